"""A knowledge graph over the corpus' own words, linked by rank: the most widespread words of each language, one for every
hundred documents of the corpus and at least LEAST, so that the graph grows with the data."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trilune.functions.text import ascii_upper, tokenize
from trilune.sources.tables import kept, stored, table

LEAST, EVERY = 50, 100


def entities(spark, d) -> DataFrame:
    docs = table(spark, d, "documents").where(F.col("lang").isin("en", "fr", "es", "de"))
    size = max(LEAST, table(spark, d, "documents").count() // EVERY)
    words = docs.select("lang", F.explode(F.array_distinct(tokenize(F.col("text")))).alias("token")).where(
        F.length("token") >= 4,
    )
    df = words.groupBy("lang", "token").agg(F.count(F.lit(1)).alias("df"))
    r = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("df"), "token")) - 1
    top = df.withColumn("r", r.cast("long")).where(F.col("r") < size)
    ids = F.concat_ws(":", "lang", "token")
    return stored(
        top.select(
            ids.alias("id"),
            F.col("token").alias("name"),
            F.when(F.col("r") % 10 == 9, "Grammar").otherwise("Word").alias("type"),
            F.col("lang").alias("language"),
            F.lit(None).cast("string").alias("description"),
            F.array(ascii_upper(F.col("token"))).alias("aliases"),
            (1 / (1 + F.col("r") % 4)).alias("confidence"),
            "r",
            F.row_number().over(Window.orderBy("lang", "r")).cast("long").alias("ord"),
        ),
        "lexicon",
    )


def relations(e: DataFrame) -> DataFrame:
    a = e.select(F.col("id").alias("src"), "language", "r")
    target = e.select(F.col("id").alias("dst"), F.col("language").alias("l2"), F.col("r").alias("r2"))
    links = [
        ("translatedAs", (F.col("language") == "en") & (F.col("l2") == "fr") & (F.col("r") == F.col("r2"))),
        (
            "hasPrereq",
            (F.col("language") == F.col("l2")) & (F.col("r") >= 1) & (F.floor(F.col("r") / 2) == F.col("r2")),
        ),
        (
            "belongsTo",
            (
                (F.col("language") == F.col("l2"))
                & (F.floor(F.col("r") / 5) * 5 == F.col("r2"))
                & (F.col("r") != F.col("r2"))
            ),
        ),
        ("sameAs", (F.col("language") == F.col("l2")) & (F.col("r") % 7 == 0) & (F.col("r") + 1 == F.col("r2"))),
    ]
    out = None
    for rel, on in links:
        x = a.join(target, on).select(
            "src",
            "dst",
            F.lit(rel).alias("rel"),
            (1 / (1 + F.col("r") % 4)).alias("confidence"),
        )
        out = x if out is None else out.unionByName(x)
    return stored(
        out.withColumn("ord", F.row_number().over(Window.orderBy("rel", "src", "dst")).cast("long")),
        "relations",
    )


def graph(spark, d) -> tuple[DataFrame, DataFrame]:
    """Entities and relations, stored; made anew when the documents change."""

    def made():
        e = entities(spark, d)
        return e, relations(e)

    return kept(spark, d, ("documents",), "graph", made, lambda x: x)


SQL = rf"""WITH RECURSIVE lex_w AS (
  SELECT lang, doc_id, unnest(list_distinct(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+'))) AS token FROM documents WHERE lang IN ('en', 'fr', 'es', 'de')
), lex_df AS (SELECT lang, token, count(*) AS df FROM lex_w WHERE length(token) >= 4 GROUP BY lang, token
), lex_r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY df DESC, token) - 1 AS r FROM lex_df
), ent AS (SELECT lang || ':' || token AS id, token AS name, CASE WHEN r % 10 = 9 THEN 'Grammar' ELSE 'Word' END AS type, lang AS language, 1.0::DOUBLE / (1 + r % 4) AS confidence, r,
  row_number() OVER (ORDER BY lang, r) AS ord FROM lex_r WHERE r < greatest({LEAST}, (SELECT count(*) FROM documents) // {EVERY})
), rel0 AS (
  SELECT a.id AS src, b.id AS dst, 'translatedAs' AS rel, a.confidence FROM ent a JOIN ent b ON a.language = 'en' AND b.language = 'fr' AND a.r = b.r
  UNION ALL SELECT a.id, b.id, 'hasPrereq', a.confidence FROM ent a JOIN ent b ON a.language = b.language AND a.r >= 1 AND a.r // 2 = b.r
  UNION ALL SELECT a.id, b.id, 'belongsTo', a.confidence FROM ent a JOIN ent b ON a.language = b.language AND (a.r // 5) * 5 = b.r AND a.r <> b.r
  UNION ALL SELECT a.id, b.id, 'sameAs', a.confidence FROM ent a JOIN ent b ON a.language = b.language AND a.r % 7 = 0 AND a.r + 1 = b.r
), rel AS (SELECT *, row_number() OVER (ORDER BY rel, src, dst) AS ord FROM rel0
)"""
