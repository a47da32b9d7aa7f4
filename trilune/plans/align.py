"""Queries of alignment and extraction."""

from __future__ import annotations

from pyspark.sql import functions as F

from trilune.functions.text import STOPWORDS
from trilune.operators import align as A
from trilune.operators import extract as X
from trilune.operators import graph_encoder as N
from trilune.operators import metrics as M
from trilune.operators import translation as B
from trilune.plans.lexicon import graph
from trilune.sources.files import read_alignments
from trilune.sources.tables import scratch, stored, table


def sides(spark, d):
    """Vectors with odd and even ids are the two languages."""
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("x"), "label")
    return v.where("id % 2 = 1"), v.where("id % 2 = 0")


def pairs(spark, d, k=5, least=0.2):
    left, right = sides(spark, d)
    return stored(A.candidates(left, right, k, least), "candidates")


def align_cosine(spark, d):
    return pairs(spark, d)


def align_fused(spark, d):
    p = pairs(spark, d)
    return A.fused(p.where("confidence < 0.35"), p.where("confidence > 0.3").withColumn("confidence", F.col("confidence") * 0.5)).withColumn(
        "confidence",
        F.round("confidence", 9),
    )


def align_one_to_one(spark, d):
    return A.one_to_one(pairs(spark, d))


def gold(spark, d):
    """All pairs of one label: their number grows with the square of the vectors, so they are told by labels."""
    left, right = sides(spark, d)
    return M.ClassGold(left.select(F.col("id").alias("e1"), F.col("label").alias("class")), right.select(F.col("id").alias("e2"), F.col("label").alias("class")))


def align_metrics(spark, d):
    x = M.alignment_metrics(pairs(spark, d), gold(spark, d))
    return x.select("k", *[F.round(c, 6).alias(c) for c in x.columns[1:]])


def align_precision_recall(spark, d):
    x = M.precision_recall(pairs(spark, d), gold(spark, d))
    return x.select("k", F.round("precision", 6).alias("precision"), F.round("recall", 9).alias("recall"))


def align_compare(spark, d):
    """All candidates against those of at least 0.4, metric by metric."""
    p = pairs(spark, d)
    x = M.compared({"all": p, "sure": p.where("confidence >= 0.4")}, gold(spark, d))
    return x.select("metric", F.round("all", 6).alias("all_pairs"), F.round("sure", 6).alias("sure_pairs"))


def align_file(spark, d):
    """Alignments as a file of three columns, read back; short lines are left out."""
    lines = align_tsv(spark, d).unionByName(spark.createDataFrame([("short\tline",)], "line string"))
    lines.withColumnRenamed("line", "value").write.text(path := scratch(spark, "alignments"))
    return read_alignments(spark, path)


def align_gcn(spark, d):
    """Entities of the word graph, whose vectors are their rank's digits: predicted partners of English words among French ones."""
    e, r = graph(spark, d)
    x = e.select(
        "id",
        "language",
        F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.when(F.col("r") % 8 == i, 1.0).otherwise(0.1)).alias(
            "x",
        ),
    )
    z = stored(A.propagated(x, r.where("rel <> 'translatedAs'")), "averaged")
    side = lambda lang: z.join(e.where(F.col("language") == lang).select("id"), "id", "left_semi")
    return N.predicted(side("en"), side("fr"), 3, 0.5).select("e1", "e2", F.round("confidence", 4).alias("confidence"))


def align_statistics(spark, d):
    return pairs(spark, d).agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.avg("confidence"), 6).alias("mean"),
        F.countDistinct("e1").alias("sources"),
    )


def align_tsv(spark, d):
    return pairs(spark, d).select(
        F.concat_ws("\t", "e1", "e2", F.format_string("%.4f", F.col("confidence") + 1e-9), F.lit("cosine")).alias(
            "line",
        ),
    )


def align_linear_map(spark, d):
    """How far the best linear map over all gold pairs takes each label's first vector from its second: rows by label.

    A left vector's pairs are one row, their mean on the right, weighted by their number: the moments are the same.
    """
    left, right = sides(spark, d)
    first = lambda v, n: v.groupBy("label").agg(F.min_by("x", "id").alias(n))
    both = stored(first(left, "x").join(first(right, "y"), "label"), "seeds")
    n = right.where("x is not null").groupBy("label").agg(F.sqrt(F.count(F.lit(1))).alias("w"))
    mean = (
        right.select("label", F.posexplode("x").alias("i", "v"))
        .groupBy("label", "i")
        .agg(F.avg("v").alias("v"))
        .groupBy("label")
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda s: s["v"]).alias("y"))
    )
    weighted = lambda c: F.transform(c, lambda v: v * F.col("w")).alias(c)
    m = A.linear_map(
        left.where("x is not null").join(mean.join(n, "label"), "label").select(weighted("x"), weighted("y")),
    )
    image = F.array(
        *[
            F.aggregate(
                F.zip_with("x", F.array(*[F.lit(float(w)) for w in m[:, j]]), lambda a, b: a * b),
                F.lit(0.0),
                lambda s,
                v: s + v,
            )
            for j in range(m.shape[1])
        ],
    )
    return both.select(
        "label",
        F.round(F.sqrt(F.aggregate(F.zip_with(image, "y", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v)), 4).alias(
            "distance",
        ),
    )


def triples(spark, d):
    e, r = graph(spark, d)
    return r.join(e.select(F.col("id").alias("src"), "language"), "src").select(
        "language",
        F.col("src").alias("h"),
        F.col("rel").alias("r"),
        F.col("dst").alias("t"),
    )


def kg_embeddings(spark, d):
    """Each word that relations of its language start from, and how far these lead past their ends on average."""
    t = stored(triples(spark, d), "triples")
    far = B.distances(t, "language", *B.embedded(t, "language"))
    return far.groupBy("language", F.col("h").alias("name")).agg(
        F.count("*").alias("n"),
        F.round(F.avg("distance"), 4).alias("distance"),
    )


def kg_propagated(spark, d):
    e, r = graph(spark, d)
    x = e.select(
        "id",
        F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.when(F.col("r") % 8 == i, 1.0).otherwise(0.0)).alias(
            "x",
        ),
    )
    return (
        A.propagated(x, r)
        .select("id", F.transform("x", lambda v: F.round(v, 4)).alias("x"))
        .select("id", F.array_join(F.col("x").cast("array<string>"), " ").alias("x"))
    )


#: The corpus is invented prose, so patterns over its own endings and stop words stand in for the grammar's.
WORDS = [
    ("en", "Word", r"\b[a-z]+ing\b"),
    ("en", "Grammar", r"\b[a-z]+tion\b"),
    ("fr", "Word", r"\p{L}+ment"),
    ("fr", "Grammar", r"\p{L}+tion"),
]


def texts(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").alias("doc"), "text", F.col("lang").alias("language"))


def extract_entities(spark, d):
    return X.kept_entities(X.entities(texts(spark, d), WORDS), STOPWORDS, 4).select(
        "language",
        "type",
        F.lower("name").alias("name"),
        "doc",
    )


def extract_counts(spark, d):
    return X.entities(texts(spark, d), WORDS).groupBy("language", "type").agg(F.count(F.lit(1)).alias("n"))


def extract_grammar(spark, d):
    """The catalogue of grammar, course and level patterns over all texts."""
    return X.entities(texts(spark, d)).groupBy("language", "type", "name").agg(F.count(F.lit(1)).alias("n"))


def pattern_relations(spark, d):
    """Words joined by `of` or `de` directly, as relations between the words."""
    pats = [("en", "belongsTo", r"\b([a-z]+) of ([a-z]+)\b"), ("fr", "belongsTo", r"(\p{Ll}+) de (\p{Ll}+)")]
    s = X.relation_spans(texts(spark, d), pats)
    return s.groupBy("language", "rel", "left", "right").agg(F.count(F.lit(1)).alias("n"))


def relation_sentences(spark, d):
    return (
        X.relation_spans(texts(spark, d))
        .groupBy("language", "rel")
        .agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("left")).alias("left_chars"))
    )


def cooccurrence_window(spark, d):
    p = stored(X.places(texts(spark, d), "[a-z]+tion"), "places")
    return X.cooccurrences(p).groupBy("name", "name2").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {
    f.__name__: f
    for f in (align_cosine, align_fused, align_one_to_one, align_metrics, align_precision_recall, align_compare, align_file, align_gcn, align_statistics, align_tsv, align_linear_map, kg_embeddings, kg_propagated, extract_entities, extract_counts, extract_grammar, pattern_relations, relation_sentences, cooccurrence_window)
}

_P = (
    "pr AS (SELECT e1, e2, confidence FROM (SELECT a.vec_id AS e1, b.vec_id AS e2,"
    " round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS confidence,"
    " row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_dot_product(a.embedding::DOUBLE[],"
    " b.embedding::DOUBLE[]), 6) DESC, b.vec_id) AS k FROM embeddings a, embeddings b WHERE a.vec_id % 2 = 1"
    " AND b.vec_id % 2 = 0) WHERE k <= 5 AND confidence >= 0.2)"
)
_RAW = (
    "en AS ("
    + " UNION ALL ".join(
        (
            f"SELECT doc_id AS doc, lang AS language, '{k}' AS type, unnest(regexp_extract_all(text, '{p}')) AS name"
            f" FROM documents WHERE lang = '{l}'"
        )
        for l, k, p in WORDS
    )
    + ")"
)
_AT = (
    "pl AS (SELECT doc, m AS name, off AS pos FROM (SELECT doc, unnest(n) AS m, unnest(list_transform(range(len(n)),"
    " lambda i: coalesce(list_sum(list_transform(n[1:i], lambda s: length(s))),"
    " 0)::BIGINT + list_sum(list_transform(g[1:i + 1], lambda s: length(s)))::BIGINT)) AS off"
    " FROM (SELECT doc_id AS doc, regexp_extract_all(text, '[a-z]+tion') AS n, regexp_split_to_array(text,"
    " '[a-z]+tion') AS g FROM documents)))"
)

_METRICS = (
    "WITH {0}, g AS (SELECT a.vec_id AS e1, b.vec_id AS e2 FROM embeddings a JOIN embeddings b ON a.label = b.label"
    " AND a.vec_id % 2 = 1 AND b.vec_id % 2 = 0), h AS (SELECT pr.*, (g.e1 IS NOT NULL)::INT AS ok,"
    " row_number() OVER (ORDER BY confidence DESC, pr.e1, pr.e2) AS n, row_number() OVER (PARTITION BY pr.e1"
    " ORDER BY confidence DESC, pr.e2) AS own FROM pr LEFT JOIN g USING (e1, e2)), s AS (SELECT e1, min(CASE"
    " WHEN ok = 1 THEN own END) AS first FROM h GROUP BY e1), k AS (SELECT unnest([1, 5, 10, 50]) AS k),"
    " c AS (SELECT k, least(k, (SELECT count(*) FROM pr)) AS size, (SELECT sum(ok) FROM h"
    " WHERE n <= k) AS hits, (SELECT avg(coalesce((first <= k)::INT, 0))"
    " FROM s) AS hk, (SELECT avg(coalesce(1.0::DOUBLE / first, 0)) FROM s) AS mrr, (SELECT count(*) FROM g) AS m"
    " FROM k) SELECT k, round(hits::DOUBLE / size, 6) AS precision, round(hits::DOUBLE / m, 6) AS recall, round(CASE"
    " WHEN hits = 0 THEN 0"
    " ELSE 2 * (hits::DOUBLE / size) * (hits::DOUBLE / m) / (hits::DOUBLE / size + hits::DOUBLE / m) END, 6) AS f1,"
    " round(hk, 6) AS hits, round(mrr, 6) AS mrr FROM c"
)
_GOLD = (
    "g AS (SELECT a.vec_id AS e1, b.vec_id AS e2 FROM embeddings a JOIN embeddings b ON a.label = b.label"
    " AND a.vec_id % 2 = 1 AND b.vec_id % 2 = 0)"
)


def _long(least: str) -> str:
    """The metrics of the candidates that are confident enough, a row each."""
    m = _METRICS.replace("{0}", _P).replace("AND confidence >= 0.2)", f"AND confidence >= {least})")
    parts = [f"SELECT '{c}@' || k AS metric, {c} AS v FROM m" for c in ("precision", "recall", "f1", "hits")]
    return f"(WITH m AS ({m}) " + " UNION ALL ".join(parts) + ")"


SQL = {
    "align_precision_recall": f"""WITH {_P}, {_GOLD}, h AS (SELECT confidence, pr.e1, pr.e2, (g.e1 IS NOT NULL)::INT AS ok FROM pr LEFT JOIN g USING (e1, e2)
), o AS (SELECT row_number() OVER w AS k, sum(ok) OVER w AS hits FROM h WINDOW w AS (ORDER BY confidence DESC, e1, e2 ROWS UNBOUNDED PRECEDING))
SELECT k::INT AS k, round(hits / k, 6) AS "precision", round(hits / (SELECT count(*) FROM g), 9) AS recall FROM o WHERE k <= 100""",
    "align_compare": f"SELECT a.metric, a.v AS all_pairs, b.v AS sure_pairs FROM {_long('0.2')} a JOIN {_long('0.4')} b USING (metric)",
    "align_file": f"WITH {_P} SELECT e1::VARCHAR AS e1, e2::VARCHAR AS e2, printf('%.4f', confidence + 1e-9::DOUBLE)::DOUBLE AS confidence FROM pr",
    "align_cosine": f"WITH {_P} SELECT e1, e2, confidence FROM pr",
    "align_fused": f"WITH {_P}, a AS (SELECT * FROM pr WHERE confidence < 0.35), b AS (SELECT e1, e2, confidence * 0.5::DOUBLE AS confidence FROM pr WHERE confidence > 0.3) SELECT e1, e2, round(CASE WHEN a.confidence IS NOT NULL AND b.confidence IS NOT NULL THEN 0.5::DOUBLE * a.confidence + 0.5::DOUBLE * b.confidence ELSE coalesce(a.confidence, b.confidence) END, 9) AS confidence, CASE WHEN a.confidence IS NOT NULL AND b.confidence IS NOT NULL THEN 'fused' WHEN a.confidence IS NOT NULL THEN 'first' ELSE 'second' END AS source FROM a FULL JOIN b USING (e1, e2)",
    "align_metrics": f"WITH {_P}, g AS (SELECT a.vec_id AS e1, b.vec_id AS e2 FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id % 2 = 1 AND b.vec_id % 2 = 0), h AS (SELECT pr.*, (g.e1 IS NOT NULL)::INT AS ok, row_number() OVER (ORDER BY confidence DESC, pr.e1, pr.e2) AS n, row_number() OVER (PARTITION BY pr.e1 ORDER BY confidence DESC, pr.e2) AS own FROM pr LEFT JOIN g USING (e1, e2)), s AS (SELECT e1, min(CASE WHEN ok = 1 THEN own END) AS first FROM h GROUP BY e1), k AS (SELECT unnest([1, 5, 10, 50]) AS k), c AS (SELECT k, least(k, (SELECT count(*) FROM pr)) AS size, (SELECT sum(ok) FROM h WHERE n <= k) AS hits, (SELECT avg(coalesce((first <= k)::INT, 0)) FROM s) AS hk, (SELECT avg(coalesce(1.0::DOUBLE / first, 0)) FROM s) AS mrr, (SELECT count(*) FROM g) AS m FROM k) SELECT k, round(hits::DOUBLE / size, 6) AS precision, round(hits::DOUBLE / m, 6) AS recall, round(CASE WHEN hits = 0 THEN 0 ELSE 2 * (hits::DOUBLE / size) * (hits::DOUBLE / m) / (hits::DOUBLE / size + hits::DOUBLE / m) END, 6) AS f1, round(hk, 6) AS hits, round(mrr, 6) AS mrr FROM c",
    "align_statistics": f"WITH {_P} SELECT count(*) AS n, round(avg(confidence), 6) AS mean, count(DISTINCT e1) AS sources FROM pr",
    "align_tsv": f"WITH {_P} SELECT e1 || e'\\t' || e2 || e'\\t' || printf('%.4f', confidence + 1e-9::DOUBLE) || e'\\tcosine' AS line FROM pr",
    "extract_entities": f"WITH {_RAW} SELECT language, type, lower(name) AS name, min(doc) AS doc FROM en WHERE length(name) >= 4 AND NOT (language = 'en' AND name = 'being') GROUP BY language, type, lower(name)",
    "extract_counts": f"WITH {_RAW} SELECT language, type, count(*) AS n FROM en GROUP BY language, type",
    "extract_grammar": "WITH g AS (" + " UNION ALL ".join(f"SELECT lang AS language, '{k}' AS type, trim(unnest(regexp_extract_all(text, '{p}'))) AS name FROM documents WHERE lang = '{l}'" for l, k, p in X.ENTITY_PATTERNS) + ") SELECT language, type, name, count(*) AS n FROM g GROUP BY ALL",
    "pattern_relations": "WITH s AS (" + " UNION ALL ".join(f"SELECT '{l}' AS language, unnest(regexp_extract_all(text, '{p}', 1)) AS \"left\", unnest(regexp_extract_all(text, '{p}', 2)) AS \"right\" FROM documents WHERE lang = '{l}'" for l, p in (("en", r"\b([a-z]+) of ([a-z]+)\b"), ("fr", r"(\p{Ll}+) de (\p{Ll}+)"))) + ') SELECT language, \'belongsTo\' AS rel, "left", "right", count(*) AS n FROM s GROUP BY ALL',
    "cooccurrence_window": f"WITH {_AT} SELECT a.name, b.name AS name2, count(*) AS n FROM pl a JOIN pl b ON a.doc = b.doc AND a.name <> b.name AND abs(a.pos - b.pos) <= 50 GROUP BY ALL",
}
