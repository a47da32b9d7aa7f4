"""The graph built out of documents as one pipeline, and its report."""

from __future__ import annotations

from pyspark.sql import functions as F

from trilune.functions.text import STOPWORDS
from trilune.operators import kg_build as B
from trilune.operators import layout as Y
from trilune.plans.align import _RAW, WORDS, texts
from trilune.plans.lexicon import graph
from trilune.sources import upserts as V
from trilune.sources.tables import scratch, table
from trilune.streaming import uploads as U

#: Words joined by `of` or `de` stand in for the relations that invented prose does not state.
JOINED = [("en", "belongsTo", r"\b([a-z]+) of ([a-z]+)\b"), ("fr", "belongsTo", r"(\p{Ll}+) de (\p{Ll}+)")]


def built(spark, d, upto="report"):
    return B.build(texts(spark, d), scratch(spark, "graph"), WORDS, JOINED, STOPWORDS, 4, upto=upto)


def kg_built(spark, d):
    return built(spark, d, "relations")[1].select("src", "dst", "rel", "confidence")


def kg_built_entities(spark, d):
    return built(spark, d, "entities")[0].select("id", "name", "type", "language")


def kg_built_report(spark, d):
    return built(spark, d)[2]


def uploaded_documents(spark, d):
    """Texts as files in a folder per source, taken into the store as a stream, in two runs."""
    inbox, store = scratch(spark, "inbox"), scratch(spark, "store")
    t = table(spark, d, "documents").select("text", "source")
    for part in (0, 1):
        rows = t.where(F.pmod(F.crc32(F.col("text").cast("binary")), F.lit(2)) == part)
        rows.write.mode("append").option("maxRecordsPerFile", 200).partitionBy("source").text(inbox)
        U.ingest(spark, inbox, store)
    x = U.documents(spark, store)
    return x.groupBy("status").agg(F.sum(F.length("original_text")).alias("chars"), F.sum("size").alias("bytes"))


def upserted_customers(spark, d):
    """Customers as a table whose layers are written whole: every third one changed, some added."""
    path, c = scratch(spark, "customers"), table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal")
    V.replace(c, path)
    V.upsert(c.where("c_custkey % 3 = 0").withColumn("c_acctbal", F.col("c_acctbal") + 1), path)
    V.upsert(c.where("c_custkey % 5 = 0").withColumn("c_custkey", -F.col("c_custkey") - 1), path)
    return V.read(spark, path, "c_custkey").select("c_custkey", "c_name", F.round("c_acctbal", 2).alias("c_acctbal"))


def kg_layout(spark, d):
    """Places of the word graph's nodes in the plane."""
    e, r = graph(spark, d)
    return Y.spring(e, r, 8).select("id", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"))


QUERIES = {f.__name__: f for f in (kg_layout, upserted_customers, uploaded_documents, kg_built, kg_built_entities, kg_built_report)}

_BUILD = (
    f"""WITH {_RAW}, x AS (SELECT language, type, min((doc, name)) AS b FROM en
  WHERE length(name) >= 4 AND NOT (language = 'en' AND lower(name) = 'being') GROUP BY language, type, lower(name)
), ex AS (SELECT b[1] AS doc, language, type, b[2] AS name FROM x
), i AS (SELECT lower(type) || '_' || language || '_' || substr(md5(type || '¦' || language || '¦' || lower(name)), 1, 8) AS id, name, type, language, (doc, language, type, name) AS ord FROM ex
), e AS (SELECT id, min_by(name, ord) AS name, min_by(type, ord) AS type, min_by(language, ord) AS language, min(ord) AS ord FROM i GROUP BY id
), ix AS (SELECT lower(name) AS key, max_by(id, ord) AS id FROM e GROUP BY lower(name)
), sp AS ("""
    + " UNION ALL ".join(
        f"SELECT doc_id AS doc, unnest(regexp_extract_all(text, '{p}', 1)) AS l, unnest(regexp_extract_all(text, '{p}', 2)) AS r FROM documents WHERE lang = '{lang}'"
        for lang, _, p in JOINED
    )
    + r"""), sd AS (SELECT DISTINCT t FROM (SELECT l AS t FROM sp UNION ALL SELECT r FROM sp)
), mt AS (SELECT t, min_by(i.name, i.ord) AS name FROM sd JOIN i ON contains(lower(t), lower(i.name)) OR contains(lower(i.name), lower(t)) GROUP BY t
), rw AS (SELECT doc, a.name AS src, b.name AS dst FROM sp JOIN mt a ON a.t = l JOIN mt b ON b.t = r WHERE a.name <> b.name
), fd AS (SELECT min((doc, src, dst)) AS b FROM rw GROUP BY lower(src), lower(dst)
), rl AS (SELECT DISTINCT s.id AS src, t.id AS dst FROM fd JOIN ix s ON s.key = lower(b[2]) JOIN ix t ON t.key = lower(b[3]))"""
)

SQL = {
    "upserted_customers": """SELECT c_custkey, c_name, round(c_acctbal + (c_custkey % 3 = 0)::INT, 2) AS c_acctbal FROM customer
UNION ALL SELECT -c_custkey - 1, c_name, round(c_acctbal, 2) FROM customer WHERE c_custkey % 5 = 0""",
    "uploaded_documents": "SELECT 'success' AS status, sum(length(text) + 1)::BIGINT AS chars, sum(strlen(text) + 1)::BIGINT AS bytes FROM documents",
    "kg_built": f"{_BUILD} SELECT src, dst, 'belongsTo' AS rel, 0.85::DOUBLE AS confidence FROM rl",
    "kg_built_entities": f"{_BUILD} SELECT id, name, type, language FROM e",
    "kg_built_report": f"""{_BUILD}, al AS (SELECT src AS id FROM rl UNION SELECT dst FROM rl)
SELECT 'corpus_size' AS measure, count(*) AS "value" FROM documents UNION ALL SELECT 'entities_extracted', count(*) FROM ex UNION ALL SELECT 'entities_added', count(*) FROM e
UNION ALL SELECT 'relations_extracted', count(*) FROM fd UNION ALL SELECT 'relations_added', count(*) FROM rl
UNION ALL SELECT 'entities ' || d.l, count(e.id) FROM (SELECT unnest(['zh', 'fr', 'en']) AS l) d LEFT JOIN e ON e.language = d.l GROUP BY d.l
UNION ALL SELECT 'isolated ' || d.l, count(e.id) FROM (SELECT unnest(['zh', 'fr', 'en']) AS l) d LEFT JOIN e ON e.language = d.l AND e.id NOT IN (SELECT id FROM al) GROUP BY d.l""",
}
