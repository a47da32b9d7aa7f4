"""Queries that write tables in each format to the shared folder and read them back."""

from __future__ import annotations

from pyspark.sql import functions as F

from trilune.functions.text import clean_text
from trilune.plans.lexicon import SQL as LEX
from trilune.plans.lexicon import graph
from trilune.sources import files as S
from trilune.sources.tables import scratch, table


def jsonl_source(spark, d):
    x = table(spark, d, "documents").select("doc_id", "text", "lang")
    x.write.json(path := scratch(spark, "jsonl"))
    return S.read_jsonl(spark, path, x.schema)


def tsv_source(spark, d):
    x = table(spark, d, "customer")
    x.write.option("sep", "\t").option("header", True).csv(path := scratch(spark, "tsv"))
    return S.read_delimited(spark, path, x.schema)


def csv_source(spark, d):
    x = table(spark, d, "conversations").select(
        "conv_id",
        "turn",
        "role",
        F.regexp_replace("text", r"[\r\n]+", " ").alias("text"),
    )
    x.write.option("header", True).option("escape", '"').csv(path := scratch(spark, "csv"))
    return spark.read.schema(x.schema).option("header", True).option("escape", '"').csv(path)


def orc_source(spark, d):
    table(spark, d, "orders").write.orc(path := scratch(spark, "orc"))
    return spark.read.orc(path).select("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority")


def qrels_source(spark, d):
    x = table(spark, d, "labels").select(F.concat_ws(" ", F.lit("q1"), F.lit("0"), "doc_id", "quality").alias("value"))
    x.unionByName(spark.createDataFrame([("broken line",), ("q1 0 x notanumber",)], "value string")).write.text(
        path := scratch(spark, "qrels"),
    )
    return S.read_qrels(spark, path).select("query_id", F.col("doc_id").cast("long").alias("doc_id"), "relevance")


def run_source(spark, d):
    x = (
        table(spark, d, "embeddings")
        .groupBy(F.col("label").cast("string").alias("query_id"))
        .agg(
            F.sort_array(F.collect_list(F.struct(F.col("vec_id").cast("string").alias("doc_id"), (F.col("vec_id") / 2).alias("score")))).alias(
                "results",
            ),
        )
    )
    x.withColumn("query", F.lit("")).write.json(path := scratch(spark, "run"))
    return S.read_run(spark, path, lines=True).select("query_id", "rank", "doc_id", "score")


def graph_source(spark, d):
    e, r = graph(spark, d)
    S.write_graph(e, r, path := scratch(spark, "graph"), "http://example.org/kg/")
    return S.read_graph(spark, path)[1].select("src", "dst", "rel", "confidence")


def parquet_partitioned(spark, d):
    (
        table(spark, d, "documents")
        .select("doc_id", "lang", "n_chars").write
        .partitionBy("lang")
        .parquet(path := scratch(spark, "parts"))
    )
    return spark.read.parquet(path).groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"))


def upsert_documents(spark, d):
    """Documents of the first source replace themselves with cleaned texts."""
    x = table(spark, d, "documents").select("doc_id", "text", "source")
    new = x.where("source = 'src0'").select("doc_id", clean_text(F.col("text")).alias("text"), "source")
    return S.upserted(x, new, "doc_id").select("doc_id", F.md5(F.col("text").cast("binary")).alias("hash"))


def delete_documents(spark, d):
    x = table(spark, d, "documents")
    return (
        x.join(table(spark, d, "labels").where("toxic = 1").select("doc_id"), "doc_id", "left_anti")
        .groupBy("source")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def document_export(spark, d):
    p = F.concat(F.substring("text", 1, 200), F.lit("..."))
    return table(spark, d, "documents").select(
        "doc_id",
        "lang",
        F.when(F.length("text") > 200, p).otherwise(F.col("text")).alias("preview"),
    )


def federated(spark, d):
    """Customers and suppliers as two sources whose titles are their names' numbers; the first source wins."""
    c = table(spark, d, "customer").select(F.regexp_extract("c_name", r"(\d+)", 1).alias("title"))
    s = table(spark, d, "supplier").select(F.regexp_extract("s_name", r"(\d+)", 1).alias("title"))
    return S.merged([("customer", c), ("supplier", s)], None, None).groupBy("source").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {
    f.__name__: f
    for f in (jsonl_source, tsv_source, csv_source, orc_source, qrels_source, run_source, graph_source, parquet_partitioned, upsert_documents, delete_documents, document_export, federated)
}

_CLEAN = (
    r"lower(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text,"
    r" 'http[s]?://(?:[a-zA-Z]|[0-9]|[$-_@.&+]|[!*\\(\\),]|(?:%[0-9a-fA-F][0-9a-fA-F]))+', '', 'g'), '<[^>]+>', '',"
    r" 'g'), '\S+@\S+', '', 'g'), '\n+', ' ', 'g'), '\s+', ' ', 'g')))"
)

SQL = {
    "jsonl_source": "SELECT doc_id, text, lang FROM documents",
    "tsv_source": "SELECT * FROM customer",
    "csv_source": r"SELECT conv_id, turn, role, regexp_replace(text, '[\r\n]+', ' ', 'g') AS text FROM conversations",
    "orc_source": "SELECT o_orderkey, o_custkey, o_totalprice, o_orderpriority FROM orders",
    "qrels_source": "SELECT 'q1' AS query_id, doc_id, quality AS relevance FROM labels",
    "run_source": (
        "SELECT label::VARCHAR AS query_id, row_number() OVER (PARTITION BY label"
        " ORDER BY vec_id::VARCHAR)::INT AS rank, vec_id::VARCHAR AS doc_id, vec_id / 2.0::DOUBLE AS score"
        " FROM embeddings"
    ),
    "graph_source": LEX + " SELECT src, dst, rel, confidence FROM rel",
    "parquet_partitioned": "SELECT lang, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY lang",
    "upsert_documents": f"SELECT doc_id, md5(CASE WHEN source = 'src0' THEN {_CLEAN} ELSE text END) AS hash FROM documents",
    "delete_documents": (
        "SELECT source, count(*) AS n FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)"
        " GROUP BY source"
    ),
    "document_export": (
        "SELECT doc_id, lang, CASE WHEN length(text) > 200 THEN substr(text, 1, 200) || '...' ELSE text END AS preview"
        " FROM documents"
    ),
    "federated": (
        r"WITH u AS (SELECT regexp_extract(c_name, '(\d+)', 1) AS t, 'customer' AS source FROM customer UNION ALL"
        r" SELECT regexp_extract(s_name, '(\d+)', 1), 'supplier' FROM supplier), f AS (SELECT t, min(source) AS source"
        r" FROM u GROUP BY t) SELECT source, count(*) AS n FROM f GROUP BY source"
    ),
}
