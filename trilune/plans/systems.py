"""Queries of whole search systems: four of them evaluated, their statistics, their files; reranking by a graph and vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from trilune.operators import dictionary as D
from trilune.operators import graph as G
from trilune.operators import retrieval as R
from trilune.operators import system as S
from trilune.plans import learned as L
from trilune.plans import retrieval as P
from trilune.plans.lexicon import SQL as LEX
from trilune.plans.lexicon import graph
from trilune.sources.files import read_run
from trilune.sources.tables import scratch, stored, table

MEASURES = ["ndcg@10", "mrr", "recall@10", "precision@10"]
BASE = "fused"


def passages(spark, d):
    """Documents that hold the beginning of an item are relevant to it."""
    i = P.items(spark, d).select("query_id", F.lower(F.substring("query_text", 1, 40)).alias("found"))
    docs = table(spark, d, "documents").select("doc_id", "text")
    held = D.mentions(docs, "text", i, "found", whole=False, keep=["doc_id"], once=True)
    return held.join(i, "found").select("query_id", "doc_id", F.lit(1).alias("relevance")).distinct()


def runs(spark, d):
    """The four systems' rankings, ten documents each. The last three are made of the same two searches."""
    first = lambda run: stored(run.where("rank <= 10").select("query_id", "rank", "doc_id", "score"), "run")
    found = P.searched(spark, d, 100)
    return {
        "translated": first(L.translated_search(spark, d)),
        "dense": first(found["dense"]),
        "hybrid": first(P.hybrid_half(spark, d, found)),
        BASE: first(P.fused_search(spark, d, found)),
    }


def systems_evaluated(spark, d):
    """Means of four systems, and how much the fused one exceeds each."""
    qrels = stored(passages(spark, d), "qrels")
    asked = P.items(spark, d)
    values = {name: stored(S.per_query(run, qrels, asked, MEASURES), "values") for name, run in runs(spark, d).items()}
    out = S.compared(values, BASE)
    return out.select("system", "metric", *[F.round(c, 6).alias(c) for c in out.columns[2:]])


def expander_statistics(spark, d):
    return S.expander_statistics(*graph(spark, d), 2, 0.8)


def system_statistics(spark, d):
    parts = {"bm25": P.bm25_stats(spark, d), "dense": P.dense_stats(spark, d)}
    return S.system_statistics(P.WEIGHTS, True, parts, expander_statistics(spark, d))


def search_run_file(spark, d):
    """The fused search's results as a file, read back."""
    S.write_run(P.fused_search(spark, d), P.items(spark, d), path := scratch(spark, "run"))
    run = read_run(spark, path, lines=True)
    return run.select(F.col("query_id").cast("long").alias("query_id"), "rank", F.col("doc_id").cast("long").alias("doc_id"), "score")


def expanded_queries_file(spark, d):
    S.write_expanded(P.kg_expand_query(spark, d), P.items(spark, d), path := scratch(spark, "expanded"))
    return S.read_expanded(spark, path)


def hops(e, r, most: int, decay: float):
    """(source, name, w): names within `most` hops, weighted by decay per hop."""
    near = G.neighbours(e.select("id"), r, most)
    return near.join(e.select("id", "name"), "id").select("source", "name", F.pow(F.lit(decay), F.col("hop")).alias("w"))


def rerank_full(spark, d):
    """Candidates of the dense and the sparse search again, with names that they share: a query's within two hops, a document's within one."""
    e, r = graph(spark, d)
    far, near = stored(hops(e, r, 2, 0.8), "far"), stored(hops(e, r, 1, 0.8), "near")

    def weigh(found, key, around):
        own = found.join(e.select("id", "name"), "id").select(key, "name", F.lit(1.0).alias("w"))
        more = found.withColumnRenamed("id", "source").join(around, "source").select(key, "name", "w")
        return own.unionByName(more).groupBy(key, "name").agg(F.max("w").alias("w"))

    bm = stored(P.index(spark, d).search(P.items(spark, d), 20).select("query_id", "doc_id", "score"), "bm25")
    dense = stored(P.dense_list(spark, d, 20), "dense")
    keys = stored(bm.select("query_id", "doc_id").union(dense.select("query_id", "doc_id")).distinct(), "keys")
    kept = P.doc_entities(spark, d, e).join(keys.select("doc_id").distinct(), "doc_id", "left_semi")
    kg = R.weighted_jaccard(weigh(P.query_entities(spark, d, e), "query_id", far), weigh(kept, "doc_id", near), keys)
    kg = keys.join(kg, ["query_id", "doc_id"], "left").fillna(0.0, ["score"])
    out = R.fuse({"dense": dense, "bm25": bm, "kg": kg}, P.WEIGHTS).withColumn("score", F.round("final", 6))
    return R.top(out, 10, "query_id", F.col("doc_id")).select("query_id", "rank", "doc_id", "score")


QUERIES = {
    f.__name__: f
    for f in (systems_evaluated, expander_statistics, system_statistics, search_run_file, expanded_queries_file, rerank_full)
}

_EXPANDER = (
    "SELECT 'expander' AS part, unnest(['max_hops', 'decay_factor', "
    + ", ".join(f"'weight {k}'" for k in G.RELATION_WEIGHTS)
    + "]) AS name, unnest([2.0::DOUBLE, 0.8, "
    + ", ".join(map(str, G.RELATION_WEIGHTS.values()))
    + """]) AS "value" UNION ALL SELECT 'expander', 'num_entities', count(*) FROM ent UNION ALL SELECT 'expander', 'num_relations', count(*) FROM rel"""
)
_PARTS = """
UNION ALL SELECT 'weights', unnest(['dense', 'bm25', 'kg']), unnest([0.4::DOUBLE, 0.3, 0.3]) UNION ALL SELECT 'system', 'normalize_scores', 1
UNION ALL SELECT 'bm25', 'documents', count(*) FROM dl UNION ALL SELECT 'bm25', 'avgdl', round(avg(dl), 6) FROM dl UNION ALL SELECT 'bm25', 'tokens', sum(dl) FROM dl
UNION ALL SELECT 'bm25', 'vocabulary', count(*) FROM wt UNION ALL SELECT 'dense', 'vectors', count(*) FROM embeddings UNION ALL SELECT 'dense', 'dimension', max(len(embedding)) FROM embeddings
UNION ALL SELECT 'dense', 'longest', max(round(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 4)) FROM embeddings"""
_HOPS = """ed AS (SELECT DISTINCT src, dst FROM rel), n1 AS (SELECT DISTINCT src AS source, dst AS id FROM ed WHERE src <> dst
), n2 AS (SELECT DISTINCT n1.source, ed.dst AS id FROM n1 JOIN ed ON ed.src = n1.id WHERE ed.dst <> n1.source AND NOT EXISTS (SELECT 1 FROM n1 x WHERE x.source = n1.source AND x.id = ed.dst)
), nr AS (SELECT source, name, 0.8::DOUBLE AS w FROM n1 JOIN ent ON ent.id = n1.id), fr AS (SELECT * FROM nr UNION ALL SELECT source, name, 0.8::DOUBLE * 0.8 FROM n2 JOIN ent ON ent.id = n2.id
), qn AS (SELECT query_id, name, max(w) AS w FROM (SELECT query_id, name, 1.0::DOUBLE AS w FROM qe JOIN ent ON ent.id = qe.id UNION ALL SELECT query_id, name, w FROM qe JOIN fr ON fr.source = qe.id) GROUP BY ALL
), tn AS (SELECT doc_id, name, max(w) AS w FROM (SELECT doc_id, name, 1.0::DOUBLE AS w FROM te JOIN ent ON ent.id = te.id UNION ALL SELECT doc_id, name, w FROM te JOIN nr ON nr.source = te.id) GROUP BY ALL
), qw AS (SELECT query_id, sum(w) AS w FROM qn GROUP BY query_id), tw AS (SELECT doc_id, sum(w) AS w FROM tn GROUP BY doc_id
), cand AS (SELECT query_id, doc_id FROM bm UNION SELECT query_id, doc_id FROM de
), mm AS (SELECT c.query_id, c.doc_id, sum(least(qn.w, tn.w)) AS m FROM cand c JOIN qn ON qn.query_id = c.query_id JOIN tn ON tn.doc_id = c.doc_id AND tn.name = qn.name GROUP BY ALL
), kg AS (SELECT c.query_id, c.doc_id, coalesce(m / (qw.w + tw.w - m), 0) AS score FROM cand c LEFT JOIN mm USING (query_id, doc_id) LEFT JOIN qw USING (query_id) LEFT JOIN tw USING (doc_id))"""

SQL = {
    "expander_statistics": f"{LEX} {_EXPANDER}",
    "system_statistics": f"{LEX}, {P._bm25(10)} {_EXPANDER} {_PARTS}",
    "search_run_file": P.SQL["fused_search"],
    "expanded_queries_file": P.SQL["kg_expand_query"],
    "rerank_full": (
        f"{LEX}, {P._bm25(20)}, {P._dense(20)}, {P._ENTS}, {_HOPS}, {P._JOINED}, f AS (SELECT query_id, doc_id,"
        f" round(0.4::DOUBLE * {P._MM.format('dense')} + 0.3::DOUBLE * {P._MM.format('bm25')} + 0.3::DOUBLE * {P._MM.format('kg')},"
        f" 6) AS score FROM jo WINDOW q AS (PARTITION BY query_id)), r AS (SELECT *,"
        f" row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM f)"
        f" SELECT query_id, rank::INT AS rank, doc_id, score FROM r WHERE rank <= 10"
    ),
}
