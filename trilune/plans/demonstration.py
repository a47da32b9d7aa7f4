"""Queries of demonstrations and of a service in front of the engine."""

from __future__ import annotations

from pyspark.sql import functions as F

from trilune.operators import demonstration as D
from trilune.operators import graph as G
from trilune.operators import metrics as M
from trilune.operators import retrieval as R
from trilune.plans import retrieval as P
from trilune.plans.lexicon import SQL as LEX
from trilune.plans.lexicon import graph
from trilune.sources.tables import stored, table


def demo_corpus(spark, d):
    return D.corpus(spark)


def demo_questions(spark, d):
    return D.questions(spark)


def demo_judgments(spark, d):
    return D.judgments(spark)


def demo_seeds(spark, d):
    return D.seeds(spark)


def demo_graph(spark, d):
    """The sample graph: what the first concept leads to."""
    nodes, edges = D.sample_graph(spark)
    first = nodes.where("id = 'concept_001'").select("id")
    return G.neighbours(first, edges, 2).join(nodes, "id").select("id", "name", "hop")


def demo_evaluation(spark, d):
    """The made-up corpus searched with its own questions in English, judged by its judgments."""
    index = R.Bm25Index(D.corpus(spark), language="en")
    run = stored(
        index.search(D.questions(spark).where("language = 'en'"), 10).select("query_id", "rank", "doc_id", "score"),
        "run",
    )
    return M.evaluated(run, D.judgments(spark), ["mrr@10", "recall@10", "precision@5"]).select(
        "metric",
        F.round("value", 6).alias("value"),
    )


def tagged_types(spark, d):
    """Market segments stand in for a tagger's labels."""
    labels = F.array(*map(F.lit, ["ORG", "GPE", "PERSON", "PRODUCT", "EVENT"]))
    x = table(spark, d, "customer").select(
        "c_custkey",
        F.element_at(labels, (F.col("c_custkey") % 5 + 1).cast("int")).alias("label"),
    )
    return x.select("c_custkey", D.tagged_type(F.col("label")).alias("type"))


def technical_terms(spark, d):
    """Words of parts' types with endings put to them."""
    word = F.lower(F.element_at(F.split("p_type", " "), 1))
    term = (
        F.when(F.col("p_partkey") % 3 == 0, F.concat(word, F.lit("-tion")))
        .when(F.col("p_partkey") % 3 == 1, word)
        .otherwise(F.lit("le"))
    )
    x = table(spark, d, "part").select(
        "p_partkey",
        term.alias("term"),
        F.when(F.col("p_partkey") % 2 == 0, "fr").otherwise("en").alias("language"),
    )
    return x.select("p_partkey", D.technical_term(F.col("term"), F.col("language")).alias("technical"))


def dependency_relations(spark, d):
    roles = lambda names, k: F.element_at(F.array(*map(F.lit, names)), (F.col("p_partkey") % k + 1).cast("int"))
    x = table(spark, d, "part").select(
        "p_partkey",
        roles(["nsubj", "prep", "amod"], 3).alias("a"),
        roles(["dobj", "pobj"], 2).alias("b"),
    )
    return x.select("p_partkey", D.dependency_relation(F.col("a"), F.col("b")).alias("rel"))


def valid_requests(spark, d):
    x = table(spark, d, "orders").select(
        "o_orderkey",
        F.when(F.col("o_orderkey") % 7 != 0, "q").otherwise(" ").alias("query"),
        F.when(F.col("o_orderkey") % 5 == 0, "de").otherwise("fr").alias("language"),
        (F.col("o_orderkey") % 120).alias("top_k"),
    )
    return x.select("o_orderkey", D.valid_request(F.col("query"), F.col("language"), F.col("top_k")).alias("valid"))


def explained(spark, d):
    """Explanations of the candidates' scores, with the document's words that are entities."""
    e, _ = graph(spark, d)
    parts = stored(P.fused_explain(spark, d), "parts")
    names = (
        P.doc_entities(spark, d, e)
        .join(e.select("id", "name", "ord"), "id")
        .join(parts.select("doc_id").distinct(), "doc_id", "left_semi")
    )
    names = names.groupBy("doc_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("ord", "name"))), lambda x: x["name"]).alias("entities"),
    )
    rows = parts.join(names, "doc_id", "left").withColumn(
        "entities",
        F.coalesce("entities", F.array().cast("array<string>")),
    )
    return rows.select("query_id", "doc_id", D.explanation(P.WEIGHTS).alias("text"))


def template_exercises(spark, d):
    x = table(spark, d, "part").select(
        "p_partkey",
        D.template_exercise(F.col("p_brand"), F.col("p_type"), F.col("p_size").cast("string")).alias("x"),
    )
    return x.select("p_partkey", "x.*")


def health(spark, d):
    e, r = graph(spark, d)
    sizes = [
        x.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("what"), "n")
        for name, x in (("entities", e), ("relations", r))
    ]
    return sizes[0].unionByName(sizes[1])


#: Made-up data for trying things out; no queries of the engine, as they read no table.
FIXTURES = {f.__name__: f for f in (demo_corpus, demo_questions, demo_judgments, demo_seeds, demo_graph, demo_evaluation)}

QUERIES = {
    f.__name__: f
    for f in (tagged_types, technical_terms, dependency_relations, valid_requests, explained, template_exercises, health)
}

_T = (
    "t AS (SELECT i, ['fr', 'zh', 'en'][(i - 1) % 3 + 1] AS language, "
    + ", ".join(f"{[t[x] for t in D.TOPICS]}[(i - 1) % 10 + 1] AS {x}" for x in D.LANGUAGES)
    + " FROM range(1, 101) r(i))"
)
_TERM = "CASE language WHEN 'fr' THEN fr WHEN 'zh' THEN zh ELSE en END"
_SAID = lambda table: (
    "CASE language " + " ".join(f"WHEN '{k}' THEN replace('{v}', '{{}}', {k})" for k, v in table.items()) + " END"
)

FIXTURE_SQL = {
    "demo_corpus": f"WITH {_T} SELECT printf('doc_%04d', i) AS doc_id, upper(language) || ': ' || {_TERM} AS title, {_SAID(D.SAYINGS)} AS text, language FROM t",
    "demo_questions": f"WITH {_T} SELECT 'q' || i AS query_id, {_SAID(D.QUESTIONS)} AS query_text, language FROM t",
    "demo_judgments": "SELECT 'q' || i AS query_id, printf('doc_%04d', (i - 1) % 10 + 10 * k + 1) AS doc_id, 1 AS relevance FROM range(1, 101) q(i), range(3) x(k)",
    "demo_seeds": f"SELECT i AS line, {[t['zh'] for t in D.TOPICS]}[(i - 1) % 10 + 1] AS e1, {[t['fr'] for t in D.TOPICS]}[(i - 1) % 10 + 1] AS e2, 0.95::DOUBLE AS confidence FROM range(1, 61) t(i)",
    "demo_graph": """SELECT * FROM (VALUES ('concept_002', '语法', 1), ('concept_003', 'subjonctif', 1), ('activity_001', '语法练习', 1), ('outcome_001', '掌握虚拟式', 2), ('resource_001', '法语语法书', 2)) t(id, name, hop)""",
}

SQL = {
    "tagged_types": "SELECT c_custkey, ['Reference', 'Culture', NULL, 'Media', 'Culture'][c_custkey % 5 + 1] AS type FROM customer",
    "technical_terms": "SELECT p_partkey, p_partkey % 3 = 0 AND p_partkey % 2 = 0 AND length(split_part(p_type, ' ', 1)) + 5 <= 20 AS technical FROM part",
    "dependency_relations": "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 OR (p_partkey % 3 = 1 AND p_partkey % 2 = 1) THEN 'belongsTo' END AS rel FROM part",
    "valid_requests": "SELECT o_orderkey, o_orderkey % 7 <> 0 AND o_orderkey % 5 <> 0 AND o_orderkey % 120 BETWEEN 1 AND 100 AS valid FROM orders",
    "template_exercises": "SELECT p_partkey, '根据概念 ''' || p_brand || ''' 生成的 ' || p_type || ' 练习题。' AS content, '答案示例' AS answer, '这道题目考察了 ' || p_brand || ' 的核心概念，难度为 ' || p_size || '。' AS explanation FROM part",
    "health": LEX + " SELECT 'entities' AS what, count(*) AS n FROM ent UNION ALL SELECT 'relations', count(*) FROM rel",
    "explained": f"""{LEX}, p AS (SELECT * FROM ({P.SQL["fused_explain"]})
), w AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+'))) AS token FROM documents WHERE doc_id IN (SELECT doc_id FROM p)
), n AS (SELECT doc_id, list(name ORDER BY ord) AS names FROM w JOIN ent ON name = token GROUP BY doc_id)
SELECT query_id, p.doc_id, 'Document: ' || p.doc_id || printf(e'\\n  Final Score: %.4f\\n    - Dense: %.4f (α=0.40)\\n    - BM25: %.4f (β=0.30)\\n    - KG: %.4f (γ=0.30)\\n  Entities: ', p."final" + 1e-9::DOUBLE, p.dense + 1e-9::DOUBLE, p.bm25 + 1e-9::DOUBLE, p.kg + 1e-9::DOUBLE)
  || coalesce(array_to_string(names[1:5], ', '), '') || CASE WHEN len(names) > 5 THEN ' ... (' || len(names) || ' total)' ELSE '' END AS text FROM p LEFT JOIN n USING (doc_id)""",
}
