"""Queries of evidence, exercises, paths, graph views and exports."""

from __future__ import annotations

from pyspark.sql import functions as F

from trilune.functions.text import ASCII_LOWER, ASCII_UPPER
from trilune.operators import evidence as E
from trilune.operators import graph as G
from trilune.operators import retrieval as R
from trilune.plans import retrieval as P
from trilune.plans.lexicon import SQL as LEX
from trilune.plans.lexicon import graph
from trilune.sources.tables import stored, table


def questions(spark, d, e):
    """The benchmark items, and the beginnings of the most widespread words."""
    begins = e.where("r = 0").select((-F.col("ord")).alias("query_id"), F.substring("name", 1, 3).alias("query_text"))
    return P.items(spark, d).unionByName(begins)


def kg_query_entities_full(spark, d):
    """Entities whose name or alias is part of a question, or the question part of it."""
    e, _ = graph(spark, d)
    return E.matched(questions(spark, d, e), "query_id", "query_text", e)


def found(spark, d):
    e, r = graph(spark, d)
    return E.evidence(questions(spark, d, e), e, r, stored(P.kg_expand_query(spark, d), "expansion"))


def exercise_evidence(spark, d):
    x = found(spark, d)
    return x.select(
        "query_id",
        "place",
        "id",
        F.round("score", 6).alias("score"),
        F.array_join("near", ", ").alias("near"),
    )


def exercise_mock(spark, d):
    x = E.exercises(found(spark, d), 3)
    return x.select("query_id", "id", "question", F.array_join("options", "|").alias("options"), "answer")


def exercise_prompt(spark, d):
    return E.evidence_lines(found(spark, d))


def exercise_answers(spark, d):
    """What a model may have answered to an item: exercises in JSON with words around, or no JSON."""
    n = F.col("item_id").cast("string")
    one = lambda i: F.concat(
        F.lit(f'{{"id": "q{i}", "type": "cloze", "question": "'),
        n,
        F.lit(f'-{i}", "answer": "a'),
        n,
        F.lit('"}'),
    )
    good = F.concat(
        F.lit('Here it is:\n{"exercises": ['),
        one(1),
        F.lit(", "),
        one(2),
        F.lit(", "),
        one(3),
        F.lit("]}\nGood luck"),
    )
    text = F.when(F.col("item_id") % 4 == 0, F.lit("no {json here}")).otherwise(good)
    return E.answered(table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), text.alias("text")), 2)


def kg_path_text(spark, d):
    e, r = graph(spark, d)
    pairs = (
        e.where("language = 'en'")
        .select(F.col("id").alias("src"))
        .crossJoin(F.broadcast(e.where("r = 0").select(F.col("id").alias("dst"))))
    )
    return G.shortest_paths(pairs, r).select("src", "dst", "length", "path")


def kg_paths_between(spark, d):
    """Paths from the entities of an item to those of the document of the same number."""
    e, r = graph(spark, d)
    order = e.select("id", "ord")
    q = P.query_entities(spark, d, e).join(order, "id")
    docs = table(spark, d, "documents").join(
        P.items(spark, d).select(F.col("query_id").alias("doc_id")),
        "doc_id",
        "left_semi",
    )
    t = stored(R.mentions(docs, "doc_id", "text", e), "dent").join(order, "id")
    pairs = P.items(spark, d).select("query_id", F.col("query_id").alias("doc_id"))
    return E.paths_between(pairs, q, t, r)


def kg_either_way(spark, d):
    e, r = graph(spark, d)
    pairs = (
        e.where("r between 3 and 7")
        .select(F.col("id").alias("src"))
        .crossJoin(F.broadcast(e.where("r = 1").select(F.col("id").alias("dst"))))
    )
    return E.either_way(pairs, r).select("src", "dst", "length", "path", "directed")


def kg_around(spark, d):
    e, r = graph(spark, d)
    return E.around(e.where("r < 10"), r, 2)


def kg_of_level(spark, d):
    e, r = graph(spark, d)
    return E.of_level(e, r, "e", "Word")


def kg_node_table(spark, d):
    return E.node_table(graph(spark, d)[0]).select(
        F.col("id:ID").alias("id"),
        "name",
        "language",
        F.col(":LABEL").alias("label"),
    )


def kg_edge_table(spark, d):
    return E.edge_table(graph(spark, d)[1]).select(
        F.col(":START_ID").alias("src"),
        F.col(":END_ID").alias("dst"),
        F.col(":TYPE").alias("kind"),
        "confidence",
    )


def kg_digraph(spark, d):
    return E.digraph(graph(spark, d)[1])


def search_results(spark, d):
    """The fused search with what a user sees of a document."""
    docs = table(spark, d, "documents").select(
        "doc_id",
        "lang",
        F.concat(F.substring("text", 1, 300), F.lit("...")).alias("preview"),
    )
    return P.fused_search(spark, d).join(docs, "doc_id")


QUERIES = {
    f.__name__: f
    for f in (kg_query_entities_full, exercise_evidence, exercise_mock, exercise_prompt, exercise_answers, kg_path_text, kg_paths_between, kg_either_way, kg_around, kg_of_level, kg_node_table, kg_edge_table, kg_digraph, search_results)
}


def _paths(edges: str, sources: str, tag: str) -> str:
    """Shortest paths of 1 to 3 edges as a queue finds them: by the parent's place, then by the edge's."""
    steps = [
        f"""{tag}f1 AS (SELECT src, dst AS pos, src || ' -(' || rel || ')-> ' || dst AS path, 1 AS place, ord,
  row_number() OVER (PARTITION BY src, dst ORDER BY ord) AS k FROM {edges} WHERE src <> dst AND src IN ({sources})
), {tag}1 AS (SELECT src, pos, path, 1 AS length, row_number() OVER (PARTITION BY src ORDER BY ord) AS place FROM {tag}f1 WHERE k = 1)"""
    ]
    for n in (2, 3):
        seen = " AND ".join(
            f"NOT EXISTS (SELECT 1 FROM {tag}{i} s WHERE s.src = p.src AND s.pos = e.dst)"
            for i in range(1, n)
        )
        steps.append(
            f"""{tag}f{n} AS (SELECT p.src, e.dst AS pos, p.path || ' -(' || e.rel || ')-> ' || e.dst AS path, p.place, e.ord,
  row_number() OVER (PARTITION BY p.src, e.dst ORDER BY p.place, e.ord) AS k FROM {tag}{n - 1} p JOIN {edges} e ON e.src = p.pos WHERE e.dst <> p.src AND {seen}
), {tag}{n} AS (SELECT src, pos, path, {n} AS length, row_number() OVER (PARTITION BY src ORDER BY place, ord) AS place FROM {tag}f{n} WHERE k = 1)"""
        )
    return (
        ", ".join(steps)
        + f", {tag}all AS (SELECT * FROM {tag}1 UNION ALL SELECT * FROM {tag}2 UNION ALL SELECT * FROM {tag}3)"
    )


_ASK = f"""q AS (SELECT item_id AS query_id, lower(text) AS t FROM benchmark UNION ALL SELECT -ord, substr(name, 1, 3) FROM ent WHERE r = 0
), f AS (SELECT id, lower(name) AS form, lower(translate(name, '{ASCII_LOWER}', '{ASCII_UPPER}')) AS alias FROM ent
), m AS (SELECT query_id, id, bool_or(contains(t, form) OR contains(form, t)) AS by_name, bool_or(contains(t, alias) OR contains(alias, t)) AS by_alias FROM q, f WHERE t <> '' GROUP BY query_id, id)"""
_FOUND = f"""{LEX}, {_ASK}, x AS (SELECT * FROM ({P.SQL["kg_expand_query"]})
), s AS (SELECT query_id, id, by_name::INT * 2.0::DOUBLE + by_alias::INT AS score FROM m WHERE by_name OR by_alias
  UNION ALL SELECT x.query_id, e.id, 1 + x.weight FROM x JOIN ent e ON contains(lower(e.name), lower(x.name))
), b AS (SELECT query_id, s.id, max(score) AS score FROM s GROUP BY query_id, s.id
), v AS (SELECT query_id, b.id, score, e.name, e.type, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, e.ord) AS place FROM b JOIN ent e ON e.id = b.id
), n AS (SELECT src, '-(' || rel || ')-> ' || t.name AS said, r.ord, row_number() OVER (PARTITION BY src ORDER BY r.ord) AS k FROM rel r JOIN ent t ON t.id = r.dst
), w AS (SELECT query_id, place, v.id, name, type, score, coalesce((SELECT string_agg(said, ', ' ORDER BY ord) FROM n WHERE n.src = v.id AND k <= 10), '') AS near FROM v WHERE place <= 5)"""
SQL = {
    "kg_query_entities_full": f"{LEX}, {_ASK} SELECT query_id, id, by_name, by_alias FROM m WHERE by_name OR by_alias",
    "exercise_evidence": f"{_FOUND} SELECT query_id, place, id, round(score, 6) AS score, near FROM w",
    "exercise_mock": f"""{_FOUND} SELECT query_id, 'q' || place AS id, '请根据证据[' || (place - 1) || ']：' || name || '，选择正确的关系或含义。' AS question,
  name || '|' || lower(name) || '|' || upper(name) || '|' || upper(substr(name, 1, 1)) || lower(substr(name, 2)) AS options, name AS answer FROM w WHERE place <= 3""",
    "exercise_prompt": f"{_FOUND} SELECT query_id, string_agg('[' || (place - 1) || '] ' || name || ' (' || type || ') | ' || near, e'\\n' ORDER BY place) AS evidence FROM w GROUP BY query_id",
    "exercise_answers": "SELECT item_id AS query_id, 'q' || i AS id, item_id || '-' || i AS question, 'a' || item_id AS answer FROM benchmark, (SELECT unnest([1, 2]) AS i) WHERE item_id % 4 <> 0",
    "kg_path_text": f"""{LEX}, {_paths("rel", "SELECT id FROM ent WHERE language = 'en'", "p")} SELECT p.src, pos AS dst, length, path FROM pall p JOIN ent t ON t.id = pos AND t.r = 0
UNION ALL SELECT id, id, 0, id || ' -(self)' FROM ent WHERE language = 'en' AND r = 0""",
    "kg_paths_between": f"""{LEX}, {_paths("rel", "SELECT id FROM ent", "p")}, tq AS (SELECT item_id AS k, unnest(list_distinct(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+'))) AS token FROM benchmark
), td AS (SELECT doc_id AS k, unnest(list_distinct(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+'))) AS token FROM documents WHERE doc_id IN (SELECT item_id FROM benchmark)
), eq AS (SELECT k, id, ord FROM tq JOIN ent ON name = token), ed AS (SELECT k, id, ord FROM td JOIN ent ON name = token
), b AS (SELECT eq.k, src, pos AS dst, path, row_number() OVER (PARTITION BY eq.k ORDER BY eq.ord, ed.ord) AS place FROM eq JOIN ed ON eq.k = ed.k JOIN pall ON src = eq.id AND pos = ed.id)
SELECT k AS query_id, k AS doc_id, place, src, dst, path FROM b WHERE place <= 3""",
    "kg_either_way": f"""{LEX}, {_paths("rel", "SELECT id FROM ent WHERE r BETWEEN 3 AND 7", "p")}
, un AS (SELECT src, dst, rel, ord FROM rel UNION ALL SELECT dst, src, rel, ord + (SELECT max(ord) FROM rel) + 1 FROM rel), {_paths("un", "SELECT id FROM ent WHERE r BETWEEN 3 AND 7", "u")}
, t AS (SELECT id FROM ent WHERE r = 1) SELECT src, pos AS dst, length, path, true AS directed FROM pall WHERE pos IN (FROM t)
UNION ALL SELECT src, pos, length, path, false FROM uall u WHERE pos IN (FROM t) AND NOT EXISTS (SELECT 1 FROM pall p WHERE p.src = u.src AND p.pos = u.pos)""",
    "kg_around": f"""{LEX}, u AS (SELECT src AS a, dst AS b FROM rel UNION SELECT dst, src FROM rel), z AS (SELECT id FROM ent WHERE r < 10
), w AS (SELECT id AS source, id, 0 AS hop FROM z UNION SELECT z.id, b, 1 FROM z JOIN u ON a = z.id UNION SELECT z.id, y.b, 2 FROM z JOIN u x ON x.a = z.id JOIN u y ON y.a = x.b)
SELECT source, id, min(hop)::INT AS hop FROM w GROUP BY source, id""",
    "kg_of_level": f"{LEX} SELECT DISTINCT src AS id FROM rel JOIN ent ON ent.id = dst WHERE rel = 'belongsTo' AND type = 'Word' AND contains(name, 'e')",
    "kg_node_table": f"{LEX} SELECT id, name, language, type AS label FROM ent",
    "kg_edge_table": f"{LEX} SELECT src, dst, upper(rel) AS kind, confidence FROM rel",
    "kg_digraph": f"{LEX} SELECT src, dst, arg_max(rel, ord) AS rel, arg_max(confidence, ord) AS confidence FROM rel GROUP BY src, dst",
    "search_results": f"SELECT f.*, lang, substr(text, 1, 300) || '...' AS preview FROM ({P.SQL['fused_search']}) f JOIN documents USING (doc_id)",
}
