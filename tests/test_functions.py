"""Small cases of functions and operators, by hand."""

import json
import zipfile

import pytest
from pyspark.sql import functions as F

from trilune.functions import statistics as S
from trilune.functions import text as T
from trilune.operators import align as A
from trilune.operators import extract as X
from trilune.operators import graph as G
from trilune.operators import kg as K
from trilune.operators import learner as L
from trilune.operators import metrics as M
from trilune.operators import retrieval as R
from trilune.plans.kg import doubled
from trilune.sources import files


def one(spark, value, expr):
    return spark.createDataFrame([(value,)], "t string").select(expr(F.col("t"))).first()[0]


@pytest.mark.parametrize(
    ("text", "expr", "want"),
    [
        ("  Hello,  World! ", lambda c: T.normalize_text(c, remove_punctuation=True), "hello world"),
        (None, T.normalize_text, ""),
        ("ﬁn", T.normalize_text, "fin"),
        ("See http://a.b/c <b>Bold</b> me@x.org\nEnd", T.clean_text, "see bold end"),
        ("être", lambda c: T.string_similarity(c, F.lit("etre")), 0.75),
        ("", lambda c: T.string_similarity(c, F.lit("")), 1.0),
        ("虚拟式", T.heuristic_language, "zh"),
        ("ab", T.heuristic_language, None),
        ("One. Two! 三。", T.sentences, ["One", "Two", "三"]),
        ("abcdefgh", lambda c: T.truncate_text(c, 4, "middle"), "abgh"),
        ("élève", T.remove_accents, "eleve"),
    ],
)
def test_text(spark, text, expr, want):
    assert one(spark, text, expr) == want


def test_student_t():
    assert S.student_t_p(2.262, 9) == pytest.approx(0.05, abs=1e-4)
    assert S.student_t_p(0, 5) == pytest.approx(1)


def test_bootstrap_repeats():
    assert S.bootstrap_ci([1, 2, 3], [0, 1, 2]) == (1.0, 1.0, 1.0)
    assert S.bootstrap_ci([], []) == (0.0, 0.0, 0.0)


def edges(spark, rows):
    return spark.createDataFrame(
        [(a, b, "sameAs", 1.0, i) for i, (a, b) in enumerate(rows)],
        "src string, dst string, rel string, confidence double, ord long",
    )


def test_first_way_counts_not_the_best(spark):
    e = spark.createDataFrame(
        [
            ("s", "a", "tests", 1.0, 0),
            ("s", "b", "sameAs", 1.0, 1),
            ("a", "t", "tests", 1.0, 2),
            ("b", "t", "sameAs", 1.0, 3),
        ],
        "src string, dst string, rel string, confidence double, ord long",
    )
    got = {r.id: r.weight for r in G.related(spark.createDataFrame([("s",)], "id string"), e).collect()}
    assert got["t"] == pytest.approx(0.4 * 0.8 * 0.4 * 0.64)


def test_cycles_have_no_level(spark):
    got = {
        r.id: r.level
        for r in G.topological_levels(edges(spark, [("b", "a"), ("c", "b"), ("x", "y"), ("y", "x")])).collect()
    }
    assert got == {"a": 0, "b": 1, "c": 2}


def test_strong_components(spark):
    e = edges(spark, [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")])
    got = {
        r.id: r.component
        for r in G.strong_components(spark.createDataFrame([(x,) for x in "abcd"], "id string"), e).collect()
    }
    assert got["a"] == got["b"] == got["c"] != got["d"]


def test_caps_of_rounds_fail_aloud(spark):
    ids = [f"n{i}" for i in range(6)]
    nodes, chain = spark.createDataFrame([(x,) for x in ids], "id string"), edges(spark, list(zip(ids[1:], ids, strict=False)))
    p = spark.createDataFrame(
        [(i, j, -float(i + j)) for i in range(4) for j in range(4)],
        "e1 long, e2 long, confidence double",
    )
    for run in (lambda m: G.topological_levels(chain, m), lambda m: G.strong_components(nodes, chain, m), lambda m: G.components(nodes, chain, m), lambda m: A.one_to_one(p, m)):
        with pytest.raises(RuntimeError):
            run(1)
    assert {r.id: r.level for r in G.topological_levels(chain).collect()} == {x: i for i, x in enumerate(ids)}
    assert {r.id: r.component for r in G.strong_components(nodes, chain).collect()} == {x: x for x in ids}
    assert {(r.e1, r.e2) for r in A.one_to_one(p.union(p)).collect()} == {(i, i) for i in range(4)}


def test_deep_chains_have_all_levels(spark):
    ids = [f"{i:03}" for i in range(104)]
    got = {r.id: r.level for r in G.topological_levels(edges(spark, list(zip(ids[1:], ids, strict=False)))).collect()}
    assert got == {x: i for i, x in enumerate(ids)}


def test_fusion_is_idempotent(spark):
    e = spark.createDataFrame(
        [
            ("1", "colour", "Word", "en", None, [], 0.9, 0),
            ("2", "colours", "Word", "en", None, [], 0.5, 1),
            ("3", "tree", "Word", "en", None, [], 0.5, 2),
        ],
        (
            "id string, name string, type string, language string, description string, aliases array<string>,"
            " confidence double, ord long"
        ),
    )
    r = edges(spark, [("2", "3"), ("1", "3")])
    pairs = K.similar_names(e)
    assert [(p.a, p.b) for p in pairs.collect()] == [("1", "2")]
    clusters = G.components(
        pairs.select(F.col("a").alias("id")).union(pairs.select("b")),
        pairs.select(F.col("a").alias("src"), F.col("b").alias("dst")),
    )
    e2, r2 = K.remapped(e, r, K.representatives(e, clusters))
    assert {x.id for x in e2.collect()} == {"1", "3"}
    assert r2.count() == 1
    assert K.similar_names(e2).count() == 0


def test_greedy_matching(spark):
    p = spark.createDataFrame(
        [(1, 1, 0.9), (1, 2, 0.8), (2, 1, 0.7), (2, 2, 0.1)],
        "e1 long, e2 long, confidence double",
    )
    assert {(r.e1, r.e2) for r in A.one_to_one(p).collect()} == {(1, 1), (2, 2)}


def test_ideal_ranking(spark):
    run = spark.createDataFrame(
        [("q", i, f"d{i}", 1.0) for i in range(1, 4)],
        "query_id string, rank int, doc_id string, score double",
    )
    qrels = spark.createDataFrame([("q", "d1", 2), ("q", "d2", 1)], "query_id string, doc_id string, relevance int")
    r = M.ranking_metrics(run, qrels, 10).first()
    assert (r.ndcg, r.mrr, r.recall, r.ap_judged) == (1.0, 1.0, 1.0, 1.0)


def test_forgetting_of_nothing_and_future(spark):
    at = F.lit("2024-01-01").cast("timestamp")
    r = (
        spark.range(1)
        .select(
            L.forgetting(F.lit(None).cast("timestamp"), at).alias("a"),
            L.forgetting(F.lit("2030-01-01").cast("timestamp"), at).alias("b"),
        )
        .first()
    )
    assert (r.a, r.b) == (1.0, 1.0)


def test_learner_without_success_gets_the_whole_path(spark):
    concepts = spark.createDataFrame([("a", "Word"), ("b", "Grammar")], "id string, type string")
    levels = spark.createDataFrame([("a", 0), ("b", 1)], "id string, level int")
    mastered = spark.createDataFrame([(1, "a")], "learner long, id string")
    log = spark.createDataFrame([(1,), (2,), (2,)], "learner long")
    got = {(r.learner, r.step, r.id) for r in L.learning_path(concepts, levels, mastered, 10, log).collect()}
    assert got == {(1, 1, "b"), (2, 1, "a"), (2, 2, "b")}


def test_linear_map_of_all_gold_pairs(spark, tmp_path):
    import numpy as np

    from trilune.plans import align

    r = np.random.default_rng(4)
    x = r.normal(size=(60, 4))
    label = r.integers(0, 3, 60)
    rows = [(i, v.tolist(), int(n)) for i, (v, n) in enumerate(zip(x, label, strict=True))]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").write.parquet(
        str(tmp_path / "embeddings.parquet"),
    )
    pairs = [(i, j) for i in range(1, 60, 2) for j in range(0, 60, 2) if label[i] == label[j]]
    m = np.linalg.lstsq(x[[i for i, _ in pairs]], x[[j for _, j in pairs]], rcond=None)[0]
    first = {
        n: (min(i for i, j in pairs if label[i] == n), min(j for i, j in pairs if label[i] == n))
        for n in range(3)
    }
    got = {r.label: r.distance for r in align.align_linear_map(spark, str(tmp_path)).collect()}
    assert got == pytest.approx({n: np.linalg.norm(x[i] @ m - x[j]) for n, (i, j) in first.items()}, abs=1e-4)
    assert min(got.values()) > 0.1


def test_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("plain")
    (tmp_path / "b.json").write_text(json.dumps({"x": ["one", {"y": 2}]}))
    (tmp_path / "c.jsonl").write_text('{"content": "c", "text": "t"}\nbroken\n{"other": "o"}')
    (tmp_path / "d.bin").write_bytes(b"\0")
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    with zipfile.ZipFile(tmp_path / "e.docx", "w") as z:
        z.writestr(
            "word/document.xml",
            f'<w:document xmlns:w="{w}"><w:body><w:p><w:r><w:t>Hi</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>1</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>2</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>',
        )
    got = {r.filename: (r.text, r.error) for r in files.read_documents(spark, str(tmp_path)).collect()}
    assert got["a.txt"] == ("plain", None)
    assert got["b.json"] == ("one 2", None)
    assert got["c.jsonl"] == ("t c\n\no", None)
    assert got["d.bin"][1] is not None
    assert got["e.docx"] == ("Hi\n1 | 2", None)


def test_malformed_lines(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"a": 1}\n{bad\n{"a": 2}\n')
    assert files.read_jsonl(spark, str(tmp_path), "a long").count() == 2
    assert files.malformed_jsonl(spark, str(tmp_path), "a long") == 1
    with pytest.raises(Exception):
        files.read_jsonl(spark, str(tmp_path), "a long", strict=True).collect()


def test_federated_counts_every_row(spark, tmp_path):
    import duckdb

    from trilune.plans import sources

    n = 1_000_003
    (
        spark.range(n)
        .selectExpr("format_string('Customer#%09d', id) AS c_name")
        .coalesce(1).write
        .parquet(str(tmp_path / "customer.parquet"))
    )
    (
        spark.range(n - 2, n + 5)
        .selectExpr("format_string('Supplier#%09d', id) AS s_name")
        .coalesce(1).write
        .parquet(str(tmp_path / "supplier.parquet"))
    )
    con = duckdb.connect()
    for name in ("customer", "supplier"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    got = {r.source: r.n for r in sources.federated(spark, str(tmp_path)).collect()}
    assert got == dict(con.execute(sources.SQL["federated"]).fetchall()) == {"customer": n, "supplier": 5}


def test_merged_limits(spark):
    a, b = (spark.createDataFrame([(t,) for t in x], "title string") for x in (["A", "c", "d"], [" a", "e"]))
    titles = lambda *limits: [r.title for r in files.merged([("a", a), ("b", b)], *limits).collect()]
    assert titles(None, None) == ["A", "c", "d", "e"]
    assert titles(None, 2) == ["A", "c"]
    assert len(titles(1, None)) <= 2


def test_articles(spark, tmp_path):
    (tmp_path / "p.xml").write_text(
        "<S><PubmedArticle><MedlineCitation><PMID>7</PMID><Article><ArticleTitle>A  b</ArticleTitle><Abstract><AbstractText>Text</AbstractText></Abstract><AuthorList><Author><ForeName>Ann</ForeName><LastName>Lee</LastName></Author><Author><ForeName>Bo</ForeName><LastName>Ek</LastName></Author></AuthorList></Article></MedlineCitation></PubmedArticle></S>",
    )
    r = files.read_articles(spark, str(tmp_path / "p.xml")).first()
    assert (r.id, r.title, r.authors) == ("pubmed_7", "A b", ["Ann Lee", "Bo Ek"])


def test_words_end_at_letters_beyond_ascii(spark, duck):
    text = "étation notiön motion chaßing of ämen nation of öl 2019é mé2020"
    texts = spark.createDataFrame([(1, text, "en")], "doc int, text string, language string")
    for pattern in (r"\b[a-z]+tion\b", r"\b[a-z]+ing\b", r"\b(?:19|20)\d{2}\b", r"\\\b"):
        got = [r.name for r in X.entities(texts, [("en", "Word", pattern)]).collect()]
        assert got == duck.execute("SELECT unnest(regexp_extract_all(?, ?))", [text, pattern]).df().iloc[:, 0].tolist()
    joined = X.relation_spans(texts, [("en", "belongsTo", r"\b([a-z]+) of ([a-z]+)\b")]).collect()
    assert joined == []
    mixed = spark.createDataFrame([(1, "étation of nationé", "en")], "doc int, text string, language string")
    assert [(r.left, r.right) for r in X.relation_spans(mixed, [("en", "belongsTo", r"\b([a-z]+) of ([a-z]+)\b")]).collect()] == [("tation", "nation")]


def test_entities_met_again_in_capitals_are_one(spark):
    rows = [("de:ßung", "ßung", "Word", "de", 1.0, 1), ("de:haus", "haus", "Word", "de", 0.5, 2), ("fr:été", "été", "Word", "fr", 0.25, 3), ("de:x", "ŉame", "Word", "de", 1.0, 4)]
    e = spark.createDataFrame(rows, "id string, name string, type string, language string, confidence double, ord long")
    again = {r.name for r in doubled(e).collect()} - {r.name for r in e.collect()}
    assert again == {"Haus"}
    assert sorted((r.id, r.name, r.confidence) for r in K.best_entities(doubled(e)).collect()) == sorted((r[0], r[1], r[4]) for r in rows)


def test_graph_and_shared_names_score_candidates_only(spark):
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    asked = frame([(1, "a"), (1, "b"), (2, "a")], "query_id int, id string")
    held = frame([(7, "a"), (7, "c"), (8, "b"), (9, "x")], "doc_id int, id string")
    near = frame([("a", "c", 0.5), ("b", "a", 0.25)], "source string, id string, weight double")
    keys = frame([(1, 7), (1, 9), (2, 8)], "query_id int, doc_id int")
    got = R.graph_scores(asked, held, near, keys).collect()
    assert [(r.query_id, r.doc_id, r.score) for r in got] == [(1, 7, round((1 + 0.25 + 0.5) / 3, 9))]
    a, b = asked.select("query_id", F.col("id").alias("name"), F.lit(1.0).alias("w")), held.select("doc_id", F.col("id").alias("name"), F.lit(0.5).alias("w"))
    got = R.weighted_jaccard(a, b, keys).collect()
    assert [(r.query_id, r.doc_id, r.score) for r in got] == [(1, 7, 0.5 / 2.5)]


def test_bm25_adds_up_where_documents_are(spark):
    docs = spark.createDataFrame([(1, "un chat noir"), (2, "chat chat"), (3, None), (4, "noir")], "doc_id int, text string")
    asked = spark.createDataFrame([(7, "chat noir"), (8, "rien")], "query_id int, query_text string")
    found = R.Bm25Index(docs, idf="lucene").scores(asked)
    assert sorted((r.query_id, r.doc_id) for r in found.collect()) == [(7, 1), (7, 2), (7, 4)]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(query_id" not in plan


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        last, row = row, [i + 1]
        for j, y in enumerate(b):
            row.append(min(last[j + 1] + 1, row[j] + 1, last[j] + (x != y)))
    return row[-1]


def test_similar_names_are_those_of_all_pairs(spark):
    import random

    r = random.Random(4)
    names = [f"Supplier#{i:09}" for i in (*range(60), 100, 1010, 12345)] + ["".join(r.choices("ab", k=r.randint(1, 16))) for _ in range(80)]
    long = ["".join(r.choices("abc", k=r.randint(21, 40))) for _ in range(12)]
    names += long + [x[:5] + "z" + x[6:-1] for x in long] + ["", "a", "a", "Ab", "aB", "Supplier#000000007"]
    rows = [(f"{i:03}", "Word" if i % 3 else "Part", n) for i, n in enumerate(names)] + [("none", None, "aaaa"), ("null", "Word", None)]
    e = spark.createDataFrame(rows, "id string, type string, name string")
    for least, same in ((0.85, True), (0.75, True), (0.85, False)):
        known = [(i, t, n.lower()) for i, t, n in rows if n and (t or not same)]
        want = {}
        for i, t, n in known:
            for j, u, m in known:
                if i < j and (t == u or not same):
                    s = 1 - edit_distance(n, m) / max(len(n), len(m))
                    if s >= least:
                        want[i, j] = round(s, 9)
        got = K.similar_names(e, least, same).collect()
        assert len(got) == len(want) and {(x.a, x.b): round(x.similarity, 9) for x in got} == want


def test_similar_names_of_one_beginning_do_not_meet(spark):
    """17,576 names with the same first and no like rest: 154 million pairs would meet on their cuts."""
    import itertools
    import time

    names = ["Supplier#" + "".join(c * 3 for c in x) for x in itertools.product("abcdefghijklmnopqrstuvwxyz", repeat=3)]
    e = spark.createDataFrame([(n, "Supplier", n) for n in names], "id string, type string, name string")
    begun = time.time()
    assert K.similar_names(e).count() == 0
    assert time.time() - begun < 60
