"""Repeated ids, many languages and long texts in the training-data operators."""

import hashlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from test_operators import brute_contamination, exact_nearest

from trilune.llm import contamination, language_id, nearest, toxicity

MODEL = public_tokenizers.path("piece_bpe_32k.model")


def probed_share(monkeypatch):
    """Collects (parts probed, parts) per search, from the table of what is probed."""
    seen, put = [], nearest.written

    def watch(spark, df, what, *a):
        out = put(spark, df, what, *a)
        if what == "probed":
            seen.append(out.agg(F.avg(F.size("probes"))).first()[0])
        return out

    monkeypatch.setattr(nearest, "written", watch)
    return seen


def recall(got, x, ids, queries, k=20):
    hits = 0
    for q in queries:
        want = set(ids[exact_nearest(x, q, k)].tolist())
        mine = list(got[got.query_id == ids[q]].sort_values("rank").vec_id)
        assert len(mine) == k
        hits += len(want & set(mine))
    return hits / (k * len(queries))


def test_nearest_with_repeated_queries_is_exact(spark):
    x = np.random.default_rng(7).normal(size=(60, 8))
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(20, x[20].tolist())] * 3 + [(40, x[41].tolist()), (5, x[5].tolist())]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    got = nearest.nearest(v, F.col("vec_id") % 20 == 0, parts=1).toPandas()
    assert got.groupby("query_id").size().to_dict() == {0: 20, 20: 20, 40: 20}
    for q in (0, 20, 40):
        asks = min((np.array(a) for i, a in rows if i == q), key=lambda a: a.tobytes())
        want = sorted(((-round(float(np.dot(a, asks)), 12), i) for i, a in rows if i != q))[:20]
        mine = got[got.query_id == q].sort_values("rank")
        assert list(mine["rank"]) == list(range(1, 21))
        assert [(-round(s, 12), i) for s, i in zip(mine.score, mine.vec_id, strict=True)] == want


def test_nearest_of_many_copies_of_the_query(spark):
    """Copies of the query's own row do not crowd out other rows with its vector."""
    same = [1.0, 0.0]
    rows = [(20, same)] * 40 + [(i, same) for i in range(100, 130)] + [(i, [0.5, i / 1000]) for i in range(200, 300)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = nearest.nearest(v, F.col("vec_id") == 20, parts=1).orderBy("rank").collect()
    assert [r.vec_id for r in got] == list(range(100, 120))


def test_nearest_ties_of_very_long_vectors(spark):
    r = np.random.default_rng(8)
    x = np.repeat(r.normal(size=(40, 16)) * 1e7, 3, axis=0)
    v = spark.createDataFrame([(i, a.tolist()) for i, a in enumerate(x)], "vec_id long, embedding array<double>")
    got = nearest.nearest(v, F.col("vec_id") % 20 == 0, parts=1).toPandas()
    for q in range(0, 120, 20):
        scores = {i: (x[q] * x[i]).sum() for i in range(120) if i != q}
        want = sorted(scores, key=lambda i: (-scores[i], i))[:20]
        assert list(got[got.query_id == q].sort_values("rank").vec_id) == want


def test_nearest_leaves_parts_out_on_the_largest_given_table(spark, monkeypatch):
    seen = probed_share(monkeypatch)
    v = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = v.orderBy("vec_id").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    got = nearest.query(spark, "/root/testdata/sf0.1").toPandas()
    assert recall(got, x, ids, np.flatnonzero(ids % 20 == 0)) >= 0.9
    assert len(rows) // 20 >= nearest.LEAST_PARTS and seen[0] < nearest.LEAST_PARTS


def test_nearest_recall_on_vectors_without_clusters(spark, monkeypatch):
    seen = probed_share(monkeypatch)
    x = np.random.default_rng(9).normal(size=(20_000, 24))
    x /= np.linalg.norm(x, axis=1)[:, None]
    v = spark.createDataFrame([(i, a.tolist()) for i, a in enumerate(x)], "vec_id long, embedding array<double>").repartition(4)
    got = nearest.nearest(v, F.col("vec_id") % 200 == 0).toPandas()
    assert recall(got, x, np.arange(len(x)), np.arange(0, len(x), 200)) >= 0.9
    assert seen[0] < len(x) // nearest.PART_ROWS


def test_ten_thousand_languages(spark):
    rows = [(i, f"word{i % 50} of language", f"l{i % 10_000:05}") for i in range(20_000)]
    rows += [(30_000 + i, "the house and the garden with a tree", "en") for i in range(300)]
    rows += [(40_000 + i, "la maison et le jardin avec un arbre", "fr") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    names, logp = language_id.fit(docs, MODEL, most_langs=3, rounds=1)
    assert names == ["en", "fr", "l00000"] and logp.shape[1] == 3  # most rows first, then by name
    known = language_id.languages(docs.where("doc_id >= 30000"), (names, logp), MODEL)
    assert {(r.doc_id < 40_000, r.lang_pred) for r in known.collect()} == {(True, "en"), (False, "fr")}


def test_language_fit_within_its_bytes(spark):
    long = "garbage " * 200_000
    rows = [(1, long, "en"), (2, "a garden", "en"), (2, "another garden", "en"), (None, "x", "en"), (3, None, "en"), (4, "jardin", None)]
    rows += [(5, f"row {i} of one id", "fr") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    names, logp = language_id.fit(docs, MODEL, most_bytes=1000, most_docs=10_000, rounds=1)
    assert names == ["en", "fr"]
    few = spark.createDataFrame([(2, "a garden", "en"), (None, "x", "en"), (5, "row 0 of one id", "fr")], "doc_id long, text string, lang string")
    assert np.array_equal(logp, language_id.fit(few, MODEL, most_bytes=1000, rounds=1)[1])


def test_toxicity_counts_an_id_once(spark):
    rows = [(i, f"{'bad' if i % 2 else 'good'} text {i} " * 20, "en") for i in range(200)]
    docs = spark.createDataFrame(rows + [(1, f"bad text {i}", "en") for i in range(5000)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, toxic int")
    least = min([rows[1][1]] + [f"bad text {i}" for i in range(5000)])
    once = spark.createDataFrame([r for r in rows if r[0] != 1] + [(1, least, "en")], "doc_id long, text string, lang string")
    a, b = toxicity.fit(docs, labels, epochs=2), toxicity.fit(once, labels, epochs=2)
    assert all(np.array_equal(a.weights[k], b.weights[k]) for k in a.weights)


@pytest.mark.parametrize("most", [8_000_000, 20])
def test_contamination_by_items_of_one_id_and_of_none(spark, most):
    words = lambda c, n: " ".join(f"{c}{i}" for i in range(n))
    items = [("i1", words("a", 20)), ("i1", words("b", 15)), (None, words("c", 14)), (None, "d"), ("i2", words("a", 20)), ("i3", None)]
    docs = [(1, f"{words('a', 20)} x {words('b', 15)}"), (2, words("c", 14)), (3, "x d"), (4, words("e", 30)), (None, words("b", 15)), (5, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id string, text string")
    got = {r.doc_id: r for r in contamination.contamination(df, bench, most_terms=most).collect()}
    named = brute_contamination(docs, [x for x in items if x[0] is not None])
    every = brute_contamination(docs, [(str(n), t) for n, (_, t) in enumerate(items)])
    for i, want in named.items():
        r = got[i]
        assert (r.n_words, r.n_hit, r.contaminated) == (every[i][0], every[i][1], every[i][4])
        assert (r.n_items, r.items_sha256) == (want[2], want[3])
    assert got[1]["items"] == ["i1", "i2"] and got[2].n_hit == 14 and got[2].n_items == 0
    assert got[2].items_sha256 == hashlib.sha256(b"").hexdigest()
