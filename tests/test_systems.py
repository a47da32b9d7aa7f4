"""Systems side by side against plain computations."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from trilune.operators import system as S
from trilune.plans import retrieval as P
from trilune.plans import systems as Y


def t_tail(t, df, steps=400_000):
    """Two-sided tail of Student's t by the trapezium rule."""
    x = np.linspace(0, abs(t), steps)
    density = np.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(df * math.pi) * (1 + x * x / df) ** (-(df + 1) / 2)
    return 1 - 2 * float(((density[1:] + density[:-1]) / 2 * np.diff(x)).sum())


def test_differences_and_their_intervals(spark):
    r = np.random.default_rng(0)
    a, b = r.random(60), r.random(60)
    frame = lambda v: spark.createDataFrame([(i, "m", float(x)) for i, x in enumerate(v)], "query_id long, metric string, value double")
    got = {x.system: x for x in S.compared({"base": frame(a), "other": frame(b)}, "base").collect()}
    d = a - b
    x = got["other"]
    assert (x.value, x.difference) == (pytest.approx(b.mean()), pytest.approx(d.mean()))
    assert x.t == pytest.approx(d.mean() / (d.std(ddof=1) / 60**0.5)) and x.p == pytest.approx(t_tail(x.t, 59), abs=1e-6)
    assert x.effect == pytest.approx(d.mean() / math.sqrt((a.var(ddof=1) + b.var(ddof=1)) / 2))
    means = np.array([d[r.integers(0, 60, 60)].mean() for _ in range(4000)])
    assert x.low == pytest.approx(np.percentile(means, 2.5), abs=0.03) and x.high == pytest.approx(np.percentile(means, 97.5), abs=0.03)
    assert (got["base"].difference, got["base"].low, got["base"].high, got["base"].p) == (0, 0, 0, 1)


def test_draws_of_resamples_are_poisson(spark):
    n = spark.range(100_000).select(S.poisson((F.col("id") + 0.5) / 100_000).alias("n")).groupBy("n").count().collect()
    for r in n:
        assert r["count"] / 100_000 == pytest.approx(math.exp(-1) / math.factorial(r.n), abs=1e-4)


def test_queries_without_results_count(spark):
    run = spark.createDataFrame([(1, 1, 10, 0.5)], "query_id long, rank int, doc_id long, score double")
    qrels = spark.createDataFrame([(1, 10, 1), (2, 11, 1)], "query_id long, doc_id long, relevance int")
    asked = spark.createDataFrame([(1,), (2,), (3,)], "query_id long")
    got = {(r.query_id, r.metric): r.value for r in S.per_query(run, qrels, asked, ["ndcg@10", "precision@1"]).collect()}
    assert got == {(1, "ndcg@10"): 1.0, (1, "precision@1"): 1.0, **{(q, m): 0.0 for q in (2, 3) for m in ("ndcg@10", "precision@1")}}
    with pytest.raises(ValueError):
        S.per_query(run, qrels, asked, ["nonsense@3"])


def test_four_systems_over_the_given_tables(spark, data):
    texts = {r.doc_id: r.text.lower() for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    items = {r.query_id: r.query_text for r in P.items(spark, data).collect()}
    relevant = {q: {i for i, t in texts.items() if x[:40].lower() in t} for q, x in items.items()}
    want = {}
    for name, run in Y.runs(spark, data).items():
        ranked: dict = {q: [] for q in items}
        for r in run.orderBy("query_id", "rank").collect():
            ranked[r.query_id].append(r.doc_id)
        first = {q: next((n for n, i in enumerate(found, 1) if i in relevant[q]), None) for q, found in ranked.items()}
        want[name, "mrr"] = np.mean([1 / n if n else 0 for n in first.values()])
        want[name, "precision@10"] = np.mean([sum(i in relevant[q] for i in found) / 10 for q, found in ranked.items()])
        want[name, "recall@10"] = np.mean([sum(i in relevant[q] for i in found) / len(relevant[q]) if relevant[q] else 0 for q, found in ranked.items()])
    got = {(r.system, r.metric): r for r in Y.systems_evaluated(spark, data).collect()}
    assert {k: got[k].value for k in want} == {k: pytest.approx(v, abs=1e-5) for k, v in want.items()}
    assert {k[0] for k in got} == {"translated", "dense", "hybrid", "fused"} and any(v > 0 for v in want.values())
    for (name, metric), r in got.items():
        assert r.difference == pytest.approx(got["fused", metric].value - r.value, abs=2e-6) and r.low <= r.difference + 1e-6 and r.difference <= r.high + 1e-6


def test_significance_query(spark, data):
    from trilune.operators.metrics import ranking_metrics

    run, qrels = P.judged_run(spark, data)
    a, b = ({r.query_id: r.recall for r in ranking_metrics(run, qrels, k).collect()} for k in (20, 10))
    d = np.array([a[q] - b[q] for q in sorted(a)])
    got = P.significance(spark, data).first()
    assert got.n == len(d) and got.t == pytest.approx(d.mean() / (d.std(ddof=1) / len(d) ** 0.5)) and got.p == pytest.approx(t_tail(got.t, len(d) - 1), abs=1e-6)
    assert got.low <= got.mean <= got.high and got.mean == pytest.approx(d.mean(), abs=0.01)


def test_partners_by_plain_averages(spark, data):
    """The untrained query: nearest French words by Euclidean distance of averaged vectors."""
    from trilune.operators import align as A
    from trilune.plans import align as G
    from trilune.plans.lexicon import graph

    e, r = graph(spark, data)
    words = e.collect()
    nodes = spark.createDataFrame([(n.id, [1.0 if n.r % 8 == i else 0.1 for i in range(8)]) for n in words], "id string, x array<double>")
    z = {x.id: np.array(x.x) for x in A.propagated(nodes, r.where("rel <> 'translatedAs'")).collect()}
    french = [n.id for n in words if n.language == "fr" and n.id in z]
    for p in G.align_gcn(spark, data).collect():
        far = {i: np.linalg.norm(z[p.e1] - z[i]) for i in french}
        assert p.confidence == pytest.approx(1 - far[p.e2] / (max(far.values()) + 1e-8), abs=1e-3)
        assert sum(v < far[p.e2] - 1e-6 for v in far.values()) < 3


def test_statistics_of_a_corpus_are_those_of_its_index_without_one(spark, monkeypatch):
    from trilune.operators import retrieval as R

    rows = [(1, "Le chat dort"), (2, None), (2, "un chat, deux chiens"), (2, "chat"), (None, "perdu ici"), (3, "")]
    for some in (rows, rows[:3], [rows[0], rows[5]], [rows[5]], [rows[4]], []):
        docs = spark.createDataFrame(some, "doc_id long, text string")
        want = R.Bm25Index(docs).statistics().first().asDict()
        assert R.corpus_statistics(docs).first().asDict() == want, some


def test_system_statistics_make_no_index(spark, data, monkeypatch):
    from trilune.operators import retrieval as R
    from trilune.plans import systems

    def none(*a, **k):
        raise AssertionError("an index was made")

    monkeypatch.setattr(R, "Bm25Index", none)
    monkeypatch.setattr(systems.P, "kept", lambda spark, d, tables, what, make, frames: make())
    assert systems.system_statistics(spark, data).where("part = 'bm25'").count() == 4


def test_evaluated_systems_search_texts_once(spark, data, monkeypatch, tmp_path):
    """Texts are not cut to stretches, and the hybrid and the fused system are made of one search."""
    from trilune.operators import extract as X
    from trilune.operators import retrieval as R

    def none(*a, **k):
        raise AssertionError("texts were cut")

    monkeypatch.setattr(X, "_grams", none)
    rows = [(1, "xx ÉTAT de l'un " * 2), (2, None), (3, ""), (4, "état DE L'un"), (4, "b"), (5, "tat de l'unA")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    asked = [(1, "État de l'un"), (2, "tat de l'una"), (3, ""), (4, None), (5, "état de l'un"), (6, "un A")]
    spark.createDataFrame(asked, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = sorted((r.query_id, r.doc_id) for r in Y.passages(spark, str(tmp_path)).collect())
    assert got == [(1, 1), (1, 4), (2, 5), (5, 1), (5, 4)]
    asked, search = [], R.Bm25Index.search
    monkeypatch.setattr(R.Bm25Index, "search", lambda self, q, *a, **k: asked.append(q.columns) or search(self, q, *a, **k))
    found = Y.runs(spark, data)
    assert len(asked) == 2
    for name, alone in (("hybrid", P.hybrid_half), ("fused", P.fused_search)):
        assert sorted(found[name].collect()) == sorted(alone(spark, data).select(*found[name].columns).collect())


def test_built_entities_need_no_relations(spark, data, monkeypatch):
    from trilune.operators import kg_build as K
    from trilune.plans import building

    def none(*a, **k):
        raise AssertionError("relations were sought")

    monkeypatch.setattr(K, "related", none)
    assert building.kg_built_entities(spark, data).count() > 0
    with pytest.raises(ValueError):
        building.built(spark, data, "corpus")
