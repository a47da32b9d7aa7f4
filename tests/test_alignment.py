"""Training and pipeline of alignment, by hand."""

import numpy as np
import pytest

from trilune.operators import graph_encoder as N


def test_hardest_is_neither_of_the_pair():
    e = np.eye(4)[[0, 0, 1, 0]]
    assert N.hardest(e, np.array([0]), np.array([1])).tolist() == [3]
    assert N.contrastive_loss(e, np.array([0]), np.array([1])) == pytest.approx(1.0)
    assert N.contrastive_loss(np.array([[1.0, 0], [1, 0], [-1, 0]]), np.array([0]), np.array([1]), margin=1.0) == 0


def test_head_learns_what_pairs_share():
    r = np.random.default_rng(0)
    common = r.normal(size=(120, 6))
    left = np.concatenate([common, 3 * r.normal(size=(120, 6))], axis=1)
    right = np.concatenate([common, 3 * r.normal(size=(120, 6))], axis=1)
    z = np.concatenate([left, right])
    a, b = np.arange(120), np.arange(120, 240)
    before = N.hits_at_1(z / np.linalg.norm(z, axis=1)[:, None], a, b)
    head = N.trained(z, a, b, epochs=300, patience=30)
    assert N.hits_at_1(head(z), a, b) > before + 0.2


def test_predictions_are_scaled_by_the_largest_distance(spark):
    one = spark.createDataFrame([("a", [0.0, 0.0])], "id string, x array<double>")
    many = spark.createDataFrame([("a", [0.0, 0.0]), ("b", [0.0, 1.0]), ("c", [0.0, 3.0]), ("d", [4.0, 0.0])], "id string, x array<double>").repartition(
        3,
    )
    got = {r.e2: r.confidence for r in N.predicted(one, many, 3, 0.2).collect()}
    assert got == {"b": pytest.approx(0.75), "c": pytest.approx(0.25)}  # the source itself is no partner
    assert [r.e2 for r in N.predicted(one, many, 2, 0.0).collect()] == ["b"]
    assert N.predicted(one.limit(0), many).count() == 0


def test_pipeline_finds_turned_vectors(spark):
    r = np.random.default_rng(5)
    x = r.normal(size=(60, 6))
    x /= np.linalg.norm(x, axis=1)[:, None]
    turn = np.linalg.qr(r.normal(size=(6, 6)))[0]
    y = x @ turn
    left = spark.createDataFrame([(f"l{i}", v.tolist()) for i, v in enumerate(x)], "id string, x array<double>")
    right = spark.createDataFrame([(f"r{i}", v.tolist()) for i, v in enumerate(y)], "id string, x array<double>")
    edges = spark.createDataFrame(
        [(f"{s}{i}", f"{s}{(i + 1) % 60}") for s in "lr" for i in range(60)],
        "src string, dst string",
    )
    seeds = spark.createDataFrame([(f"l{i}", f"r{i}") for i in range(0, 60, 3)], "e1 string, e2 string")
    found = N.aligned(left, right, edges, seeds).collect()
    assert len({r.e1 for r in found}) == len(found) == len({r.e2 for r in found})
    assert sum(r.e1[1:] == r.e2[1:] for r in found) >= 54


def test_gold_by_classes_is_that_by_pairs(spark):
    from trilune.operators import metrics as M

    left = spark.createDataFrame([(1, "a"), (3, "a"), (5, "b"), (7, None), (9, "c")], "e1 long, class string")
    right = spark.createDataFrame([(2, "a"), (4, "b"), (6, "b"), (8, None), (10, "a")], "e2 long, class string")
    pairs = left.join(right, "class").select("e1", "e2")
    predicted = spark.createDataFrame([(1, 2, 0.9), (1, 4, 0.8), (5, 6, 0.7), (7, 8, 0.6), (3, 10, 0.5), (9, 2, 0.4)], "e1 long, e2 long, confidence double")
    gold = M.ClassGold(left, right)
    assert gold.count() == pairs.count() == 6
    for f in (M.alignment_metrics, M.precision_recall):
        assert sorted(f(predicted, gold).collect()) == sorted(f(predicted, pairs).collect())


def test_gold_of_large_classes_is_not_written_out(spark):
    from trilune.operators import metrics as M

    ids = spark.range(2_000_000)
    left, right = (ids.where(f"id % 2 = {i}").selectExpr(f"id as e{2 - i}", "id % 7 div 4 as class") for i in (1, 0))
    predicted = spark.createDataFrame([(1, 2, 0.9), (5, 2, 0.8)], "e1 long, e2 long, confidence double")
    rows = {r.k: r.precision for r in M.precision_recall(predicted, M.ClassGold(left, right)).collect()}
    assert rows == {1: 1.0, 2: 0.5}
