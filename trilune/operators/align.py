"""Entity alignment across languages: candidates by cosine, fusion of sources, one-to-one matching, translations of vectors."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trilune.operators.graph import rounds
from trilune.operators.retrieval import dense_search
from trilune.sources.tables import stored


def candidates(left: DataFrame, right: DataFrame, top_k: int, least: float) -> DataFrame:
    """(e1, e2, confidence): each left vector's nearest right ones, first the top_k, then those of at least `least`."""
    return (
        dense_search(left, right, top_k)
        .where(F.col("score") >= least)
        .select(F.col("query_id").alias("e1"), F.col("doc_id").alias("e2"), F.col("score").alias("confidence"))
    )


def fused(a: DataFrame, b: DataFrame, wa: float = 0.5, wb: float = 0.5) -> DataFrame:
    """Full outer join of candidates: weighted where both have a confidence that is not 0, else the one, with its source."""
    x = a.select("e1", "e2", F.col("confidence").alias("a")).join(
        b.select("e1", "e2", F.col("confidence").alias("b")),
        ["e1", "e2"],
        "full",
    )
    has = lambda c: F.coalesce(F.col(c), F.lit(0.0)) != 0
    return x.select(
        "e1",
        "e2",
        (
            F.when(has("a") & has("b"), wa * F.col("a") + wb * F.col("b"))
            .when(has("a"), F.col("a"))
            .otherwise(F.col("b"))
            .alias("confidence")
        ),
        F.when(has("a") & has("b"), "fused").when(has("a"), "first").otherwise("second").alias("source"),
    )


def one_to_one(pairs: DataFrame, most: int | None = None) -> DataFrame:
    """Greedy matching in order of confidence: rounds that take every pair that is the best left on both of its sides. Pairs without both ends are none."""
    left, taken = stored(pairs.where("e1 is not null and e2 is not null").select("e1", "e2", "confidence").distinct(), "left"), None
    for _ in rounds(most):
        order = [F.desc("confidence"), "e1", "e2"]
        best = left.withColumn("r1", F.row_number().over(Window.partitionBy("e1").orderBy(*order))).withColumn(
            "r2",
            F.row_number().over(Window.partitionBy("e2").orderBy(*order)),
        )
        won = stored(best.where("r1 = 1 and r2 = 1").select("e1", "e2", "confidence"), "won")
        taken = won if taken is None else stored(taken.unionByName(won), "taken")
        left = stored(left.join(won.select("e1"), "e1", "left_anti").join(won.select("e2"), "e2", "left_anti"), "left")
        if left.isEmpty():
            break
    return taken


def linear_map(pairs: DataFrame) -> np.ndarray:
    """M with x M closest to y over pairs of vectors (x, y): the d x d moments are summed in the tasks, and only they are collected."""

    def moments(batches):
        import pyarrow as pa

        for batch in batches:
            if len(batch):
                x, y = (np.asarray(c.flatten(), float).reshape(len(batch), -1) for c in batch.columns)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([(x.T @ x).ravel().tolist()]), pa.array([(x.T @ y).ravel().tolist()])],
                    names=["g", "h"],
                )

    cast = lambda c: F.col(c).cast("array<double>").alias(c)
    rows = pairs.select(cast("x"), cast("y")).mapInArrow(moments, "g array<double>, h array<double>")
    total = lambda c: (
        rows.select(F.posexplode(c).alias("i", "v"))
        .groupBy("i")
        .agg(F.sum("v").alias("v"))
        .orderBy("i")
        .select("v")
        .collect()
    )
    g, h = (np.array([r[0] for r in total(c)]) for c in ("g", "h"))
    d = int(round(len(g) ** 0.5))
    return np.linalg.lstsq(g.reshape(d, d), h.reshape(d, -1), rcond=None)[0]


def trans_e(
    triples: DataFrame,
    by: str,
    size: int = 16,
    epochs: int = 50,
    rate: float = 0.05,
    margin: float = 1.0,
    negatives: int = 5,
    seed: int = 1,
) -> DataFrame:
    """(by, name, x): embeddings of h, r, t triples of each group, trained with a margin against corrupted triples. Groups are vocabularies of one language."""

    def train(key, pdf):
        import pandas as pd

        names = sorted({*pdf["h"], *pdf["t"]})
        rels = sorted(set(pdf["r"]))
        at, of = {n: i for i, n in enumerate(names)}, {n: i for i, n in enumerate(rels)}
        h, r, t = (np.array([m[v] for v in pdf[c]]) for c, m in (("h", at), ("r", of), ("t", at)))
        g = np.random.default_rng(seed)
        e, v = g.normal(0, 1 / size**0.5, (len(names), size)), g.normal(0, 1 / size**0.5, (len(rels), size))
        for _ in range(epochs):
            for _ in range(negatives):
                bad, head = g.integers(0, len(names), len(h)), g.random(len(h)) < 0.5
                hn, tn = np.where(head, bad, h), np.where(head, t, bad)
                p, n = e[h] + v[r] - e[t], e[hn] + v[r] - e[tn]
                dp, dn = np.linalg.norm(p, axis=1) + 1e-9, np.linalg.norm(n, axis=1) + 1e-9
                on = (margin + dp - dn > 0)[:, None]
                gp, gn = on * p / dp[:, None], on * n / dn[:, None]
                for i, grad in ((h, gp), (t, -gp), (hn, -gn), (tn, gn)):
                    np.add.at(e, i, -rate / negatives * grad)
                np.add.at(v, r, -rate / negatives * (gp - gn))
            e /= np.maximum(1, np.linalg.norm(e, axis=1))[:, None]
        return pd.DataFrame({by: key[0], "name": names, "x": list(e)})

    return (
        triples.select(by, "h", "r", "t")
        .groupBy(by)
        .applyInPandas(train, f"{by} string, name string, x array<double>")
    )


def undirected(edges: DataFrame) -> DataFrame:
    """(src, dst) in both directions, each once, without loops. A table."""
    ends = edges.select("src", "dst").where("src <> dst")
    return stored(ends.union(ends.select("dst", "src")).distinct(), "both")


def averaged(nodes: DataFrame, both: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """(id, x): the mean of a node's vector and its neighbours', one row per edge and a column of means per number. Nodes without a vector get none. wanted: ids to keep (all)."""
    first = nodes.where("x is not null").select(F.size("x")).first()
    size = first[0] if first is not None else 0
    x = nodes.where("x is not null").select("id", F.col("x").cast("array<double>").alias("x"))
    own = x if wanted is None else x.join(wanted.select("id"), "id", "left_semi")
    near = both.join(x, both["dst"] == x["id"]).select(F.col("src").alias("id"), "x", F.lit(False).alias("_own"))
    near = near.unionByName(own.withColumn("_own", F.lit(True)))
    mean = [F.avg(F.get("x", F.lit(i))).alias(f"_{i}") for i in range(size)]
    whole = F.array(*[F.col(f"_{i}") for i in range(size)]) if size else F.array().cast("array<double>")
    return near.groupBy("id").agg(F.max("_own").alias("_own"), *mean).where("_own").select("id", whole.alias("x"))


def propagated(nodes: DataFrame, edges: DataFrame, layers: int = 2) -> DataFrame:
    """(id, x): vectors averaged with those of undirected neighbours, `layers` times, then of length 1; the propagation of a graph convolution."""
    both = undirected(edges)
    x = nodes.select("id", "x")
    for _ in range(layers):
        x = stored(averaged(x, both), "layer")
    norm = F.sqrt(F.aggregate("x", F.lit(0.0), lambda s, v: s + v * v))
    return x.select("id", F.transform("x", lambda v: v / F.greatest(norm, F.lit(1e-12))).alias("x"))
