"""Alignment by a graph convolution: neighbourhoods are averaged in the cluster, a small head is trained on seed pairs.

The averaging over neighbours has no weights, so that it runs as joins on graphs of any size (operators.align.propagated);
what is learned comes after it: a hidden layer and a projection, trained on a bounded number of seeds.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trilune.operators import align as A
from trilune.operators.retrieval import block_search, kept_best
from trilune.sources.tables import stored


@dataclass
class Head:
    first: np.ndarray
    second: np.ndarray

    def __call__(self, z: np.ndarray) -> np.ndarray:
        """Vectors of length 1."""
        e = np.maximum(z @ self.first, 0) @ self.second
        return e / np.maximum(np.linalg.norm(e, axis=1, keepdims=True), 1e-12)


def hardest(e: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """For each pair of rows, the row nearest to the left one that is neither of the two."""
    d = 2 - 2 * e[left] @ e.T
    n = np.arange(len(left))
    d[n, left] = d[n, right] = np.inf
    return d.argmin(axis=1)


def contrastive_loss(e: np.ndarray, left: np.ndarray, right: np.ndarray, margin: float = 1.0) -> float:
    """Mean over the pairs of margin plus their distance less that to the hardest other row, where that is above 0."""
    other = hardest(e, left, right)
    near, far = (np.linalg.norm(e[left] - e[x], axis=1) for x in (right, other))
    return float(np.maximum(0, margin + near - far).mean())


def hits_at_1(e: np.ndarray, left: np.ndarray, right: np.ndarray) -> float:
    """Share of the left rows whose nearest other row among the right ones is theirs."""
    return float((((e[left] @ e[right].T).argmax(axis=1)) == np.arange(len(left))).mean())


def trained(
    z: np.ndarray,
    left: np.ndarray,
    right: np.ndarray,
    size: int = 32,
    hidden: int = 64,
    epochs: int = 100,
    rate: float = 5e-3,
    margin: float = 1.0,
    patience: int = 3,
    held: float = 0.2,
    seed: int = 1,
) -> Head:
    """A head that brings pairs of rows of z together; every ten epochs it is judged on pairs held out, and the best one is kept."""
    r = np.random.default_rng(seed)
    d = z.shape[1]
    head = Head(r.normal(0, (2 / d) ** 0.5, (d, hidden)), r.normal(0, (1 / hidden) ** 0.5, (hidden, size)))
    order = r.permutation(len(left))
    aside = order[: int(held * len(left))] if len(left) >= 10 else order
    train = order[len(aside) :] if len(left) >= 10 else order
    best, kept, worse = -1.0, head, 0
    m, v = ([np.zeros_like(w) for w in (head.first, head.second)] for _ in range(2))
    for epoch in range(1, epochs + 1):
        h = z @ head.first
        raw = np.maximum(h, 0) @ head.second
        norm = np.maximum(np.linalg.norm(raw, axis=1, keepdims=True), 1e-12)
        e = raw / norm
        a, b = left[train], right[train]
        c = hardest(e, a, b)
        near, far = np.linalg.norm(e[a] - e[b], axis=1), np.linalg.norm(e[a] - e[c], axis=1)
        on = ((margin + near - far) > 0)[:, None] / max(len(a), 1)
        to_b, to_c = on * (e[a] - e[b]) / np.maximum(near, 1e-9)[:, None], on * (e[a] - e[c]) / np.maximum(far, 1e-9)[:, None]
        g = np.zeros_like(e)
        for rows, grad in ((a, to_b - to_c), (b, -to_b), (c, to_c)):
            np.add.at(g, rows, grad)
        g = (g - e * (g * e).sum(axis=1, keepdims=True)) / norm
        grads = (z.T @ ((g @ head.second.T) * (h > 0)), np.maximum(h, 0).T @ g)
        weights = []
        for i, (w, grad) in enumerate(zip((head.first, head.second), grads, strict=True)):
            m[i] = 0.9 * m[i] + 0.1 * grad
            v[i] = 0.999 * v[i] + 0.001 * grad * grad
            weights.append(w - rate * (m[i] / (1 - 0.9**epoch)) / (np.sqrt(v[i] / (1 - 0.999**epoch)) + 1e-8))
        head = Head(*weights)
        if epoch % 10 == 0:
            now = hits_at_1(head(z), left[aside], right[aside])
            if now > best:
                best, kept, worse = now, head, 0
            else:
                worse += 1
                if worse >= patience:
                    break
    return kept


def fitted(vectors: DataFrame, seeds: DataFrame, most: int = 5000, **how) -> Head:
    """A head from at most `most` seeds (e1, e2) between rows of vectors (id, x), chosen by hash."""
    some = seeds.orderBy(F.xxhash64("e1", "e2"), "e1", "e2").limit(most)
    own = lambda i, n: vectors.select(F.col("id").alias(i), F.col("x").alias(n))
    rows = (
        some.join(own("e1", "a"), "e1")
        .join(own("e2", "b"), "e2")
        .orderBy("e1", "e2")
        .select("e1", "e2", "a", "b")
        .collect()
    )
    ids = sorted({r.e1 for r in rows} | {r.e2 for r in rows})
    at = {x: i for i, x in enumerate(ids)}
    z = np.zeros((len(ids), len(rows[0].a)))
    for r in rows:
        z[at[r.e1]], z[at[r.e2]] = r.a, r.b
    return trained(z, np.array([at[r.e1] for r in rows]), np.array([at[r.e2] for r in rows]), **how)


def embedded(vectors: DataFrame, head: Head) -> DataFrame:
    """(id, x) under the head."""
    sent = vectors.sparkSession.sparkContext.broadcast(head)  # of a fixed size

    def apply(batches):
        import pyarrow as pa

        for batch in batches:
            if len(batch):
                z = np.asarray(batch.column(1).flatten(), float).reshape(len(batch), -1)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(list(sent.value(z)), pa.list_(pa.float64()))],
                    names=["id", "x"],
                )

    kind = vectors.schema["id"].dataType.simpleString()
    return vectors.select("id", F.col("x").cast("array<double>").alias("x")).mapInArrow(
        apply,
        f"id {kind}, x array<double>",
    )


def predicted(source: DataFrame, target: DataFrame, top_k: int = 10, least: float = 0.8) -> DataFrame:
    """(e1, e2, confidence): each source's nearest targets by Euclidean distance, of which 1 less its share of the largest distance is at least `least`.

    The sources go to every part of the targets in blocks; a task passes on its nearest ones and its largest distance.
    """
    kinds = [d.schema["id"].dataType.simpleString() for d in (source, target)]

    def near(ids, q, batches):
        import pyarrow as pa

        held, far = [], np.zeros(len(ids))
        for batch in batches:
            if not batch.num_rows or not len(ids):
                continue
            x = np.asarray(batch.column(1).flatten(), float).reshape(len(batch), -1)
            own = batch.column(0).to_numpy(zero_copy_only=False)
            if not held:
                held = [(np.empty((len(q[a : a + 512]), 0), own.dtype), np.empty((len(q[a : a + 512]), 0))) for a in range(0, len(ids), 512)]
            for i, a in enumerate(range(0, len(ids), 512)):
                p = q[a : a + 512]
                d = np.sqrt(np.maximum((p * p).sum(axis=1)[:, None] + (x * x).sum(axis=1)[None, :] - 2 * p @ x.T, 0))
                far[a : a + 512] = np.maximum(far[a : a + 512], d.max(axis=1))
                held[i] = kept_best(*held[i], own, -np.round(d, 9), top_k)
        for i, (names, scores) in enumerate(held):
            rows, cols = np.nonzero(scores > -np.inf)
            yield pa.RecordBatch.from_arrays(
                [pa.array([ids[512 * i + r] for r in rows]), pa.array(names[rows, cols]), pa.array(-scores[rows, cols]), pa.array(far[512 * i + rows])],
                names=["e1", "e2", "d", "far"],
            )

    out = block_search(source, target, f"e1 {kinds[0]}, e2 {kinds[1]}, d double, far double", near)
    from pyspark.sql import Window

    own = Window.partitionBy("e1")
    out = (
        out.withColumn("far", F.max("far").over(own))
        .withColumn("n", F.row_number().over(own.orderBy(F.round("d", 9), "e2")))
        .where(F.col("n") <= top_k)
    )
    score = F.round(1 - F.col("d") / (F.col("far") + 1e-8), 9)
    return (
        out.where(F.col("e1") != F.col("e2"))
        .select("e1", "e2", score.alias("confidence"))
        .where(F.col("confidence") >= least)
    )


def aligned(
    left: DataFrame,
    right: DataFrame,
    edges: DataFrame,
    seeds: DataFrame,
    sure: float = 0.95,
    least: float = 0.8,
    layers: int = 2,
) -> DataFrame:
    """Two stages. First a linear map over the seeds takes the left vectors (id, x) to the right; its surest candidates join the seeds.

    Then a head over neighbourhood averages is trained on these; both stages' candidates are fused and matched one to one.
    """
    own = lambda v, i, n: v.select(F.col("id").alias(i), F.col("x").alias(n))
    m = A.linear_map(seeds.join(own(left, "e1", "x"), "e1").join(own(right, "e2", "y"), "e2").select("x", "y"))
    taken = F.array(
        *[
            F.aggregate(
                F.zip_with("x", F.array(*[F.lit(float(w)) for w in m[:, j]]), lambda a, b: a * b),
                F.lit(0.0),
                lambda s,
                v: s + v,
            )
            for j in range(m.shape[1])
        ],
    )
    length = F.greatest(F.sqrt(F.aggregate("x", F.lit(0.0), lambda s, v: s + v * v)), F.lit(1e-12))
    unit = lambda v: v.select("id", F.transform("x", lambda c: c / length).alias("x"))
    mapped = stored(unit(left.select("id", taken.alias("x"))), "mapped")
    first = stored(A.candidates(mapped, stored(unit(right), "unit"), 100, least), "first")
    more = seeds.select("e1", "e2").union(first.where(F.col("confidence") >= sure).select("e1", "e2")).distinct()
    both = stored(A.propagated(mapped.unionByName(unit(right)), edges, layers), "averaged")
    x = stored(embedded(both, fitted(both, stored(more, "pseudo"))), "encoded")
    second = predicted(
        x.join(left.select("id"), "id", "left_semi"),
        x.join(right.select("id"), "id", "left_semi"),
        10,
        least,
    )
    return A.one_to_one(A.fused(first, second))
