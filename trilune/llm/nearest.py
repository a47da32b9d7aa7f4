"""Approximate nearest neighbours by learned partitions.

On a bounded sample, a neighbour graph is built and cut into balanced parts: a start by
halving along main directions, then moves of vertices to where most of their neighbours
are, as long as parts keep their size. A small classifier learns which parts hold a
vector's neighbours. Every row is put into its likeliest part; a query searches its
likeliest parts, as many as reach the wanted recall on sample rows that the classifier
did not learn from (all of them, if the sample has no such rows), and further ones until they
hold k rows beside its own; what they hold is ranked by exact inner products in double precision.

The number of parts follows the number of rows; a table of 160 rows and more has eight at least. Where one classifier would have to tell more parts apart than its
sample can teach (a twentieth of it), there are two levels: the parts that it tells apart are cut again, each
by a partition and a classifier of its own, learned in a task of its own from a bounded sample of its rows.

Parts and the queries sent to them are dealt out in blocks of bounded size, so that a
part with many rows, such as copies of one vector, is many tasks. In a block, copies are
compared once; of one vector's copies only the smallest ids can be among the nearest.

Vectors that are null, zero, of another length than most in the sample, or that hold a null
or a non-finite component take no part. Null ids take no part. A repeated id asks once, with the first of its
vectors in order of their bytes; all rows with its id are its own. As candidates, repeated rows are rows of their own. Other columns are not used. Empty tables give no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trilune.llm.common import dropped, table, written

LEAST_CELLS = 8
LEAST_PARTS = 8
PART_ROWS = 800


@dataclass
class Router:
    mean: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray
    probes: int = 1

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.maximum((x - self.mean) @ self.w1 + self.b1, 0) @ self.w2 + self.b2


@dataclass
class Levels:
    """A router, and for each of its parts the one that cuts it again, if any; parts are numbered through."""

    top: Router
    below: list[Router | None]

    @property
    def first(self) -> np.ndarray:
        """Number of each top part's first part; at the end, of all parts."""
        return np.cumsum([0, *(1 if r is None else r.w2.shape[1] for r in self.below)])

    def home(self, x: np.ndarray) -> np.ndarray:
        """The likeliest part of each row."""
        part = self.top.logits(x).argmax(axis=1)
        out = self.first[part]
        for p in np.unique(part):
            if self.below[p] is not None:
                own = part == p
                out[own] += self.below[p].logits(x[own]).argmax(axis=1)
        return out

    def searched(self, x: np.ndarray, held: np.ndarray, wanted: np.ndarray) -> list[np.ndarray]:
        """Parts that each row searches: the likeliest ones, and then further ones until they hold the rows wanted."""
        order = np.argsort(-self.top.logits(x), axis=1, kind="stable")
        first = self.first
        inner = {p: np.argsort(-r.logits(x), axis=1, kind="stable") for p, r in enumerate(self.below) if r is not None}
        out = []
        for i, tops in enumerate(order):
            now, later = [], []
            for place, p in enumerate(tops):
                own = first[p] + (inner[p][i] if p in inner else np.zeros(1, np.int64))
                n = 0 if place >= self.top.probes else len(own) if p not in inner else self.below[p].probes
                now.append(own[:n])
                later.append(own[n:])
            now, later = np.concatenate(now), np.concatenate(later)
            missing = wanted[i] - held[now].sum()
            if missing > 0:
                now = np.append(now, later[: 1 + int(np.searchsorted(np.cumsum(held[later]), missing))])
            out.append(now)
        return out


def neighbours(x: np.ndarray, k: int, block: int = 512) -> np.ndarray:
    """The k rows with the largest inner product with each row, but itself."""
    out = np.empty((len(x), k), np.int64)
    for a in range(0, len(x), block):
        s = x[a : a + block] @ x.T
        s[np.arange(len(s)), np.arange(a, a + len(s))] = -np.inf
        out[a : a + block] = np.argpartition(-s, k - 1, axis=1)[:, :k]
    return out


def balanced_parts(
    x: np.ndarray,
    graph: np.ndarray,
    parts: int,
    rounds: int = 12,
    slack: float = 1.15,
    seed: int = 5,
) -> np.ndarray:
    """Part of each vertex: few edges of the graph between parts, none larger than slack times the mean."""
    part = np.zeros(len(x), np.int64)

    def halve(rows, lo, hi):
        if hi - lo <= 1 or len(rows) < 2:
            part[rows] = lo
            return
        own = x[rows] - x[rows].mean(axis=0)
        v = np.random.default_rng(seed + lo).normal(size=x.shape[1])
        for _ in range(8):
            v = own.T @ (own @ v)
            v /= np.linalg.norm(v) or 1
        mid = (lo + hi) // 2
        order = rows[np.argsort(own @ v, kind="stable")]
        cut = len(rows) * (mid - lo) // (hi - lo)
        halve(order[:cut], lo, mid)
        halve(order[cut:], mid, hi)

    halve(np.arange(len(x)), 0, parts)
    most = int(np.ceil(slack * len(x) / parts))
    source = np.repeat(np.arange(len(x)), graph.shape[1])
    for _ in range(rounds):
        tie = np.zeros((len(x), parts), np.int32)
        np.add.at(tie, (source, part[graph.ravel()]), 1)
        np.add.at(tie, (graph.ravel(), part[source]), 1)
        best = tie.argmax(axis=1)
        gain = tie[np.arange(len(x)), best] - tie[np.arange(len(x)), part]
        size, moved = np.bincount(part, minlength=parts), 0
        for i in np.argsort(-gain, kind="stable"):
            if gain[i] <= 0:
                break
            if size[best[i]] < most:
                size[part[i]] -= 1
                size[best[i]] += 1
                part[i], moved = best[i], moved + 1
        if not moved:
            break
    return part


def learned(
    x: np.ndarray,
    parts: int,
    k: int = 20,
    recall: float = 0.95,
    hidden: int = 96,
    epochs: int = 30,
    seed: int = 3,
) -> Router:
    """Partition and classifier from sample vectors, with the probes that reach the recall on a tenth of them."""
    r, n, d = np.random.default_rng(seed), len(x), x.shape[1]
    k = min(k, n - 1)
    if parts < 2 or k < 1:
        return Router(np.zeros(d), np.zeros((d, 1)), np.zeros(1), np.zeros((1, 1)), np.zeros(1))  # one part
    graph = neighbours(x, k)
    part = balanced_parts(x, graph, parts)
    goal = np.zeros((n, parts))
    np.add.at(goal, (np.repeat(np.arange(n), k), part[graph.ravel()]), 0.5 / k)
    goal[np.arange(n), part] += 0.5
    test = np.arange(n) % 10 == 9
    train = np.flatnonzero(~test)
    m = Router(
        x.mean(axis=0),
        r.normal(0, 1.4 / np.sqrt(d * x.var()), (d, hidden)),
        np.zeros(hidden),
        r.normal(0, 1 / np.sqrt(hidden), (hidden, parts)),
        np.zeros(parts),
    )
    names = ("w1", "b1", "w2", "b2")
    first, second, step = {q: 0.0 for q in names}, {q: 0.0 for q in names}, 0
    for _ in range(epochs):
        for some in np.array_split(r.permutation(train), max(1, len(train) // 128)):
            a = x[some] - m.mean
            h = np.maximum(a @ m.w1 + m.b1, 0)
            z = h @ m.w2 + m.b2
            p = np.exp(z - z.max(axis=1, keepdims=True))
            g = (p / p.sum(axis=1, keepdims=True) - goal[some]) / len(some)
            gh = (g @ m.w2.T) * (h > 0)
            step += 1
            for q, grad in zip(names, (a.T @ gh, gh.sum(axis=0), h.T @ g, g.sum(axis=0)), strict=True):
                first[q] = 0.9 * first[q] + 0.1 * grad
                second[q] = 0.99 * second[q] + 0.01 * grad * grad
                setattr(
                    m,
                    q,
                    (
                        getattr(m, q)
                        - 3e-3 * (first[q] / (1 - 0.9**step)) / (np.sqrt(second[q] / (1 - 0.99**step)) + 1e-8)
                    ),
                )
    if not test.any():
        m.probes = parts
        return m
    z = m.logits(x)
    home = z.argmax(axis=1)
    rank = np.argsort(np.argsort(-z[test], axis=1, kind="stable"), axis=1)
    need = rank[np.arange(test.sum())[:, None], home[graph[test]]]
    share = [(need < p).mean() for p in range(1, parts + 1)]
    m.probes = 1 + int(np.argmax(np.array(share) >= recall))
    return m


def best_in_block(q_ids, q, ids, x, k: int):
    """(query row, id, score) of each query's k best, nearest first, ties to the smaller id."""
    order = np.argsort(ids, kind="stable")
    ids, x = ids[order], x[order]
    _, same = np.unique(
        np.ascontiguousarray(x).view(np.dtype((np.void, x.dtype.itemsize * x.shape[1]))).ravel(),
        return_inverse=True,
    )
    by = np.argsort(same, kind="stable")
    run = np.arange(len(by)) - np.repeat(np.flatnonzero(np.append(True, np.diff(same[by]) > 0)), np.bincount(same))
    # The smallest ids of each vector: k, and as many as rows with the query's own id may be among them.
    _, times = np.unique(np.stack([same, ids]), axis=1, return_counts=True)
    keep = np.sort(by[run < k + times.max(initial=1)])
    ids, x = ids[keep], x[keep]
    # A product of d terms is rounded by less than d parts in 2**52 of the vectors' lengths.
    rounded = 1e-15 * x.shape[1] * np.sqrt((q * q).sum(axis=1)) * np.sqrt((x * x).sum(axis=1)).max(initial=0)
    rows, cols, scores = [], [], []
    for a in range(0, len(q), 256):
        s = q[a : a + 256] @ x.T
        s[q_ids[a : a + 256, None] == ids[None, :]] = -np.inf
        n = min(k, len(ids))
        least = np.partition(s, len(ids) - n, axis=1)[:, len(ids) - n]
        r, c = np.nonzero((s >= (least - 2 * rounded[a : a + 256])[:, None]) & (s > -np.inf))
        exact = (q[a + r] * x[c]).sum(axis=1)
        o = np.lexsort((ids[c], -exact, r))
        r, c, exact = r[o], c[o], exact[o]
        place = np.arange(len(r)) - np.searchsorted(r, r)
        ok = place < n
        rows.append(a + r[ok])
        cols.append(ids[c[ok]])
        scores.append(exact[ok])
    return np.concatenate(rows), np.concatenate(cols), np.concatenate(scores)


def nearest(
    vectors: DataFrame,
    is_query,
    key: str = "vec_id",
    vector: str = "embedding",
    k: int = 20,
    parts: int | None = None,
    sample: int = 10_000,
    recall: float = 0.95,
    block: int = 20_000,
) -> DataFrame:
    """query_id, rank, id and score of each query's k nearest of the rows found. `sample` bounds what is fitted on."""
    spark = vectors.sparkSession
    clean = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("x"), F.coalesce(is_query, F.lit(False)).alias("asks")).where(
        (
            F.col("id").isNotNull()
            & F.col("x").isNotNull()
            & ~F.exists("x", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
            & F.exists("x", lambda v: v != 0)
        ),
    )
    total = clean.count()
    parts = parts or max(1, total // PART_ROWS, min(LEAST_PARTS, total // 20))
    chance = F.pmod(F.xxhash64(F.lit("fit"), "id"), F.lit(1 << 30))
    chosen = (
        clean.where(chance < F.lit(int(min(1.0, sample / max(total, 1)) * (1 << 30))))
        .orderBy("id")
        .select("x")
        .toArrow()
        .column(0)
    )
    length = np.asarray(chosen.combine_chunks().value_lengths()) if len(chosen) else np.zeros(0, int)
    size = int(np.bincount(length).argmax()) if len(length) else 0
    if not size:
        x = np.zeros((0, 1))
    else:
        x = np.array([v for v in chosen.to_pylist() if len(v) == size])
    top = min(parts, max(1, len(x) // 20))
    levels = parts > top > 1
    router = learned(np.unique(x, axis=0), top, min(k, 20), np.sqrt(recall) if levels else recall)
    tree = Levels(router, [None] * router.w2.shape[1])

    def put(tree: Levels) -> DataFrame:
        sent = spark.sparkContext.broadcast(tree)  # of a size that the sample bounds

        def route(batches):
            import pyarrow as pa

            for batch in batches:
                if len(batch):
                    x = np.asarray(batch.column(1).flatten(), float).reshape(len(batch), size)
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column(0),
                            pa.array([r.tobytes() for r in x], pa.binary()),
                            pa.array(sent.value.home(x), pa.int32()),
                            batch.column(2),
                        ],
                        names=["id", "x", "home", "asks"],
                    )

        return written(
            spark,
            clean.where(F.size("x") == size).mapInArrow(route, "id long, x binary, home int, asks boolean"),
            "routed",
        )

    def rows_in(routed: DataFrame, n: int) -> np.ndarray:
        held = np.zeros(n, np.int64)  # one number per part
        for part, rows in routed.groupBy("home").count().collect():
            held[part] = rows
        return held

    routed = put(tree)
    if levels:
        held = rows_in(routed, len(tree.below))
        share = F.array(*[F.lit(int(min(1.0, sample / max(n, 1)) * (1 << 30))) for n in held])
        again = -(-parts // top)

        def cut(key, pdf):
            import pickle

            import pandas as pd

            x = np.frombuffer(b"".join(pdf["x"]), float).reshape(len(pdf), size)
            fine = min(-(-int(held[key[0]]) * again * top // max(total, 1)), len(x) // 20)
            r = learned(np.unique(x, axis=0), fine, min(k, 20), np.sqrt(recall), hidden=32)
            return pd.DataFrame({"home": [key[0]], "router": [pickle.dumps(r)]})

        import pickle

        some = routed.where(F.pmod(F.xxhash64(F.lit("again"), "id"), F.lit(1 << 30)) < F.element_at(share, F.col("home") + 1)).select(
            "home",
            "x",
        )
        for p, r in some.groupBy("home").applyInPandas(cut, "home int, router binary").collect():  # one per top part
            r = pickle.loads(r)
            tree.below[p] = r if r.w2.shape[1] > 1 else None
        dropped(routed)
        routed = put(tree)
    p_all = int(tree.first[-1])
    held = rows_in(routed, p_all)
    sent = spark.sparkContext.broadcast((tree, held))

    def probe(batches):
        import pyarrow as pa

        for batch in batches:
            if len(batch):
                tree, held = sent.value
                x = np.frombuffer(b"".join(batch.column(1).to_pylist()), float).reshape(len(batch), size)
                found = tree.searched(x, held, k + np.asarray(batch.column(2)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array([t.tolist() for t in found], pa.list_(pa.int32()))],
                    names=["id", "x", "probes"],
                )

    own = routed.groupBy("id").agg(F.count(F.lit(1)).alias("own")).where("own > 1")
    asking = (
        routed.where("asks")
        .groupBy("id")
        .agg(F.min("x").alias("x"))
        .join(own, "id", "left")
        .select("id", "x", F.coalesce("own", F.lit(1)).alias("own"))
    )
    probed = written(spark, asking.mapInArrow(probe, "id long, x binary, probes array<int>"), "probed")
    # Parts lie in cells; a task searches the parts of one cell that each of its queries probes, and passes on one list per query.
    cells = max(LEAST_CELLS, -(-p_all // 32))
    per = -(-p_all // cells)
    cell = lambda c: F.floor(c / per).cast("int")
    routed = routed.withColumn("cell", cell(F.col("home")))
    asked = probed.select("id", "x", "probes", F.explode(F.array_distinct(F.transform("probes", cell))).alias("cell"))
    # How many blocks each cell's rows and queries make; one row per cell.
    rows_of, queries_of = (
        {r[0]: -(-r[1] // block) for r in df.groupBy("cell").count().collect()}
        for df in (routed, asked)
    )
    blocks = lambda found: F.element_at(
        F.array(*[F.lit(max(1, found.get(i, 1))) for i in range(cells)]),
        F.col("cell") + 1,
    )
    salt = lambda found: F.pmod(F.xxhash64(F.lit("block"), "id"), blocks(found)).cast("int")
    every = lambda found: F.explode(F.sequence(F.lit(0), blocks(found) - 1))
    base = routed.select("id", "x", "home", "cell", salt(rows_of).alias("b"), every(queries_of).alias("q"))
    ask = asked.select("id", "x", "probes", "cell", salt(queries_of).alias("q"), every(rows_of).alias("b"))

    def search(left, right):
        import pandas as pd

        rows, cols, scores = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        q_ids, ids = left["id"].to_numpy(), right["id"].to_numpy()
        if len(left) and len(right):
            q, x = (np.frombuffer(b"".join(d["x"]), float).reshape(len(d), -1) for d in (left, right))
            home = right["home"].to_numpy()
            probe_of = np.repeat(np.arange(len(left)), [len(p) for p in left["probes"]])
            probe = np.concatenate(list(left["probes"]))
            for part in np.unique(home):
                mine, held = np.unique(probe_of[probe == part]), home == part
                if len(mine):
                    r, c, s = best_in_block(q_ids[mine], q[mine], ids[held], x[held], k)
                    rows.append(mine[r])
                    cols.append(c)
                    scores.append(s)
        r, c, s = (np.concatenate(v) for v in (rows, cols, scores))
        o = np.lexsort((c, -s, r))
        o = o[np.arange(len(o)) - np.searchsorted(r[o], r[o]) < k]
        return pd.DataFrame({"query_id": q_ids[r[o]], "vec_id": c[o], "score": s[o]})

    keys = ["cell", "b", "q"]
    found = (
        ask.groupBy(*keys)
        .cogroup(base.groupBy(*keys))
        .applyInPandas(search, "query_id long, vec_id long, score double")
    )
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(best))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
