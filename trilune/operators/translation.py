"""Translation embeddings of a graph of any size: entities in buckets, triples trained bucket pair by bucket pair.

A triple h, r, t wants |x(h) + v(r) - x(t)| smaller, by a margin, than the same with an end replaced by another entity. Entities are
dealt to an even number of buckets by a hash of their names. A sweep is a tournament: in each of its rounds every bucket
meets one other, so that pairs of buckets share nothing and are trained side by side, each in a task that holds two buckets'
vectors and the triples between them. Triples inside a bucket are dealt to the rounds by a hash, so each triple is trained once
a sweep. Replacements come from the pair's two buckets and the same group. After a round the tables of vectors are written, so lost
executors repeat that round only.

Relations have a vector per group, of which a round's pairs each train a copy; the next round starts from their mean, weighted by triples.
There are few relations: their vectors are sent to every task.

Groups (such as languages) are vocabularies of their own. Repeated triples count once; triples with a null are left out. Starts are drawn
from a hash of the name, and what a task draws from its round and pair, so results do not depend on partitions.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trilune.sources.tables import stored


def tournament(buckets: int) -> list[list[tuple[int, int]]]:
    """Rounds of disjoint pairs in which each of an even number of buckets meets each other once."""
    if buckets == 1:
        return [[(0, 0)]]
    ring = list(range(1, buckets))
    out = []
    for turn in range(buckets - 1):
        now = [0, *ring[turn:], *ring[:turn]]
        out.append([tuple(sorted((now[i], now[-1 - i]))) for i in range(buckets // 2)])
    return out


def start_of(name: str, size: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, zlib.crc32(name.encode("utf-8", "surrogatepass"))]).normal(0, 1 / size**0.5, size)


def descend(e, v, h, r, t, rng, rate: float, margin: float, negatives: int) -> None:
    """One pass over the triples, in place: gradient steps against `negatives` replaced ends of each; then no vector is longer than 1."""
    for _ in range(negatives):
        bad, head = rng.integers(0, len(e), len(h)), rng.random(len(h)) < 0.5
        hn, tn = np.where(head, bad, h), np.where(head, t, bad)
        p, n = e[h] + v[r] - e[t], e[hn] + v[r] - e[tn]
        dp, dn = np.linalg.norm(p, axis=1) + 1e-9, np.linalg.norm(n, axis=1) + 1e-9
        on = (margin + dp - dn > 0)[:, None]
        gp, gn = on * p / dp[:, None], on * n / dn[:, None]
        for i, grad in ((h, gp), (t, -gp), (hn, -gn), (tn, gn)):
            np.add.at(e, i, -rate / negatives * grad)
        np.add.at(v, r, -rate / negatives * (gp - gn))
    e /= np.maximum(1, np.linalg.norm(e, axis=1))[:, None]


def embedded(
    triples: DataFrame,
    by: str,
    size: int = 16,
    sweeps: int = 50,
    rate: float = 0.05,
    margin: float = 1.0,
    negatives: int = 5,
    seed: int = 1,
    buckets: int | None = None,
    bucket_triples: int = 200_000,
    passes: int = 5,
) -> tuple[DataFrame, dict[tuple[str, str], np.ndarray]]:
    """(by, name, x) of the entities of triples (by, h, r, t), and the relations' vectors by group and relation.

    buckets: as many as keep about `bucket_triples` triples between two, if not given. `passes` over a pair's triples each time its buckets meet
    save rounds: a sweep does the work of as many epochs.
    """
    spark = triples.sparkSession
    clean = triples.select(F.col(by).cast("string").alias("g"), "h", "r", "t").dropna().distinct()
    clean = stored(clean, "triples")
    if buckets is None:
        buckets = max(1, int((clean.count() / bucket_triples) ** 0.5))
    buckets += buckets % 2 if buckets > 1 else 0
    rounds = tournament(buckets)
    turn = {pair: (i, k) for i, pairs in enumerate(rounds) for k, pair in enumerate(pairs)}
    bucket = lambda c: F.pmod(F.xxhash64(F.lit("bucket"), c), F.lit(buckets)).cast("int")
    a, b = F.least(bucket("h"), bucket("t")), F.greatest(bucket("h"), bucket("t"))
    inside = F.pmod(F.xxhash64("h", "r", "t"), F.lit(len(rounds))).cast("int")
    place = {(i, x): k for i, pairs in enumerate(rounds) for k, pair in enumerate(pairs) for x in pair}
    flat = lambda values: F.array(*map(F.lit, values))
    meets = flat([turn.get((min(i, j), max(i, j)), (0, 0))[0] for i in range(buckets) for j in range(buckets)])
    table = flat([place[i, x] for i in range(len(rounds)) for x in range(buckets)])
    dealt = clean.withColumn("a", a).withColumn("b", b)
    dealt = dealt.withColumn("round", F.when(F.col("a") == F.col("b"), inside).otherwise(F.element_at(meets, F.col("a") * buckets + F.col("b") + 1)))
    dealt = dealt.withColumn("pair", F.element_at(table, F.col("round") * buckets + F.col("a") + 1)).select("g", "round", "pair", "h", "r", "t")
    dealt = stored(dealt, "dealt")
    names = dealt.select("g", F.col("h").alias("name")).union(dealt.select("g", F.col("t"))).distinct()
    relations = {(x.g, x.r): start_of(f"{x.g}\n{x.r}", size, seed + 1) for x in dealt.select("g", "r").distinct().collect()}

    def begin(batches):
        import pyarrow as pa

        for batch in batches:
            x = [start_of(f"{g}\n{n}", size, seed) for g, n in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(x, pa.list_(pa.float64()))], ["g", "name", "x"])

    def trainer(sent, sweep: int, i: int):
        def train(key, left, right):
            import pandas as pd

            g, pair = key
            left = left.sort_values("name", ignore_index=True)
            own = sorted(r for group, r in sent.value if group == g)
            v = np.array([sent.value[g, r] for r in own])
            names = left["name"].tolist()
            if len(left) and len(right):
                right = right.sort_values(["h", "r", "t"], ignore_index=True)
                e = np.stack(left["x"])
                number = {n: k for k, n in enumerate(names)}
                rel = {r: k for k, r in enumerate(own)}
                h, r, t = (np.array([m[x] for x in right[c]]) for c, m in (("h", number), ("r", rel), ("t", number)))
                rng = np.random.default_rng([seed, sweep, i, int(pair), zlib.crc32(g.encode())])
                for _ in range(min(passes, sweeps - sweep * passes)):
                    descend(e, v, h, r, t, rng, rate, margin, negatives)
                left = left.assign(x=list(e))
            out = pd.DataFrame({"g": g, "kind": "e", "name": names, "x": list(left["x"]), "n": 0})
            told = pd.DataFrame({"g": g, "kind": "r", "name": own, "x": list(v), "n": len(right)})
            return pd.concat([out, told], ignore_index=True)

        return train

    vectors = stored(names.mapInArrow(begin, "g string, name string, x array<double>"), "vectors")
    for sweep in range(-(-sweeps // passes)):
        for i in range(len(rounds)):
            sent = spark.sparkContext.broadcast(relations)
            pair_of = F.element_at(table, F.lit(i * buckets + 1) + bucket("name"))
            grouped = vectors.withColumn("pair", pair_of).groupBy("g", "pair")
            now = dealt.where(F.col("round") == i).groupBy("g", "pair")
            train = trainer(sent, sweep, i)
            both = stored(grouped.cogroup(now).applyInPandas(train, "g string, kind string, name string, x array<double>, n long"), "round")
            vectors = both.where("kind = 'e'").select("g", "name", "x")
            sums: dict = {}
            for row in both.where("kind = 'r' and n > 0").orderBy("g", "name", "n", "x").select("g", "name", "x", "n").collect():  # relations x pairs
                total = sums.setdefault((row.g, row.name), [np.zeros(size), 0])
                total[0] += row.n * np.array(row.x)
                total[1] += row.n
            relations = relations | {k: x / n for k, (x, n) in sums.items()}
            sent.destroy()
    return vectors.withColumnRenamed("g", by), relations


def distances(triples: DataFrame, by: str, vectors: DataFrame, relations: dict[tuple[str, str], np.ndarray]) -> DataFrame:
    """triples with `distance`, |x(h) + v(r) - x(t)|."""
    spark = triples.sparkSession
    rows = [(g, r, v.tolist()) for (g, r), v in relations.items()]
    rel = F.broadcast(spark.createDataFrame(rows, "_g string, _r string, _v array<double>"))  # few relations
    end = lambda c, x: vectors.select(F.col(by).alias(f"_{c}g"), F.col("name").alias(f"_{c}"), F.col("x").alias(x))
    out = triples.join(end("h", "_x"), (F.col(by) == F.col("_hg")) & (F.col("h") == F.col("_h"))).join(end("t", "_y"), (F.col(by) == F.col("_tg")) & (F.col("t") == F.col("_t")))
    out = out.join(rel, (F.col(by) == F.col("_g")) & (F.col("r") == F.col("_r")))
    gap = F.zip_with(F.zip_with("_x", "_v", lambda a, b: a + b), "_y", lambda a, b: a - b)
    return out.withColumn("distance", F.sqrt(F.aggregate(gap, F.lit(0.0), lambda s, v: s + v * v))).select(*triples.columns, "distance")
