"""A graph convolution with weights in its layers, trained on seed pairs by several tasks at once.

    z(v) = mean over v and its neighbours u of relu(mean over u and its neighbours of x  W1)  W2,  of length 1

Training takes blocks: of each seed a sample of its neighbours, and of these the averages of a sample of theirs, which no weight
precedes and which are therefore made by joins beforehand. A node keeps about `fan` neighbours, chosen by a hash of
the edge. Blocks are dealt to tasks of one barrier stage; each computes the gradient of its own pairs, all exchange and sum
their gradients, of the weights' size, and take the same step, so that no task ever holds another's blocks and the driver none. When
a task is lost, Spark starts the stage again. What the stage returns are the weights that did best on pairs held out.

Applying the network samples nothing: two averages over whole neighbourhoods as aggregations, and a product with each weight.
Nodes without vectors count nowhere; edges are without direction, repeated ones and loops count once. Barrier stages need as many
free slots as tasks, and no dynamic allocation.
"""

from __future__ import annotations

import base64
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trilune.operators.align import averaged, undirected
from trilune.operators.graph_encoder import hardest, hits_at_1
from trilune.sources.tables import stored


@dataclass
class Network:
    first: np.ndarray
    second: np.ndarray

    def forward(self, block: np.ndarray, weight: np.ndarray):
        """Of nodes' blocks (nodes x members x numbers, and each member's share): hidden values, their means, vectors before and after scaling, lengths."""
        hidden = np.maximum(block @ self.first, 0)
        mean = np.einsum("nm,nmh->nh", weight, hidden)
        raw = mean @ self.second
        length = np.maximum(np.linalg.norm(raw, axis=1, keepdims=True), 1e-12)
        return hidden, mean, raw / length, length

    def gradient(self, block: np.ndarray, weight: np.ndarray, pairs: int, margin: float):
        """Summed loss of the pairs (row i and row i + pairs) against the hardest other rows, and its gradients."""
        hidden, mean, e, length = self.forward(block, weight)
        a, b = np.arange(pairs), np.arange(pairs) + pairs
        c = hardest(e, a, b)
        near, far = np.linalg.norm(e[a] - e[b], axis=1), np.linalg.norm(e[a] - e[c], axis=1)
        loss = np.maximum(0, margin + near - far)
        on = (loss > 0)[:, None]
        to_b = on * (e[a] - e[b]) / np.maximum(near, 1e-9)[:, None]
        to_c = on * (e[a] - e[c]) / np.maximum(far, 1e-9)[:, None]
        g = np.zeros_like(e)
        for rows, grad in ((a, to_b - to_c), (b, -to_b), (c, to_c)):
            np.add.at(g, rows, grad)
        g = (g - e * (g * e).sum(axis=1, keepdims=True)) / length
        below = np.einsum("nm,nh->nmh", weight, g @ self.second.T) * (hidden > 0)
        return float(loss.sum()), np.einsum("nmd,nmh->dh", block, below), mean.T @ g


def sampled(edges: DataFrame, fan: int) -> DataFrame:
    """About `fan` of each node's neighbours, all where it has no more; chosen by a hash of the edge."""
    degree = edges.groupBy("src").agg(F.count("*").alias("_degree")).where(F.col("_degree") > fan)
    drawn = F.pmod(F.xxhash64(F.lit("fan"), "src", "dst"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    chance = F.coalesce(fan / F.col("_degree"), F.lit(1.0))
    return edges.join(degree, "src", "left").where(drawn < chance).select("src", "dst")


def blocks(nodes: DataFrame, edges: DataFrame, roots: DataFrame, fan: int) -> DataFrame:
    """(id, block): for each root an array with its own average and those of its sampled neighbours."""
    near = stored(sampled(undirected(edges), fan), "sampled")
    one = near.join(roots.select(F.col("id").alias("src")), "src").select(F.col("src").alias("root"), F.col("dst").alias("id"))
    members = stored(one.unionByName(roots.select(F.col("id").alias("root"), "id")).distinct(), "members")
    wanted = members.select("id").distinct()
    around = near.join(wanted.select(F.col("id").alias("src")), "src")
    means = averaged(nodes, around, wanted)
    return members.join(means, "id").groupBy("root").agg(F.collect_list("x").alias("block")).withColumnRenamed("root", "id")


def fit(
    nodes: DataFrame,
    edges: DataFrame,
    seeds: DataFrame,
    size: int = 32,
    hidden: int = 64,
    fan: int = 10,
    most: int = 5000,
    epochs: int = 120,
    rate: float = 0.01,
    margin: float = 1.0,
    held: float = 0.2,
    patience: int = 4,
    tasks: int = 4,
    seed: int = 1,
) -> Network:
    """Weights from at most `most` seed pairs (e1, e2), chosen by hash, of nodes (id, x)."""
    spark = nodes.sparkSession
    some = stored(seeds.where("e1 is not null and e2 is not null").select("e1", "e2").distinct().orderBy(F.xxhash64("e1", "e2"), "e1", "e2").limit(most), "seeds")
    roots = some.select(F.col("e1").alias("id")).union(some.select("e2")).distinct()
    own = stored(blocks(nodes, edges, roots, fan), "blocks")
    side = lambda i, n: own.select(F.col("id").alias(i), F.col("block").alias(n))
    tasks = min(tasks, spark.sparkContext.defaultParallelism)
    pairs = some.join(side("e1", "a"), "e1").join(side("e2", "b"), "e2")
    dealt = pairs.select(F.pmod(F.xxhash64("e1", "e2"), F.lit(1000)).alias("h"), F.concat_ws(" ", "e1", "e2").alias("name"), "a", "b")
    rows = stored(dealt.repartition(tasks, "h"), "pairs")
    d = nodes.where("x is not null").select(F.size("x")).first()
    if d is None:
        raise ValueError("no node has a vector")
    dims = d[0]

    def train(batches):
        import pyarrow as pa
        from pyspark import BarrierTaskContext

        context = BarrierTaskContext.get()

        def summed(*arrays):
            flat = np.concatenate([np.ravel(a) for a in arrays])
            told = context.allGather(base64.b64encode(flat.tobytes()).decode())
            total = np.sum([np.frombuffer(base64.b64decode(t)) for t in told], axis=0)
            cuts = np.cumsum([np.size(a) for a in arrays])[:-1]
            return [t.reshape(np.shape(a)) for t, a in zip(np.split(total, cuts), arrays, strict=True)]

        mine = sorted((h, name, a, b) for batch in batches for h, name, a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True))

        def packed(some):
            both = [x[2] for x in some] + [x[3] for x in some]
            most_members = max(map(len, both), default=1)
            block, weight = np.zeros((len(both), most_members, dims)), np.zeros((len(both), most_members))
            for i, m in enumerate(both):
                block[i, : len(m)], weight[i, : len(m)] = sorted(m), 1 / len(m)
            return block, weight, len(some)

        aside = [x for x in mine if x[0] < 1000 * held]
        rest = [x for x in mine if x[0] >= 1000 * held]
        (block, weight, n), judged = packed(rest), packed(aside if len(aside) > 1 else mine)
        r = np.random.default_rng(seed)
        net = Network(r.normal(0, (2 / dims) ** 0.5, (dims, hidden)), r.normal(0, (1 / hidden) ** 0.5, (hidden, size)))
        best, kept, worse = -1.0, net, 0
        moments = [[np.zeros_like(w), np.zeros_like(w)] for w in (net.first, net.second)]
        for epoch in range(1, epochs + 1):
            loss, *grads = net.gradient(block, weight, n, margin) if n else (0.0, np.zeros_like(net.first), np.zeros_like(net.second))
            count, loss, *grads = summed(np.array(float(n)), np.array(loss), *grads)
            weights = []
            for w, g, moment in zip((net.first, net.second), grads, moments, strict=True):
                g = g / max(float(count), 1.0)
                moment[0] = 0.9 * moment[0] + 0.1 * g
                moment[1] = 0.999 * moment[1] + 0.001 * g * g
                weights.append(w - rate * (moment[0] / (1 - 0.9**epoch)) / (np.sqrt(moment[1] / (1 - 0.999**epoch)) + 1e-8))
            net = Network(*weights)
            if epoch % 10 == 0:
                m = judged[2]
                e = net.forward(*judged[:2])[2] if m else np.zeros((0, size))
                hits = hits_at_1(e, np.arange(m), np.arange(m) + m) * m if m else 0.0
                hits, of = summed(np.array(float(hits)), np.array(float(m)))
                if float(hits) / max(float(of), 1.0) > best:
                    best, kept, worse = float(hits) / max(float(of), 1.0), net, 0
                else:
                    worse += 1
                    if worse >= patience:
                        break
        if context.partitionId() == 0:
            yield pa.RecordBatch.from_arrays([pa.array([w.tobytes()], pa.binary()) for w in (kept.first, kept.second)], ["first", "second"])

    found = rows.mapInArrow(train, "first binary, second binary", barrier=True).collect()  # one row, of the weights' size
    return Network(np.frombuffer(found[0].first).reshape(dims, hidden), np.frombuffer(found[0].second).reshape(hidden, size))


def product(rows: DataFrame, w: np.ndarray, rectified: bool) -> DataFrame:
    """(id, x): vectors times a matrix; what is below 0 becomes 0, or else vectors get length 1."""
    sent = rows.sparkSession.sparkContext.broadcast(w)  # of a fixed size

    def apply(batches):
        import pyarrow as pa

        for batch in batches:
            if batch.num_rows:
                z = np.asarray(batch.column(1).flatten(), float).reshape(batch.num_rows, -1) @ sent.value
                z = np.maximum(z, 0) if rectified else z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(z), pa.list_(pa.float64()))], ["id", "x"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.select("id", F.col("x").cast("array<double>").alias("x")).mapInArrow(apply, f"id {kind}, x array<double>")


def encoded(nodes: DataFrame, edges: DataFrame, net: Network) -> DataFrame:
    """(id, x) of every node under the network, over whole neighbourhoods."""
    both = undirected(edges)
    x = nodes.where("x is not null").select("id", F.col("x").cast("array<double>").alias("x"))
    hidden = stored(product(averaged(x, both), net.first, True), "hidden")
    return product(averaged(hidden, both), net.second, False)
