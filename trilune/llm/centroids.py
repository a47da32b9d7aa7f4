"""Centroid clustering by Lloyd's rounds, each vector meeting only the centroids of its annulus.

Centroids are sorted by norm. By the triangle inequality a centroid c can be no farther from a vector x than a
known distance u only if | |c| - |x| | <= u. So a vector's distance to the centroid next to it in norm bounds its
nearest one, a binary search finds the centroids with norms in [|x| - u, |x| + u], and those alone are compared
exactly, in whole numbers. Bounds are widened by more than the rounding of norms, so that centroids on the
boundary, which may tie, are among them; ties go to the smaller number.

Components are integers floor(scale * x). A round is one pass over the vectors: each task sums its own vectors per
centroid, Spark sums the tasks' rows per centroid and component, and k * dimensions sums reach the driver, however
many vectors there are. Nothing of a round is kept but the centroids, so a lost executor repeats its own tasks only.

Vectors that are null, of another length, or that hold a null or a non-finite component take no part. Scaled
components beyond +-2**27 are held at that bound: squared distances would not fit a long otherwise. Repeated rows
are vectors of their own; a null id is one of them, but never a start. Starts with the same hash are ordered by
their components. With fewer vectors than centroids there are as many centroids as vectors with an id; without
those there are no rows. Other columns are not used, whatever they are called.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trilune.llm.common import table, written

#: Scaled components are held within +- this: 64 squares of differences then stay below 2**63.
MOST = 1 << 27
#: Vectors that a task compares at once.
BLOCK = 2048


def integers(column, dims: int, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """Of an Arrow column of lists: the rows that take part, and their components floor(scale * x)."""
    import pyarrow as pa
    import pyarrow.compute as pc

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    rows = np.flatnonzero(np.asarray(pc.fill_null(pc.equal(pc.list_value_length(column), dims), False)))
    flat = column.take(pa.array(rows)).flatten()
    values = pc.fill_null(flat.cast(pa.float64()), float("nan")).to_numpy(zero_copy_only=False).reshape(len(rows), dims)
    fit = np.isfinite(values).all(axis=1)
    with np.errstate(over="ignore"):
        whole = np.clip(np.floor(values[fit] * scale), -MOST, MOST).astype(np.int64)
    return rows[fit], whole


def norms(vectors: np.ndarray) -> np.ndarray:
    return np.sqrt((vectors.astype(np.float64) ** 2).sum(axis=1))


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    gap = a - b
    return np.einsum("ij,ij->i", gap, gap)


def nearest(vectors: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number and exact squared distance of each vector's nearest centroid."""
    order = np.argsort(norms(centroids), kind="stable")
    by_norm, ring = centroids[order], norms(centroids)[order]
    length = norms(vectors)
    right = np.clip(np.searchsorted(ring, length), 0, len(ring) - 1)
    left = np.maximum(right - 1, 0)
    guess = np.where(np.abs(ring[left] - length) <= np.abs(ring[right] - length), left, right)
    best = squared(vectors, by_norm[guess])
    which = order[guess]
    # Squares above 2**53 and roots are rounded by some parts in 2**52 of the numbers involved.
    bound = np.sqrt(best.astype(np.float64))
    bound += 1e-9 * (bound + length + ring[-1]) + 1e-6
    low, high = np.searchsorted(ring, length - bound, "left"), np.searchsorted(ring, length + bound, "right")
    for at in range(len(ring)):
        rows = np.flatnonzero((low <= at) & (at < high) & (guess != at))
        if not len(rows):
            continue
        found = squared(vectors[rows], by_norm[at])
        nearer = (found < best[rows]) | ((found == best[rows]) & (order[at] < which[rows]))
        rows, found = rows[nearer], found[nearer]
        best[rows], which[rows] = found, order[at]
    return which, best


def assigned_blocks(batch, centroids: np.ndarray, dims: int, scale: int):
    """(rows, vectors, numbers, distances) for block after block of an Arrow batch whose second column holds the vectors."""
    for start in range(0, batch.num_rows, BLOCK):
        rows, whole = integers(batch.column(1).slice(start, BLOCK), dims, scale)
        if len(rows):
            yield rows + start, whole, *nearest(whole, centroids)


def starts(vectors: DataFrame, k: int, dims: int, scale: int, salt: str) -> np.ndarray:
    """The k vectors whose ids hash smallest, in that order; a task hands on its own k at most."""

    def smallest(batches):
        import pyarrow as pa

        best: list[tuple[str, list[int]]] = []
        for batch in batches:
            rows, whole = integers(batch.column(1), dims, scale)
            hashes = batch.column(0).take(pa.array(rows)).to_pylist()
            last = best[-1][0] if len(best) == k else "g"  # after all digits
            best += [(h, x.tolist()) for h, x in zip(hashes, whole, strict=True) if h <= last]
            best = sorted(best)[:k]
        if best:
            yield pa.RecordBatch.from_arrays(
                [pa.array([h for h, _ in best], pa.string()), pa.array([x for _, x in best], pa.list_(pa.int64()))],
                ["h", "whole"],
            )

    hashed = F.sha2(F.concat(F.lit(salt), F.col("id").cast("string")).cast("binary"), 256)
    rows = vectors.where("id is not null").select(hashed.alias("h"), "vector").mapInArrow(smallest, "h string, whole array<bigint>")
    first = rows.orderBy("h", "whole").limit(k).collect()
    return np.array([r.whole for r in first], np.int64).reshape(len(first), dims)


def moved(vectors: DataFrame, centroids: np.ndarray, dims: int, scale: int) -> np.ndarray:
    """Every non-empty centroid as the floor of its vectors' means; empty ones stay."""

    def sums(batches):
        import pyarrow as pa

        total = np.zeros((len(centroids), dims), object)
        count = np.zeros(len(centroids), np.int64)
        for batch in batches:
            for _, whole, which, _ in assigned_blocks(batch, centroids, dims, scale):
                for c in np.unique(which):
                    total[c] += whole[which == c].sum(axis=0)
                count += np.bincount(which, minlength=len(centroids))
        for c in np.flatnonzero(count):
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([int(c)] * dims, pa.int32()),
                    pa.array(range(dims), pa.int32()),
                    pa.array([str(x) for x in total[c]], pa.string()),
                    pa.array([int(count[c])] * dims, pa.int64()),
                ],
                ["c", "at", "total", "count"],
            )

    rows = vectors.mapInArrow(sums, "c int, at int, total string, count bigint")
    whole = rows.groupBy("c", "at").agg(
        F.sum(F.col("total").cast("decimal(38,0)")).alias("total"),
        F.sum("count").alias("count"),
    )
    out = centroids.copy()
    for r in whole.collect():
        out[r.c, r["at"]] = int(r.total) // r["count"]
    return out


def digest(centroid) -> str:
    return hashlib.sha256(",".join(map(str, map(int, centroid))).encode()).hexdigest()


def clustered(
    vectors: DataFrame,
    key: str = "vec_id",
    vector: str = "embedding",
    k: int = 16,
    rounds: int = 3,
    dims: int = 64,
    scale: int = 64,
    salt: str = "1:",
) -> tuple[DataFrame, np.ndarray]:
    """A row per vector that takes part (its id under its own name, cluster, distance), and the final centroids."""
    spark, kind = vectors.sparkSession, vectors.schema[key].dataType.simpleString()
    rows = vectors.select(F.col(key).alias("id"), F.col(vector).alias("vector"))
    centroids = starts(rows, k, dims, scale, salt)
    if not len(centroids):
        return spark.createDataFrame([], f"`{key}` {kind}, cluster int, distance long"), centroids
    for _ in range(rounds):
        centroids = moved(rows, centroids, dims, scale)

    def told(batches):
        import pyarrow as pa

        for batch in batches:
            for at, _, which, far in assigned_blocks(batch, centroids, dims, scale):
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(at)), pa.array(which.astype(np.int32)), pa.array(far)],
                    [key, "cluster", "distance"],
                )

    return rows.mapInArrow(told, f"`{key}` {kind}, cluster int, distance long"), centroids


def query(spark, sf_dir: str) -> DataFrame:
    found, centroids = clustered(table(spark, sf_dir, "embeddings"))
    found = written(spark, found, "clustered")
    sums = {r.cluster: r.s for r in found.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}  # 16 rows at most
    inertia = sum(sums.values())
    facts = [(c, s, inertia, digest(centroids[c])) for c, s in sums.items()]
    schema = "cluster int, cluster_inertia long, inertia long, centroid_sha256 string"
    return found.join(F.broadcast(spark.createDataFrame(facts, schema)), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )


def _sql(rounds: int = 3) -> str:
    """Lloyd's rounds as one query: assignments by exact distances to all centroids, means by floored division."""
    steps = []
    near = """
a{n} AS (
  SELECT r, arg_min(c, (dist, c)) AS c, min(dist) AS dist FROM (
    SELECT x.r, m.c, sum((x.q - m.q) * (x.q - m.q))::BIGINT AS dist FROM x JOIN c{n} m USING (i) GROUP BY x.r, m.c) GROUP BY r
)"""
    for n in range(rounds):
        steps.append(near.format(n=n))
        steps.append(f"""
c{n + 1} AS (
  SELECT c, i, coalesce(t.q, o.q) AS q FROM c{n} o LEFT JOIN (
    SELECT a.c, x.i, floor_div(sum(x.q)::HUGEINT, count(*)::HUGEINT)::BIGINT AS q FROM x JOIN a{n} a USING (r) GROUP BY a.c, x.i) t USING (c, i)
)""")
    steps.append(near.format(n=rounds))
    chain = ",".join(steps).replace("floor_div(sum(x.q)::HUGEINT, count(*)::HUGEINT)", "((sum(x.q)::HUGEINT - ((sum(x.q)::HUGEINT % count(*) + count(*)) % count(*))) // count(*))")
    return f"""
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, embedding FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64
), x AS (
  SELECT r, unnest(range(1, 65)) AS i, greatest(-134217728, least(134217728, floor(64 * unnest(embedding)::DOUBLE)))::BIGINT AS q FROM v
), s AS (
  SELECT r, row_number() OVER (ORDER BY sha256('1:' || vec_id), qs) - 1 AS c
  FROM v JOIN (SELECT r, list(q ORDER BY i) AS qs FROM x GROUP BY r) USING (r) WHERE vec_id IS NOT NULL
), c0 AS (SELECT s.c, x.i, x.q FROM s JOIN x USING (r) WHERE s.c < 16),{chain}
SELECT v.vec_id, a.c::INTEGER AS cluster, a.dist AS distance,
  (sum(a.dist) OVER (PARTITION BY a.c))::BIGINT AS cluster_inertia, (sum(a.dist) OVER ())::BIGINT AS inertia, h.centroid_sha256
FROM v JOIN a{rounds} a USING (r) JOIN (SELECT c, sha256(string_agg(q::VARCHAR, ',' ORDER BY i)) AS centroid_sha256 FROM c{rounds} GROUP BY c) h ON h.c = a.c
"""


SQL = _sql()
