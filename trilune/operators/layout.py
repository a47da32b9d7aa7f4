"""Places for the nodes of a network in the plane: a spring layout in rounds.

Edges pull with d**2 / k, nodes push each other with k**2 / d, where k is the length that suits the area. A node is pushed by what lies in
its own and the eight neighbouring cells of a grid of width 2 k; of a cell it sees the number of nodes and their centre, so a round
is a join of nodes with cells, whatever the number of nodes in one. No step is longer than the round's heat, which falls to nothing. Each
round is a table. Starts are hashes of ids; places are rounded to 1e-9, so that results do not depend on partitions.

Repeated edges, loops and directions do not count; ends that are no nodes are left out. A node alone stays where its cell pushes it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trilune.operators.align import undirected
from trilune.sources.tables import stored


def start(key: str, axis: str):
    """A number from -1 to 1 by the id."""
    return F.pmod(F.xxhash64(F.lit(axis), F.col(key).cast("string")), F.lit(2_000_001)) / F.lit(1_000_000.0) - 1


def spring(nodes: DataFrame, edges: DataFrame, rounds: int = 30, area: float = 4.0) -> DataFrame:
    """(id, x, y) of the nodes (id) with the edges (src, dst)."""
    ids = nodes.select("id").where("id is not null").distinct()
    place = stored(ids.select("id", F.round(start("id", "x"), 9).alias("x"), F.round(start("id", "y"), 9).alias("y")), "places")
    n = place.count()
    if not n:
        return place
    k = (area / n) ** 0.5
    width, least = 2 * k, 1e-6
    known = ids.select(F.col("id").alias("_id"))
    both = undirected(edges)
    both = stored(both.join(known, F.col("src") == F.col("_id"), "left_semi").join(known, F.col("dst") == F.col("_id"), "left_semi"), "edges")
    cell = lambda c: F.floor(F.col(c) / width)
    for turn in range(rounds):
        heat = 0.2 * area**0.5 * (1 - turn / rounds)
        here = place.withColumns({"cx": cell("x"), "cy": cell("y")})
        cells = here.groupBy("cx", "cy").agg(F.count("*").alias("n"), F.sum("x").alias("sx"), F.sum("y").alias("sy"))
        around = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
        seen = here.withColumn("_c", around).select("id", "x", "y", F.col("_c.i").alias("i"), F.col("_c.j").alias("j"), (F.col("cx") + F.col("_c.i")).alias("cx"), (F.col("cy") + F.col("_c.j")).alias("cy"))
        own = (F.col("i") == 0) & (F.col("j") == 0)
        other = F.col("n") - own.cast("int")
        met = seen.join(cells, ["cx", "cy"]).where(other > 0)
        gap = {c: F.col(c) - (F.col(f"s{c}") - F.when(own, F.col(c)).otherwise(0.0)) / other for c in "xy"}
        far = F.greatest(F.sqrt(gap["x"] * gap["x"] + gap["y"] * gap["y"]), F.lit(least))
        push = met.groupBy("id").agg(*[F.sum(gap[c] / far * other * k * k / far).alias(f"p{c}") for c in "xy"])
        end = place.select(F.col("id").alias("dst"), F.col("x").alias("x2"), F.col("y").alias("y2"))
        joined = both.join(place.withColumnRenamed("id", "src"), "src").join(end, "dst")
        dx, dy = F.col("x2") - F.col("x"), F.col("y2") - F.col("y")
        long = F.sqrt(dx * dx + dy * dy)
        pull = joined.groupBy(F.col("src").alias("id")).agg(F.sum(dx * long / k).alias("ax"), F.sum(dy * long / k).alias("ay"))
        moved = place.join(push, "id", "left").join(pull, "id", "left").fillna(0.0, ["px", "py", "ax", "ay"])
        fx, fy = F.round(F.col("px") + F.col("ax"), 9), F.round(F.col("py") + F.col("ay"), 9)
        size = F.greatest(F.sqrt(fx * fx + fy * fy), F.lit(least))
        step = F.least(size, F.lit(heat)) / size
        place = stored(moved.select("id", F.round(F.col("x") + fx * step, 9).alias("x"), F.round(F.col("y") + fy * step, 9).alias("y")), "places")
    return place
