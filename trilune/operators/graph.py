"""Traversals as frontier loops; each hop is a table, so lineage does not grow."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trilune.sources.tables import stored

# Weights of relation types, and that of any other.
RELATION_WEIGHTS = {
    "sameAs": 1.0,
    "translatedAs": 0.9,
    "belongsTo": 0.7,
    "supports": 0.6,
    "covers": 0.6,
    "hasPrereq": 0.5,
    "tests": 0.4,
}
OTHER_WEIGHT = 0.3


def rounds(most: int | None) -> Iterator[int]:
    """Numbers of the rounds of a loop that ends when nothing changes; one that needs more than `most` fails."""
    for n in count():
        if n == most:
            raise RuntimeError(f"not settled after {most} rounds")
        yield n


def relation_weight(rel, weights: dict[str, float] | None = None):
    weights = RELATION_WEIGHTS if weights is None else weights
    return F.coalesce(
        F.element_at(F.create_map(*[F.lit(x) for kv in weights.items() for x in kv]), rel),
        F.lit(OTHER_WEIGHT),
    )


def undirected(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").union(edges.select("dst", "src")).distinct()


def neighbours(sources: DataFrame, edges: DataFrame, hops: int = 1, rel: str | None = None) -> DataFrame:
    """(source, id, hop): nodes reached over out-edges in at most `hops`, at their first hop, the source excluded."""
    e = (edges if rel is None else edges.where(F.col("rel") == rel)).select("src", "dst").distinct()
    seen = sources.select(F.col("id").alias("source"), "id").distinct().withColumn("hop", F.lit(0))
    front = seen
    for hop in range(1, hops + 1):
        reached = (
            front.join(e, front["id"] == e["src"])
            .select("source", F.col("dst").alias("id"))
            .distinct()
            .join(seen, ["source", "id"], "left_anti")
        )
        front = stored(reached.withColumn("hop", F.lit(hop)), "front")
        seen = stored(seen.unionByName(front), "seen")
    return seen.where("hop > 0")


def related(
    sources: DataFrame,
    edges: DataFrame,
    hops: int = 2,
    decay: float = 0.8,
    weights: dict[str, float] | None = None,
) -> DataFrame:
    """(source, id, weight, hop): a child's weight is its parent's times relation weight, confidence and decay**hop.

    Where several ways lead to a node, that of the first dequeued parent counts, then
    of the first edge, as in a breadth-first queue.
    """
    e = edges.withColumn("_w", relation_weight(F.col("rel"), weights) * F.col("confidence")).select(
        "src",
        "dst",
        "_w",
        F.col("ord").alias("_ord"),
    )
    seen = (
        sources.select(F.col("id").alias("source"), "id")
        .distinct()
        .withColumn("weight", F.lit(1.0))
        .withColumn("hop", F.lit(0))
        .withColumn("place", F.lit(0).cast("long"))
    )
    front = seen
    for hop in range(1, hops + 1):
        found = (
            front.join(e, front["id"] == e["src"])
            .select(
                "source",
                F.col("dst").alias("id"),
                (F.col("weight") * F.col("_w") * F.lit(decay**hop)).alias("weight"),
                "place",
                "_ord",
            )
            .join(seen.select("source", "id"), ["source", "id"], "left_anti")
        )
        first = F.row_number().over(Window.partitionBy("source", "id").orderBy("place", "_ord"))
        found = found.withColumn("_n", first).where("_n = 1")
        place = F.row_number().over(Window.partitionBy("source").orderBy("place", "_ord")).cast("long")
        front = stored(
            (
                found.withColumn("place", place)
                .withColumn("hop", F.lit(hop))
                .select("source", "id", "weight", "hop", "place")
            ),
            "front",
        )
        seen = stored(seen.unionByName(front), "seen")
    return seen.where("hop > 0").select("source", "id", "weight", "hop")


def shortest_paths(pairs: DataFrame, edges: DataFrame, most: int = 3) -> DataFrame:
    """(src, dst, length, path) of a shortest directed path up to `most` edges; of several, the first by edge order. Path: names joined by relations."""
    e = edges.select(F.col("src").alias("_at"), F.col("dst").alias("_to"), "rel", F.col("ord").alias("_ord"))
    wanted = pairs.select("src", "dst").distinct()
    same = wanted.where("src = dst").select(
        "src",
        "dst",
        F.lit(0).alias("length"),
        F.concat("src", F.lit(" -(self)")).alias("path"),
    )
    front = (
        wanted.where("src <> dst")
        .select("src")
        .distinct()
        .select("src", F.col("src").alias("at"), F.col("src").alias("path"), F.lit(0).cast("long").alias("place"))
    )
    seen = front.select("src", "at")
    found = same
    for hop in range(1, most + 1):
        step = (
            front.join(e, front["at"] == e["_at"])
            .select(
                "src",
                F.col("_to").alias("at"),
                F.concat("path", F.lit(" -("), "rel", F.lit(")-> "), "_to").alias("path"),
                "place",
                "_ord",
            )
            .join(seen, ["src", "at"], "left_anti")
        )
        step = step.withColumn("_n", F.row_number().over(Window.partitionBy("src", "at").orderBy("place", "_ord"))).where(
            "_n = 1",
        )
        front = stored(
            step.select(
                "src",
                "at",
                "path",
                F.row_number().over(Window.partitionBy("src").orderBy("place", "_ord")).cast("long").alias("place"),
            ),
            "front",
        )
        seen = stored(seen.unionByName(front.select("src", "at")), "seen")
        found = found.unionByName(
            front.join(wanted, (front["src"] == wanted["src"]) & (front["at"] == wanted["dst"])).select(
                front["src"],
                F.col("at").alias("dst"),
                F.lit(hop).alias("length"),
                "path",
            ),
        )
    return found


def components(nodes: DataFrame, edges: DataFrame, most: int | None = None) -> DataFrame:
    """(id, component): the smallest id that undirected edges connect. Labels pass to neighbours and jump to their labels' labels."""
    both = stored(undirected(edges).where("src <> dst"), "both")
    label = stored(nodes.select("id").distinct().withColumn("component", F.col("id")), "label")
    for _ in rounds(most):
        near = both.join(label, both["dst"] == label["id"]).groupBy("src").agg(F.min("component").alias("near"))
        new = label.join(near, label["id"] == near["src"], "left").select(
            "id",
            F.least("component", "near").alias("component"),
        )
        jump = new.select(F.col("id").alias("component"), F.col("component").alias("next"))
        new = stored(
            new.join(jump, "component", "left").select("id", F.coalesce("next", "component").alias("component")),
            "label",
        )
        changed = not new.exceptAll(label).isEmpty()
        label = new
        if not changed:
            break
    return label


def strong_components(nodes: DataFrame, edges: DataFrame, most: int | None = None) -> DataFrame:
    """(id, component): nodes on common cycles. The largest label spreads forward; who is reached backward from its owner, within its label, is one component."""
    rest = stored(nodes.select("id").where("id is not null").distinct(), "rest")
    e = stored(edges.select("src", "dst").distinct(), "edges")
    done = rest.limit(0).withColumn("component", F.col("id"))
    if rest.isEmpty():
        return done
    for _ in rounds(most):
        inner = stored(
            e.join(rest, e["src"] == rest["id"], "left_semi").join(rest, F.col("dst") == rest["id"], "left_semi"),
            "inner",
        )
        color = stored(rest.withColumn("c", F.col("id")), "color")
        while True:
            got = inner.join(color, inner["src"] == color["id"]).groupBy("dst").agg(F.max("c").alias("m"))
            new = stored(
                color.join(got, color["id"] == got["dst"], "left").select("id", F.greatest("c", "m").alias("c")),
                "color",
            )
            same = new.exceptAll(color).isEmpty()
            color = new
            if same:
                break
        named = (
            inner.join(color.select(F.col("id").alias("src"), F.col("c").alias("cs")), "src")
            .join(color.select(F.col("id").alias("dst"), F.col("c").alias("cd")), "dst")
            .where("cs = cd")
        )
        named = stored(named.select("src", "dst"), "named")
        back = stored(color.where("id = c"), "back")
        front = back
        while True:
            front = stored(
                (
                    front.join(named, front["id"] == named["dst"])
                    .select(F.col("src").alias("id"), "c")
                    .distinct()
                    .join(back, ["id"], "left_anti")
                ),
                "front",
            )
            if front.isEmpty():
                break
            back = stored(back.unionByName(front), "back")
        done = stored(done.unionByName(back.select("id", F.col("c").alias("component"))), "done")
        rest = stored(rest.join(back, "id", "left_anti"), "rest")
        if rest.isEmpty():
            break
    return done


def topological_levels(edges: DataFrame, most: int | None = None) -> DataFrame:
    """(id, level) of nodes with edges src -> prerequisite dst: the longest chain below; nodes on or behind cycles are left out."""
    e = stored(edges.select("src", "dst").where("src <> dst").distinct(), "prereq")
    nodes = e.select(F.col("src").alias("id")).union(e.select("dst")).distinct()
    done = stored(nodes.join(e, nodes["id"] == e["src"], "left_anti").withColumn("level", F.lit(0)), "level")
    for _ in rounds(most):
        ready = (
            e.join(done, e["dst"] == done["id"], "left")
            .groupBy("src")
            .agg(F.max("level").alias("m"), F.count(F.lit(1)).alias("n"), F.count("level").alias("k"))
            .where("n = k")
        )
        new = stored(
            ready.select(F.col("src").alias("id"), (F.col("m") + 1).alias("level")).join(done, "id", "left_anti"),
            "level",
        )
        if new.isEmpty():
            break
        done = stored(done.unionByName(new), "level")
    return done


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    ends = (
        edges.select(F.col("src").alias("id"))
        .union(edges.select("dst"))
        .groupBy("id")
        .agg(F.count(F.lit(1)).alias("degree"))
    )
    return nodes.select("id").join(ends, "id", "left").fillna(0, ["degree"])


def induced(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges with both ends among the nodes."""
    ids = nodes.select("id").distinct()
    return edges.join(ids, edges["src"] == ids["id"], "left_semi").join(ids, F.col("dst") == ids["id"], "left_semi")
