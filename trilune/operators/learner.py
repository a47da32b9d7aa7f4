"""Learner analytics as aggregates of an append-only log: learner, concept, success (0/1), ts, ord."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Difficulty and minutes per entity type, and those of any other.
DIFFICULTY = {"Word": 0.3, "Grammar": 0.6, "Pragmatics": 0.7, "Culture": 0.5, "Topic": 0.4}
MINUTES = {"Word": 10, "Grammar": 30, "Pragmatics": 25, "Culture": 20, "Topic": 15, "Exercise": 15, "Task": 45}
# Presets of (accuracy weight, coverage weight).
MASTERY = {"code_default": (0.6, 0.4), "yaml_default": (0.7, 0.3)}


def lookup(values: dict, key: Column, other) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), key), F.lit(other))


def concept_stats(log: DataFrame) -> DataFrame:
    """attempts, successes and last success per learner and concept."""
    return log.groupBy("learner", "concept").agg(
        F.count(F.lit(1)).alias("attempts"),
        F.sum("success").cast("long").alias("successes"),
        F.max(F.when(F.col("success") == 1, F.col("ts"))).alias("last_success"),
    )


def recent_accuracy(log: DataFrame, k: int, *by: str) -> DataFrame:
    """Share of successes among the newest k rows per key."""
    n = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("ts"), F.desc("ord")))
    return (
        log.withColumn("_n", n)
        .where(F.col("_n") <= k)
        .groupBy(*by)
        .agg(F.avg("success").alias("accuracy"), F.count(F.lit(1)).alias("n"))
    )


def forgetting(last: Column, as_of: Column, rate: float = 0.05) -> Column:
    """exp(-rate * days since the last success); 1 without one, and for one in the future."""
    days = (F.unix_micros(as_of) - F.unix_micros(last)) / F.lit(8.64e10)
    return F.coalesce(F.exp(-F.lit(rate) * F.greatest(F.lit(0.0), days)), F.lit(1.0))


def mastery_practice() -> Column:
    """0.7 accuracy and 0.3 practice up to three attempts; 0 without any."""
    a = F.col("attempts")
    return F.when(a > 0, 0.7 * F.col("successes") / a + 0.3 * F.least(a / 3, F.lit(1.0))).otherwise(0.0)


def coverage(stats: DataFrame, prerequisites: DataFrame, threshold: float = 0.7) -> DataFrame:
    """Share of a concept's prerequisites (concept, needs) mastered by practice, per learner and concept of stats; 1 without any."""
    done = stats.where(mastery_practice() >= threshold).select(
        "learner",
        F.col("concept").alias("needs"),
        F.lit(1).alias("ok"),
    )
    x = (
        stats.select("learner", "concept")
        .join(prerequisites, "concept", "left")
        .join(done, ["learner", "needs"], "left")
    )
    return x.groupBy("learner", "concept").agg(
        (
            F.when(F.count("needs") == 0, 1.0)
            .otherwise(F.sum(F.coalesce("ok", F.lit(0))) / F.count("needs"))
            .alias("coverage")
        ),
    )


def mastery(
    stats: DataFrame,
    prerequisites: DataFrame,
    as_of: Column,
    preset: str = "code_default",
    rate: float = 0.05,
) -> DataFrame:
    a, b = MASTERY[preset]
    x = stats.join(coverage(stats, prerequisites), ["learner", "concept"])
    acc = F.coalesce(F.try_divide("successes", "attempts"), F.lit(0.0))
    raw = F.greatest(F.lit(0.0), F.least(F.lit(1.0), a * acc + b * F.col("coverage")))
    return x.withColumn("mastery", raw * forgetting(F.col("last_success"), as_of, rate))


def adjusted_difficulty(accuracy: Column) -> Column:
    return F.least(F.lit(0.9), F.greatest(F.lit(0.2), 0.5 + 0.8 * (accuracy - 0.5)))


def feedback(correct: Column, level: Column, threshold: float = 0.7) -> Column:
    return (
        F.when(correct == 0, "review the evidence and try again")
        .when(level > threshold, "mastered: go on to the next concept")
        .otherwise("correct: practise once more")
    )


def learning_path(
    concepts: DataFrame,
    levels: DataFrame,
    mastered: DataFrame,
    most: int,
    learners: DataFrame | None = None,
) -> DataFrame:
    """Per learner: concepts not mastered, in order of prerequisite level then id, with difficulty and minutes. mastered: learner, id; learners come from it unless given."""
    learners = (mastered if learners is None else learners).select("learner").distinct()
    order = concepts.join(levels, "id").withColumn("place", F.row_number().over(Window.orderBy("level", "id")))  # the graph's concepts
    # Among the first `most` and as many more as a learner has mastered, there are `most` that are open: no learner meets all concepts.
    known = (
        mastered.join(order.select("id"), "id", "left_semi")
        .distinct()
        .groupBy("learner")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    reach = learners.join(known, "learner", "left").select(
        "learner",
        F.explode(F.sequence(F.lit(1), F.coalesce("n", F.lit(0)).cast("int") + most)).alias("place"),
    )
    todo = reach.join(order, "place").join(mastered, ["learner", "id"], "left_anti")
    todo = todo.withColumn("step", F.row_number().over(Window.partitionBy("learner").orderBy("level", "id"))).where(
        F.col("step") <= most,
    )
    return todo.select(
        "learner",
        "step",
        "id",
        lookup(DIFFICULTY, F.col("type"), 0.5).alias("difficulty"),
        lookup(MINUTES, F.col("type"), 20).cast("long").alias("minutes"),
    )
