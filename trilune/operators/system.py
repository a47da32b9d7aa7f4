"""Search systems side by side: metrics per query, tests of their differences, statistics of what they are made of, run files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trilune.functions.statistics import student_t_p
from trilune.operators import graph as G
from trilune.operators.metrics import METRICS, ranking_metrics


def per_query(run: DataFrame, qrels: DataFrame, queries: DataFrame, specifications: list[str]) -> DataFrame:
    """(query_id, metric, value) of metrics such as ndcg@10; queries without results or judgments have 0."""
    out = None
    for spec in specifications:
        name, _, k = spec.lower().partition("@")
        if name not in METRICS or not (k.isdigit() or not k):
            raise ValueError(f"unknown metric: {spec}")
        found = ranking_metrics(run, qrels, int(k) if k else 1000).select("query_id", F.col(METRICS[name]).cast("double").alias("value"))
        rows = queries.select("query_id").distinct().join(found, "query_id", "left").fillna(0.0, ["value"])
        rows = rows.select("query_id", F.lit(spec).alias("metric"), "value")
        out = rows if out is None else out.unionByName(rows)
    return out


def poisson(uniform):
    """How often a resample takes a row, from a number in [0, 1)."""
    out, below, term = F.lit(0), 0.0, 0.36787944117144233
    for n in range(1, 12):
        below += term
        out = F.when(uniform >= below, n).otherwise(out)
        term /= n
    return out


def resampled(differences: DataFrame, by: list[str], rounds: int = 1000, alpha: float = 0.05) -> DataFrame:
    """(by, low, high): interval of the mean difference over resamples.

    In each round a query counts as often as a Poisson draw says, hashed from its id and the round: rounds are sums, whatever the number of queries.
    """
    drawn = differences.withColumn("round", F.explode(F.sequence(F.lit(1), F.lit(rounds))))
    uniform = F.pmod(F.xxhash64(F.lit("resample"), F.col("query_id").cast("string"), "round"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    drawn = drawn.withColumn("times", poisson(uniform))
    means = drawn.groupBy(*by, "round").agg(F.try_divide(F.sum(F.col("difference") * F.col("times")), F.sum("times")).alias("mean"))
    return means.groupBy(*by).agg(
        F.percentile("mean", F.lit(alpha / 2)).alias("low"),
        F.percentile("mean", F.lit(1 - alpha / 2)).alias("high"),
    )


def compared(values: dict[str, DataFrame], base: str) -> DataFrame:
    """(system, metric, value, difference, t, effect, p, low, high): each system's means, and how much the base exceeds it, query by query.

    values: per system (query_id, metric, value), all over the same queries. The base itself has a difference of 0 and a p of 1.
    """
    both = None
    own = values[base].select("query_id", "metric", F.col("value").alias("_base"))
    for name, rows in values.items():
        x = rows.join(own, ["query_id", "metric"]).withColumn("system", F.lit(name))
        both = x if both is None else both.unionByName(x)
    both = both.withColumn("difference", F.col("_base") - F.col("value"))
    by = ["system", "metric"]
    pooled = F.sqrt((F.var_samp("_base") + F.var_samp("value")) / 2)
    sums = both.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.avg("value").alias("value"),
        F.avg("difference").alias("mean"),
        F.stddev_samp("difference").alias("sd"),
        F.coalesce(F.try_divide(F.avg("difference"), pooled), F.lit(0.0)).alias("effect"),
    )
    rows = sums.join(resampled(both, by), by).collect()  # systems x metrics
    out = []
    for r in sorted(rows):
        t = r["mean"] / (r.sd / r.n**0.5) if r.sd else 0.0
        p = student_t_p(t, r.n - 1) if r.n > 1 else 1.0
        out.append((r.system, r.metric, r.value, r["mean"], t, r.effect, p, r.low, r.high))
    schema = "system string, metric string, value double, difference double, t double, effect double, p double, low double, high double"
    return sums.sparkSession.createDataFrame(out, schema)


def expander_statistics(entities: DataFrame, relations: DataFrame, hops: int, decay: float, weights: dict[str, float] | None = None) -> DataFrame:
    """(part, name, value) of a graph expander."""
    weights = G.RELATION_WEIGHTS if weights is None else weights
    spark = entities.sparkSession
    fixed = [("expander", "max_hops", float(hops)), ("expander", "decay_factor", float(decay))]
    fixed += [("expander", f"weight {k}", float(v)) for k, v in weights.items()]
    size = lambda df, name: df.agg(F.lit("expander").alias("part"), F.lit(name).alias("name"), F.count("*").cast("double").alias("value"))
    told = spark.createDataFrame(fixed, "part string, name string, value double")
    return told.unionByName(size(entities, "num_entities")).unionByName(size(relations, "num_relations"))


def system_statistics(weights: dict[str, float], normalize: bool, parts: dict[str, DataFrame], expander: DataFrame) -> DataFrame:
    """(part, name, value) of a whole system; parts: one-row tables of numbers by part."""
    spark = expander.sparkSession
    fixed = [("weights", k, float(v)) for k, v in weights.items()] + [("system", "normalize_scores", float(normalize))]
    out = spark.createDataFrame(fixed, "part string, name string, value double").unionByName(expander)
    for part, row in parts.items():
        named = F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("value")) for c in row.columns])
        out = out.unionByName(row.select(F.lit(part).alias("part"), F.explode(named).alias("x")).select("part", "x.*"))
    return out


def write_run(run: DataFrame, queries: DataFrame, path: str) -> None:
    """A run (query_id, rank, doc_id, score) as JSON lines of {query_id, query, results}, queries without results included."""
    best = F.array_sort(F.collect_list(F.struct("rank", F.col("doc_id").cast("string").alias("doc_id"), F.col("score").cast("double").alias("score"))))
    lists = run.groupBy("query_id").agg(F.transform(best, lambda x: F.struct(x["doc_id"].alias("doc_id"), x["score"].alias("score"))).alias("results"))
    asked = queries.select("query_id", F.col("query_text").alias("query"))
    rows = asked.join(lists, "query_id", "left")
    empty = F.array().cast("array<struct<doc_id:string,score:double>>")
    rows.select(F.col("query_id").cast("string").alias("query_id"), "query", F.coalesce("results", empty).alias("results")).write.mode("overwrite").json(path)


def write_expanded(expanded: DataFrame, queries: DataFrame, path: str) -> None:
    """Queries and their expansion terms (query_id, name, weight, rank) as JSON lines of {query_id, query, terms}."""
    best = F.array_sort(F.collect_list(F.struct("rank", "name", "weight")))
    lists = expanded.groupBy("query_id").agg(F.transform(best, lambda x: F.struct(x["name"].alias("name"), x["weight"].alias("weight"))).alias("terms"))
    rows = queries.select("query_id", F.col("query_text").alias("query")).join(lists, "query_id", "left")
    rows.write.mode("overwrite").json(path)


def read_expanded(spark, path: str) -> DataFrame:
    """(query_id, name, weight, rank)"""
    df = spark.read.schema("query_id long, query string, terms array<struct<name: string, weight: double>>").json(path)
    return df.select("query_id", F.posexplode("terms").alias("i", "t")).select("query_id", "t.name", "t.weight", (F.col("i") + 1).alias("rank"))
