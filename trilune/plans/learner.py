"""Queries of learner analytics: users are learners, event types concepts, values above a fixed mark successes."""

from __future__ import annotations

from pyspark.sql import functions as F

from trilune.functions import statistics as S
from trilune.operators import graph as G
from trilune.operators import learner as L
from trilune.plans.lexicon import SQL as LEX
from trilune.plans.lexicon import graph
from trilune.sources.tables import stored, table

MARK, AS_OF = 60.0, "2024-02-01 00:00:00"


def log(spark, d):
    e = table(spark, d, "events")
    return e.select(
        F.col("user_id").alias("learner"),
        F.col("event_type").alias("concept"),
        (F.col("value") >= MARK).cast("int").alias("success"),
        "ts",
        F.col("event_id").alias("ord"),
        "value",
    )


def prerequisites(spark, d):
    """Each event type needs the one before it in the alphabet."""
    t = table(spark, d, "events").select(F.col("event_type").alias("concept")).distinct()
    return (
        t.alias("a")
        .join(t.alias("b"), F.col("b.concept") < F.col("a.concept"))
        .groupBy(F.col("a.concept").alias("concept"))
        .agg(F.max("b.concept").alias("needs"))
    )


def as_of():
    return F.lit(AS_OF).cast("timestamp")


def concept_stats(spark, d):
    x = L.concept_stats(log(spark, d))
    return x.select(
        "learner",
        "concept",
        "attempts",
        "successes",
        F.coalesce(F.unix_micros("last_success"), F.lit(-1)).alias("last_success"),
        F.round(F.try_divide("successes", "attempts"), 6).alias("accuracy"),
    )


def recent_accuracy(spark, d):
    return L.recent_accuracy(log(spark, d), 10, "learner", "concept").withColumn("accuracy", F.round("accuracy", 6))


def overall_accuracy(spark, d):
    return L.recent_accuracy(log(spark, d), 50, "learner").withColumn("accuracy", F.round("accuracy", 6))


def forgetting(spark, d):
    return L.concept_stats(log(spark, d)).select(
        "learner",
        "concept",
        F.round(L.forgetting(F.col("last_success"), as_of()), 6).alias("factor"),
    )


def mastery_practice(spark, d):
    return L.concept_stats(log(spark, d)).select(
        "learner",
        "concept",
        F.round(L.mastery_practice(), 6).alias("mastery"),
        (F.round(L.mastery_practice(), 9) >= 0.7).alias("mastered"),
    )


def mastery_coverage(spark, d):
    x = L.mastery(stored(L.concept_stats(log(spark, d)), "stats"), prerequisites(spark, d), as_of())
    return x.select(
        "learner",
        "concept",
        F.round("coverage", 6).alias("coverage"),
        F.round("mastery", 6).alias("mastery"),
    )


def mastery_coverage_yaml(spark, d):
    x = L.mastery(
        stored(L.concept_stats(log(spark, d)), "stats"),
        prerequisites(spark, d),
        as_of(),
        "yaml_default",
        1 / 30,
    )
    return x.select("learner", "concept", F.round("mastery", 6).alias("mastery"))


def adjust_difficulty(spark, d):
    return L.recent_accuracy(log(spark, d), 10, "learner", "concept").select(
        "learner",
        "concept",
        F.round(L.adjusted_difficulty(F.col("accuracy")), 6).alias("difficulty"),
    )


def feedback(spark, d):
    l = log(spark, d)
    x = l.join(L.concept_stats(l).withColumn("level", F.round(L.mastery_practice(), 9)), ["learner", "concept"])
    return x.groupBy("concept", L.feedback(F.col("success"), F.col("level")).alias("message")).agg(
        F.count(F.lit(1)).alias("n"),
    )


def learning_path(spark, d):
    """English words in order of prerequisites; a learner has mastered those whose rank is below its number of successful concepts."""
    e, r = graph(spark, d)
    e = e.where("language = 'en'")
    done = L.concept_stats(log(spark, d)).where("successes > 0").groupBy("learner").agg(F.count(F.lit(1)).alias("k"))
    mastered = done.join(e.select("id", "r"), F.col("r") < F.col("k")).select("learner", "id")
    return L.learning_path(
        e,
        stored(G.topological_levels(r.where("rel = 'hasPrereq'")), "levels"),
        stored(mastered, "mastered"),
        10,
    )


def describe_values(spark, d):
    x = S.describe(log(spark, d), "value", "concept")
    return x.select("concept", "count", *[F.round(c, 4).alias(c) for c in x.columns[2:]])


def distribution(spark, d):
    return log(spark, d).groupBy("concept").agg(F.count(F.lit(1)).alias("n"))


def learning_curve(spark, d):
    return (
        log(spark, d)
        .groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day"))
        .agg(F.round(F.avg("value"), 6).alias("mean"))
    )


def groups(spark, d):
    """Per half of the month and concept: values before and after, their paired t per learner, and effect size."""
    l = log(spark, d)
    mid = F.lit("2024-01-16 00:00:00").cast("timestamp")
    per = (
        l.groupBy("learner", "concept")
        .agg(
            F.avg(F.when(F.col("ts") < mid, F.col("value"))).alias("pre"),
            F.avg(F.when(F.col("ts") >= mid, F.col("value"))).alias("post"),
        )
        .where("pre is not null and post is not null")
    )
    n = F.count(F.lit(1))
    return per.groupBy("concept").agg(
        n.alias("n"),
        F.round(F.avg("pre"), 6).alias("pre_mean"),
        F.round(F.avg("post"), 6).alias("post_mean"),
        F.round(S.paired_t(F.col("post") - F.col("pre")), 6).alias("t"),
        F.round(S.cohen_d(n, F.avg("post"), F.stddev_samp("post"), n, F.avg("pre"), F.stddev_samp("pre")), 6).alias(
            "d",
        ),
    )


def welch(spark, d):
    """Welch's t between each pair of concepts."""
    x = (
        log(spark, d)
        .groupBy("concept")
        .agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("m"), F.stddev_samp("value").alias("s"))
    )
    y = x.select(*[F.col(c).alias(c + "2") for c in x.columns])
    t, df = S.welch_t(F.col("n"), F.col("m"), F.col("s"), F.col("n2"), F.col("m2"), F.col("s2"))
    return x.join(y, F.col("concept") < F.col("concept2")).select(
        "concept",
        "concept2",
        F.round(t, 6).alias("t"),
        F.round(df, 4).alias("df"),
    )


def run_monitor(spark, d):
    """Events as a log of executions: the newest 100 of the last 24 hours before the end, failures and times."""
    e = table(spark, d, "events")
    end = e.agg(F.max("ts").alias("now"))
    last = (
        e.orderBy(F.desc("ts"), F.desc("event_id"))
        .limit(100)
        .join(F.broadcast(end))
        .where(F.col("ts") >= F.col("now") - F.expr("INTERVAL 24 HOURS"))
    )
    x = last.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("event_type") == "error").alias("failed"),
        F.round(F.avg("value"), 2).alias("avg_time"),
    )
    rate = F.round(F.coalesce(F.try_divide("failed", "total"), F.lit(0.0)), 3)
    return x.select(
        "total",
        "failed",
        rate.alias("failure_rate"),
        "avg_time",
        (rate > 0.3).alias("alert_failures"),
        (F.col("avg_time") > 3600).alias("alert_time"),
    )


QUERIES = {
    "concept_stats": concept_stats,
    "recent_accuracy": recent_accuracy,
    "overall_accuracy": overall_accuracy,
    "forgetting": forgetting,
    "mastery_practice": mastery_practice,
    "mastery_coverage": mastery_coverage,
    "mastery_coverage_yaml": mastery_coverage_yaml,
    "adjust_difficulty": adjust_difficulty,
    "feedback": feedback,
    "learning_path": learning_path,
    "describe_values": describe_values,
    "count_distribution": distribution,
    "learning_curve": learning_curve,
    "group_evaluation": groups,
    "welch_t": welch,
    "run_monitor": run_monitor,
}

_LOG = (
    f"lg AS (SELECT user_id AS learner, event_type AS concept, (value >= {MARK})::INT AS success, ts, event_id AS ord,"
    f" value FROM events), cs AS (SELECT learner, concept, count(*) AS attempts, sum(success)::BIGINT AS successes,"
    f" max(CASE WHEN success = 1 THEN ts END) AS last FROM lg GROUP BY ALL),"
    f" ty AS (SELECT DISTINCT event_type AS concept FROM events), pq AS (SELECT a.concept, max(b.concept) AS needs"
    f" FROM ty a JOIN ty b ON b.concept < a.concept GROUP BY a.concept)"
)
_PRACTICE = "(0.7::DOUBLE * successes / attempts + 0.3::DOUBLE * least(attempts / 3::DOUBLE, 1.0))"
_FORGET = (
    "coalesce(exp(-{0}::DOUBLE * greatest(0.0::DOUBLE, (epoch_us(TIMESTAMP '"
    + AS_OF
    + "') - epoch_us(last)) / 86400000000.0::DOUBLE)), 1.0)"
)
_COVER = (
    f"dn AS (SELECT learner, concept FROM cs WHERE {_PRACTICE} >= 0.7), cv AS (SELECT cs.*, CASE"
    f" WHEN pq.needs IS NULL THEN 1.0::DOUBLE ELSE (dn.concept IS NOT NULL)::INT::DOUBLE END AS coverage FROM cs LEFT"
    f" JOIN pq ON pq.concept = cs.concept LEFT JOIN dn ON dn.learner = cs.learner AND dn.concept = pq.needs)"
)
_RECENT = (
    "SELECT {0}, avg(success) AS accuracy, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY {0}"
    " ORDER BY ts DESC, ord DESC) AS k FROM lg) WHERE k <= {1} GROUP BY {0}"
)

SQL = {
    "concept_stats": (
        f"WITH {_LOG} SELECT learner, concept, attempts, successes, coalesce(epoch_us(last), -1) AS last_success,"
        f" round(successes::DOUBLE / attempts, 6) AS accuracy FROM cs"
    ),
    "recent_accuracy": (
        f"WITH {_LOG}, r AS ({_RECENT.format('learner, concept', 10)})"
        f" SELECT learner, concept, round(accuracy, 6) AS accuracy, n FROM r"
    ),
    "overall_accuracy": f"WITH {_LOG}, r AS ({_RECENT.format('learner', 50)}) SELECT learner, round(accuracy, 6) AS accuracy, n FROM r",
    "forgetting": f"WITH {_LOG} SELECT learner, concept, round({_FORGET.format(0.05)}, 6) AS factor FROM cs",
    "mastery_practice": (
        f"WITH {_LOG} SELECT learner, concept, round({_PRACTICE}, 6) AS mastery, round({_PRACTICE},"
        f" 9) >= 0.7 AS mastered FROM cs"
    ),
    "mastery_coverage": (
        f"WITH {_LOG}, {_COVER} SELECT learner, concept, round(coverage, 6) AS coverage, round(least(1.0,"
        f" 0.6::DOUBLE * successes / attempts + 0.4::DOUBLE * coverage) * {_FORGET.format(0.05)}, 6) AS mastery FROM cv"
    ),
    "mastery_coverage_yaml": (
        f"WITH {_LOG}, {_COVER} SELECT learner, concept, round(least(1.0,"
        f" 0.7::DOUBLE * successes / attempts + 0.3::DOUBLE * coverage) * {_FORGET.format(repr(1 / 30))}, 6) AS mastery"
        f" FROM cv"
    ),
    "adjust_difficulty": (
        f"WITH {_LOG}, r AS ({_RECENT.format('learner, concept', 10)})"
        f" SELECT learner, concept, round(least(0.9::DOUBLE, greatest(0.2::DOUBLE,"
        f" 0.5::DOUBLE + 0.8::DOUBLE * (accuracy - 0.5::DOUBLE))), 6) AS difficulty FROM r"
    ),
    "feedback": (
        f"WITH {_LOG} SELECT lg.concept, CASE WHEN success = 0 THEN 'review the evidence and try again'"
        f" WHEN round({_PRACTICE}, 9) > 0.7 THEN 'mastered: go on to the next concept'"
        f" ELSE 'correct: practise once more' END AS message, count(*) AS n FROM lg JOIN cs USING (learner, concept)"
        f" GROUP BY ALL"
    ),
    "learning_path": (
        f"{LEX}, {_LOG}, e AS (SELECT DISTINCT src, dst FROM rel WHERE rel = 'hasPrereq'"
        f" AND src <> dst), lw AS (SELECT dst AS id, 0 AS level FROM e WHERE dst NOT IN (SELECT src FROM e) UNION"
        f" SELECT e.src, level + 1 FROM lw JOIN e ON e.dst = lw.id), lv AS (SELECT id, max(level) AS level FROM lw"
        f" GROUP BY id), dn AS (SELECT learner, count(*) AS k FROM cs WHERE successes > 0"
        f" GROUP BY learner), x AS (SELECT learner, ent.id, type, row_number() OVER (PARTITION BY learner"
        f" ORDER BY level, ent.id) AS step FROM dn JOIN ent ON language = 'en' AND r >= k JOIN lv ON lv.id = ent.id)"
        f" SELECT learner, step::INT AS step, id, CASE type WHEN 'Word' THEN 0.3::DOUBLE"
        f" ELSE 0.6::DOUBLE END AS difficulty, CASE type WHEN 'Word' THEN 10 ELSE 30 END::BIGINT AS minutes FROM x"
        f" WHERE step <= 10"
    ),
    "describe_values": (
        "SELECT event_type AS concept, count(value) AS count, round(avg(value), 4) AS mean, round(stddev_pop(value),"
        " 4) AS std, round(min(value), 4) AS min, round(max(value), 4) AS max, round(sum(value), 4) AS sum,"
        " round(quantile_cont(value, 0.25), 4) AS p25, round(quantile_cont(value, 0.5), 4) AS p50,"
        " round(quantile_cont(value, 0.75), 4) AS p75 FROM events GROUP BY event_type"
    ),
    "count_distribution": "SELECT event_type AS concept, count(*) AS n FROM events GROUP BY event_type",
    "learning_curve": "SELECT strftime(ts, '%Y-%m-%d') AS day, round(avg(value), 6) AS mean FROM events GROUP BY 1",
    "group_evaluation": (
        "WITH p AS (SELECT user_id, event_type AS concept, avg(value) FILTER (ts < TIMESTAMP '2024-01-16') AS pre,"
        " avg(value) FILTER (ts >= TIMESTAMP '2024-01-16') AS post FROM events GROUP BY ALL)"
        " SELECT concept, count(*) AS n, round(avg(pre), 6) AS pre_mean, round(avg(post), 6) AS post_mean,"
        " round(avg(post - pre) / (stddev_samp(post - pre) / sqrt(count(*))), 6) AS t,"
        " round((avg(post) - avg(pre)) / sqrt((stddev_samp(post) ** 2 + stddev_samp(pre) ** 2) / 2), 6) AS d FROM p"
        " WHERE pre IS NOT NULL AND post IS NOT NULL GROUP BY concept"
    ),
    "welch_t": (
        "WITH x AS (SELECT event_type AS concept, count(*) AS n, avg(value) AS m, stddev_samp(value) AS s FROM events"
        " GROUP BY 1) SELECT a.concept, b.concept AS concept2,"
        " round((a.m - b.m) / sqrt(a.s ** 2 / a.n + b.s ** 2 / b.n), 6) AS t,"
        " round((a.s ** 2 / a.n + b.s ** 2 / b.n) ** 2 / ((a.s ** 2 / a.n) ** 2 / (a.n - 1) + (b.s ** 2 / b.n) ** 2 / (b.n - 1)),"
        " 4) AS df FROM x a JOIN x b ON a.concept < b.concept"
    ),
    "run_monitor": (
        "WITH l AS (SELECT * FROM events ORDER BY ts DESC, event_id DESC LIMIT 100), w AS (SELECT * FROM l"
        " WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 24 HOURS), a AS (SELECT count(*) AS total,"
        " count(*) FILTER (event_type = 'error') AS failed, round(avg(value), 2) AS avg_time FROM w)"
        " SELECT total, failed, round(failed::DOUBLE / total, 3) AS failure_rate, avg_time,"
        " round(failed::DOUBLE / total, 3) > 0.3 AS alert_failures, avg_time > 3600 AS alert_time FROM a"
    ),
}
