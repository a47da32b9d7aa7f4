"""Queries of the scheduler: orders are tasks, their line items executions."""

from __future__ import annotations

from pyspark.sql import functions as F

from trilune.operators import scheduling as S
from trilune.sources.tables import table

AS_OF = 1_000_000_000  # a fixed now


def tasks(spark, d):
    o = table(spark, d, "orders")
    forms = F.array(
        F.lit("every_5m"),
        F.lit("every_2h"),
        F.lit("daily_08:30"),
        F.lit("weekly_wed_06:15"),
        F.lit("every_3x"),
        F.lit("yearly"),
    )
    config = F.when(F.col("o_orderkey") % 11 == 0, "not json").otherwise(
        F.concat(
            F.lit('{"connector": "c'),
            F.col("o_custkey") % 5,
            F.lit('", "query": "q", "max_results": '),
            F.col("o_orderkey") % 50,
            F.lit("}"),
        ),
    )
    return o.select(
        F.col("o_orderkey").cast("string").alias("task_id"),
        F.when(F.col("o_orderkey") % 13 != 0, F.concat(F.lit("task "), "o_orderkey")).alias("name"),
        F.col("o_orderpriority").alias("task_type"),
        F.element_at(forms, (F.col("o_orderkey") % 6 + 1).cast("int")).alias("schedule"),
        config.alias("config"),
        (F.col("o_orderstatus") != "F").alias("enabled"),
        (F.col("o_orderkey") % 4).cast("int").alias("max_retries"),
        F.lit(60).cast("long").alias("retry_delay"),
        (F.col("o_custkey") % 10 * 1_000_000).alias("timeout"),
    )


def executions(spark, d):
    """Started at the shipping second; what was returned has failed, what is open runs."""
    x = table(spark, d, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        "l_returnflag",
        F.unix_timestamp("l_shipdate").alias("started"),
    )
    state = (
        F.when(F.col("l_returnflag") == "R", S.FAILED)
        .when(F.col("l_returnflag") == "A", S.COMPLETED)
        .otherwise(S.RUNNING)
    )
    return x.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "started").alias("execution_id"),
        F.col("l_orderkey").cast("string").alias("task_id"),
        state.alias("status"),
        "started",
        F.when(state != S.RUNNING, F.col("started") + 30).alias("finished"),
        F.lit(None).cast("string").alias("error"),
    )


def interval_seconds(spark, d):
    x = table(spark, d, "events").select(
        "event_id",
        (F.col("event_id") % 90).alias("value"),
        F.element_at(F.array(*map(F.lit, "smhdx")), (F.col("event_id") % 5 + 1).cast("int")).alias("unit"),
    )
    return x.select("event_id", S.interval_seconds(F.col("value"), F.col("unit")).alias("seconds"))


def task_valid(spark, d):
    t = tasks(spark, d)
    return t.select("task_id", S.valid(t).alias("valid"))


def task_typed(spark, d):
    return S.typed(tasks(spark, d)).select(
        "task_id",
        "config.connector",
        F.coalesce("config.max_results", F.lit(-1)).alias("max_results"),
    )


def task_next(spark, d):
    return S.scheduled(tasks(spark, d), executions(spark, d), AS_OF).select(
        "task_id",
        *[F.coalesce(c, F.lit(-1)).alias(c) for c in ("last", "next")],
    )


def task_due(spark, d):
    return S.due(tasks(spark, d), executions(spark, d), AS_OF).select("task_id", "next")


def task_admitted(spark, d):
    """The first hundred of the tasks that are due, were nothing running."""
    idle = executions(spark, d).where(F.col("status") != S.RUNNING)
    return S.due(tasks(spark, d), idle, AS_OF, 100).select("task_id", "next")


def task_status(spark, d):
    return S.status(tasks(spark, d), executions(spark, d)).fillna(-1, ["started"])


def task_retries(spark, d):
    return S.retries(tasks(spark, d), executions(spark, d))


def task_timeouts(spark, d):
    return (
        S.timed_out(tasks(spark, d), executions(spark, d), AS_OF)
        .groupBy("status", "error")
        .agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("finished"), F.lit(-1)).alias("finished"))
    )


def task_history(spark, d):
    return S.recent(executions(spark, d), 2).select("task_id", "execution_id", "status")


def task_replaced(spark, d):
    t = tasks(spark, d)
    new = (
        t.where("task_id % 3 = 0")
        .withColumn("name", F.lit("new"))
        .unionByName(t.where("task_id = '1'").withColumn("task_id", F.lit("added")))
    )
    kept = S.removed(t, t.where("task_id % 5 = 0"), "task_id")
    return S.replaced(kept, new, "task_id").select("task_id", "name")


QUERIES = {
    f.__name__: f
    for f in (interval_seconds, task_valid, task_typed, task_next, task_due, task_admitted, task_status, task_retries, task_timeouts, task_history, task_replaced)
}

_TASKS = """WITH t AS (
  SELECT o_orderkey::VARCHAR AS task_id, CASE WHEN o_orderkey % 13 <> 0 THEN 'task ' || o_orderkey END AS name,
    ['every_5m', 'every_2h', 'daily_08:30', 'weekly_wed_06:15', 'every_3x', 'yearly'][o_orderkey % 6 + 1] AS schedule,
    CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE 'c' || o_custkey % 5 END AS connector,
    CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE (o_orderkey % 50)::INT END AS max_results,
    o_orderstatus <> 'F' AS enabled, o_orderkey % 4 AS max_retries, o_custkey % 10 * 1000000 AS timeout, o_orderpriority AS task_type
  FROM orders
), e AS (
  SELECT concat_ws('-', l_orderkey, l_linenumber, epoch(l_shipdate)::BIGINT) AS execution_id, l_orderkey::VARCHAR AS task_id,
    CASE l_returnflag WHEN 'R' THEN 'failed' WHEN 'A' THEN 'completed' ELSE 'running' END AS status, epoch(l_shipdate)::BIGINT AS started,
    CASE WHEN l_returnflag IN ('R', 'A') THEN epoch(l_shipdate)::BIGINT + 30 END AS finished
  FROM lineitem
)"""
_NEXT = f"""{_TASKS}, l AS (SELECT task_id, max(started) AS "last" FROM e GROUP BY task_id
), s AS (SELECT t.*, l."last", coalesce(l."last", {AS_OF}) AS since FROM t LEFT JOIN l USING (task_id) WHERE enabled
), c AS (SELECT *, since // 86400 * 86400 AS today, (since // 86400 + 3) % 7 AS weekday FROM s
), n AS (SELECT *, CASE schedule
    WHEN 'every_5m' THEN coalesce("last" + 300, {AS_OF}) WHEN 'every_2h' THEN coalesce("last" + 7200, {AS_OF}) WHEN 'every_3x' THEN coalesce("last" + 180, {AS_OF})
    WHEN 'daily_08:30' THEN today + 30600 + CASE WHEN today + 30600 <= since THEN 86400 ELSE 0 END
    WHEN 'weekly_wed_06:15' THEN today + (9 - weekday) % 7 * 86400 + 22500
      + CASE WHEN today + (9 - weekday) % 7 * 86400 + 22500 <= since THEN 604800 ELSE 0 END
  END AS "next" FROM c)"""

SQL = {
    "interval_seconds": "SELECT event_id, event_id % 90 * [1, 60, 3600, 86400, 60][event_id % 5 + 1] AS seconds FROM events",
    "task_valid": f"{_TASKS} SELECT task_id, name IS NOT NULL AND task_type <> '' AS valid FROM t",
    "task_typed": f"{_TASKS} SELECT task_id, connector, coalesce(max_results, -1) AS max_results FROM t",
    "task_next": f'{_NEXT} SELECT task_id, coalesce("last", -1) AS "last", coalesce("next", -1) AS "next" FROM n',
    "task_due": f"""{_NEXT} SELECT task_id, "next" FROM n WHERE "next" <= {AS_OF} AND task_id NOT IN (SELECT task_id FROM e WHERE status = 'running')""",
    "task_admitted": _NEXT.replace("FROM lineitem", "FROM lineitem WHERE l_returnflag IN ('R', 'A')") + f' SELECT task_id, "next" FROM n WHERE "next" <= {AS_OF} ORDER BY "next", task_id LIMIT 100',
    "task_status": f"""{_TASKS} SELECT t.task_id, coalesce(CASE WHEN bool_or(status = 'running') THEN 'running' ELSE arg_max(status, (started, execution_id, status)) END, 'pending') AS status, coalesce(max(started), -1) AS started
FROM t LEFT JOIN e USING (task_id) GROUP BY t.task_id""",
    "task_retries": f"""{_TASKS}, k AS (SELECT *, max(CASE WHEN status <> 'failed' THEN (started, execution_id, status) END) OVER (PARTITION BY task_id) AS ok FROM e
), f AS (SELECT task_id, count(*) AS attempt, max(finished) AS finished FROM k WHERE status = 'failed' AND (ok IS NULL OR (started, execution_id, status) > ok) GROUP BY task_id)
SELECT task_id, attempt, finished + 60 AS "at" FROM t JOIN f USING (task_id) WHERE enabled AND attempt <= max_retries""",
    "task_timeouts": f"""{_TASKS}, x AS (SELECT e.*, status = 'running' AND {AS_OF} - started > timeout AS late FROM e LEFT JOIN t USING (task_id)
) SELECT CASE WHEN late THEN 'cancelled' ELSE status END AS status, CASE WHEN late THEN 'timeout' END AS error, count(*) AS n, coalesce(sum(CASE WHEN late THEN {AS_OF} ELSE finished END)::BIGINT, -1) AS finished
FROM x GROUP BY 1, 2""",
    "task_history": f"""{_TASKS} SELECT task_id, execution_id, status FROM e QUALIFY row_number() OVER (PARTITION BY task_id ORDER BY started DESC, execution_id DESC, status DESC) <= 2""",
    "task_replaced": """SELECT o_orderkey::VARCHAR AS task_id, CASE WHEN o_orderkey % 3 = 0 THEN 'new' WHEN o_orderkey % 13 <> 0 THEN 'task ' || o_orderkey END AS name FROM orders WHERE o_orderkey % 3 = 0 OR o_orderkey % 5 <> 0
UNION ALL SELECT 'added', 'task 1' FROM orders WHERE o_orderkey = 1""",
}
