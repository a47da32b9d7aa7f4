"""Scheduled tasks and their executions as tables; times are seconds since 1970 in UTC.

tasks: task_id, name, task_type, schedule, config (JSON), enabled, max_retries, retry_delay, timeout.
executions: execution_id, task_id, status, started, finished, error. Executions are in order of start, id and, for equal ids, status.

A schedule is `every_<n><s|m|h|d>`, `daily_HH:MM` or `weekly_<day>_HH:MM`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Units of intervals in seconds (any other counts as minutes), days of the week, states.
UNITS = {"s": 1, "m": 60, "h": 3600, "d": 86400}
DAYS = ["mon", "tue", "wed", "thu", "fri", "sat", "sun"]
PENDING, RUNNING, COMPLETED, FAILED, CANCELLED = "pending", "running", "completed", "failed", "cancelled"

TASKS = (
    "task_id string, name string, task_type string, schedule string, config string, "
    "enabled boolean, max_retries int, retry_delay long, timeout long"
)
EXECUTIONS = "execution_id string, task_id string, status string, started long, finished long, error string"
#: The last of a task's executions in this order is its newest.
ORDER = ("started", "execution_id", "status")


def interval_seconds(value: Column, unit: Column) -> Column:
    units = F.create_map(*[F.lit(x) for pair in UNITS.items() for x in pair])
    return value.cast("long") * F.coalesce(F.element_at(units, unit), F.lit(60))


def valid(task: DataFrame) -> Column:
    """Whether a task has all that it needs; null or empty is missing."""
    ok = F.lit(True)
    for c in ("task_id", "name", "task_type", "schedule", "config"):
        ok = ok & (F.coalesce(task[c].cast("string"), F.lit("")) != "")
    return ok


def typed(rows: DataFrame, config: str = "connector string, query string, max_results int") -> DataFrame:
    """Stored rows with their configuration decoded; one that is no JSON is null."""
    return rows.withColumn("config", F.from_json("config", config))


def enabled(tasks: DataFrame) -> DataFrame:
    return tasks.where(F.coalesce("enabled", F.lit(False)))


def next_run(schedule: Column, last: Column, as_of: Column) -> Column:
    """When a task is to run after it last did (null: never, which makes intervals due at once). Null for schedules that are none."""
    every = F.regexp_extract(schedule, r"^every_(\d+)([a-z]+)$", 1)
    unit = F.regexp_extract(schedule, r"^every_(\d+)([a-z]+)$", 2)
    clock = r"(?:^daily|^weekly_[a-z]+)_(\d{1,2}):(\d{2})$"
    at = (
        F.regexp_extract(schedule, clock, 1).try_cast("long") * 3600
        + F.regexp_extract(schedule, clock, 2).try_cast("long") * 60
    )
    since = F.coalesce(last, as_of)
    today = F.floor(since / 86400) * 86400
    daily = today + at + F.when(today + at <= since, 86400).otherwise(0)
    wanted = (
        F.array_position(
            F.array(*map(F.lit, DAYS)),
            F.substring(F.regexp_extract(schedule, r"^weekly_([a-z]+)_", 1), 1, 3),
        )
        - 1
    )
    weekday = F.pmod(F.floor(since / 86400) + 3, F.lit(7))  # the first day of 1970 was a Thursday
    first = today + F.pmod(wanted - weekday, F.lit(7)) * 86400 + at
    weekly = first + F.when(first <= since, 7 * 86400).otherwise(0)
    return (
        F.when(every != "", F.when(last.isNull(), as_of).otherwise(last + interval_seconds(every, unit)))
        .when(schedule.startswith("daily_"), daily)
        .when(schedule.startswith("weekly_") & (wanted >= 0), weekly)
    )


def scheduled(tasks: DataFrame, executions: DataFrame, as_of: int) -> DataFrame:
    """Enabled tasks with `last` and `next`."""
    last = executions.groupBy("task_id").agg(F.max("started").alias("last"))
    out = enabled(tasks).join(last, "task_id", "left")
    return out.withColumn("next", next_run(F.col("schedule"), F.col("last"), F.lit(as_of)))


def status(tasks: DataFrame, executions: DataFrame) -> DataFrame:
    """(task_id, status, started): running if any execution is, else that of the newest, else pending."""
    newest = F.max(F.struct(*ORDER)).getField("status")
    now = executions.groupBy("task_id").agg(
        F.when(F.max(F.col("status") == RUNNING), RUNNING).otherwise(newest).alias("status"),
        F.max("started").alias("started"),
    )
    out = tasks.select("task_id").join(now, "task_id", "left")
    return out.withColumn("status", F.coalesce("status", F.lit(PENDING)))


def due(tasks: DataFrame, executions: DataFrame, as_of: int, most_running: int | None = None) -> DataFrame:
    """Tasks to start, the longest waiting first; those that run already wait. `most_running` is the gate on how many run at once."""
    running = executions.where(F.col("status") == RUNNING).select("task_id").distinct()
    out = scheduled(tasks, executions, as_of).where(F.col("next") <= as_of).join(running, "task_id", "left_anti")
    if most_running is None:
        return out
    return out.orderBy("next", "task_id").limit(max(0, most_running - running.count()))


def retries(tasks: DataFrame, executions: DataFrame) -> DataFrame:
    """(task_id, attempt, at) of tasks whose newest executions failed, while there are retries left: a delay after the last one."""
    rows = executions.withColumn(
        "_ok",
        F.max(F.when(F.col("status") != FAILED, F.struct(*ORDER))).over(
            Window.partitionBy("task_id"),
        ),
    )
    failed = F.col("_ok").isNull() | (F.struct(*ORDER) > F.col("_ok"))
    run = (
        rows.where(failed)
        .groupBy("task_id")
        .agg(F.count(F.lit(1)).alias("attempt"), F.max("finished").alias("finished"))
    )
    out = enabled(tasks).join(run, "task_id").where(F.col("attempt") <= F.col("max_retries"))
    return out.select("task_id", "attempt", (F.col("finished") + F.col("retry_delay")).alias("at"))


def timed_out(tasks: DataFrame, executions: DataFrame, as_of: int) -> DataFrame:
    """Executions, of which those that run longer than their task allows are cancelled now."""
    limits = tasks.select("task_id", F.col("timeout").alias("_timeout"))
    late = (F.col("status") == RUNNING) & (F.lit(as_of) - F.col("started") > F.col("_timeout"))
    out = executions.join(limits, "task_id", "left").withColumn("_late", F.coalesce(late, F.lit(False)))
    out = out.withColumn("status", F.when(F.col("_late"), CANCELLED).otherwise(F.col("status")))
    out = out.withColumn("finished", F.when(F.col("_late"), F.lit(as_of)).otherwise(F.col("finished")))
    out = out.withColumn("error", F.when(F.col("_late"), F.lit("timeout")).otherwise(F.col("error")))
    return out.select(*executions.columns)


def cancelled(executions: DataFrame, task_id: str, as_of: int) -> DataFrame:
    """Executions, of which the running ones of a task are cancelled now."""
    hit = (F.col("status") == RUNNING) & (F.col("task_id") == task_id)
    return executions.withColumns(
        {
            "finished": F.when(hit, F.lit(as_of)).otherwise(F.col("finished")),
            "status": F.when(hit, CANCELLED).otherwise(F.col("status")),
        },
    )


def recent(executions: DataFrame, each: int) -> DataFrame:
    """The newest `each` executions of a task: what its history keeps."""
    order = Window.partitionBy("task_id").orderBy(*map(F.desc, ORDER))
    return executions.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= each).drop("_n")


def replaced(table: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of new, and those of table whose key is not among them: insert or replace."""
    return table.join(new.select(key), key, "left_anti").select(*new.columns).unionByName(new)


def removed(table: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return table.join(keys.select(key).distinct(), key, "left_anti")


def run(
    tasks: DataFrame,
    actions: dict[str, Callable],
    as_of: int,
    callbacks: tuple[Callable, ...] = (),
    alert: Callable | None = None,
) -> DataFrame:
    """Runs tasks one after the other and returns their executions. An action takes the task's row and returns a number of records.

    Failures, also of callbacks, stay with their execution; `alert` is told of them.
    """
    found = []
    for task in tasks.orderBy("task_id").toLocalIterator():
        key = f"{task.task_id}-{as_of}"
        try:
            if task.task_type not in actions:
                raise ValueError(f"no action for {task.task_type}")
            actions[task.task_type](task)
            row = (key, task.task_id, COMPLETED, as_of, as_of, None)
        except Exception as problem:  # an action is a caller's code
            row = (key, task.task_id, FAILED, as_of, as_of, str(problem))
            if alert is not None:
                alert(task.task_id, str(problem))
        found.append(row)
        for told in callbacks:
            try:
                told(row)
            except Exception as problem:
                if alert is not None:
                    alert(task.task_id, str(problem))
    return tasks.sparkSession.createDataFrame(found, EXECUTIONS)
