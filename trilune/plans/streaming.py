"""Queries that run a stream over all events to its end; their SQL is the batch twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from trilune.streaming import events as E


def stream_counters(spark, d):
    return E.latest(E.finished(E.counters(E.event_stream(spark, d)), "update"), "learner", "concept")


def stream_rate_windows(spark, d):
    """Requests a minute and user, as the last update of each window."""
    rows = E.finished(E.rate_windows(E.event_stream(spark, d)), "update")
    return E.latest(rows, "start", "user_id").select(F.unix_micros("start").alias("start"), "user_id", "n")


def stream_quality(spark, d):
    """A filter and projection of each micro-batch, appended."""
    s = E.event_stream(spark, d)
    return E.finished(s.where("value >= 60").select("event_id", "event_type", F.round("value", 2).alias("value")), "append").drop(
        "batch",
    )


def stream_user_windows(spark, d):
    """Closed windows of each user that opened at an event of its own."""
    return E.finished(E.first_event_windows(E.event_stream(spark, d), 3600), "append").drop("batch")


QUERIES = {
    "stream_counters": stream_counters,
    "stream_rate_windows": stream_rate_windows,
    "stream_quality": stream_quality,
    "stream_user_windows": stream_user_windows,
}

SQL = {
    "stream_counters": (
        "SELECT user_id AS learner, event_type AS concept, count(*) AS attempts,"
        " count(*) FILTER (value >= 60) AS successes FROM events GROUP BY ALL"
    ),
    "stream_rate_windows": "SELECT (epoch_us(ts) // 60000000) * 60000000 AS start, user_id, count(*) AS n FROM events GROUP BY 1, 2",
    "stream_quality": "SELECT event_id, event_type, round(value, 2) AS value FROM events WHERE value >= 60",
    "stream_user_windows": (
        "WITH RECURSIVE o AS (SELECT user_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id"
        " ORDER BY ts) AS k FROM events), w AS (SELECT user_id, t AS opened, k, t FROM o WHERE k = 1 UNION ALL"
        " SELECT o.user_id, CASE WHEN o.t - w.opened >= 3600000000 THEN o.t ELSE w.opened END, o.k, o.t FROM w"
        " JOIN o ON o.user_id = w.user_id AND o.k = w.k + 1), g AS (SELECT user_id, opened, count(*) AS n FROM w"
        " GROUP BY ALL) SELECT user_id, opened, n, n > 70 AS blocked FROM g WHERE opened < (SELECT max(opened) FROM g x"
        " WHERE x.user_id = g.user_id)"
    ),
}
