"""Executions of one id and second are in order of their states."""

import pytest
from pyspark.sql import functions as F

from trilune.operators import scheduling as S

TASK = [("t", "n", "k", "every_5m", "{}", True, 3, 60, 100)]


@pytest.mark.parametrize("turn", [False, True])
def test_ties_are_decided_by_state(spark, turn):
    rows = [
        ("e1", "t", S.FAILED, 100, 130, None),
        ("e2", "t", S.FAILED, 200, 230, None),
        ("e2", "t", S.COMPLETED, 200, 240, None),
        ("e0", "t", S.COMPLETED, 100, 110, None),
    ]
    tasks = spark.createDataFrame(TASK, S.TASKS)
    runs = spark.createDataFrame(rows[::-1] if turn else rows, S.EXECUTIONS).repartition(1 + turn)
    assert S.status(tasks, runs).first().status == S.FAILED
    assert [(r.execution_id, r.status) for r in S.recent(runs, 2).orderBy(*map(F.desc, S.ORDER)).collect()] == [("e2", S.FAILED), ("e2", S.COMPLETED)]
    again = S.retries(tasks, runs).collect()
    assert [(r.attempt, r["at"]) for r in again] == [(1, 290)]  # only what comes after the last success counts
