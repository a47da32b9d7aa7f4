"""Upserts appear as a whole or not at all."""

import pytest
from pyspark.sql import functions as F

from trilune.sources import upserts as U


def rows_of(spark, path):
    return sorted((r.id, r.level, r.n) for r in U.read(spark, path, "id").collect())


@pytest.fixture
def table(spark, tmp_path):
    path = f"file://{tmp_path}/learners"
    U.upsert(spark.createDataFrame([("a", "A1", 1), ("b", "B1", 2), ("c", "C1", 3)], "id string, level string, n long").repartition(3), path)
    return path


def test_upserts_replace_and_add(spark, table):
    U.upsert(spark.createDataFrame([("b", "B2", 9), ("d", "A1", 4), ("d", "A2", 4)], "id string, level string, n long"), table)
    assert rows_of(spark, table) == [("a", "A1", 1), ("b", "B2", 9), ("c", "C1", 3), ("d", "A1", 4)]
    before = len(U.manifests(table))
    U.compacted(spark, table, "id")
    assert rows_of(spark, table) == [("a", "A1", 1), ("b", "B2", 9), ("c", "C1", 3), ("d", "A1", 4)]
    assert len(U.manifests(table)) == before + 1 and len(U.layers(table)) == 1
    U.upsert(spark.createDataFrame([("a", "A2", 0)], "id string, level string, n long"), table)
    assert rows_of(spark, table)[0] == ("a", "A2", 0)


def test_a_failed_task_leaves_the_old_table(spark, table):
    old, seen = rows_of(spark, table), U.manifests(table)
    new = spark.range(40, numPartitions=4).select(
        F.col("id").cast("string").alias("id"),
        F.when(F.col("id") == 35, F.raise_error(F.lit("stopped"))).otherwise("X").cast("string").alias("level"),
        F.col("id").alias("n"),
    )
    with pytest.raises(Exception, match="stopped"):
        U.upsert(new, table)
    assert rows_of(spark, table) == old and U.manifests(table) == seen
    U.vacuum(table)  # tasks that were still at it when the write was given up may leave files
    assert rows_of(spark, table) == old
    fs, root = U.opened(table)
    from pyarrow.fs import FileSelector

    kept = {f for _, files in U.layers(table) for f in files}
    there = {i.path.removeprefix(root + "/") for i in fs.get_file_info(FileSelector(f"{root}/layers", recursive=True)) if i.is_file}
    assert there == kept


def test_empty_writes_and_empty_tables(spark, table, tmp_path):
    none = spark.createDataFrame([], "id string, level string, n long")
    U.upsert(none, table)
    assert len(rows_of(spark, table)) == 3
    U.replace(none, table)
    assert U.read(spark, table, "id", "id string, level string, n long").collect() == []
    with pytest.raises(ValueError):
        U.read(spark, f"file://{tmp_path}/nothing", "id")


def test_a_manifest_is_made_once(tmp_path):
    fs, root = U.opened(f"file://{tmp_path}")
    U.put_once(fs, f"{root}/1.json", "one")
    with pytest.raises(FileExistsError):
        U.put_once(fs, f"{root}/1.json", "two")
    assert (tmp_path / "1.json").read_text() == "one" and len(list(tmp_path.iterdir())) == 1
