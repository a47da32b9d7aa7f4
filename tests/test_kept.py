"""What is made of tables is made once, and again when they change or it is gone."""

import shutil

from trilune.sources import tables as T


def test_kept_follows_the_table(spark, tmp_path):
    folder, calls = f"file://{tmp_path}", []

    def get():
        def make():
            calls.append(1)
            return T.stored(spark.read.parquet(f"{folder}/x.parquet").selectExpr("id * 2 AS id"), "kept")

        return T.kept(spark, folder, ("x",), "double", make, lambda df: (df,))

    spark.range(3).write.parquet(f"{folder}/x.parquet")
    assert sorted(r.id for r in get().collect()) == [0, 2, 4] and get().count() == 3 and len(calls) == 1
    spark.range(5).write.mode("overwrite").parquet(f"{folder}/x.parquet")
    assert get().count() == 5 and len(calls) == 2
    shutil.rmtree(get().inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0])
    assert get().count() == 5 and len(calls) == 3
