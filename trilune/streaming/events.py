"""Streams over the events: counters per key, rate windows, quality per micro-batch. Sources are folders of Parquet files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trilune.sources.tables import scratch


def event_stream(spark: SparkSession, folder: str, files: int = 1) -> DataFrame:
    """The events as a stream, a few files a batch; NTZ times become TIMESTAMP, as watermarks need."""
    path = f"{folder}/events.parquet"
    schema = spark.read.parquet(path).schema
    # A stream reads a folder, and events may be one file in it.
    df = (
        spark.readStream.schema(schema)
        .option("maxFilesPerTrigger", files)
        .option("pathGlobFilter", "*.parquet")
        .option("recursiveFileLookup", "true")
    )
    is_dir = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = is_dir.getFileSystem(spark._jsc.hadoopConfiguration())
    source = (
        df.parquet(path)
        if fs.getFileStatus(is_dir).isDirectory()
        else df.option("pathGlobFilter", "events.parquet").parquet(folder)
    )
    return source.withColumn("ts", F.col("ts").cast("timestamp"))


def finished(stream: DataFrame, mode: str) -> DataFrame:
    """All that is there now, run through the stream; the result of its last state per batch, as a table.

    Each batch is written under its number, so a repeated batch replaces itself.
    """
    spark = stream.sparkSession
    out, state = scratch(spark, "stream"), scratch(spark, "state")

    def sink(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/batch={number}/rows")

    query = (
        stream.writeStream.outputMode(mode)
        .foreachBatch(sink)
        .option("checkpointLocation", state)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.option("recursiveFileLookup", "true").schema(stream.schema.add("batch", "integer")).parquet(out)


def latest(rows: DataFrame, *keys: str) -> DataFrame:
    """Of updates per key the newest batch's."""
    rest = [c for c in rows.columns if c not in (*keys, "batch")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("x")).select(*keys, "x.*")


def counters(stream: DataFrame) -> DataFrame:
    """Running attempts and successes per learner and concept."""
    return stream.groupBy(F.col("user_id").alias("learner"), F.col("event_type").alias("concept")).agg(
        F.count(F.lit(1)).alias("attempts"),
        F.count_if(F.col("value") >= 60).alias("successes"),
    )


def rate_windows(stream: DataFrame, every: str = "60 seconds", late: str = "1 day") -> DataFrame:
    """Requests per key and window; windows are emitted once the watermark has passed them."""
    return (
        stream.withWatermark("ts", late)
        .groupBy(F.window("ts", every), "user_id")
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.col("window.start").alias("start"), "user_id", "n")
    )


def first_event_windows(stream: DataFrame, seconds: int = 60, limit: int = 70) -> DataFrame:
    """Per key, fixed windows that open at its first event after the last window closed: (user_id, opened, n, blocked)."""
    from pyspark.sql.streaming.state import GroupStateTimeout

    def step(key, frames, state):
        import pandas as pd

        opened, n = state.get if state.exists else (None, 0)
        out = []
        times = sorted(
            t
            for pdf in frames
            for t in (pdf["ts"].astype("int64") // 1000 if str(pdf["ts"].dtype).endswith("[ns]") or "ns" in str(pdf["ts"].dtype) else pdf["ts"].astype("int64"))
        )
        for t in times:
            if opened is None or t - opened >= seconds * 1_000_000:
                if opened is not None:
                    out.append((key[0], opened, n, n > limit))
                opened, n = t, 0
            n += 1
        state.update((opened, n))
        yield pd.DataFrame(out, columns=["user_id", "opened", "n", "blocked"])

    return stream.groupBy("user_id").applyInPandasWithState(
        step,
        "user_id long, opened long, n long, blocked boolean",
        "opened long, n long",
        "append",
        GroupStateTimeout.NoTimeout,
    )
