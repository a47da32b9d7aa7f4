"""Files that arrive in a folder, taken into the document store as a stream.

Each run takes the files that have come since the last one and stops (`availableNow`); what was taken is remembered in the
store's own folder, so a run that is stopped goes on where it was. A batch of files is one partition of the store, which is
replaced as a whole when Spark repeats the batch: nothing is stored twice. Every file leaves a row with its status, also one that cannot
be read. A file that comes again, under any path, with the same name and content is the same document, of which the last row counts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trilune.functions.text import heuristic_language, normalize_text
from trilune.operators.quality import text_validation
from trilune.sources.files import documents_of

FILES = "path string, modificationTime timestamp, length long, content binary"
ROWS = (
    "doc_id string, filename string, file_type string, size long, language string, created_at timestamp, quality_score double, "
    "valid boolean, checksum string, source string, status string, error string, text string, original_text string, batch long"
)


def processed(files: DataFrame, extractors: dict[str, Callable[[bytes], str]] | None = None) -> DataFrame:
    """Files (path, modificationTime, length, content) as documents of the store."""
    rows = documents_of(files, extractors, ("modificationTime",))
    language = F.coalesce(heuristic_language(F.col("text")), F.lit("unknown"))
    score, valid = text_validation(F.col("text"), F.col("language"))
    ok = F.col("error").isNull()
    return (
        rows.withColumn("language", language)
        .withColumn("score", score)
        .withColumn("valid", valid)
        .select(
            "doc_id",
            "filename",
            "file_type",
            "size",
            F.when(ok, F.col("language")).alias("language"),
            F.col("modificationTime").alias("created_at"),
            F.when(ok, F.col("score")).alias("quality_score"),
            (ok & F.col("valid")).alias("valid"),
            "checksum",
            F.lit("upload").alias("source"),
            F.when(ok, "success").otherwise("error").alias("status"),
            "error",
            F.when(ok, normalize_text(F.col("text"))).alias("text"),
            F.when(ok, F.col("text")).alias("original_text"),
        )
    )


def ingest(
    spark: SparkSession,
    incoming: str,
    store: str,
    extractors: dict[str, Callable[[bytes], str]] | None = None,
    files_per_batch: int = 1000,
) -> None:
    """Takes what is new in `incoming` (a folder, its folders included) into the store, batch after batch."""

    def save(batch: DataFrame, number: int) -> None:
        processed(batch, extractors).write.mode("overwrite").parquet(f"{store}/rows/batch={number}")

    files = (
        spark.readStream.format("binaryFile")
        .schema(FILES)
        .option("recursiveFileLookup", True)
        .option("maxFilesPerTrigger", files_per_batch)
        .load(incoming)
    )
    files.writeStream.foreachBatch(save).option("checkpointLocation", f"{store}/progress").trigger(availableNow=True).start().awaitTermination()


def rows(spark: SparkSession, store: str) -> DataFrame:
    """A row for every file taken."""
    return spark.read.schema(ROWS).parquet(f"{store}/rows")


def documents(spark: SparkSession, store: str) -> DataFrame:
    """Documents that could be read, each once."""
    last = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("batch"), F.desc("created_at")))
    return rows(spark, store).where("status = 'success'").withColumn("_n", last).where("_n = 1").drop("_n")
