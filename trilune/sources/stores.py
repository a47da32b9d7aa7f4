"""The engine's own tables under a folder: their columns, appending, replacing, and reading them in pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from trilune.operators.scheduling import EXECUTIONS, TASKS

TABLES = {
    "documents": (
        "doc_id string, filename string, file_type string, size long, language string, created_at string, processed_at string, "
        "quality_score double, checksum string, source string, metadata string, processing_metadata string, validation string"
    ),
    "document_content": "doc_id string, text string, original_text string",
    "learners": "learner_id string, current_level string, mastery_threshold double, created_at string",
    "concept_mastery": (
        "learner_id string, concept_id string, attempts long, successes long, last_attempt_at string,"
        " last_success_at string"
    ),
    "exercise_log": (
        "id string, learner_id string, concept_id string, question_id string, difficulty double, success int,"
        " response_time double, created_at string"
    ),
    "quality_reports": (
        "id string, record_id string, overall_score double, issues_count long, recommendations_count long,"
        " report_data string, created_at string"
    ),
    "cleaning_records": "id string, record_id string, cleaning_actions string, created_at string",
    "tasks": TASKS,
    "task_executions": EXECUTIONS,
}


def create(spark: SparkSession, folder: str, tables: tuple[str, ...] = tuple(TABLES)) -> None:
    """Empty tables where there are none yet."""
    for name in tables:
        spark.createDataFrame([], TABLES[name]).write.mode("ignore").parquet(f"{folder}/{name}")


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.schema(TABLES[name]).parquet(f"{folder}/{name}")


def append(rows: DataFrame, folder: str, name: str) -> None:
    """Adds rows; columns that they lack are null, others of the table's columns must not be missing by a misspelling."""
    fields = StructType.fromDDL(TABLES[name]).fields
    unknown = set(rows.columns) - {f.name for f in fields}
    if unknown:
        raise ValueError(f"{name} has no columns {sorted(unknown)}")
    have = [
        F.col(f.name).cast(f.dataType) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name)
        for f in fields
    ]
    rows.select(*have).write.mode("append").parquet(f"{folder}/{name}")


def iso(seconds: Column) -> Column:
    """A time in UTC as text."""
    return F.date_format(
        F.to_utc_timestamp(F.timestamp_seconds(seconds), F.current_timezone()),
        "yyyy-MM-dd'T'HH:mm:ss",
    )


def log_exercises(rows: DataFrame, folder: str) -> None:
    """Appends answered exercises (learner_id, concept_id, question_id, difficulty, success, response_time, created_at); ids follow from the rows."""
    key = F.md5(F.concat_ws("|", "learner_id", "concept_id", "question_id", "created_at").cast("binary"))
    append(rows.withColumn("id", key).withColumn("success", F.col("success").cast("int")), folder, "exercise_log")


def mastery(log: DataFrame) -> DataFrame:
    """concept_mastery out of the log, for each learner and concept."""
    won = F.when(F.col("success") == 1, F.col("created_at"))
    return log.groupBy("learner_id", "concept_id").agg(
        F.count(F.lit(1)).alias("attempts"),
        F.sum(F.col("success").cast("long")).alias("successes"),
        F.max("created_at").alias("last_attempt_at"),
        F.max(won).alias("last_success_at"),
    )


def save_reports(assessed: DataFrame, folder: str, at: str) -> None:
    """Appends what was found about records (id, metrics, overall, recommendations), the whole of it as JSON."""
    failed = F.size(F.filter("metrics", lambda m: ~m["passed"])).cast("long")
    report = F.to_json(F.struct("overall", "metrics", "recommendations"))
    key = F.md5(F.concat_ws("|", F.col("id").cast("string"), F.lit(at)).cast("binary"))
    rows = assessed.select(
        key.alias("id"),
        F.col("id").cast("string").alias("record_id"),
        F.col("overall").alias("overall_score"),
        failed.alias("issues_count"),
        F.size("recommendations").cast("long").alias("recommendations_count"),
        report.alias("report_data"),
        F.lit(at).alias("created_at"),
    )
    append(rows, folder, "quality_reports")


def save_cleaning(cleaned: DataFrame, folder: str, at: str) -> None:
    """Appends which fields of records (id, actions) were cleaned, for those where any was."""
    key = F.md5(F.concat_ws("|", F.col("id").cast("string"), F.lit(at)).cast("binary"))
    rows = cleaned.where(F.size("actions") > 0).select(
        key.alias("id"),
        F.col("id").cast("string").alias("record_id"),
        F.to_json("actions").alias("cleaning_actions"),
        F.lit(at).alias("created_at"),
    )
    append(rows, folder, "cleaning_records")


def page(documents: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    """Documents, the newest first: `limit` of them after the first `offset`."""
    return documents.orderBy(F.desc("created_at"), "doc_id").offset(offset).limit(limit)


def with_content(documents: DataFrame, content: DataFrame, doc_id: str | None = None) -> DataFrame:
    """Documents with their texts; of one id, if given."""
    if doc_id is not None:
        documents, content = documents.where(F.col("doc_id") == doc_id), content.where(F.col("doc_id") == doc_id)
    return documents.join(content, "doc_id", "left")


def decoded(
    documents: DataFrame,
    columns: tuple[str, ...] = ("metadata", "processing_metadata", "validation"),
) -> DataFrame:
    """JSON columns as maps of texts; what is no such JSON stays as it is, under the name "raw"."""
    kind = "map<string,string>"
    as_map = lambda c: F.coalesce(
        F.from_json(c, kind),
        F.when(F.col(c).isNotNull(), F.create_map(F.lit("raw"), F.col(c))),
    )
    return documents.withColumns({c: as_map(c) for c in columns if c in documents.columns})


def folder_statistics(spark: SparkSession, path: str) -> DataFrame:
    """(files, bytes) of all files under a folder that are not empty; their contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("length")
    return files.agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"))


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def line_count(spark: SparkSession, path: str) -> int:
    return spark.read.text(path).count()


def corpus(spark: SparkSession, paths: list[str], schema: str, most: int | None = None) -> DataFrame:
    """JSON lines of all paths that exist, as one table; `most` rows of it for a demonstration."""
    found = [p for p in paths if exists(spark, p)]
    out = spark.createDataFrame([], schema)
    for p in found:
        out = out.unionByName(spark.read.schema(schema).json(p))
    return out if most is None else out.limit(most)


def settings(path: str) -> dict | None:
    """A YAML file's settings; an empty file is None."""
    import yaml

    with open(path, encoding="utf-8") as f:
        return yaml.safe_load(f)
