"""What the operators share: tables, the shared folder, and buckets."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of the contracts: runs without \x20 and \x09-\x0D.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it.

    Only where spark.checkpoint.dir is unset and all runs on one machine, as in tests, a temporary folder is made and set.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        jvm = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = jvm.get() if jvm.isDefined() else None
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="trilune-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: Folders that were named in this process and not removed since, in order.
MADE: list[str] = []


def new_folder(spark: SparkSession, what: str) -> str:
    MADE.append(f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}")
    return MADE[-1]


def written(spark: SparkSession, df: DataFrame, what: str, compression: str = "zstd") -> DataFrame:
    """The rows as a Parquet table in the shared folder, read again: lineage ends there and lost executors lose nothing."""
    path = new_folder(spark, what)
    df.write.option("compression", compression).parquet(path)
    return kept_at(spark.read.schema(df.schema).parquet(path), path)


def kept_at(df: DataFrame, path: str) -> DataFrame:
    """df, with the folder that `dropped` removes."""
    df._trilune_folder = path
    return df


def remove(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    if path in MADE:
        MADE.remove(path)


def dropped(*tables: DataFrame) -> None:
    """Removes what `written` wrote, once no result reads it any more."""
    for t in tables:
        remove(t.sparkSession, t._trilune_folder)


def stored_alone(spark: SparkSession, make, what: str) -> DataFrame:
    """The rows that make() describes, as a table; all folders that were made on the way are removed."""
    before = set(MADE)
    out = written(spark, make(), what)
    for path in [p for p in MADE if p not in before and p != out._trilune_folder]:
        remove(spark, path)
    return out


#: Keys up to this size are sent to every task; beyond it, a join shuffles.
SENT_BYTES = 16 << 20


def without(docs: DataFrame, gone: DataFrame, *keys: str, bytes_each: int = 8) -> DataFrame:
    """Rows of docs whose keys (expressions over docs, named as in gone) are not in gone. Null keys stay."""
    gone = written(docs.sparkSession, gone.distinct(), "gone")
    few = gone.count() * bytes_each <= SENT_BYTES
    return docs.join(F.broadcast(gone) if few else gone, list(keys), "left_anti")


def apart(docs: DataFrame, stage, *names: str) -> DataFrame:
    """stage(docs), with docs' columns other than `names` out of its way meanwhile, so that none is replaced by what an operator calls the same."""
    held = {c: f"_kept_{i}" for i, c in enumerate(docs.columns) if c not in names}
    out = stage(docs.withColumnsRenamed(held))
    return out.select(*[F.col(held.get(c, c)).alias(c) for c in docs.columns])


def let(value, body):
    """body(x) with x standing for the value, which is computed once however often body names it, inside lambdas too."""
    return F.element_at(F.transform(F.array(value), body), 1)


def with_facts(rows: DataFrame, facts: DataFrame, keys: list[str], bytes_each: int, salts: int = 32) -> DataFrame:
    """Inner join of rows with a written table of facts on keys, nulls equal: sent to every task if small, else by key and salt, so that a key with many rows is many tasks."""
    names = {k: f"_of_{k}" for k in keys}
    facts = facts.withColumnsRenamed(names)
    same = [F.col(k).eqNullSafe(F.col(of)) for k, of in names.items()]
    if facts.count() * bytes_each <= SENT_BYTES:
        out = rows.join(F.broadcast(facts), same)
    else:
        salted = rows.withColumn("_salt", F.pmod(F.xxhash64(*rows.columns), F.lit(salts)))
        spread = facts.withColumn("_of_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        out = salted.join(spread, [*same, F.col("_salt") == F.col("_of_salt")]).drop("_salt", "_of_salt")
    return out.drop(*names.values())


#: Rows and bytes of an Arrow batch at most, where whole texts go to Python: JVM and worker both hold a batch, and keep its memory.
BATCH_ROWS = 2500
BATCH_BYTES = 8 << 20


def small_batches(spark: SparkSession) -> None:
    """Bounds Arrow batches of the session; smaller settings stay."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < int(spark.conf.get(name).rstrip("b")) <= BATCH_BYTES:  # Spark gives "67108864b"
        spark.conf.set(name, str(BATCH_BYTES))


#: Input, as stored, that a bucket gets on average.
BUCKET_BYTES = 32 << 20


def buckets(docs: DataFrame) -> int:
    """Groups that hashed keys are dealt to: by the input's bytes, and at least as many as the session has shuffle partitions."""
    least = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(least, -(-size // BUCKET_BYTES)) if size < 1 << 58 else least  # beyond that, Spark does not know


def fold(column, parts: int, keep: int):
    """Rows whose crc32(id as text) mod parts is keep: the held-out fold of a contract."""
    return F.coalesce(F.crc32(column.cast("string").cast("binary")) % parts == keep, F.lit(False))


def opened(uri: str):
    """A pyarrow file system and the path in it; file:, hdfs:, s3:, gs: and plain paths."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    if "://" not in uri:
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(uri)
