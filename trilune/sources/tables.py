"""The driver's tables, with timestamps that streams and windows accept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A Parquet table; TIMESTAMP_NTZ columns become TIMESTAMP."""
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    return df.withColumns({c: F.col(c).cast("timestamp") for c, t in df.dtypes if t == "timestamp_ntz"})


def scratch(spark: SparkSession, what: str) -> str:
    """A new folder that driver and executors share: under spark.checkpoint.dir, or, on one machine only, a temporary one where that is unset."""
    import tempfile
    import uuid

    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="trilune-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{what}-{uuid.uuid4().hex}"


def stored(df: DataFrame, what: str) -> DataFrame:
    """The rows written as Parquet and read again, so that later steps neither repeat nor depend on what made them."""
    path = scratch(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: What was made of tables in this process, the newest last: (application, what, state of the tables' files) -> result.
_KEPT: dict = {}
MOST_KEPT = 16


def state(spark: SparkSession, path: str) -> tuple:
    """Names, sizes and times of the files of a table: what changes when it is written again."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    listed = [(s.getPath().toString(), s.getLen(), s.getModificationTime()) for s in fs.listStatus(p)]
    return tuple(sorted(listed))


def kept(spark: SparkSession, folder: str, tables: tuple[str, ...], what: str, make, frames):
    """make()'s result, made once in a process as long as the folder's tables stay as they are and the stored tables that frames(result) names are there."""
    key = (spark.sparkContext.applicationId, what, tuple(state(spark, f"{folder}/{t}.parquet") for t in tables))
    found = _KEPT.pop(key, None)
    if found is None or not all(_there(df) for df in frames(found)):
        found = make()
    _KEPT[key] = found
    while len(_KEPT) > MOST_KEPT:
        _KEPT.pop(next(iter(_KEPT)))
    return found


def _there(df: DataFrame) -> bool:
    files = df.inputFiles()
    spark = df.sparkSession
    if not files:
        return True
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(files[0])
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)
