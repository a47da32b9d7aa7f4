"""A table whose upserts appear as a whole: a Spark data source that writes layers, and a reader that lets the newest layer win.

A layer is the Parquet files of one write. Tasks write their files aside; nothing of them shows until the driver's commit, when all
tasks are done, names them in a manifest, which is one small file, made in one step and never changed. A task or write that fails
leaves the table as it was; its files are removed where they can be, and are in no manifest otherwise. Two writers that commit at once
get manifests of different numbers or the second one fails; neither loses rows of the other. Reading takes the manifests
there are, so a reader sees a write whole or not at all. `compacted` merges the layers into one.

Options: path (any file system of pyarrow's), key. A null key is a key too. Of rows of one key in one layer the first in order of all columns counts.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

NAME = "upserts"


def opened(uri: str):
    """A pyarrow file system and the path in it."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    if "://" not in uri:
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(uri)


@dataclass
class Written(WriterCommitMessage):
    files: list[str]
    rows: int


class Upserts(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return LayerWriter(self.options["path"], overwrite)


class LayerWriter(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.layer = path.rstrip("/"), overwrite, uuid.uuid4().hex

    def write(self, iterator: Iterator) -> Written:
        """A task's rows as one file, if it has any."""
        import pyarrow.parquet as pq

        fs, root = opened(self.path)
        name, writer, rows = f"layers/{self.layer}/{uuid.uuid4().hex}.parquet", None, 0
        try:
            for batch in iterator:
                if writer is None:
                    fs.create_dir(f"{root}/layers/{self.layer}", recursive=True)
                    writer = pq.ParquetWriter(f"{root}/{name}", batch.schema, filesystem=fs)
                writer.write_batch(batch)
                rows += batch.num_rows
        finally:
            if writer is not None:
                writer.close()
        return Written([name] if rows else [], rows)

    def commit(self, messages: list[Written | None]) -> None:
        """Names the files of all tasks in the next manifest."""
        fs, root = opened(self.path)
        files = [f for m in messages if m is not None for f in m.files]
        fs.create_dir(f"{root}/manifests", recursive=True)
        number = max((n for n, _ in manifests(self.path)), default=-1) + 1
        put_once(fs, f"{root}/manifests/{number:010}.json", json.dumps({"files": files, "overwrite": self.overwrite}))

    def abort(self, messages: list[Written | None]) -> None:
        from pyarrow import fs as kinds

        fs, root = opened(self.path)
        if fs.get_file_info(f"{root}/layers/{self.layer}").type != kinds.FileType.NotFound:
            fs.delete_dir(f"{root}/layers/{self.layer}")


def put_once(fs, path: str, text: str) -> None:
    """A file with that text; fails where there is one. Local files by exclusive creation of a link, others by a move that must not replace."""
    import os

    from pyarrow import fs as kinds

    aside = f"{path}.{uuid.uuid4().hex}"
    with fs.open_output_stream(aside) as f:
        f.write(text.encode())
    try:
        if isinstance(fs, kinds.LocalFileSystem):
            os.link(aside, path)
        elif fs.get_file_info(path).type == kinds.FileType.NotFound:
            fs.copy_file(aside, path)
        else:
            raise FileExistsError(path)
    finally:
        fs.delete_file(aside)


def manifests(path: str) -> list[tuple[int, dict]]:
    """The manifests in order of their numbers."""
    from pyarrow import fs as kinds

    fs, root = opened(path.rstrip("/"))
    found = fs.get_file_info(kinds.FileSelector(f"{root}/manifests", allow_not_found=True))
    out = []
    for info in sorted(found, key=lambda i: i.base_name):
        if info.base_name.endswith(".json"):
            with fs.open_input_stream(info.path) as f:
                out.append((int(info.base_name[:-5]), json.loads(f.read().decode())))
    return out


def layers(path: str) -> list[tuple[int, list[str]]]:
    """Files of each layer since the last one that replaced all."""
    out: list[tuple[int, list[str]]] = []
    for number, m in manifests(path):
        out = [*([] if m["overwrite"] else out), (number, m["files"])]
    return out


def read(spark: SparkSession, path: str, key: str, schema: str | None = None) -> DataFrame:
    """The newest row of each key. schema: that of a table that may be without rows."""
    found, root = None, path.rstrip("/")
    for number, files in layers(path):
        if files:
            df = spark.read.parquet(*(f"{root}/{f}" for f in files)).withColumn("_layer", F.lit(number))
            found = df if found is None else found.unionByName(df, allowMissingColumns=True)
    if found is None:
        if schema is None:
            raise ValueError(f"no rows under {path}")
        return spark.createDataFrame([], schema)
    columns = [c for c in found.columns if c != "_layer"]
    newest = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("_layer"), *columns))
    return found.withColumn("_n", newest).where("_n = 1").select(*columns)


def upsert(rows: DataFrame, path: str) -> None:
    """Rows into the table: those of a key replace the older ones."""
    rows.sparkSession.dataSource.register(Upserts)
    rows.write.format(NAME).mode("append").option("path", path).save()


def replace(rows: DataFrame, path: str) -> None:
    """Rows as the whole table."""
    rows.sparkSession.dataSource.register(Upserts)
    rows.write.format(NAME).mode("overwrite").option("path", path).save()


def compacted(spark: SparkSession, path: str, key: str) -> None:
    """The same table in one layer. Older layers' files stay, for readers that have begun."""
    replace(read(spark, path, key), path)


def vacuum(path: str) -> None:
    """Removes layers that no manifest since the last replacement names: what failed writes and older states left. Not while others read or write."""
    from pyarrow import fs as kinds

    fs, root = opened(path.rstrip("/"))
    kept = {f.split("/")[1] for _, files in layers(path) for f in files}
    for info in fs.get_file_info(kinds.FileSelector(f"{root}/layers", allow_not_found=True)):
        if info.base_name not in kept:
            fs.delete_dir(info.path)
