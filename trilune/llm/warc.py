"""WARC archives with an index of byte ranges.

Writing: every task appends gzip members, one per record, to archives of its own in
a shared folder and returns one index row per record: archive, offset, length, URL,
digest. The index is written as a table; only archives that it names count, so what a
lost or repeated task left behind is never read. Reading: the wanted index rows are
sorted by archive and offset, near ranges are joined into one read, and records are
cut out of it.

Payloads repeat: of records with equal payloads of at least `least` bytes that with
the largest id holds the payload, the others are revisit records that name it.

Null or empty payloads are empty payloads. A record without an id (null) gets a random
record id and, if its payload is repeated, revisits. Rows with the same id and payload are all
responses where that id is the largest. Null URLs give records without a target URI. Other
columns are not archived. An empty table gives an empty index.
"""

from __future__ import annotations

import uuid
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trilune.llm.common import SENT_BYTES, new_folder, opened, table, written

INDEX = (
    "id string, url string, archive string, offset long, length long, payload_bytes long, payload_digest string,"
    " record_type string, refers_to string"
)
RECORD = (
    "id string, url string, record_type string, refers_to string, payload_bytes long, payload_digest string,"
    " payload binary, intact boolean"
)
_END = b"\r\n\r\n"


def _field(value: str) -> str:
    return value.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A")


def _unfield(value: str) -> str:
    return value.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%")


def _name(key: str | None) -> str:
    return f"<urn:uuid:{uuid.uuid4()}>" if key is None else f"<urn:x-record:{_field(key)}>"


def _member(data: bytes, level: int) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def record(key, url, payload: bytes, size: int, digest: str, refers_to) -> bytes:
    """One WARC/1.1 record: response with its payload, or revisit with the HTTP header alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    revisit = refers_to is not None
    block = http if revisit else http + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {_name(key)}",
        "WARC-Date: 2024-01-01T00:00:00Z",
    ]
    if url is not None:
        lines.append(f"WARC-Target-URI: {_field(url)}")
    if revisit:
        lines += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: {_name(refers_to)}",
        ]
    lines += [
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(lines).encode() + _END + block + _END


def parsed(data: bytes) -> dict:
    """Fields of one record, and its payload (None for a revisit)."""
    import hashlib

    head, _, rest = data.partition(_END)
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(_END)
    size = int(dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:])["Content-Length"])
    revisit, digest = fields["WARC-Type"] == "revisit", fields["WARC-Payload-Digest"].removeprefix("sha1:")
    own = lambda s: _unfield(s[14:-1]) if s and s.startswith("<urn:x-record:") else None
    url = fields.get("WARC-Target-URI")
    return {
        "id": own(fields["WARC-Record-ID"]),
        "url": None if url is None else _unfield(url),
        "record_type": fields["WARC-Type"],
        "refers_to": own(fields.get("WARC-Refers-To")),
        "payload_bytes": size,
        "payload_digest": digest,
        "payload": None if revisit else payload,
        "intact": revisit or (len(payload) == size and hashlib.sha1(payload).hexdigest() == digest),
    }


def write(
    pages: DataFrame,
    key: str = "page_id",
    url: str = "url",
    payload: str = "html",
    least: int = 1000,
    folder: str | None = None,
    level: int = 3,
    roll_bytes: int = 1 << 30,
) -> DataFrame:
    """Archives of all rows of pages; returns the index (INDEX), read from its table."""
    spark = pages.sparkSession
    root = folder or new_folder(spark, "warc")
    body = F.coalesce(F.col(payload), F.lit("")).cast("binary")
    rows = pages.select(
        F.col(key).alias("_key"),
        F.col(url).cast("string").alias("url"),
        body.alias("_payload"),
        F.octet_length(body).cast("long").alias("_bytes"),
        F.sha1(body).alias("_digest"),
    )
    # One row per repeated payload: partial sums leave the tasks, never the payloads.
    held = (
        rows.where(F.col("_bytes") >= least)
        .groupBy("_digest")
        .agg(F.max("_key").alias("_holder"), F.count(F.lit(1)).alias("_n"))
        .where("_n > 1")
        .drop("_n")
    )
    held = written(spark, held, "warc-held")
    # Payloads are only exchanged where the repeated ones are too many to send, and then not the small ones, which all may share a digest.
    few = (
        (held.agg(F.sum(F.coalesce(F.octet_length(F.col("_holder").cast("string")), F.lit(0)) + 56)).first()[0] or 0)
        <= SENT_BYTES
    )
    large, small = rows.where(F.col("_bytes") >= least), rows.where(F.col("_bytes") < least)
    if few:
        rows = rows.join(F.broadcast(held), "_digest", "left")
    else:
        rows = large.join(held, "_digest", "left").unionByName(
            small.withColumn("_holder", F.lit(None).cast(pages.schema[key].dataType)),
        )
    refers = F.when((F.col("_bytes") >= least) & ~F.col("_key").eqNullSafe(F.col("_holder")), F.col("_holder"))
    rows = rows.select(
        F.col("_key").cast("string").alias("id"),
        "url",
        F.when(refers.isNull(), F.col("_payload")).alias("payload"),
        F.col("_bytes").alias("size"),
        F.col("_digest").alias("digest"),
        refers.cast("string").alias("refers_to"),
    )

    def append(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        schema = pa.schema(
            [(n, pa.int64() if t == "long" else pa.string()) for n, t in (c.split() for c in INDEX.split(", "))],
        )
        fs, base = opened(root)
        fs.create_dir(base, recursive=True)
        out, at, name = None, 0, ""
        try:
            for batch in batches:
                found = []
                for r in batch.to_pylist():
                    if out is None or at >= roll_bytes:
                        if out is not None:
                            out.close()
                        name, at = f"{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz", 0
                        out = fs.open_output_stream(f"{base}/{name}", compression=None)
                        info = b"software: trilune\r\nformat: WARC File Format 1.1\r\n"
                        head = f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: {_name(None)}\r\nWARC-Date: 2024-01-01T00:00:00Z\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(info)}\r\n\r\n"
                        at += out.write(m := _member(head.encode() + info + _END, level)) or len(m)
                    m = _member(
                        record(r["id"], r["url"], r["payload"] or b"", r["size"], r["digest"], r["refers_to"]),
                        level,
                    )
                    out.write(m)
                    found.append(
                        (
                            r["id"],
                            r["url"],
                            f"{root}/{name}",
                            at,
                            len(m),
                            r["size"],
                            r["digest"],
                            "response" if r["refers_to"] is None else "revisit",
                            r["refers_to"],
                        ),
                    )
                    at += len(m)
                if found:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, f.type) for c, f in zip(zip(*found, strict=True), schema, strict=True)],
                        schema=schema,
                    )
        finally:
            if out is not None:
                out.close()

    return written(spark, rows.mapInArrow(append, INDEX), "warc-index")


def read(
    index: DataFrame,
    block_bytes: int = 8 << 20,
    gap_bytes: int = 64 << 10,
    task_bytes: int = 32 << 20,
) -> DataFrame:
    """Records (RECORD) of the given index rows, and of no others.

    Blocks of an archive are dealt over the cluster, so many to a task as make task_bytes of what is wanted; in
    each, ranges less than gap_bytes apart are read at once, up to block_bytes.
    """
    wanted = index.select("archive", "offset", "length", (F.col("offset") / block_bytes).cast("long").alias("_block"))
    # A number of tasks that is asked for is not merged again by adaptive execution, for which the index is small.
    tasks = max(
        index.sparkSession.sparkContext.defaultParallelism,
        -(-(index.agg(F.sum("length")).first()[0] or 0) // task_bytes),
    )
    wanted = wanted.repartition(tasks, "archive", "_block").sortWithinPartitions("archive", "offset").drop("_block")

    def fetch(batches):
        import pyarrow as pa

        kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_()}
        schema = pa.schema([(n, kinds[t]) for n, t in (c.split() for c in RECORD.split(", "))])

        def runs():
            run: list = []
            for batch in batches:
                for a, o, n in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                    if run and (a != run[0][0] or o - (run[-1][1] + run[-1][2]) > gap_bytes or o + n - run[0][1] > block_bytes):
                        yield run
                        run = []
                    run.append((a, o, n))
            if run:
                yield run

        name, source = None, None
        try:
            for run in runs():
                if run[0][0] != name:
                    if source is not None:
                        source.close()
                    name = run[0][0]
                    fs, path = opened(name)
                    source = fs.open_input_file(path)
                first = run[0][1]
                data = source.read_at(run[-1][1] + run[-1][2] - first, first)
                yield pa.RecordBatch.from_pylist(
                    [parsed(zlib.decompress(data[o - first : o - first + n], 31)) for _, o, n in run],
                    schema=schema,
                )
        finally:
            if source is not None:
                source.close()

    return wanted.mapInArrow(fetch, RECORD)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    kind = pages.schema["page_id"].dataType
    return read(write(pages)).select(
        F.col("id").cast(kind).alias("page_id"),
        "payload_bytes",
        "payload_digest",
        "record_type",
        F.col("refers_to").cast(kind).alias("refers_to"),
        "intact",
    )


SQL = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
), h AS (
  SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS holder FROM p
)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 1000 AND page_id IS DISTINCT FROM holder AND holder IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id IS DISTINCT FROM holder THEN holder END AS refers_to,
  TRUE AS intact
FROM h
"""
