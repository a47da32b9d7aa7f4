"""File sources and sinks: JSON lines, delimited text, whole documents, judgments, runs, office and XML files."""

from __future__ import annotations

import json
import re
import zipfile
import zlib
from collections.abc import Callable
from io import BytesIO
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_jsonl(spark: SparkSession, path: str, schema, strict: bool = False, most: int = 0) -> DataFrame:
    """JSON lines; malformed ones are skipped, or fail if strict. most > 0 bounds the rows."""
    df = spark.read.schema(schema).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)
    return df.limit(most) if most else df


def malformed_jsonl(spark: SparkSession, path: str, schema) -> int:
    """How many lines read_jsonl skips."""
    kind = schema if isinstance(schema, T.StructType) else T._parse_datatype_string(schema)
    df = spark.read.schema(T.StructType([*kind.fields, T.StructField("_corrupt_record", T.StringType())])).json(path)
    return df.agg(F.count_if(F.col("_corrupt_record").isNotNull()), *[F.count(n) for n in kind.names]).first()[0]


def read_delimited(spark: SparkSession, path: str, schema, sep: str = "\t", header: bool = True) -> DataFrame:
    return spark.read.schema(schema).option("sep", sep).option("header", header).csv(path)


def read_qrels(spark: SparkSession, path: str) -> DataFrame:
    """query_id, doc_id, relevance of lines with exactly four fields and a whole number; of repeated pairs the last line."""
    lines = spark.read.text(path).select(
        "value",
        F.col("_metadata.file_path").alias("f"),
        F.monotonically_increasing_id().alias("n"),
    )
    f = F.split(F.trim("value"), r"\s+")
    rows = (
        lines.where(F.size(f) == 4)
        .select(f[0].alias("query_id"), f[2].alias("doc_id"), f[3].try_cast("int").alias("relevance"), "f", "n")
        .where("relevance is not null")
    )
    last = F.row_number().over(Window.partitionBy("query_id", "doc_id").orderBy(F.desc("f"), F.desc("n")))
    return rows.withColumn("_n", last).where("_n = 1").select("query_id", "doc_id", "relevance")


def read_run(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """query_id, rank, doc_id, score of a JSON array or JSON lines of {query_id, query, results: [{doc_id, score}]}."""
    schema = "query_id string, query string, results array<struct<doc_id: string, score: double>>"
    df = spark.read.schema(schema).option("multiLine", not lines).json(path)
    return df.select("query_id", F.posexplode("results").alias("i", "r")).select(
        "query_id",
        (F.col("i") + 1).alias("rank"),
        "r.doc_id",
        "r.score",
    )


def read_alignments(spark: SparkSession, path: str, header: bool = False) -> DataFrame:
    """e1, e2, confidence of tab-separated lines; those with fewer columns, or whose third is no number, are left out."""
    f = F.split("value", "\t")
    lines = spark.read.text(path)
    if header:
        lines = lines.where(~F.col("value").startswith("entity") & ~F.col("value").startswith("e1"))
    rows = lines.where(F.size(f) >= 3).select(
        f[0].alias("e1"),
        f[1].alias("e2"),
        f[2].try_cast("double").alias("confidence"),
    )
    return rows.where("confidence is not null")


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Entities and relations of an exported graph; ends may be called source and target or subject and object."""
    entity = "struct<id: string, name: string, type: string, language: string, description: string, aliases: array<string>>"
    relation = "struct<source: string, target: string, subject: string, object: string, type: string, confidence: double>"
    df = (
        spark.read.schema(f"entities array<{entity}>, relations array<{relation}>")
        .option("multiLine", True)
        .json(path)
    )
    e = df.select(F.posexplode("entities").alias("ord", "e")).select("e.*", F.col("ord").cast("long"))
    r = df.select(F.posexplode("relations").alias("ord", "r"))
    return e, r.select(F.coalesce("r.source", "r.subject").alias("src"), F.coalesce("r.target", "r.object").alias("dst"), F.col("r.type").alias("rel"), F.coalesce("r.confidence", F.lit(1.0)).alias("confidence"), F.col("ord").cast("long"))


def write_graph(entities: DataFrame, relations: DataFrame, path: str, base: str) -> None:
    """One JSON document, for graphs of a size to be read as one; larger ones are two tables."""
    e = entities.agg(
        F.sort_array(F.collect_list(F.struct("id", "name", "type", "language", "description", "aliases"))).alias(
            "entities",
        ),
    )
    r = relations.agg(
        F.sort_array(F.collect_list(F.struct(F.col("src").alias("source"), F.col("dst").alias("target"), F.col("rel").alias("type"), "confidence"))).alias(
            "relations",
        ),
    )
    (
        e.crossJoin(F.broadcast(r))
        .select(F.lit("1.0").alias("version"), F.lit(base).alias("base_uri"), "entities", "relations")
        .coalesce(1).write
        .json(path)
    )


def write_graph_lines(entities: DataFrame, relations: DataFrame, path: str) -> None:
    """The graph as JSON lines, each with the `entities` or the `relations` that it holds: as many files as there are parts, nothing is gathered."""
    e = entities.select(F.to_json(F.struct(F.array(F.struct("id", "name", "type", "language", "description", "aliases")).alias("entities"))).alias("value"))
    rel = F.struct(F.col("src").alias("subject"), F.col("dst").alias("object"), F.col("rel").alias("type"), "confidence")
    e.unionByName(relations.select(F.to_json(F.struct(F.array(rel).alias("relations"))).alias("value"))).write.mode("overwrite").text(path)


def read_graph_lines(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Entities and relations of such lines; a line may hold several. A line with entities gives these only, lines that are no JSON nothing."""
    entity = "struct<id: string, name: string, type: string, language: string, description: string, aliases: array<string>>"
    relation = "struct<source: string, target: string, subject: string, object: string, type: string, confidence: double>"
    df = spark.read.schema(f"entities array<{entity}>, relations array<{relation}>").json(path)
    e = df.select(F.explode("entities").alias("e")).select("e.*").withColumn("language", F.coalesce("language", F.lit("unknown")))
    r = df.where("entities is null").select(F.explode("relations").alias("r"))
    return e, r.select(
        F.coalesce("r.subject", "r.source").alias("src"),
        F.coalesce("r.object", "r.target").alias("dst"),
        F.col("r.type").alias("rel"),
        F.coalesce("r.confidence", F.lit(1.0)).alias("confidence"),
    )


def read_experiment(spark: SparkSession, path: str, tabs: bool = False) -> DataFrame:
    """learner_id, group, pre_score, post_score of a table with a header; a missing group is `control`, rows whose scores are no numbers are left out."""
    schema = "learner_id string, group string, pre_score string, post_score string"
    df = spark.read.schema(schema).option("header", True).option("enforceSchema", False).option("sep", "\t" if tabs else ",").csv(path)
    rows = df.select("learner_id", F.coalesce("group", F.lit("control")).alias("group"), *[F.expr(f"try_cast({c} as double)").alias(c) for c in ("pre_score", "post_score")])
    return rows.where("pre_score is not null and post_score is not null")


def write_results(rows: DataFrame, path: str) -> None:
    """Result rows as JSON lines, and as a CSV table with a header, under a folder."""
    rows.write.mode("overwrite").json(f"{path}/results")
    rows.write.mode("overwrite").option("header", True).csv(f"{path}/summary")


def _docx(data: bytes) -> str:
    """Paragraphs and table rows, cells joined by ' | '."""
    w = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    body = ElementTree.fromstring(zipfile.ZipFile(BytesIO(data)).read("word/document.xml")).find(f"{w}body")
    text = lambda x: "".join(t.text or "" for t in x.iter(f"{w}t"))
    out = []
    for x in body:
        if x.tag == f"{w}p":
            out.append(text(x))
        elif x.tag == f"{w}tbl":
            out += [" | ".join(text(c) for c in row.iter(f"{w}tc")) for row in x.iter(f"{w}tr")]
    return "\n".join(t for t in out if t.strip())


def _leaves(value) -> list[str]:
    if isinstance(value, dict):
        return [t for v in value.values() for t in _leaves(v)]
    if isinstance(value, list):
        return [t for v in value for t in _leaves(v)]
    return [] if value is None else [str(value)]


def _jsonl(data: bytes) -> str:
    """Per record its known text fields in a fixed order, or else all its strings; records parted by blank lines."""
    known = ("text", "content", "description", "title", "abstract")
    out = []
    for line in data.decode("utf-8", "replace").splitlines():
        try:
            r = json.loads(line)
        except ValueError:
            continue
        if isinstance(r, dict):
            parts = [r[k] for k in known if isinstance(r.get(k), str)] or [v for v in r.values() if isinstance(v, str)]
            out.append(" ".join(parts))
    return "\n\n".join(out)


def _plain(data: bytes) -> str:
    for code in ("utf-8", "gbk", "latin-1"):
        try:
            return data.decode(code)
        except UnicodeDecodeError:
            continue
    return ""


def _xlsx(data: bytes) -> str:
    """Every sheet under a banner with its name: rows as lines, cells joined by ' | '."""
    main = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
    link = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
    book = zipfile.ZipFile(BytesIO(data))
    root = lambda path: ElementTree.fromstring(book.read(path))
    text = lambda x: "".join(t.text or "" for t in x.iter(f"{main}t"))
    shared = [text(x) for x in root("xl/sharedStrings.xml")] if "xl/sharedStrings.xml" in book.namelist() else []
    targets = {x.get("Id"): x.get("Target").removeprefix("/xl/") for x in root("xl/_rels/workbook.xml.rels")}
    out = []
    for sheet in root("xl/workbook.xml").iter(f"{main}sheet"):
        lines = [f"=== 工作表: {sheet.get('name')} ==="]
        for row in root(f"xl/{targets[sheet.get(link)]}").iter(f"{main}row"):
            cells = []
            for c in row.iter(f"{main}c"):
                value = c.find(f"{main}v")
                if c.get("t") == "s" and value is not None:
                    cells.append(shared[int(value.text)])
                else:
                    cells.append(text(c) if c.get("t") == "inlineStr" else (value.text or "" if value is not None else ""))
            lines.append(" | ".join(cells))
        out.append("\n".join(lines))
    return "\n\n".join(out)


def _shown(data: bytes) -> str:
    """Text of the strings that streams show, a line per text block, of a file whose pages cannot be found."""
    out = []
    for stream in re.findall(rb"stream\r?\n(.*?)\r?\nendstream", data, re.S):
        try:
            stream = zlib.decompress(stream)
        except zlib.error:
            pass  # not compressed
        for block in re.findall(rb"BT\b(.*?)\bET\b", stream, re.S):
            shown = re.findall(rb"\(((?:[^()\\]|\\.)*)\)", block)
            plain = b"".join(re.sub(rb"\\([()\\])", rb"\1", x) for x in shown)
            out.append(plain.decode("utf-8", "replace") if plain[:2] != b"\xfe\xff" else plain.decode("utf-16", "replace"))
    return "\n".join(out)


def _pdf(data: bytes) -> str:
    """Text of all pages; of a damaged file, of its streams."""
    from trilune.sources import pdf

    return pdf.text(data) or _shown(data)


def _html(data: bytes) -> str:
    """What is to be read of a page: without scripts, styles and tags, entities decoded, blank lines left out."""
    import html

    body = re.sub(r"(?is)<script.*?</script>|<style.*?</style>", "", _plain(data))
    lines = (x.strip() for x in html.unescape(re.sub(r"(?s)<[^>]+>", "\n", body)).split("\n"))
    return "\n".join(x for x in lines if x)


#: Extension -> text of the file's bytes; callers may add their own.
EXTRACTORS: dict[str, Callable[[bytes], str]] = {
    "txt": _plain,
    "csv": _plain,
    "md": _plain,
    "docx": _docx,
    "xlsx": _xlsx,
    "pdf": _pdf,
    "html": _html,
    "htm": _html,
    "json": lambda b: " ".join(_leaves(json.loads(b))),
    "jsonl": _jsonl,
}


def documents_of(files: DataFrame, extractors: dict[str, Callable[[bytes], str]] | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """filename, size, file_type, checksum, doc_id, text, error of files (path, length, content) by extension, and the columns `keep`; unknown and empty ones have an error."""
    known = {**EXTRACTORS, **(extractors or {})}

    def extract(batches):
        for pdf in batches:
            texts, errors = [], []
            for kind, data in zip(pdf["file_type"], pdf["content"], strict=True):
                try:
                    text = known[kind](bytes(data))
                    texts.append(text)
                    errors.append(None if text.strip() else "empty")
                except Exception as e:  # a file that cannot be read is a row with its error
                    texts.append("")
                    errors.append(f"{type(e).__name__}: {e}")
            yield pdf.drop(columns="content").assign(text=texts, error=errors)

    name = F.element_at(F.split("path", "/"), -1)
    df = files.select(
        name.alias("filename"),
        F.col("length").alias("size"),
        F.lower(F.element_at(F.split(name, r"\."), -1)).alias("file_type"),
        F.md5("content").alias("checksum"),
        *keep,
        "content",
    )
    df = df.withColumn("doc_id", F.substring(F.md5(F.concat_ws("_", "filename", "checksum").cast("binary")), 1, 16))
    df = df.select("filename", "size", "file_type", "checksum", "doc_id", *keep, "content")
    schema = df.drop("content").withColumns({c: F.lit(None).cast("string") for c in ("text", "error")}).schema
    return df.mapInPandas(extract, schema)


def read_documents(
    spark: SparkSession,
    path: str,
    extractors: dict[str, Callable[[bytes], str]] | None = None,
) -> DataFrame:
    """All files under a folder by `documents_of`."""
    return documents_of(spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path), extractors)


def read_articles(spark: SparkSession, path: str) -> DataFrame:
    """Records of a bibliographic XML file with rows <PubmedArticle>; those without id or title are left out."""
    schema = (
        "MedlineCitation struct<PMID: string, Article: struct<ArticleTitle: string,"
        " Abstract: struct<AbstractText: string>, AuthorList: struct<Author: array<struct<ForeName: string,"
        " LastName: string>>>, Journal: struct<JournalIssue: struct<PubDate: struct<Year: string>>>>>"
    )
    df = (
        spark.read.format("xml")
        .option("rowTag", "PubmedArticle")
        .schema(schema)
        .load(path)
        .select("MedlineCitation.PMID", "MedlineCitation.Article.*")
    )
    tidy = lambda c: F.trim(F.regexp_replace(F.regexp_replace(c, r"<[^>]+>", ""), r"\s+", " "))
    return df.where("PMID is not null and ArticleTitle is not null").select(
        F.concat(F.lit("pubmed_"), "PMID").alias("id"),
        tidy(F.col("ArticleTitle")).alias("title"),
        F.transform("AuthorList.Author", lambda a: F.concat_ws(" ", a["ForeName"], a["LastName"])).alias("authors"),
        tidy(F.col("Abstract.AbstractText")).alias("content"),
        F.col("Journal.JournalIssue.PubDate.Year").alias("publish_date"),
        F.lit("en").alias("language"),
    )


def merged(
    sources: list[tuple[str, DataFrame]],
    per_source: int | None,
    most: int | None,
    title: str = "title",
) -> DataFrame:
    """A federated search: at most per_source rows of each, of equal trimmed lower-cased titles the first in order of sources, at most `most` in all; None is no limit."""
    out = None
    for i, (name, df) in enumerate(sources):
        x = (
            (df if per_source is None else df.limit(per_source))
            .withColumn("source", F.lit(name))
            .withColumn("_s", F.lit(i))
        )
        out = x if out is None else out.unionByName(x, allowMissingColumns=True)
    first = F.row_number().over(Window.partitionBy(F.lower(F.trim(title))).orderBy("_s", title))
    out = out.withColumn("_n", first).where("_n = 1").orderBy("_s", title)
    return (out if most is None else out.limit(most)).drop("_n", "_s")


def upserted(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Insert or replace by key."""
    return old.join(new.select(key), key, "left_anti").unionByName(new)
