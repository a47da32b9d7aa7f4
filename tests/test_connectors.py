"""Connectors, stores and the scheduler, by hand."""

import json
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from trilune.operators import kg as K
from trilune.operators import scheduling as S
from trilune.sources import connectors as C
from trilune.sources import files
from trilune.sources import stores


def test_limiter_waits_for_the_rest_of_the_interval():
    now, slept = [0.0], []
    limiter = C.RateLimiter(2, clock=lambda: now[0], sleep=slept.append)
    limiter.wait()
    now[0] = 0.2
    limiter.wait()
    now[0] = 5.0
    limiter.wait()
    assert slept == [pytest.approx(0.3)]


def test_retries_wait_longer_and_end():
    calls, slept = [], []

    def call():
        calls.append(1)
        if len(calls) < 3:
            raise C.NotNow
        return "got"

    assert C.with_retries(call, 3, 1.0, slept.append) == "got" and slept == [1.0, 2.0]
    with pytest.raises(C.NotNow):
        calls.clear()
        C.with_retries(call, 2, 1.0, slept.append)
    with pytest.raises(ValueError):
        C.with_retries(lambda: int("x"), 3, 1.0, slept.append)


def test_connector_reads_pages_in_tasks(spark, tmp_path):
    for i in range(3):
        rows = [{"id": f"{i}-{k}", "title": f"t{k}", "more": 1} for k in range(4)]
        (tmp_path / f"{i}.json").write_text("\n".join(map(json.dumps, rows)))
    spark.dataSource.register(C.JsonFolder)
    df = spark.read.format("json_folder").option("folder", str(tmp_path)).option("persecond", "1000").load()
    assert df.columns == ["id", "title", "content", "source", "url", "language"] and df.rdd.getNumPartitions() == 3
    assert sorted(r.id for r in df.collect()) == [f"{i}-{k}" for i in range(3) for k in range(4)]


def test_run_keeps_failures_apart(spark):
    told, alerts = [], []
    tasks = spark.createDataFrame(
        [("a", "n", "good"), ("b", "n", "bad"), ("c", "n", "none")],
        "task_id string, name string, task_type string",
    )

    def broken(row):
        told.append(row[1])
        if row[1] == "a":
            raise RuntimeError("callback")

    actions = {"good": lambda t: 3, "bad": lambda t: 1 / 0}
    got = {
        r.task_id: (r.status, r.error)
        for r in S.run(tasks, actions, 100, (broken,), lambda k, e: alerts.append((k, e))).collect()
    }
    assert got == {"a": ("completed", None), "b": ("failed", "division by zero"), "c": ("failed", "no action for none")}
    assert told == ["a", "b", "c"] and ("a", "callback") in alerts and len(alerts) == 3


def test_cancelled_and_timed_out(spark):
    rows = [
        ("1", "a", "running", 0, None, None),
        ("2", "a", "completed", 0, 5, None),
        ("3", "b", "running", 90, None, None),
    ]
    e = spark.createDataFrame(rows, S.EXECUTIONS)
    assert {r.execution_id: r.status for r in S.cancelled(e, "a", 100).collect()} == {"1": "cancelled", "2": "completed", "3": "running"}
    t = spark.createDataFrame([("a", 50), ("b", 50)], "task_id string, timeout long")
    assert {r.execution_id: r.error for r in S.timed_out(t, e, 100).collect()} == {"1": "timeout", "2": None, "3": None}


def test_stores_refuse_unknown_columns(spark, tmp_path):
    folder = f"file://{tmp_path}/store"
    stores.create(spark, folder)
    stores.create(spark, folder)
    assert all(stores.read(spark, folder, n).count() == 0 for n in stores.TABLES)
    with pytest.raises(ValueError):
        stores.append(spark.createDataFrame([("x", 1)], "doc_id string, wrong int"), folder, "documents")
    assert stores.exists(spark, folder) and not stores.exists(spark, folder + "-none")


def test_corpus_skips_missing_files(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": "1"}\n{"id": "2"}\n')
    found = stores.corpus(
        spark,
        [f"file://{tmp_path}/a.jsonl", f"file://{tmp_path}/none.jsonl"],
        "id string, text string",
    )
    assert found.count() == 2 and stores.corpus(spark, [], "id string").count() == 0
    assert stores.line_count(spark, f"file://{tmp_path}/a.jsonl") == 2
    (tmp_path / "s.yaml").write_text("a: {b: 1}\n")
    (tmp_path / "empty.yaml").write_text("")
    assert stores.settings(str(tmp_path / "s.yaml")) == {"a": {"b": 1}} and stores.settings(str(tmp_path / "empty.yaml")) is None
    assert tuple(stores.folder_statistics(spark, f"file://{tmp_path}").first())[0] == 2  # the empty file is none


def test_unsupported_language_fails(spark):
    with pytest.raises(Exception, match="unsupported language"):
        spark.createDataFrame([("xx",)], "l string").select(K.checked_language(F.col("l"))).collect()


def test_spreadsheets_pdf_and_pages(spark, tmp_path):
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    link = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    with zipfile.ZipFile(tmp_path / "a.xlsx", "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {main} {link}><sheets><sheet name="One" r:id="x"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="x" Target="worksheets/s.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {main}><si><t>name</t></si></sst>")
        rows = '<row><c t="s"><v>0</v></c><c t="inlineStr"><is><t>n</t></is></c></row><row><c><v>4.5</v></c><c/></row>'
        z.writestr("xl/worksheets/s.xml", f"<worksheet {main}><sheetData>{rows}</sheetData></worksheet>")
    shown = zlib.compress(rb"BT /F1 12 Tf (Hello \(you\)) Tj ET BT [(a) -3 (b)] TJ ET")
    (tmp_path / "b.pdf").write_bytes(b"%PDF-1.4\nstream\n" + shown + b"\nendstream")
    (tmp_path / "c.html").write_text("<html><script>no</script><p>A &amp; B</p>\n<p>C</p></html>")
    (tmp_path / "d.xyz").write_text("?")
    got = {r.filename: (r.text, r.error is None) for r in files.read_documents(spark, f"file://{tmp_path}").collect()}
    assert got["a.xlsx"] == ("=== 工作表: One ===\nname | n\n4.5 | ", True)
    assert got["b.pdf"] == ("Hello (you)\nab", True)
    assert got["c.html"] == ("A & B\nC", True)
    assert not got["d.xyz"][1]
