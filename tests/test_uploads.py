"""Files as a stream into the store."""

import pytest
from pyspark.sql import functions as F

from trilune.streaming import uploads as U


def put(folder, **files):
    folder.mkdir(parents=True, exist_ok=True)
    for name, data in files.items():
        stem, kind = name.rsplit("_", 1)
        (folder / f"{stem}.{kind}").write_bytes(data if isinstance(data, bytes) else data.encode())


def test_a_second_run_takes_new_files_only(spark, tmp_path):
    inbox, store = tmp_path / "in", f"file://{tmp_path}/store"
    put(inbox, a_txt="A long enough text about gardens, houses and the people in them. " * 3, b_json='{"text": "short"}', c_json="{broken", d_qqq="x")
    put(inbox / "deep", e_txt="Une autre page.", f_txt="")
    U.ingest(spark, f"file://{inbox}", store)
    first = {r.filename: r for r in U.rows(spark, store).collect()}
    assert {n: r.status for n, r in first.items()} == {"a.txt": "success", "b.json": "success", "c.json": "error", "d.qqq": "error", "e.txt": "success"}
    assert first["a.txt"].valid and first["a.txt"].language == "en" and first["a.txt"].quality_score == 1.0 and not first["b.json"].valid
    assert first["a.txt"].text == first["a.txt"].original_text.strip().lower() and first["c.json"].text is None and "JSON" in first["c.json"].error
    U.ingest(spark, f"file://{inbox}", store)
    assert U.rows(spark, store).count() == len(first)
    put(inbox, g_txt="new text", h_txt="more")
    put(inbox / "again", e_txt="Une autre page.")
    U.ingest(spark, f"file://{inbox}", store)
    added = U.rows(spark, store).where("batch > 0").collect()
    assert sorted(r.filename for r in added) == ["e.txt", "g.txt", "h.txt"]
    names = [r.filename for r in U.documents(spark, store).collect()]
    assert sorted(names) == ["a.txt", "b.json", "e.txt", "g.txt", "h.txt"]


def test_a_batch_that_failed_is_taken_again_and_once(spark, tmp_path):
    inbox, store = tmp_path / "in", f"file://{tmp_path}/store"
    put(inbox, a_txt="one", b_txt="two", c_txt="three")
    calls = []
    real = U.processed

    def failing(files, extractors=None):
        calls.append(1)
        out = real(files, extractors)
        if len(calls) == 2:  # the second batch fails when half of it is written
            return out.withColumn("size", F.when(F.col("filename") > "a", F.raise_error(F.lit("stopped"))).otherwise(F.col("size")).cast("long"))
        return out

    with pytest.MonkeyPatch.context() as m:
        m.setattr(U, "processed", failing)
        with pytest.raises(Exception, match="stopped"):
            U.ingest(spark, f"file://{inbox}", store, files_per_batch=1)
    U.ingest(spark, f"file://{inbox}", store, files_per_batch=1)
    got = U.rows(spark, store).collect()
    assert sorted(r.text for r in got) == ["one", "three", "two"] and {r.batch for r in got} == {0, 1, 2}


def test_callers_add_extractors(spark, tmp_path):
    put(tmp_path / "in", a_rev="cba", b_rev="")
    U.ingest(spark, f"file://{tmp_path}/in", f"file://{tmp_path}/store", {"rev": lambda b: b.decode()[::-1]})
    assert {(r.text, r.error) for r in U.rows(spark, f"file://{tmp_path}/store").collect()} <= {("abc", None), (None, "empty")}
