"""The pipeline and its stages with nulls, empty tables, repeated ids, ties, long texts and clashing columns."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as p

CLASH = ["copy", "score", "predicted", "part", "component_id", "n_removed", "size", "rate", "_text_hash", "id"]


def words(r, n):
    return " ".join("".join(r.choices("abcdefghijklmnop", k=r.randint(3, 8))) for _ in range(n))


def write(spark, folder, docs, labels=(), bench=()):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    df = spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in docs], schema)
    df = df.select("*", *[F.concat(F.lit(f"{c}-"), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))).alias(c) for c in CLASH])
    df.repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(list(labels), "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(list(bench), "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return df


def test_odd_rows_have_their_defined_results(spark, tmp_path):
    r = random.Random(5)
    long, passage, item = words(r, 30_000), words(r, 40), words(r, 20)
    near = words(r, 300)
    docs = [
        (1, None, "s"),
        (2, "", None),
        (3, " \n\t ", "s"),
        (None, words(r, 50), "s"),
        (None, None, None),
        (4, near, "a"),
        (5, near + " more", "a"),  # near 4
        (6, near, "b"),  # a copy of 4
        (4, near, "a"),  # a repeated row
        (7, f"{words(r, 30)} {passage} {words(r, 30)}", "a"),
        (8, f"{words(r, 30)} {passage} {words(r, 30)}", "a"),  # holds 7's passage
        (9, passage.split(" ", 1)[1], "b"),  # nothing but that passage
        (10, f"{words(r, 10)} {item}", "b"),  # contaminated
        (11, long, "b"),
        (12, "one two", "b"),
    ]
    folder = f"file://{tmp_path}"
    df = write(spark, folder, docs, bench=[(1, item), (2, None), (None, "")])
    kept, stages = spark.read.parquet(f"{folder}/documents.parquet"), {}
    for name, stage in p.STAGES[:-1]:
        kept = stage(spark, kept, folder)
        assert kept.columns == df.columns
        stages[name] = kept.collect()
        kept = spark.createDataFrame(stages[name], df.schema)
    ids = lambda name: sorted((x.doc_id is None, x.doc_id or 0) for x in stages[name])
    every = sorted((i is None, i or 0) for i, *_ in docs)
    assert ids("toxicity") == every
    assert ids("jaccard_join") == [x for x in every if x[1] not in (5, 6)]
    assert ids("substring_dedup") == [x for x in every if x[1] not in (5, 6, 9)]
    assert ids("contamination") == [x for x in every if x[1] not in (5, 6, 9, 10)]
    texts = {x.doc_id: x.text for x in stages["contamination"] if x.doc_id}
    assert passage in texts[7] and passage not in texts[8] and len(texts[8].split()) == 60
    assert texts[1] is None and texts[2] == "" and texts[11] == long
    assert {x.doc_id: x.n_chars for x in stages["contamination"] if x.doc_id == 8} == {8: len(texts[8])}
    out = p.run(spark, folder)
    assert out.columns == [*df.columns, "copy_"]
    rows = out.collect()
    assert {x.doc_id for x in rows} <= {x.doc_id for x in stages["contamination"]}
    wrong = {(c, x.doc_id, x[c]) for x in rows for c in CLASH if x[c] != f"{c}-{x.doc_id or chr(110) + chr(111) + chr(110) + chr(101)}"}
    assert not wrong
    assert sorted(map(str, p.run(spark, folder).collect())) == sorted(map(str, rows))


@pytest.mark.parametrize("docs", [[], [(1, None, None)], [(None, "a b c", "s")] * 3])
def test_small_tables(spark, tmp_path, docs):
    folder = f"file://{tmp_path}"
    df = write(spark, folder, docs)
    for _, stage in p.STAGES[:-1]:
        assert stage(spark, df, folder).count() == len(docs)
    got = p.run(spark, folder)
    assert got.columns == [*df.columns, "copy_"]
    assert {x.doc_id for x in got.collect()} <= {i for i, *_ in docs}
