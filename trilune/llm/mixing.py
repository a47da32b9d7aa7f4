"""Mixing sources to target weights, with DataFrame operations only.

Tokens are summed per source, targets follow from weights, and the repetition
rate of a source is target / size. Each document is emitted floor(rate) times
plus one copy with probability rate - floor(rate), decided by a hash of its id, or of its text where
it has none, so that reruns agree whatever the partitioning.

Rows with a null text have size 0. A null source is a source of its own. Rows with the same id, or without
one and with the same text, draw alike: ties are decided together. Empty tables give empty results.
Names of columns never clash inside, whatever documents' columns are called.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trilune.llm.common import SENT_BYTES, WORD, written


def word_count(text):
    """Words of a text, 0 for null or empty ones."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights=(5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """One row per source (_source, source_size) -> also target and rate.

    Sources in order of code point, null last, weigh `weights`, repeated. They share
    `share` times all sizes; a target stops at `most` times its source's size, and
    what is above is shared again by weight until no target is above. That fixed
    point is found in one pass: in order of the level at which sources fill up,
    one is full exactly if its part of what the fuller ones leave exceeds its limit.
    The two ordered windows hold one row per source, the aggregate of all its documents.
    A source without words has target 0.
    """
    by_name = Window.orderBy(F.col("_source").isNull(), F.col("_source").cast("binary"))
    turn = (F.row_number().over(by_name) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int"))
    level = F.col("_limit") / F.col("_weight")
    fuller = Window.orderBy("_level", F.col("_source").isNull(), F.col("_source").cast("binary"))
    before = fuller.rowsBetween(Window.unboundedPreceding, -1)
    everything = fuller.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = lambda c, total: total - F.coalesce(F.sum(c).over(before), F.lit(0.0))
    out = (
        sizes.withColumn("_limit", F.col("source_size") * F.lit(float(most)))
        .withColumn("_weight", weight)
        .withColumn("_level", level)
        .withColumn("_words", left("_limit", F.sum("source_size").over(everything) * F.lit(float(share))))
        .withColumn("_weights", left("_weight", F.sum("_weight").over(everything)))
        .withColumn("_full", F.col("_limit") * F.col("_weights") <= F.col("_weight") * F.col("_words"))
    )
    # What the first source that isn't full finds left is left for all of them.
    rest = Window.partitionBy("_full")
    return out.select(
        "_source",
        "source_size",
        F.when(F.col("_full"), F.col("_limit"))
        .otherwise(F.col("_weight") * F.max("_words").over(rest) / F.max("_weights").over(rest))
        .alias("target"),
    ).withColumn("_rate", F.coalesce(F.try_divide("target", "source_size"), F.lit(0.0)))


def draw(key, text, seed: str = "mix"):
    """A number from [0, 1) that depends on the key's text, or for null keys on the text, and on the seed alone."""
    own = F.coalesce(key.cast("string"), F.concat(F.lit("text:"), F.md5(F.coalesce(text, F.lit("")).cast("binary"))))
    hashed = F.md5(F.concat(F.lit(seed + ":"), own).cast("binary"))
    return F.conv(F.substring(hashed, 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


RESULTS = ("size", "source_size", "target", "rate", "copies")


def _mixed(
    docs: DataFrame,
    key: str,
    text: str,
    source: str,
    size: str | None,
    weights,
    share: float,
    most: float,
    salts: int = 32,
) -> DataFrame:
    """docs' columns as c0, c1 ... and RESULTS with a leading underscore.

    A source's rate reaches its rows by a broadcast, if the sources' table is small, so that no document is exchanged. A larger
    one is joined by source and salt, so that a source with many rows is many tasks.
    """
    at = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    plain = docs.toDF(*at.values())
    words = word_count(F.col(at[text])) if size is None else F.col(at[size])
    sized = plain.withColumn("_size", words)
    sizes = sized.groupBy(F.col(at[source]).alias("_source")).agg(F.sum("_size").alias("source_size"))
    goal = written(docs.sparkSession, targets(sizes, weights, share, most), "rates")
    goal = goal.select("_source", F.col("source_size").alias("_source_size"), F.col("target").alias("_target"), "_rate")
    few = (
        (goal.agg(F.sum(F.coalesce(F.octet_length(F.col("_source").cast("string")), F.lit(0)) + 40)).first()[0] or 0)
        <= SENT_BYTES
    )
    same = F.col(at[source]).eqNullSafe(F.col("_source"))
    if few:
        rows = sized.join(F.broadcast(goal), same)
    else:
        rows = sized.withColumn("_salt", F.pmod(F.xxhash64(*at.values()), F.lit(salts)))
        rows = rows.join(
            goal.withColumn("_of", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))),
            same & (F.col("_salt") == F.col("_of")),
        )
    extra = (draw(F.col(at[key]), F.col(at[text])) < F.col("_rate") - F.floor("_rate")).cast("long")
    return rows.withColumn("_copies", F.floor("_rate") + extra)


def mixed(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
    size: str | None = None,
    weights=(5, 2, 1),
    share: float = 1.5,
    most: float = 2.0,
) -> DataFrame:
    """All rows and columns of docs, with size, source_size, target, rate and copies (0, 1, 2 ...), which replace columns of these names.

    `size` names a column that holds the sizes already.
    """
    out = _mixed(docs, key, text, source, size, weights, share, most)
    kept = [F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns) if c not in RESULTS or c in (key, text, source)]
    return out.select(*kept, *[F.col(f"_{c}").alias(c) for c in RESULTS])


def emitted(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights=(5, 2, 1),
    share: float = 1.5,
    most: float = 2.0,
    number: str = "copy",
) -> DataFrame:
    """The mix itself: each row of docs, with all its columns, as often as it is taken, with its copy number from 0 on; `number` names that, with underscores behind it while docs has such a column."""
    out = _mixed(docs, key, text, source, None, weights, share, most)
    while number in docs.columns:
        number += "_"
    kept = [F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)]
    return out.where("_copies > 0").select(
        *kept,
        F.explode(F.sequence(F.lit(0), (F.col("_copies") - 1).cast("int"))).alias(number),
    )


def query(spark, sf_dir: str) -> DataFrame:
    from trilune.llm.common import table

    # Words are counted once; texts are only needed again for documents without an id.
    docs = table(spark, sf_dir, "documents")
    sized = written(
        spark,
        docs.select(
            "doc_id",
            F.when(F.col("doc_id").isNull(), F.col("text")).alias("text"),
            "source",
            word_count(F.col("text")).alias("words"),
        ),
        "sized",
    )
    return mixed(sized, size="words").select(
        "doc_id",
        "size",
        "source_size",
        "target",
        (F.col("size") * F.col("copies")).alias("taken"),
    )


_SQL_WORD = r"[^\x20\x09-\x0D]+"

SQL = rf"""
WITH d AS (
  SELECT doc_id, source, md5(coalesce(text, '')) AS text_md5, coalesce(len(regexp_extract_all(text, '{_SQL_WORD}')), 0)::BIGINT AS size FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source
), w AS (
  SELECT *, 2.0::DOUBLE * source_size AS lim,
    [5.0::DOUBLE, 2.0, 1.0][1 + (row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3] AS weight FROM s
), o AS (
  SELECT *, 1.5::DOUBLE * (SELECT sum(source_size) FROM s)::DOUBLE
      - coalesce(sum(lim) OVER b, 0) AS words,
    (SELECT sum(weight) FROM w) - coalesce(sum(weight) OVER b, 0) AS weights
  FROM w WINDOW b AS (ORDER BY lim / weight, source IS NULL, encode(source) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), f AS (SELECT *, lim * weights <= weight * words AS is_full FROM o),
t AS (
  SELECT source, source_size, CASE WHEN is_full THEN lim
    ELSE weight * (max(words) OVER (PARTITION BY is_full)) / (max(weights) OVER (PARTITION BY is_full)) END AS target FROM f
), r AS (
  SELECT d.doc_id, d.size, t.source_size, t.target,
    CASE WHEN t.source_size = 0 THEN 0 ELSE t.target / t.source_size END AS rate,
    ('0x' || substr(md5('mix:' || coalesce(d.doc_id::VARCHAR, 'text:' || d.text_md5)), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0::DOUBLE AS u
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target, size * (floor(rate)::BIGINT + (u < rate - floor(rate))::BIGINT) AS taken FROM r
"""
