"""Audit of how filters interact: what each removes alone, after the others, and needlessly, for every order of them.

Native expressions give each text a mask with a bit per filter that it fails. Whether a text repeats one of
a smaller id is told by the smallest id per text, from a groupBy over texts, which stand as their SHA-256.
The rows of a part are then summed to one cell per mask, 32 of them for five filters, and everything about every order
of the filters follows from the cells: no row is read a second time.

Rows with the same id are each counted. A null text is an empty one, a null part the empty text. A null id repeats
nothing and makes nothing a repeat; it has no label. Of several labels of an id, one that says so is enough.
Empty tables give no rows. Other columns are not used, whatever they are called.

Copies of one text are pre-aggregated where they are read, then by text, part and mask, so that a group of copies
of any size is a row per part in the window that finds its smallest id.
"""

from __future__ import annotations

import json
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trilune.llm.common import WORD, table




def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def few_words(text: Column, least: int = 200) -> Column:
    return F.size(words(text)) < least


def few_distinct(text: Column, percent: int = 50) -> Column:
    """Distinct words below that share of all words."""
    w = words(text)
    return 100 * F.size(F.array_distinct(w)).cast("long") < percent * F.size(w).cast("long")


def many_capitals(text: Column, percent: int = 3) -> Column:
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    return 100 * capitals.cast("long") > percent * F.length(text).cast("long")


def odd_symbols(text: Column, symbols: str = "[#$%&*|]") -> Column:
    return text.rlike(symbols)


#: Filters over the text alone, by letter; the last letter is that of repeated texts.
FILTERS = {"A": few_words, "B": few_distinct, "C": many_capitals, "D": odd_symbols}
REPEATED = "E"


def masked(docs: DataFrame, key: str, text: str, part: str, filters: dict) -> DataFrame:
    """_id, _part, _text (its digest) and _mask: the bits of the filters, in order, that the text fails."""
    of = F.coalesce(F.col(text), F.lit(""))
    bits = [F.when(fails(of), F.lit(1 << i)).otherwise(F.lit(0)) for i, fails in enumerate(filters.values())]
    return docs.select(
        F.col(key).alias("_id"),
        F.coalesce(F.col(part).cast("string"), F.lit("")).alias("_part"),
        F.unhex(F.sha2(of.cast("binary"), 256)).alias("_text"),
        sum(bits, F.lit(0)).alias("_mask"),
    )


def cells(
    docs: DataFrame,
    labels: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    part: str = "lang",
    filters: dict | None = None,
    good: str = "quality",
    toxic: str = "toxic",
) -> DataFrame:
    """One row per part and mask that occurs: part, mask, n, n_good, n_toxic (long). The highest bit is that of repeats."""
    filters = FILTERS if filters is None else filters
    rows = masked(docs, key, text, part, filters).groupBy("_id", "_part", "_text", "_mask").agg(F.count("*").alias("_n"))
    said = (
        labels.select(F.col(key).alias("_id"), F.col(good).alias("_good"), F.col(toxic).alias("_toxic"))
        .where("_id is not null and (_good = 1 or _toxic = 1)")
        .groupBy("_id")
        .agg(*[F.coalesce(F.max(F.col(c) == 1), F.lit(False)).cast("long").alias(c) for c in ("_good", "_toxic")])
    )
    none = F.lit(0).cast("long")
    told = rows.join(said, "_id", "left").withColumns({c: F.col("_n") * F.coalesce(F.col(c), none) for c in ("_good", "_toxic")})
    sums = ("_n", "_good", "_toxic")
    # Of a text and part: all rows, those of its smallest id, and those without an id.
    by_text = told.groupBy("_text", "_part", "_mask").agg(
        *[F.sum(c).alias(c) for c in sums],
        F.min(F.when(F.col("_id").isNotNull(), F.struct("_id", *sums))).alias("_least"),
        F.sum(F.when(F.col("_id").isNull(), F.col("_n"))).alias("_nameless"),
    )
    by_text = by_text.withColumn("_first", F.min("_least._id").over(Window.partitionBy("_text")))
    own = {c: F.coalesce(F.when(F.col("_least._id") == F.col("_first"), F.col(f"_least.{c}")), none) for c in sums}
    own["_n"] = own["_n"] + F.coalesce(F.col("_nameless"), none)
    split = by_text.withColumn(
        "_cell",
        F.explode(
            F.array(
                F.struct(F.col("_mask").alias("mask"), *[own[c].alias(c) for c in sums]),
                F.struct(
                    F.col("_mask").bitwiseOR(F.lit(1 << len(filters))).alias("mask"),
                    *[(F.col(c) - own[c]).alias(c) for c in sums],
                ),
            ),
        ),
    )
    return (
        split.where("_cell._n > 0")
        .groupBy(F.col("_part").alias("part"), F.col("_cell.mask").alias("mask"))
        .agg(F.sum("_cell._n").alias("n"), F.sum("_cell._good").alias("n_good"), F.sum("_cell._toxic").alias("n_toxic"))
    )


def rules(letters: str) -> list[tuple[int, str, int, int, int, int, int, int]]:
    """For each mask, order and step: whether such a row is kept after the step, removed in it, redundant, fails nothing else, and its part in the Shapley sum.

    Over all orders, a row of b failed filters is removed by each of them equally often: in 1 of b.
    """
    orders, out = ["".join(p) for p in permutations(letters)], []
    for mask in range(1 << len(letters)):
        failed = {c for i, c in enumerate(letters) if mask >> i & 1}
        for order in orders:
            for at, letter in enumerate(order):
                fails, before = letter in failed, bool(failed & set(order[:at]))
                share = factorial(len(letters)) // len(failed) if fails else 0
                flags = (not before and not fails, fails and not before, fails and before, failed == {letter})
                out.append((mask, order, at + 1, *map(int, flags), share))
    return out


def audit(found: DataFrame, letters: str) -> DataFrame:
    """Per part, order and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley, from the cells.

    The rules are a table of fixed size, 2 ** n * n! * n rows for n filters (at most 6: 276480), which meets the cells by mask.
    """
    if not 0 < len(letters) <= 6:
        raise ValueError("one to six filters: all orders of them are listed")
    spark, schema = found.sparkSession, "mask int, filter_order string, step int, _kept long, _removed long, _redundant long, _only long, _share long"
    by_mask = F.broadcast(spark.createDataFrame(rules(letters), schema))
    total = lambda flag, of: F.sum(F.col(flag) * F.col(of))
    return (
        found.join(by_mask, "mask")
        .groupBy("part", "filter_order", "step")
        .agg(
            total("_kept", "n").alias("kept"),
            total("_removed", "n").alias("removed"),
            total("_redundant", "n").alias("redundant"),
            total("_only", "n").alias("unique_fails"),
            total("_removed", "n_good").alias("good_lost"),
            total("_removed", "n_toxic").alias("toxic_lost"),
            total("_share", "n").alias("shapley"),
        )
    )


def query(spark, sf_dir: str) -> DataFrame:
    found = cells(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return audit(found, "".join(FILTERS) + REPEATED)


_LETTERS = json.dumps([*FILTERS, REPEATED]).replace('"', "'")

SQL = rf"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM documents
), f AS (
  SELECT doc_id, part,
    len(w) < 200 AS a,
    100 * len(list_distinct(w)) < 50 * len(w) AS b,
    100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text) AS c,
    regexp_matches(text, '[#$%&*|]') AS d,
    coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false) AS e
  FROM d
), g AS (
  SELECT part, [a, b, c, d, e] AS fails,
    coalesce(doc_id IN (SELECT doc_id FROM labels WHERE quality = 1), false) AS good,
    coalesce(doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1), false) AS toxic
  FROM f
), cells AS (
  SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS n_good, count(*) FILTER (toxic) AS n_toxic FROM g GROUP BY ALL
), l AS (SELECT unnest({_LETTERS}) AS x), orders AS (
  SELECT p.x || q.x || r.x || s.x || t.x AS filter_order FROM l p, l q, l r, l s, l t
  WHERE p.x NOT IN (q.x, r.x, s.x, t.x) AND q.x NOT IN (r.x, s.x, t.x) AND r.x NOT IN (s.x, t.x) AND s.x <> t.x
), o AS (
  SELECT part, n, n_good, n_toxic, fails, filter_order, step::INTEGER AS step,
    list_transform(string_split(filter_order, ''), lambda y: fails[ascii(y) - 64]) AS by_step
  FROM cells, orders, range(1, 6) AS steps(step)
), m AS (
  SELECT *, by_step[step] AS own, list_contains(by_step[1:step - 1], true) AS earlier,
    substr(filter_order, step, 1) AS letter, len(list_filter(fails, lambda y: y)) AS failed FROM o
), r AS (
  SELECT part, filter_order, step, letter,
    coalesce(sum(n) FILTER (NOT own AND NOT earlier), 0)::BIGINT AS kept,
    coalesce(sum(n) FILTER (own AND NOT earlier), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER (own AND earlier), 0)::BIGINT AS redundant,
    coalesce(sum(n) FILTER (own AND failed = 1), 0)::BIGINT AS unique_fails,
    coalesce(sum(n_good) FILTER (own AND NOT earlier), 0)::BIGINT AS good_lost,
    coalesce(sum(n_toxic) FILTER (own AND NOT earlier), 0)::BIGINT AS toxic_lost
  FROM m GROUP BY ALL
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  (sum(removed) OVER (PARTITION BY part, letter))::BIGINT AS shapley
FROM r
"""
