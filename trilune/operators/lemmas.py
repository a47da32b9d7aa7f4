"""Lemmas without a model: rules that rewrite endings, induced from pairs of words of the corpus.

A rule s -> t says that words in s stand beside words in t on the same stem. Its support is the number of stems that have both. Only the
`endings` commonest endings of a language make rules, so a stem gives at most that many squared pairs, however many words share it. Of an
ending the rule to a shorter one with the most support holds, if that is enough. A word's lemma is what the rule of its longest
ending makes of it, if that is a word of the corpus too; else the word is its own.

words: language, word, n. Null languages are a language of their own. Ties go to the ending first in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trilune.sources.tables import stored

#: Letters of the longest ending, and of the shortest stem.
LONGEST, STEM = 3, 3


def cuts(words: DataFrame) -> DataFrame:
    """words with each way to cut them: stem, ending."""
    n = F.length("word")
    pieces = [
        F.when(n >= STEM + k, F.struct(F.substring("word", F.lit(1), n - k).alias("stem"), F.right("word", F.lit(k)).alias("ending")))
        for k in range(LONGEST + 1)
    ]
    return words.withColumn("_c", F.explode(F.array_compact(F.array(*pieces)))).select(*words.columns, "_c.stem", "_c.ending")


def rules(words: DataFrame, endings: int = 30, least: int = 5) -> DataFrame:
    """(language, ending, into, support): the rule of each ending that has one. A table."""
    all_cuts = cuts(words.select("language", "word"))
    common = all_cuts.groupBy("language", "ending").agg(F.count("*").alias("stems"))
    place = F.row_number().over(Window.partitionBy("language").orderBy(F.desc("stems"), "ending"))
    common = stored(common.withColumn("_n", place).where(F.col("_n") <= endings).select(F.col("language").alias("_l"), F.col("ending").alias("_e")), "endings")
    same = F.col("language").eqNullSafe(F.col("_l")) & (F.col("ending") == F.col("_e"))
    kept = all_cuts.join(common, same).select("language", "stem", "ending")
    by_stem = kept.groupBy("language", "stem").agg(F.sort_array(F.collect_set("ending")).alias("all"))  # at most `endings`
    pairs = by_stem.where(F.size("all") > 1).select("language", F.explode("all").alias("ending"), "all").select("language", "ending", F.explode("all").alias("into"))
    counts = pairs.where(F.length("into") < F.length("ending")).groupBy("language", "ending", "into").agg(F.count("*").alias("support"))
    best = F.row_number().over(Window.partitionBy("language", "ending").orderBy(F.desc("support"), "into"))
    return stored(counts.where(F.col("support") >= least).withColumn("_n", best).where("_n = 1").drop("_n"), "rules")


def lemmas(words: DataFrame, found: DataFrame) -> DataFrame:
    """words (language, word, n) with `lemma`."""
    rule = found.select(F.col("language").alias("_l"), F.col("ending").alias("_e"), "into")
    tried = cuts(words).join(F.broadcast(rule), F.col("language").eqNullSafe(F.col("_l")) & (F.col("ending") == F.col("_e")))  # endings x languages
    tried = tried.select("language", "word", F.length("ending").alias("size"), F.concat("stem", "into").alias("lemma"))
    known = words.select(F.col("language").alias("_kl"), F.col("word").alias("_kw"))
    real = tried.join(known, F.col("language").eqNullSafe(F.col("_kl")) & (F.col("lemma") == F.col("_kw")), "left_semi")
    longest = real.groupBy(F.col("language").alias("_l"), F.col("word").alias("_w")).agg(F.max_by("lemma", "size").alias("lemma"))
    out = words.join(longest, F.col("language").eqNullSafe(F.col("_l")) & (F.col("word") == F.col("_w")), "left")
    return out.select(*words.columns, F.coalesce("lemma", "word").alias("lemma"))


def rewritten(word: Column, endings: dict[str, str]) -> Column:
    """A word by the rule of its longest ending, whether the result is known or not: one lookup per length, as along a trie from the end."""
    out = word
    table = F.create_map(*[F.lit(x) for pair in sorted(endings.items()) for x in pair]) if endings else None
    for k in range(1, LONGEST + 1):
        if table is not None:
            into = F.try_element_at(table, F.right(word, F.lit(k)))
            fits = (F.length(word) >= STEM + k) & into.isNotNull()
            out = F.when(fits, F.concat(F.substring(word, F.lit(1), F.length(word) - k), into)).otherwise(out)
    return out
