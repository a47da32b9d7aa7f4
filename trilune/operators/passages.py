"""What texts say of themselves and of their concepts: abstracts, references, captions, definitions, relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trilune.functions import patterns as P
from trilune.functions.text import collapse_ends
from trilune.operators.extract import places

UNICODE = "(?U)"  # letters and digits of all scripts


def abstract(text: Column) -> Column:
    """The first abstract or summary of 51 to 1999 characters; null without one."""
    found = [collapse_ends(F.regexp_extract(text, p, 1)) for p in P.ABSTRACTS]
    return F.coalesce(*[F.when((F.length(x) > 50) & (F.length(x) < 2000), x) for x in found])


def references(text: Column) -> Column:
    """Entries of the list of references, longer than 20 characters."""
    section = collapse_ends(F.regexp_extract(text, P.REFERENCES, 1))
    entries = F.transform(F.split(section, P.REFERENCE_STARTS), collapse_ends)
    return F.filter(entries, lambda x: F.length(x) > 20)


def captions(texts: DataFrame, pattern: str) -> DataFrame:
    """(doc, index, title, at) of tables or figures that a text (doc, text) names; at: characters before it."""
    found = places(texts, pattern)
    index = F.row_number().over(_in_text()) - 1
    return found.select(
        "doc",
        index.cast("long").alias("index"),
        collapse_ends(F.regexp_extract("name", pattern, 1)).alias("title"),
        "at",
    )


def _in_text():
    from pyspark.sql import Window

    return Window.partitionBy("doc").orderBy("at")


def concepts(texts: DataFrame, table=None) -> DataFrame:
    """(doc, type, name, definition, confidence): a row for each match of each pattern."""
    both = lambda k, p: F.transform(
        F.arrays_zip(
            F.regexp_extract_all("text", F.lit(UNICODE + p), F.lit(1)).alias("a"),
            F.regexp_extract_all("text", F.lit(UNICODE + p), F.lit(2)).alias("b"),
        ),
        lambda m: F.struct(F.lit(k).alias("type"), m["a"].alias("name"), m["b"].alias("definition")),
    )
    found = F.flatten(F.array(*[both(k, p) for k, p in (table or P.CONCEPTS)]))
    return texts.select("doc", F.inline(found)).withColumn("confidence", F.lit(0.8))


def near_concepts(found: DataFrame, within: int = 100) -> DataFrame:
    """(doc, subject, object, confidence): pairs of a text's concepts (doc, name, at) fewer than `within` characters apart, in their order.

    They meet on cells of that width and the next, so that a long text is no pairing of all with all.
    """
    a = found.withColumn("cell", F.floor(F.col("at") / within))
    b = a.select(
        "doc",
        F.col("name").alias("object"),
        F.col("at").alias("at2"),
        F.explode(F.array(F.col("cell"), F.col("cell") - 1)).alias("cell"),
    )
    both = a.join(b, ["doc", "cell"]).where((F.col("at2") > F.col("at")) & (F.col("at2") - F.col("at") < within))
    return both.select(
        "doc",
        F.col("name").alias("subject"),
        "object",
        "at",
        "at2",
        (1 - (F.col("at2") - F.col("at")) / within).alias("confidence"),
    )


def between(text: Column, at: Column, at2: Column, after: int = 100) -> Column:
    """The text from the first of two places to `after` characters behind the second."""
    low, high = F.least(at, at2), F.greatest(at, at2)
    return collapse_ends(F.substring(text, low + 1, high + after - low))


def verb_relations(texts: DataFrame, known: DataFrame, table=None) -> DataFrame:
    """(doc, subject, object, confidence) of verbs between two words that are both concepts (doc, name) of the text."""
    both = lambda p: F.arrays_zip(
        F.regexp_extract_all("text", F.lit(UNICODE + p), F.lit(1)).alias("subject"),
        F.regexp_extract_all("text", F.lit(UNICODE + p), F.lit(2)).alias("object"),
    )
    spans = texts.select("doc", F.inline(F.flatten(F.array(*[both(p) for p in (table or P.CONCEPT_RELATIONS)]))))
    names = known.select("doc", "name").distinct()
    for side in ("subject", "object"):
        spans = spans.join(names.withColumnRenamed("name", side), ["doc", side], "left_semi")
    return spans.select("doc", "subject", "object", F.lit(0.7).alias("confidence"))


def alignment_score(aligned: Column, sentences: Column, same_language: Column, names: Column, names2: Column) -> Column:
    """0 without aligned sentences; else half their share, 0.3 for one language (0.15 for two) and 0.2 of what the lower-cased names share, at most 1."""
    low = lambda a: F.array_distinct(F.transform(a, F.lower))
    shared = F.coalesce(
        F.try_divide(
            F.size(F.array_intersect(low(names), low(names2))),
            F.size(F.array_union(low(names), low(names2))),
        ),
        F.lit(0.0),
    )
    score = (
        0.5 * F.coalesce(F.try_divide(aligned, sentences), F.lit(0.0))
        + 0.3 * F.when(same_language, 1.0).otherwise(0.5)
        + 0.2 * shared
    )
    return F.when(aligned > 0, F.least(score, F.lit(1.0))).otherwise(0.0)
