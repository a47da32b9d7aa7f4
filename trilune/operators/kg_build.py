"""A knowledge graph built out of documents in rounds: load, extract entities, insert, relate, insert, validate.

Each round reads the tables of the rounds before and writes its own under one folder, so a build that is stopped goes on
where it was, and a lost executor repeats one round's tasks only. Tables: corpus (doc, text, language), extracted, entities, related,
relations, report.

Order of insertion is document, language, type, name; of several entities of one name the last inserted answers to it. Documents without
a text, or in a language without patterns, give nothing. Repeated documents give the same entities once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trilune.operators import extract as X
from trilune.operators import kg as K
from trilune.sources.stores import exists

ROUNDS = ("corpus", "extracted", "entities", "related", "relations", "report")


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}")


def round_of(spark: SparkSession, folder: str, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """A round's table; it is made if it isn't there whole."""
    path = f"{folder}/{name}"
    if not exists(spark, f"{path}/_SUCCESS"):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def inserted(extracted: DataFrame) -> DataFrame:
    """Extracted rows (doc, language, type, name, confidence) as entities of the graph, those of an id once."""
    order = F.struct("doc", "language", "type", "name")
    rows = extracted.select(
        K.entity_id(F.col("name"), F.col("type"), F.col("language")).alias("id"),
        "name",
        "type",
        "language",
        F.lit(None).cast("string").alias("description"),
        F.array().cast("array<string>").alias("aliases"),
        "confidence",
        order.alias("ord"),
    )
    return K.added_entities(rows)


def related(corpus: DataFrame, extracted: DataFrame, patterns) -> DataFrame:
    """(src, dst, rel, confidence, ord): relations between extracted names, each once."""
    names = extracted.select(F.col("name").alias("id"), "name", F.struct("doc", "language", "type", "name").alias("ord"))
    spans = X.relation_spans(corpus, patterns)
    ends = {side: X.first_matches(spans, side, names).withColumnRenamed("id", end) for side, end in (("left", "src"), ("right", "dst"))}
    rows = spans.join(ends["left"], "left").join(ends["right"], "right").where("src <> dst")
    best = F.min(F.struct("doc", "src", "dst")).alias("b")
    return rows.groupBy(F.lower("src"), F.lower("dst"), "rel").agg(best).select("b.src", "b.dst", "rel", F.lit(0.85).alias("confidence"), F.col("b.doc").alias("ord"))


def linked(found: DataFrame, entities: DataFrame) -> DataFrame:
    """Relations between names as relations between the entities that answer to them, valid ones only."""
    index = K.name_index(entities)
    end = lambda c: index.select(F.col("key").alias(f"_{c}"), F.col("id").alias(f"{c}_id"))
    rows = found.join(end("src"), F.lower("src") == F.col("_src")).join(end("dst"), F.lower("dst") == F.col("_dst"))
    rows = rows.select(F.col("src_id").alias("src"), F.col("dst_id").alias("dst"), "rel", "confidence", F.struct("ord", "src", "dst").alias("ord"))
    return K.added_relations(K.valid_relations(rows, entities))


def report(corpus: DataFrame, extracted: DataFrame, entities: DataFrame, found: DataFrame, relations: DataFrame) -> DataFrame:
    """(measure, value): sizes of the rounds, and per language entities and those without relations."""
    sizes = {
        "corpus_size": corpus,
        "entities_extracted": extracted,
        "entities_added": entities,
        "relations_extracted": found,
        "relations_added": relations,
    }
    out = K.schema_report(entities, relations).select(
        F.explode(
            F.map_from_arrays(
                F.array(F.concat_ws(" ", F.lit("entities"), "language"), F.concat_ws(" ", F.lit("isolated"), "language")),
                F.array("n", "isolated"),
            ),
        ).alias("measure", "value"),
    )
    for name, df in sizes.items():
        out = out.unionByName(df.agg(F.lit(name).alias("measure"), F.count(F.lit(1)).alias("value")))
    return out


def build(
    corpus: DataFrame,
    folder: str,
    entity_patterns=None,
    relation_patterns=None,
    stop: dict[str, list[str]] | None = None,
    least: int = 2,
    tagger: Callable[[DataFrame], DataFrame] | None = None,
    upto: str = "report",
) -> tuple[DataFrame, DataFrame | None, DataFrame | None]:
    """(entities, relations, report) of a corpus (doc, text, language), as tables under the folder.

    tagger: further entities (doc, language, type, name) of the corpus, less certain than those by patterns.
    upto: the last round that is made; entities do not depend on the rounds after theirs. What is not made is None.
    """
    if upto not in ("entities", "relations", "report"):
        raise ValueError(f"no round to stop after: {upto}")
    spark = corpus.sparkSession
    texts = round_of(spark, folder, "corpus", lambda: corpus.select("doc", "text", "language"))

    def extract() -> DataFrame:
        rows = X.entities(texts, entity_patterns).withColumn("confidence", F.lit(0.95))
        if tagger is not None:
            rows = rows.unionByName(tagger(texts).withColumn("confidence", F.lit(0.8)))
        good = X.worthy(rows, stop or {}, least)
        best = F.min(F.struct(-F.col("confidence"), "doc", "name")).alias("b")
        kept = good.groupBy(F.lower("name"), "type", "language").agg(best)
        return kept.select("b.doc", "language", "type", "b.name", (-F.col("b").getField("col1")).alias("confidence"))

    extracted = round_of(spark, folder, "extracted", extract)
    entities = round_of(spark, folder, "entities", lambda: inserted(extracted))
    if upto == "entities":
        return entities, None, None
    found = round_of(spark, folder, "related", lambda: related(texts, extracted, relation_patterns))
    relations = round_of(spark, folder, "relations", lambda: linked(found, entities))
    if upto == "relations":
        return entities, relations, None
    told = round_of(spark, folder, "report", lambda: report(texts, extracted, entities, found, relations))
    return entities, relations, told
