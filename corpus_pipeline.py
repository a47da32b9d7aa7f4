"""A training corpus from raw documents: five stages, each written as a table that the next one reads.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all
but the last return the columns of documents, further ones included, whatever they are called.

Null and empty texts are kept by every stage: they are not toxic, near nothing, repeat and contain nothing, and have no words to mix.
Rows without an id are kept as near duplicates of nothing; of a group of near duplicates all rows with its smallest id stay.
A null source is a source of its own. A document of which all words repeat others' passages goes; very long texts are handled
whole. An empty table gives an empty one; without labels of both kinds nothing is rejected, without benchmark nothing is contaminated.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from trilune.llm import contamination, jaccard_join, mixing, substring_dedup, toxicity
from trilune.llm.common import dropped, stored_alone, table


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources: a row per copy taken, with its number in `copy`."""
    return mixing.emitted(docs)


STAGES = [
    ("toxicity", toxicity.stage),
    ("jaccard_join", jaccard_join.stage),
    ("substring_dedup", substring_dedup.stage),
    ("contamination", contamination.stage),
    ("mixing", mix_sources),
]

#: The classifier and the similarity join are beyond SQL; tests hold run() against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; of the stages before it only the last one's table is left, which they are read from."""
    docs, last = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = stored_alone(spark, lambda stage=stage, docs=docs: stage(spark, docs, sf_dir), f"stage-{name}")
        if last is not None:
            dropped(last)
        last = docs
    return STAGES[-1][1](spark, docs, sf_dir)
