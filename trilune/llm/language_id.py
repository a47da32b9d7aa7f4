"""Language identification by unigrams over pieces, summed over all segmentations.

For each language, probabilities of the pieces of a fixed public vocabulary are fitted
to the words of a bounded sample of its documents by expectation maximisation. A text
is scored under each language by the forward algorithm over the lattices of all its
words, and the likeliest language wins, ties to the first in order of its name.

A null text, or one without a letter, is `und` with score 0, as is every text if no
language is known. Null languages teach nothing. Rows that repeat are each judged. Very long texts are judged
whole, in slices of documents, and teach nothing beyond the bound of `fit`. Columns
other than the key, the text and, in training, the language are not used.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trilune.llm import words as W
from trilune.llm.common import fold, small_batches, table, written
from trilune.llm.lattice import Table, fitted, lattice

_ASCII_LETTER = re.compile("[A-Za-z]")


def sampled(docs: DataFrame, label: str, key: str, most: int, most_labels: int = 64) -> DataFrame:
    """About `most` rows of each label, chosen by a hash of the key: all if there are fewer. Of more than `most_labels` labels, those with the most rows, ties to the first in order."""
    counts = docs.where(F.col(label).isNotNull()).groupBy(F.col(label).alias("_label")).agg(F.count("*").alias("_rows"))
    chances = counts.orderBy(F.desc("_rows"), "_label").limit(most_labels)
    chances = written(docs.sparkSession, chances.select("_label", F.least(F.lit(1.0), most / F.col("_rows")).alias("_chance")), "chances")
    drawn = F.pmod(F.xxhash64(F.lit("sample"), F.col(key)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    # One row per label, most_labels at most.
    return docs.join(F.broadcast(chances), (F.col(label) == F.col("_label")) & (drawn < F.col("_chance"))).drop("_label", "_chance")


def fit(
    train: DataFrame,
    model: str,
    key: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
    most_docs: int = 1000,
    rounds: int = 3,
    most_langs: int = 64,
    most_bytes: int = 16 << 20,
) -> tuple[list[str], np.ndarray]:
    """Languages in order, and piece x language log probabilities.

    Bounds of what is fitted on: the `most_langs` languages with the most texts, of each about `most_docs` texts, chosen by a
    hash of the key, and of these, in order of another hash, the first that are `most_bytes` together; longer texts are left out.
    Of several texts with one id and language the first in order counts. Each language is fitted in a task of its own.
    """
    plain = train.select(F.col(key).alias("_key"), F.col(lang).alias("_lang"), F.col(text).alias("_text"))
    chosen = sampled(plain.where("_text is not null"), "_lang", "_key", most_docs, most_langs)
    chosen = chosen.where(F.octet_length("_text") <= most_bytes).groupBy("_key", "_lang").agg(F.min("_text").alias("_text"))
    upto = Window.partitionBy("_lang").orderBy(F.xxhash64(F.lit("fit"), "_key"), "_key")  # about most_docs rows
    chosen = chosen.withColumn("_upto", F.sum(F.octet_length("_text").cast("long")).over(upto)).where(F.col("_upto") <= most_bytes)

    def one(pdf):
        import pandas as pd

        seen: Counter = Counter()
        for body in pdf["_text"]:
            seen.update(body.encode("utf-8", "surrogatepass").lower().split())
        words = sorted(seen)
        logp = fitted(lattice(model), words, np.array([seen[w] for w in words], float), rounds)
        return pd.DataFrame({"lang": [pdf["_lang"].iloc[0]], "logp": [logp.tobytes()]})

    found = chosen.select("_lang", "_text").groupBy("_lang").applyInPandas(one, "lang string, logp binary")
    models = {r.lang: np.frombuffer(r.logp) for r in found.collect()}  # vocabulary x languages
    names = sorted(models)
    return names, np.stack([models[n] for n in names], axis=1) if names else np.zeros((lattice(model).size, 0))


def has_letter(text: str | None) -> bool:
    return bool(text) and (bool(_ASCII_LETTER.search(text)) or any(map(str.isalpha, text)))


def languages(docs: DataFrame, fitted_model, model: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, lang_pred and score, the share of the winner when per-word likelihoods compete. One pass, no shuffle."""
    names, logp = fitted_model
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast((names, logp))  # vocabulary x languages

    def judge(batches):
        import pyarrow as pa

        names, logp = sent.value
        known = Table(lattice(model), logp, max(10_000, min(400_000, 4_000_000 // len(names)))) if names else None
        for batch in batches:
            best, score = np.full(len(batch), "und", object), np.zeros(len(batch))
            if known is not None:
                for a, b, w in W.chunks(batch.column(1), lower=True):
                    if not len(w.hash):
                        continue
                    values, number = known.scores(w)
                    total = np.stack([np.bincount(w.doc, values[number, j], b - a) for j in range(len(names))], axis=1)
                    mean = total / np.maximum(w.counts(), 1)[:, None]
                    share = np.exp(mean - mean.max(axis=1, keepdims=True))
                    share /= share.sum(axis=1, keepdims=True)
                    win = total.argmax(axis=1)
                    best[a:b], score[a:b] = np.array(names, object)[win], share[np.arange(b - a), win]
            for i, t in enumerate(batch.column(1).to_pylist()):
                if not has_letter(t):
                    best[i], score[i] = "und", 0.0
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(best, pa.string()), pa.array(score)],
                names=[key, "lang_pred", "score"],
            )

    return docs.select(key, text).mapInArrow(
        judge,
        f"{key} {docs.schema[key].dataType.simpleString()}, lang_pred string, score double",
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    model = public_tokenizers.path("piece_bpe_32k.model")
    docs = table(spark, sf_dir, "documents")
    held = fold(F.col("doc_id"), 4, 2)
    out = languages(docs, fit(docs.where(~held), model), model)
    return out.select("doc_id", held.alias("held_out"), "lang_pred", "score")
