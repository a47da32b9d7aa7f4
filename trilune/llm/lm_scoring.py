"""Subword lattice likelihood of whole texts.

A text's model probability is that of its words and one end. A word's probability sums
over all its segmentations into pieces of a fixed public vocabulary, by a forward
recursion in log space. The vocabulary file's own scores are merge ranks, no probabilities: they segment
the training words, how often each piece is then used over the whole training corpus are the first weights,
and `rounds` of expectation maximisation over all segmentations of all training words follow.
With `word_edge` (the default) a training word is one more edge over itself, weighted by its count; Good and
Turing's estimate shares out between the two. Without it, the lattice alone gives the score.
Beside it stands a base score, the word unigram with one added to each count.

Corpus counts of words need every word to meet its like, and every document to learn
its words' counts. Slices of the corpus are encoded once, as a table in the shared folder:
the tokens of a slice's documents, numbered by its distinct words, and these words by
hash bucket with the slice's training counts. Bucket by bucket, words of all slices are
counted and scored once, and the numbers go back to the slices. Frequent words thus
travel once per slice, whatever their count, and no vocabulary is ever collected.

Null and empty texts have one token, the end. Ties need no rule: equal words have equal scores. Ids may repeat or be null; each row is scored.
Without training texts every count is 0 and the pieces are equally likely. Other columns are not used.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trilune.llm import words as W
from trilune.llm.common import buckets, dropped, fold, new_folder, small_batches, table, written
from trilune.llm.lattice import lattice, spelled

ENCODED = "kind string, slice string, bucket int, ids binary, tokens binary, sizes binary, words binary, counts binary"


def encoded(docs: DataFrame, train, key: str, text: str, parts: int, slice_bytes: int = 5 << 20) -> DataFrame:
    def encode(batches):
        import pickle
        import uuid

        import pyarrow as pa
        import zstandard

        z = zstandard.ZstdCompressor(level=1)
        names = [c.split()[0] for c in ENCODED.split(", ")]
        kinds = [pa.string(), pa.string(), pa.int32(), *[pa.binary()] * 5]
        for batch in batches:
            ids, learns = batch.column(0).to_pylist(), batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
            for a, b, w in W.chunks(batch.column(1), lower=True, most_bytes=slice_bytes):
                name = uuid.uuid4().hex
                keys, first, number = np.unique(w.hash, return_index=True, return_inverse=True)
                of = (keys % np.uint64(parts)).astype(np.int64)
                order = np.argsort(of, kind="stable")
                place = np.empty(len(order), np.int64)
                place[order] = np.arange(len(order))
                token = place[number].astype("<u4")
                counts = np.bincount(number[learns[a:b][w.doc]], minlength=len(keys)).astype(np.uint32)[order]
                planes = token.view(np.uint8).reshape(-1, 4).T.tobytes()
                rows = [
                    (
                        "docs",
                        name,
                        None,
                        pickle.dumps((ids[a:b], learns[a:b])),
                        z.compress(planes),
                        w.counts().astype(np.uint32).tobytes(),
                        None,
                        None,
                    ),
                ]
                cut = np.searchsorted(of[order], np.arange(parts + 1))
                for p in range(parts):
                    x = slice(cut[p], cut[p + 1])
                    if x.stop > x.start:
                        rows.append(
                            ("words", name, p, None, None, None, W.packed(w, first[order[x]]), counts[x].tobytes()),
                        )
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)],
                    names=names,
                )

    spark = docs.sparkSession
    path = new_folder(spark, "encoded")
    (
        docs.select(key, text, train.alias("_train"))
        .mapInArrow(encode, ENCODED).write
        .partitionBy("kind")
        .option("compression", "zstd")
        .parquet(path)
    )
    return spark.read.schema(ENCODED).parquet(path)


def _unpacked(packs: list[bytes]) -> tuple[W.Words, list[np.ndarray]]:
    """All words of the packs, in order, and each pack's positions."""
    w = W.split_buffer(np.frombuffer(b"".join(packs), np.uint8), np.cumsum([0, *map(len, packs)]))
    return w, [np.arange(a, b) for a, b in zip(w.first[:-1], w.first[1:], strict=True)]


def vocabulary(code: DataFrame, most: int = 100_000) -> DataFrame:
    """Distinct training words with their counts, in rows of at most `most` words, with their number, sum, and how many occur once."""

    def merge(key, pdf):
        import pandas as pd

        w, _ = _unpacked(list(pdf["words"]))
        counts = np.concatenate([np.frombuffer(c, np.uint32) for c in pdf["counts"]]).astype(float)
        _, first, number = np.unique(w.hash, return_index=True, return_inverse=True)
        total = np.bincount(number, counts, len(first)).astype(np.int64)
        seen = np.flatnonzero(total)
        parts = [seen[a : a + most] for a in range(0, len(seen), most)]
        rows = [
            (W.packed(w, first[x]), total[x].tobytes(), len(x), int(total[x].sum()), int((total[x] == 1).sum()))
            for x in parts
        ]
        return pd.DataFrame(rows, columns=["words", "counts", "distinct", "total", "single"])

    rows = code.where("kind = 'words'").select("bucket", "words", "counts")
    return written(
        code.sparkSession,
        rows.groupBy("bucket").applyInPandas(
            merge,
            "words binary, counts binary, distinct long, total long, single long",
        ),
        "vocabulary",
    )


def piece_weights(vocab: DataFrame, model: str, rounds: int = 1, add: float = 0.1) -> np.ndarray:
    """Log probabilities of the pieces; their uses in all training words are summed piece by piece, so the vocabulary's size bounds what is collected."""
    spark = vocab.sparkSession
    size = lattice(model).size

    def used(state):
        def uses(batches):
            import pyarrow as pa
            import sentencepiece

            lat = lattice(model)
            place = {p: i for i, p in enumerate(lat.pieces[256:], 256)}
            total = np.zeros(lat.size)
            coder = sentencepiece.SentencePieceProcessor(model_file=model)
            own = [
                (
                    bytes([int(coder.id_to_piece(i)[1:-1], 16)])
                    if coder.is_byte(i)
                    else coder.id_to_piece(i).replace("▁", " ").encode()
                )
                for i in range(coder.get_piece_size())
            ]
            number = np.array([b[0] if len(b) == 1 else place.get(b, -1) for b in own])
            for batch in batches:
                for pack, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    words, counts = pack.split(), np.frombuffer(c, np.int64).astype(float)
                    for at in range(0, len(words), 100_000):
                        some, n = words[at : at + 100_000], counts[at : at + 100_000]
                        if state is None:
                            found = coder.encode([x.decode("utf-8", "replace") for x in some])
                            sizes = np.fromiter(map(len, found), np.int64, len(found))
                            piece = number[np.fromiter((p for x in found for p in x), np.int64, int(sizes.sum()))]
                            total += np.bincount(
                                np.maximum(piece, 0),
                                np.where(piece < 0, 0, np.repeat(n, sizes)),
                                lat.size,
                            )
                        else:
                            total += lat.run(*spelled(some), state.value, n)[1]
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], names=["piece", "uses"])

        return uses

    logp = None
    for _ in range(rounds + 1):
        state = None if logp is None else spark.sparkContext.broadcast(logp.reshape(-1, 1))
        sums = (
            vocab.select("words", "counts")
            .mapInArrow(used(state), "piece int, uses double")
            .groupBy("piece")
            .agg(F.sum("uses"))
            .collect()
        )
        total = np.full(size, add)
        for piece, n in sums:
            total[piece] += n
        logp = np.log(total / total.sum())
    return logp


def lm_scores(
    docs: DataFrame,
    train,
    model: str,
    key: str = "doc_id",
    text: str = "text",
    rounds: int = 1,
    word_edge: bool = True,
) -> DataFrame:
    """Per row: key, learns, n_tokens, n_known, train_tokens, base_score, score. `train`: the condition of training rows."""
    spark = docs.sparkSession
    parts = buckets(docs)
    small_batches(spark)
    code = encoded(docs, F.coalesce(train, F.lit(False)), key, text, parts)
    vocab = vocabulary(code)
    logp = piece_weights(vocab, model, rounds)
    sent = spark.sparkContext.broadcast(logp.reshape(-1, 1))
    words, distinct, single = vocab.agg(F.sum("total"), F.sum("distinct"), F.sum("single")).first()
    texts = docs.where(train).count()
    n, v = int(words or 0) + texts, int(distinct or 0) + (texts > 0)
    # Ends among all that is drawn, and words that are new among all words (Good and Turing's estimate).
    end = (texts + 0.1) / ((words or 0) + texts + 0.2)
    new = (single + 1.0) / (words + 2.0) if words else 1.0
    known = (1 - new) / words if words else 0.0
    if not word_edge:
        new, known = 1.0, 0.0
    dropped(vocab)

    def value(key, pdf):
        import pandas as pd

        w, places = _unpacked(list(pdf["words"]))
        counts = np.concatenate([np.frombuffer(c, np.uint32) for c in pdf["counts"]]).astype(float)
        _, first, number = np.unique(w.hash, return_index=True, return_inverse=True)
        total = np.bincount(number, counts, len(first))
        scores = np.empty(len(first))
        lat = lattice(model)
        for at in range(0, len(first), 50_000):
            scores[at : at + 50_000] = lat.run(*spelled(W.packed(w, first[at : at + 50_000]).split()), sent.value)[:, 0]
        with np.errstate(divide="ignore"):  # the whole word is an edge too, if training texts have it
            scores = np.logaddexp(scores + np.log(new), np.log(total * known)) + np.log1p(-end)
        scores, total = (scores / np.log(10))[number], total.astype(np.int64)[number]
        return pd.DataFrame(
            {
                "slice": pdf["slice"],
                "bucket": key[0],
                "total": [total[p].tobytes() for p in places],
                "scores": [scores[p].tobytes() for p in places],
            },
        )

    values = (
        code.where("kind = 'words'")
        .select("slice", "bucket", "words", "counts")
        .groupBy("bucket")
        .applyInPandas(value, "slice string, bucket int, total binary, scores binary")
    )

    def score(key, left, right):
        import pickle

        import pandas as pd
        import zstandard

        right = right.sort_values("bucket")
        total = np.concatenate([np.frombuffer(x, np.int64) for x in right["total"]] or [np.zeros(0, np.int64)]).astype(
            float,
        )
        own = np.concatenate([np.frombuffer(x, float) for x in right["scores"]] or [np.zeros(0)])
        out = []
        for ids, tokens, sizes in zip(left["ids"], left["tokens"], left["sizes"], strict=True):
            (ids, learns), sizes = pickle.loads(ids), np.frombuffer(sizes, np.uint32)
            planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(tokens), np.uint8)
            token = np.ascontiguousarray(planes.reshape(4, -1).T).view("<u4").ravel()
            doc = np.repeat(np.arange(len(sizes)), sizes)
            base = np.log10((total + 1) / (n + v + 1))
            sums = lambda x: np.bincount(doc, x[token], len(sizes))  # noqa: E731, B023
            out.append(
                pd.DataFrame(
                    {
                        "_key": [None if i is None else str(i) for i in ids],
                        "learns": learns,
                        "n_tokens": sizes.astype(np.int64) + 1,
                        "n_known": sums((total > 0).astype(float)).round().astype(np.int64) + (texts > 0),
                        "base_score": sums(base) + np.log10((texts + 1) / (n + v + 1)),
                        "score": sums(own) + np.log10(end),
                    },
                ),
            )
        return (
            pd.concat(out)
            if out
            else pd.DataFrame(columns=["_key", "learns", "n_tokens", "n_known", "base_score", "score"], dtype=object)
        )

    slices = code.where("kind = 'docs'").select("slice", "ids", "tokens", "sizes")
    out = (
        slices.groupBy("slice")
        .cogroup(values.groupBy("slice"))
        .applyInPandas(
            score,
            "_key string, learns boolean, n_tokens long, n_known long, base_score double, score double",
        )
    )
    return out.select(
        F.col("_key").cast(docs.schema[key].dataType).alias(key),
        "learns",
        "n_tokens",
        "n_known",
        F.lit(n).cast("long").alias("train_tokens"),
        "base_score",
        "score",
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    held = fold(F.col("doc_id"), 7, 2)
    out = lm_scores(table(spark, sf_dir, "documents"), ~held, public_tokenizers.path("piece_bpe_32k.model"))
    return out.select(
        "doc_id",
        (~F.col("learns")).alias("held_out"),
        "n_tokens",
        "n_known",
        "train_tokens",
        "base_score",
        "score",
    )
