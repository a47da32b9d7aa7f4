"""Benchmark passages in training text, by a distributed positional inverted index.

The index is partitioned by document: each shard covers the documents of one slice of
the corpus and stores, as a table in the shared folder, its terms as text with their postings
(positions in the shard, where documents are one position apart) and the documents'
places. Test passages are short windows of terms. In a shard, a window's candidates are
the postings of its rarest term, each less the term's offset in the window; they are
intersected with the offset-adjusted postings of its other terms, rarest first. What is
left are the exact occurrences, or, with slop, those whose terms stand within slop
positions of their places. Terms are looked up by fingerprint and compared as text.

The test items are the stated query set. They are kept as one array of terms, of which windows are stretches, and
sent to every shard in blocks of at most `most_terms`: one pass over the index for each block, so
that tasks and driver hold one block at a time. Where there is more than one, what the passes find is written and
put together shard by shard. The corpus is never shuffled.

Null and empty texts have no words; items without words have no windows. Documents that repeat are each judged.
Items with one id are one item, with the windows of all its rows. The windows of items without an id make words
hit, but such items have no name to be counted or listed by. Null ids of documents stay as they are. A very long
text is a slice, and so a shard, of its own. Other columns are not used, whatever their names. Empty
documents give an empty table, without items nothing is hit.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trilune.llm import words as W
from trilune.llm.common import small_batches, table, without, written

SHARD = "shard string, ids binary, first binary, terms binary, texts binary, ends binary, postings binary"
HITS = "shard string, starts binary, lengths binary, found binary"
VERDICT = (
    "_key string, n_words long, n_hit long, n_items long, items array<string>, items_sha256 string,"
    " contaminated boolean"
)


@dataclass
class Block:
    """Some items: their distinct terms (fingerprints in order, and texts), the terms one after the other, and where windows start."""

    terms: np.ndarray
    texts: np.ndarray
    sizes: np.ndarray
    number: np.ndarray  # of each term of the items
    start: np.ndarray  # of each window
    length: np.ndarray
    item: np.ndarray
    names: dict[int, str | None]


def block(rows: list[tuple[int, str | None, str]], size: int) -> Block:
    w = W.split([body for _, _, body in rows], W.NOT_TERM, lower=True)
    exact = W.numbered(w)
    _, pick = np.unique(exact, return_index=True)
    pick = pick[np.argsort(w.hash[pick], kind="stable")]
    place = np.empty(len(pick), np.int64)
    place[exact[pick]] = np.arange(len(pick))
    n = w.counts()
    length = np.minimum(n, size)
    windows = np.where(n > 0, n - length + 1, 0)
    of = np.repeat(np.arange(len(n)), windows)
    start = w.first[of] + np.arange(len(of)) - np.repeat(np.cumsum(windows) - windows, windows)
    return Block(
        w.hash[pick],
        np.frombuffer(W.packed(w, pick), np.uint8),
        (w.end - w.start)[pick],
        place[exact],
        start,
        length[of],
        np.array([i for i, _, _ in rows])[of],
        {i: name for i, name, _ in rows},
    )


def blocks(items: DataFrame, size: int, item: str, text: str, most_terms: int) -> Iterator[Block]:
    """All items in blocks; the driver holds one."""
    rows, held = [], 0
    for i, (name, body) in enumerate(items.select(F.col(item).cast("string"), F.col(text)).where(F.col(text).isNotNull()).toLocalIterator()):
        terms = len(body) // 2 + 1  # at most
        if rows and held + terms > most_terms:
            yield block(rows, size)
            rows, held = [], 0
        rows.append((i, name, body))
        held += terms
    yield block(rows, size)


def index(docs: DataFrame, key: str = "doc_id", text: str = "text", shard_bytes: int = 4 << 20) -> DataFrame:
    """The stored index: one row per shard."""

    def build(batches):
        import pickle
        import uuid

        import pyarrow as pa

        for batch in batches:
            ids = batch.column(0).to_pylist()
            for a, b, w in W.chunks(batch.column(1), W.NOT_TERM, lower=True, most_bytes=shard_bytes):
                place = np.arange(len(w.hash), dtype=np.uint32) + w.doc.astype(np.uint32)  # a gap after each document
                number = W.numbered(w)
                order = np.lexsort((number, w.hash))  # terms with equal fingerprints are apart
                begin = (
                    np.flatnonzero(np.append(True, number[order[1:]] != number[order[:-1]])) if len(order) else order
                )
                ends = np.append(begin[1:], len(order)).astype(np.uint32)[: len(begin)]
                row = [
                    pickle.dumps(ids[a:b]),
                    w.first.astype(np.uint32).tobytes(),
                    w.hash[order[begin]].tobytes(),
                    W.packed(w, order[begin]),
                    ends.tobytes(),
                    place[order].tobytes(),
                ]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([uuid.uuid4().hex]), *(pa.array([x], pa.binary()) for x in row)],
                    names=[c.split()[0] for c in SHARD.split(", ")],
                )

    return written(docs.sparkSession, docs.select(key, text).mapInArrow(build, SHARD), "postings")


def _equal(a: np.ndarray, at: np.ndarray, b: np.ndarray, to: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the bytes a[at : at + size] and b[to : to + size] are the same, for each."""
    step = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    same = a[np.repeat(at, size) + step] == b[np.repeat(to, size) + step]
    return np.logical_and.reduceat(same, np.cumsum(size) - size) if len(size) else np.zeros(0, bool)


class Shard:
    """Postings of one shard, and searches in them."""

    def __init__(self, first, terms, texts, ends, postings):
        self.first = np.frombuffer(first, np.uint32).astype(np.int64)
        self.terms, self.ends = np.frombuffer(terms, np.uint64), np.frombuffer(ends, np.uint32).astype(np.int64)
        self.begins = np.append(0, self.ends[:-1])
        self.postings = np.frombuffer(postings, np.uint32)
        self.texts = np.frombuffer(texts, np.uint8)
        self.text_end = np.flatnonzero(self.texts == 32)  # no term holds a blank
        self.text_at = np.append(0, self.text_end[:-1] + 1)
        self.doc_at = self.first[:-1] + np.arange(len(self.first) - 1)  # place of each document's first word

    def lookup(self, block: Block) -> np.ndarray:
        """The number here of each term of the block, -1 for those that no document here has."""
        out = np.full(len(block.terms), -1)
        if not len(self.terms):
            return out
        at, left = np.searchsorted(self.terms, block.terms), np.arange(len(block.terms))
        to = np.cumsum(block.sizes + 1) - block.sizes - 1
        while len(left):  # once, but for terms whose fingerprints are equal here
            ok = at[left] < len(self.terms)
            left = left[ok]
            left = left[self.terms[at[left]] == block.terms[left]]
            same = (self.text_end - self.text_at)[at[left]] == block.sizes[left]
            some = left[same]
            hit = some[_equal(self.texts, self.text_at[at[some]], block.texts, to[some], block.sizes[some])]
            out[hit] = at[hit]
            left = np.setdiff1d(left, hit)
            at[left] += 1
        return out

    def search(self, block: Block, slop: int) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int, str]]]:
        """Where windows of the block occur, how long they are, and (document, item, its name) of each that does."""
        own = self.lookup(block)[block.number]
        missing = np.append(0, np.cumsum(own < 0))
        starts, lengths, found = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], set()
        for q in np.flatnonzero(missing[block.start + block.length] == missing[block.start]):
            n = int(block.length[q])
            places = self.meet(own[block.start[q] : block.start[q] + n], slop)
            if len(places):
                starts.append(places)
                lengths.append(np.full(len(places), n))
                i = int(block.item[q])
                found.update(
                    (int(d), i, block.names[i])
                    for d in np.unique(np.searchsorted(self.doc_at, places, "right") - 1)
                )
        return np.concatenate(starts), np.concatenate(lengths), sorted(found)

    def meet(self, at: np.ndarray, slop: int = 0) -> np.ndarray:
        order = np.argsort(self.ends[at] - self.begins[at], kind="stable")
        left = None
        for i in order:
            own = self.postings[self.begins[at[i]] : self.ends[at[i]]].astype(np.int64) - i
            if left is None:
                left = own[own >= 0]
            else:
                j = np.searchsorted(own, left)
                near = own[np.minimum(j, len(own) - 1)] - left
                if slop:
                    before = left - own[np.maximum(j - 1, 0)]
                    left = left[((near >= 0) & (near <= slop)) | ((before >= 0) & (before <= slop))]
                else:
                    left = left[near == 0]
            if not len(left):
                return left
        if slop:  # the window must lie in one document
            doc = np.searchsorted(self.doc_at, left, "right") - 1
            left = left[left + len(at) - 1 < self.doc_at[doc] + (self.first[doc + 1] - self.first[doc])]
        return left

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def verdicts(
        self,
        ids: list,
        starts: np.ndarray,
        lengths: np.ndarray,
        found: list[tuple[int, int, str]],
        share: int,
    ):
        """Rows of VERDICT for the shard's documents."""
        import pyarrow as pa

        n = self.counts()
        hit = np.zeros(int(n.sum() + len(n)) + 1, np.int64)
        np.add.at(hit, starts, 1)
        np.add.at(hit, starts + lengths, -1)
        covered = np.append(0, np.cumsum(np.cumsum(hit) > 0))
        n_hit = covered[self.doc_at + n] - covered[self.doc_at]
        of: dict[int, set[str]] = {}
        for d, _, name in found:
            if name is not None:
                of.setdefault(d, set()).add(name)
        lists = [sorted(of.get(d, ())) for d in range(len(ids))]
        return pa.RecordBatch.from_pydict(
            {
                "_key": pa.array([None if i is None else str(i) for i in ids], pa.string()),
                "n_words": pa.array(n, pa.int64()),
                "n_hit": pa.array(n_hit, pa.int64()),
                "n_items": pa.array([len(x) for x in lists], pa.int64()),
                "items": pa.array(lists, pa.list_(pa.string())),
                "items_sha256": pa.array(
                    [hashlib.sha256(",".join(x).encode()).hexdigest() for x in lists],
                    pa.string(),
                ),
                "contaminated": pa.array((n_hit > 0) & (share * n_hit >= n), pa.bool_()),
            },
        )


def contamination(
    docs: DataFrame,
    items: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    size: int = 13,
    slop: int = 0,
    share: int = 20,
    most_terms: int = 8_000_000,
) -> DataFrame:
    """Per document: key, n_words, n_hit, n_items, items (their ids), items_sha256, contaminated."""
    spark = docs.sparkSession
    small_batches(spark)
    shards = index(docs, key, text)
    columns = shards.columns

    def once(sent):
        def search(batches):
            import pickle

            for batch in batches:
                for _, ids, *parts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    shard = Shard(*parts)
                    yield shard.verdicts(pickle.loads(ids), *shard.search(sent.value, slop), share)

        return search

    def hits(sent):
        def search(batches):
            import pickle

            import pyarrow as pa

            for batch in batches:
                rows = []
                for name, _, *parts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    starts, lengths, found = Shard(*parts).search(sent.value, slop)
                    if found:
                        rows.append((name, starts.tobytes(), lengths.tobytes(), pickle.dumps(found)))
                if rows:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c) for c in zip(*rows, strict=True)],
                        names=[c.split()[0] for c in HITS.split(", ")],
                    )

        return search

    def together(_, left, right):
        import pickle

        import pandas as pd

        out = []
        for row in left[columns].itertuples(index=False):
            starts, lengths = (
                np.concatenate([np.zeros(0, np.int64), *(np.frombuffer(x, np.int64) for x in right[c])])
                for c in ("starts", "lengths")
            )
            found = [f for x in right["found"] for f in pickle.loads(x)]
            out.append(Shard(*row[2:]).verdicts(pickle.loads(row[1]), starts, lengths, found, share).to_pandas())
        return (
            pd.concat(out) if out else pd.DataFrame(columns=[c.split()[0] for c in VERDICT.split(", ")], dtype=object)
        )

    parts = blocks(items, size, item, item_text, most_terms)
    first, second = next(parts), next(parts, None)
    if second is None:
        out = shards.mapInArrow(once(spark.sparkContext.broadcast(first)), VERDICT)
    else:
        told = []
        while first is not None:
            sent = spark.sparkContext.broadcast(first)
            told.append(written(spark, shards.mapInArrow(hits(sent), HITS), "hits"))
            sent.destroy()
            first, second = second, next(parts, None)
        every = spark.read.schema(HITS).parquet(*(t._trilune_folder for t in told))
        out = shards.groupBy("shard").cogroup(every.groupBy("shard")).applyInPandas(together, VERDICT)
    return out.select(F.col("_key").cast(docs.schema[key].dataType).alias(key), *out.columns[1:])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("items")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated. The text alone decides, so rows are matched by its hash, whatever their ids."""
    name = "_text_hash"
    while name in docs.columns:
        name += "_"
    hashed = docs.withColumn(name, F.sha2(F.coalesce("text", F.lit("")), 256))
    bad = (
        contamination(hashed.select(name, "text"), table(spark, sf_dir, "benchmark"), key=name)
        .where("contaminated")
        .select(name)
    )
    return without(hashed, bad, name, bytes_each=64).select(*docs.columns)
