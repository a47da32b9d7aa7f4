"""Repeated word passages across documents, by prefix-partitioned suffix trees.

A window is `size` consecutive words of one document. It is repeated if its word sequence
also starts in a document with a smaller id; words that a repeated window covers are removed.
All windows are judged on the input.

The corpus is kept as slices, compressed, in the shared folder. Then:

1. A filter leaves out suffixes whose first `size` words occur once. Each window contains an anchor,
   the smallest fingerprint among its short word grams; equal windows have equal anchors. Slices send
   their distinct anchors by hash, as packed numbers, and learn which occur in another slice or document;
   and likewise which documents are copies as a whole. False alarms cost time only.
2. Suffixes are split by prefixes of variable length. How many suffixes begin with each word is counted,
   and for words that more than GROUP suffixes begin with, how many begin with each two words, and so on;
   the few prefixes that are too frequent are known to all tasks. A suffix then goes, as text, to the group of its
   shortest prefix that is rare enough, so that groups fit in memory before anything is exchanged.
3. A group's suffixes, sorted, with the lengths of the prefixes that neighbours have in common, are its
   subtree, cut at depth `size`: that is what a window needs. An internal node at that depth is a repeat,
   its leaves but those of the smallest document are repeated windows. Consecutive ones make up the maximal
   repeats of a document, of any length, which are removed as a whole.
4. Slices learn their repeated windows and rewrite their documents.

Two kinds of repeats need no exchange of text. Equal windows of one slice are settled there, found by
fingerprint and confirmed word by word, so that a passage that every document has is sent once per slice;
a group of equal windows, which no prefix splits, has at most one suffix per slice. Copies of whole
documents are settled by 128-bit fingerprints of their words, whose own fingerprints have 62 bits.

Null ids neither remove nor lose words. Null texts have no words; rows with equal ids do not remove from
each other, and all lose what a smaller id has. Columns named like the results are replaced. An empty table gives an empty one.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trilune.llm import words as W
from trilune.llm.common import apart, buckets, dropped, new_folder, small_batches, table, written

GRAM = 8
GROUP = 200_000  # suffixes of a subtree
SLICE = "kind string, slice string, bucket int, data binary, anchors binary, marks binary"
RUNS = "slice string, words binary, sizes binary, begins binary, ids binary, suffixes long"
SUFFIXES = "slice string, bucket int, words binary, places binary, ids binary"
_NO_ID = np.iinfo(np.int64).max


def anchors(w: W.Words, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows' first words, their anchors' places, and fingerprints of the grams from each word on."""
    gram = min(GRAM, size)
    ok = np.flatnonzero(W.inside_one(w.doc, size))
    g = W.grams(w.hash, gram)
    if not len(ok):
        return ok, ok, g
    best = g[: len(g) - (size - gram)].copy()
    place = np.arange(len(best))
    for i in range(1, size - gram + 1):
        other = g[i : i + len(best)]
        less = other < best
        best[less] = other[less]
        place[less] = np.flatnonzero(less) + i
    return ok, place[ok], g


def marks(w: W.Words) -> np.ndarray:
    """Two fingerprints of each document's whole word sequence."""
    out = np.zeros((len(w.first) - 1, 2), np.uint64)
    at = (np.arange(len(w.hash)) - w.first[w.doc]).astype(np.uint64)
    for i in range(2):
        h = W.mix(w.hash + at * W._LANE[i + 2])
        total = np.append(np.zeros(1, np.uint64), np.cumsum(h))
        out[:, i] = total[w.first[1:]] - total[w.first[:-1]]
    return out


def dealt(bucket: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """The order that puts equal buckets together, and where each of them begins and the last one ends."""
    order = np.argsort(bucket, kind="stable")
    return order, np.searchsorted(bucket[order], np.arange(parts + 1, dtype=bucket.dtype))


def _ids(batch, key: str) -> np.ndarray:
    import pyarrow.compute as pc

    return np.asarray(pc.fill_null(batch.column(key).cast("int64"), _NO_ID))


def _load(data: bytes):
    import pyarrow as pa
    import zstandard

    return pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(data)).read_all().combine_chunks().to_batches()[0]


def _words(batch, text: str) -> W.Words:
    return W.split_buffer(*W.from_arrow(batch.column(text)))


def sliced(docs: DataFrame, key: str, text: str, size: int, parts: int, slice_bytes: int) -> DataFrame:
    """Slices with all columns, and by bucket their anchors and their documents' marks."""

    def cut(batches):
        import uuid

        import pyarrow as pa
        import zstandard

        z = zstandard.ZstdCompressor(level=3)
        names = [c.split()[0] for c in SLICE.split(", ")]
        kinds = [pa.string(), pa.string(), pa.int32(), *[pa.binary()] * 3]
        for batch in batches:
            offsets = W.from_arrow(batch.column(text))[1]
            for a, b in W.slices(offsets, slice_bytes):
                part = pa.RecordBatch.from_arrays(
                    [pa.concat_arrays([c.slice(a, b - a)]) for c in batch.columns],
                    schema=batch.schema,
                )
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, part.schema) as out:
                    out.write_batch(part)
                name = uuid.uuid4().hex
                rows = [("docs", name, None, z.compress(sink.getvalue()), None, None)]
                w, ids = _words(part, text), _ids(part, key)
                _, place, g = anchors(w, size)
                place = np.unique(place)
                h, doc = g[place], w.doc[place]
                order = np.lexsort((doc, h))
                h, doc = h[order], doc[order]
                begin = np.flatnonzero(np.append(True, h[1:] != h[:-1])) if len(h) else np.zeros(0, int)
                several = doc[begin] != doc[np.append(begin[1:], len(doc)) - 1] if len(h) else np.zeros(0, bool)
                h = h[begin]
                short = ((h // np.uint64(parts)) & np.uint64(0xFFFFFFFF)).astype(np.uint32)
                of, cut = dealt(h % np.uint64(parts), parts)
                short, several = short[of], several[of]
                mark = marks(w)
                own = np.flatnonzero((w.counts() >= size) & (ids != _NO_ID))
                home, cut_own = dealt(mark[own, 0] % np.uint64(parts), parts)
                own = own[home]
                for p in np.flatnonzero((np.diff(cut) > 0) | (np.diff(cut_own) > 0)):
                    x, y = slice(cut[p], cut[p + 1]), own[cut_own[p] : cut_own[p + 1]]
                    rows.append(
                        (
                            "keys",
                            name,
                            int(p),
                            None,
                            short[x].tobytes() + several[x].astype(np.uint8).tobytes(),
                            mark[y].tobytes() + ids[y].tobytes() + y.astype(np.uint32).tobytes(),
                        ),
                    )
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)],
                    names=names,
                )
                W.returned()

    spark = docs.sparkSession
    path = new_folder(spark, "slices")
    docs.mapInArrow(cut, SLICE).write.partitionBy("kind").option("compression", "none").parquet(path)
    return spark.read.schema(SLICE).parquet(path)


def split_by(values: np.ndarray, of: np.ndarray, n: int) -> list[bytes]:
    """The values of each of n owners; owners ascend."""
    return [x.tobytes() for x in np.split(values, np.searchsorted(of, np.arange(1, n)))]


def shared_keys(code: DataFrame) -> DataFrame:
    """Per slice and bucket: anchors that another slice or document has too, and documents that copy one with a smaller id."""

    def meet(key, pdf):
        import pandas as pd

        W.returned()
        short, several, m, ids, local = [], [], [], [], []
        for a, b in zip(pdf["anchors"], pdf["marks"], strict=True):
            n, k = len(a) // 5, len(b) // 28
            short.append(np.frombuffer(a, np.uint32, n))
            several.append(np.frombuffer(a, np.uint8, n, 4 * n))
            m.append(np.frombuffer(b, np.uint64, 2 * k).reshape(-1, 2))
            ids.append(np.frombuffer(b, np.int64, k, 16 * k))
            local.append(np.frombuffer(b, np.uint32, k, 24 * k))
        h, flag = np.concatenate(short), np.concatenate(several).astype(bool)
        slice_of = np.repeat(np.arange(len(short)), [len(x) for x in short])
        _, number, count = np.unique(h, return_inverse=True, return_counts=True)
        twice = (count > 1) | (np.bincount(number, flag, len(count)) > 0)
        keep = twice[number] if len(h) else flag
        doc_slice = np.repeat(np.arange(len(ids)), [len(x) for x in ids])
        m, ids, local = np.concatenate(m), np.concatenate(ids), np.concatenate(local)
        order = np.lexsort((ids, m[:, 1], m[:, 0]))
        begin = np.ones(len(order), bool)
        begin[1:] = (m[order[1:]] != m[order[:-1]]).any(axis=1)
        least = ids[order][np.flatnonzero(begin)][np.cumsum(begin) - 1] if len(order) else ids
        copy = np.zeros(len(order), bool)
        copy[order] = ids[order] > least
        return pd.DataFrame({
            "slice": pdf["slice"], "bucket": key[0],
            "anchors": split_by(h[keep], slice_of[keep], len(pdf)),
            "copies": split_by(local[copy], doc_slice[copy], len(pdf)),
        })

    return (
        code.where("kind = 'keys'")
        .select("slice", "bucket", "anchors", "marks")
        .groupBy("bucket")
        .applyInPandas(meet, "slice string, bucket int, anchors binary, copies binary")
    )


def settled(w: W.Words, ids: np.ndarray, copies: np.ndarray, size: int):
    """Windows of documents that are no copies: their first words, fingerprints, and whether the slice itself repeats them earlier."""
    at = np.flatnonzero(W.inside_one(w.doc, size))
    whole = np.ones(len(ids), bool)
    whole[copies] = False
    whole[ids == _NO_ID] = False
    at = at[whole[w.doc[at]]]
    g = W.grams(w.hash, size)[at]
    own = ids[w.doc[at]]
    order = np.lexsort((own, g))
    begin = np.ones(len(order), bool)
    begin[1:] = g[order[1:]] != g[order[:-1]]
    again = np.flatnonzero(~begin)
    if len(again):  # equal fingerprints: the words decide
        number = W.numbered(w)
        if any((number[at[order[again]] + i] != number[at[order[again - 1]] + i]).any() for i in range(size)):
            words = np.stack([number[at + i] for i in range(size)], axis=1)
            g = np.unique(words, axis=0, return_inverse=True)[1].ravel().astype(np.uint64)
            order = np.lexsort((own, g))
            begin[1:] = g[order[1:]] != g[order[:-1]]
    least = own[order][np.flatnonzero(begin)][np.cumsum(begin) - 1] if len(order) else own
    repeated = np.zeros(len(at), bool)
    repeated[order] = own[order] > least
    first = np.zeros(len(at), bool)  # of equal windows of the slice's smallest document, the first
    first[order] = begin
    return at, g, repeated, first


def candidates(code: DataFrame, keys: DataFrame, key: str, text: str, size: int, parts: int) -> DataFrame:
    """Per slice (RUNS): runs of suffixes whose first words may occur elsewhere, as text, with their places."""

    def cut(_, left, right):
        import pandas as pd
        import zstandard

        W.returned()
        out, z = [], zstandard.ZstdCompressor(level=1)
        found = [(int(b), np.frombuffer(a, np.uint32)) for b, a in zip(right["bucket"], right["anchors"], strict=True)]
        known = np.sort(
            np.concatenate(
                [(np.uint64(b) << np.uint64(32)) | a.astype(np.uint64) for b, a in found] or [np.zeros(0, np.uint64)],
            ),
        )
        copies = np.concatenate([np.frombuffer(c, np.uint32) for c in right["copies"]] or [np.zeros(0, np.uint32)])
        for name, data in zip(left["slice"], left["data"], strict=True):
            batch = _load(data)
            w, ids = _words(batch, text), _ids(batch, key)
            at, _, _, first = settled(w, ids, copies, size)
            at = at[first]
            if not len(at) or not len(known):
                continue
            ok, place, g = anchors(w, size)
            h = g[place[np.searchsorted(ok, at)]]
            full = ((h % np.uint64(parts)) << np.uint64(32)) | ((h // np.uint64(parts)) & np.uint64(0xFFFFFFFF))
            at = at[known[np.minimum(np.searchsorted(known, full), len(known) - 1)] == full]
            if not len(at):
                continue
            new = np.append(True, (np.diff(at) != 1) | (np.diff(w.doc[at]) != 0))
            begin, last = at[new], at[np.append(np.flatnonzero(new)[1:], len(at)) - 1]
            n = last - begin + size
            of = np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            out.append(
                (
                    name,
                    z.compress(W.packed(w, of)),
                    n.astype(np.uint32).tobytes(),
                    begin.astype(np.uint32).tobytes(),
                    ids[w.doc[begin]].tobytes(),
                    len(at),
                ),
            )
        return pd.DataFrame(out, columns=["slice", "words", "sizes", "begins", "ids", "suffixes"])

    docs = code.where("kind = 'docs'").select("slice", "data")
    return docs.groupBy("slice").cogroup(keys.groupBy("slice")).applyInPandas(cut, RUNS)


def _suffixes(
    words: bytes,
    sizes: bytes,
    size: int,
    hashes: bool = True,
) -> tuple[W.Words, np.ndarray, np.ndarray, np.ndarray]:
    """The words of runs, where suffixes start in them, and each suffix's run and step in it."""
    import zstandard

    data = np.frombuffer(zstandard.ZstdDecompressor().decompress(words), np.uint8)
    w = W.split_buffer(data, np.array([0, len(data)]), hashes=hashes)
    n = np.frombuffer(sizes, np.uint32).astype(np.int64)
    count = n - size + 1
    run = np.repeat(np.arange(len(n)), count)
    step = np.arange(len(run)) - np.repeat(np.cumsum(count) - count, count)
    return w, (np.cumsum(n) - n)[run] + step, run, step


def prefixes(w: W.Words, starts: np.ndarray, heavy: list[np.ndarray], size: int) -> np.ndarray:
    """Fingerprint of each suffix's shortest prefix that is not among the heavy ones of its length; of `size` words, if all are."""
    key, left = W.grams(w.hash, 1)[starts], np.arange(len(starts))
    for depth, known in enumerate(heavy[: size - 1], 1):
        left = left[np.isin(key[left], known)]
        key[left] = W.grams(w.hash, depth + 1)[starts[left]]
    return key


def heavy_prefixes(runs: DataFrame, size: int, most: int) -> list[np.ndarray]:
    """For lengths 1, 2 ...: fingerprints of the prefixes that more than `most` suffixes begin with. A length has at most suffixes / most of them."""
    heavy: list[np.ndarray] = []

    def count(known):
        def counted(batches):
            import pyarrow as pa

            for batch in batches:
                for words, sizes in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    w, starts, _, _ = _suffixes(words, sizes, size)
                    for depth, table in enumerate(known.value, 1):
                        starts = starts[np.isin(W.grams(w.hash, depth)[starts], table)]
                    h, n = np.unique(W.grams(w.hash, len(known.value) + 1)[starts], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], names=["h", "n"])

        return counted

    while len(heavy) < size:
        known = runs.sparkSession.sparkContext.broadcast(heavy)
        rows = (
            runs.select("words", "sizes")
            .mapInArrow(count(known), "h long, n long")
            .groupBy("h")
            .agg(F.sum("n").alias("n"))
            .where(F.col("n") > most)
        )
        found = np.sort(np.array([r.h for r in rows.collect()], np.int64).view(np.uint64))
        if not len(found):
            break
        heavy.append(found)
    return heavy


def subtree(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes (rows of word numbers) in sorted order, and how many first words each has in common with the one before it."""
    order = np.lexsort(words.T[::-1])
    same = words[order[1:]] == words[order[:-1]]
    return order, np.append(0, np.cumprod(same, axis=1, dtype=np.int8).sum(axis=1, dtype=np.int64))[: len(order)]


def repeated_leaves(order: np.ndarray, common: np.ndarray, ids: np.ndarray, depth: int) -> np.ndarray:
    """Whether a suffix lies under an internal node of at least this depth, and a smaller id does too."""
    node = np.cumsum(common < depth) - 1
    least = np.full(len(order), _NO_ID)
    np.minimum.at(least, node, ids[order])
    out = np.zeros(len(order), bool)
    out[order] = ids[order] > least[node]
    return out


def subtree_repeats(runs: DataFrame, size: int) -> DataFrame:
    """Per slice: first words of its windows that a document with a smaller id has too."""
    spark, most = runs.sparkSession, GROUP
    total = runs.agg(F.sum("suffixes")).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // most))
    heavy = spark.sparkContext.broadcast(heavy_prefixes(runs, size, most))

    def deal(batches):
        import pyarrow as pa
        import zstandard

        z = zstandard.ZstdCompressor(level=1)
        kinds = [pa.string(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
        for batch in batches:
            for name, words, sizes, begins, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                w, starts, run, step = _suffixes(words, sizes, size)
                place, own = np.frombuffer(begins, np.uint32)[run] + step, np.frombuffer(ids, np.int64)[run]
                order, cut = dealt(prefixes(w, starts, heavy.value, size) % np.uint64(parts), parts)
                rows = []
                for p in np.flatnonzero(np.diff(cut)):
                    x = order[cut[p] : cut[p + 1]]
                    text = W.packed(w, (starts[x][:, None] + np.arange(size)).ravel())
                    rows.append(
                        (name, int(p), z.compress(text), place[x].astype(np.uint32).tobytes(), own[x].tobytes()),
                    )
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)],
                    names=[c.split()[0] for c in SUFFIXES.split(", ")],
                )
                W.returned()

    def build(key, pdf):
        import pandas as pd
        import zstandard

        W.returned()
        z = zstandard.ZstdDecompressor()
        data = np.frombuffer(b"".join(map(z.decompress, pdf["words"])), np.uint8)
        w = W.split_buffer(data, np.array([0, len(data)]), hashes=False)
        ids, place = (
            np.concatenate([np.frombuffer(x, t) for x in pdf[c]])
            for c, t in (("ids", np.int64), ("places", np.uint32))
        )
        of = np.repeat(np.arange(len(pdf)), [len(x) // 8 for x in pdf["ids"]])
        hit = repeated_leaves(*subtree(W.numbered(w).reshape(-1, size)), ids, size)
        return pd.DataFrame({"slice": pdf["slice"], "places": split_by(place[hit], of[hit], len(pdf))})

    rows = runs.select("slice", "words", "sizes", "begins", "ids").mapInArrow(deal, SUFFIXES)
    return rows.groupBy("bucket").applyInPandas(build, "slice string, places binary")


def rewritten(
    code: DataFrame,
    keys: DataFrame,
    repeats: DataFrame,
    columns: T.StructType,
    key: str,
    text: str,
    size: int,
    keep: list[str],
) -> DataFrame:
    """All rows, with the columns to keep, n_words, n_removed and kept_sha256; text, if kept, without the removed words."""
    schema = (
        T.StructType([columns[c] for c in keep])
        .add("n_words", "long")
        .add("n_removed", "long")
        .add("kept_sha256", "string")
    )

    def rewrite(_, left, right):
        import pandas as pd
        import pyarrow as pa

        W.returned()
        copies = np.concatenate(
            [np.frombuffer(c, np.uint32) for c in right["copies"] if c is not None] or [np.zeros(0, np.uint32)],
        )
        places = np.concatenate([np.frombuffer(p, np.uint32) for p in right["places"] if p is not None] or [np.zeros(0, np.uint32)]).astype(
            np.int64,
        )
        out = []
        for data in left["data"]:
            batch = _load(data)
            w, ids = _words(batch, text), _ids(batch, key)
            at, g, repeated, _ = settled(w, ids, copies, size)
            own = W.mix(g + W.mix(ids[w.doc[at]].view(np.uint64)))
            if len(places):  # the verdict on a window holds wherever its document, also in another row with the same id, repeats it
                repeated |= np.isin(own, own[np.searchsorted(at, places)])
            delta = np.zeros(len(w.hash) + 1, np.int64)
            np.add.at(delta, at[repeated], 1)
            np.add.at(delta, at[repeated] + size, -1)
            gone = np.cumsum(delta)[:-1] > 0
            gone |= np.isin(w.doc, copies)
            n = w.counts()
            removed = np.bincount(w.doc[gone], minlength=len(n))
            kept = np.flatnonzero(~gone)
            whole = W.packed(w, kept)
            length = np.bincount(w.doc[kept], (w.end - w.start + 1)[kept], len(n)).astype(np.int64)
            end = np.cumsum(length)
            texts = [whole[e - m : max(e - 1, e - m)] for e, m in zip(end, length, strict=True)]
            values = {}
            for c in keep:
                values[c] = batch.column(c)
                if c == text:
                    old = values[c].to_pylist()
                    values[c] = pa.array(
                        [
                            t.decode("utf-8", "surrogatepass") if r else o
                            for t, r, o in zip(texts, removed, old, strict=True)
                        ],
                        pa.string(),
                    )
            frame = pa.table(values).to_pandas(integer_object_nulls=True) if keep else pd.DataFrame(index=range(len(n)))
            frame["n_words"], frame["n_removed"] = n, removed
            frame["kept_sha256"] = [hashlib.sha256(t).hexdigest() for t in texts]
            out.append(frame)
        return pd.concat(out) if out else pd.DataFrame(columns=schema.names, dtype=object)

    docs = code.where("kind = 'docs'").select("slice", "data")
    both = keys.select("slice", "copies", F.lit(None).cast("binary").alias("places")).unionByName(
        repeats.select("slice", F.lit(None).cast("binary").alias("copies"), "places"),
    )
    return docs.groupBy("slice").cogroup(both.groupBy("slice")).applyInPandas(rewrite, schema)


def deduplicated(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    size: int = 13,
    keep: list[str] | None = None,
    slice_bytes: int = 3 << 20,
) -> DataFrame:
    """Rows of docs with their columns (or those to keep), n_words, n_removed and kept_sha256; columns of these names are replaced."""
    spark, parts = docs.sparkSession, buckets(docs)
    small_batches(spark)
    names = ("n_words", "n_removed", "kept_sha256")
    keep = [c for c in (docs.columns if keep is None else keep) if c not in names]
    docs = docs.select(*dict.fromkeys([*keep, key, text]))
    code = sliced(docs, key, text, size, parts, slice_bytes)
    keys = written(spark, shared_keys(code), "keys")
    runs = written(spark, candidates(code, keys, key, text, size, parts), "runs", "none")
    repeats = written(spark, subtree_repeats(runs, size), "repeats")
    dropped(runs)
    return rewritten(code, keys, repeats, docs.schema, key, text, size, keep)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicated(table(spark, sf_dir, "documents"), keep=["doc_id"]).select(
        "doc_id",
        "n_words",
        "n_removed",
        "kept_sha256",
    )


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without repeated passages; those that consist of them entirely go."""

    def without_passages(own: DataFrame) -> DataFrame:
        out = deduplicated(own).where("n_removed = 0 or n_removed < n_words")
        if "n_chars" not in own.columns:
            return out
        shorter = F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("n_chars"))
        return out.withColumn("n_chars", shorter.cast(own.schema["n_chars"].dataType))

    return apart(docs, without_passages, "doc_id", "text", "n_chars")
