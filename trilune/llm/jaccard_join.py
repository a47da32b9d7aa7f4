"""Near-duplicate documents by a vertically partitioned Jaccard join on word shingles.

All shingles have one global order: by fingerprint, those found frequent behind all
others. Fixed places of it cut every set into fragments. Two sets similar enough share a shingle among the
first few of each, the prefix, so that candidates come from posting lists of prefixes alone, dealt out by
fingerprint in packed arrays. For the candidates, fragments are rows of their own, dealt out by
fragment and document: a task sees one fragment of two sets, never whole ones, and counts the overlap in it; the
partial overlaps are summed per pair. Documents with equal sets form a class and are compared once.

Components need a spanning set of links, not all of them. Long candidate lists are
therefore compared with a few leaders first; documents that a link connects already
need no further comparison. What stays unconnected in a list is compared in full: short lists pair
by pair, long ones in blocks, inside the tasks, which return links only; there a block's fragments are counted
one after the other and summed in the task, since partial counts of all its pairs must not leave it. No list, pair or document
is left out, whatever its frequency.

Texts with fewer words than a shingle are one shingle; null texts, and those without
words, have none and link with nothing. Null ids link with nothing and have no component. Rows
with the same id are one node of the link graph, one row each of the result. Other columns are not
used, whatever their names. An empty table gives an empty one. Fingerprints have 64 bits.
"""

from __future__ import annotations

from itertools import count

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trilune.llm import words as W
from trilune.llm.common import SENT_BYTES, buckets, dropped, small_batches, table, without, written

FRAGMENTS = 4
SHORT = 100  # lists up to this long give all their pairs of like size
BLOCK = 2048  # rows and columns of a block of comparisons, at most


def shingles(w: W.Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of each text's distinct shingles and the text of each, in order of (text, fingerprint)."""
    h = W.grams(w.hash, size)
    own = W.inside_one(w.doc, size)
    h, doc = h[own], w.doc[: len(own)][own]
    n = w.counts()
    for m in range(1, size):  # texts of m words
        few = np.flatnonzero(n == m)
        if len(few):
            g = W.grams(w.hash, m)[w.first[few]] + np.uint64(m)
            h, doc = np.append(h, W.mix(g)), np.append(doc, few)
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return h[new], doc[new]


def overlap_needed(n, percent: int):
    """Least overlap of a set of n with any set as similar as asked."""
    return (percent * n + 99) // 100


def frequent(
    docs: DataFrame,
    text: str,
    size: int,
    local: int = 3,
    least: int = 32,
    most: int = 200_000,
    at_once: int = 8_000_000,
) -> np.ndarray:
    """Fingerprints of frequent shingles, most frequent last: at most `most`. They only order, so any set is right.

    Tasks count what they hold, at_once shingles at a time, and pass on what they saw `local` times or more.
    """

    def count(batches):
        import pyarrow as pa

        def told(held):
            h, n = np.unique(np.concatenate(held), return_counts=True)
            often = n >= local
            return pa.RecordBatch.from_arrays([pa.array(h[often].view(np.int64)), pa.array(n[often])], names=["h", "n"])

        held, n = [], 0
        for batch in batches:
            for _, _, w in W.chunks(batch.column(0), lower=True):
                held.append(shingles(w, size)[0])
                n += len(held[-1])
                if n >= at_once:
                    yield told(held)
                    held, n = [], 0
        if n:
            yield told(held)

    counts = docs.select(text).mapInArrow(count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    rows = counts.where(F.col("n") >= least).orderBy(F.desc("n"), "h").limit(most).select("h").toArrow().column(0)
    return np.asarray(rows.combine_chunks() if rows.num_chunks else [], np.int64)[::-1].copy().view(np.uint64)


def ranks(h: np.ndarray, often: np.ndarray) -> np.ndarray:
    """Place of each shingle in the global order: by fingerprint, the frequent ones behind all others, in the order given."""
    rank = h >> np.uint64(1)
    if len(often):
        late = np.argsort(often, kind="stable")
        known = often[late]
        at = np.minimum(np.searchsorted(known, h), len(known) - 1)
        hit = known[at] == h
        rank[hit] = np.uint64(1 << 63) + late[at[hit]].astype(np.uint64)
    return rank


def signatures(docs: DataFrame, key: str, text: str, size: int, percent: int, often: np.ndarray) -> DataFrame:
    """Per row: id, n (size of its set), mark (fingerprint of the whole set) and prefix (first shingles in the global order)."""
    sent = docs.sparkSession.sparkContext.broadcast(often)  # at most `most` fingerprints

    def sign(batches):
        import pyarrow as pa

        for batch in batches:
            for a, b, w in W.chunks(batch.column(1), lower=True):
                h, doc = shingles(w, size)
                n = np.bincount(doc, minlength=b - a)
                begin = np.cumsum(n) - n
                order = np.lexsort((ranks(h, sent.value), doc))
                h = h[order]
                some = n > 0
                mark = np.zeros((b - a, 2), np.uint64)
                if len(h):
                    for i in range(2):
                        mark[some, i] = np.add.reduceat(W.mix(h + W._LANE[i]), begin[some])
                first = np.where(some, n - overlap_needed(n, percent) + 1, 0)
                rows = h.tobytes()
                prefix = [rows[8 * x : 8 * (x + y)] for x, y in zip(begin, first, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, b - a),
                        pa.array(n, pa.int64()),
                        pa.array([m.tobytes() for m in mark], pa.binary()),
                        pa.array(prefix, pa.binary()),
                    ],
                    names=["id", "n", "mark", "prefix"],
                )

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("id"), text).mapInArrow(sign, f"id {kind}, n long, mark binary, prefix binary")


def candidate_lists(signed: DataFrame, parts: int) -> DataFrame:
    """Lists of documents (ids, sizes) that share prefix shingles, and how many; the same list once per bucket.

    Of documents with equal sets, one stands for all that meet.
    """

    def deal(batches):
        import pyarrow as pa

        for batch in batches:
            W.returned()
            ids, sizes = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64), batch.column(1).to_numpy(zero_copy_only=False)
            marks = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint64).reshape(-1, 2)
            order = np.lexsort((ids, marks[:, 1], marks[:, 0]))
            same = np.ones(len(order), bool)
            same[1:] = (marks[order[1:]] != marks[order[:-1]]).any(axis=1)
            prefixes = batch.column(3).to_pylist()
            one = np.sort(order[same])
            tokens = np.frombuffer(b"".join(prefixes[i] for i in one), np.uint64)
            doc = np.repeat(np.arange(len(one)), [len(prefixes[i]) // 8 for i in one]).astype(np.uint32)
            bucket = (tokens % np.uint64(parts)).astype(np.int64)
            by = np.argsort(bucket, kind="stable")
            tokens, doc = tokens[by], doc[by]
            cut = np.searchsorted(bucket[by], np.arange(parts + 1))
            rows = []
            for p in range(parts):
                x = slice(cut[p], cut[p + 1])
                if x.stop > x.start:
                    own, local = np.unique(doc[x], return_inverse=True)
                    rows.append(
                        (
                            p,
                            tokens[x].tobytes(),
                            local.astype(np.uint32).tobytes(),
                            ids[one[own]].tobytes(),
                            sizes[one[own]].astype(np.uint32).tobytes(),
                            marks[one[own], 0].tobytes(),
                        ),
                    )
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, pa.int32() if i == 0 else pa.binary()) for i, c in enumerate(zip(*rows, strict=True))],
                    names=["bucket", "tokens", "doc", "ids", "sizes", "marks"],
                )

    def meet(key, pdf):
        import pandas as pd

        W.returned()
        load = lambda c, t: [np.frombuffer(x, t) for x in pdf[c]]
        ids, tables = load("ids", np.int64), load("doc", np.uint32)
        base = np.cumsum([0, *map(len, ids)])
        token = np.concatenate(load("tokens", np.uint64))
        doc = np.concatenate([d.astype(np.int64) + b for d, b in zip(tables, base, strict=False)])
        ids, sizes, marks = np.concatenate(ids), np.concatenate(load("sizes", np.uint32)).astype(np.int64), np.concatenate(load("marks", np.uint64))
        order = np.lexsort((ids[doc], marks[doc], token))
        token, doc = token[order], doc[order]
        keep = np.ones(len(token), bool)
        keep[1:] = (token[1:] != token[:-1]) | (marks[doc[1:]] != marks[doc[:-1]])
        token, doc = token[keep], doc[keep]
        cut = np.flatnonzero(np.append(True, token[1:] != token[:-1])) if len(token) else np.zeros(0, int)
        length = np.diff(np.append(cut, len(token)))
        lists: dict[bytes, list] = {}
        for a, m in zip(cut[length > 1], length[length > 1], strict=True):
            some = doc[a : a + m]
            some = some[np.lexsort((ids[some], sizes[some]))]
            lists.setdefault(ids[some].tobytes(), [sizes[some], 0])[1] += 1
        return pd.DataFrame(
            {
                "ids": [np.frombuffer(k, np.int64) for k in lists],
                "sizes": [v[0] for v in lists.values()],
                "tokens": [v[1] for v in lists.values()],
            },
            dtype=object,
        )

    rows = signed.where("n > 0 and id is not null").mapInArrow(
        deal,
        "bucket int, tokens binary, doc binary, ids binary, sizes binary, marks binary",
    )
    return rows.groupBy("bucket").applyInPandas(meet, "ids array<long>, sizes array<long>, tokens long")


def _least(a, b, percent: int):
    """Least overlap of sets of a and b for the similarity asked; columns or arrays."""
    return (percent * (a + b) + 99 + percent) // (100 + percent)


def pairs_of_short(lists: DataFrame, percent: int) -> DataFrame:
    """Pairs x < y of like size from lists of at most SHORT, with the prefix shingles that they share in them."""

    def told(held):
        import pyarrow as pa

        rows = np.concatenate(held)
        turn = rows[:, 0] > rows[:, 1]
        rows[turn] = rows[turn][:, [1, 0, 3, 2, 4]]
        rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
        new = (
            np.flatnonzero(np.append(True, (rows[1:, :2] != rows[:-1, :2]).any(axis=1)))
            if len(rows)
            else np.zeros(0, int)
        )
        shared = np.add.reduceat(rows[:, 4], new) if len(new) else np.zeros(0, np.int64)
        return pa.RecordBatch.from_arrays(
            [*(pa.array(rows[new, c]) for c in range(4)), pa.array(shared)],
            names=["x", "y", "nx", "ny", "shared"],
        )

    def pair(batches):
        held, size = [], 0
        for batch in batches:
            for ids, sizes, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                i, s = np.array(ids), np.array(sizes)
                a, b = np.triu_indices(len(i), 1)
                like = 100 * s[a] >= percent * s[b]  # sizes ascend
                held.append(np.stack([i[a], i[b], s[a], s[b], np.full(len(a), n)], axis=1)[like])
                size += len(held[-1])
                if size >= 500_000:
                    yield told(held)
                    held, size = [], 0
        if held:
            yield told(held)

    # Lists of the same documents come together, so that a pair is told about once per task, not once per bucket.
    lists = (
        lists.where(F.size("ids") <= SHORT)
        .withColumn("_least", F.array_min("ids"))
        .repartition("_least")
        .drop("_least")
    )
    rows = lists.mapInArrow(pair, "x long, y long, nx long, ny long, shared long")
    return rows.groupBy("x", "y", "nx", "ny").agg(F.sum("shared").alias("shared"))


def joined_up(batches):
    """(id, component) of the links (x, y) of one task: labels pass to the smaller end, and jump to their labels' labels."""
    import pyarrow as pa

    rows = [b for b in batches if len(b)]
    if not rows:
        return
    x, y = (np.concatenate([b.column(i).to_numpy(zero_copy_only=False) for b in rows]) for i in (0, 1))
    ids, place = np.unique(np.concatenate([x, y]), return_inverse=True)
    a, b = np.split(place, 2)
    label = np.arange(len(ids))
    while True:
        new = label.copy()
        least = np.minimum(label[a], label[b])
        for end in (a, b, label[a], label[b]):
            np.minimum.at(new, end, least)
        new = new[new]
        if (new == label).all():
            break
        label = new
    yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(ids[label])], names=["id", "component"])


def components(
    spark: SparkSession,
    links: DataFrame,
    most_rounds: int | None = None,
    at_once: int = 1_000_000,
) -> DataFrame:
    """(id, component) of each node of links (x, y); the component is its smallest id.

    Up to at_once links, 16 bytes each, are joined up in one task. More of them take large and small stars in turn, until nothing
    changes; that fails where it takes more than most_rounds.
    """
    edges = written(
        spark,
        links.select(F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y")).where("x <> y").distinct(),
        "edges",
    )
    if edges.count() <= at_once:
        return written(spark, edges.coalesce(1).mapInArrow(joined_up, "id long, component long"), "components")
    state = None
    for n in count():
        if n == most_rounds:
            raise RuntimeError(f"not settled after {most_rounds} rounds")
        both = edges.unionByName(edges.select(F.col("y").alias("x"), F.col("x").alias("y")))
        least = both.groupBy("x").agg(F.min("y").alias("m")).withColumn("m", F.least("m", "x"))
        large = both.join(least, "x").where("y > x").select(F.col("y").alias("x"), F.col("m").alias("y")).distinct()
        least = large.groupBy("x").agg(F.min("y").alias("m"))
        small = (
            large.join(least, "x")
            .where("y <> m")
            .select(F.col("y").alias("x"), F.col("m").alias("y"))
            .unionByName(least.select("x", F.col("m").alias("y")))
        )
        old, edges = edges, written(spark, small.select(F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y")).where("x <> y").distinct(), "edges")
        dropped(old)
        new = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("x", "y").cast("decimal(38,0)"))).first())
        if new == state or not new[0]:
            break
        state = new
    roots = edges.select(F.col("y").alias("id")).distinct().withColumn("component", F.col("id"))
    return edges.select(F.col("x").alias("id"), F.col("y").alias("component")).unionByName(roots)


def only(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows whose id is among the given distinct ones, which go to every task up to a size and beyond it are joined by a shuffle."""
    few = ids.count() * 8 <= SENT_BYTES
    return rows.join(F.broadcast(ids) if few else ids, "id", "left_semi")


def sets_of(docs: DataFrame, ids: DataFrame, key: str, text: str, size: int) -> DataFrame:
    """(id, n, set): shingles in order of fingerprint of the documents with the given distinct ids."""

    def cut(batches):
        import pyarrow as pa

        for batch in batches:
            for a, b, w in W.chunks(batch.column(1), lower=True):
                h, doc = shingles(w, size)
                n = np.bincount(doc, minlength=b - a)
                at = np.append(0, np.cumsum(n))
                data = h.tobytes()
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, b - a),
                        pa.array(n, pa.int64()),
                        pa.array([data[8 * i : 8 * j] for i, j in zip(at[:-1], at[1:], strict=True)], pa.binary()),
                    ],
                    names=["id", "n", "set"],
                )

    rows = only(docs.select(F.col(key).alias("id"), F.col(text).alias("text")), ids)
    return written(docs.sparkSession, rows.mapInArrow(cut, "id long, n long, set binary"), "sets", "none")


def fragments(rows: DataFrame, size: int, sent) -> DataFrame:
    """rows (numbers, and last a text) as their numbers, fragment, n, mark, part: the set's size and fingerprint, and its shingles in that fragment. Empty fragments have no row.

    sent: the broadcast fingerprints of frequent shingles, which the last fragment holds.
    """
    kept = rows.columns[:-1]

    def cut(batches):
        import pyarrow as pa

        edges = np.array([(i << 63) // (FRAGMENTS - 1) for i in range(1, FRAGMENTS)], np.uint64)
        for batch in batches:
            for a, b, w in W.chunks(batch.column(len(kept)), lower=True):
                h, doc = shingles(w, size)
                n = np.bincount(doc, minlength=b - a)
                mark = np.zeros(b - a, np.uint64)
                np.add.at(mark, doc, W.mix(h + W._LANE[0]))
                fragment = np.searchsorted(edges, ranks(h, sent.value), "right")
                order = np.lexsort((h, fragment, doc))
                own = (doc * FRAGMENTS + fragment)[order]
                begin = np.flatnonzero(np.append(True, own[1:] != own[:-1])) if len(own) else np.zeros(0, int)
                data = h[order].tobytes()
                part = [data[8 * i : 8 * j] for i, j in zip(begin, np.append(begin[1:], len(own)), strict=True)]
                which = own[begin] // FRAGMENTS
                take = pa.array(which)
                yield pa.RecordBatch.from_arrays(
                    [
                        *(batch.column(i).slice(a, b - a).take(take) for i in range(len(kept))),
                        pa.array(own[begin] % FRAGMENTS, pa.int32()),
                        pa.array(n[which], pa.int64()),
                        pa.array(mark[which].view(np.int64)),
                        pa.array(part, pa.binary()),
                    ],
                    names=[*kept, "fragment", "n", "mark", "part"],
                )

    kinds = ", ".join(f"{c} long" for c in kept)
    return rows.mapInArrow(cut, f"{kinds}, fragment int, n long, mark long, part binary")


def shared(a: bytes, b: bytes) -> int:
    """How many shingles two sorted sets share."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    if not len(x) or not len(y):
        return 0
    return int(np.count_nonzero(y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x))


def ranges(h: np.ndarray) -> list[np.ndarray]:
    """A sorted set cut at fixed places of the order of fingerprints."""
    edges = np.array([(i << 64) // FRAGMENTS for i in range(1, FRAGMENTS)], np.uint64)
    return np.split(h, np.searchsorted(h, edges))


def verified(pairs: DataFrame, docs: DataFrame, key: str, text: str, size: int, sent, percent: int) -> DataFrame:
    """The pairs (x, y), a table, that are similar enough.

    Texts are cut to fragments where they are read, already with the pair that they are read for, so that a fragment is exchanged
    once: those of y go to where that fragment of x is; a frequent x is split by the join.
    """
    names = ["x", "y", "rx", "ry", "m", "n", "fragment"]

    def count(batches):
        import pyarrow as pa

        for batch in batches:
            a, b = (batch.column(i).to_pylist() for i in (-2, -1))
            n = pa.array([shared(u, v) for u, v in zip(a, b, strict=True)], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], n], names=[*names, "overlap"])

    few = pairs.count() * 16 <= SENT_BYTES
    texts = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))

    def side(rows: DataFrame, of: str, *named: str) -> DataFrame:
        read = texts.join(F.broadcast(rows) if few else rows, texts["id"] == rows[of]).select(*rows.columns, "text")
        found = fragments(read, size, sent)
        return found.select(*rows.columns, "fragment", *[F.col(c).alias(a) for c, a in zip(("n", "mark", "part"), named, strict=True)])

    left, right = side(pairs.select("x", "y"), "y", "n", "ry", "b"), side(pairs.select("x").distinct(), "x", "m", "rx", "a")
    both = left.join(right, ["x", "fragment"])
    kinds = [f"{c} {'int' if c == 'fragment' else 'long'}" for c in (*names, "overlap")]
    found = both.select(*names, "a", "b").mapInArrow(count, ", ".join(kinds))
    # Rows that repeat an id and its text count once; rows of one id with several texts are apart.
    once = [F.max(F.when(F.col("fragment") == f, F.col("overlap"))).alias(f"o{f}") for f in range(FRAGMENTS)]
    total = sum((F.coalesce(f"o{f}", F.lit(0)) for f in range(FRAGMENTS)), F.lit(0))
    sums = found.groupBy(*names[:-1]).agg(*once).withColumn("overlap", total)
    return (
        sums.where(100 * F.col("overlap") >= percent * (F.col("m") + F.col("n") - F.col("overlap")))
        .select("x", "y")
        .distinct()
    )


def promising(pairs: DataFrame, prefixes: DataFrame, percent: int) -> DataFrame:
    """The pairs whose prefixes share enough for the rest to suffice."""

    def compare(batches):
        import pyarrow as pa

        for batch in batches:
            x, y, a, m, b, n = (c.to_pylist() for c in batch.columns)
            ok = [
                (
                    (
                        shared(bytes(np.sort(np.frombuffer(u, np.uint64))), bytes(np.sort(np.frombuffer(v, np.uint64))))
                        + max(i - len(u) // 8, j - len(v) // 8)
                    )
                    >= _least(i, j, percent)
                )
                for u, i, v, j in zip(a, m, b, n, strict=True)
            ]
            ok = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(ok), batch.column(1).filter(ok)], names=["x", "y"])

    own = lambda i, a, n: prefixes.select(F.col("id").alias(i), F.col("set").alias(a), F.col("n").alias(n))
    both = pairs.select("x", "y").join(own("y", "b", "bn"), "y").join(own("x", "a", "an"), "x")
    return both.select("x", "y", "a", "an", "b", "bn").mapInArrow(compare, "x long, y long").distinct()


def overlaps(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Overlap of every set of a with every set of b, as sums over ranges of the shingles that both sides hold."""
    out = np.zeros((len(a), len(b)), np.float32)
    for p, q in zip(zip(*map(ranges, a), strict=True), zip(*map(ranges, b), strict=True), strict=True):
        u, v = np.concatenate(p), np.concatenate(q)
        shared = np.intersect1d(u, v)
        i, j = np.repeat(np.arange(len(a)), [len(x) for x in p]), np.repeat(np.arange(len(b)), [len(x) for x in q])
        for lo in range(0, len(shared), 2048):
            some = shared[lo : lo + 2048]
            m = []
            for h, row, n in ((u, i, len(a)), (v, j, len(b))):
                at = np.minimum(np.searchsorted(some, h), len(some) - 1)
                hit = some[at] == h
                x = np.zeros((n, len(some)), np.float32)
                x[row[hit], at[hit]] = 1
                m.append(x)
            out += m[0] @ m[1].T
    return out


def in_blocks(asked: DataFrame, members: DataFrame, sets: DataFrame, percent: int, whole: bool) -> DataFrame:
    """Each asked document (part, id, c) against all members of its part in other components c, in blocks.

    With whole sets: links (x, y) that span what is linked. With prefixes only: (part, id) of the
    documents that may link, on either side.
    """
    # Blocks of up to BLOCK rows; groups of fewer than eight such blocks are cut into eight, for as many tasks.
    size = F.least(F.lit(BLOCK), F.greatest(F.lit(-(-BLOCK // 8)), F.ceil(F.count(F.lit(1)) / 8)))
    blocks = lambda rows, name: rows.groupBy("part").agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias(name))
    n = blocks(members, "nb").join(blocks(asked, "na"), "part")
    salt = lambda c: F.pmod(F.xxhash64(F.lit("b"), "id"), F.col(c)).cast("int")
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    left = (
        asked.join(n, "part")
        .select("part", "id", "c", salt("na").alias("a"), every("nb").alias("b"))
        .join(sets, "id")
    )
    right = (
        members.join(n, "part")
        .select("part", "id", "c", salt("nb").alias("b"), every("na").alias("a"))
        .join(sets, "id")
    )

    def compare(key, p, q):
        import pandas as pd

        names = ["x", "y"] if whole else ["part", "id"]
        if not len(p) or not len(q):
            return pd.DataFrame({c: [] for c in names})
        s, t = ([np.frombuffer(x, np.uint64) for x in f["set"]] for f in (p, q))
        m, n = p["n"].to_numpy()[:, None], q["n"].to_numpy()[None, :]
        least = _least(m, n, percent)
        if not whole:
            held = [np.array([len(x) for x in f]) for f in (s, t)]
            least = least - np.maximum(m - held[0][:, None], n - held[1][None, :])
        i, j = np.nonzero((overlaps(s, t) >= least) & (p["c"].to_numpy()[:, None] != q["c"].to_numpy()[None, :]))
        x, y = p["id"].to_numpy()[i], q["id"].to_numpy()[j]
        if not whole:
            return pd.DataFrame({"part": key[0], "id": np.unique(np.concatenate([x, y]))})
        root: dict = {}

        def find(v):
            while root.setdefault(v, v) != v:
                root[v] = v = root[root[v]]
            return v

        keep = []
        for u, v in zip(x, y, strict=True):
            u, v = find(u), find(v)
            if u != v:
                root[max(u, v)] = min(u, v)
                keep.append((u, v))
        return pd.DataFrame(keep, columns=names)

    keys = ["part", "a", "b"]
    left, right = (x.select(*[F.col(c).alias(c) for c in (*keys, "id", "c", "n", "set")]) for x in (left, right))
    found = (
        left.groupBy(*keys)
        .cogroup(right.groupBy(*keys))
        .applyInPandas(compare, "x long, y long" if whole else "part long, id long")
    )
    return found.distinct()


def labelled(frame: DataFrame, found: DataFrame, *columns: str) -> DataFrame:
    """frame with the component of each column's id as c_<column>; ids without links are their own."""
    for c in columns:
        frame = (
            frame.join(found.select(F.col("id").alias(c), F.col("component").alias(f"_{c}")), c, "left")
            .withColumn(f"c_{c}", F.coalesce(f"_{c}", c))
            .drop(f"_{c}")
        )
    return frame


def equal_sets(signed: DataFrame, many: int = 10_000) -> DataFrame:
    """Links (x, y) of each document with the smallest id of its set. Sets that more than `many` documents have are no key of an exchange: there are at most rows / many of them."""
    spark, rows = signed.sparkSession, signed.where("n > 0 and id is not null").select("id", "mark")
    same = written(
        spark,
        rows.groupBy("mark").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("rows")).where("rows > 1"),
        "equal",
    )
    few = same.count() * 32 <= SENT_BYTES
    hot = same if few else same.where(F.col("rows") > many)
    links = rows.join(F.broadcast(hot.select("mark", "first")), "mark")
    if not few:
        links = links.unionByName(rows.join(same.where(F.col("rows") <= many).select("mark", "first"), "mark"))
    return links.where("id <> first").select(F.col("id").alias("x"), F.col("first").alias("y"))


def linked_components(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    size: int = 5,
    percent: int = 80,
) -> DataFrame:
    """Per row: key, n_shingles and component_id, the smallest id that links reach."""
    spark, parts = docs.sparkSession, buckets(docs)
    small_batches(spark)
    often = frequent(docs, text, size)
    signed = written(spark, signatures(docs, key, text, size, percent, often), "signatures")
    lists = written(spark, candidate_lists(signed, parts), "lists")
    # Candidates: pairs of short lists that share enough, and each long list's members with its smallest id.
    long = lists.where(F.size("ids") > SHORT)
    member = long.select(F.array_min("ids").alias("part"), "tokens", F.explode(F.arrays_zip("ids", "sizes")).alias("m")).select(
        "part",
        "tokens",
        F.col("m.ids").alias("id"),
        F.col("m.sizes").alias("n"),
    )
    unseen = written(spark, member.groupBy("id").agg(F.sum("tokens").alias("unseen")), "unseen")
    member = written(spark, member.select("part", "id", "n").distinct(), "members")
    pairs = pairs_of_short(lists, percent)
    for c in "xy":  # shingles that long lists hide from short ones may be shared as well
        pairs = pairs.join(unseen.select(F.col("id").alias(c), F.col("unseen").alias(f"u{c}")), c, "left")
    need = lambda n: F.floor((F.col(n) * percent + 99) / 100)
    least = F.floor(((F.col("nx") + F.col("ny")) * percent + 99 + percent) / (100 + percent))
    at_most = (
        F.col("shared")
        + F.least(F.coalesce("ux", F.lit(0)), F.coalesce("uy", F.lit(0)))
        + F.greatest(need("nx"), need("ny"))
        - 1
    )
    pairs = pairs.where(at_most >= least).select(
        "x",
        "y",
        F.least(F.coalesce("ux", F.lit(0)), F.coalesce("uy", F.lit(0))).alias("unseen"),
    )
    leader = member.where("part = id").select("part", F.col("n").alias("nl"))
    led = member.join(leader, "part").where(
        (F.col("id") != F.col("part")) & (100 * F.least("n", "nl") >= percent * F.greatest("n", "nl")),
    )
    led = led.select(F.col("part").alias("x"), F.col("id").alias("y"), F.lit(1).cast("long").alias("unseen"))
    pairs = written(spark, pairs.unionByName(led).groupBy("x", "y").agg(F.min("unseen").alias("unseen")), "pairs")
    # Where long lists hide what a pair shares, the whole first fragment, the prefix, is compared.
    ids_of = lambda rows: written(spark, rows.select(F.col("x").alias("id")).union(rows.select("y")).distinct(), "ids")
    prefixes = signed.select("id", "n", F.col("prefix").alias("set"))
    unsure = pairs.where("unseen > 0").select("x", "y")
    pairs = written(
        spark,
        (
            pairs.where("unseen = 0")
            .select("x", "y")
            .unionByName(promising(unsure, only(prefixes, ids_of(unsure)), percent))
        ),
        "promising",
    )
    # First each document with its smallest partner, then what that leaves unconnected.
    sent = spark.sparkContext.broadcast(often)  # at most `most` fingerprints
    similar = lambda rows: verified(rows, docs, key, text, size, sent, percent)
    first = written(spark, pairs.groupBy("y").agg(F.min("x").alias("x")), "first")
    links = written(spark, similar(first), "links")
    found = components(spark, links)
    open_ = written(spark, labelled(pairs, found, "x", "y").where("c_x <> c_y").select("x", "y"), "open")
    links = written(spark, links.unionByName(similar(open_)), "links")
    found = components(spark, links)
    dropped(first, pairs, open_, lists)
    # Long lists that are not one component yet: those outside their largest component against all, by prefixes first.
    named = labelled(member.select("part", "id"), found, "id")
    count = named.groupBy("part", "c_id").count()
    main = (
        count.groupBy("part")
        .agg(F.max_by("c_id", F.struct("count", "c_id")).alias("main"), F.count(F.lit(1)).alias("n"))
        .where("n > 1")
    )
    rest = written(
        spark,
        named.join(main, "part").select(
            "part",
            "id",
            F.col("c_id").alias("c"),
            (F.col("c_id") != F.col("main")).alias("asks"),
        ),
        "rest",
    )
    if not rest.isEmpty():
        halves = lambda r: (r.where("asks").drop("asks"), r.drop("asks"))
        near = written(
            spark,
            in_blocks(*halves(rest), only(prefixes, rest.select("id").distinct()), percent, False),
            "near",
        )
        rest = written(spark, rest.join(near, ["part", "id"], "left_semi"), "rest")
        sets = sets_of(docs, rest.select("id").distinct(), key, text, size)
        links = written(spark, links.unionByName(in_blocks(*halves(rest), sets, percent, True)), "links")
        found = components(spark, links)
    # Documents with equal sets share the component of the smallest id among them.
    whole = components(spark, links.unionByName(equal_sets(signed)))
    dropped(links)
    out = signed.select("id", "n").join(whole, "id", "left")
    return out.select(
        F.col("id").alias(key),
        F.col("n").alias("n_shingles"),
        F.coalesce("component", "id").alias("component_id"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked_components(table(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component stays, that with the smallest id; documents without an id all stay."""
    gone = linked_components(docs).where("component_id <> doc_id").select("doc_id")
    return without(docs, gone, "doc_id").select(*docs.columns)
