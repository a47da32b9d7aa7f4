"""Vectors of texts from the corpus itself: latent semantic analysis by a randomised singular value decomposition.

The matrix A has a row per document and a column per term; an entry is (1 + ln tf) * (1 + ln((1 + n) / (1 + df))). It is never
built: documents are dealt to parts once and packed there as numbers, and a pass over the parts multiplies by A and then by A
transposed. Random signs, from a hash of the term, span the first directions; each power step is such a pass and makes the
directions orthonormal. Only matrices of directions x directions reach the driver.

Between parts one row is exchanged for each term of a part, not for each posting, there and back. A term that only one document has
is not exchanged: it multiplies this document's own row by its squared weight. A part has PART_BYTES of text at most (or one
document), so that a task holds its terms' rows, as they come and once more; parts become more with the texts.

Null and empty texts have zero vectors. Documents with the same key are one document. Fewer than `size` singular
values above zero give vectors of fewer numbers, none give vectors without numbers.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trilune.functions.text import remove_stopwords, tokenize
from trilune.operators.retrieval import terms
from trilune.sources.tables import stored

#: Bytes of text in a part at most; groups of documents that parts do not mix; parts of small inputs.
PART_BYTES, GROUPS, LEAST_PARTS = 64 << 20, 64, 8
#: Tokens of a chunk (or one document's); a term that one in DENSE of a chunk's documents has is a row of a matrix; rows handed on at a time.
CHUNK_TOKENS, DENSE, ROWS = 1 << 20, 10, 1 << 14


def columns(l: int, name: str = "q") -> list[str]:
    return [f"{name}{i}" for i in range(l)]


def gram(rows: DataFrame, l: int) -> np.ndarray:
    """The sum of the outer products of rows' columns q0, q1 ...: l x l numbers per task, then summed."""

    def moments(batches):
        import pyarrow as pa

        total = np.zeros((l, l))
        for batch in batches:
            x = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns], axis=1) if batch.num_rows else np.zeros((0, l))
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array([total.ravel().tolist()], pa.list_(pa.float64()))], ["g"])

    found = rows.select(*columns(l)).mapInArrow(moments, "g array<double>")
    sums = found.select(F.posexplode("g").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v")).orderBy("i").collect()
    return np.array([r.v for r in sums] or np.zeros(l * l)).reshape(l, l)


def whitened(g: np.ndarray) -> np.ndarray:
    """M with M' g M the identity, without the directions in which g is nothing."""
    value, vector = np.linalg.eigh(g)
    use = value > max(value.max(initial=0) * 1e-12, 1e-300)
    return vector[:, use] / np.sqrt(value[use])


def parts_of(docs: DataFrame, key: str, text: str, together: str | None) -> tuple[DataFrame, int]:
    """Documents (key, text) with the part that each belongs to, and the number of parts.

    Groups by hash of `together` have parts of their own; a group has as many as its bytes ask for.
    """
    group = F.pmod(F.xxhash64(together), F.lit(GROUPS)) if together else F.lit(0).cast("long")
    rows = docs.select(F.col(key), F.col(text).alias("text"), group.alias("group"))
    size = {r.group: r.n or 0 for r in rows.groupBy("group").agg(F.sum(F.octet_length("text")).alias("n")).collect()}  # at most GROUPS
    most = min(PART_BYTES, max(1 << 20, sum(size.values()) // LEAST_PARTS))
    first, n, own = {}, 0, {}
    for g in sorted(size):
        first[g], own[g] = n, max(1, -(-size[g] // most))
        n += own[g]
    told = lambda d: F.create_map(*[F.lit(x).cast("long") for kv in d.items() for x in kv])[F.col("group")]
    if n > 1:
        rows = rows.withColumn("part", told(first) + F.pmod(F.xxhash64(F.lit("part"), key), told(own)))
    else:
        rows = rows.withColumn("part", F.lit(0).cast("long"))
    return rows.select(key, "text", "part"), max(n, 1)


def packed(docs: DataFrame, key: str, language: str, parts: int) -> DataFrame:
    """Rows of two kinds. Documents: (part, chunk, keys, docs, tf, terms, counts), postings in order of terms, which are places in their part's list. Terms: (part, at, term, n), n the part's documents with it."""
    tokens = F.coalesce(remove_stopwords(tokenize(F.col("text")), language), F.array().cast("array<string>"))
    rows = docs.repartitionById(parts, F.col("part").cast("int")).select("part", F.col(key).alias("key"), tokens.alias("tokens"))
    kind = docs.schema[key].dataType.simpleString()
    schema = f"part long, chunk long, keys array<{kind}>, docs binary, tf binary, terms binary, counts binary, at long, term string, n long"

    def pack(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        places: dict[int, dict[str, int]] = {}
        having: dict[int, np.ndarray] = {}
        chunk = 0

        def one(part, keys, tokens):
            flat = tokens.flatten().dictionary_encode()
            own = places.setdefault(part, {})
            place = np.array([own.setdefault(t, len(own)) for t in flat.dictionary.to_pylist()], np.int64)
            size = pc.list_value_length(tokens).to_numpy(zero_copy_only=False).astype(np.int64)
            code = place[flat.indices.to_numpy(zero_copy_only=False)] if len(flat) else np.zeros(0, np.int64)
            doc = np.repeat(np.arange(len(size)), size)
            both, tf = np.unique((code << 32) | doc, return_counts=True)
            terms, counts = np.unique(both >> 32, return_counts=True)
            n = having.get(part, np.zeros(0, np.int64))
            if len(n) < len(own):
                n = np.concatenate([n, np.zeros(max(len(own), 2 * len(n)) - len(n), np.int64)])
            n[terms] += counts
            having[part] = n
            return [keys.to_pylist(), *(x.astype(np.int32).tobytes() for x in (both & 0xFFFFFFFF, tf, terms, counts))]

        names = ["part", "chunk", "keys", "docs", "tf", "terms", "counts", "at", "term", "n"]
        for batch in batches:
            keys_kind = batch.schema.field(1).type
            all_parts = batch.column(0).to_numpy()
            for part in np.unique(all_parts).tolist():
                some = batch.filter(pa.array(all_parts == part))
                upto = np.cumsum(pc.list_value_length(some.column(2)).to_numpy(zero_copy_only=False))
                first = [0, *(np.flatnonzero(np.diff(upto // CHUNK_TOKENS)) + 1).tolist(), some.num_rows]
                for x, y in zip(first, first[1:]):
                    values = [[part], [chunk], *([v] for v in one(part, some.column(1).slice(x, y - x), some.column(2).slice(x, y - x))), [None], [None], [None]]
                    kinds = [pa.int64(), pa.int64(), pa.list_(keys_kind), *[pa.binary()] * 4, pa.int64(), pa.string(), pa.int64()]
                    yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds, strict=True)], names)
                    chunk += 1
        for part, own in places.items():
            words, n = list(own), having[part]
            for a in range(0, len(words), 50_000):
                m = len(words[a : a + 50_000])
                none = [pa.nulls(m, k) for k in (pa.int64(), pa.list_(keys_kind), *[pa.binary()] * 4)]
                told = [pa.array(np.arange(a, a + m)), pa.array(words[a : a + m], pa.string()), pa.array(n[a : a + m])]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(m, part, np.int64)), *none, *told], names)

    return stored(rows.mapInArrow(pack, schema), "packed")


@dataclass
class Chunk:
    """Some documents' postings in order of terms: documents from 0, tf, the different terms and how many postings each has."""

    first: int
    size: int
    docs: np.ndarray
    tf: np.ndarray
    terms: np.ndarray
    counts: np.ndarray

    def times(self, w: np.ndarray, use: np.ndarray):
        """The weights w of the terms `use` as two functions: directions of terms (l x terms) to those of documents, and back.

        What many of the documents have is one matrix, the rest are sums direction by direction.
        """
        many = use & (self.counts >= max(2, self.size / DENSE))
        few = use & ~many
        docs, n = self.docs.astype(np.int64), int(many.sum())
        told = np.repeat(many, self.counts)
        whole = np.zeros((n, self.size))
        whole[np.repeat(np.arange(n), self.counts[many]), docs[told]] = w[told]
        told = np.repeat(few, self.counts)
        docs, w, counts = docs[told], w[told], self.counts[few]
        starts = np.cumsum(counts) - counts

        def forth(q):
            y = q(many) @ whole
            if len(docs):
                for i, own in enumerate(q(few)):
                    y[i] += np.bincount(docs, w * np.repeat(own, counts), self.size)
            return y

        def back(y):
            yield many, y @ whole.T
            if len(docs):
                yield few, np.stack([np.add.reduceat(w * row[docs], starts) for row in y])

        return forth, back


def chunks(table):
    """The packed documents in order of chunks."""
    first = 0
    for row in np.argsort(table.column("chunk").to_numpy(), kind="stable").tolist():
        size = len(table.column("keys")[row])
        yield Chunk(first, size, *(np.frombuffer(table.column(c)[row].as_py(), np.int32) for c in ("docs", "tf", "terms", "counts")))
        first += size


def product(docs: DataFrame, given: DataFrame, key: str, kind: str, once: float, l: int, m: np.ndarray | None, last: bool = False) -> DataFrame:
    """A pass over the parts, each with what it needs of the terms' and its documents' numbers: (part, at, key, term, idf, s, q0, q1 ...).

    Of each document (term null) the row of A Q, and s, the sum of the squared weights of terms that no other document has; of each
    other term its part's sum of A' A Q, or, in the last pass, of each term that only one document has (s null, idf set) its row.
    given: (part, at, term, idf, h) at first, with m None: signs from h span the directions. Then of terms that several
    documents have (part, at, term, idf, q0 ...), in the last pass of all terms, q null for the others; and of documents, as at -1, -2 ...,
    what the pass before made of them. All q are multiplied by m.
    """
    out_l = l if m is None else m.shape[1]
    schema = f"part long, at long, key {kind}, term string, idf double, s double, " + ", ".join(f"{c} double" for c in columns(out_l))

    def one(left, right):
        import pyarrow as pa

        at, idf = right.column("at").to_numpy(), right.column("idf").to_numpy()
        of_term = np.flatnonzero(at >= 0)
        total = sum(len(x) for x in left.column("keys"))
        n = 1 + max(int(at.max(initial=-1)), max((int(c.terms.max(initial=-1)) for c in chunks(left)), default=-1))
        weight = np.full(n, once)
        weight[at[of_term]] = idf[of_term]
        several = np.zeros(n, bool)
        told = of_term[(right.column("df").to_numpy()[of_term] > 1) if m is None else right.column("q0").is_valid().to_numpy()[of_term]]
        several[at[told]] = True
        t = np.flatnonzero(several)
        slot = np.full(n, -1)
        slot[t] = np.arange(len(t))
        # The numbers of terms that several documents have, then their sums in the same place; in the first pass numbers are signs, which are not held.
        q = np.zeros((out_l, len(t)))
        before = np.zeros((out_l, total))
        if m is None:
            h = np.zeros(n, np.uint64)
            h[at[of_term]] = right.column("h").to_numpy()[of_term].view(np.uint64)
            bits = np.arange(l, dtype=np.uint64)[:, None]
            numbers = lambda terms: 1.0 - 2.0 * ((h[terms] >> bits) & np.uint64(1))
        else:
            for batch in right.to_batches(max_chunksize=ROWS):
                a = batch.column("at").to_numpy()
                x = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in columns(l)])
                known, own = (a >= 0) & batch.column("q0").is_valid().to_numpy(zero_copy_only=False), a < 0
                q[:, slot[a[known]]] = m.T @ x[:, known]
                before[:, -1 - a[own]] = m.T @ x[:, own]
            numbers = lambda terms: q[:, slot[terms]]
        y, s = np.zeros((out_l, total)), np.zeros(total)
        alone = []
        weights = lambda c: (1 + np.log(c.tf)) * np.repeat(weight[c.terms], c.counts)
        for c in chunks(left):
            w, here = weights(c), slice(c.first, c.first + c.size)
            single = np.repeat(~several[c.terms], c.counts)
            s[here] = np.bincount(c.docs[single], w[single] ** 2, c.size)
            if last:
                alone.append((np.repeat(c.terms, c.counts)[single], c.docs[single] + c.first, w[single]))
            # Signs are known of all terms, later numbers only of those that several documents have.
            use = several[c.terms] if m is not None else np.ones(len(c.terms), bool)
            y[:, here] = c.times(w, use)[0](lambda some, c=c: numbers(c.terms[some]))
            if m is not None:
                y[:, here] += s[here] * before[:, here]
        if not last:
            q[:] = 0
            for c in chunks(left):
                for some, sums in c.times(weights(c), several[c.terms])[1](y[:, c.first : c.first + c.size]):
                    q[:, slot[c.terms[some]]] += sums
        part = left.column("part")[0].as_py() if left.num_rows else 0
        keys = pa.concat_arrays(_in_order(left)) if left.num_rows else pa.nulls(0, left.schema.field("keys").type.value_type)
        place = np.full(n, -1)
        place[at[of_term]] = of_term
        names = ["part", "at", "key", "term", "idf", "s", *columns(out_l)]
        kinds = [pa.int64(), pa.int64(), keys.type, pa.string(), pa.float64(), pa.float64(), *[pa.float64()] * out_l]
        made = []

        def tell(size, *values):
            arrays = [pa.nulls(size, k) if v is None else pa.array(v, k) for v, k in zip(values, kinds, strict=True)]
            made.append(pa.RecordBatch.from_arrays(arrays, names))

        for a in range(0, total, ROWS):
            k = min(ROWS, total - a)
            tell(k, np.full(k, part), np.arange(a, a + k), keys.slice(a, k), None, None, s[a : a + k], *y[:, a : a + k])
        if last:
            t, d, w = (np.concatenate(x) for x in zip(*alone, strict=True)) if alone else (np.zeros(0, int),) * 3
        for a in range(0, len(t), ROWS):
            some = t[a : a + ROWS]
            k = len(some)
            term = right.column("term").take(pa.array(place[some])).combine_chunks().cast(pa.string())
            of = w[a : a + ROWS] * before[:, d[a : a + ROWS]] if last else q[:, a : a + ROWS]
            tell(k, np.full(k, -1), np.full(k, -1), None, term, weight[some] if last else None, None, *of)
        return pa.Table.from_batches(made, pa.schema(list(zip(names, kinds, strict=True))))

    left = docs.groupBy("part")
    return left.cogroup(given.groupBy("part")).applyInArrow(one, schema)


def _in_order(table) -> list:
    """The lists of keys of packed documents, in order of chunks."""
    order = np.argsort(table.column("chunk").to_numpy(), kind="stable").tolist()
    return [table.column("keys")[i].values for i in order]


@dataclass
class Encoder:
    """The singular values; term vectors (term, idf, q0 ...) and the documents' own vectors (key, q0 ...) as tables, made when first asked for."""

    key: str
    language: str
    values: np.ndarray
    make: Callable[[], tuple[DataFrame, DataFrame]] = field(repr=False)

    @cached_property
    def _made(self) -> tuple[DataFrame, DataFrame]:
        return self.make()

    @property
    def terms(self) -> DataFrame:
        return self._made[0]

    @property
    def docs(self) -> DataFrame:
        return self._made[1]

    def encode(self, texts: DataFrame, key: str, text: str) -> DataFrame:
        """(id, x): texts along the singular directions, of length 1, or zeros where no term is known."""
        tf = terms(texts, key, text, self.language).join(self.terms, "term")
        weighted = tf.withColumn("w", (1 + F.log("tf")) * F.col("idf"))
        l = len(self.values)
        found = weighted.groupBy(key).agg(F.count("*").alias("_n"), *[F.sum(F.col("w") * F.col(c)).alias(c) for c in columns(l)])
        return unit(texts.select(key).distinct().join(found, key, "left"), key, l)

    def encoded(self) -> DataFrame:
        """(id, x) of the documents that it was fitted on."""
        return unit(self.docs, self.key, len(self.values))


def unit(rows: DataFrame, key: str, l: int) -> DataFrame:
    values = [F.coalesce(c, F.lit(0.0)) for c in columns(l)]
    length = F.sqrt(sum((v * v for v in values), F.lit(0.0)))
    whole = F.array(*[F.coalesce(F.try_divide(v, length), F.lit(0.0)) for v in values]) if l else F.array().cast("array<double>")
    return rows.select(F.col(key).alias("id"), whole.alias("x"))


def fit(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    size: int = 32,
    extra: int = 16,
    power: int = 2,
    language: str = "fr",
    together: str | None = None,
) -> Encoder:
    """The `size` largest singular directions; `extra` more are followed on the way, at most 64 in all.

    Documents alike in the column `together`, such as their language, share parts, which then share fewer terms; results are the same without.
    """
    l = min(64, size + extra)
    kind = docs.schema[key].dataType.simpleString()
    docs = docs.where(F.col(key).isNotNull())
    rows, n = docs.agg(F.count("*"), F.count_distinct(key)).first()
    if rows != n:  # rows of one key are one document; tokens do not reach over a line's end
        docs, together = docs.groupBy(key).agg(F.array_join(F.collect_list(text), "\n").alias(text)), None
    dealt, parts = parts_of(docs, key, text, together)
    pack = packed(dealt, key, language, parts)
    own = pack.where("keys is not null").select("part", "chunk", "keys", "docs", "tf", "terms", "counts")
    listed = pack.where("keys is null").select("part", "at", "term", "n")
    weight = lambda df: 1 + F.log((1 + F.lit(n)) / (1 + F.col(df)))
    idf = listed.groupBy("term").agg(F.sum("n").alias("df"))
    places = stored(listed.drop("n").join(idf.select("term", "df", weight("df").alias("idf")), "term"), "places")
    several = places.where("df > 1").select("part", "at", "term", "idf")
    once = 1 + np.log((1 + n) / 2)

    def summed(found: DataFrame, l: int, what: str) -> DataFrame:
        """Terms' sums over the parts; documents as they are."""
        sums = [F.sum(c).alias(c) for c in columns(l)]
        return stored(found.groupBy("part", "at", "term").agg(F.max("s").alias("s"), *sums), what)

    def given(made: DataFrame, l: int, where: DataFrame, how: str = "inner") -> DataFrame:
        """What the next pass needs: numbers of each part's terms and documents."""
        numbers = made.where("term is not null").select("term", *columns(l))
        of_docs = made.where("term is null").select("part", (-1 - F.col("at")).alias("at"), F.lit(None).cast("string").alias("term"), F.lit(None).cast("double").alias("idf"), *columns(l))
        return where.select("part", "at", "term", "idf").join(numbers, "term", how).select("part", "at", "term", "idf", *columns(l)).unionByName(of_docs)

    signs = places.withColumn("h", F.xxhash64(F.lit("directions"), "term"))
    made = summed(product(own, signs, key, kind, once, l, None), l, "sums")
    m = whitened(gram(made.where("term is null"), l))
    for _ in range(power):
        if not m.shape[1]:
            break
        made, l = summed(product(own, given(made, l, several), key, kind, once, l, m), m.shape[1], "sums"), m.shape[1]
        m = whitened(gram(made.where("term is null"), l))
    if not m.shape[1]:
        empty = lambda: (places.select("term", "idf").distinct(), docs.select(key))
        return Encoder(key, language, np.zeros(0), empty)
    # Rows of A' U: of terms that several documents have from the sums, the others' squares from the documents that have them.
    alone = made.where("term is null").select(*[(F.sqrt("s") * F.col(c)).alias(c) for c in columns(l)])
    g = m.T @ (gram(made.where("term is not null"), l) + gram(alone, l)) @ m
    value, vector = np.linalg.eigh(g)
    use = np.argsort(-value)[:size]
    use = use[value[use] > max(value.max(initial=0) * 1e-10, 1e-300)]
    sigma, along = np.sqrt(value[use]), m @ (vector[:, use] / np.sqrt(value[use]))

    def vectors() -> tuple[DataFrame, DataFrame]:
        k = len(sigma)
        last = stored(product(own, given(made, l, places, "left"), key, kind, once, l, along, last=True), "vectors")
        turned = [sum((F.col(f"q{i}") * float(along[i, j]) for i in range(l)), F.lit(0.0)).alias(f"q{j}") for j in range(k)]
        shared = made.where("term is not null").select("term", *turned)
        shared = shared.join(several.select("term", "idf").distinct(), "term").select("term", "idf", *columns(k))
        lone = last.where("term is not null").select("term", "idf", *columns(k))
        return stored(shared.unionByName(lone), "directions"), last.where("term is null").select(F.col("key").alias(key), *columns(k))

    return Encoder(key, language, sigma, vectors)
