"""Ranked retrieval: Okapi BM25, exact inner products, graph evidence, and their fusion. Every step is keyed by query_id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trilune.functions.statistics import min_max
from trilune.functions.text import remove_stopwords, tokenize
from trilune.sources.tables import stored


def terms(df: DataFrame, key: str, text: str, language: str = "fr") -> DataFrame:
    """(key, term, tf): tokens without the language's stop words."""
    tokens = remove_stopwords(tokenize(F.col(text)), language)
    return df.select(key, F.explode(tokens).alias("term")).groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"))


class Bm25Index:
    """Postings (doc_id, term, tf), document lengths and term weights, as tables."""

    def __init__(
        self,
        docs: DataFrame,
        key: str = "doc_id",
        text: str = "text",
        language: str = "fr",
        k1: float = 1.5,
        b: float = 0.75,
        idf: str = "okapi",
    ):
        self.key, self.language, self.k1, self.b = key, language, k1, b
        self.postings = stored(terms(docs, key, text, language), "postings")
        lengths = self.postings.groupBy(key).agg(F.sum("tf").alias("dl"))
        self.lengths = stored(docs.select(key).join(lengths, key, "left").fillna(0, ["dl"]), "lengths")
        self.n, self.avgdl = self.lengths.agg(F.count(F.lit(1)), F.coalesce(F.avg("dl"), F.lit(0.0))).first()
        df = self.postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
        rest = F.lit(self.n) - F.col("df") + 0.5
        if idf == "lucene":
            self.weights = stored(df.withColumn("idf", F.log(1 + rest / (F.col("df") + 0.5))), "weights")
        else:  # weights below 0 become a quarter of the mean weight of all terms
            raw = stored(df.withColumn("idf", F.log(rest) - F.log(F.col("df") + 0.5)), "weights")
            floor = 0.25 * (raw.agg(F.avg("idf")).first()[0] or 0.0)
            self.weights = raw.withColumn("idf", F.when(F.col("idf") < 0, floor).otherwise(F.col("idf")))

    def scores(self, queries: DataFrame, query: str = "query_id", text: str = "query_text") -> DataFrame:
        """(query_id, doc_id, score) of all documents that share a term; a query's repeated terms count repeatedly.

        Postings of asked terms are dealt by document, once; all that a document gets of a query is then added up where it is, and
        no pairs of a query and a document are exchanged. Asked terms are stored, so that a table of few is sent to all tasks.
        """
        q = terms(queries, query, text, self.language).withColumnRenamed("tf", "qtf").join(self.weights, "term")
        q = stored(q.select(query, "term", "qtf", "idf"), "asked")
        dealt = self.postings.join(q.select("term").distinct(), "term", "left_semi").repartition(self.key)
        hits = dealt.join(self.lengths.hint("shuffle_hash"), self.key).join(q, "term")
        tf = F.col("tf") * (self.k1 + 1) / (F.col("tf") + self.k1 * (1 - self.b + self.b * F.col("dl") / self.avgdl))
        return hits.groupBy(query, self.key).agg(F.round(F.sum(F.col("qtf") * F.col("idf") * tf), 6).alias("score"))

    def search(
        self,
        queries: DataFrame,
        top_k: int = 10,
        query: str = "query_id",
        text: str = "query_text",
    ) -> DataFrame:
        """The best per query; ties to the larger document id; scores of 0 and less left out."""
        return top(self.scores(queries, query, text), top_k, query, F.desc(self.key)).where("score > 0")

    def save(self, path: str) -> None:
        """Postings in order of terms, weights, lengths and settings under a folder."""
        (
            self.postings.repartitionByRange("term")
            .sortWithinPartitions("term").write
            .mode("overwrite")
            .parquet(f"{path}/postings")
        )
        self.weights.write.mode("overwrite").parquet(f"{path}/weights")
        self.lengths.write.mode("overwrite").parquet(f"{path}/lengths")
        kept = [(self.key, self.language, float(self.k1), float(self.b), int(self.n), float(self.avgdl))]
        spark = self.postings.sparkSession
        (
            spark.createDataFrame(kept, "key string, language string, k1 double, b double, n long, avgdl double").write
            .mode("overwrite")
            .parquet(f"{path}/settings")
        )

    @classmethod
    def load(cls, spark, path: str) -> Bm25Index:
        """A saved index; a query then reads the terms that it asks for."""
        out = cls.__new__(cls)
        out.key, out.language, out.k1, out.b, out.n, out.avgdl = spark.read.parquet(f"{path}/settings").first()
        out.postings, out.weights, out.lengths = (
            spark.read.parquet(f"{path}/{t}")
            for t in ("postings", "weights", "lengths")
        )
        return out

    def statistics(self) -> DataFrame:
        terms_ = self.weights.agg(F.count(F.lit(1)).alias("vocabulary"))
        return self.lengths.agg(F.count(F.lit(1)).alias("documents"), F.avg("dl").alias("avgdl"), F.sum("dl").alias("tokens")).join(
            F.broadcast(terms_),
        )


def corpus_statistics(docs: DataFrame, key: str = "doc_id", text: str = "text", language: str = "fr") -> DataFrame:
    """What an index's statistics() tell, without the index: distinct terms are all that is exchanged.

    As there, documents of one key each have the tokens of all of them, those without a key have none, but count.
    """
    tokens = remove_stopwords(tokenize(F.col(text)), language)
    rows, keys = docs.agg(F.count(F.lit(1)), F.count_distinct(key)).first()
    used = docs.select(F.explode(tokens).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    out = used.agg(F.count(F.lit(1)).alias("vocabulary"), F.coalesce(F.sum("n"), F.lit(0)).alias("tokens"))
    if rows != keys:
        own = docs.where(F.col(key).isNotNull()).groupBy(key).agg((F.count(F.lit(1)) * F.sum(F.size(tokens))).alias("n"))
        out = out.drop("tokens").join(F.broadcast(own.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("tokens"))))
    documents = F.lit(rows).cast("long")
    some = F.when(documents > 0, F.col("tokens"))
    return out.select(documents.alias("documents"), F.try_divide(some.cast("double"), documents).alias("avgdl"), some.alias("tokens"), "vocabulary")


def top(scored: DataFrame, k: int, query: str, tie: Column) -> DataFrame:
    """Adds rank, from 1; Spark drops what cannot be among the first k before it shuffles."""
    rank = F.row_number().over(Window.partitionBy(query).orderBy(F.desc("score"), tie))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k)


def inner(a: Column, b: Column) -> Column:
    """Inner product in double precision."""
    return F.aggregate(
        F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y),
        F.lit(0.0),
        lambda s,
        x: s + x,
    )


def blocks_of(queries: DataFrame, block: int):
    """(ids, matrix) of the queries (id, x), block by block."""
    import numpy as np

    held: list = []
    first = True
    for row in queries.select("id", F.col("x").cast("array<double>")).toLocalIterator():
        held.append(row)
        if len(held) == block:
            yield [r[0] for r in held], np.array([r[1] for r in held], float)
            held, first = [], False
    if held or first:
        yield [r[0] for r in held], np.array([r[1] for r in held], float)


def block_search(queries: DataFrame, items: DataFrame, schema: str, best, block: int = 20_000) -> DataFrame:
    """Rows of best(ids, matrix, batches) over each part of the items (id, x), for block after block of the queries (id, x).

    What a block finds is written before the next one is sent, and its copies are removed from driver and executors; the
    driver holds two blocks at most. One block only is sent once and needs no table.
    """
    plain = items.select("id", F.col("x").cast("array<double>"))
    context = queries.sparkSession.sparkContext

    def run(sent):
        return plain.mapInArrow(lambda batches: best(*sent.value, batches), schema)

    parts = blocks_of(queries, block)
    now, following = next(parts), next(parts, None)
    if following is None:
        return run(context.broadcast(now))
    out = None
    while now is not None:
        sent = context.broadcast(now)
        found = stored(run(sent), "found")
        sent.destroy()
        out = found if out is None else out.unionByName(found)
        now, following = following, next(parts, None)
    return out


def kept_best(ids, scores, own_ids, own, k: int):
    """Each row's k best of two sets of (score, id), -inf for none: largest first, ties to the smaller id. ids, scores: rows x kept; own_ids: new ones, own: rows x new."""
    import numpy as np

    both = np.concatenate([scores, own], axis=1)
    names = np.concatenate([ids, np.broadcast_to(own_ids, own.shape)], axis=1)
    n = min(k, both.shape[1])
    least = np.partition(both, both.shape[1] - n, axis=1)[:, both.shape[1] - n]
    out_ids, out = np.empty((len(both), n), names.dtype), np.full((len(both), n), -np.inf)
    for i, row in enumerate(both):
        c = np.flatnonzero((row >= least[i]) & (row > -np.inf))
        c = c[np.lexsort((names[i, c], -row[c]))][:n]
        out_ids[i, : len(c)], out[i, : len(c)] = names[i, c], row[c]
    return out_ids, out


def dense_search(queries: DataFrame, items: DataFrame, top_k: int, block: int = 20_000) -> DataFrame:
    """(query_id, doc_id, score, rank) by inner product; both sides have id and x.

    The stated queries go to every part of the items in blocks, so that what is sent is
    bounded; each task keeps its best, and only these are shuffled.
    """
    import numpy as np

    asked, kind = (d.schema["id"].dataType.simpleString() for d in (queries, items))

    def best(ids, q, batches):
        import pyarrow as pa

        held: list = []
        for batch in batches:
            if not batch.num_rows or not len(ids):
                continue
            x = np.asarray(batch.column(1).flatten(), float).reshape(len(batch), -1)
            own = batch.column(0).to_numpy(zero_copy_only=False)
            if not held:
                held = [(np.empty((len(q[a : a + 512]), 0), own.dtype), np.empty((len(q[a : a + 512]), 0))) for a in range(0, len(ids), 512)]
            held = [
                kept_best(*held[i], own, np.round(q[a : a + 512] @ x.T, 6), top_k)
                for i, a in enumerate(range(0, len(ids), 512))
            ]
        for i, (names, scores) in enumerate(held):
            rows, cols = np.nonzero(scores > -np.inf)
            yield pa.RecordBatch.from_arrays(
                [pa.array([ids[512 * i + r] for r in rows]), pa.array(names[rows, cols]), pa.array(scores[rows, cols])],
                names=["query_id", "doc_id", "score"],
            )

    out = block_search(queries, items, f"query_id {asked}, doc_id {kind}, score double", best, block)
    return top(out, top_k, "query_id", F.col("doc_id"))


class IvfIndex:
    """Vectors in the cells of a k-means; a query looks into as many of the nearest cells as reach the wanted recall.

    There is a cell for every `per_cell` rows. How many cells are probed is measured: some sampled vectors ask for their exact
    nearest ones among the sample, and enough cells are searched to hold `recall` of these.
    """

    def __init__(self, items: DataFrame, per_cell: int = 400, recall: float = 0.95, near: int = 20, seed: int = 7, sample: int = 20_000):
        import numpy as np
        from pyspark.ml.clustering import KMeans
        from pyspark.ml.functions import array_to_vector

        n = items.count()
        vectors = items.withColumn("features", array_to_vector(F.col("x").cast("array<double>")))
        share = min(1.0, sample / max(1, n))  # `sample` bounds what is fitted on; all rows get a cell
        some = vectors if share == 1 else vectors.where(F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(1 << 30)) < int(share * (1 << 30)))
        cells = max(1, min(max(8, n // per_cell), int(n * share) // 20))
        self.model = KMeans(k=cells, seed=seed, maxIter=10, predictionCol="cell").fit(some)
        self.centers = np.array(self.model.clusterCenters())
        x = np.array([r[0] for r in some.select(F.col("x").cast("array<double>")).toLocalIterator()])
        self.probes = self._probes(x, recall, near)
        self.rows = stored(self.model.transform(vectors).select("id", "x", "cell"), "cells")

    def _probes(self, x, recall: float, near: int) -> int:
        """Cells to search, from what every twentieth sampled vector would need."""
        import numpy as np

        squares = (self.centers**2).sum(axis=1)
        home = np.concatenate([(squares - 2 * part @ self.centers.T).argmin(axis=1) for part in np.array_split(x, 1 + len(x) // 1000)])
        asks = np.arange(0, len(x), 20)
        place = np.argsort(np.argsort(-(x[asks] @ self.centers.T), axis=1, kind="stable"), axis=1)
        s = x[asks] @ x.T
        s[np.arange(len(asks)), asks] = -np.inf
        k = min(near, len(x) - 1)
        if k < 1:
            return len(self.centers)
        found = np.argpartition(-s, k - 1, axis=1)[:, :k]
        need = place[np.arange(len(asks))[:, None], home[found]]
        return 1 + int(np.sort(need.ravel())[min(need.size - 1, int(np.ceil(recall * need.size)) - 1)])

    def search(self, queries: DataFrame, top_k: int, nprobe: int | None = None, salts: int = 8) -> DataFrame:
        """A cell's rows are spread over `salts` tasks, to which its queries are copied."""
        import numpy as np

        sent = queries.sparkSession.sparkContext.broadcast((self.centers, nprobe or self.probes))  # of the sample's size
        kind = queries.schema["id"].dataType.simpleString()

        def probe(batches):
            import pyarrow as pa

            centers, n = sent.value
            for batch in batches:
                if batch.num_rows:
                    x = np.asarray(batch.column(1).flatten(), float).reshape(len(batch), -1)
                    near = np.argsort(-(x @ centers.T), axis=1, kind="stable")[:, :n].astype(np.int32)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0), batch.column(1), pa.array(near.tolist(), pa.list_(pa.int32()))],
                        ["query_id", "q", "cells"],
                    )

        asked = queries.select("id", F.col("x").cast("array<double>")).mapInArrow(probe, f"query_id {kind}, q array<double>, cells array<int>")
        probes = asked.select("query_id", "q", F.explode("cells").alias("cell"))
        probes = probes.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        rows = self.rows.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(salts)).cast("int"))
        found = rows.join(probes, ["cell", "salt"]).select(
            "query_id",
            F.col("id").alias("doc_id"),
            F.round(inner(F.col("q"), F.col("x")), 6).alias("score"),
        )
        return top(found, top_k, "query_id", F.col("doc_id"))


def save_vectors(items: DataFrame, path: str, settings: dict[str, str] | None = None) -> None:
    """Vectors (id, x) and what is to be known of them under a folder."""
    items.select("id", "x").write.mode("overwrite").parquet(f"{path}/vectors")
    rows = list((settings or {}).items())
    (
        items.sparkSession.createDataFrame(rows, "name string, value string").write
        .mode("overwrite")
        .parquet(f"{path}/settings")
    )


def load_vectors(spark, path: str) -> tuple[DataFrame, dict[str, str]]:
    return spark.read.parquet(f"{path}/vectors"), {r.name: r.value for r in spark.read.parquet(f"{path}/settings").collect()}


def fuse(parts: dict[str, DataFrame], weights: dict[str, float], normalize: bool = True) -> DataFrame:
    """(query_id, doc_id, parts..., final): full outer join of score lists, missing 0, each scaled to 0..1 per query, weighted sum.

    Weights whose sum is further from 1 than 0.01 are divided by it.
    """
    total = sum(weights.values())
    if abs(total - 1) > 0.01:
        weights = {k: w / total for k, w in weights.items()}
    out = None
    for name, df in parts.items():
        x = df.select("query_id", "doc_id", F.col("score").alias(name))
        out = x if out is None else out.join(x, ["query_id", "doc_id"], "full")
    out = out.fillna(0.0, list(parts))
    if normalize:
        out = out.withColumns({n: min_max(F.col(n), Window.partitionBy("query_id")) for n in parts})
    return out.withColumn("final", sum((F.col(n) * F.lit(float(w)) for n, w in weights.items()), F.lit(0.0)))


def mentions(texts: DataFrame, key: str, text: str, entities: DataFrame, language: str | None = None) -> DataFrame:
    """(key, id): entities whose lower-cased name the lower-cased text contains as whole tokens; by an equi-join on token n-grams as long as the longest name.

    language: a column of texts that must equal the entity's language.
    """
    tokens = tokenize(F.col(text))
    longest = entities.agg(F.max(F.size(F.split("name", " ")))).first()[0] or 1
    starts = lambda n: F.sequence(F.lit(1), F.size(tokens) - n + 1)
    grams = lambda n: F.when(F.size(tokens) >= n, F.transform(starts(n), lambda i: F.array_join(F.slice(tokens, i, n), " "))).otherwise(
        F.array().cast("array<string>"),
    )
    spans = F.flatten(F.array(tokens, *[grams(n) for n in range(2, longest + 1)]))
    rows = texts.select(key, *([language] if language else []), F.explode(F.array_distinct(spans)).alias("_span"))
    names = entities.select("id", F.lower("name").alias("_span"), F.col("language").alias("_l"))
    out = rows.join(names, "_span")
    if language:
        out = out.where(F.col(language) == F.col("_l"))
    return out.select(key, "id").distinct()


def graph_scores(query_entities: DataFrame, doc_entities: DataFrame, related: DataFrame, keys: DataFrame) -> DataFrame:
    """(query_id, doc_id, score) of the pairs in keys (query_id, doc_id), each once: over pairs of a query's and a document's entities, 1 for the same and the relation's weight for related ones; the mean over pairs that hit, at most 1.

    Documents' entities are first brought to the queries that the documents are candidates of: no other pairs are made.
    """
    near = query_entities.select("query_id", "id", F.lit(1.0).alias("w")).unionByName(
        (
            query_entities.withColumnRenamed("id", "source")
            .join(related, "source")
            .select("query_id", "id", F.col("weight").alias("w"))
        ),
    )
    return (
        keys.join(doc_entities, "doc_id")
        .join(near, ["query_id", "id"])
        .groupBy("query_id", "doc_id")
        .agg(F.least(F.round(F.avg("w"), 9), F.lit(1.0)).alias("score"))
    )


def expanded(
    query_entities: DataFrame,
    related: DataFrame,
    entities: DataFrame,
    top_k: int = 10,
    least: float = 0.1,
) -> DataFrame:
    """(query_id, name, weight): related entities' weights summed over a query's entities, those of at least `least`, by name, scaled by the largest."""
    w = (
        query_entities.withColumnRenamed("id", "source")
        .join(related, "source")
        .groupBy("query_id", "id")
        .agg(F.sum("weight").alias("w"))
    )
    w = (
        w.where(F.round("w", 9) >= least)
        .join(entities.select("id", "name", "ord"), "id")
        .groupBy("query_id", "name")
        .agg(F.max_by("w", "ord").alias("w"))
    )
    w = w.withColumn("score", F.round(F.col("w") / F.max("w").over(Window.partitionBy("query_id")), 6))
    return top(w, top_k, "query_id", F.col("name")).select("query_id", "name", F.col("score").alias("weight"), "rank")


def weighted_jaccard(a: DataFrame, b: DataFrame, keys: DataFrame) -> DataFrame:
    """(query_id, doc_id, score) of the pairs in keys (query_id, doc_id), each once: sum of smaller over sum of larger weights. a: query_id, name, w; b: doc_id, name, w. Pairs that share no name are left out: they score 0."""
    ta, tb = a.groupBy("query_id").agg(F.sum("w").alias("ta")), b.groupBy("doc_id").agg(F.sum("w").alias("tb"))
    both = (
        keys.join(b.withColumnRenamed("w", "wb"), "doc_id")
        .join(a.withColumnRenamed("w", "wa"), ["query_id", "name"])
        .groupBy("query_id", "doc_id")
        .agg(F.sum(F.least("wa", "wb")).alias("m"))
    )
    return (
        both.join(ta, "query_id")
        .join(tb, "doc_id")
        .select("query_id", "doc_id", F.col("m"), (F.col("ta") + F.col("tb") - F.col("m")).alias("u"))
        .select("query_id", "doc_id", F.try_divide("m", "u").alias("score"))
    )
