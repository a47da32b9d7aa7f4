"""Queries of what is learned from the tables themselves: a tagger, a dictionary, an encoder."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from trilune.functions.text import STOPWORDS, tokenize
from trilune.operators import align as A
from trilune.operators import dictionary as D
from trilune.operators import encoder as N
from trilune.operators import graph_encoder as E
from trilune.operators import graph_network as W
from trilune.operators import lemmas as M
from trilune.operators import retrieval as R
from trilune.operators import tagger as G
from trilune.operators import translation as T
from trilune.plans.lexicon import SQL as LEX
from trilune.plans.lexicon import graph
from trilune.plans.retrieval import _bm25, index, items
from trilune.plans.text import ENTITY_PATTERNS
from trilune.sources.tables import stored, table

CATALOGUE = [(kind, pattern) for kind, pattern, _ in ENTITY_PATTERNS]


def texts(spark, d):
    """Documents, and pages under ids below 0."""
    pages = table(spark, d, "pages").select((-F.col("page_id") - 1).alias("doc_id"), F.col("html").alias("text"), F.lit("en").alias("lang"))
    return table(spark, d, "documents").select("doc_id", "text", "lang").unionByName(pages)


def held_out(key="doc_id"):
    return F.crc32(F.col(key).cast("string").cast("binary")) % 4 == 1


def tagger(spark, d):
    """Learned from three quarters of the texts."""
    return G.train(texts(spark, d).where(~held_out()), CATALOGUE)


def tagged_entities(spark, d):
    """What the tagger finds in every text."""
    return G.tagged(texts(spark, d), tagger(spark, d)).select("doc_id", "type", "name", F.col("start").cast("long").alias("start"))


def extracted_entities(spark, d):
    """Entities by the catalogue and by the tagger together, once per name, type and language."""
    x = texts(spark, d)
    one = lambda kind: lambda m: F.struct(F.lit(kind).alias("type"), F.trim(m).alias("name"))
    hits = F.flatten(F.array(*[F.transform(F.regexp_extract_all("text", F.lit(p), F.lit(0)), one(k)) for k, p in CATALOGUE]))
    rules = x.select(F.col("doc_id").alias("doc"), F.col("lang").alias("language"), F.inline(hits))
    found = G.tagged(x.select(F.struct("doc_id", "lang").alias("at"), "text"), tagger(spark, d), "at")
    found = found.select(F.col("at.doc_id").alias("doc"), F.col("at.lang").alias("language"), "type", "name")
    return G.extracted(rules, found, STOPWORDS).select("language", "type", "name", "confidence", "doc")


def lexical_pairs(spark, d, source="en", target="fr"):
    """(name, target): what the graph's translations say."""
    e, r = graph(spark, d)
    end = lambda c, lang: e.where(F.col("language") == lang).select(F.col("id").alias(c), F.col("name").alias(f"{c}_name"))
    both = r.where("rel = 'translatedAs'").join(end("src", source), "src").join(end("dst", target), "dst")
    return both.select(F.col("src_name").alias("name"), F.col("dst_name").alias("target"))


def translated_queries(spark, d):
    return D.translated(items(spark, d), "query_id", "query_text", lexical_pairs(spark, d))


def translated_search(spark, d):
    """BM25 with translated queries."""
    q = stored(translated_queries(spark, d), "translated")
    return index(spark, d).search(q.withColumnRenamed("translated", "query_text")).select("query_id", "rank", "doc_id", "score")


def kg_text_mentions(spark, d):
    """Names of a text's own language that it holds anywhere, inside words too."""
    e, _ = graph(spark, d)
    names = e.select(F.lower("name").alias("found"), "id", "language")
    docs = table(spark, d, "documents").select("doc_id", "text", "lang")
    out = None
    for language in [r.language for r in names.select("language").distinct().orderBy("language").collect()]:  # the graph has four
        own = names.where(F.col("language") == language)
        found = D.mentions(docs.where(F.col("lang") == language), "text", own, "found", whole=False, keep=["doc_id"], once=True)
        held = found.join(own, "found").select("doc_id", "id")
        out = held if out is None else out.unionByName(held)
    if out is None:
        return docs.join(names, F.col("lang") == F.col("language")).select("doc_id", "id")
    return out.distinct()


def encoder(spark, d):
    return N.fit(table(spark, d, "documents"), size=32, together="lang")


def encoded_topk(spark, d):
    """The nearest documents of each item, both as vectors that the corpus itself teaches."""
    e = encoder(spark, d)
    q = stored(e.encode(items(spark, d), "query_id", "query_text"), "asked")
    return R.dense_search(q, e.encoded(), 10).select("query_id", "rank", "doc_id", "score")


def encoder_values(spark, d):
    """The singular values, the largest first."""
    values = [(i + 1, float(v)) for i, v in enumerate(encoder(spark, d).values)]
    return spark.createDataFrame(values, "rank int, value double").select("rank", F.round("value", 4).alias("value"))


def word_vectors(e):
    """Words' ranks as digits, English ones and others in places of their own: what is alike must be learned."""
    shift = F.when(F.col("language") == "en", 0).otherwise(8)
    digit = F.col("r") % 8 + shift
    high = F.floor(F.col("r") / 8) % 8 + shift
    return e.select("id", F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: F.when(digit == i, 1.0).when(high == i, 0.5).otherwise(0.0)).alias("x"))


def word_seeds(r, learned):
    """Half of the translations are learned from, the other half are kept for the test."""
    half = F.crc32(F.col("src").cast("binary")) % 2 == 0
    return r.where("rel = 'translatedAs'").where(half if learned else ~half).select(F.col("src").alias("e1"), F.col("dst").alias("e2"))


def trained_words(spark, d):
    e, r = graph(spark, d)
    x, edges = stored(word_vectors(e), "words"), r.where("rel <> 'translatedAs'")
    net = W.fit(x, edges, word_seeds(r, True))
    return e, r, x, edges, net


def align_gcn_trained(spark, d):
    """French partners of English words by a graph convolution that was trained on half of the translations."""
    e, _, x, edges, net = trained_words(spark, d)
    z = stored(W.encoded(x, edges, net), "encoded")
    side = lambda lang: z.join(e.where(F.col("language") == lang).select("id"), "id", "left_semi")
    return E.predicted(side("en"), side("fr"), 3, 0.0).select("e1", "e2", F.round("confidence", 4).alias("confidence"))


def corpus_words(spark, d):
    """Tokens of four letters and more by language."""
    t = table(spark, d, "documents").select(F.col("lang").alias("language"), F.explode(tokenize(F.col("text"))).alias("word"))
    return t.where(F.length("word") >= 4).groupBy("language", "word").agg(F.count("*").alias("n"))


def lemma_rules(spark, d):
    return M.rules(corpus_words(spark, d))


def lemma_freq(spark, d):
    w = stored(corpus_words(spark, d), "words")
    return M.lemmas(w, M.rules(w)).groupBy("language", "lemma").agg(F.sum("n").alias("n"), F.count("*").alias("forms"))


def align_mtranse(spark, d):
    """French partners of English words: embeddings of each language's graph, brought together by a linear map over half of the translations."""
    e, r = graph(spark, d)
    within = r.where("rel <> 'translatedAs'").join(e.select(F.col("id").alias("src"), "language"), "src").where("language in ('en', 'fr')")
    vectors, _ = T.embedded(within.select("language", F.col("src").alias("h"), F.col("rel").alias("r"), F.col("dst").alias("t")), "language")
    vectors = stored(vectors.withColumnRenamed("name", "id"), "embedded")
    side = lambda lang, i, x: vectors.where(F.col("language") == lang).select(F.col("id").alias(i), F.col("x").alias(x))
    seeds = word_seeds(r, True).join(side("en", "e1", "x"), "e1").join(side("fr", "e2", "y"), "e2")
    mapped = W.product(side("en", "id", "x"), A.linear_map(seeds.select("x", "y")), False)
    return E.predicted(stored(mapped, "mapped"), stored(W.product(side("fr", "id", "x"), np.eye(16), False), "unit"), 10, 0.0).select("e1", "e2", F.round("confidence", 4).alias("confidence"))


QUERIES = {
    f.__name__: f
    for f in (lemma_rules, lemma_freq, align_mtranse, tagged_entities, extracted_entities, translated_queries, translated_search, kg_text_mentions, encoded_topk, encoder_values, align_gcn_trained)
}

_TR = r"""tr AS (SELECT a.name, min(b.name) AS target FROM rel JOIN ent a ON rel.src = a.id JOIN ent b ON rel.dst = b.id
  WHERE rel.rel = 'translatedAs' AND a.language = 'en' AND b.language = 'fr' GROUP BY a.name
), pc AS (SELECT query_id, unnest(p) AS piece, unnest(range(len(p))) AS i
  FROM (SELECT item_id AS query_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+|[^\p{L}\p{N}_]+') AS p FROM benchmark)
), tq AS (SELECT query_id, string_agg(coalesce(target, piece), '' ORDER BY i) AS translated, count(target)::BIGINT AS n_translated
  FROM pc LEFT JOIN tr ON tr.name = pc.piece GROUP BY query_id)"""

_LEMMA = r"""WITH tk AS (SELECT lang AS language, unnest(regexp_extract_all(lower(trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g'))), '[\p{L}\p{N}_]+')) AS word FROM documents
), w AS (SELECT language, word, count(*) AS n FROM tk WHERE length(word) >= 4 GROUP BY ALL
), ct AS (SELECT language, word, left(word, length(word) - k) AS stem, right(word, k) AS ending FROM (SELECT *, unnest(range(4)) AS k FROM w) WHERE length(word) >= 3 + k
), ce AS (SELECT language, ending FROM (SELECT language, ending, row_number() OVER (PARTITION BY language ORDER BY count(*) DESC, encode(ending)) AS place FROM ct GROUP BY language, ending) WHERE place <= 30
), ks AS (SELECT ct.language, stem, ct.ending FROM ct JOIN ce ON ct.language IS NOT DISTINCT FROM ce.language AND ct.ending = ce.ending
), pc AS (SELECT a.language, a.ending, b.ending AS into_, count(*) AS support FROM ks a JOIN ks b ON a.language IS NOT DISTINCT FROM b.language AND a.stem = b.stem AND length(b.ending) < length(a.ending) GROUP BY ALL
), ru AS (SELECT language, ending, into_ AS "into", support FROM (SELECT *, row_number() OVER (PARTITION BY language, ending ORDER BY support DESC, encode(into_)) AS place FROM pc WHERE support >= 5) WHERE place = 1
), tr0 AS (SELECT ct.language, word, length(ct.ending) AS size, stem || "into" AS lemma FROM ct JOIN ru ON ct.language IS NOT DISTINCT FROM ru.language AND ct.ending = ru.ending
), lm AS (SELECT t.language, t.word, max_by(t.lemma, t.size) AS lemma FROM tr0 t JOIN w ON t.language IS NOT DISTINCT FROM w.language AND t.lemma = w.word GROUP BY ALL)"""

SQL = {
    "lemma_rules": f'{_LEMMA} SELECT language, ending, "into", support FROM ru',
    "lemma_freq": f"{_LEMMA} SELECT w.language, coalesce(lm.lemma, w.word) AS lemma, sum(w.n)::BIGINT AS n, count(*) AS forms FROM w LEFT JOIN lm ON w.language IS NOT DISTINCT FROM lm.language AND w.word = lm.word GROUP BY ALL",
    "translated_queries": f"{LEX}, {_TR} SELECT query_id, translated, n_translated FROM tq",
    "translated_search": f"{LEX}, {_TR}, {_bm25(10).replace('SELECT item_id AS query_id', 'SELECT query_id').replace('FROM benchmark', 'FROM (SELECT query_id, translated AS text FROM tq)')} SELECT query_id, rank, doc_id, score FROM bm",
    "kg_text_mentions": f"{LEX} SELECT DISTINCT doc_id, ent.id FROM documents JOIN ent ON lang = ent.language AND contains(lower(text), ent.name)",
}
