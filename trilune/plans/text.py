"""Queries of the text functions over documents, pages and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from trilune.functions import patterns as P
from trilune.functions import text as T
from trilune.sources.tables import stored, table


def docs(spark, d):
    return table(spark, d, "documents")


def normalize(spark, d):
    return docs(spark, d).select(
        "doc_id",
        T.normalize_text(F.col("text")).alias("normalized"),
        T.normalize_text(F.col("text"), remove_punctuation=True).alias("bare"),
    )


def clean(spark, d):
    return docs(spark, d).select("doc_id", T.clean_text(F.col("text")).alias("cleaned"))


def token_freq(spark, d):
    t = docs(spark, d).select(F.explode(T.tokenize(F.col("text"))).alias("token"))
    return t.groupBy("token").agg(F.count(F.lit(1)).alias("n"))


def stopwords(spark, d):
    k = lambda lang: F.size(T.remove_stopwords(T.tokenize(F.col("text")), lang))
    return docs(spark, d).select(
        "doc_id",
        F.size(T.tokenize(F.col("text"))).cast("long").alias("n_tokens"),
        k("en").cast("long").alias("n_en"),
        k("fr").cast("long").alias("n_fr"),
    )


def type_token_ratio(spark, d):
    t = T.tokenize(F.col("text"))
    return docs(spark, d).select(
        "doc_id",
        F.round(F.coalesce(F.try_divide(F.size(F.array_distinct(t)), F.size(t)), F.lit(0.0)), 6).alias("ttr"),
    )


def truncate(spark, d):
    c = F.col("text")
    return docs(spark, d).select("doc_id", *[T.truncate_text(c, 100, s).alias(s) for s in ("head", "tail", "middle")])


def accents(spark, d):
    return docs(spark, d).select("doc_id", T.remove_accents("text").alias("plain"))


def similarity(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_name", "p_brand", "p_type")
    return p.select(
        "p_partkey",
        F.round(T.string_similarity(F.col("p_name"), F.col("p_type")), 6).alias("name_type"),
        F.round(T.string_similarity(F.col("p_brand"), F.col("p_type")), 6).alias("brand_type"),
    )


def lang_heuristic(spark, d):
    x = docs(spark, d).select("lang", T.heuristic_language(F.col("text")).alias("guess"))
    return x.groupBy("lang", "guess").agg(
        F.count(F.lit(1)).alias("n"),
        F.first(T.language_name(F.col("guess"))).alias("name"),
    )


def filter_language(spark, d):
    return (
        docs(spark, d)
        .where(T.heuristic_language(F.col("text")) == "en")
        .select("doc_id", F.col("lang").isin("zh", "fr", "en").alias("supported"))
    )


def sentence_split(spark, d):
    s = T.sentences(F.col("text"))
    return docs(spark, d).select(
        "doc_id",
        F.size(s).cast("long").alias("n_sentences"),
        F.try_element_at(s, F.lit(1)).alias("first"),
        F.try_element_at(s, F.lit(-1)).alias("last"),
    )


def following(ids, by: str, key: str, width: int = 100_000):
    """(key, next): the next larger key of the same group; stretches of `width` keys are windows of their own, so a large group is many tasks."""
    from pyspark.sql import Window

    cut = ids.select(by, key, F.floor(F.col(key) / width).alias("_cut"))
    inside = F.lead(key).over(Window.partitionBy(by, "_cut").orderBy(key))
    first = cut.groupBy(by, "_cut").agg(F.min(key).alias("_first"))
    later = first.select(
        F.col(by).alias("_by"),
        F.col("_cut").alias("_at"),
        F.lead("_first").over(Window.partitionBy(by).orderBy("_cut")).alias("_later"),
    )
    rows = cut.withColumn("next", inside)
    ends = rows.where("next is null").join(later, F.col(by).eqNullSafe(F.col("_by")) & (F.col("_cut") == F.col("_at")))
    both = rows.where("next is not null").select(key, "next").unionByName(ends.select(key, F.col("_later").alias("next")))
    return both.where("next is not null")


def sentence_alignment(spark, d):
    """Sentences of each document against those of the next one in its source, by length ratio. Texts are split once, and exchanged once."""
    rows = docs(spark, d).select("doc_id", "source", T.sentences(F.col("text")).alias("t"))
    s = stored(rows.withColumn("n", F.size("t")), "sentences")
    after = following(s.where("doc_id is not null"), "source", "doc_id")
    pairs = after.join(s.select("doc_id", "n").where("n > 0"), "doc_id")
    x = s.select(F.col("doc_id").alias("next"), "t").where(F.size("t") > 0).join(pairs, "next")
    x = x.withColumn("r", F.size("t") / F.col("n")).select("doc_id", "t", "r", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("i"))
    lo, hi = F.floor(F.col("i") * F.col("r")).cast("int"), F.least(F.floor((F.col("i") + 1) * F.col("r")).cast("int"), F.size("t"))
    x = x.withColumn("lo", lo).withColumn("hi", hi)
    return x.select(
        "doc_id",
        F.col("i").cast("long").alias("i"),
        F.array_join(F.slice("t", F.col("lo") + 1, F.greatest(F.col("hi") - F.col("lo"), F.lit(0))), " ").alias(
            "target",
        ),
        F.when(F.col("hi") == F.col("lo") + 1, "1-1").otherwise("1-n").alias("kind"),
    )


def text_scores(spark, d):
    """Per document: quality of a processed text, and its parts."""
    c = F.col("text")
    words, sents = F.size(T.tokenize(c)), F.size(T.sentences(c))
    q = (
        0.3 * F.least(F.length(c) / 1000, F.lit(1.0))
        + 0.25 * F.least(F.coalesce(F.try_divide(words, sents), F.lit(0.0)) / 20, F.lit(1.0))
        + 0.2 * F.lit(1.0)
    )
    compression = F.coalesce(
        F.try_divide(F.length(T.normalize_text(c, normalize_unicode=False)), F.length(c)),
        F.lit(0.0),
    )
    return docs(spark, d).select(
        "doc_id",
        words.cast("long").alias("n_words"),
        sents.cast("long").alias("n_sentences"),
        F.round(F.least(q, F.lit(1.0)), 6).alias("quality"),
        F.round(compression, 6).alias("compression"),
    )


def html_to_text(spark, d):
    """Visible text of pages: scripts and styles dropped, tags cut, entities decoded, blank lines removed."""
    h = F.col("html")
    title = T.collapse_ends(F.regexp_extract(h, r"(?is)<title[^>]*>(.*?)</title>", 1))
    body = F.regexp_replace(
        F.regexp_replace(h, r"(?is)<script.*?</script>|<style.*?</style>", ""),
        r"(?s)<[^>]+>",
        "\n",
    )
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&nbsp;", " "), ("&#39;", "'"), ("&amp;", "&")):
        body = F.replace(body, F.lit(a), F.lit(b))
    lines = F.filter(
        F.transform(F.split(body, "\n"), lambda x: F.regexp_replace(x, r"^[ \t\r]+|[ \t\r]+$", "")),
        lambda x: x != "",
    )
    return table(spark, d, "pages").select(
        "page_id",
        F.substring(F.md5(F.concat(F.lit("url_"), "url").cast("binary")), 1, 16).alias("doc_id"),
        title.alias("title"),
        F.array_join(lines, "\n").alias("text"),
    )


# Patterns of entities, with their confidence.
ENTITY_PATTERNS = [
    ("EMAIL", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b", 0.9),
    ("URL", r"https?://[^\s<>\"{}|\\^`\[\]]+", 0.9),
    ("YEAR", r"\b(?:19|20)\d{2}\b", 0.7),
]


def regex_entities(spark, d):
    rows = (
        docs(spark, d)
        .select("doc_id", "text")
        .unionByName(
            table(spark, d, "pages").select((-F.col("page_id") - 1).alias("doc_id"), F.col("html").alias("text")),
        )
    )
    as_rows = lambda n, c: lambda m: F.struct(F.lit(n).alias("label"), m.alias("match"), F.lit(c).alias("confidence"))
    found = F.flatten(
        F.array(
            *[
                F.transform(F.regexp_extract_all("text", F.lit(P.bounded(p)), F.lit(0)), as_rows(n, c))
                for n, p, c in ENTITY_PATTERNS
            ],
        ),
    )
    return (
        rows.select("doc_id", F.inline(found))
        .groupBy("doc_id", "label", "match", "confidence")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def metadata(spark, d):
    """Title, identifiers and citations read out of each text."""
    t = F.col("text")
    lines = F.transform(F.slice(F.split(t, "\n"), 1, 5), T.collapse_ends)
    title = F.try_element_at(
        F.filter(lines, lambda x: (F.length(x) > 5) & (F.length(x) < 200) & ~x.rlike(r"[.!?。！？]$")),
        F.lit(1),
    )
    urls = F.array_distinct(F.regexp_extract_all(t, F.lit(ENTITY_PATTERNS[1][1]), F.lit(0)))
    cites = F.array_distinct(F.concat(*[F.regexp_extract_all(t, F.lit(p), F.lit(1)) for p in P.CITATIONS]))
    date = lambda p: F.nullif(F.regexp_extract(t, p, 1), F.lit(""))
    return docs(spark, d).select(
        "doc_id", title.alias("title"), F.nullif(F.regexp_extract(t, P.DOI, 1), F.lit("")).alias("doi"),
        F.array_join(F.array_sort(urls), " ").alias("urls"), F.array_join(F.array_sort(cites), "|").alias("citations"),
        F.coalesce(*map(date, P.DATES)).alias("published"),
        F.size(F.filter(F.split(t, r"\s+"), lambda w: w != "")).cast("long").alias("word_count"),
    )


def sections(spark, d):
    """Authors and keywords named in each text."""
    t = F.col("text")
    split = lambda found, sep: F.flatten(F.transform(found, lambda m: F.split(m, sep)))
    many = lambda *p: F.concat(*[F.regexp_extract_all(t, F.lit(x), F.lit(1)) for x in p])
    tidy = lambda a, n: F.array_distinct(F.filter(F.transform(a, T.collapse_ends), lambda x: F.length(x) > n))
    authors = tidy(split(many(*P.AUTHORS), P.AUTHOR_ENDS), 0)
    keywords = tidy(split(many(*P.KEYWORDS), P.KEYWORD_ENDS), 1)
    return docs(spark, d).select(
        "doc_id",
        F.array_join(F.array_sort(authors), "|").alias("authors"),
        F.array_join(F.array_sort(keywords), "|").alias("keywords"),
    )


def prepared_corpus(spark, d):
    """Trimmed and cleaned texts with a language, none empty."""
    x = docs(spark, d).select(
        F.coalesce(F.col("doc_id").cast("string"), F.lit("doc")).alias("doc_id"),
        T.clean_text(F.trim("text")).alias("text"),
        F.coalesce("lang", T.heuristic_language(F.col("text")), F.lit("en")).alias("language"),
    )
    return x.where(F.col("text") != "")


_TOK = r"regexp_extract_all(lower(trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g'))), '[\p{L}\p{N}_]+')"
_SENT = (
    r"list_filter(list_transform(regexp_split_to_array(text, '[.!?。！？]+'), lambda s: trim(s, e' \n\t\r')),"
    r" lambda s: s <> '')"
)
_IN = lambda lang: ", ".join(f"'{w}'" for w in T.STOPWORDS[lang])
_NORM = r"trim(regexp_replace({}, '\s+', ' ', 'g'))"

QUERIES = {
    "text_normalize": normalize,
    "text_clean": clean,
    "token_freq": token_freq,
    "stopword_counts": stopwords,
    "type_token_ratio": type_token_ratio,
    "truncate_modes": truncate,
    "remove_accents": accents,
    "string_similarity": similarity,
    "lang_heuristic": lang_heuristic,
    "filter_language": filter_language,
    "sentence_split": sentence_split,
    "sentence_alignment": sentence_alignment,
    "text_scores": text_scores,
    "html_to_text": html_to_text,
    "regex_entities": regex_entities,
    "metadata_extract": metadata,
    "authors_keywords": sections,
    "prepared_corpus": prepared_corpus,
}

_CLEAN = (
    r"lower(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({},"
    r" 'http[s]?://(?:[a-zA-Z]|[0-9]|[$-_@.&+]|[!*\\(\\),]|(?:%[0-9a-fA-F][0-9a-fA-F]))+', '', 'g'), '<[^>]+>', '',"
    r" 'g'), '\S+@\S+', '', 'g'), '\n+', ' ', 'g'), '\s+', ' ', 'g')))"
)

SQL = {
    "text_normalize": rf"SELECT doc_id, {_NORM.format('lower(text)')} AS normalized, {_NORM.format(r'''regexp_replace(lower(text), '[!-/:-@\[-`{-~]', ' ', 'g')''')} AS bare FROM documents",
    "text_clean": f"SELECT doc_id, {_CLEAN.format('text')} AS cleaned FROM documents",
    "token_freq": f"SELECT token, count(*) AS n FROM (SELECT unnest({_TOK}) AS token FROM documents) GROUP BY token",
    "stopword_counts": f"SELECT doc_id, len(t)::BIGINT AS n_tokens, len(list_filter(t, lambda x: x NOT IN ({_IN('en')})))::BIGINT AS n_en, len(list_filter(t, lambda x: x NOT IN ({_IN('fr')})))::BIGINT AS n_fr FROM (SELECT doc_id, {_TOK} AS t FROM documents)",
    "type_token_ratio": f"SELECT doc_id, round(CASE WHEN len(t) = 0 THEN 0 ELSE len(list_distinct(t))::DOUBLE / len(t) END, 6) AS ttr FROM (SELECT doc_id, {_TOK} AS t FROM documents)",
    "truncate_modes": "SELECT doc_id, CASE WHEN length(text) <= 100 THEN text ELSE left(text, 100) END AS head, CASE WHEN length(text) <= 100 THEN text ELSE right(text, 100) END AS tail, CASE WHEN length(text) <= 100 THEN text ELSE left(text, 50) || right(text, 50) END AS middle FROM documents",
    "remove_accents": "SELECT doc_id, strip_accents(text) AS plain FROM documents",
    "string_similarity": "SELECT p_partkey, round(CASE WHEN p_name = p_type THEN 1.0::DOUBLE ELSE 1 - levenshtein(p_name, p_type)::DOUBLE / greatest(length(p_name), length(p_type)) END, 6) AS name_type, round(CASE WHEN p_brand = p_type THEN 1.0::DOUBLE ELSE 1 - levenshtein(p_brand, p_type)::DOUBLE / greatest(length(p_brand), length(p_type)) END, 6) AS brand_type FROM part",
    "lang_heuristic": "WITH g AS (SELECT lang, length(trim(text)) AS n, length(regexp_replace(text, '[^一-鿿]', '', 'g')) AS cjk, length(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS a FROM documents), h AS (SELECT lang, CASE WHEN n < 3 THEN NULL WHEN cjk > a THEN 'zh' WHEN a > 0 THEN 'en' END AS guess FROM g) SELECT lang, guess, count(*) AS n, CASE guess WHEN 'zh' THEN '中文' WHEN 'en' THEN 'English' END AS name FROM h GROUP BY lang, guess",
    "filter_language": "SELECT doc_id, lang IN ('zh', 'fr', 'en') AS supported FROM documents WHERE length(trim(text)) >= 3 AND length(regexp_replace(text, '[^A-Za-z]', '', 'g')) > 0 AND length(regexp_replace(text, '[^一-鿿]', '', 'g')) <= length(regexp_replace(text, '[^A-Za-z]', '', 'g'))",
    "sentence_split": f"SELECT doc_id, len(s)::BIGINT AS n_sentences, s[1] AS first, s[-1] AS last FROM (SELECT doc_id, {_SENT} AS s FROM documents)",
    "sentence_alignment": f"WITH a AS (SELECT doc_id, s, lead(s) OVER (PARTITION BY source ORDER BY doc_id) AS t FROM (SELECT doc_id, source, {_SENT} AS s FROM documents)), b AS (SELECT doc_id, t, len(t)::DOUBLE / len(s) AS r, unnest(range(len(s))) AS i FROM a WHERE len(t) > 0 AND len(s) > 0), c AS (SELECT *, floor(i * r)::INT AS lo, least(floor((i + 1) * r)::INT, len(t)) AS hi FROM b) SELECT doc_id, i::BIGINT AS i, CASE WHEN hi > lo THEN array_to_string(t[lo + 1:hi], ' ') ELSE '' END AS target, CASE WHEN hi = lo + 1 THEN '1-1' ELSE '1-n' END AS kind FROM c",
    "text_scores": f"WITH x AS (SELECT doc_id, text, len({_TOK}) AS w, len({_SENT}) AS s FROM documents) SELECT doc_id, w::BIGINT AS n_words, s::BIGINT AS n_sentences, round(least(0.3::DOUBLE * least(length(text) / 1000.0::DOUBLE, 1.0) + 0.25::DOUBLE * least(CASE WHEN s = 0 THEN 0 ELSE w::DOUBLE / s END / 20, 1.0) + 0.2::DOUBLE, 1.0), 6) AS quality, round(CASE WHEN length(text) = 0 THEN 0 ELSE length({_NORM.format('lower(text)')})::DOUBLE / length(text) END, 6) AS compression FROM x",
    "html_to_text": r"WITH b AS (SELECT page_id, url, html, regexp_replace(regexp_replace(html, '(?is)<script.*?</script>|<style.*?</style>', '', 'g'), '(?s)<[^>]+>', e'\n', 'g') AS body FROM pages), c AS (SELECT *, replace(replace(replace(replace(replace(replace(body, '&lt;', '<'), '&gt;', '>'), '&quot;', chr(34)), '&nbsp;', ' '), '&#39;', ''''), '&amp;', '&') AS plain FROM b) SELECT page_id, substr(md5('url_' || url), 1, 16) AS doc_id, trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), e' \n\t\r') AS title, array_to_string(list_filter(list_transform(string_split(plain, e'\n'), lambda x: trim(x, e' \t\r')), lambda x: x <> ''), e'\n') AS text FROM c",
    "regex_entities": r"""WITH r AS (SELECT doc_id, text FROM documents UNION ALL SELECT -page_id - 1, html FROM pages), m AS (
SELECT doc_id, 'EMAIL' AS label, unnest(regexp_extract_all(text, '\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b')) AS match, 0.9::DOUBLE AS confidence FROM r UNION ALL
SELECT doc_id, 'URL', unnest(regexp_extract_all(text, 'https?://[^\s<>"{}|\\^`\[\]]+')), 0.9::DOUBLE FROM r UNION ALL
SELECT doc_id, 'YEAR', unnest(regexp_extract_all(text, '\b(?:19|20)\d{2}\b')), 0.7::DOUBLE FROM r) SELECT doc_id, label, match, confidence, count(*) AS n FROM m GROUP BY ALL""",
    "metadata_extract": r"""WITH x AS (SELECT doc_id, text,
 list_filter(list_transform(string_split(text, e'\n')[1:5], lambda s: trim(s, e' \n\t\r')), lambda s: length(s) > 5 AND length(s) < 200 AND NOT regexp_matches(s, '[.!?。！？]$'))[1] AS title,
 nullif(regexp_extract(text, '(?i)doi[:：]?\s*(10\.\d+/\S+)', 1), '') AS doi,
 list_sort(list_distinct(regexp_extract_all(text, 'https?://[^\s<>"{}|\\^`\[\]]+'))) AS u,
 list_sort(list_distinct(list_concat(regexp_extract_all(text, '\[([^\]]+)\]', 1), regexp_extract_all(text, '\(([^)]*(?:19|20)\d{2}[^)]*)\)', 1)))) AS c,
 coalesce(nullif(regexp_extract(text, '(\d{4}[-/年]\d{1,2}[-/月]\d{1,2}日?)', 1), ''), nullif(regexp_extract(text, '(\d{1,2}[-/]\d{1,2}[-/]\d{4})', 1), '')) AS published,
 len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')) AS n FROM documents)
SELECT doc_id, title, doi, array_to_string(u, ' ') AS urls, array_to_string(c, '|') AS citations, published, n::BIGINT AS word_count FROM x""",
    "authors_keywords": r"""WITH x AS (SELECT doc_id,
 list_concat(regexp_extract_all(text, '(?i)(?:作者|authors?)[:：]\s*([^。\n]+)', 1), regexp_extract_all(text, '(?i)(?:著|by)\s+([^。\n]+)', 1)) AS a,
 list_concat(regexp_extract_all(text, '(?i)(?:关键词|key words?|keywords?)[:：]\s*([^。\n]+)', 1), regexp_extract_all(text, '(?i)(?:主题|topics?)[:：]\s*([^。\n]+)', 1)) AS k FROM documents)
SELECT doc_id, array_to_string(list_sort(list_distinct(list_filter(list_transform(flatten(list_transform(a, lambda m: regexp_split_to_array(m, '[,;，；]'))), lambda s: trim(s, e' \n\t\r')), lambda s: length(s) > 0))), '|') AS authors,
 array_to_string(list_sort(list_distinct(list_filter(list_transform(flatten(list_transform(k, lambda m: regexp_split_to_array(m, '[,;，；\s]+'))), lambda s: trim(s, e' \n\t\r')), lambda s: length(s) > 1))), '|') AS keywords FROM x""",
    "prepared_corpus": f"WITH x AS (SELECT doc_id::VARCHAR AS doc_id, {_CLEAN.format('trim(text)')} AS text, coalesce(lang, 'en') AS language FROM documents) SELECT * FROM x WHERE text <> ''",
}
