"""Queries of data quality: documents as records, with fields cut from their texts."""

from __future__ import annotations

from pyspark.sql import Observation
from pyspark.sql import functions as F

from trilune.functions.text import normalize_text, tokenize
from trilune.operators import quality as Q
from trilune.sources.tables import stored, table


def records(spark, d):
    some = lambda a, n: F.slice("_tokens", a, n)
    n = F.col("doc_id")
    day = F.date_add(F.lit("2024-01-01").cast("date"), (n % 365).cast("int"))
    created = (
        F.when(n % 4 == 1, F.date_format(F.date_sub(day, 1), "yyyy-MM-dd"))
        .when(n % 4 == 2, F.date_format(F.date_add(day, 1), "yyyy-MM-dd"))
        .when(n % 9 == 3, "no date")
    )
    return (
        table(spark, d, "documents")
        .withColumn("_tokens", tokenize(F.col("text")))
        .select(
            n.alias("id"),
            F.element_at(F.split("text", "\n"), 1).alias("title"),
            F.col("text").alias("content"),
            F.col("lang").alias("language"),
            some(F.lit(1), (n % 4).cast("int")).alias("authors"),
            some(F.lit(5), (n % 7).cast("int")).alias("keywords"),
            F.date_format(day, "yyyy/MM/dd").alias("publish_date"),
            created.alias("created_date"),
            F.when(n % 3 == 0, F.concat(F.lit("10."), n, F.lit("/x"))).when(n % 3 == 1, F.lit("bad")).alias("doi"),
            F.concat(F.lit("example.org/ "), n, F.lit(".")).alias("url"),
        )
    )


def quality_metrics(spark, d):
    return (
        Q.assessed(records(spark, d))
        .select("id", F.inline("metrics"))
        .select("id", "name", F.round("value", 6).alias("value"), "passed")
    )


def quality_overall(spark, d):
    return Q.assessed(records(spark, d)).select(
        "id",
        F.round("overall", 6).alias("overall"),
        F.array_join("recommendations", "; ").alias("recommendations"),
    )


def quality_summary(spark, d):
    x = Q.assessed(records(spark, d)).select(F.round("overall", 9).alias("s"))
    return x.agg(
        F.count("s").alias("n"),
        F.round(F.avg("s"), 6).alias("mean"),
        F.round(F.min("s"), 6).alias("low"),
        F.round(F.max("s"), 6).alias("high"),
        F.count_if(F.col("s") >= 0.7).alias("passed"),
    )


def quality_histogram(spark, d):
    s = F.col("s")
    x = Q.assessed(records(spark, d)).select(F.round("overall", 9).alias("s"))
    return x.groupBy(F.when(s >= 0.9, "excellent").when(s >= 0.7, "good").when(s >= 0.5, "fair").otherwise("poor").alias("bucket")).agg(
        F.count(F.lit(1)).alias("n"),
    )


def rule_validation(spark, d):
    return records(spark, d).select("id", *[Q.rule_passes(n).alias(n) for n in Q.RULES])


def clean_records(spark, d):
    x = Q.cleaned(records(spark, d))
    return x.select(
        "id",
        "title",
        F.array_join("authors", "|").alias("authors"),
        F.array_join("keywords", "|").alias("keywords"),
        "url",
        "publish_date",
        F.array_join("actions", ",").alias("actions"),
    )


def validate_text(spark, d):
    """Product of penalties of each text, and whether it is long enough."""
    score, valid = Q.text_validation(F.col("text"), F.col("lang"))
    return table(spark, d, "documents").select("doc_id", F.round(score, 6).alias("score"), valid.alias("valid"))


def corpus_report(spark, d):
    t = F.col("text")
    norm = F.md5(normalize_text(t, normalize_unicode=False).cast("binary"))
    ratio = lambda keep: F.avg(F.length(F.regexp_replace(t, keep, "")) / F.length(t))
    return table(spark, d, "documents").agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.avg((F.trim(t) != "").cast("double")), 6).alias("non_empty"),
        F.round(F.avg(F.length(t)), 4).alias("mean_length"),
        F.countDistinct("doc_id").alias("ids"),
        (F.count(F.lit(1)) - F.countDistinct(norm)).alias("duplicates"),
        F.round(F.avg((F.length(t) < 20).cast("double")), 6).alias("short"),
        F.round(F.avg((F.length(t) > 5000).cast("double")), 6).alias("long"),
        F.round(ratio(r"[^\x20-\x7E]"), 6).alias("ascii"),
        F.count_if(F.coalesce("lang", F.lit("")) == "").alias("no_language"),
    )


def checksum_duplicates(spark, d):
    x = (
        table(spark, d, "documents")
        .groupBy(F.md5(F.col("text").cast("binary")).alias("checksum"))
        .agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list("doc_id")).alias("ids"))
        .where("n > 1")
    )
    return x.select("checksum", "n", F.array_join("ids", ",").alias("ids"))


def title_distinct(spark, d):
    """The first record of each trimmed, lower-cased title."""
    key = F.lower(F.trim("title"))
    return records(spark, d).groupBy(key.alias("title")).agg(F.min("id").alias("id"))


def doc_store(spark, d):
    """Documents with their judgments, if any; of known languages and quality."""
    return (
        table(spark, d, "documents")
        .join(table(spark, d, "labels"), "doc_id", "left")
        .where("lang in ('fr', 'en') and quality >= 1")
        .select("doc_id", "lang", "quality", F.concat(F.substring("text", 1, 300), F.lit("...")).alias("preview"))
    )


def doc_store_stats(spark, d):
    x = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    return x.groupingSets([["lang"], ["source"], []], "lang", "source").agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.coalesce(F.avg("quality"), F.lit(0.0)), 6).alias("quality"),
    )


def demo_quality(spark, d):
    x = records(spark, d)
    s = (
        F.when(F.col("title") != "", 0.2).otherwise(0.0)
        + 0.4 * F.least(F.length("content") / 500, F.lit(1.0))
        + 0.2 * F.least(F.size("authors") / 2, F.lit(1.0))
        + 0.2 * 0.9
    )
    return x.select("id", F.round(s, 6).alias("score"), (F.round(s, 9) >= 0.7).alias("passed"))


def date_parse(spark, d):
    forms = F.array(
        F.date_format("ts", "yyyy-MM-dd"),
        F.date_format("ts", "yyyy/MM/dd"),
        F.date_format("ts", "dd/MM/yyyy"),
        F.date_format("ts", "yyyy-MM"),
        F.lit("unknown"),
    )
    x = table(spark, d, "events").select(
        "event_id",
        F.element_at(forms, (F.col("event_id") % 5 + 1).cast("int")).alias("raw"),
    )
    return x.select(
        "event_id",
        F.date_format(Q.parsed_date(F.col("raw"), F.lit("2024-02-01").cast("timestamp")), "yyyy-MM-dd").alias("day"),
    )


def latest_state(spark, d):
    """Upserts as an append-only log: the newest row of each user."""
    e = table(spark, d, "events")
    x = e.groupBy("user_id").agg(
        F.max_by(F.struct("event_type", "value"), F.struct("ts", "event_id")).alias("x"),
        F.min("ts").alias("created"),
    )
    return x.select(
        "user_id",
        F.col("x.event_type").alias("event_type"),
        F.col("x.value").alias("value"),
        F.date_format("created", "yyyy-MM-dd HH:mm:ss").alias("created"),
    )


def assessed_and_cleaned(spark, d):
    """Records assessed as they came and cleaned in the same pass."""
    return Q.assessed_and_cleaned(records(spark, d)).select(
        "id",
        F.round("overall", 6).alias("overall"),
        "title",
        F.array_join("actions", ",").alias("actions"),
    )


def batch_assessed(spark, d):
    """A batch's summary out of the pass that stored its records."""
    seen = Observation("batch")
    stored(Q.assessed_and_cleaned(records(spark, d), seen).select("id", "overall", "actions"), "assessed")
    got = seen.get
    row = (got["n"], *(round(got[c], 6) for c in ("mean", "low", "high")), got["passed"])
    return spark.createDataFrame([row], "n long, mean double, low double, high double, passed long")


QUERIES = {
    f.__name__: f
    for f in (assessed_and_cleaned, batch_assessed, quality_metrics, quality_overall, quality_summary, quality_histogram, rule_validation, clean_records, validate_text, corpus_report, checksum_duplicates, title_distinct, doc_store, doc_store_stats, demo_quality, date_parse, latest_state)
}

_TK = r"regexp_extract_all(lower(trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g'))), '[\p{L}\p{N}_]+')"
_REC = f"""rc AS (SELECT doc_id AS id, string_split(text, e'\\n')[1] AS title, text AS content, lang AS language, CASE WHEN doc_id % 4 = 0 THEN [] ELSE tk[1:doc_id % 4] END AS authors, CASE WHEN doc_id % 7 = 0 THEN [] ELSE tk[5:4 + doc_id % 7] END AS keywords,
 strftime(DATE '2024-01-01' + (doc_id % 365)::INT, '%Y/%m/%d') AS publish_date, CASE doc_id % 3 WHEN 0 THEN '10.' || doc_id || '/x' WHEN 1 THEN 'bad' END AS doi, 'example.org/ ' || doc_id || '.' AS url FROM (SELECT *, {_TK} AS tk FROM documents))"""
_GUESS = (
    "CASE WHEN length(trim(content)) < 3 THEN NULL WHEN length(regexp_replace(content, '[^一-鿿]', '',"
    " 'g')) > length(regexp_replace(content, '[^A-Za-z]', '', 'g')) THEN 'zh'"
    " WHEN length(regexp_replace(content, '[^A-Za-z]', '', 'g')) > 0 THEN 'en' END"
)
_VALUES = {
    "content_length": "CASE WHEN content <> '' THEN least(length(content) / 1000.0::DOUBLE, 1.0) END",
    "language_confidence": "CASE WHEN content <> '' THEN (language IS NOT NULL)::INT::DOUBLE END",
    "sentence_structure": (
        "CASE WHEN content <> '' THEN least(list_sum(list_transform(regexp_split_to_array(content, '[.!?。！？]+'),"
        " lambda x: length(trim(x))))::DOUBLE / len(regexp_split_to_array(content, '[.!?。！？]+')) / 50, 1.0) END"
    ),
    "title_quality": "CASE WHEN title <> '' THEN CASE WHEN length(title) BETWEEN 5 AND 200 THEN 1.0::DOUBLE ELSE 0.5 END END",
    "authors_completeness": "least(len(authors) / 3.0::DOUBLE, 1.0)",
    "keywords_completeness": "least(len(keywords) / 5.0::DOUBLE, 1.0)",
    "date_presence": "1.0::DOUBLE",
    "identifiers": "CASE WHEN doi IS NOT NULL THEN 0.5::DOUBLE ELSE 0 END + 0.3::DOUBLE",
    "required_fields": "(1 + (title <> '')::INT + (content <> '')::INT) / 3.0::DOUBLE",
    "type_consistency": "1.0::DOUBLE",
    "format_consistency": (
        "((doi IS NULL OR regexp_matches(doi, '^10\\.\\d+/'))::INT + regexp_matches(url,"
        " '^https?://')::INT + 1) / 3.0::DOUBLE"
    ),
    "language_consistency": (
        f"CASE WHEN content = '' THEN 0.5::DOUBLE WHEN language IS NULL THEN 0.3 WHEN language = ({_GUESS}) THEN 1.0"
        f" ELSE 0.5 END"
    ),
    "date_consistency": "CASE WHEN id % 4 = 1 THEN 0.5::DOUBLE WHEN id % 4 = 2 THEN 1.0 WHEN id % 9 = 3 THEN 0.5 ELSE 1.0 END",
    "length_reasonableness": (
        "((length(title) BETWEEN 5 AND 200)::INT + (length(content) BETWEEN 10"
        " AND 1000000)::INT + (len(authors) BETWEEN 1 AND 50)::INT + (len(keywords) BETWEEN 1"
        " AND 20)::INT) / 4.0::DOUBLE"
    ),
}
_MET = (
    "mt AS ("
    + " UNION ALL ".join(
        (
            f"SELECT id, '{n}' AS name, round({v}, 9) AS value, {Q.METRICS[n][0]}::DOUBLE AS threshold,"
            f" {Q.METRICS[n][1]}::DOUBLE AS weight, {i} AS pos,"
            f" {repr(Q.ADVICE[n]) if n in Q.ADVICE else 'NULL'} AS advice FROM rc"
        )
        for i, (n, v) in enumerate(_VALUES.items())
    )
    + ")"
)
_ALL = (
    f"WITH {_REC}, {_MET}, ov AS (SELECT id, sum(value * weight) / sum(weight) AS overall, string_agg(CASE"
    f" WHEN value < threshold THEN advice END, '; ' ORDER BY pos) AS advice FROM mt WHERE value IS NOT NULL"
    f" GROUP BY id)"
)
_CLEANF = r"""trim(regexp_replace(regexp_replace({0}, '\s+', ' ', 'g'), '[^\p{{L}}\p{{M}}\p{{N}}_\s.,!?;:()\[\]{{}}"''-]', '', 'g'))"""

SQL = {
    "quality_metrics": f"WITH {_REC}, {_MET} SELECT id, name, round(value, 6) AS value, value >= threshold AS passed FROM mt WHERE value IS NOT NULL",
    "quality_overall": f"{_ALL} SELECT id, round(overall, 6) AS overall, coalesce(advice, '{Q.GOOD}') AS recommendations FROM ov",
    "quality_summary": f"{_ALL}, x AS (SELECT round(overall, 9) AS s FROM ov) SELECT count(s) AS n, round(avg(s), 6) AS mean, round(min(s), 6) AS low, round(max(s), 6) AS high, count(*) FILTER (s >= 0.7) AS passed FROM x",
    "quality_histogram": f"{_ALL}, x AS (SELECT round(overall, 9) AS s FROM ov) SELECT CASE WHEN s >= 0.9 THEN 'excellent' WHEN s >= 0.7 THEN 'good' WHEN s >= 0.5 THEN 'fair' ELSE 'poor' END AS bucket, count(*) AS n FROM x GROUP BY 1",
    "rule_validation": f"WITH {_REC} SELECT id, (title = '' OR length(title) BETWEEN 5 AND 200) AND (content = '' OR length(content) BETWEEN 5 AND 200) AS title_length, (title = '' OR length(title) BETWEEN 50 AND 100000) AND (content = '' OR length(content) BETWEEN 50 AND 100000) AS content_length, regexp_matches(language, '^[a-z]{{2}}$') AS language_detection, doi IS NULL OR regexp_matches(doi, '^10\\.\\d+/') AS doi_format, regexp_matches(url, '^https?://') AS url_format FROM rc",
    "clean_records": f"""WITH {_REC}, c AS (SELECT *, {_CLEANF.format('title')} AS t2, {_CLEANF.format('content')} AS c2,
 list_transform(authors, lambda x: trim(regexp_replace(regexp_replace(x, '[0-9]', '', 'g'), '[^\\p{{L}}\\p{{M}}\\p{{N}}_\\s.,\\-]', '', 'g'))) AS a1, 'https://' || regexp_replace(regexp_replace(trim(url), '\\s+', '', 'g'), '[.,;!?"'']+$', '') AS u2, strftime(strptime(publish_date, '%Y/%m/%d'), '%Y-%m-%d') AS p2 FROM rc),
 e AS (SELECT *, list_filter(a1, lambda x: length(x) > 1) AS a2, list_filter(keywords, lambda x: length(x) BETWEEN 2 AND 50) AS k2 FROM c), f AS (SELECT *, list_filter(a2, lambda x, i: list_position(a2, x) = i) AS a3, list_filter(k2, lambda x, i: list_position(k2, x) = i) AS k3 FROM e)
 SELECT id, nullif(t2, '') AS title, array_to_string(a3, '|') AS authors, array_to_string(k3, '|') AS keywords, u2 AS url, p2 AS publish_date,
 concat_ws(',', CASE WHEN t2 <> title THEN 'title' END, CASE WHEN c2 <> content THEN 'content' END, CASE WHEN a3 <> authors THEN 'authors' END, CASE WHEN k3 <> keywords THEN 'keywords' END, 'url', 'publish_date') AS actions FROM f""",
    "validate_text": "WITH x AS (SELECT doc_id, text, lang, string_split(text, e'\\n') AS l FROM documents), y AS (SELECT *, len(l) AS n, len(list_distinct(list_filter(list_transform(l, lambda s: trim(s)), lambda s: s <> ''))) AS u FROM x) SELECT doc_id, round(CASE WHEN length(text) < 50 THEN 0.3::DOUBLE ELSE 1 END * CASE WHEN length(text) > 1000000 THEN 0.8::DOUBLE ELSE 1 END * CASE WHEN lang IN ('zh', 'fr', 'en') THEN 1::DOUBLE ELSE 0.7 END * CASE WHEN length(trim(text))::DOUBLE / length(text) < 0.5 THEN 0.6::DOUBLE ELSE 1 END * CASE WHEN n > 10 AND 1 - u::DOUBLE / n > 0.7 THEN 0.7::DOUBLE ELSE 1 END, 6) AS score, length(text) >= 50 AS valid FROM y",
    "corpus_report": r"SELECT count(*) AS n, round(avg((trim(text) <> '')::INT), 6) AS non_empty, round(avg(length(text)), 4) AS mean_length, count(DISTINCT doc_id) AS ids, count(*) - count(DISTINCT md5(trim(regexp_replace(lower(text), '\s+', ' ', 'g')))) AS duplicates, round(avg((length(text) < 20)::INT), 6) AS short, round(avg((length(text) > 5000)::INT), 6) AS long, round(avg(length(regexp_replace(text, '[^\x20-\x7E]', '', 'g'))::DOUBLE / length(text)), 6) AS ascii, count(*) FILTER (coalesce(lang, '') = '') AS no_language FROM documents",
    "checksum_duplicates": "SELECT md5(text) AS checksum, count(*) AS n, string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id) AS ids FROM documents GROUP BY 1 HAVING count(*) > 1",
    "title_distinct": f"WITH {_REC} SELECT lower(trim(title)) AS title, min(id) AS id FROM rc GROUP BY 1",
    "doc_store": "SELECT doc_id, lang, quality, substr(text, 1, 300) || '...' AS preview FROM documents LEFT JOIN labels USING (doc_id) WHERE lang IN ('fr', 'en') AND quality >= 1",
    "doc_store_stats": "SELECT lang, source, count(*) AS n, round(coalesce(avg(quality), 0), 6) AS quality FROM documents LEFT JOIN labels USING (doc_id) GROUP BY GROUPING SETS ((lang), (source), ())",
    "demo_quality": f"WITH {_REC}, x AS (SELECT id, CASE WHEN title <> '' THEN 0.2::DOUBLE ELSE 0 END + 0.4::DOUBLE * least(length(content) / 500.0::DOUBLE, 1.0) + 0.2::DOUBLE * least(len(authors) / 2.0::DOUBLE, 1.0) + 0.18::DOUBLE AS s FROM rc) SELECT id, round(s, 6) AS score, round(s, 9) >= 0.7 AS passed FROM x",
    "date_parse": "SELECT event_id, CASE WHEN event_id % 5 < 3 THEN strftime(ts, '%Y-%m-%d') WHEN event_id % 5 = 3 THEN strftime(ts, '%Y-%m-01') ELSE '2024-02-01' END AS day FROM events",
    "latest_state": "SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type, arg_max(value, (ts, event_id)) AS value, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS created FROM events GROUP BY user_id",
}
SQL |= {
    "assessed_and_cleaned": f"SELECT id, overall, title, actions FROM ({SQL['quality_overall']}) JOIN (SELECT id, title, actions FROM ({SQL['clean_records']})) USING (id)",
    "batch_assessed": SQL["quality_summary"],
}
