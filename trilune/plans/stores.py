"""Queries over stored tables and saved answers of services, written to the shared folder and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from trilune.operators import quality as Q
from trilune.plans.quality import SQL as QUALITY
from trilune.plans.quality import records
from trilune.sources import services as V
from trilune.sources import stores as S
from trilune.sources.tables import scratch, table


def entries(spark, d) -> dict:
    """An entry for each nation, in the shape of each service."""
    n = table(spark, d, "nation").select(
        F.col("n_nationkey").cast("string").alias("k"),
        F.col("n_name").alias("name"),
        F.col("n_nationkey").cast("long").alias("i"),
    )
    two = F.array("name", F.lit("Other"))
    return {
        "ieee": n.select(
            F.col("k").alias("article_number"),
            F.col("name").alias("title"),
            F.struct(two.alias("authors")).alias("authors"),
            F.lit("said").alias("abstract"),
            F.lit("2020").alias("publication_date"),
            F.struct(F.struct(two.alias("terms")).alias("ieee_terms")).alias("index_terms"),
        ),
        "arxiv": n.select(
            F.concat(F.lit("http://arxiv.org/abs/"), "k").alias("entry_id"),
            F.col("name").alias("title"),
            two.alias("authors"),
            F.lit("said").alias("summary"),
            F.lit("2021-03-04T05:06:07Z").alias("published"),
            F.lit("cs.CL").alias("primary_category"),
        ),
        "scholar": n.select(
            F.concat(F.lit("u"), "k").alias("pub_url"),
            F.struct(F.col("name").alias("title"), F.concat("name", F.lit(" and Other")).alias("author"), F.lit("said").alias("abstract"), F.lit("2019").alias("pub_year")).alias(
                "bib",
            ),
        ),
        "hugging_face": n.select(
            F.col("k").alias("id"),
            F.lit("said").alias("description"),
            two.alias("tags"),
            F.col("i").alias("downloads"),
        ),
        "hugging_face_info": n.select(
            F.concat(F.lit("i"), "k").alias("id"),
            F.col("name").alias("builder_name"),
            F.concat("name", F.lit("\nmore")).alias("citation"),
            F.lit("said").alias("description"),
            two.alias("tags"),
        ),
        "kaggle": n.select(
            F.col("k").alias("ref"),
            F.col("name").alias("title"),
            F.col("name").alias("author"),
            F.lit("said").alias("subtitle"),
            two.alias("tags"),
        ),
        "marc": n.select(
            F.col("i").alias("number"),
            F.lit("lib").alias("library"),
            F.array(F.struct(F.lit("245").alias("tag"), F.col("name").alias("a")), F.struct(F.lit("100").alias("tag"), F.col("name").alias("a"))).alias(
                "fields",
            ),
        ),
        "twitter": n.select(
            F.col("k").alias("id"),
            F.lit("said").alias("full_text"),
            F.struct(F.col("name").alias("screen_name")).alias("user"),
            F.lit("2022-01-02T03:04:05Z").alias("created_at"),
            F.lit("en").alias("lang"),
        ),
        "reddit": n.select(
            F.col("k").alias("id"),
            F.col("name").alias("title"),
            F.col("name").alias("author"),
            F.lit("said").alias("selftext"),
            F.lit(86400).cast("long").alias("created_utc"),
            F.concat("name", F.lit("  Other")).alias("link_flair_text"),
        ),
    }


def service_records(spark, d):
    out = None
    for name, rows in entries(spark, d).items():
        rows.write.json(path := scratch(spark, name))
        x = V.read_service(spark, path, name)
        out = x if out is None else out.unionByName(x)
    return out.select(
        "id",
        "title",
        F.array_join("authors", "|").alias("authors"),
        "abstract",
        "source",
        "publish_date",
        "language",
        F.array_join("keywords", "|").alias("keywords"),
    )


def service_record(spark, d):
    """The first source that has an id, by order of sources."""
    rows = entries(spark, d)
    found = []
    for name in ("kaggle", "reddit"):
        rows[name].write.json(path := scratch(spark, name))
        found.append(V.read_service(spark, path, name).withColumn("id", F.regexp_replace("id", "^.*_", "")))
    return V.record_of(found, "any_7", "any_").select("id", "title", "source")


def sample_records(spark, d):
    return (
        V.sample_catalogue(spark, "听力")
        .unionByName(V.sample_posts(spark, "听力", 3))
        .select("id", "title", "abstract", "publish_date", F.array_join("keywords", "|").alias("keywords"))
    )


def stored_reports(spark, d):
    S.create(spark, folder := scratch(spark, "store"))
    S.save_reports(Q.assessed(records(spark, d)), folder, "2024-01-01")
    S.save_cleaning(Q.cleaned(records(spark, d)), folder, "2024-01-01")
    kept = S.read(spark, folder, "quality_reports").join(
        S.read(spark, folder, "cleaning_records").select("record_id", "cleaning_actions"),
        "record_id",
        "left",
    )
    score = F.round(F.get_json_object("report_data", "$.overall").cast("double"), 6)
    return kept.select(
        F.col("record_id").cast("long").alias("id"),
        F.round("overall_score", 6).alias("overall"),
        score.alias("in_report"),
        "issues_count",
        F.col("cleaning_actions").isNotNull().alias("cleaned"),
    )


def exercise_log(spark, d):
    """Events as answered exercises, logged in two parts; who mastered what follows from the log."""
    S.create(spark, folder := scratch(spark, "store"), ("exercise_log",))
    e = table(spark, d, "events").select(
        F.col("user_id").cast("string").alias("learner_id"),
        F.col("event_type").alias("concept_id"),
        F.col("event_id").cast("string").alias("question_id"),
        (F.col("value") / 100).alias("difficulty"),
        (F.col("value") > 50).alias("success"),
        F.lit(1.0).alias("response_time"),
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("created_at"),
    )
    for part in (0, 1):
        S.log_exercises(e.where(F.col("question_id") % 2 == part), folder)
    return S.mastery(S.read(spark, folder, "exercise_log")).fillna("", ["last_success_at"])


def document_pages(spark, d):
    """Stored documents, the second ten of the newest, with their texts."""
    S.create(spark, folder := scratch(spark, "store"), ("documents", "document_content"))
    x = (
        table(spark, d, "documents")
        .where("doc_id is not null")
        .dropDuplicates(["doc_id"])
        .withColumn("doc_id", F.col("doc_id").cast("string"))
    )
    meta = F.when(F.col("doc_id") % 3 == 0, F.lit("no json")).otherwise(
        F.concat(F.lit('{"lang": "'), F.coalesce("lang", F.lit("")), F.lit('"}')),
    )
    S.append(
        x.select(
            "doc_id",
            F.col("lang").alias("language"),
            F.lpad("doc_id", 12, "0").alias("created_at"),
            "source",
            meta.alias("metadata"),
        ),
        folder,
        "documents",
    )
    S.append(x.select("doc_id", "text"), folder, "document_content")
    found = S.with_content(
        S.page(S.read(spark, folder, "documents"), 10, 10),
        S.read(spark, folder, "document_content"),
    )
    kept = S.decoded(found)
    return kept.select(
        "doc_id",
        F.coalesce(F.col("metadata")["lang"], F.col("metadata")["raw"]).alias("said"),
        F.md5(F.col("text").cast("binary")).alias("hash"),
    )


def document_by_id(spark, d):
    S.create(spark, folder := scratch(spark, "store"), ("documents", "document_content"))
    x = table(spark, d, "documents").withColumn("doc_id", F.col("doc_id").cast("string"))
    S.append(x.select("doc_id", F.col("lang").alias("language")), folder, "documents")
    S.append(x.select("doc_id", "text"), folder, "document_content")
    return S.with_content(S.read(spark, folder, "documents"), S.read(spark, folder, "document_content"), "17").select(
        "doc_id",
        "language",
        "text",
    )


#: Made-up records for trying things out; no query of the engine, as they come from no table.
FIXTURES = {"sample_records": sample_records}

QUERIES = {
    f.__name__: f
    for f in (service_records, service_record, stored_reports, exercise_log, document_pages, document_by_id)
}

_SERVICES = [
    # id, title, authors, source, date, language, keywords
    ("'ieee_' || k", "n", "n || '|Other'", "IEEE Xplore", "'2020'", "'en'", "n || '|Other'"),
    ("'arxiv_' || k", "n", "n || '|Other'", "arXiv", "'2021-03-04'", "'en'", "''"),
    ("'gscholar_' || md5('u' || k)", "n", "n || '|Other'", "Google Scholar", "'2019'", "'en'", "''"),
    ("'hf_' || k", "k::VARCHAR", "''", "HuggingFace", "NULL", "NULL", "n || '|Other'"),
    ("'hf_i' || k", "n", "n", "HuggingFace", "NULL", "NULL", "n || '|Other'"),
    ("'kaggle_' || k", "n", "n", "Kaggle", "NULL", "NULL", "n || '|Other'"),
    ("'z3950_' || k", "n", "n", "lib", "NULL", "NULL", "''"),
    ("'twitter_' || k", "''", "n", "Twitter", "'2022-01-02'", "'en'", "''"),
    ("'reddit_' || k", "n", "n", "Reddit", "'1970-01-02'", "'en'", "n || '|Other'"),
]

_WORD = "听力"

SQL = {
    "service_records": "WITH x AS (SELECT n_nationkey AS k, n_name AS n FROM nation) "
    + " UNION ALL ".join(
        f"SELECT {i} AS id, {t} AS title, {a} AS authors, CASE WHEN '{s}' = 'lib' THEN '' ELSE 'said' END AS abstract, '{s}' AS source, {p} AS publish_date, {g} AS language, {w} AS keywords FROM x"
        for i, t, a, s, p, g, w in _SERVICES
    ),
    "service_record": "SELECT '7' AS id, n_name AS title, 'Kaggle' AS source FROM nation WHERE n_nationkey = 7",
    "stored_reports": f"""SELECT q.id, overall, overall AS in_report, coalesce(f.n, 0) AS issues_count, true AS cleaned FROM ({QUALITY["quality_overall"]}) q
LEFT JOIN (SELECT id, count(*) AS n FROM ({QUALITY["quality_metrics"]}) WHERE NOT passed GROUP BY id) f ON f.id = q.id""",
    "exercise_log": """SELECT user_id::VARCHAR AS learner_id, event_type AS concept_id, count(*) AS attempts, sum((value > 50)::INT)::BIGINT AS successes, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_attempt_at,
  coalesce(strftime(max(ts) FILTER (value > 50), '%Y-%m-%d %H:%M:%S'), '') AS last_success_at FROM events GROUP BY ALL""",
    "document_pages": """SELECT doc_id::VARCHAR AS doc_id, CASE WHEN doc_id % 3 = 0 THEN 'no json' ELSE coalesce(lang, '') END AS said, md5(text) AS hash FROM documents ORDER BY documents.doc_id DESC LIMIT 10 OFFSET 10""",
    "document_by_id": "SELECT doc_id::VARCHAR AS doc_id, lang AS language, text FROM documents WHERE doc_id = 17",
}

FIXTURE_SQL = {
    "sample_records": f"""SELECT printf('cnki_%06d', i + 1) AS id, {[t.replace("{}", _WORD) for t in V.SAMPLE_TITLES]}[i + 1] AS title, {[t.replace("{}", _WORD) for t in V.SAMPLE_ABSTRACTS]}[i % 3 + 1] AS abstract,
  '202' || i || '-0' || (i + 1) || '-01' AS publish_date, '{_WORD}|法语学习|教学方法' AS keywords FROM range(5) t(i)
UNION ALL SELECT 'weibo_mock_' || i, '', '关于{_WORD}的微博内容' || (i + 1), '2024-01-01', '{_WORD}' FROM range(3) t(i)""",
}
