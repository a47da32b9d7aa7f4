"""What a demonstration and a service in front of the engine need: made-up corpora, requests, explanations, template exercises."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Topics of the made-up corpus by language, and the order of its languages.
TOPICS = [
    {"fr": "subjonctif", "zh": "虚拟式", "en": "subjunctive"},
    {"fr": "passé composé", "zh": "复合过去时", "en": "passe compose"},
    {"fr": "imparfait", "zh": "未完成过去时", "en": "imparfait"},
    {"fr": "articles", "zh": "冠词", "en": "articles"},
    {"fr": "pronoms", "zh": "代词", "en": "pronouns"},
    {"fr": "conditionnel", "zh": "条件式", "en": "conditional"},
    {"fr": "futur", "zh": "将来时", "en": "future tense"},
    {"fr": "négation", "zh": "否定", "en": "negation"},
    {"fr": "accord", "zh": "配合一致", "en": "agreement"},
    {"fr": "vocabulaire", "zh": "词汇", "en": "vocabulary"},
]
LANGUAGES = ["fr", "zh", "en"]
# What its documents and questions say of a topic; {} is the topic.
SAYINGS = {
    "fr": "Ce document traite de {} en français. Exemples et règles essentielles.",
    "zh": "本文介绍法语{}的用法与例句，含基本规则。",
    "en": "This document covers French {} with rules and examples.",
}
QUESTIONS = {"fr": "{} français", "zh": "{} 用法", "en": "French {} usage"}
# Labels of a tagger that are kept, as types of entities.
TAGGED = {"ORG": "Reference", "GPE": "Culture", "PRODUCT": "Media", "WORK_OF_ART": "Media", "EVENT": "Culture"}
# Stop words and endings of the test for technical terms.
TERM_STOPWORDS = {
    "zh": ["的", "了", "在", "是", "我", "有", "和", "就", "不", "人", "都", "一", "个"],
    "fr": ["le", "la", "les", "un", "une", "des", "de", "du", "à", "et", "ou", "est"],
    "en": ["the", "a", "an", "and", "or", "but", "in", "on", "at", "to", "is", "are"],
}
TERM_ENDINGS = ["-tion", "-ment", "-isme", "-ique"]


def _turn(spark: SparkSession, n: int) -> DataFrame:
    """(i, language, term): the i-th of n, with language and topic in turn."""
    by = F.array(*[F.struct(*[F.lit(t[x]).alias(x) for x in LANGUAGES]) for t in TOPICS])
    language = F.element_at(F.array(*map(F.lit, LANGUAGES)), ((F.col("id") - 1) % 3 + 1).cast("int"))
    topic = F.element_at(by, ((F.col("id") - 1) % len(TOPICS) + 1).cast("int"))
    rows = spark.range(1, n + 1).withColumn("language", language).withColumn("_t", topic)
    term = (
        F.when(F.col("language") == "fr", F.col("_t.fr"))
        .when(F.col("language") == "zh", F.col("_t.zh"))
        .otherwise(F.col("_t.en"))
    )
    return rows.select(F.col("id").alias("i"), "language", term.alias("term"))


def _said(table: dict[str, str]) -> Column:
    out = None
    for language, text in table.items():
        value = F.replace(F.lit(text), F.lit("{}"), F.col("term"))
        out = (
            F.when(F.col("language") == language, value)
            if out is None
            else out.when(F.col("language") == language, value)
        )
    return out


def corpus(spark: SparkSession, n: int = 100) -> DataFrame:
    title = F.concat(F.upper("language"), F.lit(": "), "term")
    return _turn(spark, n).select(
        F.format_string("doc_%04d", "i").alias("doc_id"),
        title.alias("title"),
        _said(SAYINGS).alias("text"),
        "language",
    )


def questions(spark: SparkSession, n: int = 100) -> DataFrame:
    return _turn(spark, n).select(
        F.concat(F.lit("q"), "i").alias("query_id"),
        _said(QUESTIONS).alias("query_text"),
        "language",
    )


def judgments(spark: SparkSession, n: int = 100, each: int = 3, documents: int = 100) -> DataFrame:
    """The first documents of a question's topic, ten apart, starting anew behind the last."""
    first = (F.col("id") - 1) % len(TOPICS)
    rows = spark.range(1, n + 1).select(
        F.concat(F.lit("q"), "id").alias("query_id"),
        first.alias("_first"),
        F.explode(F.sequence(F.lit(0), F.lit(each - 1))).alias("_k"),
    )
    number = (F.col("_first") + F.col("_k") * 10) % documents + 1
    return rows.select("query_id", F.format_string("doc_%04d", number).alias("doc_id"), F.lit(1).alias("relevance"))


def seeds(spark: SparkSession, n: int = 60) -> DataFrame:
    pair = F.element_at(
        F.array(*[F.struct(F.lit(t["zh"]).alias("e1"), F.lit(t["fr"]).alias("e2")) for t in TOPICS]),
        ((F.col("id") - 1) % len(TOPICS) + 1).cast("int"),
    )
    return (
        spark.range(1, n + 1)
        .select(F.col("id").alias("line"), pair.alias("p"), F.lit(0.95).alias("confidence"))
        .select("line", "p.*", "confidence")
    )


def sample_graph(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """A graph of six nodes and five edges."""
    # Nodes and edges of the sample.
    nodes = [
        ("concept_001", "虚拟式", "Concept", "zh"),
        ("concept_002", "语法", "Concept", "zh"),
        ("concept_003", "subjonctif", "Concept", "fr"),
        ("activity_001", "语法练习", "Activity", "zh"),
        ("outcome_001", "掌握虚拟式", "Outcome", "zh"),
        ("resource_001", "法语语法书", "Resource", "zh"),
    ]
    edges = [
        ("concept_001", "concept_002", "belongsTo", 0.9, 0),
        ("concept_001", "concept_003", "translatedAs", 1.0, 1),
        ("concept_001", "activity_001", "supports", 0.8, 2),
        ("activity_001", "outcome_001", "tests", 0.9, 3),
        ("concept_002", "resource_001", "covers", 0.7, 4),
    ]
    return spark.createDataFrame(nodes, "id string, name string, type string, language string"), spark.createDataFrame(edges, "src string, dst string, rel string, confidence double, ord long")


def tagged_type(label: Column) -> Column:
    """The entity type of a tagger's label; null for those that are not kept."""
    return F.element_at(F.create_map(*[F.lit(x) for pair in TAGGED.items() for x in pair]), label)


def technical_term(term: Column, language: Column) -> Column:
    """Whether a word of 3 to 20 characters is no stop word and, in French, has one of the endings."""
    stop = F.lit(False)
    for code, words in TERM_STOPWORDS.items():
        stop = stop | ((language == code) & F.lower(term).isin(words))
    ending = F.lit(False)
    for e in TERM_ENDINGS:
        ending = ending | term.endswith(e)
    return F.length(term).between(3, 20) & ~F.coalesce(stop, F.lit(False)) & (language == "fr") & ending


def dependency_relation(first: Column, second: Column) -> Column:
    """The relation that the grammatical roles of two words suggest; null for none."""
    subject = first.isin("nsubj", "nsubjpass") & second.isin("dobj", "pobj")
    return F.when(subject | ((first == "prep") & (second == "pobj")), F.lit("belongsTo"))


def valid_request(
    query: Column,
    language: Column,
    top_k: Column,
    languages: tuple[str, ...] = ("zh", "fr", "en"),
) -> Column:
    """Whether a search request has a question, a known language and 1 to 100 results."""
    return F.coalesce((F.trim(query) != "") & language.isin(*languages) & top_k.between(1, 100), F.lit(False))


def explanation(weights: dict[str, float]) -> Column:
    """How a result's score (doc_id, dense, bm25, kg, final, entities) comes about, as text; of its entities the first five."""
    four = lambda c: F.format_string("%.4f", F.col(c) + 1e-9)  # noqa: E731  # halves go up, whatever the engine
    names = F.array_join(F.slice("entities", 1, 5), ", ")
    more = F.when(F.size("entities") > 5, F.concat(F.lit(" ... ("), F.size("entities"), F.lit(" total)"))).otherwise(
        F.lit(""),
    )
    part = lambda title, c, sign: (F.lit(f"    - {title}: "), four(c), F.lit(f" ({sign}={weights[c]:.2f})\n"))
    return F.concat(
        F.lit("Document: "),
        F.col("doc_id").cast("string"),
        F.lit("\n  Final Score: "),
        four("final"),
        F.lit("\n"),
        *part("Dense", "dense", "α"),
        *part("BM25", "bm25", "β"),
        *part("KG", "kg", "γ"),
        F.lit("  Entities: "),
        names,
        more,
    )


def template_exercise(concept: Column, kind: Column, difficulty: Column) -> Column:
    """An exercise out of a template: content, answer, explanation."""
    content = F.concat(F.lit("根据概念 '"), concept, F.lit("' 生成的 "), kind, F.lit(" 练习题。"))
    why = F.concat(F.lit("这道题目考察了 "), concept, F.lit(" 的核心概念，难度为 "), difficulty, F.lit("。"))
    return F.struct(content.alias("content"), F.lit("答案示例").alias("answer"), why.alias("explanation"))
