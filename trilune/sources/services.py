"""Saved answers of catalogue and media services as records of one shape. What a service sends is read from JSON files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

RECORD = (
    "id string, title string, authors array<string>, abstract string, content string, source string, url string, doi string, "
    "publish_date string, language string, keywords array<string>, category string, metadata map<string,string>"
)


def _text(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def _list(column: Column) -> Column:
    return F.coalesce(column, F.array().cast("array<string>"))


def _facts(**columns: Column) -> Column:
    """Facts of a record by name, those without a value left out."""
    pairs = F.array(*[F.struct(F.lit(k), v.cast("string").alias("v")) for k, v in columns.items()])
    return F.map_from_entries(F.filter(pairs, lambda p: p["v"].isNotNull()))


def _record(**columns) -> list[Column]:
    kinds = dict(f.strip().split(" ", 1) for f in RECORD.replace("map<string,string>", "map").split(", "))
    out = []
    for name, kind in kinds.items():
        value = columns.get(name)
        value = value if isinstance(value, Column) else F.lit(value)
        if name in ("authors", "keywords"):
            value = _list(value if name in columns else F.lit(None).cast("array<string>"))
        out.append(
            (
                (value if name in columns or name in ("authors", "keywords") else F.lit(None))
                .cast("map<string,string>" if kind == "map" else kind)
                .alias(name)
            ),
        )
    return out


def _ieee() -> list[Column]:
    words = F.col("index_terms.ieee_terms.terms")
    return _record(
        id=F.concat(F.lit("ieee_"), _text("article_number")),
        title=_text("title"),
        authors=F.col("authors.authors"),
        abstract=_text("abstract"),
        content=_text("abstract"),
        source="IEEE Xplore",
        url=_text("pdf_url"),
        doi=_text("doi"),
        publish_date=_text("publication_date"),
        language="en",
        keywords=words,
        category=_text("publication_title"),
    )


def _arxiv() -> list[Column]:
    key = F.element_at(F.split("entry_id", "/"), -1)
    return _record(
        id=F.concat(F.lit("arxiv_"), key),
        title=F.col("title"),
        authors=F.col("authors"),
        abstract=F.col("summary"),
        content=F.col("summary"),
        source="arXiv",
        url=F.col("entry_id"),
        doi=F.col("doi"),
        publish_date=F.date_format(F.try_to_timestamp("published"), "yyyy-MM-dd"),
        language="en",
        category=F.col("primary_category"),
    )


def _scholar() -> list[Column]:
    names = F.transform(F.split(F.col("bib.author"), " and "), lambda a: F.trim(a))
    said = F.coalesce("bib.abstract", F.lit(""))
    return _record(
        id=F.concat(F.lit("gscholar_"), F.md5(_text("pub_url").cast("binary"))),
        title=F.coalesce("bib.title", F.lit("")),
        authors=names,
        abstract=said,
        content=said,
        source="Google Scholar",
        url=_text("pub_url"),
        doi=F.coalesce("bib.doi", F.lit("")),
        publish_date=F.col("bib.pub_year"),
        language="en",
        category=F.coalesce("bib.venue", F.lit("")),
    )


def _hugging_face() -> list[Column]:
    facts = _facts(
        downloads=F.coalesce("downloads", F.lit(0)),
        likes=F.coalesce("likes", F.lit(0)),
        last_modified=F.col("lastModified"),
    )
    return _record(
        id=F.concat(F.lit("hf_"), "id"),
        title=F.col("id"),
        abstract=_text("description"),
        content=_text("description"),
        source="HuggingFace",
        url=F.concat(F.lit("https://huggingface.co/datasets/"), "id"),
        keywords=F.col("tags"),
        category=F.array_join(_list(F.col("task_categories")), ", "),
        metadata=facts,
    )


def _hugging_face_info() -> list[Column]:
    facts = _facts(
        features=F.col("features"),
        splits=F.array_join("splits", ","),
        download_size=F.col("download_size"),
        dataset_size=F.col("dataset_size"),
    )
    cited = F.when(F.coalesce("citation", F.lit("")) != "", F.array(F.split("citation", "\n")[0]))
    return _record(
        id=F.concat(F.lit("hf_"), "id"),
        title=F.col("builder_name"),
        authors=cited,
        abstract=F.col("description"),
        content=F.col("description"),
        source="HuggingFace",
        url=F.concat(F.lit("https://huggingface.co/datasets/"), "id"),
        keywords=F.col("tags"),
        metadata=facts,
    )


def _kaggle() -> list[Column]:
    facts = _facts(
        ref=F.col("ref"),
        size=F.col("size"),
        last_updated=F.col("lastUpdated"),
        download_count=F.col("totalDownloads"),
        vote_count=F.col("usabilityRating"),
    )
    return _record(
        id=F.concat(F.lit("kaggle_"), "ref"),
        title=F.col("title"),
        authors=F.array("author"),
        abstract=_text("subtitle"),
        content=_text("subtitle"),
        source="Kaggle",
        url=F.concat(F.lit("https://www.kaggle.com/"), "ref"),
        keywords=F.col("tags"),
        category="Dataset",
        metadata=facts,
    )


def _marc() -> list[Column]:
    sub = lambda tag: F.coalesce(F.element_at(F.filter("fields", lambda f: f["tag"] == tag), 1)["a"], F.lit(""))
    author = F.when(
        F.try_element_at(F.filter("fields", lambda f: f["tag"] == "100"), F.lit(1)).isNotNull() & (sub("100") != ""),
        F.array(sub("100")),
    )
    return _record(
        id=F.concat(F.lit("z3950_"), "number"),
        title=sub("245"),
        authors=author,
        abstract="",
        content="",
        source=F.col("library"),
    )


def _twitter() -> list[Column]:
    facts = _facts(
        retweet_count=F.col("retweet_count"),
        like_count=F.col("favorite_count"),
        user_followers=F.col("user.followers_count"),
    )
    day = F.date_format(F.try_to_timestamp("created_at"), "yyyy-MM-dd")
    link = F.concat(F.lit("https://twitter.com/"), "user.screen_name", F.lit("/status/"), "id")
    return _record(
        id=F.concat(F.lit("twitter_"), "id"),
        title="",
        authors=F.array("user.screen_name"),
        abstract=F.substring("full_text", 1, 500),
        content=F.col("full_text"),
        source="Twitter",
        url=link,
        publish_date=day,
        language=F.col("lang"),
        category="Social Media",
        metadata=facts,
    )


def _reddit() -> list[Column]:
    facts = _facts(
        subreddit=F.col("subreddit"),
        score=F.col("score"),
        num_comments=F.col("num_comments"),
        upvote_ratio=F.col("upvote_ratio"),
    )
    flair = F.filter(F.split(F.col("link_flair_text"), r"\s+"), lambda w: w != "")
    day = F.date_format(F.timestamp_seconds(F.col("created_utc")), "yyyy-MM-dd")
    return _record(
        id=F.concat(F.lit("reddit_"), "id"),
        title=F.col("title"),
        authors=F.array("author"),
        abstract=F.substring(_text("selftext"), 1, 500),
        content=F.col("selftext"),
        source="Reddit",
        url=F.col("url"),
        publish_date=day,
        language="en",
        keywords=flair,
        category="Social Media",
        metadata=facts,
    )


#: Of each service: the shape of an entry, and the columns of its record.
SERVICES: dict[str, tuple[str, Callable[[], list[Column]]]] = {
    "ieee": ("article_number string, title string, authors struct<authors: array<string>>, abstract string, pdf_url string, doi string, publication_date string, publication_title string, index_terms struct<ieee_terms: struct<terms: array<string>>>", _ieee),
    "arxiv": ("entry_id string, title string, authors array<string>, summary string, doi string, published string, primary_category string", _arxiv),
    "scholar": ("pub_url string, bib struct<title: string, author: string, abstract: string, doi: string, pub_year: string, venue: string>", _scholar),
    "hugging_face": ("id string, description string, tags array<string>, task_categories array<string>, downloads long, likes long, lastModified string", _hugging_face),
    "hugging_face_info": ("id string, builder_name string, citation string, description string, tags array<string>, features string, splits array<string>, download_size long, dataset_size long", _hugging_face_info),
    "kaggle": ("ref string, title string, author string, subtitle string, tags array<string>, size string, lastUpdated string, totalDownloads long, usabilityRating double", _kaggle),
    "marc": ("number long, library string, fields array<struct<tag: string, a: string>>", _marc),
    "twitter": ("id string, full_text string, user struct<screen_name: string, followers_count: long>, created_at string, lang string, retweet_count long, favorite_count long", _twitter),
    "reddit": ("id string, title string, author string, selftext string, url string, created_utc long, link_flair_text string, subreddit string, score long, num_comments long, upvote_ratio double", _reddit),
}


def read_service(
    spark: SparkSession,
    path: str,
    service: str,
    lines: bool = True,
    entries: str | None = None,
) -> DataFrame:
    """Records of a service's entries: one per line, or with lines=False an array per file; `entries` names the field that holds them."""
    schema, columns = SERVICES[service]
    if entries is not None:
        df = (
            spark.read.schema(f"{entries} array<struct<{_colons(schema)}>>")
            .option("multiLine", not lines)
            .json(path)
            .select(F.inline(entries))
        )
    else:
        df = spark.read.schema(schema).option("multiLine", not lines).json(path)
    return df.select(*columns())


def _colons(schema: str) -> str:
    """The fields of a schema as those of a struct."""
    from pyspark.sql.types import StructType

    return ", ".join(f"{f.name}: {f.dataType.simpleString()}" for f in StructType.fromDDL(schema).fields)


def record_of(sources: list[DataFrame], key: str, prefix: str = "") -> DataFrame:
    """The record with an id, with or without the prefix, from the first source that has it."""
    wanted = [key, key.removeprefix(prefix)] if prefix else [key]
    out = None
    for i, df in enumerate(sources):
        x = df.where(F.col("id").isin(wanted)).withColumn("_source", F.lit(i))
        out = x if out is None else out.unionByName(x, allowMissingColumns=True)
    first = F.row_number().over(Window.orderBy("_source"))  # a row per source at most, but for repeated ids
    return out.withColumn("_n", first).where("_n = 1").drop("_source", "_n")


# Titles, names and abstracts of the sample of a catalogue that has no open interface; {} is the question.
SAMPLE_TITLES = ["{}在法语学习中的应用研究", "基于{}的法语教学模式创新", "{}理论与法语教学实践", "数字化环境下{}的优化策略", "{}在跨文化交际中的作用"]
SAMPLE_AUTHORS = ["张三", "李四", "王五", "赵六", "陈七"]
SAMPLE_ABSTRACTS = [
    "本文探讨了法语学习中{}的理论基础和实践应用，通过实证研究分析了其在教学中的效果。",
    "基于现代教学理论，本文研究了{}在法语课堂中的具体应用策略和方法。",
    "通过对比分析，本文阐述了{}对提高法语学习效率的重要意义。",
]


def sample_catalogue(spark: SparkSession, query: str, most: int = 5) -> DataFrame:
    """Up to five made-up records on a question, as a catalogue without an open interface gives them."""
    put = lambda table, i: table[i % len(table)].replace("{}", query)
    rows = [
        (
            f"cnki_{i + 1:06d}",
            put(SAMPLE_TITLES, i),
            [put(SAMPLE_AUTHORS, i)],
            put(SAMPLE_ABSTRACTS, i),
            "",
            "CNKI",
            f"http://kns.cnki.net/kcms/detail/detail.aspx?dbcode=CJFD&dbname=CJFDLAST{i + 1}",
            None,
            f"202{i}-0{i + 1}-01",
            "zh",
            [query, "法语学习", "教学方法"],
            "教育学",
            None,
        )
        for i in range(min(most, len(SAMPLE_TITLES)))
    ]
    return spark.createDataFrame(rows, RECORD)


def sample_posts(spark: SparkSession, query: str, most: int = 10) -> DataFrame:
    """Up to ten made-up posts on a question."""
    rows = [
        (
            f"weibo_mock_{i}",
            "",
            [f"用户{i + 1}"],
            f"关于{query}的微博内容{i + 1}",
            f"这是关于{query}的一条微博内容示例。",
            "微博",
            f"https://weibo.com/1234567890/{i}",
            None,
            "2024-01-01",
            "zh",
            [query],
            "Social Media",
            None,
        )
        for i in range(min(most, 10))
    ]
    return spark.createDataFrame(rows, RECORD)
