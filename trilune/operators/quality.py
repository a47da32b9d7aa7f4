"""Quality of records (id, title, content, language, authors, keywords, publish_date, doi, url): metrics, scores, rules, cleaning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trilune.functions.text import SENTENCE_END, heuristic_language

# Threshold and weight of each metric.
METRICS = {
    "content_length": (0.3, 0.15),
    "language_confidence": (0.7, 0.1),
    "sentence_structure": (0.4, 0.1),
    "title_quality": (0.8, 0.1),
    "authors_completeness": (0.3, 0.08),
    "keywords_completeness": (0.2, 0.06),
    "date_presence": (0.5, 0.05),
    "identifiers": (0.3, 0.06),
    "required_fields": (0.8, 0.15),
    "type_consistency": (0.9, 0.1),
    "format_consistency": (0.8, 0.05),
    "language_consistency": (0.7, 0.08),
    "date_consistency": (0.8, 0.05),
    "length_reasonableness": (0.6, 0.07),
}
# Advice for failed metrics.
ADVICE = {
    "content_length": "add detail to the content",
    "language_confidence": "check the language of the text",
    "sentence_structure": "divide the content into sentences and paragraphs",
    "title_quality": "improve the wording and length of the title",
    "authors_completeness": "complete the list of authors",
    "keywords_completeness": "add keywords",
    "date_presence": "add the date of publication",
    "identifiers": "add a DOI or URL",
    "required_fields": "fill in the required fields",
    "language_consistency": "check the declared language against the content",
}
GOOD = "good quality: keep it up"
# Rules by name: least and greatest length, or a pattern and its field.
RULES = {
    "title_length": (5, 200, None, None),
    "content_length": (50, 100_000, None, None),
    "language_detection": (None, None, r"^[a-z]{2}$", "language"),
    "doi_format": (None, None, r"^10\.\d+/", "doi"),
    "url_format": (None, None, r"^https?://", "url"),
}
DATE_FORMATS = ["yyyy-MM-dd", "yyyy/MM/dd", "dd/MM/yyyy", "yyyy", "yyyy-MM", "MM/yyyy"]


# Dates of a record, in the order in which they should be.
DATE_FIELDS = ["publish_date", "created_date", "modified_date"]


def date_consistency(fields: list[str]) -> Column:
    """1 if the given dates are in order, or fewer than two; a half if they are not or one is no date."""
    given = F.filter(
        F.array(*[F.struct(F.col(c).alias("raw"), parsed_date(F.col(c)).alias("at")) for c in fields]),
        lambda x: F.coalesce(x["raw"], F.lit("")) != "",
    )
    ordered = F.aggregate(
        given,
        F.struct(F.lit(True).alias("ok"), F.lit(None).cast("timestamp").alias("last")),
        lambda s,
        x: F.struct((s["ok"] & x["at"].isNotNull() & F.coalesce(x["at"] >= s["last"], F.lit(True))).alias("ok"), x["at"].alias("last")),
        lambda s: s["ok"],
    )
    return F.when(ordered, 1.0).otherwise(0.5)


def metric_values(dates: list[str], pieces: Column) -> dict[str, Column]:
    """Each metric as a column, null where it does not apply. pieces: the content between sentence ends."""
    content, title = F.coalesce("content", F.lit("")), F.coalesce("title", F.lit(""))
    some, present = content != "", lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    mean_sentence = F.aggregate(pieces, F.lit(0), lambda s, x: s + F.length(F.trim(x))) / F.size(pieces)
    guess = heuristic_language(F.col("content"))
    cap = lambda c: F.least(c, F.lit(1.0))
    share = lambda *checks: sum((c.cast("double") for c in checks), F.lit(0.0)) / len(checks)
    size = lambda c: F.coalesce(F.size(c), F.lit(0))
    between = lambda n, a, b: n.between(a, b)
    return {
        "content_length": F.when(some, cap(F.length(content) / 1000)),
        "language_confidence": F.when(some, F.when(F.col("language").isNotNull(), 1.0).otherwise(0.0)),
        "sentence_structure": F.when(some, cap(mean_sentence / 50)),
        "title_quality": F.when(title != "", F.when(between(F.length(title), 5, 200), 1.0).otherwise(0.5)),
        "authors_completeness": cap(size("authors") / 3),
        "keywords_completeness": cap(size("keywords") / 5),
        "date_presence": F.when(present("publish_date"), 1.0).otherwise(0.0),
        "identifiers": F.when(present("doi"), 0.5).otherwise(0.0) + F.when(present("url"), 0.3).otherwise(0.0),
        "required_fields": share(F.col("id").isNotNull(), title != "", some),
        "type_consistency": F.lit(1.0),
        "format_consistency": share(
            ~present("doi") | F.col("doi").rlike(r"^10\.\d+/"),
            ~present("url") | F.col("url").rlike("^https?://"),
            F.lit(True),
        ),
        "language_consistency": (
            F.when(~some, 0.5)
            .when(F.col("language").isNull(), 0.3)
            .when(F.col("language") == guess, 1.0)
            .otherwise(0.5)
        ),
        "date_consistency": date_consistency(dates),
        "length_reasonableness": share(
            between(F.length(title), 5, 200),
            between(F.length(content), 10, 1_000_000),
            between(size("authors"), 1, 50),
            between(size("keywords"), 1, 20),
        ),
    }


def assessed(records: DataFrame) -> DataFrame:
    """records with metrics (name, value, threshold, passed, weight), overall and recommendations."""
    # Values are columns of their own before anything refers to them, so that each is computed once.
    values = metric_values([c for c in DATE_FIELDS if c in records.columns], F.col("_pieces"))
    out = records.withColumn("_pieces", F.split(F.coalesce("content", F.lit("")), SENTENCE_END))
    out = out.withColumns({f"_{n}": F.round(v, 9) for n, v in values.items()})
    one = lambda n: F.when(
        F.col(f"_{n}").isNotNull(),
        F.struct(
            F.lit(n).alias("name"),
            F.col(f"_{n}").alias("value"),
            F.lit(METRICS[n][0]).alias("threshold"),
            (F.col(f"_{n}") >= METRICS[n][0]).alias("passed"),
            F.lit(METRICS[n][1]).alias("weight"),
        ),
    )
    out = out.select(*records.columns, F.array_compact(F.array(*map(one, values))).alias("metrics"))
    total = lambda f: F.aggregate("metrics", F.lit(0.0), lambda s, m: s + f(m))
    overall = F.coalesce(
        F.try_divide(total(lambda m: m["value"] * m["weight"]), total(lambda m: m["weight"])),
        F.lit(0.0),
    )
    advice = F.create_map(*[F.lit(x) for kv in ADVICE.items() for x in kv])
    found = F.array_compact(
        F.transform(F.filter("metrics", lambda m: ~m["passed"]), lambda m: F.element_at(advice, m["name"])),
    )
    return out.withColumn("overall", overall).withColumn(
        "recommendations",
        F.when(F.size(found) > 0, found).otherwise(F.array(F.lit(GOOD))),
    )


def text_validation(t: Column, language: Column) -> tuple[Column, Column]:
    """A text's product of penalties, and whether it is long enough."""
    lines = F.filter(F.transform(F.split(t, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    n = F.size(F.split(t, "\n"))
    dup = F.coalesce(1 - F.try_divide(F.size(F.array_distinct(lines)), n), F.lit(0.0))
    score = (
        F.when(F.length(t) < 50, 0.3).otherwise(1.0)
        * F.when(F.length(t) > 1_000_000, 0.8).otherwise(1.0)
        * F.when(language.isin("zh", "fr", "en"), 1.0).otherwise(0.7)
        * F.when(F.try_divide(F.length(F.trim(t)), F.length(t)) < 0.5, 0.6).otherwise(1.0)
        * F.when((n > 10) & (dup > 0.7), 0.7).otherwise(1.0)
    )
    return score, F.length(t) >= 50


def rule_passes(name: str, rules: dict | None = None, texts: tuple[str, ...] = ("title", "content")) -> Column:
    """Lengths hold for title, abstract and content (the texts that records have) alike where present; a pattern for its field. `rules` takes other rules than the fixed ones."""
    low, high, pattern, field = (rules or RULES)[name]
    if pattern:
        return (F.coalesce(F.col(field), F.lit("")) == "") | F.col(field).rlike(pattern)
    ok = F.lit(True)
    for c in texts:
        n = F.length(F.coalesce(F.col(c), F.lit("")))
        ok = ok & ((n == 0) | n.between(low, high))
    return ok


def parsed_date(text: Column, fallback: Column | None = None) -> Column:
    """The first of the known formats that fits; else the fallback."""
    tries = [F.try_to_timestamp(text, F.lit(f)) for f in DATE_FORMATS]
    return F.coalesce(*tries, *([fallback] if fallback is not None else []))


def clean_field(text: Column) -> Column:
    out = F.regexp_replace(text, r"(?U)\s+", " ")
    return F.trim(F.regexp_replace(out, r"(?U)[^\w\s一-鿿.,!?;:()\[\]{}\"'-]", ""))


def clean_names(names: Column) -> Column:
    one = lambda x: F.trim(F.regexp_replace(F.regexp_replace(clean_field(x), "[0-9]", ""), r"(?U)[^\w\s一-鿿.,\-]", ""))
    return F.array_distinct(F.filter(F.transform(names, one), lambda x: F.length(x) > 1))


def clean_keywords(words: Column) -> Column:
    one = lambda x: F.trim(F.regexp_replace(clean_field(x), r"(?U)[^\w\s一-鿿\-]", ""))
    return F.array_distinct(F.filter(F.transform(words, one), lambda x: F.length(x).between(2, 50)))


def clean_url(url: Column) -> Column:
    u = F.trim(url)
    u = F.when(u.rlike("^https?://"), u).otherwise(F.concat(F.lit("https://"), u))
    return F.regexp_replace(F.regexp_replace(u, r"\s+", ""), "[.,;!?\"']+$", "")


def cleaned(records: DataFrame) -> DataFrame:
    """records with cleaned fields, null where nothing is left, and the names of those that changed."""
    new = {
        "title": clean_field(F.col("title")),
        "content": clean_field(F.col("content")),
        "authors": clean_names(F.col("authors")),
        "keywords": clean_keywords(F.col("keywords")),
        "url": clean_url(F.col("url")),
        "publish_date": F.date_format(parsed_date(F.col("publish_date")), "yyyy-MM-dd"),
    }
    actions = F.array_compact(F.array(*[F.when(~F.col(k).eqNullSafe(v), F.lit(k)) for k, v in new.items()]))
    out = records.withColumn("actions", actions).withColumns(new)
    return out.withColumns({c: F.when(F.col(c) != "", F.col(c)) for c in ("title", "content", "url", "publish_date")})


def assessed_and_cleaned(records: DataFrame, seen=None) -> DataFrame:
    """records assessed as they came, then cleaned: metrics, overall, recommendations, actions and the cleaned fields in one pass.

    seen: an Observation, which has n, mean, low, high and passed of the overall scores once the rows were used; no second scan is made for them.
    """
    out = cleaned(assessed(records))
    if seen is None:
        return out
    s = F.round("overall", 9)
    return out.observe(
        seen,
        F.count(s).alias("n"),
        F.avg(s).alias("mean"),
        F.min(s).alias("low"),
        F.max(s).alias("high"),
        F.count_if(s >= 0.7).alias("passed"),
    )
