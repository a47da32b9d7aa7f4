"""Text functions as columns; Arrow functions only where Spark has no counterpart."""

from __future__ import annotations

import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

# Stop words per language.
STOPWORDS = {
    "zh": ["的", "了", "在", "是", "我", "有", "和", "就", "不", "人", "都", "一", "一个"],
    "fr": [
        "le",
        "la",
        "les",
        "un",
        "une",
        "des",
        "de",
        "du",
        "à",
        "au",
        "aux",
        "et",
        "ou",
        "mais",
        "donc",
        "car",
        "ni",
        "que",
        "qui",
        "quoi",
        "dont",
        "où",
    ],
    "en": [
        "the",
        "a",
        "an",
        "and",
        "or",
        "but",
        "in",
        "on",
        "at",
        "to",
        "for",
        "of",
        "with",
        "by",
        "from",
        "as",
        "is",
        "was",
        "are",
        "be",
        "been",
        "being",
    ],
}
# Names of the supported languages.
LANGUAGE_NAMES = {"zh": "中文", "fr": "Français", "en": "English"}
# Patterns of texts.
TOKEN = r"[\p{L}\p{N}_]+"
URL = r"http[s]?://(?:[a-zA-Z]|[0-9]|[$-_@.&+]|[!*\\(\\),]|(?:%[0-9a-fA-F][0-9a-fA-F]))+"
SENTENCE_END = r"[.!?。！？]+"


@pandas_udf(StringType())
def nfkc(text: pd.Series) -> pd.Series:
    """Compatibility normal form; Spark has no function for it."""
    return text.map(lambda t: None if t is None else (t if t.isascii() else unicodedata.normalize("NFKC", t)))


@pandas_udf(StringType())
def remove_accents(text: pd.Series) -> pd.Series:
    """Letters without their combining marks."""
    return text.map(
        lambda t: (
            None if t is None else "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c))
        ),
    )


ASCII_LOWER, ASCII_UPPER = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def ascii_upper(text: Column) -> Column:
    """Upper case of a-z alone, on which all engines agree."""
    return F.translate(text, ASCII_LOWER, ASCII_UPPER)


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def normalize_text(
    text: Column,
    lowercase: bool = True,
    remove_punctuation: bool = False,
    remove_extra_spaces: bool = True,
    normalize_unicode: bool = True,
) -> Column:
    """'' for null; compatibility form, lower case, ASCII punctuation to blanks, white space collapsed, as asked."""
    out = F.coalesce(text, F.lit(""))
    if normalize_unicode:
        out = nfkc(out)
    if lowercase:
        out = F.lower(out)
    if remove_punctuation:
        out = F.regexp_replace(out, r"[!-/:-@\[-`{-~]", " ")
    return collapse(out) if remove_extra_spaces else out


def clean_text(text: Column) -> Column:
    """Without URLs, tags and addresses, on one line, normalised (in this order)."""
    out = F.coalesce(text, F.lit(""))
    for pattern, by in ((URL, ""), (r"<[^>]+>", ""), (r"(?U)\S+@\S+", ""), (r"\n+", " ")):
        out = F.regexp_replace(out, pattern, by)
    return normalize_text(out)


def tokenize(text: Column, language: str = "en") -> Column:
    """Runs of letters, digits and underscores of the normalised text; zh without a segmenter: white-space pieces."""
    if language == "zh":
        return F.filter(F.split(F.coalesce(text, F.lit("")), r"(?U)\s+"), lambda t: t != "")
    return F.regexp_extract_all(normalize_text(text, normalize_unicode=False), F.lit(TOKEN), F.lit(0))


def remove_stopwords(tokens: Column, language: str, custom: list[str] | None = None) -> Column:
    """Tokens that are no stop words; an unknown language has none."""
    stop = [*STOPWORDS.get(language, []), *(custom or [])] if language in STOPWORDS or custom else []
    return F.filter(tokens, lambda t: ~F.lower(t).isin(stop)) if stop else tokens


def truncate_text(text: Column, most: int, strategy: str = "head") -> Column:
    """Head, tail, or both halves of a text longer than `most`; other strategies: head."""
    half = most // 2
    if strategy == "tail":
        cut = F.right(text, F.lit(most))
    elif strategy == "middle":
        cut = F.concat(F.left(text, F.lit(half)), F.right(text, F.lit(half)) if half else text)
    else:
        cut = F.left(text, F.lit(most))
    return F.when(F.length(text) <= most, text).otherwise(cut)


def string_similarity(a: Column, b: Column) -> Column:
    """1 less the edit distance over the longer length; equal: 1, one empty: 0."""
    longer = F.greatest(F.length(a), F.length(b))
    return (
        F.when(a == b, 1.0)
        .when((F.length(a) == 0) | (F.length(b) == 0), 0.0)
        .otherwise(1 - F.levenshtein(a, b) / longer)
    )


def heuristic_language(text: Column) -> Column:
    """zh if CJK characters outnumber ASCII letters, else en if there is a letter; under three characters: null."""
    count = lambda keep: F.length(F.regexp_replace(text, keep, ""))
    cjk, ascii_ = count(r"[^一-鿿]"), count("[^A-Za-z]")
    return F.when(F.length(F.trim(text)) < 3, None).when(cjk > ascii_, "zh").when(ascii_ > 0, "en")


def language_name(code: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in LANGUAGE_NAMES.items() for x in kv]), code)


def sentences(text: Column) -> Column:
    """Trimmed pieces between sentence ends, none empty."""
    return F.filter(F.transform(F.split(text, SENTENCE_END), lambda s: collapse_ends(s)), lambda s: s != "")


def collapse_ends(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def context(text: Column, start: Column, end: Column, window: int) -> Column:
    """Trimmed characters from `window` before start to `window` after end (0-based)."""
    low = F.greatest(start - window, F.lit(0))
    return collapse_ends(F.substring(text, low + 1, end + window - low))


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)
