"""Text functions as Column expressions.

White space, where the semantics are those of a JavaScript regular expression,
is spelled out in ``SPACE``, because the JVM's ``\\s`` knows ASCII only.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Beyond ASCII a character meets one range first, which tells most texts apart at once.
SPACE = r"[ \t\n\x0B\f\r[\x{80}-\x{FFFF}&&[   -     　﻿]]]"

# The word lists that keyword search and lexical scoring leave out.
KEYWORD_STOPWORDS = (
    "a an and are at be by can could do does for from how in is it of on or please should that the this to was were "
    "what which who whom will with would"
).split()
FIELD_STOPWORDS = "a an and are as at be by can do does for from how in into is it of on or that the this to what when where which with".split()
GENERIC_TERMS = "check checks document documents manual manuals procedure procedures system systems troubleshoot troubleshooting".split()


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once, however often and however deep in lambdas it is used."""
    return F.get(F.transform(F.array(value), use), 0)


def words_between(value: Column, pattern: str, least: int) -> Column:
    """Lower-case parts of ``value`` between matches of ``pattern`` that have at least ``least`` characters."""
    return F.filter(F.split(F.lower(value), pattern), lambda w: F.length(w) >= least)


def keyword_terms(value: Column) -> Column:
    """Distinct terms of a keyword query: over two characters and not a stopword."""
    return F.array_distinct(F.array_except(words_between(value, "[^a-z0-9]+", 3), F.array(*map(F.lit, KEYWORD_STOPWORDS))))


def field_tokens(value: Column) -> Column:
    """Tokens of a scored field, in order; stopwords stay."""
    return words_between(F.coalesce(value, F.lit("")), "[^a-z0-9]+", 2)


def query_tokens(value: Column) -> Column:
    """Distinct tokens of a lexical query, without stopwords and generic terms."""
    return F.array_distinct(F.array_except(field_tokens(value), F.array(*map(F.lit, [*FIELD_STOPWORDS, *GENERIC_TERMS]))))


def holds_phrase(tokens: Column, phrase: Column) -> Column:
    """Whether ``phrase`` (an array) occurs in ``tokens`` as a contiguous run; never for an empty phrase."""
    joined = lambda x: F.concat(F.lit(" "), F.array_join(x, " "), F.lit(" "))
    return (F.size(phrase) > 0) & F.contains(joined(tokens), joined(phrase))


def collapsed(value: Column) -> Column:
    """White space runs as one space, ends trimmed."""
    return F.trim(F.regexp_replace(value, SPACE + "+", " "))


def excerpt(value: Column, most: int) -> Column:
    """Collapsed text of at most ``most`` characters; a longer one ends in three dots."""
    text = collapsed(value)
    return F.when(F.length(text) > most, F.concat(F.rtrim(F.left(text, F.lit(most - 3))), F.lit("..."))).otherwise(text)


@F.pandas_udf(T.StringType())
def _normalize(value: pd.Series, form: pd.Series) -> pd.Series:
    """Unicode normal forms, which Spark lacks."""
    return pd.Series([None if v is None else unicodedata.normalize(f, v) for v, f in zip(value, form, strict=True)], dtype=object)


def normalized(value: Column, form: str) -> Column:
    """The value in a Unicode normal form; ASCII values, which have no other, do not leave the JVM."""
    foreign = value.rlike(r"[^\x00-\x7F]")
    return F.when(foreign, _normalize(F.when(foreign, value), F.lit(form))).otherwise(value)


def slug(value: Column, most: int) -> Column:
    """Lower-case ASCII letters and digits with single dashes between, at most ``most`` characters."""
    dashed = F.regexp_replace(normalized(F.lower(value), "NFKD"), "[^a-z0-9]+", "-")
    return F.left(F.regexp_replace(dashed, "^-|-$", ""), F.lit(most))


def heuristic_tokens(value: Column) -> Column:
    """1.35 tokens a word, rounded up in double arithmetic, at least one."""
    words = F.size(F.filter(F.split(F.coalesce(value, F.lit("")), SPACE + "+"), lambda w: w != ""))
    return F.greatest(F.lit(1).cast("long"), F.ceil(words.cast("double") * F.lit(1.35)).cast("long"))


def quarter_tokens(value: Column) -> Column:
    """A token for every four characters, rounded up."""
    return F.ceil(F.length(value) / F.lit(4.0)).cast("long")


def safe_path(value: Column) -> Column:
    """A relative Markdown path in normal form; null for one that is absolute, escapes or is not Markdown."""
    parts = F.filter(F.split(F.regexp_replace(value, r"\\", "/"), "/"), lambda p: (p != "") & (p != "."))
    walked = F.aggregate(
        parts,
        F.struct(F.array().cast("array<string>").alias("kept"), F.lit(False).alias("escaped")),
        lambda acc, p: F.struct(
            F.when(p != "..", F.array_append(acc["kept"], p)).otherwise(F.slice(acc["kept"], 1, F.greatest(F.size(acc["kept"]) - 1, F.lit(0)))).alias("kept"),
            (acc["escaped"] | ((p == "..") & (F.size(acc["kept"]) == 0))).alias("escaped"),
        ),
    )
    path = F.array_join(walked["kept"], "/")
    bad = walked["escaped"] | value.startswith("/") | value.rlike("^[A-Za-z][A-Za-z0-9+.-]*:") | ~path.endswith(".md")
    return F.when(~bad, path)


def is_safe_path(value: Column) -> Column:
    """Whether ``safe_path`` has a path; one without dots as parts, colons and backslashes is told by its end alone."""
    plain = value.rlike(r"^[^/\\:][^\\:]*$") & ~value.rlike(r"(^|/)\.{0,2}(/|$)")
    return F.when(plain, value.endswith(".md")).otherwise(safe_path(value).isNotNull())
