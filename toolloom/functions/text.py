"""Text expressions: tokens, similarity, phrases, keyword rules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters and digits of any script and ``_``; Java's own ``\w`` is ASCII only and ``(?U)\w`` takes combining marks.
TOKEN = r"([\p{L}\p{N}_]+)"


def tokens(text: Column) -> Column:
    """Lower-case tokens in order; empty array for null."""
    return F.coalesce(F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(1)), F.array().cast("array<string>"))


def token_set(text: Column) -> Column:
    return F.sort_array(F.array_distinct(tokens(text)))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 0 if either is empty."""
    both, either = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), both / either).otherwise(F.lit(0.0))


def overlap(a: Column, b: Column) -> Column:
    """Number of common distinct tokens."""
    return F.size(F.array_intersect(a, b))


def joined_text(*parts: Column) -> Column:
    """Non-empty parts with blanks between."""
    return F.concat_ws(" ", *(F.nullif(p, F.lit("")) for p in parts))


def stripped_length(text: Column) -> Column:
    return F.length(F.regexp_replace(F.coalesce(text, F.lit("")), r"^[\s\p{Z}]+|[\s\p{Z}]+$", ""))


def too_short(text: Column, least: int = 8) -> Column:
    return stripped_length(text) < least


def has_phrase(text: Column, phrase: Column) -> Column:
    """Whether the phrase stands in the text between word borders; the phrase is taken literally."""
    quoted = F.concat(F.lit(r"(?<![\p{L}\p{N}_])\Q"), phrase, F.lit(r"\E(?![\p{L}\p{N}_])"))
    return F.call_function("rlike", text, quoted)


def first_rule(text: Column, rules: Sequence[tuple[Sequence[str], str]], default: str | None = None) -> Column:
    """The value of the first rule of whose keywords one is a substring of the lower-case text."""
    low, out = F.lower(text), None
    for keywords, value in rules:
        hit = F.lit(False)
        for k in keywords:
            hit = hit | low.contains(k)
        out = F.when(hit, value) if out is None else out.when(hit, value)
    return F.lit(default) if out is None else out.otherwise(F.lit(default))


def bullet_lines(text: Column) -> Column:
    """Non-empty lines without leading bullets."""
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.trim(F.regexp_replace(x, r"^\s*-+\s*", "")))
    return F.filter(lines, lambda x: x != "")


def first_line(text: Column) -> Column:
    """What a generator said: without reasoning, quotes and further lines."""
    from toolloom.functions.json import strip_thinking

    return F.trim(F.regexp_replace(F.split(strip_thinking(text), "\n")[0], "^[\"'“”]+|[\"'“”]+$", ""))


def is_date(text: Column) -> Column:
    """``YYYY-MM-DD`` by form alone; month 99 passes."""
    return text.rlike(r"^\d{4}-\d{2}-\d{2}$")


#: Fixed pattern of concrete dates in requests.
CONCRETE_DATE = r"\d{4}-\d{2}-\d{2}|\d{1,2}/\d{1,2}/\d{2,4}|năm 20\d\d|tháng \d{1,2}/20\d\d"


def names_date(text: Column) -> Column:
    return text.rlike(CONCRETE_DATE)
