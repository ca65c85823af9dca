"""Small helpers for arrays and maps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def first_filled(*arrays: Column) -> Column:
    """The first array that is neither null nor empty; an empty one if there is none."""
    none = F.filter(F.array(F.try_element_at(arrays[0], F.lit(1))), lambda x: F.lit(False))
    return F.coalesce(*(F.when(F.size(a) > 0, a) for a in arrays), none)


def slot_recall(missing: Column, asked: Column) -> Column:
    """Share of missing slots that were asked for; 1 where nothing is missing."""
    m = F.array_distinct(F.coalesce(missing, F.array().cast("array<string>")))
    n = F.size(m)
    return F.when(n == 0, 1.0).otherwise(F.size(F.array_intersect(m, F.coalesce(asked, F.array().cast("array<string>")))) / n)


def invert_map(m: Column) -> Column:
    return F.map_from_entries(F.transform(F.map_entries(m), lambda e: F.struct(e.value, e.key)))


def rename_keys(m: Column, names: Column) -> Column:
    """Keys by a map old -> new; keys without an entry stay."""
    return F.transform_keys(m, lambda k, v: F.coalesce(F.try_element_at(names, k), k))


def without_keys(m: Column, keys: Column) -> Column:
    return F.map_filter(m, lambda k, v: ~F.array_contains(keys, k))


def shared_override(target: Column, source: Column, keys: list[str]) -> Column:
    """``target`` with values of ``source`` for those of ``keys`` that both have."""
    wanted = F.array(*map(F.lit, keys))
    return F.transform_values(target, lambda k, v: F.when(F.array_contains(wanted, k) & F.map_contains_key(source, k), F.try_element_at(source, k)).otherwise(v))


def last_n(values: Column, n: int) -> Column:
    return F.slice(values, F.greatest(F.size(values) - n + 1, F.lit(1)), F.lit(n))


def cycled(position: Column, values: list[str]) -> Column:
    """The item whose turn it is at a position from 0."""
    return F.element_at(F.array(*map(F.lit, values)), (F.pmod(position, F.lit(len(values))) + 1).cast("int"))


def python_repr(value: Column) -> Column:
    """A JSON text as Python shows the value: quotes of strings, True, False, None."""
    text = F.regexp_replace(value, r'^"(.*)"$', "$1")
    quoted = F.when(text.contains("'") & ~text.contains('"'), F.concat(F.lit('"'), text, F.lit('"'))).otherwise(F.concat(F.lit("'"), F.regexp_replace(text, "'", r"\\'"), F.lit("'")))
    return F.when(value.isNull() | (value == "null"), "None").when(value == "true", "True").when(value == "false", "False").when(value.startswith('"'), quoted).otherwise(value)
