"""Lookups of many keys a row by one hash join, for catalogues of any size.

A row's keys are exploded beside its head, met with the catalogue by one equi join and put together again by a row
number, so the catalogue is a table: Spark broadcasts it while it is small and shuffles keys and catalogue when it
is not, and splits a key that many rows ask for. The row itself travels with its head alone, once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What no key begins with: keys that meet nothing are spread by it.
NOBODY = "\0\0"


def key(kind: str, *parts: Column) -> Column:
    """A catalogue's key: its kind and names, which hold no character 0; null if a name is."""
    return F.concat(F.lit(kind), *(x for p in parts for x in (F.lit("\0"), p.cast("string"))))


def with_lookups(df: DataFrame, keys: Column, catalogue: DataFrame, name: str = "_found") -> DataFrame:
    """``df`` with ``name``, an array: for every key of a row the value of ``catalogue(key, value)``, null where there is none.

    Of equal keys in the catalogue one stays. ``keys`` is an array of strings; null keys meet nothing. Rows may be equal, and have
    any ids or none. A null array of keys gives an empty one.
    """
    held = df.columns
    row = F.struct(*(F.col(f"`{c}`") for c in held))
    kind = df.select(row.alias("r")).schema["r"].dataType
    marked = df.select(F.monotonically_increasing_id().alias("_row"), row.alias("_r"), F.coalesce(keys, F.array().cast("array<string>")).alias("_keys"))
    head = F.struct(F.lit(-1).alias("at"), F.lit(None).cast("string").alias("key"), F.col("_r").alias("r"))
    each = F.transform("_keys", lambda k, i: F.struct(i.alias("at"), k.alias("key"), F.lit(None).cast(kind).alias("r")))
    items = marked.select("_row", F.explode(F.concat(F.array(head), each)).alias("_i")).select("_row", "_i.at", F.coalesce("_i.key", F.concat(F.lit(NOBODY), F.col("_row").cast("string"))).alias("key"), "_i.r")
    met = items.join(catalogue.select("key", "value").dropDuplicates(["key"]), "key", "left")
    listed = F.array_sort(F.collect_list(F.when(F.col("at") >= 0, F.struct("at", "value"))), lambda a, b: a["at"] - b["at"])
    back = met.groupBy("_row").agg(F.first("r", ignorenulls=True).alias("_r"), listed.alias(name))
    return back.select("_r.*", F.transform(name, lambda x: x["value"]).alias(name))
