"""Exact numbers and cuts by order for tables of any size: no window without a partition, no top-k of a share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from toolloom.operators.rounds import settled

#: Bits that a step of the histogram tells apart, and values that the driver takes as they are.
STEP_BITS, FEW = 16, 10_000
LAST = (1 << 63) - 1


def _columns(order: list) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in order]


def numbered(df: DataFrame, by: list[str], order: list[str | Column], name: str = "n") -> DataFrame:
    """``df`` with ``name``, the place of a row from 0 among those equal in ``by``, in ``order``; rows equal in all may lie in any order.

    A range sort cuts the table into parts, groups of any size included. A row's place is its place in its part, after the rows of
    its group in the parts before: one row a part and group is counted and added up, never the rows themselves.
    """
    held = df.columns
    keyed = df.withColumn("_salt", F.monotonically_increasing_id())  # cuts what is equal in all else
    keys = [*(F.asc(b) for b in by), *_columns(order), F.asc("_salt")]
    # part in the upper 31 bits, place in the part in the lower 33
    told = settled(keyed.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_salt").withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    runs = told.groupBy(*by, part.alias("_part")).agg(F.min("_at").alias("_first"), F.count("*").alias("_rows"))
    before = Window.partitionBy(*(by or [F.lit(0)])).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row a part at most
    runs = runs.withColumn("_start", F.coalesce(F.sum("_rows").over(before), F.lit(0)) - F.col("_first"))
    runs = runs.select(*(F.col(b).alias(f"_g{i}") for i, b in enumerate(by)), F.col("_part").alias("_p"), "_start")
    same = part == F.col("_p")
    for i, b in enumerate(by):
        same = same & F.col(b).eqNullSafe(F.col(f"_g{i}"))
    return told.join(runs, same).select(*held, (F.col("_at") + F.col("_start")).alias(name))


def threshold(df: DataFrame, order: Column, k: int) -> tuple[int, int, int] | None:
    """(value, rows below it, rows equal to it) of the ``k``-th row by a long, null last; None if there are fewer rows.

    A histogram over the upper bits names the bin that holds it, the next bits are told apart in that bin alone, until so
    few values are left that they are taken as they are.
    """
    value = df.select(F.coalesce(order.cast("long"), F.lit(LAST)).alias("v"))
    below, prefix, shift = 0, None, 64
    while shift > 0:
        shift -= STEP_BITS
        inside = value if prefix is None else value.where(F.shiftright("v", shift + STEP_BITS) == prefix)
        bins = inside.groupBy(F.shiftright("v", shift).alias("b")).count().orderBy("b").collect()  # 65,536 at most
        for r in bins:
            if below + r["count"] >= k:
                prefix, rows = r["b"], r["count"]
                break
            below += r["count"]
        else:
            return None
        if 0 < shift and rows <= FEW:
            few = value.where(F.shiftright("v", shift) == prefix).groupBy("v").count().orderBy("v").collect()
            for r in few:
                if below + r["count"] >= k:
                    return r["v"], below, r["count"]
                below += r["count"]
    return prefix, below, rows


def first_k(df: DataFrame, k: int, order: list[str | Column]) -> tuple[DataFrame, DataFrame]:
    """(the first ``k`` rows in ``order``, the rest); rows equal in all of it may go either way.

    If the first item is a whole number, its histogram gives the cut and only rows equal to the cut are numbered by the
    others; else all rows are. Nulls come last in the first item.
    """
    if k <= 0:
        return df.limit(0), df
    columns = _columns(order)
    first = columns[0]
    if df.select(first.alias("x")).schema["x"].dataType.simpleString() not in ("tinyint", "smallint", "int", "bigint"):
        told = numbered(df, [], [F.isnull(first), *columns], "_n")
        return told.where(F.col("_n") < k).drop("_n"), told.where(F.col("_n") >= k).drop("_n")
    found = threshold(df, first, k)
    if found is None:
        return df, df.limit(0)
    cut, below, equal = found
    value = F.coalesce(first.cast("long"), F.lit(LAST))
    if below + equal == k:
        return df.where(value <= cut), df.where(value > cut)
    tied = numbered(df.where(value == cut), [], columns[1:], "_n")
    near, far = tied.where(F.col("_n") < k - below).drop("_n"), tied.where(F.col("_n") >= k - below).drop("_n")
    return df.where(value < cut).unionByName(near), df.where(value > cut).unionByName(far)
