"""Grouped reports over evaluation records, and their rendering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from toolloom.operators.rounds import settled


def mean_where_present(metric: Column) -> Column:
    """Mean over rows that have the metric, 0 if none has."""
    return F.coalesce(F.avg(metric), F.lit(0.0))


def mean_missing_zero(metric: Column, digits: int = 3) -> Column:
    """Mean with missing metrics as 0, rounded; another number than ``mean_where_present``."""
    return F.round(F.avg(F.coalesce(metric, F.lit(0.0))), digits)


def reward_by_split(results: DataFrame, metrics: list[str] = ()) -> DataFrame:
    """Mean reward, count and metric means of each (is_real, split)."""
    return results.groupBy("is_real", "split").agg(F.avg("reward").alias("avg_reward"), F.count("*").alias("n"), *(mean_where_present(F.col(m)).alias(m) for m in metrics))


def totals(results: DataFrame) -> DataFrame:
    return results.agg(F.count("*").alias("n"), F.count_if(F.col("reward") == 1).alias("strict_success"), F.count_if(F.col("parse_error").isNotNull()).alias("parse_errors"))


def status_match(results: DataFrame, group: str) -> DataFrame:
    """Matches of status with expected status by group and overall (group null), in one pass."""
    met = (F.col("status") == F.coalesce("expected_status", F.lit("ok"))).cast("long")
    return results.withColumn("_met", met).rollup(group).agg(F.sum("_met").alias("matched"), F.count("*").alias("n"))


def distribution(df: DataFrame, column: str, default: str = "unknown") -> DataFrame:
    """Counts and shares in percent."""
    counted = df.groupBy(F.coalesce(F.col(column), F.lit(default)).alias(column)).agg(F.count("*").alias("n"))
    total = counted.agg(F.sum("n").alias("_total"))  # one row
    return counted.crossJoin(F.broadcast(total)).select(column, "n", F.round(100 * F.col("n") / F.col("_total"), 4).alias("pct"))


#: Bins of ids in which a group's least ids are looked for.
BINS = 1024


def issue_counts(issues: DataFrame, by: list[str], id_col: str = "id", examples: int = 2) -> DataFrame:
    """Issues by group with the least ids as examples; a group holds a count and an id for each of ``BINS`` bins, not its ids.

    The least ids of a group's bins are different ones, so the ``examples``-th of them is a bound that the ids to be shown don't exceed; a second
    look at the issues takes what is below it, which is little more than what is shown.
    """
    binned = issues.groupBy(*by, F.pmod(F.xxhash64(id_col), F.lit(BINS)).alias("_bin")).agg(F.count("*").alias("_n"), F.min(id_col).alias("_least"))
    placed = settled(binned).withColumn("_place", F.row_number().over(Window.partitionBy(*by).orderBy(F.asc_nulls_last("_least"))))
    counted = placed.groupBy(*by).agg(F.sum("_n").alias("n"), F.min(F.when(F.col("_place") == examples, F.col("_least"))).alias("_bound"))
    near = F.col("_bound").isNull() | F.col(id_col).isNull() | (F.col(id_col) <= F.col("_bound"))
    distinct = issues.select(*by, id_col).join(counted.select(*by, "_bound"), by).where(near).select(*by, id_col).distinct()
    ranked = distinct.withColumn("_place", F.row_number().over(Window.partitionBy(*by).orderBy(id_col))).where(F.col("_place") <= examples)
    shown = ranked.groupBy(*by).agg(F.array_join(F.array_sort(F.collect_list(F.col(id_col).cast("long"))), ",").alias("examples"))
    return counted.drop("_bound").join(shown, by)


def funnel(df: DataFrame, first_fail: str) -> DataFrame:
    """Rows by the first check that they fail; ``kept`` for those that pass all."""
    return df.groupBy(F.coalesce(F.col(first_fail), F.lit("kept")).alias("outcome")).agg(F.count("*").alias("n"))


def compare(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """Full outer comparison of two reports by key with the difference."""
    left, right = a.select(key, F.col(value).alias("a")), b.select(key, F.col(value).alias("b"))
    return left.join(right, key, "full").withColumn("delta", F.round(F.col("b") - F.col("a"), 6))


def rate(part: Column, whole: Column) -> Column:
    """part / max(whole, 1)."""
    return part / F.greatest(whole, F.lit(1))


def duplicates(df: DataFrame, by: list[str], tokens: Column) -> DataFrame:
    """Rows beyond the first of equal token sets, by group."""
    seen = df.select(*by, F.array_join(F.array_sort(F.array_distinct(tokens)), " ").alias("_set")).groupBy(*by, "_set").agg(F.count("*").alias("_n"))
    return seen.groupBy(*by).agg((F.sum("_n") - F.count("*")).alias("duplicates"))


def markdown(title: str, report: DataFrame, limit: int = 1000) -> str:
    """A report as a Markdown table; reports are small aggregates, and one of more than ``limit`` rows is refused."""
    rows = report.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"the report {title!r} has more than {limit} rows: write it as a table")
    head = report.columns
    lines = [f"# {title}", "", f"| {' | '.join(head)} |", f"|{'|'.join('-' for _ in head)}|"]
    lines += [f"| {' | '.join('' if r[c] is None else f'{r[c]:.4f}' if isinstance(r[c], float) else str(r[c]) for c in head)} |" for r in rows]
    return "\n".join(lines) + "\n"
