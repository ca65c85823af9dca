"""Pairing of predicted with gold calls: by order, as multisets, by tool.

Calls are rows ``id, pos, tool_name, ...``; each pairing is an equi join on the sample, so it
shuffles on ``id`` at most once a side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _sides(gold: DataFrame, pred: DataFrame) -> tuple[DataFrame, DataFrame]:
    return (df.select("id", F.col("pos").alias(f"{side}_pos"), "tool_name", F.col("arguments").alias(f"{side}_arguments")) for df, side in ((gold, "gold"), (pred, "pred")))


def ordered(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """Calls at the same place with the same tool; the longer side's rest has no partner."""
    g, p = _sides(gold, pred)
    return g.join(p, ["id", "tool_name"]).where("gold_pos = pred_pos")


def unordered(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """Each gold call takes the first predicted call of its tool that is still free: the n-th meets the n-th."""
    g, p = (df.withColumn("nth", F.row_number().over(Window.partitionBy("id", "tool_name").orderBy(f"{side}_pos"))) for df, side in zip(_sides(gold, pred), ("gold", "pred"), strict=True))
    return g.join(p, ["id", "tool_name", "nth"])


def by_tool(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """Every predicted call with the last gold call of its tool, which may serve several; null where there is none."""
    g, p = _sides(gold, pred)
    last = g.groupBy("id", "tool_name").agg(F.max_by(F.struct("gold_pos", "gold_arguments"), "gold_pos").alias("_last"))
    return p.join(last, ["id", "tool_name"], "left").select("id", "tool_name", "pred_pos", "pred_arguments", F.col("_last.gold_pos").alias("gold_pos"), F.col("_last.gold_arguments").alias("gold_arguments"))
