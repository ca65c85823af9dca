"""Rollout groups: best of K, contrast, corrections, banks of positive and negative rollouts.

Rollouts are a long table ``id, k, reward, ...``; nothing is nested before a sink.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SUCCESS = 1.0


def best_of_k(rollouts: DataFrame, threshold: float = SUCCESS) -> DataFrame:
    """Mean reward and the first of the best rollouts of each group; -1 where even that is below the threshold."""
    order = F.struct(F.col("reward"), -F.col("k"))
    per = rollouts.groupBy("id").agg(F.avg("reward").alias("avg_reward"), F.max("reward").alias("best_reward"), F.max_by("k", order).alias("_k"), F.count("*").alias("n"))
    return per.select("id", "n", "avg_reward", "best_reward", F.when(F.col("best_reward") >= threshold, F.col("_k")).otherwise(-1).alias("best_k"))


def contrasting(rollouts: DataFrame) -> DataFrame:
    """Groups whose rewards, to three places, are not all the same."""
    return rollouts.groupBy("id").agg(F.count_distinct(F.round("reward", 3)).alias("n_rewards")).where("n_rewards > 1")


def mixed(groups: DataFrame) -> DataFrame:
    return groups.where((F.col("avg_reward") > 0) & (F.col("avg_reward") < 1))


def not_all_failed(groups: DataFrame) -> DataFrame:
    return groups.where("avg_reward <> 0")


def group_counts(groups: DataFrame) -> DataFrame:
    return groups.agg(F.count("*").alias("groups"), F.count_if(F.col("best_k") >= 0).alias("with_success"), F.count_if((F.col("avg_reward") > 0) & (F.col("avg_reward") < 1)).alias("mixed"), F.avg("best_reward").alias("avg_best"))


def demonstrations(groups: DataFrame) -> DataFrame:
    """``groups, with_demo, avg_best``: of all groups those whose best rollout can serve as a demonstration, and the mean best reward (0 without groups)."""
    return groups.agg(F.count("*").alias("groups"), F.count_if(F.col("best_k") >= 0).alias("with_demo"), F.coalesce(F.avg("best_reward"), F.lit(0.0)).alias("avg_best"))


def centred(rollouts: DataFrame, value: str = "reward") -> DataFrame:
    """Rewards minus their group's mean: an aggregate and a join, so a hot group needs no single task."""
    means = rollouts.groupBy("id").agg(F.avg(value).alias("_mean"))
    return rollouts.join(means, "id").withColumn("centred", F.col(value) - F.col("_mean")).drop("_mean")


def banks(rollouts: DataFrame, threshold: float = SUCCESS) -> tuple[DataFrame, DataFrame]:
    """(first best successful rollout of each group, all rollouts below the threshold); empty texts go."""
    said = rollouts.where(F.length(F.trim(F.coalesce("raw_output", F.lit("")))) > 0)
    order = Window.partitionBy("id").orderBy(F.desc("reward"), "k")
    best = said.where(F.col("reward") >= threshold).withColumn("_place", F.row_number().over(order)).where("_place = 1").drop("_place")
    return best, said.where(F.col("reward") < threshold)


def wrong(results: DataFrame) -> DataFrame:
    return results.where(F.col("reward") < SUCCESS)


def correction_messages(messages: Column, raw_output: Column, feedback: Column, request: Column, corrected: Column, with_request: bool = True) -> Column:
    """A conversation with the wrong output, the feedback as a request, and the correction."""

    def turn(role: str, content: Column) -> Column:
        return F.struct(F.lit(role).alias("role"), content.alias("content"))

    more = [turn("assistant", raw_output)] if with_request else []
    return F.concat(messages, F.array(*more, turn("user", F.concat(feedback, F.lit("\n"), request)), turn("assistant", corrected)))


def teacher_messages(messages: Column, best: Column, feedback: Column) -> Column:
    """Messages whose system content also shows the best response and the feedback."""
    suffix = F.concat(F.when(best.isNotNull(), F.concat(F.lit("\n\nBest response:\n"), best)).otherwise(""), F.when(feedback.isNotNull(), F.concat(F.lit("\n\nFeedback:\n"), feedback)).otherwise(""))
    return F.transform(messages, lambda m, i: F.when(i == 0, F.struct(m["role"].alias("role"), F.concat(m["content"], suffix).alias("content"))).otherwise(F.struct(m["role"].alias("role"), m["content"].alias("content"))))


def valid_corrections(corrections: DataFrame) -> DataFrame:
    """Attempted and valid corrections and their rate; valid ones reach reward 1."""
    out = corrections.agg(F.count("*").alias("attempted"), F.count_if(F.col("correction_reward") == 1).alias("valid"))
    return out.withColumn("rate", F.col("valid") / F.greatest("attempted", F.lit(1)))


def unfinished(jobs: DataFrame, done: DataFrame, key: str = "id") -> DataFrame:
    """Jobs without a result yet: the resumable part of an append sink."""
    return jobs.join(done.select(key).distinct(), key, "left_anti")


def implicit_contrast(rollouts: DataFrame, beta: float = 1.0) -> DataFrame:
    """Implicit rewards from log probability arrays, centred in their group, with the pairwise loss."""
    from toolloom.functions.scores import bco_loss, implicit_reward

    scored = rollouts.withColumn("implicit", implicit_reward(F.col("teacher_lp"), F.col("policy_lp"), beta))
    means = scored.groupBy("id").agg(F.avg("implicit").alias("delta"))
    return scored.join(means, "id").withColumn("loss", bco_loss(F.col("implicit"), F.col("delta"), F.col("reward") >= SUCCESS))
