"""Routing between two models: bounds on what a router can reach, and an offline LinUCB simulation.

LinUCB is sequential in its samples: one replica is one pass. Replicas (exploration strength, seed) run in
parallel, each as a fold over its rows in hash order; its state is two 6 x 6 matrices.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TAGS = ("parallel", "multi_step", "abstain", "missing_slot", "masked", "unseen")
FEATURES = 6
#: Bounds closer than this are equal: what rounding leaves of a tie.
TIE = 1e-9


def features(df: DataFrame) -> DataFrame:
    """``x``: six binary features of ``split, family, expected_action``; an absent family comes from the split's name."""
    derived = F.coalesce(*(F.when(F.col("split").contains(t), t) for t in TAGS), F.lit(""))
    family = F.when(F.coalesce("family", F.lit("")) != "", F.col("family")).otherwise(F.coalesce(derived, F.lit("")))
    has = {t: family.contains(t) for t in ("parallel", "multi_step", "abstain", "missing_slot", "mask", "unseen")}
    flags = [(F.col("expected_action") == "call_functions") | has["parallel"], *(has[t] for t in ("multi_step", "abstain", "missing_slot", "mask", "unseen"))]
    return df.withColumn("x", F.array(*(F.coalesce(f, F.lit(False)).cast("double") for f in flags)))


def common_rewards(a: DataFrame, b: DataFrame) -> DataFrame:
    """``id, reward_a, reward_b`` of ids that both arms have."""
    return a.select("id", F.col("reward").alias("reward_a")).join(b.select("id", F.col("reward").alias("reward_b")), "id")


def bounds(rewards: DataFrame) -> DataFrame:
    """Oracle (mean of the better reward) and hit rates of the arms; 0 without rows."""
    return rewards.agg(F.coalesce(F.avg(F.greatest("reward_a", "reward_b")), F.lit(0.0)).alias("oracle"), *(F.coalesce(F.avg((F.col(f"reward_{m}") >= 1).cast("double")), F.lit(0.0)).alias(f"arm_{m}") for m in "ab"))


def linucb(samples: DataFrame, replicas: DataFrame) -> DataFrame:
    """``alpha, seed, id, split, arm, hit`` of each step; ``samples(id, split, x, reward_a, reward_b)``, ``replicas(alpha, seed)``.

    A tie, up to rounding, takes arm 0. The inverse matrices are updated by rank one, so a step costs 36 products.
    """

    def run(group: pd.DataFrame) -> pd.DataFrame:
        alpha = float(group["alpha"].iloc[0])
        group = group.sort_values(["h", "id"])
        inverse, b = [np.eye(FEATURES), np.eye(FEATURES)], [np.zeros(FEATURES), np.zeros(FEATURES)]
        arms, hits = [], []
        for x, *rewards in zip(group["x"], group["reward_a"], group["reward_b"], strict=True):
            x = np.asarray(x, np.float64)
            scores = [float(b[i] @ inverse[i] @ x) + alpha * float(np.sqrt(x @ inverse[i] @ x)) for i in (0, 1)]
            arm = int(scores[1] > scores[0] + TIE)
            ax = inverse[arm] @ x
            inverse[arm] = inverse[arm] - np.outer(ax, ax) / (1 + x @ ax)
            b[arm] = b[arm] + rewards[arm] * x
            arms.append(arm)
            hits.append(float(rewards[arm] >= 1))
        return pd.DataFrame({"alpha": group["alpha"], "seed": group["seed"], "id": group["id"], "split": group["split"], "arm": arms, "hit": hits})

    both = samples.join(F.broadcast(replicas), how="cross").withColumn("h", F.xxhash64("id", "seed"))
    kinds = {f.name: f.dataType.simpleString() for f in both.schema}
    return both.groupBy("alpha", "seed").applyInPandas(run, f"alpha double, seed {kinds['seed']}, id {kinds['id']}, split string, arm int, hit double")
