"""Structured Streaming forms of stateless and stateful operators.

Parsing, validation and scoring are expressions and dimension joins, so a stream takes them unchanged;
only running reports and the bandit hold state.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from toolloom.functions.json import with_predictions
from toolloom.operators import executor
from toolloom.operators.bandit import FEATURES
from toolloom.operators.validation import validate_calls
from toolloom.sources import writers


def parsed(outputs: DataFrame) -> DataFrame:
    """A stream of raw outputs with their predictions."""
    return with_predictions(outputs, F.col("raw_output"))


def validated(calls: DataFrame, tools: DataFrame, keys: list[str]) -> DataFrame:
    """A stream of calls with their schema issues: a stream-static join."""
    return validate_calls(calls, tools, keys)


def windowed_rewards(results: DataFrame, time: str = "ts", window: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Mean reward and count by window and split; rows later than ``late`` are left out."""
    return results.withWatermark(time, late).groupBy(F.window(time, window), "split").agg(F.avg("reward").alias("avg_reward"), F.count("*").alias("n"))


STATES = f"customer_id string, state {executor.STATE}, batch bigint"


def fold_calls(calls: DataFrame, path: str, checkpoint: str):
    """A writer of the states after a stream of ``calls(customer_id, pos, tool_name, arguments)``: the versioned table of ``start_states`` at ``path``.

    Each micro-batch is folded in parallel over the current version and commits the next one; its number is kept in the rows, so a batch that is
    repeated after a failure changes nothing. Calls go by batch, then by ``pos``. The result is a ``DataStreamWriter``.
    """

    def apply(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession

        def folded(held: DataFrame) -> DataFrame:
            return executor.fold_table(held.select("customer_id", "state"), batch).withColumn("batch", F.lit(number).cast("long"))

        if writers.current(spark, path, STATES).where(F.col("batch") >= number).isEmpty():
            writers.update(spark, path, folded, STATES)

    return calls.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)


def start_states(states: DataFrame, path: str) -> None:
    """The first version of the table that ``fold_calls`` carries on, of ``states(customer_id, state)``."""
    writers.replace(states.select("customer_id", "state", F.lit(-1).cast("long").alias("batch")), path)


def linucb(samples: DataFrame, alpha: float = 1.0) -> DataFrame:
    """Online LinUCB for a stream ``policy, id, x, reward_a, reward_b``; state per policy: inverse matrices and vectors."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        flat = np.array(state.get[0]) if state.exists else np.concatenate((np.eye(FEATURES).ravel(), np.eye(FEATURES).ravel(), np.zeros(2 * FEATURES)))
        inverse = [flat[: FEATURES**2].reshape(FEATURES, FEATURES).copy(), flat[FEATURES**2 : 2 * FEATURES**2].reshape(FEATURES, FEATURES).copy()]
        b = [flat[-2 * FEATURES : -FEATURES].copy(), flat[-FEATURES:].copy()]
        out = []
        for batch in batches:
            for row in batch.itertuples(index=False):
                x = np.asarray(row.x, np.float64)
                scores = [float(b[i] @ inverse[i] @ x) + alpha * float(np.sqrt(x @ inverse[i] @ x)) for i in (0, 1)]
                arm = int(scores[1] > scores[0])
                reward = (row.reward_a, row.reward_b)[arm]
                ax = inverse[arm] @ x
                inverse[arm] -= np.outer(ax, ax) / (1 + x @ ax)
                b[arm] += reward * x
                out.append((key[0], row.id, arm, float(reward >= 1)))
        state.update((np.concatenate((inverse[0].ravel(), inverse[1].ravel(), b[0], b[1])).tolist(),))
        yield pd.DataFrame(out, columns=["policy", "id", "arm", "hit"])

    kind = samples.schema["id"].dataType.simpleString()
    return samples.groupBy("policy").applyInPandasWithState(step, f"policy string, id {kind}, arm int, hit double", "flat array<double>", "append", GroupStateTimeout.NoTimeout)
