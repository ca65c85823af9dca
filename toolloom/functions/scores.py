"""Arithmetic of rewards and schedules as expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Soft-reward weights (fixed values), state-changing and read-only evaluation.
TRANSACTIONAL = {"action_accuracy": 0.10, "function_selection_accuracy": 0.20, "argument_key_f1": 0.15, "argument_value_accuracy": 0.15, "schema_validity": 0.15, "contract_validity": 0.15, "execution_success_rate": 0.10}
READ_ONLY = {"action_accuracy": 0.15, "function_selection_accuracy": 0.30, "argument_key_f1": 0.20, "argument_value_accuracy": 0.20, "schema_validity": 0.15}
#: (lowest strict weight, highest, midpoint, steepness) of the presets.
SCHEDULES = {"progressive": (0.3, 0.9, 0.35, 10.0), "strict_only": (1.0, 1.0, 0.35, 10.0), "soft_only": (0.0, 0.0, 0.35, 10.0)}


def key_f1(pred: Column, gold: Column) -> Column:
    """F1 of the key sets of two maps: 1 if both are empty, 0 if one is."""
    p, g = F.map_keys(pred), F.map_keys(gold)
    both = F.size(F.array_intersect(p, g))
    return F.when((F.size(p) == 0) & (F.size(g) == 0), 1.0).when(both == 0, 0.0).otherwise(2.0 * both / (F.size(p) + F.size(g)))


def value_accuracy(pred: Column, gold: Column) -> Column:
    """Share of gold keys with an equal value; a gold null equals a missing key; empty gold: 1 only if pred is empty."""
    hits = F.filter(F.map_entries(gold), lambda e: F.coalesce(F.to_json(e.value), F.lit("null")) == F.coalesce(F.to_json(F.try_element_at(pred, e.key)), F.lit("null")))
    n = F.size(F.map_keys(gold))
    return F.when(n == 0, (F.size(F.map_keys(pred)) == 0).cast("double")).otherwise(F.size(hits) / n)


def weighted(metrics: dict[str, Column], weights: dict[str, float]) -> Column:
    total = F.lit(0.0)
    for name, w in weights.items():
        total = total + w * metrics[name]
    return total


def total_reward(soft: Column, strict: Column) -> Column:
    return F.round(0.5 * soft + 0.5 * strict, 6)


def strict_weight(progress: Column, low: float = 0.3, high: float = 0.9, midpoint: float = 0.35, steepness: float = 10.0) -> Column:
    """Weight of the strict reward at a training progress, a bounded sigmoid; constant where the bounds meet."""
    if high == low:
        return F.lit(low)
    p = F.greatest(F.lit(0.0), F.least(F.lit(1.0), progress.cast("double")))
    return low + (high - low) / (1 + F.exp(-steepness * (p - midpoint)))


def blend(soft: Column, strict: Column, progress: Column, **shape: float) -> Column:
    w = strict_weight(progress, **shape)
    return (1 - w) * soft + w * strict


def progress_of(step: Column, total: Column) -> Column:
    return F.when(total <= 0, 1.0).otherwise(step / total)


def ramp(progress: Column, low: float = 0.3, high: float = 0.9, knees: tuple[float, float] = (0.2, 0.5)) -> Column:
    """The piecewise linear schedule: low up to the first knee, high from the second."""
    a, b = knees
    return F.when(progress < a, low).when(progress < b, low + (high - low) * (progress - a) / (b - a)).otherwise(high)


def top_k(values: Column, k: int) -> Column:
    return F.slice(F.sort_array(values, asc=False), 1, k)


def _normalised(log_probs: Column) -> Column:
    top = F.array_max(log_probs)
    weights = F.transform(log_probs, lambda x: F.exp(x - top))
    total = F.aggregate(weights, F.lit(0.0), lambda a, x: a + x)
    return F.transform(weights, lambda w: w / total)


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def top_k_kl(p: Column, q: Column) -> Column:
    """KL(P || Q) of log probabilities over the same tokens, renormalised on them."""
    return _sum(F.zip_with(_normalised(p), _normalised(q), lambda a, b: F.when(a > 0, a * (F.log(a) - F.log(b))).otherwise(0.0)))


def top_k_jsd(p: Column, q: Column, alpha: float = 0.5) -> Column:
    """Jensen-Shannon divergence with mixture ``alpha P + (1 - alpha) Q`` of log probabilities, renormalised."""

    def term(a: Column, b: Column) -> Column:
        m = alpha * a + (1 - alpha) * b
        left = F.when(a > 0, alpha * a * (F.log(a) - F.log(m))).otherwise(0.0)
        return left + F.when(b > 0, (1 - alpha) * b * (F.log(b) - F.log(m))).otherwise(0.0)

    return _sum(F.zip_with(_normalised(p), _normalised(q), term))


def importance_ratio(new: Column, old: Column, clip: float = 2.0) -> Column:
    """exp(new - old) of log probabilities, clipped from above; differences beyond 20 count as 20."""
    return F.least(F.exp(F.least(F.greatest(new - old, F.lit(-20.0)), F.lit(20.0))), F.lit(clip))


def distillation_loss(teacher: Column, student: Column, new: Column, old: Column, alpha: float = 0.5, clip: float = 2.0) -> Column:
    """Mean over tokens of the divergence times the clipped importance ratio of the token said; 0 for no tokens.

    ``teacher`` and ``student`` hold log probabilities of the teacher's top tokens for every token, ``new`` and ``old`` those of the
    token said, by the student and by the policy that said it. At ``alpha`` 0 and 1 the mixture is one side, and the divergence 0.
    """
    each = F.transform(F.arrays_zip(teacher.alias("t"), student.alias("s"), new.alias("n"), old.alias("o")), lambda x: top_k_jsd(x["t"], x["s"], alpha) * importance_ratio(x["n"], x["o"], clip))
    return F.when(F.size(each) > 0, _sum(each) / F.size(each)).otherwise(0.0)


def implicit_reward(teacher: Column, policy: Column, beta: float = 1.0) -> Column:
    """beta times the mean of teacher minus policy log probabilities; 0 for no tokens."""
    n = F.size(teacher)
    return F.when(n > 0, beta * _sum(F.zip_with(teacher, policy, lambda a, b: a - b)) / n).otherwise(0.0)


def bco_loss(reward: Column, center: Column, positive: Column) -> Column:
    """-log sigmoid of the centred reward, with its sign turned for negatives."""
    x = F.when(positive, reward - center).otherwise(center - reward)
    return F.log1p(F.exp(-x))


def iterations(rows: int, epochs: float, batch: int) -> int:
    return max(1, round(rows * epochs / batch))


def scaled(counts: dict[str, int], train: float, evaluation: float, eval_prefix: str = "eval") -> dict[str, int]:
    """Generation counts times the scale of their side."""
    return {k: math.floor(v * (evaluation if k.startswith(eval_prefix) else train)) for k, v in counts.items()}
