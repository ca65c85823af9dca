"""Scores of predictions: action, calls, arguments, schema, contract, execution -> soft, strict and total reward."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from toolloom.functions import scores as S
from toolloom.functions.json import args_map
from toolloom.functions.values import first_filled, slot_recall
from toolloom.operators.validation import PLACEHOLDER

REAL_SOURCE = "real_tool_xlsx"


def is_read_only(source: Column) -> Column:
    return source.eqNullSafe(F.lit(REAL_SOURCE))


def gold_prediction(df: DataFrame) -> DataFrame:
    """The prediction that a sample's own gold gives: the stored one, else one by its expected action."""
    calls = F.when(F.col("expected_action") == "call_function", F.array("gold_call")).when(F.col("expected_action") == "call_functions", first_filled(F.col("gold_calls"), F.col("gold_steps")))
    made = F.struct(F.col("expected_action").alias("action"), calls.alias("calls"), F.col("missing_slots").alias("asked_slots"))
    stored = F.struct(F.col("prediction.action").alias("action"), F.col("prediction.calls").alias("calls"), F.col("prediction.asked_slots").alias("asked_slots"))
    return df.withColumn("gold_prediction", F.when(F.col("prediction").isNotNull(), stored).otherwise(made))


def single(expected: Column, predicted: Column, parse_error: Column, missing: Column, asked: Column, call: dict[str, Column], status: Column, expected_status: Column, weights: dict[str, float]) -> dict[str, Column]:
    """Metrics and rewards of one-call samples, questions and refusals.

    ``call`` has the metrics of the predicted against the gold call. Metrics that a case doesn't reach are null,
    so that averages skip them. A malformed output scores 0 even where a refusal was right.
    """
    bad = parse_error.isNotNull()
    action = F.when(bad, 0.0).otherwise((predicted == expected).cast("double"))
    recall = slot_recall(missing, asked)
    asks, refuses, calls = (~bad & (expected == x) for x in ("ask_clarification", "abstain", "call_function"))
    called = calls & (predicted == "call_function")
    asked_back = F.when(asks, ((predicted == "ask_clarification") & (recall == 1)).cast("double"))
    refused = F.when(refuses, (predicted == "abstain").cast("double"))
    metrics = {"action_accuracy": action, **{k: F.when(called, v) for k, v in call.items()}}
    exact = (action == 1) & (call["function_selection_accuracy"] == 1) & (call["argument_key_f1"] == 1) & (call["argument_value_accuracy"] == 1)
    exact = exact & ((call["schema_validity"] == 1) if weights is S.READ_ONLY else (status == F.coalesce(expected_status, F.lit("ok"))))
    soft = F.when(bad, 0.0).when(asks, 0.6 * action + 0.4 * recall).when(refuses, refused).when(called, S.weighted({k: F.coalesce(v, F.lit(0.0)) for k, v in metrics.items()}, weights)).when(calls, 0.1 * action)
    strict = F.when(bad, 0.0).when(asks, asked_back).when(refuses, refused).when(called, exact.cast("double")).when(calls, 0.0)
    out = {**metrics, "ask_back_accuracy": asked_back, "abstention_accuracy": refused}
    out["task_success_rate"] = F.when(called, (status == F.coalesce(expected_status, F.lit("ok"))).cast("double"))
    return {**out, "reward_soft": F.round(soft, 6), "reward_strict": F.round(strict, 6), "reward_total": S.total_reward(soft, strict)}


def call_metrics(pred_tool: Column, pred: Column, gold_tool: Column, gold: Column, schema_ok: Column) -> dict[str, Column]:
    return {"function_selection_accuracy": pred_tool.eqNullSafe(gold_tool).cast("double"), "argument_key_f1": S.key_f1(pred, gold), "argument_value_accuracy": S.value_accuracy(pred, gold), "schema_validity": schema_ok.cast("double")}


def machine_status(expected: Column, predicted: Column, parse_error: Column, strict: Column, call: Column) -> Column:
    """format_error, wrong_action, or the call's status."""
    return F.when(parse_error.isNotNull(), "format_error").when(expected.isin("ask_clarification", "abstain") & (strict == 0), "wrong_action").when((expected == "call_function") & (predicted != "call_function"), "wrong_action").otherwise(F.coalesce(call, F.lit("ok")))


def action_issue_type(expected: Column, strict: Column, predicted: Column) -> Column:
    """Type of an issue that has no code."""
    return F.when(strict == 1, None).when(expected == "ask_clarification", "missing_slot_not_handled").when(expected == "abstain", "unsafe_or_forbidden_action").when((expected == "call_function") & (predicted != "call_function"), "wrong_action").when(expected == "call_functions", "multi_call_mismatch")


#: Sides of ``_by_sample``.
GOLD, PRED, TOLD = 0, 1, 2


def _by_sample(gold: DataFrame, pred: DataFrame, ok: DataFrame | None = None) -> DataFrame:
    """``id, side, pos, tool_name, arguments, ok`` of gold and predicted calls and of what ``ok(id, pos, ok)`` tells of the latter: rows of a sample
    lie in one part, so that pairing and adding up shuffle nothing more; they are sorted and streamed, a sample of any size is never held."""
    none = lambda kind: F.lit(None).cast(kind)
    out = None
    for df, side in ((gold, GOLD), (pred, PRED)):
        calls = df.select("id", F.lit(side).alias("side"), "pos", "tool_name", "arguments", none("boolean").alias("ok"))
        out = calls if out is None else out.union(calls)
    if ok is not None:
        out = out.union(ok.select("id", F.lit(TOLD).alias("side"), "pos", none("string").alias("tool_name"), none("string").alias("arguments"), "ok"))
    return out.repartition("id")


def _with_match(df: DataFrame, paired: Column, pred: Column, gold: Column, waits: Column | None = None) -> DataFrame:
    """``df`` with ``_f1`` and ``_values`` of the rows that ``paired`` names. Equal texts have equal keys and values and are not parsed, others once."""
    same = pred.eqNullSafe(gold)
    p, g = (F.when(paired & ~same, args_map(x)) for x in (pred, gold))
    parsed = df.withColumns({"_p": p, "_g": g})
    values = S.value_accuracy(F.col("_p"), F.col("_g"))
    right = same if waits is None else same | F.coalesce(waits, F.lit(False))
    met = {"_f1": F.when(paired, F.when(same, 1.0).otherwise(S.key_f1(F.col("_p"), F.col("_g")))), "_values": F.when(paired, F.when(right, 1.0).otherwise(values))}
    return parsed.withColumns(met).drop("_p", "_g")


def multi(samples: DataFrame, gold: DataFrame, pred: DataFrame, statuses: DataFrame) -> DataFrame:
    """State-changing multi-call samples ``samples(id, ordered, predicted_action, expected_status)``.

    ``gold`` and ``pred`` are calls ``id, pos, tool_name, arguments``, positions of a side unique in a sample; ``statuses`` has ``id, pos, status`` of the
    predicted calls. Samples with gold steps pair by order, others as multisets: as in ``pairing``, a pair has the same tool and the same place,
    its position or its number among the calls of its tool.
    """
    c = F.col
    rows = _by_sample(gold, pred).join(samples.select("id", "ordered"), "id")
    nth = F.row_number().over(Window.partitionBy("id", "side", "tool_name").orderBy("pos"))
    rows = rows.withColumn("_nth", nth).withColumn("_place", F.when(c("ordered"), c("pos")).otherwise(c("_nth")))
    sides = {"gold": c("side") == GOLD, "pred": c("side") == PRED}
    places = rows.groupBy("id", "tool_name", "_place").agg(*(F.max(F.when(x, c("arguments"))).alias(f"_{n}") for n, x in sides.items()), *(F.count_if(x).alias(f"n_{n}") for n, x in sides.items()))
    pair = c("tool_name").isNotNull() & c("_place").isNotNull() & (c("n_gold") > 0) & (c("n_pred") > 0)
    paired = _with_match(places, pair, c("_pred"), c("_gold")).groupBy("id").agg(F.count_if(pair).alias("matched"), F.avg("_f1").alias("argument_key_f1"), F.avg("_values").alias("argument_value_accuracy"), F.sum("n_gold").alias("n_gold"), F.sum("n_pred").alias("n_pred"))
    told = statuses.select("id", "status").join(samples.select("id", F.coalesce("expected_status", F.lit("ok")).alias("_wanted")), "id")
    fits = {"schema_validity": c("status") != "schema_invalid", "contract_validity": c("status") != "contract_invalid", "execution_success_rate": c("status") == "ok"}
    scored = told.groupBy("id").agg(*(F.avg(x.cast("double")).alias(n) for n, x in fits.items()), F.count_if(c("status") != c("_wanted")).alias("_off"))
    out = samples.join(paired, "id", "left").join(scored, "id", "left")
    zero = F.lit(0.0)
    empty = F.coalesce("n_pred", F.lit(0)) == 0
    out = out.fillna(0, ["n_gold", "n_pred", "matched"])
    metrics = {
        "action_accuracy": F.when(empty, (F.col("predicted_action") == "call_functions").cast("double")).when(F.col("predicted_action") == "call_functions", 1.0).otherwise(0.5),
        "function_selection_accuracy": F.when(F.col("n_gold") == 0, 1.0).otherwise(F.col("matched") / F.col("n_gold")),
        **{k: F.coalesce(F.col(k), zero) for k in ("argument_key_f1", "argument_value_accuracy", "schema_validity", "contract_validity", "execution_success_rate")},
    }
    done = (F.col("n_gold") == F.col("n_pred")) & (F.col("_off") == 0)
    exact = (metrics["action_accuracy"] == 1) & (metrics["function_selection_accuracy"] == 1) & (metrics["argument_key_f1"] == 1) & (metrics["argument_value_accuracy"] == 1) & done
    soft = F.when(empty, 0.1 * metrics["action_accuracy"]).otherwise(S.weighted(metrics, S.TRANSACTIONAL))
    strict = F.when(empty, 0.0).otherwise(F.coalesce(exact, F.lit(False)).cast("double"))
    return out.select("id", *(v.alias(k) for k, v in metrics.items()), F.coalesce(done, F.lit(False)).cast("double").alias("task_success_rate"), F.round(soft, 6).alias("reward_soft"), F.round(strict, 6).alias("reward_strict"), S.total_reward(soft, strict).alias("reward_total"))


def multi_read_only(samples: DataFrame, gold: DataFrame, pred: DataFrame, schema_ok: DataFrame) -> DataFrame:
    """Read-only multi-call samples ``samples(id, predicted_action)``, calls matched by tool.

    ``schema_ok`` has ``id, pos, ok`` of the predicted calls. A value that waits for the first step counts as right.
    """
    c = F.col
    rows = _by_sample(gold, pred, schema_ok)
    ok = F.max("ok").over(Window.partitionBy("id", c("side") == GOLD, "pos"))
    calls = rows.withColumn("_ok", F.when(c("pos").isNotNull(), ok)).where(c("side") != TOLD)
    # gold calls of a tool come before predicted ones, by position: the last one so far is the last of all
    before = Window.partitionBy("id", "tool_name").orderBy("side", "pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = F.last(F.when((c("side") == GOLD) & c("tool_name").isNotNull(), F.struct("pos", "arguments")), ignorenulls=True).over(before)
    is_pred = c("side") == PRED
    met = calls.withColumn("_last", last).select("id", "side", c("arguments").alias("_pred"), "_ok", c("_last.pos").alias("_hit"), c("_last.arguments").alias("_gold"))
    met = _with_match(met, is_pred, c("_pred"), c("_gold"), c("_pred").contains(PLACEHOLDER))
    valid = F.avg(F.when(is_pred, F.coalesce("_ok", F.lit(False)).cast("double")))
    per = met.groupBy("id").agg(F.count_if(~is_pred).alias("n_gold"), F.count_if(is_pred).alias("n_pred"), F.count_if(is_pred & c("_hit").isNotNull()).alias("hits"), F.avg("_f1").alias("argument_key_f1"), F.avg("_values").alias("argument_value_accuracy"), valid.alias("schema_validity"))
    out = samples.join(per, "id", "left").fillna(0, ["n_gold", "n_pred", "hits"])
    most = F.greatest("n_gold", "n_pred")
    metrics = {"action_accuracy": (F.col("predicted_action") == "call_functions").cast("double"), "function_selection_accuracy": F.when(most > 0, F.col("hits") / most).otherwise(0.0), **{k: F.coalesce(F.col(k), F.lit(0.0)) for k in ("argument_key_f1", "argument_value_accuracy", "schema_validity")}}
    exact = F.col("n_gold") == F.col("n_pred")
    for m in metrics.values():
        exact = exact & (m == 1)
    empty = F.col("n_pred") == 0
    soft = F.when(empty, 0.1 * metrics["action_accuracy"]).otherwise(S.weighted(metrics, S.READ_ONLY))
    strict = F.when(empty, 0.0).otherwise(exact.cast("double"))
    return out.select("id", *(v.alias(k) for k, v in metrics.items()), F.round(soft, 6).alias("reward_soft"), F.round(strict, 6).alias("reward_strict"), S.total_reward(soft, strict).alias("reward_total"))
