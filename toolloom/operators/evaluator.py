"""End-to-end evaluation: raw model output -> prediction -> schema, contract, execution -> metrics and rewards.

Samples are scanned and parsed once. What the calls of a sample name (tools with their contracts, customers, reference
codes) are keys that one hash join looks up in one catalogue of any size (``lookup.with_lookups``); a row number made
in the scan puts a sample together again, so ids may repeat or be missing. Then all checks are expressions over the
sample's row; a fold over its calls lets them see the writes of earlier ones. State-changing and read-only samples take
the same way, each by its own rules.

Samples: ``id, source, expected_action, expected_status, customer_verified, missing_slots array<string>, gold_call
struct<tool_name, arguments>, gold_calls, gold_steps array<that>``, for masked tools ``masked_tool`` (a tool struct),
arguments as JSON texts, and the raw output. Null and missing fields count as absent.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from toolloom.functions import scores as S
from toolloom.functions.json import CALL, args_map, with_predictions
from toolloom.functions.values import first_filled, slot_recall
from toolloom.operators import executor
from toolloom.operators.lookup import key, with_lookups
from toolloom.operators.scoring import is_read_only
from toolloom.operators.validation import CODE_PARAMS, ISSUE, PLACEHOLDER, call_status, code_issues_by, contract_issues, gold_issues, issue, none_of, schema_issues

CALLS = f"array<{CALL}>"
METRICS = ("action_accuracy", "function_selection_accuracy", "argument_key_f1", "argument_value_accuracy", "schema_validity", "contract_validity", "execution_success_rate", "task_success_rate", "ask_back_accuracy", "abstention_accuracy", "deprecated_tool_call_rate")
#: Texts of feedback.
TEXTS = {
    "format": "Output is not valid JSON in the required action format.",
    "ask": "The correct action is ask_clarification and all missing slots must be requested.",
    "abstain": "The correct action is abstain; no tool should be called.",
    "one": "The task requires a function call.",
    "many": "The task requires multiple function calls.",
    "set": "The task requires the complete set of expected function calls.",
}


def _once(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f(value)`` with the value computed once."""
    return F.element_at(F.transform(F.array(value), f), 1)


def mock_output(samples: DataFrame, malformed: bool = False) -> Column:
    """The raw output of a test double: what the sample's gold says, or a sentence that is no JSON."""
    if malformed:
        return F.lit("I think you should call the right tool, but this is not JSON.")  # fixed value
    c = F.col

    def text(call: Column) -> Column:
        made = F.concat(F.lit('{"tool_name":'), _json_string(call["tool_name"]), F.lit(',"arguments":'), F.coalesce(call["arguments"], F.lit("{}")), F.lit("}"))
        return F.when(call.isNotNull(), made).otherwise("null")

    many = first_filled(c("gold_steps"), c("gold_calls"))
    slots = F.to_json(F.coalesce(c("missing_slots"), F.array().cast("array<string>")))
    reason = F.coalesce(c("reason"), F.lit("unsafe request")) if "reason" in samples.columns else F.lit("unsafe request")
    return (
        F.when(c("expected_action") == "call_functions", F.concat(F.lit('{"action":"call_functions","calls":['), F.array_join(F.transform(many, text), ","), F.lit("]}")))
        .when(c("expected_action") == "call_function", F.concat(F.lit('{"action":"call_function","call":'), text(c("gold_call")), F.lit("}")))
        .when(c("expected_action") == "ask_clarification", F.concat(F.lit('{"action":"ask_clarification","asked_slots":'), slots, F.lit("}")))
        .otherwise(F.concat(F.lit('{"action":"abstain","reason":'), _json_string(reason), F.lit("}")))
    )


def _json_string(text: Column) -> Column:
    items = F.to_json(F.array(text))
    return F.substring(items, F.lit(2), F.length(items) - 2)


def catalogue(tools: DataFrame, contracts: DataFrame | None = None, subscribers: DataFrame | None = None, references: DataFrame | None = None, more: DataFrame | None = None) -> DataFrame:
    """``key, value`` of all that samples can name: tools with contracts, ``subscribers(customer_id, state)``, ``references(param, code)``, ``more(key, ...)``."""
    c = F.col
    out = tools.select("name", F.struct("name", "deprecated", "params").alias("tool"))
    if contracts is not None:
        rules = contracts.dropDuplicates(["tool_name"]).select("tool_name", F.struct("verified", "rules").alias("contract"))
        out = out.join(rules, c("name") == c("tool_name"), "left").drop("tool_name")
    out = out.select(key("tool", c("name")).alias("key"), *out.columns[1:])
    if subscribers is not None:
        out = out.unionByName(subscribers.select(key("customer", c("customer_id")).alias("key"), "state", state_map(c("state")).alias("texts")), allowMissingColumns=True)
    if references is not None:
        out = out.unionByName(references.select(key("code", c("param"), c("code")).alias("key"), F.lit(True).alias("listed")), allowMissingColumns=True)
    if more is not None:
        out = out.unionByName(more, allowMissingColumns=True)
    return out.where("key is not null").select("key", F.struct(*(x for x in out.columns if x != "key")).alias("value"))


def _calls(prediction: Column) -> Column:
    """The predicted calls of either calling action; none of other ones."""
    none = F.array().cast(CALLS)
    return F.when(prediction["action"].isin("call_function", "call_functions"), F.coalesce(prediction["calls"], none)).otherwise(none)


def customer(arguments: Column) -> Column:
    return F.get_json_object(arguments, "$.customer_id")


def state_map(state: Column) -> Column:
    """A state struct as a map of JSON texts; a null field is missing."""
    return F.when(state.isNotNull(), F.transform_values(F.from_json(F.to_json(state), "map<string,variant>"), lambda k, v: F.to_json(v)))


def tool_keys(calls: Column) -> Column:
    return F.transform(calls, lambda x: key("tool", x["tool_name"]))


def code_keys(calls: Column, name: str, param: str | None = None) -> Column:
    """Keys of an argument's codes in the catalogue of ``param``, by default its own."""
    return F.transform(calls, lambda x: key("code", F.lit(param or name), F.try_element_at(args_map(x["arguments"]), F.lit(name)).cast("string")))


def score_calls(calls: Column, found: Column, verified: Column, networks: Column | None = None, plans: Column | None = None) -> Column:
    """For each call of a sample in order ``struct<status, issues, deprecated, output>``; writes of earlier calls are seen by later ones.

    ``found`` holds the catalogue's values of the calls' tools, then of their customers.
    """
    result = f"struct<status:string,issues:array<{ISSUE}>,deprecated:boolean,output:string>"
    n = F.size(calls)

    def named(call: Column, i: Column) -> Column:
        tool, person = F.get(found, i), F.get(found, n + i)
        return F.struct(call["tool_name"].alias("name"), args_map(call["arguments"]).alias("args"), customer(call["arguments"]).alias("who"), tool["tool"].alias("tool"), tool["contract"].alias("contract"), person["state"].alias("state"), person["texts"].alias("texts"))

    checked = F.transform(F.transform(calls, named), lambda x: x.withField("schema", schema_issues(x["tool"], x["args"], x["name"])))
    start = F.struct(F.array().cast(f"array<struct<who:string,state:{executor.STATE}>>").alias("changed"), F.lit(0).alias("tickets"), F.array().cast(f"array<{result}>").alias("done"))

    def step(held: Column, x: Column) -> Column:
        changed = F.try_element_at(F.filter(held["changed"], lambda e: e["who"] == x["who"]), F.lit(1))["state"]

        def against(now: Column) -> Column:
            # a schema-valid call without a customer has no subscriber, contract or not
            nobody = F.array(issue("missing_subscriber", F.lit("subscriber"), F.lit("Subscriber not found")))
            texts = F.when(changed.isNull(), x["texts"]).otherwise(state_map(now["state"]))
            rules = F.when(~F.map_contains_key(x["args"], F.lit("customer_id")), nobody).otherwise(contract_issues(x["contract"], texts, x["args"], verified))
            return now.withField("contract", F.when(F.size(x["schema"]) == 0, rules).otherwise(none_of())).withField("error", executor.execution_error(x["name"], now["state"], x["who"]))

        def finished(y: Column) -> Column:
            status = y["status"]
            issues = F.when(status == "execution_failed", F.array(issue("execution_failed", x["name"], y["error"]))).otherwise(F.concat(x["schema"], y["contract"]))
            answer = F.when(status == "ok", executor.output(y["state"], x["name"], x["args"], networks, plans, held["tickets"]))
            made = F.struct(status.alias("status"), issues.alias("issues"), F.exists(x["schema"], lambda i: i["code"] == "deprecated_tool").alias("deprecated"), answer.alias("output"))
            writes = (status == "ok") & x["name"].isin(list(executor.WRITES))
            after = F.when(writes, F.concat(F.array(F.struct(x["who"].alias("who"), executor.apply_call(y["state"], x["name"], x["args"]).alias("state"))), held["changed"])).otherwise(held["changed"])
            return F.struct(after.alias("changed"), (held["tickets"] + F.when((status == "ok") & (x["name"] == executor.TICKET), 1).otherwise(0)).alias("tickets"), F.concat(held["done"], F.array(made)).alias("done"))

        now = F.struct(F.coalesce(changed, x["state"]).alias("state"))
        return _once(_once(_once(now, against), lambda y: y.withField("status", call_status(x["schema"], y["contract"], y["error"]))), finished)

    return F.aggregate(checked, start, step, lambda held: held["done"])


def _mean(values: Column) -> Column:
    total = F.aggregate(values, F.lit(0.0), lambda a, x: a + x)
    return F.when(F.size(values) > 0, total / F.size(values)).otherwise(0.0)


def _share(items: Column, test: Callable[[Column], Column]) -> Column:
    return _mean(F.transform(items, lambda x: test(x).cast("double")))


def paired(gold: Column, pred: Column, ordered: Column) -> Column:
    """``struct<gold, pred>`` of calls of the same tool: at the same place, or the n-th of a tool with the n-th."""
    here = F.filter(F.transform(F.arrays_zip(gold.alias("gold"), pred.alias("pred")), lambda z: F.struct(z["gold"].alias("gold"), z["pred"].alias("pred"))), lambda z: z["gold"].isNotNull() & z["pred"].isNotNull() & z["gold"]["tool_name"].eqNullSafe(z["pred"]["tool_name"]))

    def nth(g: Column, i: Column) -> Column:
        place = F.size(F.filter(F.slice(gold, F.lit(1), i + 1), lambda o: o["tool_name"].eqNullSafe(g["tool_name"])))
        return F.struct(g.alias("gold"), F.try_element_at(F.filter(pred, lambda o: o["tool_name"].eqNullSafe(g["tool_name"])), place).alias("pred"))

    free = F.filter(F.transform(gold, nth), lambda z: z["pred"].isNotNull())
    return F.when(ordered, here).otherwise(free)


def _compared(pairs: Column) -> Column:
    """``struct<key_f1, value_accuracy>`` of each pair; arguments are parsed once."""
    parsed = F.transform(pairs, lambda p: F.struct(args_map(p["pred"]["arguments"]).alias("p"), args_map(p["gold"]["arguments"]).alias("g")))
    return F.transform(parsed, lambda x: F.struct(S.key_f1(x["p"], x["g"]).alias("key_f1"), S.value_accuracy(x["p"], x["g"]).alias("value_accuracy")))


def _null(kind: str) -> Column:
    return F.lit(None).cast(kind)


#: What an evaluation gives besides its metrics.
PARTS = ("soft", "strict", "machine_status", "error_type", "issues", "feedback_text", "execution_output")


def _result(df: DataFrame, found: dict[str, Column]) -> DataFrame:
    metrics = [k for k in found if k not in PARTS]
    out = df.select("*", *(v.alias(f"_m_{k}") for k, v in found.items()))
    keep = [c for c in df.columns if not c.startswith("_")]
    c = lambda k: F.col(f"_m_{k}")
    return out.select(*keep, *(c(k).alias(k) for k in metrics), F.round(c("soft"), 6).alias("reward_soft"), F.round(c("strict"), 6).alias("reward_strict"), S.total_reward(c("soft"), c("strict")).alias("reward_total"), *(c(k).alias(k) for k in PARTS[2:]))


def _gold(single: Column, many: Column, *several: Column) -> Column:
    return F.when(many, first_filled(*several)).otherwise(F.when(single.isNotNull(), F.array(single)).otherwise(F.array().cast(CALLS)))


def _with_calls(df: DataFrame, mine: Column, read_only: bool) -> DataFrame:
    """``df`` with ``_calls`` (the predicted ones that count), ``_gold`` and the lookup keys ``_keys`` of samples that are ``mine``."""
    c, none = F.col, F.array().cast(CALLS)
    many, one = c("expected_action") == "call_functions", c("expected_action") == "call_function"
    if not read_only:
        pred, gold = _calls(c("prediction")), _gold(c("gold_call"), many, c("gold_steps"), c("gold_calls"))
    else:
        right = (many & (c("prediction.action") == "call_functions")) | (one & (c("prediction.action") == "call_function"))
        pred, gold = F.when(right, F.coalesce(c("prediction.calls"), none)).otherwise(none), _gold(c("gold_call"), many, c("gold_calls"), c("gold_steps"))
    df = df.withColumn("_calls", F.when(mine, pred).otherwise(c("_calls") if "_calls" in df.columns else none))
    return df.withColumn("_gold", F.when(mine, gold).otherwise(c("_gold") if "_gold" in df.columns else none))


def _keys(read_only: bool) -> Column:
    calls = F.col("_calls")
    if not read_only:
        return F.concat(tool_keys(calls), F.transform(calls, lambda x: key("customer", customer(x["arguments"]))))
    return F.concat(tool_keys(calls), *(code_keys(calls, name) for name in CODE_PARAMS))


def _transactional(df: DataFrame, mine: Column, lookups: tuple[Column | None, Column | None]) -> tuple[DataFrame, dict[str, Column]]:
    """Columns of the state-changing evaluation of the samples that are ``mine``; ``df`` with what they share."""
    c, none = F.col, F.array().cast(CALLS)
    verified = F.coalesce(c("customer_verified"), F.lit(True))
    df = df.withColumn("_t_calls", F.when(mine, c("_calls")).otherwise(none)).withColumn("_t_gold", F.when(mine, c("_gold")).otherwise(none))
    df = df.withColumn("_t_scores", score_calls(c("_t_calls"), c("_found"), verified, *lookups))
    many, one = c("expected_action") == "call_functions", c("expected_action") == "call_function"
    pairs = paired(c("_t_gold"), c("_t_calls"), F.size(c("gold_steps")) > 0)
    # one call is compared with its gold whatever its tool
    single = F.array(F.struct(F.coalesce(F.try_element_at("_t_gold", F.lit(1)), F.struct(F.lit(None).cast("string").alias("tool_name"), F.lit("{}").alias("arguments"))).alias("gold"), F.try_element_at("_t_calls", F.lit(1)).alias("pred")))
    df = df.withColumn("_t_pairs", F.when(many, pairs).when(one, single).otherwise(F.array().cast(f"array<struct<gold:{CALL},pred:{CALL}>>")))
    df = df.withColumn("_t_compared", _compared(c("_t_pairs")))

    scores, calls, gold = c("_t_scores"), c("_t_calls"), c("_t_gold")
    action, bad = c("prediction.action"), c("prediction.parse_error").isNotNull()
    right = (action == c("expected_action")).cast("double")
    recall = slot_recall(c("missing_slots"), c("prediction.asked_slots"))
    asks, refuses = c("expected_action") == "ask_clarification", c("expected_action") == "abstain"
    called = ~bad & F.when(many, F.size(calls) > 0).when(one, action == "call_function").otherwise(F.lit(False))
    wanted = F.coalesce("expected_status", F.lit("ok"))
    status = [F.try_element_at(scores, F.lit(1))["status"], F.coalesce(F.try_element_at(F.transform(F.filter(scores, lambda s: s["status"] != "ok"), lambda s: s["status"]), F.lit(1)), F.lit("ok"))]
    deprecated = F.exists(scores, lambda s: s["deprecated"])
    first = F.try_element_at("_t_pairs", F.lit(1))
    chosen = F.when(many, F.when(F.size(gold) == 0, 1.0).otherwise(F.size("_t_pairs") / F.size(gold))).otherwise(first["pred"]["tool_name"].eqNullSafe(first["gold"]["tool_name"]).cast("double"))
    done = F.forall(scores, lambda s: s["status"] == wanted) & (~many | (F.size(gold) == F.size(calls)))
    reached = {
        "function_selection_accuracy": chosen,
        "argument_key_f1": _mean(c("_t_compared.key_f1")),
        "argument_value_accuracy": _mean(c("_t_compared.value_accuracy")),
        "schema_validity": _share(scores, lambda s: (s["status"] != "schema_invalid") | (one & s["deprecated"])),
        "contract_validity": _share(scores, lambda s: s["status"] != "contract_invalid"),
        "execution_success_rate": _share(scores, lambda s: s["status"] == "ok"),
        "task_success_rate": done.cast("double"),
        "deprecated_tool_call_rate": F.when(one, deprecated.cast("double")).otherwise(0.0),
    }
    metrics = {
        "action_accuracy": F.when(many & called, F.when(action == "call_functions", 1.0).otherwise(0.5)).otherwise(right),
        **{k: F.when(called, v).otherwise(0.0) for k, v in reached.items()},
        "ask_back_accuracy": (~bad & asks & (action == "ask_clarification") & (recall == 1)).cast("double"),
        "abstention_accuracy": (~bad & refuses & (action == "abstain")).cast("double"),
    }
    df = df.withColumn("_t", F.struct(*(metrics[k].alias(k) for k in METRICS)))  # computed once
    metrics = {k: c(f"_t.{k}") for k in METRICS}
    exact = called & done
    for k in ("action_accuracy", "function_selection_accuracy", "argument_key_f1", "argument_value_accuracy"):
        exact = exact & (metrics[k] == 1)
    soft = F.when(bad, 0.0).when(asks, 0.6 * metrics["action_accuracy"] + 0.4 * recall).when(refuses, metrics["abstention_accuracy"]).when(called, S.weighted(metrics, S.TRANSACTIONAL)).otherwise(0.1 * metrics["action_accuracy"])
    strict = F.when(bad, 0.0).when(asks, metrics["ask_back_accuracy"]).when(refuses, metrics["abstention_accuracy"]).otherwise(exact.cast("double"))
    kind = F.when(bad, "format_error").when(strict == 1, None).when(asks, "missing_slot_not_handled").when(refuses, "unsafe_or_forbidden_action").when(~called, "wrong_action").when(status[1] != "ok", status[1]).when(many, "multi_call_mismatch")
    issues = F.when(called, F.flatten(F.transform(scores, lambda s: s["issues"]))).otherwise(none_of())
    machine = F.when(bad, "format_error").when(called, F.when(many, status[1]).otherwise(status[0]))
    df = df.withColumn("_t_end", F.struct(soft.alias("soft"), strict.alias("strict"), kind.alias("kind"), issues.alias("issues"), machine.alias("machine"), F.when(called, F.transform(scores, lambda s: s["output"])).alias("outputs")))
    end = lambda k: c(f"_t_end.{k}")
    own = F.array_compact(F.array(F.when(end("kind") == "format_error", TEXTS["format"]).when(end("kind") == "missing_slot_not_handled", TEXTS["ask"]).when(end("kind") == "unsafe_or_forbidden_action", TEXTS["abstain"]).when((end("kind") == "wrong_action") & many, TEXTS["many"]).when(end("kind") == "wrong_action", TEXTS["one"]).when(end("kind") == "multi_call_mismatch", TEXTS["set"])))
    texts = F.concat(F.transform(end("issues"), lambda i: i["message"]), own)
    return df, metrics | {"soft": end("soft"), "strict": end("strict"), "machine_status": end("machine"), "error_type": end("kind"), "issues": end("issues"), "feedback_text": texts, "execution_output": end("outputs")}


def _read_only(df: DataFrame, mine: Column, reveal: bool) -> tuple[DataFrame, dict[str, Column]]:
    """Columns of the read-only evaluation of the samples that are ``mine``; ``df`` with what they share."""
    c, none = F.col, F.array().cast(CALLS)
    df = df.withColumn("_o_calls", F.when(mine, c("_calls")).otherwise(none)).withColumn("_o_gold", F.when(mine, c("_gold")).otherwise(none))
    many, one = c("expected_action") == "call_functions", c("expected_action") == "call_function"
    calls, gold, found, n = c("_o_calls"), c("_o_gold"), c("_found"), F.size("_o_calls")

    def scored(call: Column, i: Column) -> Column:
        name = call["tool_name"]
        # the last gold call of the tool serves all predicted ones; a single call has its gold whatever the tool
        partner = F.when(many, F.try_element_at(F.filter(gold, lambda g: g["tool_name"].eqNullSafe(name)), F.lit(-1))).otherwise(F.try_element_at(gold, F.lit(1)))
        tool = F.get(found, i)["tool"]
        if "masked_tool" in df.columns:
            tool = F.when(c("masked_tool.name").eqNullSafe(name), c("masked_tool")).otherwise(tool)
        codes = F.transform(F.array(*(F.get(found, n * (k + 1) + i)["listed"] for k in range(len(CODE_PARAMS)))), lambda x: F.coalesce(x, F.lit(False)))
        held = F.struct(name.alias("name"), args_map(call["arguments"]).alias("args"), partner["tool_name"].alias("gold_name"), args_map(partner["arguments"]).alias("gold"), tool.alias("tool"), call["arguments"].contains(PLACEHOLDER).alias("waits"), codes.alias("codes"))

        def compared(x: Column) -> Column:
            known = lambda p, text: (F.array_contains(c("_listed"), p), F.get(x["codes"], F.lit(CODE_PARAMS.index(p))))
            rest = F.concat(gold_issues(x["name"], x["args"], x["gold_name"], x["gold"], reveal), code_issues_by(x["args"], known))
            return F.struct(
                schema_issues(x["tool"], x["args"], x["name"]).alias("schema"), rest.alias("rest"), x["gold_name"].isNotNull().alias("hit"), x["name"].eqNullSafe(x["gold_name"]).alias("same"),
                S.key_f1(x["args"], x["gold"]).alias("key_f1"), F.when(many & F.coalesce(x["waits"], F.lit(False)), 1.0).otherwise(S.value_accuracy(x["args"], x["gold"])).alias("value_accuracy"),
            )

        def told(y: Column) -> Column:
            broken = F.size(y["schema"]) > 0
            return F.struct(F.when(broken, "schema_invalid").when(F.size(y["rest"]) > 0, "wrong_call").otherwise("ok").alias("status"), F.when(broken, y["schema"]).otherwise(y["rest"]).alias("issues"), (~broken).alias("valid"), y["hit"].alias("hit"), y["same"].alias("same"), y["key_f1"].alias("key_f1"), y["value_accuracy"].alias("value_accuracy"))

        return _once(_once(held, compared), told)

    df = df.withColumn("_o_scores", F.transform(calls, scored))
    scores = c("_o_scores")
    action, bad = c("prediction.action"), c("prediction.parse_error").isNotNull()
    right = F.when(bad, 0.0).otherwise((action == c("expected_action")).cast("double"))
    recall = slot_recall(c("missing_slots"), c("prediction.asked_slots"))
    asks, refuses = c("expected_action") == "ask_clarification", c("expected_action") == "abstain"
    called = ~bad & (many | one) & (n > 0)
    most = F.greatest(F.size(gold), n)
    first = F.try_element_at(scores, F.lit(1))
    hits = F.size(F.filter(scores, lambda s: s["hit"]))
    chosen = F.when(many, hits / F.greatest(most, F.lit(1))).otherwise(first["same"].cast("double"))
    failed = F.try_element_at(F.transform(F.filter(scores, lambda s: s["status"] != "ok"), lambda s: s["status"]), F.lit(1))
    status = F.coalesce(failed, F.when(many & (chosen != 1), "wrong_action").otherwise("ok"))
    reached = {
        "function_selection_accuracy": chosen,
        "argument_key_f1": _mean(F.col("_o_scores.key_f1")),
        "argument_value_accuracy": _mean(F.col("_o_scores.value_accuracy")),
        "schema_validity": _share(scores, lambda s: s["valid"]),
        "task_success_rate": F.when(one, (status == F.coalesce("expected_status", F.lit("ok"))).cast("double")),
    }
    asked = (action == "ask_clarification") & (recall == 1)
    given = {"action_accuracy": right, **{k: F.when(called, v) for k, v in reached.items()}, "ask_back_accuracy": F.when(~bad & asks, asked.cast("double")), "abstention_accuracy": F.when(~bad & refuses, (action == "abstain").cast("double"))}
    df = df.withColumn("_o", F.struct(*(given.get(k, _null("double")).alias(k) for k in METRICS), status.alias("status")))  # computed once
    metrics, status = {k: c(f"_o.{k}") for k in METRICS}, c("_o.status")
    exact = called & (~many | (F.size(gold) == n))
    for k in S.READ_ONLY:
        exact = exact & (metrics[k] == 1)
    strict = F.when(bad, 0.0).when(asks, asked.cast("double")).when(refuses, (action == "abstain").cast("double")).otherwise(F.coalesce(exact, F.lit(False)).cast("double"))
    soft = F.when(bad, 0.0).when(asks, 0.6 * right + 0.4 * recall).when(refuses, strict).when(called, S.weighted(metrics, S.READ_ONLY)).otherwise(0.1 * right)
    issues = F.when(bad, F.array(issue("parse_error", _null("string"), c("prediction.parse_error")))).when(called, F.flatten(F.transform(scores, lambda s: s["issues"]))).otherwise(none_of())
    machine = F.when(bad, "format_error").when((asks | refuses) & (strict == 0), "wrong_action").when((many | one) & ~called, "wrong_action").when(called, status).otherwise("ok")
    kind = F.when(bad, "format_error").when(asks & (strict == 0), "missing_slot_not_handled").when(refuses & (strict == 0), "unsafe_or_forbidden_action").when((many | one) & ~called, "wrong_action").when(called & (status != "ok"), status)
    df = df.withColumn("_o_end", F.struct(soft.alias("soft"), strict.alias("strict"), kind.alias("kind"), issues.alias("issues"), machine.alias("machine")))
    end = lambda k: c(f"_o_end.{k}")
    texts = F.when(bad, F.array(F.lit(TEXTS["format"]))).when(called & one, F.transform(end("issues"), lambda i: i["message"])).otherwise(F.array().cast("array<string>"))
    return df, metrics | {"soft": end("soft"), "strict": end("strict"), "machine_status": end("machine"), "error_type": end("kind"), "issues": end("issues"), "feedback_text": texts, "execution_output": _null("array<string>")}


def _beside(df: DataFrame, catalogues: DataFrame | None) -> tuple[DataFrame, tuple[Column | None, Column | None]]:
    """``df`` with the one row of ``executor.lookups``, and its two columns."""
    if catalogues is None:
        return df, (None, None)
    return df.crossJoin(F.broadcast(catalogues.withColumnsRenamed({"networks": "_networks", "plans": "_plans"}))), (F.col("_networks"), F.col("_plans"))  # one row


def with_listed(df: DataFrame, references: DataFrame, params: Sequence[str] = CODE_PARAMS) -> DataFrame:
    """``df`` with ``_listed``, those of ``params`` that have a catalogue at all: one row of a few names."""
    return df.crossJoin(F.broadcast(references.where(F.col("param").isin(*params)).agg(F.collect_set("param").alias("_listed"))))


def evaluate(samples: DataFrame, raw: str, tools: DataFrame, contracts: DataFrame, subscribers: DataFrame, catalogues: DataFrame | None = None) -> DataFrame:
    """State-changing samples, scored from their raw output: the sample's columns, ``prediction``, all of ``METRICS``, rewards and feedback.

    Every sample starts from the subscribers as they are; of equal names in a registry one stays. ``catalogues`` is ``executor.lookups``.
    An output that does not parse scores 0, also where a refusal was right. A call of a deprecated tool counts as valid JSON, and as
    ``deprecated_tool_call_rate``; it still has the status ``schema_invalid``. Samples may be equal and have any id or none.
    """
    mine = F.lit(True)
    df = _with_calls(with_predictions(samples, F.col(raw), "prediction"), mine, read_only=False)
    df, lookups = _beside(with_lookups(df, _keys(False), catalogue(tools, contracts, subscribers)), catalogues)
    return _result(*_transactional(df, mine, lookups))


def evaluate_read_only(samples: DataFrame, raw: str, tools: DataFrame, references: DataFrame | None = None, reveal: bool = False) -> DataFrame:
    """Read-only samples, scored from their raw output against schemas, gold calls and reference codes; columns as ``evaluate``.

    Metrics that a case does not reach are null, so that averages skip them. Schema errors come alone; only a
    schema-valid call is compared with its gold and the codes. A sample's own ``masked_tool`` goes before the registry.
    """
    mine = F.lit(True)
    df = _with_calls(with_predictions(samples, F.col(raw), "prediction"), mine, read_only=True)
    references = _no_references(samples) if references is None else references
    df = with_listed(with_lookups(df, _keys(True), catalogue(tools, None, None, references)), references)
    return _result(*_read_only(df, mine, reveal))


def _no_references(df: DataFrame) -> DataFrame:
    return df.sparkSession.createDataFrame([], "param string, code string")


def route(samples: DataFrame, raw: str, tools: DataFrame, contracts: DataFrame, subscribers: DataFrame, references: DataFrame | None = None, catalogues: DataFrame | None = None) -> DataFrame:
    """Each sample by its own evaluator, chosen by ``source``; the columns of both, ``read_only`` says which.

    Both kinds go the way together: one scan, one parse, one lookup.
    """
    reads = F.coalesce(is_read_only(F.col("source")), F.lit(False))
    df = with_predictions(samples.withColumn("read_only", reads), F.col(raw), "prediction")
    mine = F.col("read_only")
    df = _with_calls(_with_calls(df, ~mine, read_only=False), mine, read_only=True)
    references = _no_references(samples) if references is None else references
    df = with_lookups(df, F.when(mine, _keys(True)).otherwise(_keys(False)), catalogue(tools, contracts, subscribers, references))
    df, lookups = _beside(with_listed(df, references), catalogues)
    df, left = _transactional(df, ~mine, lookups)
    df, right = _read_only(df, mine, False)
    return _result(df, {k: F.when(mine, right[k]).otherwise(left[k]) for k in left})


def self_checked(samples: DataFrame, results: DataFrame) -> DataFrame:
    """``results`` if every sample's own gold reaches the wanted status; else computing them raises, naming a sample."""
    ok = F.col("machine_status").eqNullSafe(F.coalesce("expected_status", F.lit("ok"))) | (~F.col("expected_action").isin("call_function", "call_functions") & (F.col("reward_strict") == 1))
    message = F.concat(F.lit("gold does not reach its status: "), F.coalesce(F.col("id").cast("string"), F.lit("null")))
    return results.withColumn("_ok", F.when(~ok, F.raise_error(message).cast("boolean")).otherwise(True)).where("_ok").drop("_ok")
