"""Evaluation from raw output to reward: customers as state-changing samples, parts as read-only ones."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from toolloom.functions.json import CALL
from toolloom.operators import audit, evaluator, executor, reports
from toolloom.operators.registry import PARAM, tools
from toolloom.operators.scoring import REAL_SOURCE
from toolloom.operators.validation import PLACEHOLDER
from toolloom.plans.base import Plans, spread, table

plans = Plans()
RULES = "array<struct<path:string,op:string,value:string,message:string>>"


def _tools(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    raw = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "pos int, name string, deprecated boolean, properties string, required array<string>")
    return tools(raw.select("pos", "name", F.lit("").alias("description"), "deprecated", F.struct("required", F.from_json("properties", "map<string,variant>").alias("properties")).alias("parameters")))


def transactional_tools(spark: SparkSession) -> DataFrame:
    who = '"customer_id": {"type": "string", "pattern": "[0-9]+"}'
    return _tools(spark, [
        ("get_balance", False, f"{{{who}}}", ["customer_id"]), ("pay_bill", False, f'{{{who}, "amount": {{"type": "number"}}}}', ["customer_id", "amount"]),
        ("change_plan", False, f'{{{who}, "new_plan": {{"type": "string", "enum": ["P1", "P2", "P3"]}}}}', ["customer_id", "new_plan"]), ("old_status", True, f"{{{who}}}", ["customer_id"]),
    ])


def contracts(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([
        ("pay_bill", True, [("subscriber.status", "ne", '"cancelled"', None), ("args.amount", "gte", "1", "Too little")]),
        ("change_plan", True, [("subscriber.status", "eq", '"active"', None), ("args.new_plan", "ne_path", '"subscriber.plan_id"', None)]),
    ], f"tool_name string, verified boolean, rules {RULES}")


def subscribers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All customers but every eleventh; those of every fourth nation are suspended."""
    c = F.col
    made = F.struct(c("c_custkey").cast("string").alias("customer_id"), F.when(c("c_nationkey") % 4 != 0, "active").otherwise("suspended").alias("status"), F.lit("P1").alias("plan_id"), F.lit(50.0).alias("outstanding_balance"), F.lit(7.0).alias("balance"))
    people = spread(table(spark, sf_dir, "customer").where("c_custkey % 11 <> 0").select("c_custkey", "c_nationkey"))
    return people.select(c("c_custkey").cast("string").alias("customer_id"), F.from_json(F.to_json(made), executor.STATE).alias("state"))


def _call(tool: str, arguments: Column) -> Column:
    return F.struct(F.lit(tool).alias("tool_name"), arguments.alias("arguments")).cast(CALL)


def _args(**values: Column | str | int) -> Column:
    return F.to_json(F.struct(*((v if isinstance(v, Column) else F.lit(v)).alias(k) for k, v in values.items())))


def _said(*calls: Column) -> Column:
    """Raw output of a model that makes these calls."""
    texts = [F.concat(F.lit('{"tool_name":"'), c["tool_name"], F.lit('","arguments":'), c["arguments"], F.lit("}")) for c in calls]
    if len(texts) == 1:
        return F.concat(F.lit('{"action":"call_function","call":'), texts[0], F.lit("}"))
    return F.concat(F.lit('{"action":"call_functions","calls":['), F.concat_ws(",", *texts), F.lit("]}"))


def _samples(df: DataFrame, cases: list[dict[str, object]], more: dict[str, Column]) -> DataFrame:
    """A sample a row: its case is ``id`` modulo the number of cases; an output of None is the test double's own."""
    turn = F.col("id") % len(cases)

    def field(name: str, kind: str) -> Column:
        out = F.lit(None).cast(kind)
        for i, case in enumerate(cases):
            if (v := case.get(name)) is not None:
                out = F.when(turn == i, (v if isinstance(v, Column) else F.lit(v)).cast(kind)).otherwise(out)
        return out.alias(name)

    out = df.select("*", field("expected_action", "string"), field("missing_slots", "array<string>"), field("gold_call", CALL), field("gold_calls", f"array<{CALL}>"), field("gold_steps", f"array<{CALL}>"), F.lit(None).cast("string").alias("expected_status"), *(v.alias(k) for k, v in more.items()))
    return out.withColumn("raw", F.coalesce(field("output", "string"), evaluator.mock_output(out)))


def transactional_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    who = F.col("id").cast("string")
    balance, pay = _call("get_balance", _args(customer_id=who)), lambda n: _call("pay_bill", _args(customer_id=who, amount=n))
    plan, slots = lambda p: _call("change_plan", _args(customer_id=who, new_plan=p)), F.array(F.lit("amount"), F.lit("customer_id"))
    one, many = "call_function", "call_functions"
    cases = [
        {"expected_action": one, "gold_call": pay(10)},
        {"expected_action": one, "gold_call": pay(10), "output": evaluator.mock_output(spark.range(0), malformed=True)},
        {"expected_action": one, "gold_call": balance, "output": _said(_call("old_status", _args(customer_id=who)))},
        {"expected_action": one, "gold_call": balance, "output": _said(pay(5))},
        {"expected_action": one, "gold_call": plan("P2"), "output": _said(plan("P9"))},
        {"expected_action": "ask_clarification", "missing_slots": slots, "output": '<think>{}</think> {"action": "ask_clarification", "asked_slots": ["amount"]}'},
        {"expected_action": "abstain"},
        {"expected_action": "abstain", "output": _said(pay(5))},
        {"expected_action": one, "gold_call": balance, "output": '{"action": "ask_clarification", "asked_slots": []}'},
        {"expected_action": many, "gold_calls": F.array(balance, pay(60)), "output": _said(pay(60), balance)},
        {"expected_action": many, "gold_steps": F.array(pay(50), plan("P2")), "output": _said(pay(50), plan("P1"))},
        {"expected_action": many, "gold_calls": F.array(plan("P2"), plan("P3")), "output": _said(plan("P2"), plan("P2"))},
    ]
    people = spread(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id")))
    return _samples(people, cases, {"customer_verified": F.col("id") % 5 != 0, "source": F.lit("orders")})


def read_only_tools(spark: SparkSession) -> DataFrame:
    place, kpi = '"location_code": {"type": "string"}', '"kpi_code": {"type": "string"}'
    return _tools(spark, [("kpi_query", False, f'{{{place}, {kpi}, "net": {{"type": "string", "enum": ["4G", "5G"]}}}}', ["location_code", "kpi_code"]), ("station_info", False, f"{{{place}}}", ["location_code"])])


def references(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("location_code", f"L{i}") for i in range(20)] + [("kpi_code", f"K{i}") for i in range(5)], "param string, code string")


def read_only_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = F.concat(F.lit("L"), (F.col("size") % 25).cast("string"))
    kpi = lambda net="4G", code="K1": _call("kpi_query", _args(location_code=place, kpi_code=code, net=net))
    info = _call("station_info", _args(location_code=place))
    masked, one, many = _call("func_3", _args(arg_1="L1")), "call_function", "call_functions"
    cases = [
        {"expected_action": one, "gold_call": kpi()},
        {"expected_action": one, "gold_call": kpi(), "output": evaluator.mock_output(spark.range(0), malformed=True)},
        {"expected_action": one, "gold_call": kpi(), "output": _said(kpi("6G"))},
        {"expected_action": one, "gold_call": kpi(), "output": _said(info)},
        {"expected_action": one, "gold_call": masked},
        {"expected_action": one, "gold_call": _call("kpi_query", _args(location_code=place, kpi_code="K1")), "output": _said(kpi("5G", "K2"))},
        {"expected_action": "ask_clarification", "missing_slots": F.array(F.lit("net"))},
        {"expected_action": "abstain", "output": '{"action": "ask_clarification", "asked_slots": ["net"]}'},
        {"expected_action": many, "gold_calls": F.array(kpi(), info), "output": _said(_call("station_info", _args(location_code=PLACEHOLDER)), kpi())},
        {"expected_action": many, "gold_steps": F.array(kpi(), info), "output": _said(kpi(), kpi(), _call("none_such", F.lit("{}")))},
    ]
    tool = f"struct<name:string,deprecated:boolean,params:array<{PARAM}>>"
    mask = F.when(F.col("id") % 10 == 4, F.from_json(F.lit('{"name":"func_3","deprecated":false,"params":[{"name":"arg_1","type":"string","required":true}]}'), tool))
    rows = spread(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").alias("size")))
    return _samples(rows, cases, {"masked_tool": mask, "source": F.lit(REAL_SOURCE)}).drop("size")


_TRANSACTIONAL_SQL = """
    t AS (SELECT c_custkey AS id, c_custkey % 12 AS kase, c_custkey % 11 <> 0 AS here, c_custkey % 5 <> 0 AS ver, c_nationkey % 4 <> 0 AS active FROM customer),
    st AS (SELECT *, CASE WHEN here AND ver THEN 'ok' ELSE 'contract_invalid' END AS pay, CASE WHEN here THEN 'ok' ELSE 'execution_failed' END AS bal, CASE WHEN here AND ver AND active THEN 'ok' ELSE 'contract_invalid' END AS plan FROM t),
    s AS (SELECT *, CASE kase WHEN 0 THEN pay WHEN 2 THEN 'schema_invalid' WHEN 3 THEN pay WHEN 4 THEN 'schema_invalid' WHEN 9 THEN pay WHEN 10 THEN pay WHEN 11 THEN plan END AS s1,
                 CASE kase WHEN 9 THEN bal WHEN 10 THEN 'contract_invalid' WHEN 11 THEN 'contract_invalid' END AS s2, kase IN (0, 2, 3, 4, 9, 10, 11) AS called FROM st),
    m AS (SELECT id, kase, here, ver, active, s1, s2, called,
            CASE WHEN kase IN (0, 2, 3, 4, 5, 6, 9, 10, 11) THEN 1.0 ELSE 0.0 END AS action_accuracy,
            CASE WHEN kase IN (0, 4, 9, 10, 11) THEN 1.0 ELSE 0.0 END AS function_selection_accuracy,
            CASE WHEN kase IN (0, 2, 4, 9, 10, 11) THEN 1.0 WHEN kase = 3 THEN 2.0 / 3 ELSE 0.0 END AS argument_key_f1,
            CASE WHEN kase IN (0, 2, 3, 9) THEN 1.0 WHEN kase = 4 THEN 0.5 WHEN kase IN (10, 11) THEN 0.75 ELSE 0.0 END AS argument_value_accuracy,
            CASE WHEN NOT called OR kase = 4 THEN 0.0 ELSE 1.0 END AS schema_validity,
            CASE WHEN NOT called THEN 0.0 WHEN s2 IS NULL THEN (s1 <> 'contract_invalid')::INT ELSE ((s1 <> 'contract_invalid')::INT + (s2 <> 'contract_invalid')::INT) / 2.0 END AS contract_validity,
            CASE WHEN NOT called THEN 0.0 WHEN s2 IS NULL THEN (s1 = 'ok')::INT ELSE ((s1 = 'ok')::INT + (s2 = 'ok')::INT) / 2.0 END AS execution_success_rate,
            CASE WHEN called AND s1 = 'ok' AND coalesce(s2, 'ok') = 'ok' THEN 1.0 ELSE 0.0 END AS task_success_rate,
            CASE WHEN kase = 2 THEN 1.0 ELSE 0.0 END AS deprecated_tool_call_rate,
            CASE WHEN kase = 6 THEN 1.0 ELSE 0.0 END AS abstention_accuracy,
            CASE WHEN kase = 1 THEN 'format_error' WHEN called THEN CASE WHEN s1 <> 'ok' THEN s1 ELSE coalesce(s2, 'ok') END END AS machine_status FROM s),
    tr AS (SELECT *, CASE WHEN kase = 1 THEN 0.0 WHEN kase = 5 THEN 0.6 + 0.4 * 0.5 WHEN kase IN (6, 7) THEN abstention_accuracy
                 WHEN called THEN 0.10 * action_accuracy + 0.20 * function_selection_accuracy + 0.15 * argument_key_f1 + 0.15 * argument_value_accuracy + 0.15 * schema_validity + 0.15 * contract_validity + 0.10 * execution_success_rate ELSE 0.1 * action_accuracy END AS soft,
                 CASE WHEN kase = 6 THEN 1.0 WHEN called AND action_accuracy = 1 AND function_selection_accuracy = 1 AND argument_key_f1 = 1 AND argument_value_accuracy = 1 AND task_success_rate = 1 THEN 1.0 ELSE 0.0 END AS strict,
                 (CASE WHEN kase IN (2, 4) THEN 1 WHEN kase IN (0, 3, 9, 10, 11) THEN
                    CASE WHEN kase = 11 THEN CASE WHEN NOT here THEN 2 ELSE 2 * (NOT ver)::INT + 2 * (NOT active)::INT + (ver AND active)::INT END
                         ELSE (NOT here OR NOT ver)::INT + CASE WHEN kase = 9 THEN (NOT here)::INT WHEN kase = 10 THEN CASE WHEN NOT here THEN 1 ELSE (NOT ver)::INT + (NOT active)::INT + 1 END ELSE 0 END END ELSE 0 END)::BIGINT AS n_issues,
                 CASE WHEN kase IN (9, 10) AND s1 = 'ok' THEN '{"outstanding_balance":0.0,"paid_amount":' || CASE kase WHEN 9 THEN '60' ELSE '50' END || '}' WHEN kase = 0 AND s1 = 'ok' THEN '{"outstanding_balance":40.0,"paid_amount":10}'
                      WHEN kase = 3 AND s1 = 'ok' THEN '{"outstanding_balance":45.0,"paid_amount":5}' WHEN kase = 11 AND s1 = 'ok' THEN '{"plan_id":"P2","status":"changed"}' END AS first_output,
                 CASE WHEN kase = 9 AND s2 = 'ok' THEN CASE WHEN s1 = 'ok' THEN '{"balance":7.0,"outstanding_balance":0.0}' ELSE '{"balance":7.0,"outstanding_balance":50.0}' END END AS second_output FROM m),
    te AS (SELECT *, CASE WHEN kase = 1 THEN 'format_error' WHEN strict = 1 THEN NULL WHEN kase = 5 THEN 'missing_slot_not_handled' WHEN kase = 7 THEN 'unsafe_or_forbidden_action' WHEN NOT called THEN 'wrong_action'
                               WHEN machine_status <> 'ok' THEN machine_status WHEN kase >= 9 THEN 'multi_call_mismatch' END AS error_type FROM tr)
"""
_METRICS = ["action_accuracy", "function_selection_accuracy", "argument_key_f1", "argument_value_accuracy", "schema_validity", "contract_validity", "execution_success_rate", "task_success_rate", "deprecated_tool_call_rate", "abstention_accuracy"]
_REWARDS_SQL = "round(soft, 6) AS reward_soft, round(strict, 6) AS reward_strict, round(0.5 * soft + 0.5 * strict, 6) AS reward_total"


@plans.query(f"WITH {_TRANSACTIONAL_SQL} SELECT id, {', '.join(f'round({m}::DOUBLE, 6) AS {m}' for m in _METRICS)}, machine_status, error_type, n_issues, first_output, second_output, {_REWARDS_SQL} FROM te")
def evaluate_transactional(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twelve kinds of raw outputs over the customers: test doubles, deprecated and wrong tools, bad values, questions, refusals, call lists whose writes later calls see."""
    out = evaluator.evaluate(transactional_samples(spark, sf_dir), "raw", transactional_tools(spark), contracts(spark), subscribers(spark, sf_dir))
    outputs = [F.try_element_at("execution_output", F.lit(i)).alias(n) for i, n in ((1, "first_output"), (2, "second_output"))]
    return out.select("id", *(F.round(m, 6).alias(m) for m in _METRICS), "machine_status", "error_type", F.size("issues").cast("long").alias("n_issues"), *outputs, "reward_soft", "reward_strict", "reward_total")


_READ_ONLY_SQL = """
    p AS (SELECT p_partkey AS id, p_partkey % 10 AS kase, p_size % 25 >= 20 AS off FROM part),
    pm AS (SELECT *, kase IN (0, 2, 3, 4, 5, 8, 9) AS called,
             CASE WHEN kase IN (1, 7) THEN 0.0 ELSE 1.0 END AS a,
             CASE WHEN kase IN (0, 2, 4, 5, 8) THEN 1.0 WHEN kase = 3 THEN 0.0 WHEN kase = 9 THEN 2.0 / 3 END AS f,
             CASE WHEN kase IN (0, 2, 4, 8) THEN 1.0 WHEN kase = 3 THEN 0.5 WHEN kase = 5 THEN 0.8 WHEN kase = 9 THEN 1.0 END AS kf,
             CASE WHEN kase IN (0, 4, 8) THEN 1.0 WHEN kase = 2 THEN 2.0 / 3 WHEN kase = 3 THEN 1.0 / 3 WHEN kase = 5 THEN 0.5 WHEN kase = 9 THEN 1.0 END AS va,
             CASE WHEN kase IN (0, 3, 4, 5, 8) THEN 1.0 WHEN kase = 2 THEN 0.0 WHEN kase = 9 THEN 2.0 / 3 END AS sv,
             CASE WHEN kase = 1 THEN 'format_error' WHEN kase IN (2) THEN 'schema_invalid' WHEN kase IN (3, 5) THEN 'wrong_call' WHEN kase IN (0, 8) THEN CASE WHEN off THEN 'wrong_call' ELSE 'ok' END
                  WHEN kase = 7 THEN 'wrong_action' WHEN kase = 9 THEN CASE WHEN off THEN 'wrong_call' ELSE 'schema_invalid' END ELSE 'ok' END AS machine_status,
             CASE kase WHEN 1 THEN 'parse_error' WHEN 2 THEN 'invalid_enum' WHEN 3 THEN 'wrong_function' || CASE WHEN off THEN ',invalid_code' ELSE '' END WHEN 5 THEN 'wrong_argument_value,extra_argument' || CASE WHEN off THEN ',invalid_code' ELSE '' END
                  WHEN 0 THEN CASE WHEN off THEN 'invalid_code' ELSE '' END WHEN 8 THEN CASE WHEN off THEN 'invalid_code' ELSE '' END WHEN 9 THEN CASE WHEN off THEN 'invalid_code,invalid_code,' ELSE '' END || 'unknown_tool' ELSE '' END AS codes FROM p),
    pr AS (SELECT *, CASE WHEN kase = 1 THEN 0.0 WHEN kase = 6 THEN 1.0 WHEN kase = 7 THEN 0.0 ELSE 0.15 * a + 0.30 * f + 0.20 * kf + 0.20 * va + 0.15 * sv END AS soft,
                CASE WHEN kase IN (0, 4, 6, 8) THEN 1.0 ELSE 0.0 END AS strict,
                CASE WHEN kase = 1 THEN 'format_error' WHEN kase = 7 THEN 'unsafe_or_forbidden_action' WHEN called AND machine_status <> 'ok' THEN machine_status END AS error_type FROM pm)
"""


@plans.query(
    f"WITH {_READ_ONLY_SQL} SELECT id, round(a, 6) AS action_accuracy, round(f, 6) AS function_selection_accuracy, round(kf, 6) AS argument_key_f1, round(va, 6) AS argument_value_accuracy, round(sv, 6) AS schema_validity, machine_status, error_type, codes, {_REWARDS_SQL} FROM pr"
)
def evaluate_read_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten kinds of raw outputs over the parts: catalogue codes, enums, wrong tools and values, a masked tool, waiting values, call sets."""
    out = evaluator.evaluate_read_only(read_only_samples(spark, sf_dir), "raw", read_only_tools(spark), references(spark))
    metrics = ["action_accuracy", "function_selection_accuracy", "argument_key_f1", "argument_value_accuracy", "schema_validity"]
    return out.select("id", *(F.round(m, 6).alias(m) for m in metrics), "machine_status", "error_type", F.array_join(F.transform("issues", lambda i: i["code"]), ",").alias("codes"), "reward_soft", "reward_strict", "reward_total")


@plans.query(
    f"""WITH {_TRANSACTIONAL_SQL}, {_READ_ONLY_SQL}, u AS (SELECT false AS is_real, machine_status, error_type, soft, strict, kase = 1 AS bad, function_selection_accuracy AS func FROM te UNION ALL SELECT true, machine_status, error_type, soft, strict, kase = 1, f FROM pr)
        SELECT is_real, machine_status, error_type, count(*) AS n, round(avg(round(0.5 * soft + 0.5 * strict, 6)), 5) AS avg_reward, sum((strict = 1)::INT)::BIGINT AS strict_success, sum(bad::INT)::BIGINT AS parse_errors, round(coalesce(avg(func), 0.0), 5) AS func FROM u GROUP BY 1, 2, 3"""
)
def evaluate_routed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both kinds in one table, each sample by its own evaluator; reported by status and error."""
    both = transactional_samples(spark, sf_dir).unionByName(read_only_samples(spark, sf_dir), allowMissingColumns=True)
    tools_of_both = transactional_tools(spark).unionByName(read_only_tools(spark))
    out = evaluator.route(both, "raw", tools_of_both, contracts(spark), subscribers(spark, sf_dir), references(spark))
    return out.groupBy(F.col("read_only").alias("is_real"), "machine_status", "error_type").agg(
        F.count("*").alias("n"), F.round(F.avg("reward_total"), 5).alias("avg_reward"), F.count_if(F.col("reward_strict") == 1).alias("strict_success"),
        F.count_if(F.col("prediction.parse_error").isNotNull()).alias("parse_errors"), F.round(reports.mean_where_present(F.col("function_selection_accuracy")), 5).alias("func"),
    )


@plans.query(
    f"""WITH {_TRANSACTIONAL_SQL},
            g AS (SELECT CASE WHEN kase IN (0, 1) THEN pay WHEN kase IN (2, 3, 8) THEN bal WHEN kase IN (4, 11) THEN plan WHEN kase = 9 THEN CASE WHEN bal <> 'ok' THEN bal ELSE pay END WHEN kase = 10 THEN CASE WHEN pay <> 'ok' THEN pay ELSE plan END END AS machine_status,
                         CASE WHEN kase = 5 THEN 'ask_clarification' WHEN kase IN (6, 7) THEN 'abstain' WHEN kase >= 9 THEN 'call_functions' ELSE 'call_function' END AS expected_action FROM st)
        SELECT expected_action, machine_status, count(*) AS n, sum((coalesce(machine_status, 'ok') = 'ok')::INT)::BIGINT AS strict_success FROM g GROUP BY 1, 2"""
)
def mock_oracle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the test double says scores in full wherever the gold itself is allowed."""
    samples = transactional_samples(spark, sf_dir)
    samples = samples.withColumn("raw", evaluator.mock_output(samples))
    out = evaluator.evaluate(samples, "raw", transactional_tools(spark), contracts(spark), subscribers(spark, sf_dir))
    return out.groupBy("expected_action", "machine_status").agg(F.count("*").alias("n"), F.count_if(F.col("reward_strict") == 1).alias("strict_success"))


#: A defect a case: what the sample has besides the plain ones, the audit's findings, and the verifier's first failing layer.
_PLAIN = '{"location_code":"L0","kpi_code":"K1","from_date":"2024-01-01","to_date":"2024-01-31"}'


def _with(**changes: str | None) -> str:
    args = json.loads(_PLAIN) | {k: v for k, v in changes.items() if v is not None}
    return json.dumps({k: v for k, v in args.items() if not (k in changes and changes[k] is None)})


def _gold(arguments: str = _PLAIN, tool: str = "kpi_query") -> tuple[str, str]:
    return tool, arguments


DEFECTS: list[tuple[dict[str, object], list[str], str]] = [
    ({"gold_call": _gold()}, [], "kept"),
    ({"gold_call": _gold(), "instruction": " short "}, ["short_instruction"], "schema_fail"),
    ({}, ["missing_gold_call"], "schema_fail"),
    ({"expected_action": "call_functions"}, ["missing_gold_calls"], "schema_fail"),
    ({"expected_action": "ask_clarification", "missing_slots": []}, ["missing_clar_fields"], "schema_fail"),
    ({"expected_action": "abstain"}, ["missing_abstain_reason"], "kept"),
    ({"gold_call": _gold(tool="nope")}, ["unknown_tool"], "schema_fail"),
    ({"gold_call": _gold(_with(kpi_code=None))}, ["schema_invalid_gold"], "schema_fail"),
    ({"gold_call": _gold(tool="old_kpi")}, [], "schema_fail"),
    ({"gold_call": _gold(_with(object_code="X"))}, ["object_code_off_catalogue"], "schema_fail"),
    ({"gold_call": _gold(_with(location_code="ZZ"))}, ["location_code_off_catalogue"], "kept"),
    ({"gold_call": _gold(_with(kpi_code="ZZ"))}, ["kpi_code_off_catalogue"], "kept"),
    ({"gold_call": _gold(_with(unit_code="ZZ"))}, ["unit_code_off_catalogue"], "kept"),
    ({"gold_call": _gold(_with(station_code="ZZ"))}, ["station_code_off_catalogue"], "schema_fail"),
    ({"gold_call": _gold(_with(from_date="soon", to_date="later"))}, ["bad_date_format", "bad_date_format"], "date_fail"),
    ({"gold_call": _gold(_with(from_date="2024-02-01"))}, ["from_after_to"], "date_fail"),
    ({"gold_call": _gold(), "instruction": "figures of Da Nang today"}, ["city_code_mismatch"], "city_fail"),
    ({"gold_call": _gold(_with(station_code=PLACEHOLDER))}, ["placeholder_leak"], "kept"),
    ({"expected_action": "call_functions", "gold_steps": [_gold(), _gold(_with(station_code=PLACEHOLDER))]}, [], "kept"),
    ({"gold_call": _gold(tool="func_2"), "masked_tool": "func_1", "scenario_family": "masking"}, ["unknown_tool", "masked_name_mismatch", "masked_name_not_in_instruction"], "schema_fail"),
    ({"gold_call": _gold("{}", "func_0"), "masked_tool": "func_0", "scenario_family": "masking", "instruction": "use func_0 for that"}, ["masked_no_schema"], "kept"),
    ({"expected_action": "ask_clarification", "missing_slots": ["from_date"], "checker_call": _gold(_with(to_date=None))}, ["missing_slot_not_required", "missing_slot_present_in_checker", "date_pair_incomplete", "clarification_checker_actually_valid"], "schema_fail"),
    ({"expected_action": "ask_clarification", "missing_slots": ["kpi_code"], "checker_call": _gold(_with(kpi_code=None))}, [], "kept"),
    ({"gold_call": _gold(), "instruction": "figures of Hue and Hanoiville today"}, [], "kept"),
    ({"gold_call": _gold(_with(object_code="S1", station_code="S2", unit_code="U1", location_code="L1")), "instruction": "figures of da nang today"}, [], "kept"),
]


def defect_samples(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Events as samples, a defect after the other; tools, reference codes and location names."""
    text = '{"type": "string"}'
    props = "{" + ", ".join(f'"{k}": {text}' for k in ("location_code", "kpi_code", "unit_code", "station_code", "object_code", "from_date", "to_date")) + "}"
    known = _tools(spark, [("kpi_query", False, props, ["location_code", "kpi_code"]), ("old_kpi", True, props, [])])
    codes = spark.createDataFrame([(p, c) for p, cs in {"location_code": ("L0", "L1", "L9"), "kpi_code": ("K1",), "unit_code": ("U1",), "station_code": ("S1", "S2")}.items() for c in cs], "param string, code string")
    names = spark.createDataFrame([("Hanoi", "L0"), (" Da Nang", "L1"), ("Hue", "L9")], "name string, code string")
    tool = f"struct<name:string,deprecated:boolean,params:array<{PARAM}>>"
    kinds = f"turn int, instruction string, scenario_family string, expected_action string, gold_call {CALL}, gold_calls array<{CALL}>, gold_steps array<{CALL}>, missing_slots array<string>, checker_call {CALL}, reason string, masked_tool {tool}"
    rows = []
    for i, (case, _, _) in enumerate(DEFECTS):
        mask = case.get("masked_tool")
        params = [("location_code", "string", False, None, None, None, None)] if mask == "func_1" else []
        rows.append((i, case.get("instruction", "show the figures please"), case.get("scenario_family", "single_step_valid"), case.get("expected_action", "call_function"), case.get("gold_call"), None, case.get("gold_steps"), case.get("missing_slots"), case.get("checker_call"), None, mask and (mask, False, params)))
    events = spread(table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), (F.col("user_id") % 3).alias("file"), (F.col("event_id") % len(DEFECTS)).cast("int").alias("turn")))
    return events.join(F.broadcast(spark.createDataFrame(rows, kinds)), "turn"), known, codes, names  # a row a case


def _values(rows: list[tuple[int, str]]) -> str:
    return ", ".join(f"({i}, '{x}')" for i, x in rows)


@plans.query(f"""SELECT user_id % 3 AS file, "check", count(*) AS n FROM events JOIN (VALUES {_values([(i, c) for i, (_, found, _) in enumerate(DEFECTS) for c in found])}) AS d(turn, "check") ON event_id % {len(DEFECTS)} = turn GROUP BY 1, 2""")
def audit_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failed row checks by file and check: every check of the audit has a case."""
    return audit.audit(*defect_samples(spark, sf_dir)).groupBy("file", "check").agg(F.count("*").alias("n"))


@plans.query(
    f"""SELECT CASE WHEN outcome = 'kept' AND family = 'single_step_valid' AND event_id % 7 = 0 THEN 'semantic_fail' ELSE outcome END AS outcome, count(*) AS n
        FROM (SELECT event_id, outcome, CASE WHEN turn IN ({", ".join(str(i) for i, (case, _, _) in enumerate(DEFECTS) if case.get("scenario_family") == "masking")}) THEN 'masking' ELSE 'single_step_valid' END AS family
              FROM events JOIN (VALUES {_values([(i, x) for i, (_, _, x) in enumerate(DEFECTS)])}) AS d(turn, outcome) ON event_id % {len(DEFECTS)} = turn) GROUP BY 1"""
)
def verify_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples by the first verification layer that they fail: schema, codes, dates, city, a judge's verdict."""
    samples, known, codes, names = defect_samples(spark, sf_dir)
    judged = samples.withColumn("verdict", F.col("id") % 7 != 0)
    return reports.funnel(audit.verify(judged, known, codes, names, "verdict"), "first_fail")


def _phrase_of(case: dict[str, object]) -> str:
    """Family, primary tool and words of a case's instruction."""
    call = case.get("gold_call") or (case.get("gold_steps") or [None])[0] or case.get("checker_call") or ("", "")
    words = sorted(set(case.get("instruction", "show the figures please").lower().split()))
    return "|".join((case.get("scenario_family", "single_step_valid"), call[0], *words))


@plans.query(
    f"""SELECT user_id % 3 AS file, count(*) AS n, count(*) - count(DISTINCT phrase) AS duplicates FROM events
        JOIN (VALUES {_values([(i, _phrase_of(case)) for i, (case, _, _) in enumerate(DEFECTS)])}) AS d(turn, phrase) ON event_id % {len(DEFECTS)} = turn GROUP BY 1"""
)
def file_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Instructions that a file repeats within family and primary tool, as token sets."""
    return audit.repeated_instructions(defect_samples(spark, sf_dir)[0]).select("file", "n", "duplicates")
