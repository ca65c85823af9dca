"""Validation queries: events as calls against a literal registry, orders against contract rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from toolloom.functions import scores as S
from toolloom.functions.json import args_map
from toolloom.functions.text import is_date
from toolloom.operators import audit, executor, pairing, reports, scoring, validation
from toolloom.operators.registry import tools
from toolloom.plans.base import Plans, table

plans = Plans()

#: name, description, deprecated, properties of the literal registry; ``view`` comes twice, the last wins; ``error`` is unknown.
REGISTRY = [
    ("click", "a click", False, '{"k": {"type": "integer", "enum": [1, 2, 3, 5, 8, 13, 21, 34, 55, 89]}}', ["k"]),
    ("view", "an old view", True, "{}", []),
    ("view", "a view", False, '{"k": {"type": "string", "pattern": "[0-9]+"}, "page": {"type": "string"}}', ["k", "page"]),
    ("signup", "a signup", True, '{"k": {"type": "integer"}}', []),
    ("purchase", "a purchase", False, '{"amount": {"type": "number"}}', ["amount"]),
]


def registry(spark: SparkSession) -> DataFrame:
    rows = [(i, n, d, x, p, r) for i, (n, d, x, p, r) in enumerate(REGISTRY)]
    raw = spark.createDataFrame(rows, "pos int, name string, description string, deprecated boolean, properties string, required array<string>")
    return tools(raw.select("pos", "name", "description", "deprecated", F.struct("required", F.from_json("properties", "map<string,variant>").alias("properties")).alias("parameters")))


def validated(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("tool_name"), F.col("props").alias("arguments"))
    return validation.validate_calls(calls, registry(spark), ["event_id"])


_ISSUES_SQL = """
    WITH e AS (SELECT event_id, event_type, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events),
    i AS (
        SELECT event_id, event_type, 0 AS issue_ix, 'unknown_tool' AS code, 'tool_name' AS path FROM e WHERE event_type = 'error'
        UNION ALL SELECT event_id, event_type, 0, 'deprecated_tool', 'tool_name' FROM e WHERE event_type = 'signup'
        UNION ALL SELECT event_id, event_type, 0, 'invalid_enum', 'arguments.k' FROM e WHERE event_type = 'click' AND k NOT IN (1, 2, 3, 5, 8, 13, 21, 34, 55, 89)
        UNION ALL SELECT event_id, event_type, 0, 'missing_arg', 'arguments.page' FROM e WHERE event_type = 'view'
        UNION ALL SELECT event_id, event_type, 1, 'invalid_type', 'arguments.k' FROM e WHERE event_type = 'view'
        UNION ALL SELECT event_id, event_type, 0, 'missing_arg', 'arguments.amount' FROM e WHERE event_type = 'purchase'
        UNION ALL SELECT event_id, event_type, 1, 'unknown_arg', 'arguments.k' FROM e WHERE event_type = 'purchase')
"""


@plans.query(_ISSUES_SQL + "SELECT event_id, issue_ix, code, path FROM i")
def schema_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validation.long(validated(spark, sf_dir), ["event_id"], "schema_issues").select("event_id", "issue_ix", "code", "path")


@plans.query(
    _ISSUES_SQL
    + """, ranked AS (SELECT event_type, code, event_id, row_number() OVER (PARTITION BY event_type, code ORDER BY event_id) AS r FROM (SELECT DISTINCT event_type, code, event_id FROM i))
       SELECT event_type AS tool_name, code, n, examples FROM (SELECT event_type, code, count(*) AS n FROM i GROUP BY 1, 2)
       JOIN (SELECT event_type, code, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY event_id) AS examples FROM ranked WHERE r <= 2 GROUP BY 1, 2) USING (event_type, code)"""
)
def schema_issue_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.issue_counts(validation.long(validated(spark, sf_dir), ["event_id", "tool_name"], "schema_issues"), ["tool_name", "code"], "event_id")


@plans.query(
    """WITH t(tool_name, deprecated) AS (VALUES ('click', false), ('view', false), ('signup', true), ('purchase', false))
       SELECT event_type AS tool_name, t.tool_name IS NULL AS unknown, coalesce(deprecated, false) AS deprecated, count(*) AS n FROM events LEFT JOIN t ON event_type = t.tool_name GROUP BY 1, 2, 3"""
)
def registry_left_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = table(spark, sf_dir, "events").select(F.col("event_type").alias("tool_name"))
    joined = validation.with_tool(calls, registry(spark))
    return joined.groupBy("tool_name", F.col("tool").isNull().alias("unknown"), F.coalesce("tool.deprecated", F.lit(False)).alias("deprecated")).agg(F.count("*").alias("n"))


#: tool, verified, rules (path, op, value as JSON text)
CONTRACTS = [
    ("P", True, [("args.status", "in", '["P", "O"]'), ("subscriber.balance", "gte", "0"), ("subscriber.segment", "ne", '"BUILDING"')]),
    ("F", False, [("args.price", "lte", "300000"), ("subscriber.nation", "eq", "3"), ("args.nation", "ne_path", '"subscriber.nation"')]),
    ("O", False, [("args.custkey", "eq_path", '"subscriber.key"')]),
]


def contracted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as calls whose tool is their status, customers as state; every seventh customer has none."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    people = table(spark, sf_dir, "customer").where(F.col("c_custkey") % 7 != 0)
    state = F.create_map(F.lit("balance"), F.col("c_acctbal").cast("string"), F.lit("segment"), F.concat(F.lit('"'), "c_mktsegment", F.lit('"')), F.lit("nation"), F.col("c_nationkey").cast("string"), F.lit("key"), F.col("c_custkey").cast("string"))
    rules = spark.createDataFrame([(t, v, [(p, o, x, None) for p, o, x in r]) for t, v, r in CONTRACTS], "tool string, verified boolean, rules array<struct<path:string,op:string,value:string,message:string>>")
    dims = rules.select(F.col("tool").alias("o_orderstatus"), F.struct("verified", "rules").alias("contract"))
    args = F.to_json(F.struct(F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price"), F.col("o_custkey").alias("custkey"), (F.col("o_orderkey") % 25).cast("int").alias("nation")))
    joined = orders.join(people.select(F.col("c_custkey").alias("o_custkey"), state.alias("state")), "o_custkey", "left").join(dims, "o_orderstatus", "left")
    issues = validation.contract_issues(F.col("contract"), F.col("state"), args_map(args), F.col("o_orderkey") % 3 != 0)
    return joined.select("o_orderkey", F.col("o_orderstatus").alias("tool_name"), "o_custkey", issues.alias("issues"))


_CONTRACT_SQL = """
    WITH x AS (SELECT o_orderkey, o_orderstatus, o_custkey, o_totalprice, c_custkey, c_acctbal, c_mktsegment, c_nationkey FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND c_custkey % 7 <> 0),
    i AS (
        SELECT o_orderkey, o_orderstatus, 'missing_subscriber' AS code, 'subscriber' AS path FROM x WHERE c_custkey IS NULL
        UNION ALL SELECT o_orderkey, o_orderstatus, 'permission_denied', 'customer_verified' FROM x WHERE c_custkey IS NOT NULL AND o_orderstatus = 'P' AND o_orderkey % 3 = 0
        UNION ALL SELECT o_orderkey, o_orderstatus, 'precondition_failed', 'subscriber.balance' FROM x WHERE c_custkey IS NOT NULL AND o_orderstatus = 'P' AND NOT c_acctbal >= 0
        UNION ALL SELECT o_orderkey, o_orderstatus, 'precondition_failed', 'subscriber.segment' FROM x WHERE c_custkey IS NOT NULL AND o_orderstatus = 'P' AND c_mktsegment = 'BUILDING'
        UNION ALL SELECT o_orderkey, o_orderstatus, 'precondition_failed', 'args.price' FROM x WHERE c_custkey IS NOT NULL AND o_orderstatus = 'F' AND o_totalprice > 300000
        UNION ALL SELECT o_orderkey, o_orderstatus, 'precondition_failed', 'subscriber.nation' FROM x WHERE c_custkey IS NOT NULL AND o_orderstatus = 'F' AND c_nationkey <> 3
        UNION ALL SELECT o_orderkey, o_orderstatus, 'precondition_failed', 'args.nation' FROM x WHERE c_custkey IS NOT NULL AND o_orderstatus = 'F' AND c_nationkey = o_orderkey % 25)
"""


@plans.query(_CONTRACT_SQL + "SELECT o_orderkey, code, path FROM i")
def contract_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validation.long(contracted(spark, sf_dir), ["o_orderkey"], "issues").select("o_orderkey", "code", "path")


@plans.query(_CONTRACT_SQL + "SELECT o_orderstatus AS tool_name, count(*) AS denied FROM i WHERE code = 'permission_denied' GROUP BY 1")
def permission_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contracted(spark, sf_dir).where(F.exists("issues", lambda i: i["code"] == "permission_denied")).groupBy("tool_name").agg(F.count("*").alias("denied"))


@plans.query(
    _CONTRACT_SQL
    + """, s AS (SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN 'schema_invalid' WHEN o_orderkey IN (SELECT o_orderkey FROM i) THEN 'contract_invalid' WHEN o_orderkey % 4 = 1 THEN 'execution_failed' ELSE 'ok' END AS status FROM orders)
       SELECT status, count(*) AS n FROM s GROUP BY 1"""
)
def call_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    bad = F.when(F.col("o_orderkey") % 10 == 0, F.array(validation.issue("unknown_tool", F.col("tool_name"), F.lit("")))).otherwise(validation.none_of())
    tool = F.when(F.col("o_orderkey") % 4 == 1, "reboot").otherwise("get_balance")
    error = executor.execution_error(tool, F.lit(True))
    return contracted(spark, sf_dir).groupBy(validation.call_status(bad, F.col("issues"), error).alias("status")).agg(F.count("*").alias("n"))


@plans.query(
    """SELECT c_custkey AS customer_id, count(*) AS n_payments, round(greatest(0.0, c_acctbal * 100 - sum(o_totalprice)), 2) AS outstanding, 'F' = min(o_orderstatus) AS any_f
       FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_custkey, c_acctbal"""
)
def state_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as payments, folded in order over each customer's state."""
    c = F.col
    orders = table(spark, sf_dir, "orders").select("o_orderkey", c("o_custkey").cast("string").alias("customer_id"), "o_totalprice", "o_orderstatus")
    calls = orders.select("customer_id", c("o_orderkey").alias("pos"), F.lit("pay_bill").alias("tool_name"), F.to_json(F.struct(c("o_totalprice").alias("amount"))).alias("arguments"))
    counted = orders.groupBy(c("customer_id").alias("_id")).agg(F.count("*").alias("n_payments"), F.min("o_orderstatus").alias("least"))
    made = F.struct(c("c_custkey").cast("string").alias("customer_id"), F.lit("active").alias("status"), (c("c_acctbal") * 100).alias("outstanding_balance"))
    people = table(spark, sf_dir, "customer").select(c("c_custkey").cast("string").alias("customer_id"), F.from_json(F.to_json(made), executor.STATE).alias("state"))
    after = executor.fold_table(people, calls).join(counted, c("customer_id") == c("_id"))
    return after.select(c("customer_id").cast("long").alias("customer_id"), "n_payments", F.round("state.outstanding_balance", 2).alias("outstanding"), (c("least") == "F").alias("any_f"))


#: The tools that customers call in turn: all that are supported and an unknown one.
TOOLS_IN_TURN = [*sorted([*executor.OUTPUTS, *executor.LOOKUPS]), "reboot"]


def _answers_sql() -> str:
    """All tools in turn over the customers, with one that is unknown; every eleventh customer is no subscriber."""
    k = "CAST(c_custkey AS VARCHAR)"
    answers = {
        "get_balance": f"'{{\"balance\":' || CAST(c_nationkey AS VARCHAR) || '.0,\"outstanding_balance\":20.0}}'",
        "get_current_plan": "'{\"plan_id\":\"' || c_mktsegment || '\",\"status\":\"active\"}'",
        "get_usage": "'{\"data_used_gb\":0.0,\"voice_minutes\":' || CAST(c_nationkey AS VARCHAR) || '}'",
        "get_customer_profile": f"'{{\"customer_id\":\"' || {k} || '\",\"status\":\"active\",\"plan_id\":\"' || c_mktsegment || '\",\"billing_email\":null}}'",
        "add_data_package": "'{\"package_code\":\"D' || CAST(c_nationkey AS VARCHAR) || '\",\"status\":\"queued\"}'",
        "change_plan": "'{\"plan_id\":\"P2\",\"status\":\"changed\"}'",
        "suspend_line": "'{\"status\":\"suspended\",\"reason\":\"lost\"}'",
        "resume_line": "'{\"status\":\"active\"}'",
        "cancel_subscription": "'{\"status\":\"cancelled\"}'",
        "report_lost_sim": "'{\"lost_sim_reported\":true}'",
        "update_billing_email": "'{\"billing_email\":\"a@b.c\"}'",
        "enable_roaming": "'{\"roaming_enabled\":true,\"country\":\"FR\"}'",
        "disable_roaming": "'{\"roaming_enabled\":false}'",
        "pay_bill": "'{\"outstanding_balance\":' || CAST(greatest(0, 20 - c_nationkey) AS VARCHAR) || '.0,\"paid_amount\":' || CAST(c_nationkey AS VARCHAR) || '}'",
        "activate_esim": "'{\"esim_active\":true,\"eid\":\"E1\"}'",
        "replace_sim": "'{\"sim_type\":\"esim\",\"status\":\"replacement_queued\"}'",
        "open_support_ticket": f"'{{\"ticket_id\":\"T0001\",\"customer_id\":\"' || {k} || '\",\"category\":\"billing\",\"priority\":\"normal\"}}'",
        "close_support_ticket": "'{\"ticket_id\":\"T0009\",\"status\":\"closed\"}'",
        "check_network_status": "CASE WHEN c_nationkey < 20 THEN '{\"area_code\":\"' || CAST(c_nationkey AS VARCHAR) || '\",\"status\":\"' || (SELECT n_name FROM nation WHERE n_nationkey = c_nationkey) || '\",\"incident\":null}' ELSE '{\"area_code\":\"' || CAST(c_nationkey AS VARCHAR) || '\",\"status\":\"unknown\"}' END",
        "list_available_plans": "(SELECT '{\"plans\":[' || string_agg('{\"plan_id\":\"' || r_name || '\",\"monthly_fee\":' || CAST(r_regionkey AS VARCHAR) || '}', ',' ORDER BY r_name) || ']}' FROM region)",
        "send_otp": "'{\"otp_sent\":true,\"channel\":\"sms\"}'",
        "verify_otp": "'{\"verified\":' || CASE WHEN c_nationkey = 3 THEN 'true' ELSE 'false' END || '}'",
        "apply_late_fee_waiver": "'{\"waiver_applied\":true,\"amount\":' || CAST(c_nationkey AS VARCHAR) || '}'",
        "increase_credit_limit": "'{\"credit_limit\":500}'",
        "set_spending_limit": "'{\"spending_limit\":70}'",
        "block_premium_sms": "'{\"premium_sms_blocked\":true}'",
        "unblock_premium_sms": "'{\"premium_sms_blocked\":false}'",
        "register_autopay": "'{\"autopay_enabled\":true}'",
        "remove_autopay": "'{\"autopay_enabled\":false}'",
        "transfer_ownership": f"'{{\"owner_id\":\"' || CAST(c_custkey + 1 AS VARCHAR) || '\"}}'",
    }
    rows = " ".join(f"WHEN {i} THEN {answers[name]}" for i, name in enumerate(TOOLS_IN_TURN) if name in answers)
    return f"""SELECT c_custkey, CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE CASE c_custkey % {len(TOOLS_IN_TURN)} {rows} END END AS output,
                      CASE WHEN c_custkey % 11 = 0 THEN 'Subscriber not found: ' || {k} WHEN c_custkey % {len(TOOLS_IN_TURN)} = {TOOLS_IN_TURN.index("reboot")} THEN 'Unsupported tool: reboot' END AS error FROM customer"""



@plans.query(_answers_sql())
def executor_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers and errors of every tool, nations as areas and regions as plans."""
    c = F.col
    people = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    made = F.struct(c("c_custkey").cast("string").alias("customer_id"), F.lit("active").alias("status"), c("c_mktsegment").alias("plan_id"), c("c_nationkey").cast("double").alias("balance"), F.lit(20.0).alias("outstanding_balance"), c("c_nationkey").alias("voice_minutes"))
    state = F.when(c("c_custkey") % 11 != 0, F.from_json(F.to_json(made), executor.STATE))
    tool = F.element_at(F.array(*map(F.lit, TOOLS_IN_TURN)), (c("c_custkey") % len(TOOLS_IN_TURN)).cast("int") + 1)
    area = c("c_nationkey").cast("string")
    args = F.struct(
        c("c_custkey").cast("string").alias("customer_id"), F.when(c("c_nationkey") == 3, executor.TEST_CODE).otherwise("0").alias("otp"), c("c_nationkey").alias("amount"), area.alias("area_code"),
        F.concat(F.lit("D"), area).alias("package_code"), (c("c_custkey") + 1).cast("string").alias("new_owner_id"), F.lit(500).alias("new_limit"), F.lit(70).alias("limit"),
        *(F.lit(v).alias(k) for k, v in {"new_plan": "P2", "reason": "lost", "email": "a@b.c", "country": "FR", "eid": "E1", "sim_type": "esim", "category": "billing", "ticket_id": "T0009", "channel": "sms"}.items()),
    )
    networks = table(spark, sf_dir, "nation").where("n_nationkey < 20").select(c("n_nationkey").cast("string").alias("area_code"), c("n_name").alias("status"), F.lit(None).cast("string").alias("incident"))
    fees = table(spark, sf_dir, "region").select(c("r_name").alias("plan_id"), c("r_regionkey").alias("monthly_fee"))
    calls = people.select("c_custkey", state.alias("state"), tool.alias("tool"), args_map(F.to_json(args)).alias("args")).crossJoin(F.broadcast(executor.lookups(networks, fees)))  # one row
    answer = executor.output(c("state"), c("tool"), c("args"), c("networks"), c("plans"))
    return calls.select("c_custkey", answer.alias("output"), executor.execution_error(c("tool"), c("state"), c("c_custkey").cast("string")).alias("error"))


@plans.query(
    """WITH s AS (SELECT CAST(s_suppkey AS VARCHAR) AS code, s_nationkey AS loc, s_name AS name, row_number() OVER (PARTITION BY s_nationkey ORDER BY CAST(s_suppkey AS VARCHAR)) AS r, row_number() OVER (ORDER BY CAST(s_suppkey AS VARCHAR)) AS a FROM supplier WHERE s_nationkey % 5 <> 0),
            l AS (SELECT loc, count(*) AS n, string_agg(code || ':' || name, ',' ORDER BY code) AS held FROM s WHERE r <= 3 GROUP BY loc),
            w AS (SELECT count(*) AS n, string_agg(code || ':' || name, ',' ORDER BY code) AS held FROM s WHERE a <= 3)
       SELECT c_custkey AS id, coalesce(l.n, w.n) AS n, coalesce(l.held, w.held) AS stations, CASE c_custkey % 5 WHEN 1 THEN 'tilt_deg' WHEN 2 THEN 'antenna_height_m' WHEN 3 THEN 'distance_km' ELSE 'status' END AS field, true AS in_range
       FROM customer LEFT JOIN l ON c_nationkey = l.loc, w"""
)
def build_observation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stations (suppliers) that a listing by location shows, those of the whole catalogue where it has none; one attribute by the query's kind."""
    stations = table(spark, sf_dir, "supplier").where("s_nationkey % 5 <> 0").select(F.col("s_suppkey").cast("string").alias("station_code"), F.col("s_nationkey").cast("string").alias("location_code"), F.col("s_name").alias("name"))
    kind = F.element_at(F.array(F.lit(None).cast("string"), *map(F.lit, ("tilt", "antenna_height", "station_distance", "none such"))), (F.col("c_custkey") % 5).cast("int") + 1)
    calls = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").cast("string").alias("location"), kind.alias("query_type"))
    seen = executor.observation(calls, stations).withColumn("o", F.from_json("observation", "count int, location string, stations array<map<string,string>>"))
    field = F.array_except(F.map_keys(F.col("o.stations")[0]), F.array(F.lit("station_code"), F.lit("name")))[0]
    values = F.transform("o.stations", lambda s: F.try_element_at(s, field))
    ranges = {f: [str(v) for v in x] for f, x in executor.ATTRIBUTES.values()}
    fits = F.lit(False)
    for f, allowed in ranges.items():
        fits = fits | ((field == f) & (F.size(F.array_except(values, F.array(*map(F.lit, dict.fromkeys(allowed))))) == 0))
    return seen.select("id", F.col("o.count").cast("long").alias("n"), F.array_join(F.transform("o.stations", lambda s: F.concat(s["station_code"], F.lit(":"), s["name"])), ",").alias("stations"), field.alias("field"), (fits & (F.col("o.location") == F.col("location"))).alias("in_range"))


# Each line of an order and the next one as predicted and gold arguments.
_ARGS_SQL = """
    WITH v AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS r, l_returnflag AS a, CASE WHEN l_tax > 0.02 THEN l_linestatus END AS b, CASE WHEN l_discount > 0.05 THEN CAST(l_quantity AS INT) % 3 END AS c, l_returnflag || l_linestatus AS tool FROM lineitem),
    p AS (SELECT l_orderkey, x.r AS pos, x.a AS pa, x.b AS pb, x.c AS pc, y.a AS ga, y.b AS gb, y.c AS gc, x.tool AS ptool, y.tool AS gtool FROM v x JOIN v y USING (l_orderkey) WHERE y.r = x.r + 1),
    k AS (SELECT *, 1 + (pb IS NOT NULL)::INT + (pc IS NOT NULL)::INT AS np, 1 + (gb IS NOT NULL)::INT + (gc IS NOT NULL)::INT AS ng,
                 1 + (pb IS NOT NULL AND gb IS NOT NULL)::INT + (pc IS NOT NULL AND gc IS NOT NULL)::INT AS nb FROM p)
"""


def argument_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``l_orderkey, pos, ptool, gtool, p, g``: argument maps of each line of an order and of the next one; null arguments are absent."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")  # seven lines an order at most
    args = F.to_json(F.struct(F.col("l_returnflag").alias("a"), F.when(F.col("l_tax") > 0.02, F.col("l_linestatus")).alias("b"), F.when(F.col("l_discount") > 0.05, F.col("l_quantity").cast("int") % 3).alias("c")))
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", F.concat("l_returnflag", "l_linestatus").alias("ptool"), args.alias("pargs"), F.row_number().over(order).cast("long").alias("pos"), F.lead(F.concat("l_returnflag", "l_linestatus")).over(order).alias("gtool"), F.lead(args).over(order).alias("gargs"))
    return line.where("gtool is not null").select("l_orderkey", "pos", "ptool", "gtool", args_map(F.col("pargs")).alias("p"), args_map(F.col("gargs")).alias("g"))


@plans.query(_ARGS_SQL + "SELECT l_orderkey, pos, round(2.0 * nb / (np + ng), 6) AS key_f1 FROM k")
def key_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return argument_pairs(spark, sf_dir).select("l_orderkey", "pos", F.round(S.key_f1(F.col("p"), F.col("g")), 6).alias("key_f1"))


@plans.query(_ARGS_SQL + "SELECT l_orderkey, pos, round(((pa = ga)::INT + coalesce(pb = gb, false)::INT + coalesce(pc = gc, false)::INT) / ng, 6) AS value_accuracy FROM k")
def value_acc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return argument_pairs(spark, sf_dir).select("l_orderkey", "pos", F.round(S.value_accuracy(F.col("p"), F.col("g")), 6).alias("value_accuracy"))


@plans.query(
    _ARGS_SQL
    + """, d AS (
        SELECT l_orderkey, 'wrong_function' AS code, ptool AS path FROM p WHERE ptool <> gtool
        UNION ALL SELECT l_orderkey, CASE WHEN px IS NULL THEN 'missing_argument' WHEN gx IS NULL THEN 'extra_argument' ELSE 'wrong_argument_value' END, 'arguments.' || nm
        FROM (SELECT l_orderkey, 'a' AS nm, pa AS px, ga AS gx FROM p WHERE ptool = gtool UNION ALL SELECT l_orderkey, 'b', pb, gb FROM p WHERE ptool = gtool UNION ALL SELECT l_orderkey, 'c', CAST(pc AS VARCHAR), CAST(gc AS VARCHAR) FROM p WHERE ptool = gtool)
        WHERE px IS DISTINCT FROM gx)
       SELECT code, path, count(*) AS n, min(l_orderkey) AS first_order FROM d GROUP BY 1, 2"""
)
def arg_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    found = argument_pairs(spark, sf_dir).select("l_orderkey", validation.gold_issues(c("ptool"), c("p"), c("gtool"), c("g"), reveal=True).alias("issues"))
    return validation.long(found, ["l_orderkey"], "issues").groupBy("code", "path").agg(F.count("*").alias("n"), F.min("l_orderkey").alias("first_order"))


@plans.query("SELECT c_nationkey, count(*) AS n FROM customer WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey < 3) AND c_custkey % 5 <> 0 GROUP BY 1")
def code_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes that the catalogue lacks; a placeholder is never one of them."""
    valid = table(spark, sf_dir, "nation").where("n_regionkey < 3").agg(F.map_from_arrays(F.array(F.lit("location_code")), F.array(F.collect_list(F.col("n_nationkey").cast("string")))).alias("catalogues"))
    value = F.when(F.col("c_custkey") % 5 == 0, validation.PLACEHOLDER).otherwise(F.col("c_nationkey").cast("string"))
    calls = table(spark, sf_dir, "customer").select("c_nationkey", args_map(F.to_json(F.struct(value.alias("location_code")))).alias("args"))
    found = calls.crossJoin(F.broadcast(valid)).select("c_nationkey", validation.code_issues(F.col("args"), F.col("catalogues")).alias("issues"))  # one row of catalogues
    return validation.long(found, ["c_nationkey"], "issues").groupBy("c_nationkey").agg(F.count("*").alias("n"))


@plans.query("SELECT p_partkey, count(*) AS n_names, min(w) AS first_name FROM part, (VALUES ('ring'), ('widget'), ('blue'), ('small'), ('red')) AS t(w) WHERE regexp_matches(lower(p_name), '(^|[^\\p{L}\\p{N}_])' || w || '([^\\p{L}\\p{N}_]|$)') AND length(w) >= 4 GROUP BY 1")
def name_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalogue names of four letters or more as whole words in part names."""
    names = spark.createDataFrame([(w, w) for w in ("ring", "widget", "blue", "small", "red")], "name string, code string")
    found = audit.with_named(table(spark, sf_dir, "part").select("p_partkey", "p_name"), "p_name", names, name="m").withColumn("m", F.col("m.code"))
    return found.where("size(m) > 0").select("p_partkey", F.size("m").cast("long").alias("n_names"), F.array_min("m").alias("first_name"))


@plans.query(
    """SELECT bad_form, reversed, count(*) AS n FROM (
         SELECT o_orderkey % 13 = 0 AS bad_form, o_orderkey % 13 <> 0 AND strftime(l_shipdate, '%Y-%m-%d') < strftime(o_orderdate, '%Y-%m-%d') AS reversed FROM lineitem JOIN orders ON l_orderkey = o_orderkey) GROUP BY 1, 2"""
)
def date_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", F.date_format("l_shipdate", "yyyy-MM-dd").alias("to_date"))
    order = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 13 == 0, F.date_format("o_orderdate", "dd/MM/yyyy")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("from_date"))
    both = line.join(order, F.col("l_orderkey") == F.col("o_orderkey"))
    return both.groupBy((~is_date(F.col("from_date"))).alias("bad_form"), (is_date(F.col("from_date")) & (F.col("from_date") > F.col("to_date"))).alias("reversed")).agg(F.count("*").alias("n"))


# An order's lines in two orders as gold and predicted calls.
_CALLS_SQL = """
    WITH g AS (SELECT l_orderkey AS id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS pos, l_returnflag || l_linestatus AS tool, CAST(l_quantity AS INT) % 2 AS q FROM lineitem),
    p AS (SELECT l_orderkey AS id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS pos, CASE WHEN l_partkey % 4 = 0 THEN 'XX' ELSE l_returnflag || l_linestatus END AS tool, CAST(l_quantity AS INT) % 2 AS q FROM lineitem WHERE l_partkey % 9 <> 0)
"""


def call_lists(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate", "l_returnflag", "l_linestatus", "l_quantity")
    tool, args = F.concat("l_returnflag", "l_linestatus"), F.to_json(F.struct((F.col("l_quantity").cast("int") % 2).alias("q")))
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
    gold = line.select(F.col("l_orderkey").alias("id"), F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*order)).alias("pos"), tool.alias("tool_name"), args.alias("arguments"))
    pred = line.where(F.col("l_partkey") % 9 != 0).select(F.col("l_orderkey").alias("id"), F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_shipdate", *order)).alias("pos"), F.when(F.col("l_partkey") % 4 == 0, "XX").otherwise(tool).alias("tool_name"), args.alias("arguments"))
    return gold, pred


@plans.query(_CALLS_SQL + "SELECT id, count(*) AS pairs, sum((g.q = p.q)::INT)::BIGINT AS same_args FROM g JOIN p USING (id, pos, tool) GROUP BY id")
def ordered_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairing.ordered(*call_lists(spark, sf_dir)).groupBy("id").agg(F.count("*").alias("pairs"), F.count_if(F.col("gold_arguments") == F.col("pred_arguments")).alias("same_args"))


@plans.query(
    _CALLS_SQL
    + """, gn AS (SELECT *, row_number() OVER (PARTITION BY id, tool ORDER BY pos) AS nth FROM g), pn AS (SELECT *, row_number() OVER (PARTITION BY id, tool ORDER BY pos) AS nth FROM p)
       SELECT id, count(*) AS pairs, sum((gn.q = pn.q)::INT)::BIGINT AS same_args FROM gn JOIN pn USING (id, tool, nth) GROUP BY id"""
)
def unordered_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairing.unordered(*call_lists(spark, sf_dir)).groupBy("id").agg(F.count("*").alias("pairs"), F.count_if(F.col("gold_arguments") == F.col("pred_arguments")).alias("same_args"))


@plans.query(
    _CALLS_SQL
    + """, l AS (SELECT id, tool, max(pos) AS pos, arg_max(q, pos) AS q FROM g GROUP BY id, tool)
       SELECT p.id, count(*) AS n_pred, count(l.pos) AS hits, sum(coalesce(p.q = l.q, false)::INT)::BIGINT AS same_args FROM p LEFT JOIN l ON p.id = l.id AND p.tool = l.tool GROUP BY p.id"""
)
def set_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    same = F.count_if(F.coalesce(F.col("gold_arguments") == F.col("pred_arguments"), F.lit(False)))
    return pairing.by_tool(*call_lists(spark, sf_dir)).groupBy("id").agg(F.count("*").alias("n_pred"), F.count("gold_pos").alias("hits"), same.alias("same_args"))


@plans.query(
    _CALLS_SQL
    + """, gn AS (SELECT *, row_number() OVER (PARTITION BY id, tool ORDER BY pos) AS nth FROM g), pn AS (SELECT *, row_number() OVER (PARTITION BY id, tool ORDER BY pos) AS nth FROM p),
         pairs AS (SELECT id, g.q AS gq, p.q AS pq FROM g JOIN p USING (id, pos, tool) WHERE id % 2 = 0 UNION ALL SELECT id, gn.q, pn.q FROM gn JOIN pn USING (id, tool, nth) WHERE id % 2 = 1),
         m AS (SELECT id, count(*) AS matched, avg(CASE WHEN gq = pq THEN 1.0 ELSE 0.0 END) AS va FROM pairs GROUP BY id),
         st AS (SELECT id, count(*) AS np, avg(CASE WHEN tool = 'XX' THEN 0.0 ELSE 1.0 END) AS sv, avg(CASE WHEN tool = 'AO' THEN 0.0 ELSE 1.0 END) AS cv, avg(CASE WHEN tool IN ('XX', 'AO') THEN 0.0 ELSE 1.0 END) AS ev FROM p GROUP BY id),
         x AS (SELECT gc.id, ng, coalesce(np, 0) AS np, coalesce(matched, 0) AS matched, coalesce(va, 0.0) AS va, CASE WHEN coalesce(matched, 0) > 0 THEN 1.0 ELSE 0.0 END AS kf, coalesce(sv, 0.0) AS sv, coalesce(cv, 0.0) AS cv, coalesce(ev, 0.0) AS ev
               FROM (SELECT id, count(*) AS ng FROM g GROUP BY id) gc LEFT JOIN m USING (id) LEFT JOIN st USING (id)),
         y AS (SELECT *, CASE WHEN np = 0 THEN 0.1 ELSE 0.10 + 0.20 * matched / ng + 0.15 * kf + 0.15 * va + 0.15 * sv + 0.15 * cv + 0.10 * ev END AS soft,
                      CASE WHEN np > 0 AND matched = ng AND kf = 1 AND va = 1 AND np = ng AND ev = 1 THEN 1.0 ELSE 0.0 END AS strict FROM x)
       SELECT id, round(soft, 6) AS reward_soft, round(strict, 6) AS reward_strict, round(0.5 * soft + 0.5 * strict, 6) AS reward_total FROM y"""
)
def multi_call_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    gold, pred = call_lists(spark, sf_dir)
    samples = gold.select("id").distinct().select("id", (F.col("id") % 2 == 0).alias("ordered"), F.lit("call_functions").alias("predicted_action"), F.lit(None).cast("string").alias("expected_status"))
    status = F.when(F.col("tool_name") == "XX", "schema_invalid").when(F.col("tool_name") == "AO", "contract_invalid").otherwise("ok")
    return scoring.multi(samples, gold, pred, pred.select("id", "pos", status.alias("status"))).select("id", "reward_soft", "reward_strict", "reward_total")


@plans.query(
    _CALLS_SQL
    + """, l AS (SELECT id, tool, max(pos) AS pos, arg_max(q, pos) AS q FROM g GROUP BY id, tool),
         s AS (SELECT p.id, count(*) AS np, count(l.pos) AS hits, avg(CASE WHEN l.pos IS NULL THEN 0.0 ELSE 1.0 END) AS kf, avg(CASE WHEN l.pos IS NULL THEN 0.0 WHEN p.q = l.q THEN 1.0 ELSE 0.0 END) AS va, avg(CASE WHEN p.tool = 'XX' THEN 0.0 ELSE 1.0 END) AS sv
               FROM p LEFT JOIN l ON p.id = l.id AND p.tool = l.tool GROUP BY p.id),
         x AS (SELECT id, ng, coalesce(np, 0) AS np, coalesce(hits, 0) * 1.0 / greatest(ng, coalesce(np, 0)) AS sel, coalesce(kf, 0.0) AS kf, coalesce(va, 0.0) AS va, coalesce(sv, 0.0) AS sv FROM (SELECT id, count(*) AS ng FROM g GROUP BY id) LEFT JOIN s USING (id)),
         y AS (SELECT *, CASE WHEN np = 0 THEN 0.1 ELSE 0.15 + 0.30 * sel + 0.20 * kf + 0.20 * va + 0.15 * sv END AS soft, CASE WHEN np = ng AND sel = 1 AND kf = 1 AND va = 1 AND sv = 1 THEN 1.0 ELSE 0.0 END AS strict FROM x)
       SELECT id, round(soft, 6) AS reward_soft, round(strict, 6) AS reward_strict, round(0.5 * soft + 0.5 * strict, 6) AS reward_total FROM y"""
)
def multi_read_only_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    gold, pred = call_lists(spark, sf_dir)
    samples = gold.select("id").distinct().withColumn("predicted_action", F.lit("call_functions"))
    return scoring.multi_read_only(samples, gold, pred, pred.select("id", "pos", (F.col("tool_name") != "XX").alias("ok"))).select("id", "reward_soft", "reward_strict", "reward_total")
