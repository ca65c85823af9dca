"""Assembly of corpora: texts of tools, corrections, teacher prompts, registries put together, dual verification."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from toolloom.functions import scores as S
from toolloom.functions.feedback import feedback_or_texts
from toolloom.functions.json import args_map, indented_json, maybe_json, spaced_json
from toolloom.functions.text import bullet_lines, first_rule
from toolloom.operators import audit, derivation, evaluator, registry, reports, rollouts, sampling, scoring, validation
from toolloom.plans.base import Plans, table
from toolloom.plans.end_to_end import contracts, subscribers, transactional_samples, transactional_tools
from toolloom.plans.groups import _ROLLOUTS_SQL, rolled

plans = Plans()


@plans.query("SELECT p_partkey, concat_ws(' ', nullif(p_name, ''), CASE WHEN p_size % 2 = 0 THEN p_brand END, 'location_code', CASE WHEN p_size % 3 = 0 THEN p_type END, 'kpi') AS text FROM part")
def tool_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What retrieval sees of a tool: empty parts leave no blanks."""
    param = lambda name, text: F.struct(F.lit(name).alias("name"), text.alias("description"))
    params = F.array(param("location_code", F.when(F.col("p_size") % 3 == 0, F.col("p_type"))), param("kpi", F.lit("")))
    return table(spark, sf_dir, "part").select("p_partkey", registry.tool_text(F.col("p_name"), F.when(F.col("p_size") % 2 == 0, F.col("p_brand")).otherwise(""), params).alias("text"))


@plans.query("SELECT c_custkey, 'show ' || c_mktsegment || '|twice - ' || c_nationkey AS lines, 2::BIGINT AS n FROM customer")
def query_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of examples without bullets; blank ones go."""
    text = F.concat(F.lit("- show "), "c_mktsegment", F.lit("\n\n  --  twice - "), F.col("c_nationkey").cast("string"), F.lit("  \n - \n"))
    lines = bullet_lines(text)
    return table(spark, sf_dir, "customer").select("c_custkey", F.array_join(lines, "|").alias("lines"), F.size(lines).cast("long").alias("n"))


@plans.query(
    """SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'The response has schema errors:' || chr(10) || '• Missing required argument `' || event_type || '`. → Suggested: ask the user for a valid value (ask_clarification).'
                                  WHEN 1 THEN 'first ' || event_type ELSE 'Nothing to say.' END AS text FROM events"""
)
def feedback_fallbacks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rendered errors, else the plain texts, else a constant."""
    issues = F.when(F.col("event_id") % 3 == 0, F.array(validation.issue("missing_arg", F.col("event_type"), F.lit("m")))).otherwise(validation.none_of())
    texts = F.when(F.col("event_id") % 3 == 1, F.array(F.lit("first"), F.col("event_type"))).otherwise(F.array().cast("array<string>"))
    return table(spark, sf_dir, "events").select("event_id", feedback_or_texts(F.lit("schema_invalid"), issues, texts, F.lit("en"), "Nothing to say.").alias("text"))


@plans.query(
    """SELECT c_custkey AS id, CASE c_custkey % 12 WHEN 5 THEN 'ask_clarification' WHEN 6 THEN 'abstain' WHEN 7 THEN 'abstain' WHEN 9 THEN 'call_functions' WHEN 10 THEN 'call_functions' WHEN 11 THEN 'call_functions' ELSE 'call_function' END AS action,
              CASE WHEN c_custkey % 12 IN (5, 6, 7) THEN 0 WHEN c_custkey % 12 IN (9, 10, 11) THEN 2 ELSE 1 END::BIGINT AS n_calls, CASE WHEN c_custkey % 12 = 5 THEN 'amount,customer_id' ELSE '' END AS slots FROM customer"""
)
def gold_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prediction that a sample's own gold gives."""
    samples = transactional_samples(spark, sf_dir).withColumn("prediction", F.lit(None).cast("struct<action:string,calls:array<struct<tool_name:string,arguments:string>>,asked_slots:array<string>>"))
    out = scoring.gold_prediction(samples)
    return out.select("id", F.col("gold_prediction.action").alias("action"), F.coalesce(F.size("gold_prediction.calls"), F.lit(0)).cast("long").alias("n_calls"), F.coalesce(F.array_join("gold_prediction.asked_slots", ","), F.lit("")).alias("slots"))


@plans.query("""SELECT p_partkey, '{"a":' || p_size || ',"param_1":"' || p_brand || '"}' AS masked, 0.5 AS real_names, 0.25 AS single_step FROM part""")
def masked_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arguments under masked names; the curriculum's and the profile's shares."""
    args = args_map(F.to_json(F.struct(F.col("p_size").alias("a"), F.col("p_brand").alias("location_code"))))
    out = derivation.with_profile(table(spark, sf_dir, "part").withColumn("args", args))
    masked = F.to_json(derivation.mask_call(F.col("args"), F.create_map(F.lit("param_1"), F.lit("location_code"), F.lit("param_2"), F.lit("none"))))
    return out.select("p_partkey", masked.alias("masked"), F.lit(derivation.CURRICULUM["real_names"]).alias("real_names"), F.element_at("generation_profile", "single_step_valid").alias("single_step"))


@plans.query(
    """WITH s AS (SELECT s_nationkey, s_name, min(s_suppkey) AS pos FROM supplier GROUP BY 1, 2), e AS (SELECT s_nationkey, string_agg('"' || s_name || '"', ',' ORDER BY pos) AS codes FROM s GROUP BY 1)
       SELECT n_name AS name, coalesce(codes, '"kept"') AS enum, '' AS other FROM nation LEFT JOIN e ON n_nationkey = s_nationkey"""
)
def injected_enums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Enums of parameters from their code tables, codes in first-seen order; others keep theirs."""
    param = lambda name, enum: F.struct(name.alias("name"), F.lit("string").alias("type"), F.lit(True).alias("required"), enum.alias("enum"))
    tools = table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), F.array(param(F.concat(F.lit("p"), F.col("n_nationkey").cast("string")), F.array(F.lit('"kept"'))), param(F.lit("free"), F.lit(None).cast("array<string>"))).alias("params"))
    codes = table(spark, sf_dir, "supplier").select(F.concat(F.lit("p"), F.col("s_nationkey").cast("string")).alias("param"), F.col("s_name").alias("code"), F.col("s_suppkey").alias("pos"))
    out = registry.inject_enums(tools, codes.unionByName(codes.withColumn("pos", F.col("pos") + 10**6)))
    return out.select("name", F.array_join(F.col("params")[0]["enum"], ",").alias("enum"), F.coalesce(F.array_join(F.col("params")[1]["enum"], ","), F.lit("")).alias("other"))


@plans.query(
    """WITH r AS (SELECT n_nationkey, n_name, j, row_number() OVER (ORDER BY (n_regionkey = 2) DESC, n_nationkey, j) AS n FROM nation, (VALUES (1), (2), (3)) AS t(j))
       SELECT printf('EHB%05d', n) AS station_code, n_nationkey AS location_code, n_name || ' ' || j AS name FROM r WHERE n <= 70"""
)
def station_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three stations a location, provinces first, up to a cap."""
    places = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("code"), F.col("n_name").alias("name"), (F.col("n_regionkey") == 2).alias("is_province"), F.col("n_nationkey").alias("pos"))
    return sampling.station_catalogue(places, cap=70)


@plans.query(
    """SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'system:sys|user:ask|assistant:' || event_type || '|user:wrong' || chr(10) || 'again|assistant:' || props ELSE 'system:sys|user:ask|user:wrong' || chr(10) || 'again|assistant:' || props END AS correction,
              'system:sys' || CASE WHEN event_id % 3 = 0 THEN chr(10) || chr(10) || 'Best response:' || chr(10) || event_type ELSE '' END || chr(10) || chr(10) || 'Feedback:' || chr(10) || 'wrong' || '|user:ask' AS teacher FROM events"""
)
def corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations with a wrong output, its feedback and the correction, and prompts of a teacher who sees the best one."""
    turn = lambda role, text: F.struct(F.lit(role).alias("role"), F.lit(text).alias("content"))
    said = F.array(turn("system", "sys"), turn("user", "ask"))
    shown = lambda messages: F.array_join(F.transform(messages, lambda m: F.concat(m["role"], F.lit(":"), m["content"])), "|")
    fixed = [rollouts.correction_messages(said, F.col("event_type"), F.lit("wrong"), F.lit("again"), F.col("props"), with_request=w) for w in (True, False)]
    teacher = rollouts.teacher_messages(said, F.when(F.col("event_id") % 3 == 0, F.col("event_type")), F.lit("wrong"))
    return table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 2 == 0, shown(fixed[0])).otherwise(shown(fixed[1])).alias("correction"), shown(teacher).alias("teacher"))


@plans.query(_ROLLOUTS_SQL + ", b AS (SELECT id, max(reward) AS m FROM r GROUP BY id) SELECT count(*) AS groups, sum((m >= 1)::INT)::BIGINT AS with_demo, round(avg(m), 6) AS avg_best, (SELECT count(*) FROM r WHERE reward < 1) AS wrong FROM b")
def demonstrations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups with a demonstration, and results to be corrected."""
    rows = rolled(spark, sf_dir)
    wrong = rollouts.wrong(rows).agg(F.count("*").alias("wrong"))
    return rollouts.demonstrations(rollouts.best_of_k(rows)).withColumn("avg_best", F.round("avg_best", 6)).crossJoin(wrong)  # one row each


@plans.query(
    """SELECT id, CASE k WHEN 0 THEN 'ok' ELSE 'schema_invalid' END AS checked, kept FROM (SELECT c_custkey AS id, c_custkey % 2 AS k, (c_custkey % 11 <> 0) AND (c_custkey % 5 <> 0) AND c_custkey % 2 = 1 AS kept FROM customer)"""
)
def dual_verification(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sample stays if its gold reaches its status and its negative call fails as it should; both are evaluated."""
    samples = transactional_samples(spark, sf_dir).withColumn("expected_action", F.lit("call_function"))
    # payments of one unit: allowed unless there is no subscriber or no verified customer
    pay = F.struct(F.lit("pay_bill").alias("tool_name"), F.to_json(F.struct(F.col("id").cast("string").alias("customer_id"), F.lit(1).alias("amount"))).alias("arguments"))
    bad = F.struct(F.lit("pay_bill").alias("tool_name"), F.when(F.col("id") % 2 == 0, pay["arguments"]).otherwise(F.to_json(F.struct(F.col("id").cast("string").alias("customer_id")))).alias("arguments"))
    samples = samples.withColumns({"gold_call": pay, "checker_call": bad})
    parts = (transactional_tools(spark), contracts(spark), subscribers(spark, sf_dir))
    gold = evaluator.evaluate(samples.withColumn("raw", evaluator.mock_output(samples)), "raw", *parts).select("id", F.col("machine_status").alias("gold_status"))
    negative = samples.withColumn("gold_call", F.col("checker_call"))
    checked = evaluator.evaluate(negative.withColumn("raw", evaluator.mock_output(negative)), "raw", *parts).select("id", F.col("machine_status").alias("checker_status"))
    both = samples.select("id", "expected_status", F.lit("schema_invalid").alias("checker_expected_status")).join(gold, "id").join(checked, "id")
    kept = audit.verified(both, F.col("gold_status"), F.col("checker_status")).select("id", F.lit(True).alias("kept"))
    schema = F.when(F.col("checker_status") == "schema_invalid", "schema_invalid").otherwise("ok")
    return both.join(kept, "id", "left").select("id", schema.alias("checked"), F.coalesce("kept", F.lit(False)).alias("kept"))


@plans.query(
    """SELECT c_custkey, CASE WHEN c_nationkey % 3 = 0 THEN 'roam' WHEN c_nationkey % 3 = 1 THEN 'sim' END AS rule, '{"k": ' || c_nationkey || ', "t": "a,b:c"}' AS spaced,
              '{' || chr(10) || '  "k": ' || c_nationkey || ',' || chr(10) || '  "t": "a,b:c"' || chr(10) || '}' AS indented, CASE WHEN c_nationkey % 2 = 0 THEN '["x"]' ELSE '"plain [x]"' END AS maybe FROM customer"""
)
def text_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first keyword rule, JSON with blanks and on lines, text that may be JSON."""
    n = F.col("c_nationkey")
    text = F.concat(F.lit('{"k":'), n.cast("string"), F.lit(',"t":"a,b:c"}'))
    request = F.when(n % 3 == 0, "Enable ROAMING and a sim").when(n % 3 == 1, "a Simple thing").otherwise("none")
    rule = first_rule(request, [(["roaming", "abroad"], "roam"), (["sim"], "sim")])
    maybe = maybe_json(F.when(n % 2 == 0, '["x"]').otherwise("plain [x]"))
    return table(spark, sf_dir, "customer").select("c_custkey", rule.alias("rule"), spaced_json(text).alias("spaced"), indented_json(text).alias("indented"), F.to_json(maybe).alias("maybe"))


@plans.query(
    """SELECT 'c' || printf('%06d', c_custkey) || '_r' || i AS id, CASE WHEN i = 1 THEN 'list' ELSE 'query' END AS tool, CASE WHEN i = 2 THEN 'S' || c_nationkey END AS station
       FROM (SELECT * FROM customer WHERE c_custkey % 4 = 0 ORDER BY c_custkey LIMIT 13), (VALUES (1), (2)) AS t(i)"""
)
def react_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chains split into two records each, up to a target number; chains without an observation give none."""
    c = F.col("c_custkey")
    call = lambda tool, args: F.struct(F.lit(tool).alias("tool_name"), args_map(args).alias("arguments"))
    steps = F.array(call("list", F.lit('{"location_code": "L"}')), call("query", F.lit(f'{{"station_code": "{validation.PLACEHOLDER}", "k": 1}}')))
    seen = F.when(c % 4 == 0, F.array(F.concat(F.lit("S"), F.col("c_nationkey").cast("string")), F.lit("other")))
    rows = table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), F.format_string("%06d", c)).alias("id"), F.lit("ask").alias("instruction"), steps.alias("steps"), seen.alias("observation"))
    return derivation.react_steps(rows, cap=25).select("id", F.col("tool_name").alias("tool"), F.try_element_at("arguments", F.lit("station_code")).cast("string").alias("station"))


@plans.query("SELECT least(50, count(*)) AS n, least(50, count(*)) AS distinct_ids, true AS same, 38 AS iterations, 180 AS seen, 12 AS eval_seen FROM customer")
def draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A draw by hash is of its size, without repetition and the same again; counts of a scaled run."""
    people = table(spark, sf_dir, "customer").select("c_custkey")
    once, again = (sampling.sample_cap(df, 50, "c_custkey", seed=3) for df in (people, people.repartition(3)))
    counts = S.scaled({"seen": 150, "eval_seen": 125}, 1.2, 0.1)
    same = once.exceptAll(again).agg((F.count("*") == 0).alias("same"))
    drawn = once.agg(F.count("*").alias("n"), F.count_distinct("c_custkey").alias("distinct_ids"))
    return drawn.crossJoin(same).select("n", "distinct_ids", "same", F.lit(S.iterations(100, 3, 8)).alias("iterations"), F.lit(counts["seen"]).alias("seen"), F.lit(counts["eval_seen"]).alias("eval_seen"))


@plans.query("SELECT n_nationkey, n_regionkey FROM nation")
def required_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a registry for names that must all be there."""
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("name"), "n_regionkey")
    return registry.require(nation, nation.select("name")).select(F.col("name").alias("n_nationkey"), "n_regionkey")


@plans.query("SELECT o_orderstatus AS split, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM orders), 4) AS share FROM orders GROUP BY 1")
def split_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each split with their share of all."""
    counted = reports.distribution(table(spark, sf_dir, "orders"), "o_orderstatus")
    total = counted.agg(F.sum("n").alias("total"))
    return counted.crossJoin(total).select(F.col("o_orderstatus").alias("split"), "n", F.round(100 * F.col("n") / F.col("total"), 4).alias("share"))  # one row
