"""Generated corpora: jobs and texts over the driver's tables, checked row by row against SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from toolloom.functions.json import CALL, args_map
from toolloom.operators import generation, hard, registry, retrieval
from toolloom.operators.scoring import REAL_SOURCE
from toolloom.plans.base import Plans, spread, table
from toolloom.plans.end_to_end import DEFECTS, _tools, contracts, defect_samples, read_only_tools, transactional_tools

plans = Plans()


def _call(tool, arguments):
    return generation.call_of(F.lit(tool) if isinstance(tool, str) else tool, arguments)


@plans.query(
    """SELECT c_custkey, 'Nội dung: Traffic of ' || c_mktsegment || '. Phải nêu: địa điểm: ' || c_nationkey || CASE WHEN c_custkey % 2 = 0 THEN '; thời gian: tháng ' || c_nationkey ELSE '' END || '; top 5; chỉ số: K' || c_nationkey || '; extra'
              || CASE WHEN c_custkey % 3 = 0 THEN '  (CỐ TÌNH KHÔNG nêu khoảng thời gian)' ELSE '' END AS spec FROM customer"""
)
def spec_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What requests must say: hints in fixed order, others behind them, left-out slots named."""
    n = F.col("c_nationkey").cast("string")
    hints = F.map_filter(F.create_map(F.lit("zzz"), F.lit("extra"), F.lit("kpi_code"), F.concat(F.lit("K"), n), F.lit("_topk"), F.lit("top 5"), F.lit("_time"), F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("tháng "), n)), F.lit("location_code"), n), lambda k, v: v.isNotNull())
    text = F.concat(F.lit("Traffic of "), F.col("c_mktsegment"), F.lit(". Not shown."))
    spec = F.when(F.col("c_custkey") % 3 == 0, generation.spec_text(text, hints, F.lit("khoảng thời gian"))).otherwise(generation.spec_text(text, hints))
    return table(spark, sf_dir, "customer").select("c_custkey", spec.alias("spec"))


def part_jobs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Parts as jobs, and as texts in another order; every fourth has none, every seventh's is blank."""
    part = table(spark, sf_dir, "part")
    args = F.to_json(F.struct(F.col("p_brand").alias("location_code"), F.col("p_size").alias("kpi_code")))
    jobs = part.select(F.col("p_partkey").alias("job_id"), F.col("p_partkey").alias("i"), F.lit("kpi_query").alias("tool_name"), args.alias("arguments"), F.lit("seen").alias("split"))
    raw = F.when(F.col("p_partkey") % 7 == 0, '<think>x</think> ""').otherwise(F.concat(F.lit("<think>hm\n</think>\""), "p_name", F.lit('"\nand more')))
    return jobs, part.where("p_partkey % 4 <> 0").orderBy(F.desc("p_partkey")).select(F.col("p_partkey").alias("job_id"), raw.alias("raw"))


_PARTS = "FROM part WHERE p_partkey % 4 <> 0 AND p_partkey % 7 <> 0"


@plans.query(f"""SELECT 'real_seen_kpi_query_single_step_valid_' || printf('%04d', p_partkey) AS id, p_name AS instruction, 'call_function' AS expected_action, 'kpi_query' AS tool, '{{"location_code":"' || p_brand || '","kpi_code":' || p_size || '}}' AS arguments {_PARTS}""")
def single_step_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs joined to texts by id: a missing or blank text costs its own job only."""
    out = generation.single_step(*part_jobs(spark, sf_dir))
    return out.select("id", "instruction", "expected_action", F.col("gold_call.tool_name").alias("tool"), F.col("gold_call.arguments").alias("arguments"))


@plans.query(
    f"""SELECT 'real_hard_missing_kpi_query_' || printf('%04d', p_partkey) AS id, CASE p_partkey % 3 WHEN 0 THEN 'location_code,kpi_code' ELSE 'kpi_code' END AS missing,
               CASE p_partkey % 3 WHEN 0 THEN '{{}}' ELSE '{{"location_code":"' || p_brand || '"}}' END AS checker, 'ask_clarification' AS expected_action {_PARTS} AND p_partkey % 3 <> 1"""
)
def hard_missing_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests that leave out one or several slots in turn; slots that a call lacks are passed over."""
    out = generation.questions(*part_jobs(spark, sf_dir), [("location_code", "kpi_code"), ("from_date",), ("kpi_code", "from_date")])
    return out.select("id", F.array_join("missing_slots", ",").alias("missing"), F.col("checker_call.arguments").alias("checker"), "expected_action")


@plans.query(
    """WITH i AS (SELECT n_nationkey AS b, 0 AS j, 'ask ' || n_name AS q FROM nation UNION ALL SELECT n_nationkey, 3, 'why ' || n_name FROM nation)
       SELECT 'real_abstain_' || b || '_' || lpad(CAST(j AS VARCHAR), 3, '0') AS id, q AS instruction, 'abstain' AS expected_action, 'ngoài phạm vi công cụ KPI' AS reason FROM (SELECT *, row_number() OVER (ORDER BY b, j) AS r FROM i WHERE b % 5 <> 0) WHERE r <= 33"""
)
def refusal_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Refusals from batches of requests: numbers, blanks and batches that are no array go, the first 33 stay."""
    raw = F.when(F.col("n_nationkey") % 5 == 0, "no array").otherwise(F.concat(F.lit('Here: ["ask '), "n_name", F.lit('", 5, "  ", " why '), "n_name", F.lit(' "]')))
    return generation.refusals(table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("batch"), raw.alias("raw")), 33).select("id", "instruction", "expected_action", "reason")


def nation_pairs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Pairs of nations as tools (one partner is unknown), the registry, and two argument sets a tool."""
    nation = table(spark, sf_dir, "nation")
    name = F.concat(F.lit("t"), F.col("n_nationkey").cast("string"))
    known = nation.select(name.alias("name"), F.concat(F.lit("About "), "n_name", F.lit(". More")).alias("description"))
    partner = F.when(F.col("n_nationkey") == 7, "none_such").otherwise(F.concat(F.lit("t"), ((F.col("n_nationkey") + 1) % 25).cast("string")))
    pairs = nation.select(F.col("n_nationkey").alias("pair"), name.alias("a"), partner.alias("b"), F.lit("station_code").alias("key"))
    sets = nation.withColumn("i", F.explode(F.array(F.lit(0), F.lit(1))))
    args = F.to_json(F.struct(F.concat(F.lit("L"), F.col("n_nationkey").cast("string"), F.lit("_"), F.col("i").cast("string")).alias("location_code"), F.lit("own").alias("own")))
    hints = F.create_map(F.lit("location_code"), F.col("n_name"), F.lit("kpi_code"), F.lit("hidden"), F.lit("_time"), F.lit("May"))
    return pairs, known, sets.select(name.alias("name"), "i", args.alias("arguments"), hints.alias("hints"))


_PAIRS_SQL = "FROM (SELECT a.n_nationkey AS pair, a.n_name AS an, b.n_name AS bn, i FROM nation a JOIN nation b ON b.n_nationkey = (a.n_nationkey + 1) % 25, (VALUES (0), (1)) AS t(i) WHERE a.n_nationkey <> 7)"


@plans.query(
    f"""SELECT pair || '_' || i AS job_id, 'Hỏi CẢ HAI trong một câu: (1) About ' || an || '; (2) About ' || bn || '.  địa điểm: ' || an || '; thời gian: May' AS spec, '{{"location_code":"L' || pair || '_' || i || '","own":"own"}}' AS first,
               '{{"location_code":"L' || pair || '_' || i || '","own":"own"}}' AS second, 'real_parallel_' || pair || '_000' || i AS id {_PAIRS_SQL}"""
)
def parallel_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of tools that the registry holds; the second call takes over the place of the first."""
    jobs = generation.pair_jobs(*nation_pairs(spark, sf_dir), per_pair=2)
    rows = generation.several_calls(jobs, jobs.select("job_id", F.concat(F.lit("q "), "job_id").alias("raw")))
    named = rows.join(jobs.select("job_id", "spec"), F.col("instruction") == F.concat(F.lit("q "), "job_id"))
    return named.select("job_id", "spec", F.col("gold_calls")[0]["arguments"].alias("first"), F.col("gold_calls")[1]["arguments"].alias("second"), "id")


@plans.query(
    f"""SELECT pair || '_' || i AS job_id, 'Quy trình 2 bước: trước tiên tìm các trạm ở ' || an || ' trong May, sau đó tra cứu About ' || bn || ' của các trạm đó.' AS spec, 't' || pair AS first, '<from_step_1>' AS waits {_PAIRS_SQL}"""
)
def chain_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chains of two tools, the second waiting for the first's result."""
    jobs = generation.pair_jobs(*nation_pairs(spark, sf_dir), per_pair=2, chained=True)
    return jobs.select("job_id", "spec", F.col("calls")[0]["tool_name"].alias("first"), F.get_json_object(F.col("calls")[1]["arguments"], "$.station_code").alias("waits"))


@plans.query("""SELECT 'real_eval_mask_' || printf('%03d', s_suppkey) AS id, 'Dùng func_' || (s_suppkey + 1) || ' để: ' || s_name AS instruction, 'func_' || (s_suppkey + 1) AS tool, 'func_' || (s_suppkey + 1) AS masked, 'location_code' AS first_param FROM supplier WHERE s_suppkey % 3 = 0""")
def masked_eval_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Masked twins of samples with their schema in the row; refusals and unknown tools have none."""
    turn = F.col("s_suppkey") % 3
    samples = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("pos"), F.col("s_name").alias("instruction"), F.when(turn == 1, "abstain").otherwise("call_function").alias("expected_action"), _call(F.when(turn == 2, "none_such").otherwise("station_info"), F.lit('{"location_code":"L1"}')).alias("gold_call"))
    out = generation.masked_eval(samples, read_only_tools(spark))
    return out.select("id", "instruction", F.col("gold_call.tool_name").alias("tool"), F.col("masked_tool.name").alias("masked"), F.col("masked_tool.params")[0]["name"].alias("first_param"))


@plans.query(
    """SELECT 'real_eval_real_unseen_s' || s_suppkey || '_single_step_valid_' || lpad(CAST(i AS VARCHAR), 4, '0') AS id, 'show ' || s_name AS instruction, '{"k":' || s_nationkey || '}' AS arguments
       FROM supplier, (VALUES (0), (2)) AS t(i) WHERE NOT (i = 2 AND s_nationkey % 2 = 0)"""
)
def seed_example_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Experts' examples of unseen tools; those without request or arguments go."""
    args = F.concat(F.lit('{"k":'), F.col("s_nationkey").cast("string"), F.lit("}"))
    one = lambda query, call: F.struct(query.alias("query"), call.alias("call"))
    named = F.concat(F.lit(" show "), "s_name", F.lit(" "))
    examples = F.array(one(named, args), one(F.lit(" "), args), one(named, F.when(F.col("s_nationkey") % 2 == 0, "{}").otherwise(args)), one(named, F.lit(None).cast("string")))
    tools = table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("name"), examples.alias("seed_examples"))
    return generation.seed_rows(tools).select("id", "instruction", F.col("gold_call.arguments").alias("arguments"))


@plans.query(
    """WITH e AS (SELECT event_id, event_type, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events), seen AS (SELECT DISTINCT k FROM e WHERE event_type = 'view' AND event_id % 2 = 0),
            f AS (SELECT event_id, row_number() OVER (ORDER BY event_id) AS r FROM e WHERE event_type = 'click' AND event_id % 40 = 0 OR (event_type = 'click' AND k NOT IN (SELECT k FROM seen)))
       SELECT event_id, event_type FROM e WHERE event_type <> 'click' UNION ALL SELECT event_id, 'click' FROM (SELECT event_id, row_number() OVER (ORDER BY event_id) AS r FROM e WHERE event_type = 'click' AND (CASE WHEN event_id % 40 = 0 THEN -1 ELSE k END) NOT IN (SELECT k FROM seen)) WHERE r <= 25"""
)
def no_overlap_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Marked rows (clicks) whose call no training row (every second view) makes, the first 25 by position; all others stay."""
    k = F.get_json_object("props", "$.k").cast("int")
    own = F.when((F.col("event_type") == "click") & (F.col("event_id") % 40 == 0), F.lit(-1)).otherwise(k)
    rows = table(spark, sf_dir, "events").select("event_id", "event_type", _call("t", F.to_json(F.struct(own.alias("k")))).alias("gold_call"), (F.col("event_type") == "click").alias("filter_overlap"))
    train = rows.where("event_type = 'view' and event_id % 2 = 0")
    return generation.without_overlap(rows, train, 25, position="event_id").select("event_id", "event_type")


def _hard_sql() -> str:
    """One row for each family, tool and token set of the cases that pass, the first event of all with them."""
    keys: dict[tuple, list[int]] = {}
    for i, (case, _, outcome) in enumerate(DEFECTS):
        if outcome == "kept":
            call = case.get("gold_call") or (case.get("gold_steps") or [None])[0] or case.get("checker_call") or ("",)
            keys.setdefault((case.get("scenario_family", "single_step_valid"), call[0], case.get("instruction", "show the figures please").lower()), []).append(i)
    parts = [f"SELECT 'eval_real_{family}' AS split, min(event_id) AS id FROM events WHERE event_id % {len(DEFECTS)} IN ({', '.join(map(str, turns))})" for (family, _, _), turns in keys.items()]
    # events of case 0 are marked, and their call is a training row's
    return f"SELECT * FROM ({' UNION ALL '.join(parts)}) WHERE id IS NOT NULL AND id % {len(DEFECTS)} <> 0"


@plans.query(_hard_sql())
def hard_eval_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verified rows without near duplicates and without overlap with training rows, split by family."""
    samples, known, codes, names = defect_samples(spark, sf_dir)
    samples = samples.withColumn("pos", F.col("id")).withColumn("filter_overlap", F.col("turn") == 0)
    train = samples.where("turn = 0")
    return generation.hard_sets(samples, known, codes, names, train, 5).select("split", "id")


@plans.query(
    """WITH t AS (SELECT p_partkey, p_partkey % 3 AS k, 'T' || (p_size % 4) AS tool FROM part),
            s AS (SELECT CASE WHEN k = 0 THEN 'ask_clarification' ELSE 'abstain' END AS a FROM t WHERE tool <> 'T3' UNION ALL SELECT 'call_function' FROM supplier)
       SELECT a AS expected_action, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM s), 1) AS share FROM s GROUP BY a"""
)
def synthetic_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Refusals and questions from templates whose tool is known, merged with other rows: shares of the actions."""
    k = F.col("p_partkey") % 3
    templates = table(spark, sf_dir, "part").select(F.when(k == 0, "missing").when(k == 1, "contract").otherwise("deprecated").alias("kind"), F.col("p_partkey").alias("pos"), F.concat(F.lit("T"), (F.col("p_size") % 4).cast("string")).alias("tool_name"), F.col("p_name").alias("instruction"), F.lit("why").alias("reason"), F.when(k == 0, F.array(F.lit("amount"))).alias("missing_slots"))
    tools = spark.createDataFrame([(f"T{i}", "d") for i in range(3)], "name string, description string")
    rest = table(spark, sf_dir, "supplier").select(F.lit("call_function").alias("expected_action"))
    return generation.action_shares(generation.synthetic_actions(templates, tools).select("expected_action").unionByName(rest))


@plans.query(
    """SELECT 'synth_' || CASE WHEN p_partkey % 3 = 0 THEN 'clarify_missing' WHEN p_partkey % 3 = 1 THEN 'abstain_contract' ELSE 'abstain_deprecated' END || '_' || printf('%03d', p_partkey + 1) AS id,
              CASE WHEN p_partkey % 3 = 0 THEN '{"action":"ask_clarification","asked_slots":["amount"]}' ELSE '{"action":"abstain","reason":"why"}' END AS answer FROM part"""
)
def synthetic_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey") % 3
    templates = table(spark, sf_dir, "part").select(F.when(k == 0, "missing").when(k == 1, "contract").otherwise("deprecated").alias("kind"), F.col("p_partkey").alias("pos"), F.lit("T0").alias("tool_name"), F.col("p_name").alias("instruction"), F.lit("why").alias("reason"), F.when(k == 0, F.array(F.lit("amount"))).alias("missing_slots"))
    return generation.synthetic_actions(templates, spark.createDataFrame([("T0", "d")], "name string, description string")).select("id", "answer")


@plans.query(
    """WITH d AS (SELECT count(*) AS n FROM documents), w AS (SELECT count(*) AS n FROM part)
       SELECT 'eval' AS file, least(64, d.n) AS domain, 0::BIGINT AS warmup, 0::BIGINT AS shared FROM d UNION ALL SELECT 'train', d.n - least(64, d.n), least(100, w.n), 0 FROM d, w"""
)
def sft_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training and held-out files: disjoint, the rest of the domain rows with a draw of warm-up rows."""
    messages = lambda text: F.array(F.struct(F.lit("user").alias("role"), text.alias("content")))
    domain = table(spark, sf_dir, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"), F.lit("documents").alias("source"), F.lit("abstain").alias("expected_action"), messages(F.col("lang")).alias("messages"))
    warmup = table(spark, sf_dir, "part").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("id"), F.lit(None).cast("string").alias("source"), F.lit(None).cast("string").alias("expected_action"), messages(F.col("p_name")).alias("messages"))
    files = generation.training_files(domain, warmup, 64, 100)
    both = files.groupBy("id").agg(F.countDistinct("file").alias("files"))
    counted = files.join(both, "id").groupBy("file").agg(F.count_if(F.col("source") == "documents").alias("domain"), F.count_if((F.col("source") == "warmup") & (F.col("expected_action") == "call_function")).alias("warmup"), F.count_if(F.col("files") > 1).alias("shared"))
    return counted


@plans.query("""SELECT CASE WHEN source = 'src0' THEN 'train' ELSE 'eval' END AS file, lang AS split, count(*) AS n, sum((source IN ('src1', 'src0'))::INT)::BIGINT AS masked FROM documents GROUP BY 1, 2""")
def train_eval_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the training split go to one file, all others to the other; the masking stage is told by ids."""
    ident = F.concat(F.when(F.col("source").isin("src0", "src1"), generation.MASK_PREFIX).otherwise("real_"), F.col("doc_id").cast("string"))
    rows = table(spark, sf_dir, "documents").select(ident.alias("id"), "lang", F.when(F.col("source") == "src0", "train").otherwise("eval_x").alias("split"))
    stage = generation.masking_stage(rows).select("id", F.lit(True).alias("masked"))
    out = generation.train_or_eval(rows).join(stage, "id", "left")
    return out.groupBy("file", F.col("lang").alias("split")).agg(F.count("*").alias("n"), F.count_if(F.coalesce("masked", F.lit(False))).alias("masked"))


@plans.query("""SELECT p_partkey AS id, CASE WHEN p_partkey % 4 = 0 THEN '{"action":"abstain","reason":"' || p_brand || '"}' ELSE '{"action":"abstain","reason":"ngoài phạm vi công cụ KPI"}' END AS gold FROM part WHERE p_partkey % 2 = 0""")
def anchor_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Refusals with their stored answer, or the default one."""
    stored = F.struct(F.when(F.col("p_partkey") % 4 == 0, "abstain").otherwise("call_function").alias("action"), F.col("p_brand").alias("reason"))
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") % 2 == 0, "abstain").otherwise("call_function").alias("expected_action"), stored.alias("prediction"))
    return generation.anchors(rows).select("id", "gold")


@plans.query(
    """SELECT CAST(floor((p_partkey - 1) / 10) AS BIGINT) % 3 AS batch_kind, (p_partkey - 1) % 10 AS place, CASE CAST(floor((p_partkey - 1) / 10) AS BIGINT) % 3 WHEN 0 THEN (p_partkey - 1) % 10 NOT IN (1, 2, 4) ELSE true END AS verdict, count(*) AS n FROM part GROUP BY 1, 2, 3"""
)
def judge_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A judge's answers in batches of ten: yes, no in either case, gaps, short and broken arrays."""
    samples = table(spark, sf_dir, "part").select((F.col("p_partkey") - 1).alias("pos"))
    batches = samples.select(F.floor(F.col("pos") / 10).alias("batch")).distinct()
    raw = F.when(F.col("batch") % 3 == 0, '```json\n["CO", "khong", "KHONG!", "co", 7]\n```').when(F.col("batch") % 3 == 1, "I can't tell [")
    out = generation.verdicts(samples, batches.select("batch", raw.alias("raw")))
    return out.groupBy((F.floor(F.col("pos") / 10) % 3).alias("batch_kind"), (F.col("pos") % 10).alias("place"), "verdict").agg(F.count("*").alias("n"))


@plans.query(
    """WITH r AS (SELECT CASE WHEN source = 'src0' THEN 'train' ELSE 'eval_' || lang END AS split, CASE WHEN n_chars % 2 = 0 THEN 'masking' ELSE 'unknown' END AS family FROM documents)
       SELECT 'train_total' AS section, '' AS name, count(*) AS n FROM r WHERE split = 'train' HAVING count(*) > 0 UNION ALL SELECT 'train_by_family', family, count(*) FROM r WHERE split = 'train' GROUP BY family
       UNION ALL SELECT 'eval_total', '', count(*) FROM r WHERE split <> 'train' HAVING count(*) > 0 UNION ALL SELECT 'eval_counts', split, count(*) FROM r WHERE split <> 'train' GROUP BY split"""
)
def generation_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select(F.when(F.col("source") == "src0", "train").otherwise(F.concat(F.lit("eval_"), "lang")).alias("split"), F.when(F.col("n_chars") % 2 == 0, "masking").alias("scenario_family"))
    return generation.generation_report(rows)


@plans.query(
    """WITH t AS (SELECT c_custkey AS id, c_custkey % 4 AS k, c_nationkey FROM customer)
       SELECT id, CASE k WHEN 0 THEN 'pay_bill,get_balance' WHEN 1 THEN 'change_plan,get_balance' WHEN 2 THEN 'func_1' ELSE 'kpi_query' END AS shown,
              CASE WHEN k = 0 THEN 'pay_bill' WHEN k = 1 THEN 'change_plan' ELSE '' END AS contracts, CASE WHEN k < 2 THEN 'true' ELSE '' END AS verified, 'call ' || c_nationkey AS request FROM t"""
)
def prompt_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts with a sample's tools, suggested and filling ones that the registry holds, contracts and codes; a masked tool hides its original."""
    k = F.col("c_custkey") % 4
    gold = _call(F.when(k == 0, "pay_bill").when(k == 1, "change_plan").when(k == 2, "get_balance").otherwise("kpi_query"), F.lit("{}"))
    samples = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("id"), F.concat(F.lit("call "), F.col("c_nationkey").cast("string")).alias("instruction"), gold.alias("gold_call"), F.lit(None).cast(CALL).alias("checker_call"),
        F.lit(None).cast(f"array<{CALL}>").alias("gold_calls"), F.lit(None).cast(f"array<{CALL}>").alias("gold_steps"), F.lit(True).alias("customer_verified"),
        F.when(k == 3, REAL_SOURCE).otherwise("orders").alias("source"), F.when(k == 2, "get_balance").alias("masked_original"), F.when(k == 2, '{"name":"func_1"}').alias("masked_json"),
    )
    known = registry.compact_tool(transactional_tools(spark).unionByName(read_only_tools(spark)))
    codes = spark.createDataFrame([(0, "location_code", "L1", "Hanoi"), (1, "location_code", "L1", "again"), (2, "unit_code", "U", "x")], "pos int, kind string, code string, name string")
    plain = retrieval.with_prompts(samples.where("source = 'orders' and masked_original is null"), known, retrieval.compact_contracts(contracts(spark)), None, "sys")
    rest = retrieval.with_prompts(samples.where(f"source = '{REAL_SOURCE}' or masked_original is not null"), known, None, codes, "sys")
    text = F.col("messages")[1]["content"]
    request = F.regexp_extract(text, "^User request: (.*)\n\n", 1)
    shape = "struct<available_tools:array<struct<name:string>>,customer_verified:boolean,tool_contracts:array<struct<tool_name:string>>,reference_codes:map<string,map<string,string>>>"
    out = plain.unionByName(rest).withColumn("c", F.from_json(F.regexp_extract(text, r"(?s)\n(\{.*)$", 1), shape))
    codes_ok = F.col("c.reference_codes").isNull() | (F.col("c.reference_codes")["location_code"]["L1"] == "Hanoi")
    return out.where(codes_ok).select("id", F.array_join(F.transform("c.available_tools", lambda t: t["name"]), ",").alias("shown"), F.coalesce(F.array_join(F.transform("c.tool_contracts", lambda t: t["tool_name"]), ","), F.lit("")).alias("contracts"), F.coalesce(F.col("c.customer_verified").cast("string"), F.lit("")).alias("verified"), request.alias("request"))


def _hard_plan_sql() -> str:
    date = "'2024-01-0' || (1 + {} % 9)"
    return f"""
        WITH g AS (SELECT CASE WHEN p_partkey % 2 = 1 THEN 'kpi' ELSE 'station' END AS tool_name, p_partkey // 2 AS i, 'L' || (p_size % 25) AS loc, {date.format("p_partkey")} AS d, 'K' || (p_size % 5) AS kpi FROM part),
             t AS (SELECT 'L' || (CAST(json_extract_string(props, '$.k') AS INT) % 20) AS loc, {date.format("event_id")} AS d, 'K' || (event_id % 5) AS kpi FROM events),
             rare AS (SELECT code, row_number() OVER (ORDER BY n, code) - 1 AS place FROM (SELECT 'L' || c AS code, (SELECT count(*) FROM t WHERE loc = 'L' || c) AS n FROM range(25) AS r(c)) ORDER BY n, code LIMIT 8),
             n AS (SELECT count(*) // 2 AS n FROM part),
             fresh AS (SELECT tool_name, i, loc FROM (SELECT g.*, row_number() OVER (ORDER BY i, tool_name) AS r FROM g WHERE i < CAST(floor((SELECT n FROM n) * 1.6) AS BIGINT) AND (tool_name = 'station' OR (loc, d, kpi) NOT IN (SELECT loc, d, kpi FROM t))) WHERE r <= (SELECT n FROM n)),
             k AS (SELECT * FROM g WHERE i < (SELECT n FROM n)),
             j AS (SELECT 'hard_rare_location' AS scenario, tool_name, i, code AS loc, 0 AS missing FROM k JOIN rare ON i % 8 = place WHERE tool_name = 'kpi'
                   UNION ALL SELECT 'hard_disambiguation', tool_name, i, loc, 0 FROM k WHERE tool_name = 'kpi'
                   UNION ALL SELECT 'hard_no_train_overlap', tool_name, i, CASE WHEN tool_name = 'kpi' THEN loc END, 0 FROM fresh
                   UNION ALL SELECT s, tool_name, i, CASE WHEN tool_name = 'kpi' AND i % 3 = 1 THEN loc END, CASE WHEN tool_name = 'kpi' THEN CASE i % 3 WHEN 0 THEN 3 ELSE 2 END ELSE CASE i % 2 WHEN 0 THEN 2 ELSE 3 END END FROM k, (VALUES ('hard_missing_multi'), ('hard_missing_natural')) AS v(s)
                   UNION ALL SELECT 'hard_missing_rare_slot', tool_name, i, CASE WHEN tool_name = 'kpi' THEN loc END, 1 FROM k
                   UNION ALL SELECT 'hard_parallel_implicit', 'kpi', x.i, NULL, 0 FROM k x JOIN k y ON x.i = y.i AND x.tool_name = 'kpi' AND y.tool_name = 'station')
        SELECT scenario, tool_name, count(*) AS n, sum(i)::BIGINT AS total, count(DISTINCT loc) AS places, min(loc) AS first_place, sum(missing)::BIGINT AS missing FROM j GROUP BY 1, 2"""


@plans.query(_hard_plan_sql())
def hard_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs of every hard family over the parts as argument sets, against all events as training calls."""
    c = F.col
    props = {"kpi": ("location_code", "from_date", "to_date", "kpi_code"), "station": ("station_code", "from_date", "to_date")}
    made = _tools(spark, [(name, False, "{" + ", ".join(f'"{p}": {{"type": "string"}}' for p in ps) + "}", list(ps)) for name, ps in props.items()]).withColumn("description", F.concat(F.lit("Shows "), "name"))
    date = lambda x: F.concat(F.lit("2024-01-0"), (1 + x % 9).cast("string"))
    place, kpi, to = F.concat(F.lit("L"), (c("p_size") % 25).cast("string")), F.concat(F.lit("K"), (c("p_size") % 5).cast("string")), F.lit("2024-01-31")
    odd = c("p_partkey") % 2 == 1
    args = F.when(odd, F.to_json(F.struct(place.alias("location_code"), date(c("p_partkey")).alias("from_date"), to.alias("to_date"), kpi.alias("kpi_code")))).otherwise(F.to_json(F.struct(F.concat(F.lit("S"), c("p_size").cast("string")).alias("station_code"), date(c("p_partkey")).alias("from_date"), to.alias("to_date"))))
    grid = spread(table(spark, sf_dir, "part").select("p_partkey", "p_size")).select(F.when(odd, "kpi").otherwise("station").alias("name"), F.floor(c("p_partkey") / 2).alias("i"), args.alias("arguments"), F.create_map(F.lit("location_code"), place, F.lit("_time"), to).alias("hints"))
    k = F.get_json_object("props", "$.k").cast("int")
    seen = F.to_json(F.struct(F.concat(F.lit("L"), (k % 20).cast("string")).alias("location_code"), date(c("event_id")).alias("from_date"), to.alias("to_date"), F.concat(F.lit("K"), (c("event_id") % 5).cast("string")).alias("kpi_code")))
    none = F.lit(None).cast(f"array<{CALL}>")
    train = spread(table(spark, sf_dir, "events").select("event_id", "props")).select(_call("kpi", seen).alias("gold_call"), none.alias("gold_calls"), none.alias("gold_steps"))
    codes = spark.createDataFrame([("location_code", f"L{i}") for i in range(25)], "param string, code string")
    contrasts = spark.createDataFrame([(0, "kpi", "station", "figures", "stations"), (1, "nope", "kpi", "x", "y")], "pair int, a string, b string, a_text string, b_text string")
    pairs = spark.createDataFrame([(0, "kpi", "station"), (1, "kpi", "nope")], "pair int, a string, b string")
    jobs = hard.hard_jobs(made, grid, train, codes, contrasts, pairs, table(spark, sf_dir, "part").count() // 2, 8)
    where = F.try_element_at(args_map(c("arguments")), F.lit("location_code")).cast("string")
    missing = F.when(c("missing_slots").isNull(), 0).otherwise(F.size("missing_slots"))
    # by place first: a row is parsed once
    placed = jobs.groupBy("scenario", "tool_name", where.alias("place")).agg(F.count("*").alias("n"), F.sum("i").alias("total"), F.sum(missing).alias("missing"))
    return placed.groupBy("scenario", "tool_name").agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.count("place").alias("places"), F.min("place").alias("first_place"), F.sum("missing").alias("missing"))
