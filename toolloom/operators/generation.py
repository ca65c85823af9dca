"""Rows of generated corpora: jobs for a text generator, samples from its texts, hard variants, training files.

A job is a row with a ``job_id`` and all that its sample will hold but the instruction; texts come back with the
same id, so a missing or extra text never shifts another. Samples have the columns of ``evaluator`` and ``audit``:
``id, source, split, scenario, scenario_family, instruction, expected_action, gold_call, ...``, arguments JSON texts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from toolloom.functions.json import CALL, args_map, call_signature, json_array_candidate
from toolloom.functions.text import TOKEN, first_line, token_set, too_short
from toolloom.functions.values import shared_override
from toolloom.operators import audit, dedup
from toolloom.operators.derivation import SHARED
from toolloom.operators.ranks import first_k
from toolloom.operators.rounds import settled
from toolloom.operators.sampling import hash_order, hold_out
from toolloom.operators.scoring import REAL_SOURCE
from toolloom.operators.validation import PLACEHOLDER

#: Labels of hints in their order; a label of None shows the hint alone.
HINTS = {"location_code": "địa điểm: ", "object_code": "địa điểm: ", "station_code": "trạm: ", "_time": "thời gian: ", "_granularity": "mức thời gian: ", "_topk": "", "kpi_code": "chỉ số: ", "unit_code": "đơn vị: "}
#: Texts of requests, reasons and verdicts.
OUT_OF_SCOPE = "ngoài phạm vi công cụ KPI"
SAYS, LEFT_OUT, ANYWHERE = ("Nội dung: ", ". Phải nêu: "), ("  (CỐ TÌNH KHÔNG nêu ", ")"), "Hà Nội"
CHAINED = ("Quy trình 2 bước: trước tiên tìm các trạm ở ", " trong ", ", sau đó tra cứu ", " của các trạm đó.")
TOGETHER = ("Hỏi CẢ HAI trong một câu: (1) ", "; (2) ", ". ")
MASK_REQUEST = ("Dùng ", " để: ")
YES, NO = "CO", "KHONG"
#: Public sources of warm-up rows, and the prefix of masked rows.
PUBLIC_SOURCES = ("apigen_mt", "hermes_fc", "toolace", "xlam")
MASK_PREFIX = "real_mask_"


def spec_text(description: Column, hints: Column, left_out: Column | None = None) -> Column:
    """What a request must say: the first sentence of a tool's description, hints (map) in fixed order, others behind them."""
    told = [F.when(F.map_contains_key(hints, F.lit(k)), F.concat(F.lit(label), F.element_at(hints, F.lit(k)))) for k, label in HINTS.items()]
    others = F.map_values(F.map_filter(hints, lambda k, v: ~k.isin(list(HINTS))))
    parts = F.concat(F.filter(F.array(*told), lambda x: x.isNotNull()), others)
    text = F.concat(F.lit(SAYS[0]), F.substring(F.split(description, r"\.")[0], 1, 90), F.lit(SAYS[1]), F.array_join(parts, "; "))
    return text if left_out is None else F.concat(text, F.lit(LEFT_OUT[0]), left_out, F.lit(LEFT_OUT[1]))


def call_of(tool: Column, arguments: Column) -> Column:
    return F.struct(tool.alias("tool_name"), arguments.alias("arguments")).cast(CALL)


def with_texts(jobs: DataFrame, texts: DataFrame) -> DataFrame:
    """``jobs(job_id, ...)`` with ``instruction`` from ``texts(job_id, raw)``: reasoning, quotes and further lines cut; jobs without a text go."""
    said = texts.select("job_id", first_line(F.col("raw")).alias("instruction"))
    return jobs.join(said, "job_id").where(F.coalesce(F.col("instruction"), F.lit("")) != "")


def _plain(df: DataFrame, ident: Column, scenario: Column, family: str, action: str, split: Column) -> DataFrame:
    return df.withColumns({"id": ident, "source": F.lit(REAL_SOURCE), "split": split, "scenario": scenario, "scenario_family": F.lit(family), "expected_action": F.lit(action)})


def single_step(jobs: DataFrame, texts: DataFrame) -> DataFrame:
    """One-call samples of ``jobs(job_id, i, tool_name, arguments, split)``."""
    rows = with_texts(jobs, texts)
    ident = F.concat(F.lit("real_"), "split", F.lit("_"), "tool_name", F.lit("_single_step_valid_"), F.format_string("%04d", F.col("i")))
    out = _plain(rows, ident, F.lit("valid_kpi_read"), "single_step_valid", "call_function", F.col("split"))
    return out.withColumn("gold_call", call_of(F.col("tool_name"), F.col("arguments"))).drop("job_id", "i", "tool_name", "arguments")


def refusals(outputs: DataFrame, n: int, kind: str = "abstain", scenario: str = "irrelevance", family: str = "abstain") -> DataFrame:
    """Refusal samples from ``outputs(batch, raw)``, JSON arrays of requests: items that are no text or blank go, the first ``n`` by batch and place stay."""
    items = F.try_variant_get(F.try_parse_json(json_array_candidate(F.col("raw"))), "$", "array<variant>")
    rows = outputs.select("batch", F.posexplode(items).alias("j", "item")).where(F.schema_of_variant("item") == "STRING")
    rows = rows.select("batch", "j", F.trim(F.col("item").cast("string")).alias("instruction")).where("instruction <> ''")
    rows = first_k(rows, n, ["batch", "j"])[0]
    ident = F.concat(F.lit(f"real_{kind}_"), F.col("batch").cast("string"), F.lit("_"), F.format_string("%03d", F.col("j")))
    return _plain(rows, ident, F.lit(scenario), family, "abstain", F.lit("seen")).withColumn("reason", F.lit(OUT_OF_SCOPE)).drop("batch", "j")


def questions(jobs: DataFrame, texts: DataFrame, combos: Sequence[Sequence[str]], scenario: str = "hard_multi_drop", family: str = "hard_missing") -> DataFrame:
    """Samples whose request leaves out slots: ``combos`` take turns by ``i``, slots that the arguments lack are passed over, a row without any goes.

    ``jobs(job_id, i, tool_name, arguments, split)``; ``missing_slots``, and the call without them as ``checker_call``.
    """
    turn = F.element_at(F.array(*(F.array(*map(F.lit, c)) for c in combos)), (F.pmod(F.col("i"), F.lit(len(combos))) + 1).cast("int"))
    args = args_map(F.col("arguments"))
    rows = with_texts(jobs, texts).withColumn("missing_slots", F.filter(turn, lambda s: F.map_contains_key(args, s))).where("size(missing_slots) > 0")
    kept = F.to_json(F.map_filter(args, lambda k, v: ~F.array_contains("missing_slots", k)))
    ident = F.concat(F.lit("real_"), F.lit(family), F.lit("_"), "tool_name", F.lit("_"), F.format_string("%04d", F.col("i")))
    out = _plain(rows, ident, F.lit(scenario), family, "ask_clarification", F.col("split"))
    return out.withColumns({"checker_call": call_of(F.col("tool_name"), kept), "checker_expected_status": F.lit("schema_invalid")}).drop("job_id", "i", "tool_name", "arguments")


def paired_tools(pairs: DataFrame, tools: DataFrame) -> DataFrame:
    """``pairs(a, b, ...)`` of which the registry ``tools(name, description, ...)`` holds both, with both descriptions."""
    first, second = (tools.select(F.col("name").alias(side), F.col("description").alias(f"{side}_description")) for side in ("a", "b"))
    return pairs.join(first, "a").join(second, "b")


def pair_jobs(pairs: DataFrame, tools: DataFrame, grid: DataFrame, per_pair: int, chained: bool = False) -> DataFrame:
    """``per_pair`` jobs a pair of tools: ``job_id, pair, i, spec, calls``.

    ``pairs(pair, a, b)``, with ``key`` if ``chained``; ``grid(name, i, arguments, hints)`` holds argument sets of tools. Parallel calls share
    place and period of the first; the second of chained ones waits for the first's result in ``key``.
    """
    turns = paired_tools(pairs, tools).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(per_pair - 1))))
    first = grid.select(F.col("name").alias("a"), "i", F.col("arguments").alias("_a"), F.col("hints").alias("_hints"))
    second = grid.select(F.col("name").alias("b"), "i", F.col("arguments").alias("_b"))
    both = turns.join(first, ["a", "i"]).join(second, ["b", "i"])
    a, b = args_map(F.col("_a")), args_map(F.col("_b"))
    if chained:
        rest = F.map_filter(b, lambda k, v: k != F.col("key"))
        waiting = F.map_concat(rest, F.create_map(F.col("key"), F.parse_json(F.lit(f'"{PLACEHOLDER}"'))))
        place = F.coalesce(F.try_element_at("_hints", F.lit("location_code")), F.try_element_at("_hints", F.lit("object_code")), F.lit(ANYWHERE))
        when = F.coalesce(F.concat(F.lit(CHAINED[1]), F.try_element_at("_hints", F.lit("_time"))), F.lit(""))
        spec = F.concat(F.lit(CHAINED[0]), place, when, F.lit(CHAINED[2]), F.substring(F.split("b_description", r"\.")[0], 1, 60), F.lit(CHAINED[3]))
    else:
        waiting = shared_override(b, a, SHARED)
        told = F.map_filter("_hints", lambda k, v: k.startswith("_") | k.isin("location_code", "object_code"))
        heads = [F.substring(F.split(f"{side}_description", r"\.")[0], 1, 60) for side in ("a", "b")]
        spec = F.concat(F.lit(TOGETHER[0]), heads[0], F.lit(TOGETHER[1]), heads[1], F.lit(TOGETHER[2]), F.element_at(F.split(spec_text(F.col("a_description"), told), SAYS[1].strip(" .")), -1))
    calls = F.array(call_of(F.col("a"), F.to_json(a)), call_of(F.col("b"), F.to_json(waiting)))
    return both.select(F.concat_ws("_", F.col("pair").cast("string"), F.col("i").cast("string")).alias("job_id"), "pair", "i", spec.alias("spec"), calls.alias("calls"))


def several_calls(jobs: DataFrame, texts: DataFrame, steps: bool = False, family: str | None = None) -> DataFrame:
    """Samples of pair jobs: sets of calls, or steps."""
    kind = "multistep" if steps else "parallel"
    rows = with_texts(jobs, texts)
    ident = F.concat(F.lit(f"real_{kind}_"), F.col("pair").cast("string"), F.lit("_"), F.format_string("%04d", F.col("i")))
    out = _plain(rows, ident, F.lit("dependency" if steps else "parallel_reads"), family or ("multi_step" if steps else "parallel"), "call_functions", F.lit("seen"))
    return out.withColumnRenamed("calls", "gold_steps" if steps else "gold_calls").drop("job_id", "pair", "i", "spec")


def masked_eval(samples: DataFrame, tools: DataFrame, position: str = "pos") -> DataFrame:
    """Twins of one-call samples whose tool goes by ``func_N``, N by position; the masked schema travels in the row, samples of unknown tools go."""
    schema = tools.select(F.col("name").alias("_name"), F.struct("name", "deprecated", "params").alias("_tool"))
    rows = samples.where("expected_action = 'call_function'").withColumn("_masked", F.concat(F.lit("func_"), (F.col(position) + 1).cast("string")))
    rows = rows.join(schema, F.col("gold_call.tool_name") == F.col("_name"))
    out = _plain(rows, F.concat(F.lit("real_eval_mask_"), F.format_string("%03d", F.col(position))), F.lit("function_name_masking"), "masking", "call_function", F.lit("eval_real_masked"))
    out = out.withColumn("instruction", F.concat(F.lit(MASK_REQUEST[0]), "_masked", F.lit(MASK_REQUEST[1]), "instruction"))
    out = out.withColumn("gold_call", call_of(F.col("_masked"), F.col("gold_call.arguments"))).withColumn("masked_tool", F.col("_tool").withField("name", F.col("_masked")).withField("deprecated", F.lit(False)))
    return out.drop("_masked", "_name", "_tool")


def masking_stage(samples: DataFrame) -> DataFrame:
    """The rows of the masking stage, by their ids."""
    return samples.where(F.col("id").startswith(MASK_PREFIX))


def public_only(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("source").isin(*PUBLIC_SOURCES))


def seed_rows(tools: DataFrame) -> DataFrame:
    """Evaluation rows of ``tools(name, seed_examples array<struct<query, call>>)``, calls as JSON texts of arguments; examples without both go."""
    rows = tools.select("name", F.posexplode("seed_examples").alias("i", "e")).where((F.coalesce(F.trim("e.query"), F.lit("")) != "") & (F.coalesce(F.col("e.call"), F.lit("")).rlike(r"\{\s*\"")))
    ident = F.concat(F.lit("real_eval_real_unseen_"), "name", F.lit("_single_step_valid_"), F.format_string("%04d", F.col("i")))
    out = _plain(rows, ident, F.lit("valid_unseen_tool"), "single_step_valid", "call_function", F.lit("eval_real_unseen"))
    return out.withColumns({"instruction": F.trim("e.query"), "gold_call": call_of(F.col("name"), F.col("e.call"))}).drop("name", "i", "e")


def signatures(calls: DataFrame) -> DataFrame:
    """``_sig``, the different signatures of ``calls(tool_name, arguments)``; equal texts are parsed once."""
    return calls.select("tool_name", "arguments").distinct().select(call_signature(F.col("tool_name"), F.col("arguments")).alias("_sig")).distinct()


def first_of_copies(samples: DataFrame) -> DataFrame:
    """``samples`` without the rows that an earlier one (``pos``) equals in all that verification and de-duplication read; rows without a word all stay."""
    worded = F.coalesce(F.lower("instruction").rlike(TOKEN), F.lit(False))
    first = samples.where(worded).groupBy(*audit.CONTENT).agg(F.min("pos").alias("pos")).select("pos")
    return samples.where(worded).join(first, "pos", "left_semi").select(*samples.columns).unionByName(samples.where(~worded))


def without_overlap(samples: DataFrame, train: DataFrame, n: int, flag: str = "filter_overlap", position: str = "pos") -> DataFrame:
    """Of the rows that ``flag`` marks those whose gold call is none of ``train``'s, the first ``n`` by position; all others as they are."""
    seen = signatures(train.where(F.col("gold_call").isNotNull()).select("gold_call.tool_name", "gold_call.arguments"))
    marked = F.coalesce(F.col(flag), F.lit(False))
    fresh = samples.where(marked).withColumn("_sig", call_signature(F.col("gold_call.tool_name"), F.col("gold_call.arguments"))).join(seen, "_sig", "left_anti").drop("_sig")
    return samples.where(~marked).unionByName(first_k(fresh, n, [position])[0].select(*samples.columns)).drop(flag)


def hard_sets(samples: DataFrame, tools: DataFrame, references: DataFrame, names: DataFrame, train: DataFrame, n: int) -> DataFrame:
    """Hard evaluation rows: verified, near-duplicates gone, no overlap with ``train``, split by family.

    ``samples`` as ``audit`` wants them, with ``pos`` (their order) and ``filter_overlap``. Of each family and primary
    tool a row goes if one kept before it is more than 0.85 alike, or three with its very calls are. Copies go before anything
    is verified: they pass or fail together, and the first would rule out the others.
    """
    kept = settled(audit.verify(first_of_copies(samples), tools, references, names).where("first_fail is null").drop("first_fail"))  # read several times below
    c = F.col
    calls = audit.all_calls(c("gold_call"), c("gold_calls"), c("gold_steps"))
    signed = F.coalesce(F.array_join(F.transform(F.when(F.size(calls) > 0, calls).otherwise(F.array(c("checker_call"))), lambda x: call_signature(x["tool_name"], x["arguments"])), ";"), F.lit(""))
    tool = audit.primary_tool(c("gold_call"), c("gold_calls"), c("gold_steps"), c("checker_call"))
    light = kept.select(F.concat_ws("|", "scenario_family", tool).alias("key"), "pos", token_set(c("instruction")).alias("tokens"), signed.alias("signature"), (c("scenario_family") == "hard_abstain").alias("exempt"))
    unique = kept.join(dedup.greedy(light).select("pos"), "pos", "left_semi")
    return without_overlap(unique, train, n).withColumn("split", F.concat(F.lit("eval_real_"), "scenario_family"))


def synthetic_actions(templates: DataFrame, tools: DataFrame) -> DataFrame:
    """Refusals and questions of ``templates(kind, pos, tool_name, instruction, reason, missing_slots)``; templates of unknown tools go.

    ``kind`` is what makes the request one: a contract's condition, a deprecated tool, a missing argument ...; a template
    with slots asks for them.
    """
    held = tools.select(F.col("name").alias("tool_name"), "description")
    asks = F.coalesce(F.size("missing_slots") > 0, F.lit(False))
    rows = templates.join(held, "tool_name")
    number = F.format_string("%03d", F.col("pos") + 1)
    answer = F.when(asks, F.to_json(F.struct(F.lit("ask_clarification").alias("action"), F.col("missing_slots").alias("asked_slots")))).otherwise(F.to_json(F.struct(F.lit("abstain").alias("action"), "reason")))
    kind = F.when(asks, "clarify").otherwise("abstain")
    return rows.select(F.concat_ws("_", F.lit("synth"), kind, "kind", number).alias("id"), F.lit("synthetic").alias("source"), "instruction", F.when(asks, "ask_clarification").otherwise("abstain").alias("expected_action"), "missing_slots", answer.alias("answer"), F.col("tool_name").alias("shown_tool"))


def action_shares(rows: DataFrame) -> DataFrame:
    """``expected_action, n, share`` (percent of all rows, one digit)."""
    counts = rows.groupBy("expected_action").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("_total"))  # one row
    return counts.crossJoin(total).select("expected_action", "n", F.round(100 * F.col("n") / F.col("_total"), 1).alias("share"))


def training_files(domain: DataFrame, warmup: DataFrame, n_eval: int, n_warmup: int, seed: int = 42) -> DataFrame:
    """``file, place, id, source, expected_action, messages``: held-out domain rows, and the rest mixed with warm-up rows.

    Both draws and the order (``place``) follow hashes of ids; warm-up rows without source or action get the defaults.
    """
    columns = ["id", "source", "expected_action", "messages"]
    held, rest = hold_out(domain.select(*columns), n_eval, "id", seed=seed)
    drawn, _ = hold_out(warmup.select("id", F.coalesce("source", F.lit("warmup")).alias("source"), F.coalesce("expected_action", F.lit("call_function")).alias("expected_action"), "messages"), n_warmup, "id", seed=seed + 1)
    files = held.withColumn("file", F.lit("eval")).unionByName(rest.unionByName(drawn).withColumn("file", F.lit("train")))
    return files.withColumn("place", hash_order(seed + 2, "id")).select("file", "place", *columns)


def train_or_eval(samples: DataFrame) -> DataFrame:
    """``samples`` with ``file``: ``train`` for the training split, ``eval`` for all others."""
    return samples.withColumn("file", F.when(F.col("split") == "train", "train").otherwise("eval"))


def anchors(samples: DataFrame) -> DataFrame:
    """Refusal samples with ``gold``, the stored refusal or the default one."""
    stored = F.to_json(F.struct(F.col("prediction.action").alias("action"), F.col("prediction.reason").alias("reason")))
    default = F.to_json(F.struct(F.lit("abstain").alias("action"), F.lit(OUT_OF_SCOPE).alias("reason")))
    return samples.where("expected_action = 'abstain'").withColumn("gold", F.when(F.col("prediction.action") == "abstain", stored).otherwise(default))


def verdicts(samples: DataFrame, answers: DataFrame, size: int = 10, position: str = "pos") -> DataFrame:
    """``samples`` with ``verdict`` of a judge that answered in batches of ``size``: ``answers(batch, raw)``, JSON arrays.

    An item holds unless it says no; what is missing or no array counts as yes.
    """
    items = F.try_variant_get(F.try_parse_json(json_array_candidate(F.col("raw"))), "$", "array<variant>")
    said = answers.select(F.col("batch").alias("_batch"), F.transform(items, lambda v: F.upper(F.coalesce(F.try_variant_get(v, "$", "string"), F.to_json(v)))).alias("_said"))
    rows = samples.withColumn("_batch", F.floor(F.col(position) / size)).join(said, "_batch", "left")
    item = F.coalesce(F.try_element_at("_said", (F.pmod(F.col(position), F.lit(size)) + 1).cast("int")), F.lit(YES))
    return rows.withColumn("verdict", item.contains(YES) & ~item.contains(NO)).drop("_batch", "_said")


def generation_report(samples: DataFrame) -> DataFrame:
    """``section, name, n``: all training rows, training rows by family, rows of each evaluation split, all evaluation rows."""
    train = F.col("split") == "train"
    counted = samples.groupBy("split", F.coalesce("scenario_family", F.lit("unknown")).alias("family")).agg(F.count("*").alias("n"))
    rows = F.when(train, F.array(_line("train_total", F.lit("")), _line("train_by_family", F.col("family")))).otherwise(F.array(_line("eval_total", F.lit("")), _line("eval_counts", F.col("split"))))
    return counted.select("n", F.explode(rows).alias("r")).groupBy(F.col("r.section").alias("section"), F.col("r.name").alias("name")).agg(F.sum("n").alias("n"))


def _line(section: str, name: Column) -> Column:
    return F.struct(F.lit(section).alias("section"), name.alias("name"))


def call_spec(scenario_id: str, split: str, scenario: str, instruction: str, tool: str, arguments: str, **more: object) -> dict:
    """A hand-written sample with a call; ``gold_calls`` or ``gold_steps`` make it a sample of several."""
    several = more.get("gold_steps") or more.get("gold_calls")
    made = {"gold_call": (tool, arguments), "expected_status": "ok", "scenario_family": "single_step_valid"}
    return _spec(scenario_id, split, scenario, instruction, "call_functions" if several else "call_function", made | more)


def question_spec(scenario_id: str, split: str, scenario: str, instruction: str, missing_slots: Sequence[str], **more: object) -> dict:
    return _spec(scenario_id, split, scenario, instruction, "ask_clarification", {"missing_slots": list(missing_slots), "scenario_family": "missing_slot"} | more)


def refusal_spec(scenario_id: str, split: str, scenario: str, instruction: str, reason: str, **more: object) -> dict:
    return _spec(scenario_id, split, scenario, instruction, "abstain", {"reason": reason, "scenario_family": "abstention"} | more)


#: Columns of hand-written samples.
SPEC = f"id string, split string, scenario string, instruction string, expected_action string, scenario_family string, customer_verified boolean, expected_status string, gold_call {CALL}, gold_calls array<{CALL}>, gold_steps array<{CALL}>, missing_slots array<string>, reason string, checker_call {CALL}, checker_expected_status string"


def _spec(scenario_id: str, split: str, scenario: str, instruction: str, action: str, more: dict) -> dict:
    row = {"id": scenario_id, "split": split, "scenario": scenario, "instruction": instruction, "expected_action": action, "customer_verified": True} | more
    known = [f.split()[0] for f in SPEC.replace(CALL, "call").split(", ")]
    if extra := set(row) - set(known):
        raise ValueError(f"no such fields of a sample: {sorted(extra)}")
    return {name: row.get(name) for name in known}


def specs(spark: SparkSession, rows: Sequence[dict]) -> DataFrame:
    """Hand-written samples as a table; a repeated id raises."""
    ids = [r["id"] for r in rows]
    if len(set(ids)) < len(ids):
        raise ValueError(f"repeated ids: {sorted({i for i in ids if ids.count(i) > 1})}")
    return spark.createDataFrame([tuple(r.values()) for r in rows], SPEC)


def rule_ok(df: DataFrame) -> DataFrame:
    """Rows whose instruction is long enough."""
    return df.where(~too_short(F.col("instruction")))
