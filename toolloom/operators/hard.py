"""Jobs of hard evaluation sets, planned against the training table: what training shows least, or not at all.

A job is a call (or two) with a text that a request for it must follow; a generator's answers come by job id
(``hard_samples``) and go through ``generation.hard_sets``. All families are joins of argument sets with small tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from toolloom.functions.json import CALL, args_map, call_signature
from toolloom.operators import audit, generation
from toolloom.operators.ranks import first_k, numbered
from toolloom.operators.rounds import settled
from toolloom.operators.sampling import over_generated
from toolloom.operators.scoring import REAL_SOURCE
from toolloom.operators.validation import PLACEHOLDER

PLACES = ("location_code", "object_code")
#: Labels of slots that a request leaves out.
SLOT_LABELS = {"station_code": "mã trạm", "kpi_code": "chỉ số KPI", "unit_code": "đơn vị"}
#: Combinations of slots to leave out, in turn; PLACE is the tool's place slot.
PLACE = "?"
COMBINATIONS = [(("from_date", "to_date", PLACE), "thời gian và địa điểm"), (("from_date", "to_date"), "khoảng thời gian"), ((PLACE, "kpi_code"), "địa điểm và chỉ số KPI"), (("station_code", "from_date", "to_date"), "trạm và thời gian"), (("kpi_code", "unit_code"), "chỉ số và đơn vị")]
#: Texts of specifications.
NOT_SAID, ABOUT, AT, DURING, TELL_APART = " (KHÔNG nêu {})", "Viết câu hỏi về '{}'", " tại {}", " trong {}", ". Phân biệt rõ với '{}' — câu hỏi phải chỉ rõ đây là {}."
BOTH = ("Cần biết: (1) {}; (2) {}.", " Tại: {}.", " Thời gian: {}.", " KHÔNG dùng 'cả hai' hay 'đồng thời' trong câu.")
#: Argument sets of a job: name, number, arguments (JSON) and hints (map) of ``grid``.
JOB = "job_id string, family string, scenario string, tool_name string, i bigint, arguments string, missing_slots array<string>, calls array<struct<tool_name:string,arguments:string>>, spec string"


def _said(template: str, *parts: Column) -> Column:
    """A template with its gaps filled."""
    pieces = template.split("{}")
    return F.concat(*(x for piece, part in zip(pieces, [*parts, None], strict=True) for x in (F.lit(piece), part) if x is not None))


def _first_sentence(text: Column, n: int) -> Column:
    return F.substring(F.split(text, r"\.")[0], 1, n)


def _job(df: DataFrame, ident: Column, family: str, scenario: str, spec: Column, arguments: Column | None = None, missing: Column | None = None, calls: Column | None = None) -> DataFrame:
    null = lambda kind: F.lit(None).cast(kind)
    return df.select(
        ident.alias("job_id"), F.lit(family).alias("family"), F.lit(scenario).alias("scenario"), "tool_name", F.col("i").cast("long").alias("i"), (null("string") if arguments is None else arguments).alias("arguments"),
        (null("array<string>") if missing is None else missing).alias("missing_slots"), (null(f"array<{CALL}>") if calls is None else calls).alias("calls"), spec.alias("spec"),
    )


def _numbered(kind: str, *parts: str) -> Column:
    return F.concat_ws("_", F.lit(f"real_hard_{kind}"), *(F.col(p).cast("string") for p in parts), F.format_string("%04d", F.col("i")))


def _tool_rows(tools: DataFrame, grid: DataFrame, n: int) -> DataFrame:
    """The first ``n`` argument sets of each tool of ``tools(name, description, params)``, with its description and required slots."""
    required = F.transform(F.filter("params", lambda p: p["required"]), lambda p: p["name"])
    held = tools.select("name", "description", required.alias("required"))
    return grid.where(F.col("i") < n).join(held, "name").withColumnRenamed("name", "tool_name")


def training_calls(train: DataFrame) -> DataFrame:
    """``tool_name, arguments`` of all gold calls of a training table."""
    calls = audit.all_calls(F.col("gold_call"), F.col("gold_calls"), F.col("gold_steps"))
    return train.select(F.explode(calls).alias("c")).select("c.tool_name", "c.arguments")


def counted_calls(train: DataFrame) -> DataFrame:
    """``tool_name, arguments, n`` of the different gold calls of a training table by their texts, stored: it is read once, and a text is parsed once."""
    return settled(training_calls(train).groupBy("tool_name", "arguments").agg(F.count("*").alias("n")))


def rare_codes(counted: DataFrame, references: DataFrame, most: int, param: str = "location_code", names: tuple[str, ...] = PLACES) -> DataFrame:
    """``place, code, n``: the ``most`` codes of ``references(param, code)`` that training (``counted_calls``) uses least, unused ones first, ties by code."""
    args = args_map(F.col("arguments"))
    used = counted.select("n", F.explode(F.array(*(F.try_element_at(args, F.lit(k)).cast("string") for k in names))).alias("code")).where("code is not null")
    each = used.groupBy("code").agg(F.sum("n").alias("n"))
    codes = settled(references.where(F.col("param") == param).select("code").distinct().join(each, "code", "left").withColumn("n", F.coalesce("n", F.lit(0))))  # read several times
    first, _ = first_k(codes, most, ["n", "code"])
    return numbered(first, [], ["n", "code"], "place").select("place", "code", "n")


def rare_jobs(tools: DataFrame, grid: DataFrame, rare: DataFrame, n: int) -> DataFrame:
    """Calls at places that training uses least, which take turns; tools without a place go."""
    args = args_map(F.col("arguments"))
    rows = _tool_rows(tools, grid, n).where(F.exists(F.map_keys(args), lambda k: k.isin(*PLACES)))
    turns = rare.crossJoin(rare.agg(F.count("*").alias("_size")))  # one row
    met = rows.join(F.broadcast(turns), F.pmod(F.col("i"), F.col("_size")) == F.col("place"))  # ``most`` codes
    moved = F.to_json(F.transform_values(args, lambda k, v: F.when(k.isin(*PLACES), F.parse_json(F.concat(F.lit('"'), F.col("code"), F.lit('"')))).otherwise(v)))
    hints = F.transform_values("hints", lambda k, v: F.when(k.isin(*PLACES), F.col("code")).otherwise(v))
    return _job(met, _numbered("seen_rare", "tool_name"), "hard_seen", "hard_rare_location", generation.spec_text(F.col("description"), hints), moved)


def contrast_jobs(tools: DataFrame, grid: DataFrame, contrasts: DataFrame, n: int) -> DataFrame:
    """Calls of a tool told apart from another one: ``contrasts(pair, a, b, a_text, b_text)`` whose first tool the registry has."""
    met = _tool_rows(tools, grid, n).join(contrasts, F.col("tool_name") == F.col("a"))
    place = F.coalesce(*(F.try_element_at("hints", F.lit(k)) for k in PLACES), F.lit("Hà Nội"))
    when = F.try_element_at("hints", F.lit("_time"))
    spec = F.concat(_said(ABOUT, F.col("a_text")), _said(AT, place), F.coalesce(_said(DURING, when), F.lit("")), _said(TELL_APART, F.col("b_text"), F.col("a_text")))
    return _job(met, _numbered("seen_disambig", "pair"), "hard_seen", "hard_disambiguation", spec, F.col("arguments"))


def fresh_jobs(tools: DataFrame, grid: DataFrame, counted: DataFrame, n: int) -> DataFrame:
    """The first ``n`` calls, by number and tool, whose signature no call of training (``counted_calls``) has; more are taken up than are wanted."""
    per_tool = over_generated(n)
    seen = generation.signatures(counted)
    rows = _tool_rows(tools, grid, per_tool).withColumn("_sig", call_signature(F.col("tool_name"), F.col("arguments"))).join(seen, "_sig", "left_anti")
    rows, _ = first_k(settled(rows.drop("_sig", "required")), n, [F.col("i").cast("long"), "tool_name"])  # the cut reads them several times
    return _job(rows, _numbered("seen_nooverlap", "tool_name"), "hard_seen", "hard_no_train_overlap", generation.spec_text(F.col("description"), F.col("hints")), F.col("arguments"))


def combinations(required: Column) -> Column:
    """``struct<slots, label>`` of the combinations that a tool's required slots allow."""
    place = F.when(F.array_contains(required, PLACES[0]), PLACES[0]).when(F.array_contains(required, PLACES[1]), PLACES[1])
    each = []
    for slots, label in COMBINATIONS:
        named = F.array(*(place if s == PLACE else F.lit(s) for s in slots))
        each.append(F.when(F.forall(named, lambda s: s.isNotNull() & F.array_contains(required, s)), F.struct(named.alias("slots"), F.lit(label).alias("label"))))
    return F.array_compact(F.array(*each))


def _left_out(df: DataFrame, slots: Column, spec: Column, ident: Column, scenario: str) -> DataFrame:
    kept = F.to_json(F.map_filter(args_map(F.col("arguments")), lambda k, v: ~F.array_contains(slots, k)))
    return _job(df, ident, "hard_missing", scenario, spec, kept, slots)


def _without(hints: Column, slots: Column) -> Column:
    dates = F.array_contains(slots, "from_date") | F.array_contains(slots, "to_date")
    return F.map_filter(hints, lambda k, v: ~F.array_contains(slots, k) & ~((k == "_time") & dates))


def missing_jobs(tools: DataFrame, grid: DataFrame, n: int, natural: bool = False) -> DataFrame:
    """Requests without two or more slots, combinations in turn; ``natural``: the text doesn't say what is left out."""
    rows = _tool_rows(tools, grid, n).withColumn("_all", combinations(F.col("required"))).where("size(_all) > 0")
    rows = rows.withColumn("_c", F.element_at("_all", (F.pmod(F.col("i"), F.size("_all")) + 1).cast("int")))
    spec = generation.spec_text(F.col("description"), _without(F.col("hints"), F.col("_c.slots")))
    if natural:
        return _left_out(rows, F.col("_c.slots"), spec, _numbered("missing_nat", "tool_name"), "hard_missing_natural")
    return _left_out(rows, F.col("_c.slots"), F.concat(spec, _said(NOT_SAID, F.col("_c.label"))), _numbered("missing_multi", "tool_name"), "hard_missing_multi")


def slot_jobs(tools: DataFrame, grid: DataFrame, n: int) -> DataFrame:
    """Requests without one of the slots that are seldom left out, each that a tool requires."""
    labels = F.create_map(*(F.lit(x) for pair in SLOT_LABELS.items() for x in pair))
    rows = _tool_rows(tools, grid, n).withColumn("slot", F.explode(F.filter("required", lambda s: s.isin(list(SLOT_LABELS)))))
    spec = F.concat(generation.spec_text(F.col("description"), F.map_filter("hints", lambda k, v: k != F.col("slot"))), _said(NOT_SAID, F.element_at(labels, F.col("slot"))))
    return _left_out(rows, F.array("slot"), spec, _numbered("missing_rare", "tool_name", "slot"), "hard_missing_rare_slot")


def implicit_jobs(tools: DataFrame, grid: DataFrame, pairs: DataFrame, n: int) -> DataFrame:
    """Two calls in one request whose text may not say that they belong together; ``pairs(pair, a, b)``."""
    made = generation.pair_jobs(pairs, tools, grid, n).select("pair", F.col("i"), "calls")
    named = generation.paired_tools(pairs, tools).select("pair", "a", "a_description", "b_description")
    hints = grid.select(F.col("name").alias("a"), "i", "hints")
    rows = made.join(named, "pair").join(hints, ["a", "i"]).withColumnRenamed("a", "tool_name")
    place, when = F.coalesce(*(F.try_element_at("hints", F.lit(k)) for k in PLACES)), F.try_element_at("hints", F.lit("_time"))
    spec = F.concat(_said(BOTH[0], _first_sentence(F.col("a_description"), 55), _first_sentence(F.col("b_description"), 55)), F.coalesce(_said(BOTH[1], place), F.lit("")), F.coalesce(_said(BOTH[2], when), F.lit("")), F.lit(BOTH[3]))
    return _job(rows, _numbered("parallel_impl", "pair"), "hard_parallel", "hard_parallel_implicit", spec, calls=F.col("calls"))


def hard_jobs(tools: DataFrame, grid: DataFrame, train: DataFrame, references: DataFrame, contrasts: DataFrame, pairs: DataFrame, n: int, places: int) -> DataFrame:
    """All families in one table (``JOB``): ``n`` jobs a tool, pair or slot, of those without overlap ``n`` in all; ``places`` rare codes.

    ``tools(name, description, params)``, ``grid(name, i, arguments, hints)``, ``train`` with gold calls. Refusals come from ``generation.refusals``.
    """
    counted = counted_calls(train)
    parts = [
        rare_jobs(tools, grid, rare_codes(counted, references, places), n), contrast_jobs(tools, grid, contrasts, n), fresh_jobs(tools, grid, counted, n),
        missing_jobs(tools, grid, n), missing_jobs(tools, grid, n, natural=True), slot_jobs(tools, grid, n), implicit_jobs(tools, grid, pairs, n),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def hard_samples(jobs: DataFrame, texts: DataFrame) -> DataFrame:
    """Samples of ``hard_jobs`` with the requests of ``texts(job_id, raw)``; jobs without a text go, so does a request that gives a waiting value away."""
    rows = generation.with_texts(jobs, texts).where(~F.contains("instruction", F.lit(PLACEHOLDER)))
    asks, several = F.col("missing_slots").isNotNull(), F.col("calls").isNotNull()
    call = generation.call_of(F.col("tool_name"), F.col("arguments"))
    action = F.when(asks, "ask_clarification").when(several, "call_functions").otherwise("call_function")
    return rows.select(
        F.col("job_id").alias("id"), F.lit(REAL_SOURCE).alias("source"), "scenario", F.col("family").alias("scenario_family"), "instruction", action.alias("expected_action"), F.when(~asks & ~several, call).alias("gold_call"),
        F.col("calls").alias("gold_calls"), "missing_slots", F.when(asks, call).alias("checker_call"), F.when(asks, "schema_invalid").alias("checker_expected_status"), (F.col("scenario") == "hard_no_train_overlap").alias("filter_overlap"),
    )
