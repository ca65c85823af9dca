"""First-fail verification and the row-level audit, as expressions over samples.

Calls are ``struct<tool_name, arguments>``, arguments JSON texts in samples and maps of variants in the layers' expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from toolloom.functions.json import args_map
from toolloom.functions.text import has_phrase, is_date, token_set, tokens, too_short
from toolloom.functions.values import first_filled
from toolloom.operators.evaluator import CALLS, catalogue, code_keys, tool_keys, with_listed
from toolloom.operators.lookup import key, with_lookups
from toolloom.operators.validation import PLACEHOLDER, schema_issues

SHORT = 8
DATE_KEYS = ("from_date", "to_date", "date")
#: Arguments that have a catalogue of their own.
CATALOGUES = ("location_code", "kpi_code", "unit_code", "station_code")
#: All that checks and verification read of a sample, but a judge's verdict: samples equal in it fare alike.
CONTENT = ("instruction", "scenario_family", "expected_action", "gold_call", "gold_calls", "gold_steps", "missing_slots", "checker_call", "reason", "masked_tool")


def _text(args: Column, key: str) -> Column:
    return F.try_element_at(args, F.lit(key)).cast("string")


def _open(value: Column) -> Column:
    return F.coalesce(value.contains(PLACEHOLDER), F.lit(False))


def dates_ok(calls: Column) -> Column:
    """Dates have the date form (by form alone), and from is not after to (as texts)."""

    def one(c: Column) -> Column:
        a = c["arguments"]
        bad = F.lit(False)
        for k in DATE_KEYS:
            v = _text(a, k)
            bad = bad | (v.isNotNull() & ~_open(v) & ~is_date(v))
        f, t = _text(a, "from_date"), _text(a, "to_date")
        return bad | F.coalesce(is_date(f) & is_date(t) & (f > t), F.lit(False))

    return ~F.exists(calls, one)


def codes_ok(calls: Column) -> Column:
    """Object codes are locations or stations; station codes are stations where there are any. Calls as in ``_looked_up``."""

    def one(c: Column) -> Column:
        bad_s = _off(c, "station_code") & F.array_contains(F.col("_listed"), F.lit("station_code"))
        return _off(c, "object_code") | bad_s

    return ~F.exists(calls, one)


def name_catalogue(names: DataFrame, least: int = 4) -> tuple[DataFrame, DataFrame]:
    """``key, places`` of ``names(name, code)`` of at least so many letters by their words, and one row ``_sizes`` of their numbers of words.

    Of equal names the least code stays. Names without a word have the key of no words.
    """
    low = names.groupBy(F.lower(F.trim("name")).alias("name")).agg(F.min("code").alias("code")).where(F.length("name") >= least)
    worded = low.withColumn("words", tokens(F.col("name")))
    places = worded.groupBy(key("name", F.array_join("words", " ")).alias("key")).agg(F.sort_array(F.collect_list(F.struct("name", "code"))).alias("places"))
    return places, worded.agg(F.array_union(F.collect_set(F.size("words")), F.array(F.lit(0))).alias("_sizes"))


def name_keys(text: Column, sizes: Column) -> Column:
    """Keys of the word sequences of a text that can be names: each sequence of one of ``sizes`` words once."""

    def of_size(words: Column, k: Column) -> Column:
        last = F.when(k == 0, F.lit(1)).otherwise(F.size(words) - k + 1)
        return F.when(last >= 1, F.transform(F.sequence(F.lit(1), last), lambda i: key("name", F.array_join(F.slice(words, i, k), " ")))).otherwise(F.array().cast("array<string>"))

    each = F.transform(F.array(tokens(text)), lambda words: F.flatten(F.transform(sizes, lambda k: of_size(words, k))))
    return F.array_distinct(F.element_at(each, 1))


def _named(text: Column, found: Column) -> Column:
    """``struct<name, code>`` of the names that stand in the text as whole words, of the catalogue's values for its ``name_keys``."""
    met = F.flatten(F.transform(F.filter(found, lambda v: v["places"].isNotNull()), lambda v: v["places"]))
    return F.filter(met, lambda n: has_phrase(F.lower(text), n["name"]))


def with_named(df: DataFrame, text: str, names: DataFrame, least: int = 4, name: str = "named") -> DataFrame:
    """``df`` with ``name``, ``struct<name, code>`` of the names that stand in a text as whole words.

    The text's word sequences meet the names in one hash join; only what meets is compared in full, so the work does not
    grow with the number of names.
    """
    places, sizes = name_catalogue(names, least)
    asked = df.crossJoin(F.broadcast(sizes))  # one row of a few numbers
    met = with_lookups(asked, name_keys(F.col(text), F.col("_sizes")), places.select("key", F.struct("places").alias("value")), "_places")
    return met.withColumn(name, _named(F.col(text), F.col("_places"))).drop("_sizes", "_places")


def city_ok(matched: Column, calls: Column) -> Column:
    """If the request names locations (their codes), every gold location is one of them."""
    gold = F.filter(F.transform(calls, lambda c: _text(c["arguments"], "location_code")), lambda x: x.isNotNull() & (x != ""))
    return (F.size(matched) == 0) | (F.size(F.array_except(gold, matched)) == 0)


def substituted(args: Column, params: Column) -> Column:
    """Arguments with waiting values replaced by ones that fit their schema: first enum item, ``VNM`` or 1."""

    def stand_in(k: Column) -> Column:
        p = F.try_element_at(F.filter(params, lambda x: x["name"] == k), F.lit(1))
        return F.parse_json(F.coalesce(F.try_element_at(p["enum"], F.lit(1)), F.when(p["type"] == "string", F.lit('"VNM"')).otherwise("1")))

    return F.transform_values(args, lambda k, v: F.when(F.to_json(v).contains(PLACEHOLDER), stand_in(k)).otherwise(v))


def schema_ok(action: Column, n_calls: Column, invalid_calls: Column, checker_invalid: Column) -> Column:
    """Questions need a checker call that is invalid; others valid calls; none at all only for refusals."""
    return F.when(action == "ask_clarification", F.coalesce(checker_invalid, F.lit(False))).when(n_calls == 0, action == "abstain").otherwise(invalid_calls == 0)


def needs_semantic(family: Column) -> Column:
    return ~family.isin("masking", "multi_step", "missing_slot")


def first_fail(instruction: Column, schema: Column, codes: Column, dates: Column, city: Column, semantic: Column | None = None, family: Column | None = None) -> Column:
    """The first layer that a sample fails; null if it passes all. ``semantic`` is a judge's verdict, null keeps."""
    out = F.when(too_short(instruction, SHORT), "schema_fail").when(~schema, "schema_fail").when(~codes, "schema_fail").when(~dates, "date_fail").when(~city, "city_fail")
    if semantic is not None:
        out = out.when(needs_semantic(family) & ~F.coalesce(semantic, F.lit(True)), "semantic_fail")
    return out


def all_calls(single: Column, several: Column, steps: Column) -> Column:
    """A sample's gold calls: the single one, else the set, else the steps."""
    return F.when(single.isNotNull(), F.array(single)).otherwise(first_filled(several, steps))


def _off(call: Column, name: str) -> Column:
    """Whether a given code is none of the catalogue's; waiting values are not looked up."""
    value = _text(call["arguments"], name)
    return value.isNotNull() & ~_open(value) & ~call["known"][name]


def _names(*checks: tuple[Column, str]) -> Column:
    """Names of the checks whose condition holds, in order."""
    return F.filter(F.array(*(F.when(c, name) for c, name in checks)), lambda x: x.isNotNull())


def row_checks() -> Column:
    """Names of the failed checks of a sample, in order; a check that several calls or dates fail comes as often.

    A row has the columns of ``_looked_up``. A masked tool without parameters has no schema.
    """
    c, none = F.col, F.array().cast("array<string>")
    action, masked, calls = c("expected_action"), c("masked_tool"), c("_typed")

    def of_call(x: Column) -> Column:
        issues = schema_issues(x["tool"], substituted(x["arguments"], x["tool"]["params"]), x["name"])
        bad = F.exists(issues, lambda i: i["code"] != "deprecated_tool")
        f, t = _text(x["arguments"], "from_date"), _text(x["arguments"], "to_date")
        dates = [(v.isNotNull() & ~_open(v) & ~is_date(v), "bad_date_format") for v in (_text(x["arguments"], k) for k in DATE_KEYS)]
        checks = _names(
            (bad, "schema_invalid_gold"), (_off(x, "object_code"), "object_code_off_catalogue"), *((_off(x, k), f"{k}_off_catalogue") for k in CATALOGUES),
            *dates, (F.coalesce(is_date(f) & is_date(t) & (f > t), F.lit(False)), "from_after_to"),
        )
        return F.when(x["tool"].isNull(), F.array(F.lit("unknown_tool"))).otherwise(checks)

    slots = F.coalesce(c("missing_slots"), none)
    asks, is_masked = action == "ask_clarification", (c("scenario_family") == "masking") | masked.isNotNull()
    checker, given = c("_checker"), args_map(c("checker_call")["arguments"])
    required = F.coalesce(F.transform(F.filter(checker["tool"]["params"], lambda p: p["required"]), lambda p: p["name"]), none)
    both = F.array(F.lit("from_date"), F.lit("to_date"))
    valid = checker["tool"].isNotNull() & (F.size(schema_issues(checker["tool"], checker["arguments"], checker["name"])) == 0)
    before = _names(
        (too_short(c("instruction"), SHORT), "short_instruction"),
        ((action == "call_function") & c("gold_call").isNull(), "missing_gold_call"),
        ((action == "call_functions") & (F.size(first_filled(c("gold_calls"), c("gold_steps"))) == 0), "missing_gold_calls"),
        (asks & ((F.size(slots) == 0) | c("checker_call").isNull()), "missing_clar_fields"),
        ((action == "abstain") & c("reason").isNull(), "missing_abstain_reason"),
    )
    locations = F.filter(F.transform(calls, lambda x: _text(x["arguments"], "location_code")), lambda x: x.isNotNull() & (x != ""))
    matched = c("_matched")
    waits = F.exists(c("_calls"), lambda x: F.coalesce(x["arguments"].contains(PLACEHOLDER), F.lit(False)))
    after = _names(
        ((F.size(matched) > 0) & (F.size(F.array_except(locations, matched)) > 0), "city_code_mismatch"),
        (waits & ~((action == "call_functions") & F.coalesce(F.size("gold_steps") > 0, F.lit(False))), "placeholder_leak"),
        (is_masked & ~masked["name"].eqNullSafe(F.coalesce(c("gold_call")["tool_name"], F.lit(""))), "masked_name_mismatch"),
        (is_masked & (F.coalesce(F.size(masked["params"]), F.lit(0)) <= 0), "masked_no_schema"),
        (is_masked & (masked["name"] != "") & ~F.contains(F.coalesce(c("instruction"), F.lit("")), masked["name"]), "masked_name_not_in_instruction"),
        (asks & (F.size(F.array_except(slots, required)) > 0), "missing_slot_not_required"),
        (asks & (F.size(F.array_intersect(slots, F.map_keys(given))) > 0), "missing_slot_present_in_checker"),
        (asks & F.arrays_overlap(slots, both) & (F.size(F.array_except(both, slots)) > 0), "date_pair_incomplete"),
        (asks & valid, "clarification_checker_actually_valid"),
    )
    return F.concat(before, F.flatten(F.transform(calls, of_call)), after)


def _looked_up(samples: DataFrame, tools: DataFrame, references: DataFrame, names: DataFrame) -> DataFrame:
    """``samples`` with what their calls and requests name, by one lookup in catalogues of any size.

    ``_typed`` are the gold calls and ``_checker`` the checker call as ``struct<name, arguments map, tool, known>``, where ``known`` says by
    parameter whether the catalogue has the code; ``_matched`` are the codes of locations that the request names, ``_listed`` the
    parameters that have a catalogue. ``references(param, code)`` has stations as ``station_code``; ``names(name, code)`` are locations.
    """
    c = F.col
    df = samples.withColumn("_calls", all_calls(c("gold_call"), c("gold_calls"), c("gold_steps")))
    checker = F.when(c("checker_call").isNotNull(), F.array(c("checker_call"))).otherwise(F.array().cast(CALLS))
    df = df.withColumn("_every", F.concat("_calls", checker))
    places, sizes = name_catalogue(names)
    df = df.crossJoin(F.broadcast(sizes))  # one row of a few numbers
    every, n = c("_every"), F.size("_every")
    wanted = [(k, k) for k in CATALOGUES] + [("object_code", "location_code"), ("object_code", "station_code")]
    keys = F.concat(tool_keys(every), *(code_keys(every, name, param) for name, param in wanted), name_keys(c("instruction"), c("_sizes")))
    df = with_lookups(df, keys, catalogue(tools, None, None, references, places))
    df = with_listed(df, references, CATALOGUES)
    masked, found = c("masked_tool"), c("_found")

    def typed(x: Column, i: Column) -> Column:
        held = [F.coalesce(F.get(found, n * (k + 1) + i)["listed"], F.lit(False)) for k in range(len(wanted))]
        known = F.struct(*(h.alias(name) for h, (name, _) in zip(held, wanted[: len(CATALOGUES)], strict=False)), (held[-2] | held[-1]).alias("object_code"))
        tool = F.when(masked["name"].eqNullSafe(x["tool_name"]), masked).otherwise(F.get(found, i)["tool"])
        return F.struct(x["tool_name"].alias("name"), args_map(x["arguments"]).alias("arguments"), tool.alias("tool"), known.alias("known"))

    df = df.withColumn("_all", F.transform(every, typed))
    matched = F.transform(_named(c("instruction"), F.slice(found, n * (len(wanted) + 1) + 1, F.greatest(F.size(found), F.lit(1)))), lambda p: p["code"])
    df = df.withColumns({"_typed": F.slice("_all", F.lit(1), F.size("_calls")), "_checker": F.try_element_at("_all", F.size("_calls") + 1), "_matched": matched})
    return df.drop("_found", "_every", "_all", "_sizes")


def audit(samples: DataFrame, tools: DataFrame, references: DataFrame, names: DataFrame, file: str = "file") -> DataFrame:
    """(file, id, check) of every failed check of read-only samples.

    Samples: ``id, instruction, scenario_family, expected_action, gold_call, gold_calls, gold_steps, missing_slots,
    checker_call, reason, masked_tool`` and the file's column.
    """
    return _looked_up(samples, tools, references, names).select(file, "id", F.explode(row_checks()).alias("check"))


def primary_tool(single: Column, several: Column, steps: Column, checker: Column) -> Column:
    """The tool of a sample's first gold call, else of its checker call, else empty."""
    return F.coalesce(F.try_element_at(all_calls(single, several, steps), F.lit(1))["tool_name"], checker["tool_name"], F.lit(""))


def repeated_instructions(samples: DataFrame, file: str = "file") -> DataFrame:
    """``file, n, duplicates``: rows, and rows whose instruction's token set another of the same family and primary tool has before them."""
    c = F.col
    tool = primary_tool(c("gold_call"), c("gold_calls"), c("gold_steps"), c("checker_call"))
    keyed = samples.groupBy(file, "scenario_family", tool.alias("tool"), token_set(c("instruction")).alias("tokens")).agg(F.count("*").alias("rows"))
    return keyed.groupBy(file).agg(F.sum("rows").alias("n"), F.sum(F.col("rows") - 1).alias("duplicates"))


def verify(samples: DataFrame, tools: DataFrame, references: DataFrame, names: DataFrame, semantic: str | None = None) -> DataFrame:
    """``samples`` with ``first_fail``, the first layer that each fails, null for those that pass.

    Columns as ``audit``; ``semantic`` names a judge's verdict (boolean, null keeps).
    """
    df, c = _looked_up(samples, tools, references, names), F.col

    def issues_of(x: Column, args: Column) -> Column:
        return F.size(schema_issues(x["tool"], args, x["name"]))

    broken = F.size(F.filter("_typed", lambda x: issues_of(x, substituted(x["arguments"], x["tool"]["params"])) > 0))
    checker = c("checker_call").isNotNull() & (issues_of(c("_checker"), c("_checker")["arguments"]) > 0)
    schema = schema_ok(c("expected_action"), F.size("_typed"), broken, checker)
    fail = first_fail(c("instruction"), schema, codes_ok(c("_typed")), dates_ok(c("_typed")), city_ok(c("_matched"), c("_typed")), None if semantic is None else c(semantic), c("scenario_family"))
    return df.withColumn("first_fail", fail).select(*samples.columns, "first_fail")


def self_check(results: DataFrame) -> DataFrame:
    """Samples whose own gold does not reach its expected status; an empty result is a pass."""
    return results.where(~F.col("status").eqNullSafe(F.coalesce("expected_status", F.lit("ok"))))


def verified(samples: DataFrame, gold_status: Column, checker_status: Column) -> DataFrame:
    """Samples whose gold and, where there is one, negative checker call both behave as expected."""
    return samples.where((gold_status == F.coalesce("expected_status", F.lit("ok"))) & (F.col("checker_expected_status").isNull() | checker_status.eqNullSafe(F.col("checker_expected_status"))))
