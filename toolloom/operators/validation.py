"""Validation of calls: schemas, contracts, catalogues, differences from gold calls.

Every check gives an array of issues in the order of the checks; ``long`` turns it into rows. The checks
are expressions over a row that has its registry row beside it, so a call costs one hash join with a small
table (Spark broadcasts it if it is small) and no shuffle of its own.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from toolloom.functions.feedback import SUGGESTED_ACTION
from toolloom.functions.json import args_map, fits_type, kind_of, value_text

ISSUE = "struct<code:string,path:string,expected:string,actual:string,message:string,suggested_action:string>"
PLACEHOLDER = "<from_step_1>"
#: Arguments whose values are codes of a catalogue.
CODE_PARAMS = ("location_code", "kpi_code", "unit_code")


def issue(code: str, path: Column, message: Column, expected: Column | None = None, actual: Column | None = None) -> Column:
    none = F.lit(None).cast("string")
    return F.struct(F.lit(code).alias("code"), path.alias("path"), (none if expected is None else expected).alias("expected"), (none if actual is None else actual).alias("actual"), message.alias("message"), F.lit(SUGGESTED_ACTION.get(code)).cast("string").alias("suggested_action"))


def none_of() -> Column:
    return F.array().cast(f"array<{ISSUE}>")


def _path(name: Column) -> Column:
    return F.concat(F.lit("arguments."), name)


def _quoted(text: Column) -> Column:
    return F.concat(F.lit('"'), text, F.lit('"'))


def schema_issues(tool: Column, args: Column, tool_name: Column, bool_is_int: bool = True) -> Column:
    """Issues of one call against its tool struct (null: unknown); the first two kinds stand alone.

    Missing arguments come in the order of the tool's list, all others in the order of the call's arguments.
    """
    params = tool["params"]
    gone = F.array_sort(F.transform(F.filter(params, lambda p: p["required"] & ~F.map_contains_key(args, p["name"])), lambda p: F.struct(p["place"], p["name"])))
    missing = F.transform(gone, lambda p: issue("missing_arg", _path(p["name"]), F.concat(F.lit("Missing required argument: "), p["name"]), F.lit('"present"'), F.lit('"missing"')))
    extra = F.transform(F.filter(F.map_keys(args), lambda k: ~F.exists(params, lambda p: p["name"] == k)), lambda k: issue("unknown_arg", _path(k), F.concat(F.lit("Unknown argument: "), k)))

    def one(x: Column) -> Column:
        p, kind, text = x["p"], x["kind"], x["text"]
        wrong = F.when(~fits_type(kind, p["type"], bool_is_int), F.array(issue("invalid_type", _path(p["name"]), F.concat(F.lit("Invalid type for "), p["name"], F.lit(": expected "), p["type"]), _quoted(p["type"]), _quoted(kind)))).otherwise(none_of())
        outside = F.when(p["enum"].isNotNull() & ~F.coalesce(F.array_contains(p["enum"], text), F.lit(False)), F.array(issue("invalid_enum", _path(p["name"]), F.concat(F.lit("Invalid value for "), p["name"]), F.to_json(p["enum"]), text))).otherwise(none_of())
        off = (p["type"] == "string") & p["pattern"].isNotNull() & (kind == "string") & ~F.call_function("rlike", x["value"].cast("string"), F.concat(F.lit(r"\A(?:"), p["pattern"], F.lit(r")\z")))
        shape = F.when(off, F.array(issue("pattern_mismatch", _path(p["name"]), F.concat(F.lit("Invalid format for "), p["name"]), _quoted(p["pattern"]), text))).otherwise(none_of())
        return F.concat(wrong, outside, shape)

    # a chain of steps: each computes its values once
    known = F.transform(F.map_entries(args), lambda e: F.struct(e.value.alias("value"), F.schema_of_variant(e.value).alias("schema"), F.to_json(e.value).alias("text"), F.filter(params, lambda p: p["name"] == e.key).alias("ps")))
    known = F.flatten(F.transform(known, lambda x: F.transform(x["ps"], lambda p: F.struct(p.alias("p"), x["value"].alias("value"), x["text"].alias("text"), kind_of(x["schema"], x["text"]).alias("kind")))))
    return (
        F.when(tool.isNull(), F.array(issue("unknown_tool", F.lit("tool_name"), F.concat(F.lit("Unknown tool: "), F.coalesce(tool_name, F.lit("None"))))))
        .when(tool["deprecated"], F.array(issue("deprecated_tool", F.lit("tool_name"), F.concat(F.lit("Tool is deprecated: "), tool["name"]))))
        .otherwise(F.concat(missing, extra, F.flatten(F.transform(known, one))))
    )


def with_tool(calls: DataFrame, tools: DataFrame, name: str = "tool_name", masked: str | None = None) -> DataFrame:
    """``calls`` with their tool struct in ``tool``; a schema in the row itself (``masked``) goes first."""
    dim = tools.select(F.col("name").alias("_name"), F.struct("name", "deprecated", "params").alias("_tool"))
    out = calls.join(dim, F.col(name) == F.col("_name"), "left")
    own = F.when(F.col(f"{masked}.name") == F.col(name), F.col(masked)) if masked else F.lit(None)
    return out.withColumn("tool", F.coalesce(own, F.col("_tool")) if masked else F.col("_tool")).drop("_name", "_tool")


def passes(actual: Column, op: Column, expected: Column) -> Column:
    """A contract rule on JSON texts; a missing value fails ``lte`` and ``gte`` and differs from any other."""
    low, high = (x.try_cast("double") for x in (actual, expected))
    below = F.coalesce(low <= high, actual <= expected, F.lit(False))
    above = F.coalesce(low >= high, actual >= expected, F.lit(False))
    listed = F.exists(F.transform(F.from_json(expected, "array<variant>"), lambda v: F.to_json(v)), lambda v: v.eqNullSafe(actual))
    return (
        F.when(op.isin("eq", "eq_path"), actual.eqNullSafe(expected))
        .when(op.isin("ne", "ne_path"), ~actual.eqNullSafe(expected))
        .when(op == "in", F.coalesce(listed, F.lit(False)))
        .when(op == "lte", below)
        .when(op == "gte", above)
        .otherwise(F.raise_error(F.concat(F.lit("unsupported contract op: "), op)).cast("boolean"))
    )


def contract_issues(contract: Column, state: Column, args: Column, verified: Column) -> Column:
    """Issues of a call against its contract: none without one, ``missing_subscriber`` alone without state.

    ``state`` is a map of JSON texts, ``args`` one of variants; paths are ``subscriber.x`` and ``args.x``.
    """

    def at(path: Column) -> Column:
        field = F.regexp_replace(path, r"^(subscriber|args)\.", "")
        return F.when(path.startswith("subscriber."), F.try_element_at(state, field)).when(path.startswith("args."), value_text(F.try_element_at(args, field)))

    def expected(r: Column) -> Column:
        return F.when(r["op"].endswith("_path"), at(F.regexp_replace(r["value"], '"', ""))).otherwise(r["value"])

    denied = F.when(contract["verified"] & ~F.coalesce(verified, F.lit(True)), F.array(issue("permission_denied", F.lit("customer_verified"), F.lit("Customer identity must be verified"), F.lit("true"), F.lit("false")))).otherwise(none_of())
    seen = F.transform(contract["rules"], lambda r: F.struct(r["path"].alias("path"), r["op"].alias("op"), r["message"].alias("message"), expected(r).alias("expected"), at(r["path"]).alias("actual")))
    failed = F.filter(seen, lambda r: ~passes(r["actual"], r["op"], r["expected"]))
    rules = F.transform(failed, lambda r: issue("precondition_failed", r["path"], F.coalesce(r["message"], F.concat(F.lit("Precondition failed: "), r["path"])), r["expected"], r["actual"]))
    return (
        F.when(contract.isNull(), none_of())
        .when(state.isNull(), F.array(issue("missing_subscriber", F.lit("subscriber"), F.lit("Subscriber not found"))))
        .otherwise(F.concat(denied, rules))
    )


def gold_issues(pred_tool: Column, pred: Column, gold_tool: Column, gold: Column, reveal: bool = False) -> Column:
    """How a schema-valid call differs from its gold call; gold values are shown only if ``reveal``."""
    none = F.lit(None).cast("string")

    def held(e: Column) -> Column:
        return F.coalesce(F.to_json(F.try_element_at(pred, e.key)).contains(PLACEHOLDER), F.lit(False))

    gone = F.transform(F.filter(F.map_entries(gold), lambda e: ~F.map_contains_key(pred, e.key)), lambda e: issue("missing_argument", _path(e.key), F.concat(F.lit("Missing argument: "), e.key)))
    unlike = F.filter(F.map_entries(gold), lambda e: F.map_contains_key(pred, e.key) & ~held(e) & ~F.to_json(e.value).eqNullSafe(F.to_json(F.try_element_at(pred, e.key))))
    wrong = F.transform(unlike, lambda e: issue("wrong_argument_value", _path(e.key), F.concat(F.lit("Wrong value for "), e.key), F.to_json(e.value) if reveal else none, F.to_json(F.try_element_at(pred, e.key))))
    more = F.transform(F.filter(F.map_entries(pred), lambda e: ~F.map_contains_key(gold, e.key)), lambda e: issue("extra_argument", _path(e.key), F.concat(F.lit("Unnecessary argument: "), e.key), none, F.to_json(e.value)))
    return (
        F.when(gold_tool.isNull() | (gold_tool == ""), F.array(issue("unnecessary_call", pred_tool, F.concat(F.lit("Unnecessary/unmatched call: "), pred_tool), none, _quoted(pred_tool))))
        .when(~pred_tool.eqNullSafe(gold_tool), F.array(issue("wrong_function", pred_tool, F.concat(F.lit("Wrong function selected: "), pred_tool), _quoted(gold_tool) if reveal else none, _quoted(pred_tool))))
        .otherwise(F.concat(gone, wrong, more))
    )


def code_issues(args: Column, catalogues: Column) -> Column:
    """Codes that their catalogue lacks; ``catalogues`` maps parameter names to arrays of codes, empty ones check nothing."""

    def held(name: str, text: Column) -> tuple[Column, Column]:
        valid = F.try_element_at(catalogues, F.lit(name))
        return F.size(valid) > 0, F.array_contains(valid, text)

    return code_issues_by(args, held)


def code_issues_by(args: Column, held: Callable[[str, Column], tuple[Column, Column]]) -> Column:
    """Codes that their catalogue lacks; ``held`` says of a parameter and a code whether there is a catalogue, and whether it has the code."""
    out = none_of()
    for name in CODE_PARAMS:
        value = F.try_element_at(args, F.lit(name))
        text = value.cast("string")
        there, known = held(name, text)
        bad = F.map_contains_key(args, F.lit(name)) & there & ~F.coalesce(text.contains(PLACEHOLDER), F.lit(False)) & ~F.coalesce(known, F.lit(False))
        out = F.concat(out, F.when(bad, F.array(issue("invalid_code", F.lit(f"arguments.{name}"), F.concat(F.lit(f"Code not in catalogue for {name}: "), F.coalesce(text, F.lit("null"))), None, F.to_json(value)))).otherwise(none_of()))
    return out


def call_status(schema: Column, contract: Column, execution_error: Column) -> Column:
    """First failing layer of a call: schema_invalid, contract_invalid, execution_failed, ok."""
    return F.when(F.size(schema) > 0, "schema_invalid").when(F.size(contract) > 0, "contract_invalid").when(execution_error.isNotNull(), "execution_failed").otherwise("ok")


def long(df: DataFrame, keys: list[str], issues: str) -> DataFrame:
    """A row an issue: keys, issue_ix, code, path, expected, actual, message, suggested_action."""
    return df.select(*keys, F.posexplode(issues).alias("issue_ix", "_issue")).select(*keys, "issue_ix", "_issue.*")


def validate_calls(calls: DataFrame, tools: DataFrame, keys: list[str], bool_is_int: bool = True) -> DataFrame:
    """``calls(keys, tool_name, arguments)`` with ``schema_issues``."""
    joined = with_tool(calls.withColumn("args", args_map(F.col("arguments"))), tools)
    return joined.select(*keys, "tool_name", "args", schema_issues(F.col("tool"), F.col("args"), F.col("tool_name"), bool_is_int).alias("schema_issues"))
