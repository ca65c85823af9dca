"""JSON expressions: repair and parsing of model output, canonical call signatures.

Argument values are ``variant``: their JSON types survive, and equality is that of their JSON texts.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ARGS = "map<string,variant>"
CALL = "struct<tool_name:string,arguments:string>"
PREDICTION = "struct<action:string,calls:array<struct<tool_name:string,arguments:string>>,asked_slots:array<string>,reason:string,parse_error:string>"


def args_map(text: Column) -> Column:
    """Arguments of a JSON object; duplicate keys: the last wins; empty map for null or anything else."""
    return F.coalesce(F.from_json(text, ARGS), F.from_json(F.lit("{}"), ARGS))


def value_text(value: Column) -> Column:
    """A variant as canonical JSON text."""
    return F.to_json(value)


def json_type(value: Column) -> Column:
    """string, integer, number, boolean, object, array or null."""
    return kind_of(F.schema_of_variant(value), F.to_json(value))


def kind_of(kind: Column, text: Column) -> Column:
    """The JSON type of a variant with this schema and this text."""
    whole = kind.isin("BIGINT", "TINYINT", "SMALLINT", "INT") | (kind.startswith("DECIMAL") & ~text.contains("."))
    return (
        F.when(kind == "STRING", "string")
        .when(kind == "BOOLEAN", "boolean")
        .when(whole, "integer")
        .when(kind.startswith("DECIMAL") | kind.isin("DOUBLE", "FLOAT"), "number")
        .when(kind.startswith("OBJECT"), "object")
        .when(kind.startswith("ARRAY"), "array")
        .otherwise("null")
    )


def fits_type(kind: Column, wanted: Column, bool_is_int: bool = True) -> Column:
    """Whether a JSON type satisfies a schema type; unknown schema types accept all.

    ``bool_is_int``: true and false are integers too, as in Python.
    """
    whole = ["integer", "boolean"] if bool_is_int else ["integer"]
    return (
        F.when(wanted == "integer", kind.isin(whole))
        .when(wanted == "number", kind.isin([*whole, "number"]))
        .when(wanted.isin("string", "boolean", "object", "array"), kind == wanted)
        .otherwise(True)
    )


def strip_thinking(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"(?is)<think>.*?</think>", ""), r"^\s+|\s+$", "")


def json_candidate(text: Column) -> Column:
    """The first fenced object, else what lies between the first ``{`` and the last ``}``; else null."""
    fenced = F.regexp_extract(text, r"(?is)```(?:json)?\s*(\{.*?\})\s*```", 1)
    begin, back = F.locate("{", text), F.locate("}", F.reverse(text))
    end = F.length(text) - back + 1
    return F.when(fenced != "", fenced).when((begin > 0) & (back > 0) & (end > begin), F.substring(text, begin, end - begin + 1))


def json_array_candidate(text: Column) -> Column:
    """A fenced or bare ``[ ... ]``; else null."""
    fenced = F.regexp_extract(text, r"(?is)```(?:json)?\s*(\[.*?\])\s*```", 1)
    bare = F.regexp_extract(text, r"(?s)(\[.*\])", 1)
    return F.when(fenced != "", fenced).when(bare != "", bare)


def string_array(text: Column) -> Column:
    """The candidate's items as JSON texts (strings bare); empty for anything that is no array."""
    items = F.try_variant_get(F.try_parse_json(json_array_candidate(text)), "$", "array<variant>")
    return F.coalesce(F.transform(items, lambda v: v.cast("string")), F.array().cast("array<string>"))


def maybe_json(text: Column) -> Column:
    """A variant: the parsed text if it starts with ``[`` or ``{`` and parses, else the text itself."""
    return F.coalesce(F.when(F.trim(text).rlike(r"^[\[{]"), F.try_parse_json(text)), F.try_variant_get(F.try_parse_json(F.to_json(F.array(text))), "$[0]", "variant"))


def tool_call_blocks(text: Column) -> Column:
    """JSON texts of ``<tool_call>`` blocks that name a tool; bad JSON is skipped."""
    blocks = F.regexp_extract_all(text, F.lit(r"(?s)<tool_call>\s*(.*?)\s*</tool_call>"), F.lit(1))

    def named(block: Column) -> Column:
        v = F.try_parse_json(block)
        return F.coalesce(*(F.try_variant_get(v, f"$.{k}", "variant").isNotNull() for k in ("name",)), F.lit(False)) | F.try_variant_get(v, "$.tool_name", "variant").isNotNull() | F.try_variant_get(v, "$.function", "variant").isNotNull()

    return F.filter(blocks, named)


def coerce_query(text: Column) -> Column:
    """The request in a generated item: the text itself, or the first known key, or the first string value."""
    v = F.try_parse_json(text)
    known = [F.try_variant_get(v, f"$.{k}", "string") for k in ("question", "query", "cau_hoi", "q", "text")]
    fields = F.from_json(text, "map<string,variant>")
    strings = F.filter(F.map_values(fields), lambda x: F.schema_of_variant(x) == "STRING")
    return F.when(F.trim(text).startswith("{"), F.coalesce(*known, F.try_element_at(strings, F.lit(1)).cast("string"))).otherwise(text)


def _bind(value: Column, f) -> Column:
    """``f(value)`` with the value computed once."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _text_of(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "string")


def normalize(candidate: Column) -> Column:
    """A prediction from a JSON object's text, null where it does not parse.

    ``calls`` holds the call of ``call_function`` and all calls of ``call_functions``, of which a single
    one makes it a ``call_function``. What fits no action is a parse error.
    """
    return _bind(F.coalesce(F.try_parse_json(candidate), F.parse_json(F.lit("null"))), _prediction)


def _prediction(v: Column) -> Column:
    """The prediction in a parsed object; a lambda's variable, so that it is parsed once."""
    action = _text_of(v, "$.action")
    args = F.try_variant_get(v, "$.call.arguments", "variant")
    args_ok = args.isNull() | F.schema_of_variant(args).startswith("OBJECT")
    one_ok = F.try_variant_get(v, "$.call.tool_name", "variant").isNotNull() & args_ok
    one = F.array(F.struct(_text_of(v, "$.call.tool_name").alias("tool_name"), F.coalesce(F.to_json(args), F.lit("{}")).alias("arguments")))
    items = F.filter(F.try_variant_get(v, "$.calls", "array<variant>"), lambda c: F.schema_of_variant(c).startswith("OBJECT"))

    def call(c: Column) -> Column:
        a = F.try_variant_get(c, "$.arguments", "variant")
        return F.struct(_text_of(c, "$.tool_name").alias("tool_name"), F.when(F.schema_of_variant(a).startswith("OBJECT"), F.to_json(a)).otherwise("{}").alias("arguments"))

    many = F.transform(items, call)
    slots = F.coalesce(F.try_variant_get(v, "$.asked_slots", "array<string>"), F.array().cast("array<string>"))
    none = F.lit(None).cast("string")
    no_calls = F.lit(None).cast(f"array<{CALL}>")
    no_slots = F.lit(None).cast("array<string>")

    def made(kind, calls=no_calls, slots=no_slots, reason=none, error=none):
        return F.struct((kind if isinstance(kind, Column) else F.lit(kind)).alias("action"), calls.alias("calls"), slots.alias("asked_slots"), reason.alias("reason"), error.alias("parse_error"))

    error = made("abstain", reason=F.lit("parse_error"), error=F.lit(NO_ACTION))
    return F.when(F.schema_of_variant(v).startswith("OBJECT"), (
        F.when((action == "call_function") & one_ok, made("call_function", one))
        .when((action == "call_functions") & (F.size(many) == 1), made("call_function", many))
        .when((action == "call_functions") & (F.size(many) > 1), made("call_functions", many))
        .when(action == "ask_clarification", made("ask_clarification", slots=slots))
        .when(action == "abstain", made("abstain", reason=F.coalesce(_text_of(v, "$.reason"), F.lit("model abstained"))))
        .otherwise(error)
    ))


def _objects(text: str) -> list:
    """JSON objects one after another in a text."""
    decoder, out, at = json.JSONDecoder(), [], text.find("{")
    while at >= 0:
        try:
            value, size = decoder.raw_decode(text[at:])
        except ValueError:
            at = text.find("{", at + 1)
            continue
        out.append(value)
        at = text.find("{", at + size)
    return out


@F.pandas_udf(T.StringType())
def _repaired(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """What the expressions reject: one object with duplicate keys as plain JSON, or several calls as one ``call_functions``."""

    def repair(text: str | None) -> str | None:
        if text is None:
            return None
        begin, end = text.find("{"), text.rfind("}")
        try:
            whole = json.loads(text[begin : end + 1])
            return json.dumps(whole) if isinstance(whole, dict) else None
        except ValueError:
            pass
        calls = []
        for value in _objects(text):
            call = value.get("call")
            if value.get("action") != "call_function" or not isinstance(call, dict) or "tool_name" not in call or not isinstance(call.get("arguments", {}), dict):
                return None
            calls.append({"tool_name": call["tool_name"], "arguments": call.get("arguments", {})})
        return json.dumps({"action": "call_functions", "calls": calls}) if len(calls) > 1 else None

    for part in parts:
        yield part.map(repair)


def _is_one_object(candidate: Column) -> Column:
    """Whether the whole text is one JSON value; Spark's parser alone ignores what follows the first."""
    return F.coalesce(F.size(F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), candidate, F.lit("]"))), "$", "array<variant>")) == 1, F.lit(False))


#: Texts of parse errors.
NO_OBJECT, INVALID, NO_ACTION = "No JSON object found in model output.", "Invalid JSON", "JSON object does not match expected action schema."


def with_predictions(df: DataFrame, text: Column, name: str = "prediction") -> DataFrame:
    """``df`` with the predictions in raw model outputs. Python only sees outputs that don't parse as one object.

    The steps are projections of their own: Python can't stand inside a lambda.
    """
    seen = _bind(strip_thinking(text), lambda c: _bind(json_candidate(c), lambda k: F.struct(c.alias("clean"), k.alias("candidate"), _is_one_object(k).alias("one"))))
    out = df.withColumn("_seen", seen)
    c = F.col("_seen")
    out = out.withColumn("_repaired", _repaired(F.when(c["candidate"].isNotNull() & ~c["one"], c["clean"])))
    error = F.when(c["candidate"].isNull(), NO_OBJECT).otherwise(INVALID)
    none = F.lit(None)
    failed = F.struct(F.lit("abstain").alias("action"), none.cast(f"array<{CALL}>").alias("calls"), none.cast("array<string>").alias("asked_slots"), F.lit("parse_error").alias("reason"), error.alias("parse_error"))
    repaired = _prediction(F.try_parse_json(F.col("_repaired")))
    return out.withColumn(name, F.coalesce(normalize(F.when(c["one"], c["candidate"])), repaired, failed)).drop("_seen", "_repaired")


def call_signature(tool: Column, arguments: Column) -> Column:
    """Canonical text of a call: the tool and its arguments sorted by name."""
    entries = F.array_sort(F.transform(F.map_entries(args_map(arguments)), lambda e: F.concat(e.key, F.lit("="), F.to_json(e.value))))
    return F.concat(F.coalesce(tool, F.lit("")), F.lit("("), F.array_join(entries, ","), F.lit(")"))


def calls_signature(calls: Column) -> Column:
    return F.array_join(F.transform(calls, lambda c: call_signature(c.tool_name, c.arguments)), ";")


def spaced_json(text: Column) -> Column:
    """Compact JSON with a blank after ``,`` and ``:`` outside strings."""
    return F.regexp_replace(text, r'([,:])(?=(?:[^"\\]|\\.|"(?:[^"\\]|\\.)*")*$)', "$1 ")


def indented_json(text: Column, indent: int = 2) -> Column:
    """Compact JSON with every item on a line of its own, nested ones further in; strings stay as they are.

    A fold over the tokens of the text (strings, brackets, commas, colons, other values).
    """
    tokens = F.regexp_extract_all(text, F.lit(r'("(?:[^"\\]|\\.)*"|[\[\]{},:]|[^\s\[\]{},:"]+)'), F.lit(1))
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("depth"), F.lit("").alias("last"))

    def step(held: Column, token: Column) -> Column:
        opens, closes, after = token.isin("{", "["), token.isin("}", "]"), held["last"].isin("{", "[")
        depth = held["depth"] + F.when(opens, 1).when(closes, -1).otherwise(0)
        line = F.concat(F.lit("\n"), F.repeat(F.lit(" " * indent), F.when(closes, depth).otherwise(held["depth"])))
        lead = F.when(closes & after, "").when(closes | (after & ~closes) | (held["last"] == ","), line).when(held["last"] == ":", " ").otherwise("")
        return F.struct(F.concat(held["out"], lead, token).alias("out"), depth.alias("depth"), token.alias("last"))

    return F.aggregate(tokens, start, step, lambda held: held["out"])
