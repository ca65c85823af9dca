"""Public tool-call datasets in five dialects to one chat schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from toolloom.functions.json import tool_call_blocks

SOURCES = ("xlam", "toolace", "apigen_mt", "xlam_irrelevance", "hermes_fc")


def _any(v: Column, *keys: str) -> Column:
    """The first of several keys as JSON text or bare string."""
    return F.coalesce(*(F.try_variant_get(v, f"$.{k}", "string") for k in keys))


def _turn(v: Column, roles: tuple[str, ...], last: bool = False) -> Column:
    """Content of the first (last) turn whose role is one of ``roles``, in either turn dialect."""
    turns = F.coalesce(F.try_variant_get(v, "$.conversations", "array<variant>"), F.try_variant_get(v, "$.messages", "array<variant>"))
    wanted = F.filter(turns, lambda t: F.coalesce(F.try_variant_get(t, "$.from", "string"), F.try_variant_get(t, "$.role", "string")).isin(*roles))
    one = F.try_element_at(wanted, F.lit(-1 if last else 1))
    return F.coalesce(F.try_variant_get(one, "$.value", "string"), F.try_variant_get(one, "$.content", "string"))


def normalise(raw: DataFrame) -> DataFrame:
    """``raw(pos, source, json)`` to ``record_id, source, query, answer, expected_action, malformed``.

    Rows that don't parse or lack query or answer are marked malformed (callers count and drop them); a source
    of no known dialect raises.
    """
    v = F.try_parse_json(F.col("json"))
    source = F.col("source")
    asked = F.coalesce(_any(v, "query", "instruction", "user"), _turn(v, ("human", "user")))
    direct = _any(v, "answers", "answer", "output", "tool_call", "gold_call", "call")
    called = F.coalesce(_turn(v, ("function_call",), True), _turn(v, ("gpt", "assistant"), True))
    blocks = tool_call_blocks(called)
    answer = (
        F.when(source == "xlam", direct)
        .when(source == "toolace", F.coalesce(direct, called))
        .when(source.isin("apigen_mt", "hermes_fc"), F.when(F.size(blocks) > 0, F.concat(F.lit("["), F.array_join(blocks, ","), F.lit("]"))).otherwise(called))
        .when(source == "xlam_irrelevance", F.lit("[]"))
    )
    calls = F.coalesce(F.try_variant_get(F.try_parse_json(answer), "$", "array<variant>"), F.when(answer.startswith("{"), F.array(F.try_parse_json(answer))))
    n = F.coalesce(F.size(calls), F.lit(0))
    action = F.when(source == "xlam_irrelevance", "abstain").when(n > 1, "call_functions").when(n == 1, "call_function").otherwise("abstain")
    known = F.when(source.isin(*SOURCES), source).otherwise(F.raise_error(F.concat(F.lit("unsupported source: "), F.coalesce(source, F.lit("null")))))
    return raw.select(F.format_string("public_%s_%06d", known, "pos").alias("record_id"), "source", asked.alias("query"), answer.alias("answer"), action.alias("expected_action"), (v.isNull() | asked.isNull() | answer.isNull()).alias("malformed"))
