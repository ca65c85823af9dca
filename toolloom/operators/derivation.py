"""Rows derived from rows: missing slots, masked tools, parallel and chained calls, steps, repairs, chats.

Argument maps are ``map<string,variant>``; calls are ``struct<tool_name, arguments>``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from toolloom.functions.text import names_date
from toolloom.functions.values import cycled, invert_map, rename_keys, shared_override, without_keys
from toolloom.operators.ranks import first_k
from toolloom.operators.sampling import MASK_MODES
from toolloom.operators.validation import PLACEHOLDER

DATES = ["from_date", "to_date"]
#: Arguments that parallel calls share, and shares of masking curricula.
SHARED = ["location_code", "from_date", "to_date", "data_level"]
CURRICULUM = {"real_names": 0.50, "function_name_masked": 0.25, "function_and_parameter_masked": 0.15, "renamed_or_paraphrased_schema": 0.10}
#: How the result of a first step is shown.
OBSERVED = ("\n\n[Kết quả bước 1 — danh sách trạm]:\n", "\nHãy dùng kết quả trên để tra cứu tiếp.")
#: Target shares of scenario families.
PROFILE = {"single_step_valid": 0.25, "missing_slot": 0.15, "abstention": 0.10, "contract_aware": 0.20, "multi_step": 0.10, "parallel": 0.05, "masking": 0.10, "schema_or_deprecated": 0.05}


def _texts(values: list[str]) -> Column:
    return F.array(*map(F.lit, values))


def droppable_slots(required: Column) -> Column:
    """Slots that a request can leave out: both dates as one, then codes, in fixed order."""
    dates = F.array_intersect(_texts(DATES), required)
    codes = F.transform(F.array_intersect(_texts(["location_code", "kpi_code", "station_code"]), required), lambda c: F.array(c))
    return F.concat(F.when(F.size(dates) > 0, F.array(dates)).otherwise(F.array().cast("array<array<string>>")), codes)


def missing_slot(df: DataFrame, position: str = "i") -> DataFrame:
    """``missing_slots`` and ``checker_arguments`` (arguments without them) of rows with ``required, args``; rows without a droppable slot go."""
    slots = df.withColumn("_slots", droppable_slots(F.col("required"))).where("size(_slots) > 0")
    out = slots.withColumn("missing_slots", F.element_at("_slots", (F.pmod(F.col(position), F.size("_slots")) + 1).cast("int")))
    return out.withColumn("checker_arguments", without_keys(F.col("args"), F.col("missing_slots"))).drop("_slots")


def masked(df: DataFrame, position: str = "i") -> DataFrame:
    """Masked twins of rows ``i, tool_name, args, param_names, instruction``: mode, masked_name, args with masked names."""
    mode = cycled(F.col(position), MASK_MODES)
    number = (F.col(position) + 1).cast("string")
    name = F.when(F.col("mode") == "renamed", F.concat(F.lit("kpi_query_"), number)).otherwise(F.concat(F.lit("func_"), number))
    names = F.map_from_entries(F.transform("param_names", lambda k, j: F.struct(k, F.concat(F.lit("param_"), (j + 1).cast("string")))))
    verb = F.when(F.col("mode") == "renamed", "Dùng hàm ").otherwise("Dùng ")
    known = F.map_filter("args", lambda k, v: F.array_contains("param_names", k))
    out = df.withColumn("mode", mode).withColumn("masked_name", name)
    return out.withColumn("masked_args", F.when(F.col("mode") == "param", rename_keys(known, names)).otherwise(F.col("args"))).withColumn("masked_instruction", F.concat(verb, "masked_name", F.lit(" để: "), "instruction"))


def mask_call(args: Column, parameter_map: Column) -> Column:
    """Arguments under the masked names of a map masked -> real; others keep their names."""
    return rename_keys(args, invert_map(parameter_map))


def parallel_calls(first_tool: Column, first: Column, second_tool: Column, second: Column) -> Column:
    """Two calls of one request: the second takes over shared arguments of the first."""
    a = F.struct(first_tool.alias("tool_name"), first.alias("arguments"))
    return F.array(a, F.struct(second_tool.alias("tool_name"), shared_override(second, first, SHARED).alias("arguments")))


def chained_calls(first_tool: Column, first: Column, second_tool: Column, second: Column, key: Column) -> Column:
    """Two steps: the second's ``key`` waits for the first's result."""
    waiting = F.map_zip_with(second, F.create_map(key, F.parse_json(F.lit(f'"{PLACEHOLDER}"'))), lambda k, x, y: F.coalesce(y, x))
    return F.array(F.struct(first_tool.alias("tool_name"), first.alias("arguments")), F.struct(second_tool.alias("tool_name"), waiting.alias("arguments")))


def waiting_key(args: Column) -> Column:
    """The argument that waits for the first step; null if none does."""
    return F.try_element_at(F.map_keys(F.map_filter(args, lambda k, v: F.to_json(v).contains(PLACEHOLDER))), F.lit(1))


def react_steps(df: DataFrame, cap: int | None = None) -> DataFrame:
    """Chained rows ``id, instruction, steps, observation`` to two rows of one call each.

    The second shows the observation (array of station codes) and takes its first one. Rows with fewer than
    two steps, without a waiting argument or without an observation give nothing. ``cap`` is the target number of records:
    the chains of the first ids that fill it stay, whole.
    """
    one, two = F.try_element_at("steps", F.lit(1)), F.try_element_at("steps", F.lit(2))
    ready = df.withColumn("_key", waiting_key(two["arguments"])).where((F.size("steps") >= 2) & F.col("_key").isNotNull() & (F.size("observation") > 0))
    if cap is not None:
        ready = first_k(ready, -(-cap // 2), ["id"])[0]
    code = F.parse_json(F.concat(F.lit('"'), F.element_at("observation", 1), F.lit('"')))
    resolved = F.transform_values(two["arguments"], lambda k, v: F.when(k == F.col("_key"), code).otherwise(v))

    def row(suffix: str, scenario: str, instruction: Column, tool: Column, args: Column) -> Column:
        return F.struct(F.concat("id", F.lit(suffix)).alias("id"), F.lit(scenario).alias("scenario"), instruction.alias("instruction"), tool.alias("tool_name"), args.alias("arguments"))

    shown = F.concat(F.col("instruction"), F.lit(OBSERVED[0]), F.to_json("observation"), F.lit(OBSERVED[1]))
    both = F.array(row("_r1", "react_step1", F.col("instruction"), one["tool_name"], one["arguments"]), row("_r2", "react_step2", shown, two["tool_name"], resolved))
    return ready.select(F.explode(both).alias("r")).select("r.*")


def needs_date_repair(missing: Column) -> Column:
    """Exactly one date of the pair is missing."""
    return F.array_contains(missing, DATES[0]) != F.array_contains(missing, DATES[1])


def repair_dates(df: DataFrame) -> DataFrame:
    """Rows ``scenario_family, instruction, missing_slots, checker_args`` with date pairs made whole.

    A row whose request names a concrete date is ambiguous and goes; ``repaired`` marks changed rows.
    """
    broken = (F.col("scenario_family") == "missing_slot") & F.coalesce(needs_date_repair(F.col("missing_slots")), F.lit(False))
    out = df.withColumn("repaired", broken).where(~(broken & names_date(F.col("instruction"))))
    slots = F.array_sort(F.array_union("missing_slots", _texts(DATES)))
    return out.withColumns({"missing_slots": F.when(F.col("repaired"), slots).otherwise(F.col("missing_slots")), "checker_args": F.when(F.col("repaired"), without_keys(F.col("checker_args"), _texts(DATES))).otherwise(F.col("checker_args"))})


def splice(df: DataFrame, replacement: DataFrame, column: str, value: str) -> DataFrame:
    """``df`` with the rows of one family replaced."""
    return df.where(~F.col(column).eqNullSafe(F.lit(value))).unionByName(replacement, allowMissingColumns=True)


def with_profile(df: DataFrame) -> DataFrame:
    return df.withColumn("generation_profile", F.create_map(*(F.lit(x) for pair in PROFILE.items() for x in pair)))


def chat_record(df: DataFrame, system: Column, answer: Column) -> DataFrame:
    """``id, source, messages, expected_action``; raises if a placeholder would leak into the answer."""
    leak = F.when(answer.contains(PLACEHOLDER), F.raise_error(F.concat(F.lit("placeholder in "), F.col("id")))).otherwise(answer)

    def turn(role: str, content: Column) -> Column:
        return F.struct(F.lit(role).alias("role"), content.alias("content"))

    return df.select("id", "source", F.array(turn("system", system), turn("user", F.col("instruction")), turn("assistant", leak)).alias("messages"), "expected_action")


def first_and_last(turns: DataFrame, first_role: str = "user", last_role: str = "assistant") -> DataFrame:
    """First text of one role and last of another in each conversation, by turn."""
    return turns.groupBy("conv_id").agg(F.min_by(F.when(F.col("role") == first_role, F.col("text")), F.when(F.col("role") == first_role, F.col("turn"))).alias("first_text"), F.max_by(F.when(F.col("role") == last_role, F.col("text")), F.when(F.col("role") == last_role, F.col("turn"))).alias("last_text"))
