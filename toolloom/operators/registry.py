"""Registries as dimension tables.

``tools``: name, description, deprecated, params array<struct<name, type, required, enum, pattern,
description, place>>, enum items as JSON texts, place in the list of required ones. ``contracts``: tool_name, verified, rules array<struct<path, op,
value, message>>, values as JSON texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PARAM = "struct<name:string,type:string,required:boolean,enum:array<string>,pattern:string,description:string,place:int>"
TOOL_JSON = "name string, description string, deprecated boolean, parameters struct<required:array<string>, properties:map<string,variant>>"
RULE = "struct<path:string,op:string,value:string,message:string>"


def last_wins(df: DataFrame, keys: list[str], position: Column) -> DataFrame:
    """One row a key: the one at the last position."""
    order = Window.partitionBy(*keys).orderBy(position.desc())
    return df.withColumn("_place", F.row_number().over(order)).where("_place = 1").drop("_place")


def first_wins(df: DataFrame, keys: list[str], position: Column) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(position.asc())
    return df.withColumn("_place", F.row_number().over(order)).where("_place = 1").drop("_place")


def params_of(properties: Column, required: Column) -> Column:
    """Parameter structs from JSON-schema properties, in name order."""

    def one(e: Column) -> Column:
        v = e.value
        return F.struct(
            e.key.alias("name"),
            F.try_variant_get(v, "$.type", "string").alias("type"),
            F.array_contains(F.coalesce(required, F.array().cast("array<string>")), e.key).alias("required"),
            F.transform(F.try_variant_get(v, "$.enum", "array<variant>"), lambda x: F.to_json(x)).alias("enum"),
            F.try_variant_get(v, "$.pattern", "string").alias("pattern"),
            F.try_variant_get(v, "$.description", "string").alias("description"),
            F.array_position(F.coalesce(required, F.array().cast("array<string>")), e.key).cast("int").alias("place"),
        )

    return F.array_sort(F.transform(F.map_entries(properties), one))


def tools(raw: DataFrame) -> DataFrame:
    """``raw(pos, name, description, deprecated, parameters)`` to the tools table; of equal names the last wins."""
    known = last_wins(raw.where(F.col("name").isNotNull()), ["name"], F.col("pos"))
    return known.select("name", "description", F.coalesce("deprecated", F.lit(False)).alias("deprecated"), F.coalesce(params_of(F.col("parameters.properties"), F.col("parameters.required")), F.array().cast(f"array<{PARAM}>")).alias("params"))


def require(df: DataFrame, names: DataFrame, key: str = "name") -> DataFrame:
    """Rows of the registry for ``names``; a name without a row raises when the result is computed."""
    joined = names.join(df.withColumn("_found", F.lit(True)), key, "left")
    checked = F.when(F.col("_found").isNull(), F.raise_error(F.concat(F.lit("not in the registry: "), F.coalesce(F.col(key), F.lit("null")))).cast("boolean")).otherwise(True)
    return joined.where(checked).drop("_found")


def tool_text(name: Column, description: Column, params: Column) -> Column:
    """What retrieval sees of a tool: name, description, parameter names and descriptions."""
    words = F.flatten(F.transform(params, lambda p: F.array(p["name"], F.coalesce(p["description"], F.lit("")))))
    return F.concat_ws(" ", F.nullif(name, F.lit("")), F.nullif(description, F.lit("")), F.array_join(F.filter(words, lambda w: w != ""), " "))


def compact_tool(df: DataFrame) -> DataFrame:
    """Tools as prompts show them; bookkeeping columns never leave."""
    return df.select("name", F.to_json(F.struct("name", "description", F.transform("params", lambda p: F.struct(p["name"], p["type"], p["required"], p["enum"])).alias("parameters"))).alias("tool_json"))


def inject_enums(tools_table: DataFrame, codes: DataFrame) -> DataFrame:
    """Set the enum of parameters that have a code table ``codes(param, code, pos)``: its distinct codes in first-seen order."""
    firsts = codes.groupBy("param", "code").agg(F.min("pos").alias("pos"))
    listed = firsts.groupBy("param").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "code"))), lambda x: F.to_json(F.struct(x["code"].alias("v")))).alias("_codes"))
    # {"v":"x"} -> "x": the code as a JSON text
    listed = listed.select("param", F.transform("_codes", lambda x: F.regexp_replace(x, r'^\{"v":(.*)\}$', "$1")).alias("_codes"))
    lists = listed.agg(F.map_from_entries(F.collect_list(F.struct("param", "_codes"))).alias("_by_param"))
    out = tools_table.crossJoin(F.broadcast(lists))  # one row: a map as large as the code tables
    return out.withColumn("params", F.transform("params", lambda p: p.withField("enum", F.coalesce(F.try_element_at("_by_param", p["name"]), p["enum"])))).drop("_by_param")
