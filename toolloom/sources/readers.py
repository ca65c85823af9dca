"""Readers: JSON and JSON lines, split-aware scans, registries, state, results, spreadsheets."""

from __future__ import annotations

import io
import itertools
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from toolloom.functions.text import bullet_lines
from toolloom.operators.ranks import numbered
from toolloom.operators.registry import TOOL_JSON, last_wins, params_of, tools

CALL = "struct<tool_name:string,arguments:string>"
#: A labelled sample; every field but the id may be absent.
SAMPLE = f"id string, source string, split string, scenario string, scenario_family string, instruction string, customer_verified boolean, expected_action string, expected_status string, generator string, gold_call {CALL}, gold_calls array<{CALL}>, gold_steps array<{CALL}>, missing_slots array<string>, checker_call {CALL}, checker_expected_status string, masked_tool struct<name:string,original_name:string,parameters:string>, prediction struct<action:string,call:{CALL},calls:array<{CALL}>,asked_slots:array<string>,reason:string,parse_error:string>"


def _in_file_order(df: DataFrame, name: str = "pos") -> DataFrame:
    """``df``, read straight from files, with a place that orders rows by file name and line, however files are dealt to tasks."""
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    return df.withColumn(name, place)


def json_lines(spark: SparkSession, path: str | list[str], schema: str = SAMPLE) -> DataFrame:
    """JSON lines with a fixed schema; blank lines are skipped; ``file`` and ``pos`` order them."""
    df = spark.read.schema(schema).json(path)
    return df.withColumns({"file": F.col("_metadata.file_name"), "pos": F.monotonically_increasing_id()})


def json_any(spark: SparkSession, path: str) -> DataFrame:
    """``file, pos, json`` of items of JSON lines (``.jsonl``), of a list, of ``{"data": [...]}`` or of a single object.

    Lines are read as lines, so files of them may have any size and are split; ``pos`` orders the items of a file. Other
    files are one JSON value and must fit a row. An empty file gives nothing; other JSON raises.
    """
    lines = spark.read.option("pathGlobFilter", "*.jsonl").text(path) if path.endswith(".jsonl") or not path.endswith(".json") else None
    whole = spark.read.option("wholetext", True).option("pathGlobFilter", "*[!l]").text(path) if not path.endswith(".jsonl") else None
    parts = []
    if lines is not None:
        # places within a file: the block's begin in the upper bits, the row's place in its task in the lower ones
        at = F.col("_metadata.file_block_start") * F.lit(1 << 20) + F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
        parts.append(lines.select(F.col("_metadata.file_name").alias("file"), at.alias("pos"), F.col("value").alias("json")).where(F.trim("json") != ""))
    if whole is not None:
        whole = whole.select(F.col("_metadata.file_name").alias("file"), F.col("value"))
        v = F.parse_json("value")
        kind = F.schema_of_variant(v)
        listed = F.when(kind.startswith("ARRAY"), F.try_variant_get(v, "$", "array<variant>")).when(F.try_variant_get(v, "$.data", "array<variant>").isNotNull(), F.try_variant_get(v, "$.data", "array<variant>")).when(kind.startswith("OBJECT"), F.array(v)).otherwise(F.raise_error(F.lit("neither list nor object")).cast("array<variant>"))
        parts.append(whole.where(F.trim("value") != "").select("file", F.posexplode(listed).alias("pos", "v")).select("file", F.col("pos").cast("long").alias("pos"), F.to_json("v").alias("json")))
    return parts[0].unionByName(parts[1]) if len(parts) > 1 else parts[0]


def samples(spark: SparkSession, folder: str, prefix: str = "eval_", exclude: tuple[str, ...] = (), schema: str = SAMPLE) -> DataFrame:
    """All ``prefix*.jsonl`` of a folder but those with an excluded prefix, in file order."""
    df = spark.read.schema(schema).option("pathGlobFilter", f"{prefix}*.jsonl").json(folder).withColumn("file", F.col("_metadata.file_name"))
    for x in exclude:
        df = df.where(~F.col("file").startswith(x))
    return df


def chosen_splits(df: DataFrame, which: str) -> DataFrame:
    """``synthetic``, ``real`` or ``all`` samples."""
    real = F.col("source").eqNullSafe(F.lit("real_tool_xlsx"))
    return df if which == "all" else df.where(real if which == "real" else ~real)


def optional(spark: SparkSession, path: str, schema: str) -> DataFrame | None:
    """A JSON table, or None where its file is missing."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)
    return spark.read.schema(schema).option("multiLine", True).json(path) if found else None


def tool_registry(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of tools as the tools table; of equal names the last wins."""
    return tools(_in_file_order(spark.read.schema(TOOL_JSON).option("multiLine", True).json(path)))


def contract_registry(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of contracts: ``tool_name, contract`` with rules; rule values as JSON texts."""
    schema = "tool_name string, requires_customer_verified boolean, preconditions array<struct<path:string, op:string, value:variant, message:string>>"
    raw = _in_file_order(spark.read.schema(schema).option("multiLine", True).json(path))
    rules = F.transform(F.coalesce("preconditions", F.array().cast("array<struct<path:string,op:string,value:variant,message:string>>")), lambda r: F.struct(r["path"].alias("path"), r["op"].alias("op"), F.to_json(r["value"]).alias("value"), r["message"].alias("message")))
    return last_wins(raw, ["tool_name"], F.col("pos")).select("tool_name", F.struct(F.coalesce("requires_customer_verified", F.lit(False)).alias("verified"), rules.alias("rules")).alias("contract"))


def state_tables(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """subscribers, plans and network_status of one JSON object of sections."""
    whole = spark.read.option("wholetext", True).text(path)
    sections = {
        "subscribers": "customer_id string, status string, plan_id string, subscription_type string, outstanding_balance double, balance double, billing_email string, roaming_enabled boolean, lost_sim_reported boolean, esim_supported boolean, esim_active boolean, sim_type string, data_used_gb double, voice_minutes bigint",
        "plans": "plan_id string, monthly_fee bigint, data_gb bigint",
        "network_status": "area_code string, status string, incident string",
    }
    return {k: whole.select(F.explode(F.from_json("value", f"{k} array<struct<{', '.join(': '.join(c.split()) for c in v.split(', '))}>>")[k]).alias("r")).select("r.*") for k, v in sections.items()}


def results(spark: SparkSession, path: str) -> DataFrame:
    """``id, split, family, expected_action, reward`` of result lines: reward, else strict reward, else 0; of equal ids the last wins; rows without id go."""
    schema = "id string, split string, scenario_family string, reward double, reward_strict double, prediction struct<action:string>"
    raw = _in_file_order(spark.read.schema(schema).json(path)).where(F.col("id").isNotNull())
    return last_wins(raw, ["id"], F.col("pos")).select("id", "split", F.coalesce("scenario_family", "split").alias("family"), F.col("prediction.action").alias("expected_action"), F.coalesce("reward", "reward_strict", F.lit(0.0)).alias("reward"))


def demo_rows(spark: SparkSession) -> DataFrame:
    """Rows of the public dialects for runs without input."""
    rows = [
        (0, "xlam", '{"query": "Weather in Hue?", "tools": "[]", "answers": "[{\\"name\\": \\"weather\\", \\"arguments\\": {\\"city\\": \\"Hue\\"}}]"}'),
        (1, "toolace", '{"conversations": [{"from": "user", "value": "Add 1 and 2"}, {"from": "assistant", "value": "{\\"name\\": \\"add\\", \\"arguments\\": {\\"a\\": 1, \\"b\\": 2}}"}], "system": "tools"}'),
        (2, "apigen_mt", '{"conversations": [{"from": "human", "value": "Cancel it"}, {"from": "function_call", "value": "{\\"name\\": \\"cancel\\", \\"arguments\\": {}}"}], "tools": "[]"}'),
        (3, "hermes_fc", '{"conversations": [{"from": "human", "value": "Both"}, {"from": "gpt", "value": "<tool_call>{\\"name\\": \\"a\\"}</tool_call><tool_call>{\\"name\\": \\"b\\"}</tool_call>"}], "tools": "[]"}'),
        (4, "xlam_irrelevance", '{"query": "Cook rice", "answers": "[]", "reason": "no tool"}'),
        (5, "xlam", "not json"),
    ]
    return spark.createDataFrame(rows, "pos int, source string, json string")


_SHEET = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def _sheet_cells(content: bytes, sheet: str, width: int) -> Iterator[tuple[int, list]]:
    """Row number and cells of a workbook's sheet; the XML is pulled row by row and never held whole."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            with z.open("xl/sharedStrings.xml") as f:
                for _, item in ElementTree.iterparse(f):
                    if item.tag == f"{_SHEET}si":
                        shared.append("".join(t.text or "" for t in item.iter(f"{_SHEET}t")))
                        item.clear()
        names = [s.get("name") for s in ElementTree.parse(z.open("xl/workbook.xml")).getroot().find(f"{_SHEET}sheets")]
        if sheet not in names:
            raise ValueError(f"no sheet {sheet!r}; there are {names}")
        with z.open(f"xl/worksheets/sheet{names.index(sheet) + 1}.xml") as f:
            for _, row in ElementTree.iterparse(f):
                if row.tag != f"{_SHEET}row":
                    continue
                out: list = [None] * width
                for cell in row:
                    column = 0
                    for c in re.match("[A-Z]+", cell.get("r"))[0]:
                        column = column * 26 + ord(c) - 64
                    value = cell.find(f"{_SHEET}v")
                    text = shared[int(value.text)] if value is not None and cell.get("t") == "s" else value.text if value is not None else "".join(t.text or "" for t in cell.iter(f"{_SHEET}t")) or None
                    if column <= width:
                        out[column - 1] = text
                yield int(row.get("r")), out
                row.clear()


def sheet_rows(spark: SparkSession, path: str, sheets: list[str], width: int = 16) -> DataFrame:
    """``sheet, pos, cells`` of sheets of an XLSX workbook at any URI that Spark reads; a task a sheet. A missing sheet raises."""
    book = spark.read.format("binaryFile").load(path).select("content", F.explode(F.array(*map(F.lit, sheets))).alias("sheet"))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content, sheet in zip(batch.column("content"), batch.column("sheet").to_pylist(), strict=True):
                cells = _sheet_cells(content.as_py(), sheet, width)
                while part := list(itertools.islice(cells, 1000)):
                    pos, held = zip(*part, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array([sheet] * len(part)), pa.array(pos, pa.int32()), pa.array(list(held), pa.list_(pa.string()))], ["sheet", "pos", "cells"])

    return book.repartition(len(sheets), "sheet").mapInArrow(rows, "sheet string, pos int, cells array<string>")


def code_sheet(spark: SparkSession, path: str, sheet: str) -> DataFrame:
    """``pos, code, name`` of a code sheet without its header row and rows without code."""
    cells = sheet_rows(spark, path, [sheet]).where("pos > 1").select("pos", F.trim(F.try_element_at("cells", F.lit(1))).alias("code"), F.trim(F.try_element_at("cells", F.lit(2))).alias("name"))
    return cells.where("code is not null and code <> ''")


#: Tools that are held out for unseen evaluation.
UNSEEN = ("radio_kpi", "thong_ke_cntt", "top_tram_max", "top_tram_min", "top_cell_max", "top_cell_min", "top_sub_attached_max", "top_sub_attached_min")


def function_sheet(spark: SparkSession, path: str, sheet: str = "Function", unseen: tuple[str, ...] = UNSEEN) -> DataFrame:
    """The tools of a sheet ``name, description, -, schema, queries, call``: ``pos, name, raw_name, description, deprecated, params, split, tool_id, seed_examples, seed_call``.

    Names are lower-cased; the description is the cell's, else the schema's; queries are lines, bullets go; a call that is
    no JSON object is none. Rows without a name go, a schema that is no JSON raises. Enums come by ``registry.inject_enums``.
    """
    cell = lambda i: F.try_element_at("cells", F.lit(i))
    rows = sheet_rows(spark, path, [sheet]).where("pos > 1")
    rows = rows.select("pos", F.trim(cell(1)).alias("raw_name"), F.nullif(F.trim(cell(2)), F.lit("")).alias("own"), F.parse_json(cell(4)).alias("v"), cell(5).alias("queries"), cell(6).alias("call")).where("raw_name is not null and raw_name <> ''")
    call = F.when(F.coalesce(F.schema_of_variant(F.try_parse_json("call")).startswith("OBJECT"), F.lit(False)), F.col("call"))
    properties = F.coalesce(F.try_variant_get("v", "$.parameters.properties", "map<string,variant>"), F.from_json(F.lit("{}"), "map<string,variant>"))
    name = F.lower("raw_name")
    return rows.select(
        "pos", name.alias("name"), "raw_name", F.coalesce("own", F.try_variant_get("v", "$.description", "string"), F.lit("")).alias("description"), F.lit(False).alias("deprecated"),
        params_of(properties, F.try_variant_get("v", "$.parameters.required", "array<string>")).alias("params"), F.when(name.isin(*unseen), "unseen").otherwise("seen").alias("split"),
        F.concat(F.lit("telco.kpi."), name, F.lit(".v1.0")).alias("tool_id"), F.transform(bullet_lines(F.col("queries")), lambda q: F.struct(q.alias("query"), call.alias("call"))).alias("seed_examples"), call.alias("seed_call"),
    )


def with_position(df: DataFrame, *order: str) -> DataFrame:
    """Explicit positions for tables whose row order means something."""
    return numbered(df, [], list(order), "pos")
