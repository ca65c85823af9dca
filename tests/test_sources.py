import json
import zipfile

import pytest
from pyspark.sql import functions as F

from toolloom.sources import readers, writers
from toolloom.streaming import scoring


def test_any_json_shape(spark, tmp_path):
    files = {"a.jsonl": '{"x": 1}\n\n{"x": 2}\n', "b.json": '[{"x": 3}, {"x": 4}]', "c.json": '{"data": [{"x": 5}]}', "d.json": '{"x": 6}', "e.json": ""}
    for name, text in files.items():
        (tmp_path / name).write_text(text)
    rows = readers.json_any(spark, str(tmp_path)).orderBy("file", "pos").collect()
    assert [json.loads(r["json"])["x"] for r in rows] == [1, 2, 3, 4, 5, 6]


def test_samples_skip_excluded_files(spark, tmp_path):
    for name, source in (("eval_a", None), ("eval_real_b", "real_tool_xlsx"), ("sft_c", None)):
        (tmp_path / f"{name}.jsonl").write_text(json.dumps({"id": name, "source": source, "gold_call": {"tool_name": "t", "arguments": {"k": 1}}}) + "\n\n")
    df = readers.samples(spark, str(tmp_path), exclude=("eval_real_",))
    assert [(r["id"], json.loads(r["gold_call"]["arguments"])) for r in df.collect()] == [("eval_a", {"k": 1})]
    both = readers.samples(spark, str(tmp_path))
    assert [readers.chosen_splits(both, w).count() for w in ("synthetic", "real", "all")] == [1, 1, 2]


def test_registries(spark, tmp_path):
    tools = [{"name": "t", "parameters": {"properties": {"a": {"type": "integer"}}, "required": ["a"]}}, {"name": "t", "description": "later", "deprecated": True}]
    (tmp_path / "tools.json").write_text(json.dumps(tools))
    row = readers.tool_registry(spark, str(tmp_path / "tools.json")).first()
    assert (row["description"], row["deprecated"], row["params"]) == ("later", True, [])
    contracts = [{"tool_name": "t", "requires_customer_verified": True, "preconditions": [{"path": "subscriber.status", "op": "in", "value": ["a", "b"], "message": "m"}]}]
    (tmp_path / "contracts.json").write_text(json.dumps(contracts))
    rule = readers.contract_registry(spark, str(tmp_path / "contracts.json")).first()["contract"]
    assert rule["verified"] and rule["rules"][0]["value"] == '["a","b"]'
    assert readers.optional(spark, str(tmp_path / "none.json"), "a int") is None


def test_state_sections(spark, tmp_path):
    state = {"subscribers": [{"customer_id": "C1", "status": "active", "balance": 5}], "plans": [{"plan_id": "P", "monthly_fee": 1}], "network_status": []}
    (tmp_path / "db.json").write_text(json.dumps(state))
    tables = readers.state_tables(spark, str(tmp_path / "db.json"))
    assert {k: v.count() for k, v in tables.items()} == {"subscribers": 1, "plans": 1, "network_status": 0}
    assert tables["subscribers"].first()["balance"] == 5.0


def test_results_fall_back(spark, tmp_path):
    rows = [{"id": "a", "reward": 0.5}, {"id": "a", "reward_strict": 1.0, "split": "s"}, {"id": "b"}, {"reward": 1.0}]
    (tmp_path / "r.jsonl").write_text("\n".join(map(json.dumps, rows)))
    assert sorted((r["id"], r["reward"]) for r in readers.results(spark, str(tmp_path / "r.jsonl")).collect()) == [("a", 1.0), ("b", 0.0)]


def test_sheet(spark, tmp_path):
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    cells = '<row r="1"><c r="A1" t="s"><v>0</v></c></row><row r="2"><c r="A2" t="s"><v>1</v></c><c r="B2" t="inlineStr"><is><t>Name</t></is></c></row><row r="3"><c r="B3"><v>7</v></c></row>'
    with zipfile.ZipFile(tmp_path / "f.xlsx", "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns}><sheets><sheet name="codes" sheetId="1"/></sheets></workbook>')
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>code</t></si><si><t>HN</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {ns}><sheetData>{cells}</sheetData></worksheet>")
    rows = readers.code_sheet(spark, str(tmp_path / "f.xlsx"), "codes").collect()
    assert [(r["code"], r["name"]) for r in rows] == [("HN", "Name")]


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([(i, f"s{i % 2}", [("user", "ü")]) for i in range(25)], "pos long, split string, messages array<struct<role:string,content:string>>")
    path = str(tmp_path / "out")
    assert {r["split"]: r["n"] for r in writers.by_split(df, path).collect()} == {"s0": 13, "s1": 12}
    assert spark.read.json(f"{path}/split=s0").count() == 13
    table = str(tmp_path / "table")
    for below in (20, 10, 5):
        rows = df.select("pos") if below == 20 else writers.current(spark, table)
        writers.replace(rows.where(F.col("pos") < below), table)
        assert writers.current(spark, table).count() == below
    assert writers.versions(spark, table) == [1, 2]  # the one before stays for readers that have begun
    assert [r["pos"] for r in writers.tail(df, 3, "pos").collect()] == [24, 23, 22]
    writers.messages_with_tail(df, str(tmp_path / "m"))
    assert [spark.read.json(str(tmp_path / "m" / x)).count() for x in ("train", "valid")] == [23, 2]
    target, seen = str(tmp_path / "done"), []

    def work(jobs):
        seen.append(jobs.count())
        return jobs.select("pos")

    writers.append_missing(df.where("pos < 10"), target, "pos", work)
    writers.append_missing(df, target, "pos", work)
    assert seen == [10, 15] and spark.read.parquet(target).count() == 25
    assert "| s0 | 13 |" in writers.report(df.groupBy("split").agg(F.count("*").alias("n")).orderBy("split"), "Rows", str(tmp_path / "r"))


@pytest.mark.parametrize("kind", ["parsed", "linucb"])
def test_streams(spark, tmp_path, kind):
    if kind == "parsed":
        spark.createDataFrame([('{"action": "abstain"}',), ("x",)], "raw_output string").write.parquet(str(tmp_path / "in"))
        stream = scoring.parsed(spark.readStream.schema("raw_output string").parquet(str(tmp_path / "in"))).select("prediction.reason")
        want = ["model abstained", "parse_error"]
    else:
        schema = "policy string, id long, x array<double>, reward_a double, reward_b double"
        spark.createDataFrame([("p", i, [1.0, 0.0, 0.0, 0.0, 0.0, 0.0], 0.0, 1.0) for i in range(20)], schema).coalesce(1).write.parquet(str(tmp_path / "in"))
        stream, want = scoring.linucb(spark.readStream.schema(schema).parquet(str(tmp_path / "in"))), 20
    query = stream.writeStream.format("memory").queryName(f"out_{kind}").option("checkpointLocation", str(tmp_path / "cp")).start()
    query.processAllAvailable()
    query.stop()
    rows = spark.sql(f"select * from out_{kind}").collect()
    if kind == "parsed":
        assert sorted(r["reason"] for r in rows) == want
    else:
        assert len(rows) == want and [r["arm"] for r in sorted(rows, key=lambda r: r["id"])][:1] == [0] and sum(r["hit"] for r in rows) > 10


def test_the_last_of_equal_ids_wins_whatever_the_file_sizes(spark, tmp_path):
    (tmp_path / "r").mkdir()
    (tmp_path / "r" / "a.jsonl").write_text('{"id": "x", "reward": 0.25}\n')
    (tmp_path / "r" / "b.jsonl").write_text("".join(f'{{"id": "{"x" if i == 7 else i}", "reward": 0.75}}\n' for i in range(5000)))
    rows = {r["id"]: r["reward"] for r in readers.results(spark, str(tmp_path / "r")).collect()}
    assert rows["x"] == 0.75


def test_lines_and_values_of_a_folder(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"k": 1}\n\n{"k": 2}\n')
    (tmp_path / "b.json").write_text('{"data": [{"k": 3}]}')
    (tmp_path / "c.json").write_text("")
    rows = readers.json_any(spark, str(tmp_path)).orderBy("file", "pos").collect()
    assert [(r["file"], r["json"]) for r in rows] == [("a.jsonl", '{"k": 1}'), ("a.jsonl", '{"k": 2}'), ("b.json", '{"k":3}')]
    assert readers.json_any(spark, str(tmp_path / "a.jsonl")).count() == 2


def test_function_sheet(spark, tmp_path):
    from xml.sax.saxutils import escape

    from toolloom.operators import generation

    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    schema = '{"description": "from the schema", "parameters": {"required": ["b"], "properties": {"b": {"type": "string"}, "a": {"type": "integer"}}}}'
    rows = [["name", "text", "", "schema", "queries", "call"], ["Radio_KPI ", "", "", schema, "- first\n\n-- second", '{"b": "x"}'], ["Other", " own text ", "", '{"parameters": {}}', "", "no json"], ["", "no name", "", "{}", "", ""]]
    cells = "".join(f'<row r="{i}">' + "".join(f'<c r="{"ABCDEF"[k]}{i}" t="inlineStr"><is><t>{escape(x)}</t></is></c>' for k, x in enumerate(row) if x) + "</row>" for i, row in enumerate(rows, 1))
    with zipfile.ZipFile(tmp_path / "t.xlsx", "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns}><sheets><sheet name="Function" sheetId="1"/></sheets></workbook>')
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {ns}><sheetData>{cells}</sheetData></worksheet>")
    df = readers.function_sheet(spark, str(tmp_path / "t.xlsx"))
    first, second = df.orderBy("pos").collect()
    assert (first["name"], first["raw_name"], first["description"], first["split"]) == ("radio_kpi", "Radio_KPI", "from the schema", "unseen")
    assert [(p["name"], p["required"]) for p in first["params"]] == [("a", False), ("b", True)]
    assert [(e["query"], e["call"]) for e in first["seed_examples"]] == [("first", '{"b": "x"}'), ("second", '{"b": "x"}')]
    assert (second["description"], second["split"], second["params"], second["seed_examples"], second["seed_call"]) == ("own text", "seen", [], [], None)
    assert generation.seed_rows(df).count() == 2
