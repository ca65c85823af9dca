import json

import pytest
from pyspark.sql import functions as F

from toolloom.functions import feedback, scores, text, values
from toolloom.functions import json as J


def one(spark, expr, **cols):
    df = spark.createDataFrame([tuple(cols.values())], list(cols)) if cols else spark.range(1)
    return df.select(expr.alias("v")).first()["v"]


def parsed(spark, raw):
    df = spark.createDataFrame([(raw,)], "t string")
    return J.with_predictions(df, F.col("t"), "v").first()["v"]


CALL = '{"action": "call_function", "call": {"tool_name": "a", "arguments": {"x": 1}}}'


@pytest.mark.parametrize(
    ("raw", "action", "calls", "error"),
    [
        (CALL, "call_function", 1, None),
        (f"```json\n{CALL}\n```", "call_function", 1, None),
        (f"<think>{{no}}</think>\n{CALL}", "call_function", 1, None),
        ("<think>only</think>", "abstain", None, "No JSON object found in model output."),
        ("not json", "abstain", None, "No JSON object found in model output."),
        ('{"action": "call_functions", "calls": [{"tool_name": "a"}, {"tool_name": "b", "arguments": {}}]}', "call_functions", 2, None),
        ('{"action": "call_functions", "calls": [{"tool_name": "a"}]}', "call_function", 1, None),
        ('{"action": "call_functions", "calls": []}', "abstain", None, "JSON object does not match expected action schema."),
        (f"{CALL}\n{CALL}", "call_functions", 2, None),
        (f"{CALL} and then {{broken", "call_function", 1, None),
        ('{"action": "abstain", "action": "ask_clarification", "asked_slots": ["s"]}', "ask_clarification", None, None),
        ('{"action": "ask_clarification"}', "ask_clarification", None, None),
        ('{"action": "call_function", "call": {"tool_name": "a", "arguments": "x"}}', "abstain", None, "JSON object does not match expected action schema."),
        ('{"action": "call_function", "call": {"tool_name": "a", "arguments": {"s": "}{"}}}', "call_function", 1, None),
        ("{bad}", "abstain", None, "Invalid JSON"),
    ],
)
def test_model_output(spark, raw, action, calls, error):
    p = parsed(spark, raw)
    assert p["action"] == action and p["parse_error"] == error
    assert (len(p["calls"]) if p["calls"] else None) == calls


def test_parse_error_is_no_refusal(spark):
    assert parsed(spark, "x")["reason"] == "parse_error"
    assert parsed(spark, '{"action": "abstain"}')["reason"] == "model abstained"


def test_tokens_keep_other_scripts(spark):
    assert one(spark, text.tokens(F.col("t")), t="Tải Lên_1 mạng!") == ["tải", "lên_1", "mạng"]
    assert one(spark, text.jaccard(text.tokens(F.lit("a b")), text.tokens(F.lit("")))) == 0.0
    assert one(spark, text.jaccard(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("b")))) == 0.5


def test_phrase_needs_word_borders(spark):
    assert one(spark, text.has_phrase(F.col("t"), F.lit("huế")), t="ở huế.")
    assert not one(spark, text.has_phrase(F.col("t"), F.lit("vinh")), t="vinhomes")


def test_key_f1_and_value_accuracy(spark):
    def maps(p, g):
        return J.args_map(F.lit(json.dumps(p))), J.args_map(F.lit(json.dumps(g)))

    for p, g, f1, acc in (({}, {}, 1, 1), ({"a": 1}, {}, 0, 0), ({}, {"a": 1}, 0, 0), ({"a": 1, "b": 2}, {"a": 1}, 2 / 3, 1), ({"a": "1"}, {"a": 1}, 1, 0), ({}, {"a": None}, 0, 1), ({"a": 1.0}, {"a": 1}, 1, 1)):
        a, b = maps(p, g)
        assert one(spark, scores.key_f1(a, b)) == pytest.approx(f1), (p, g)
        assert one(spark, scores.value_accuracy(a, b)) == pytest.approx(acc), (p, g)


def test_schedule_laws(spark):
    rows = spark.createDataFrame([(x / 10,) for x in range(-5, 16)], "p double").select("p", scores.strict_weight(F.col("p")).alias("w")).orderBy("p").collect()
    weights = [r["w"] for r in rows]
    assert weights == sorted(weights) and min(weights) >= 0.3 and max(weights) <= 0.9
    assert weights[0] == weights[5] == pytest.approx(0.3179, abs=1e-3)
    assert one(spark, scores.strict_weight(F.lit(0.4), *scores.SCHEDULES["strict_only"])) == 1.0
    assert one(spark, scores.progress_of(F.lit(3), F.lit(0))) == 1.0


def test_divergences(spark):
    p, q = F.array(F.lit(-0.1), F.lit(-2.0)), F.array(F.lit(-2.0), F.lit(-0.1))
    assert one(spark, scores.top_k_kl(p, p)) == pytest.approx(0) and one(spark, scores.top_k_kl(p, q)) > 0
    assert one(spark, scores.top_k_jsd(p, q, 0.0)) == pytest.approx(0) and one(spark, scores.top_k_jsd(p, q, 1.0)) == pytest.approx(0)


def test_feedback_texts(spark):
    def issue(code, expected=None, actual=None):
        return F.struct(F.lit(code).alias("code"), F.lit("arguments.x").alias("path"), F.lit(expected).cast("string").alias("expected"), F.lit(actual).cast("string").alias("actual"), F.lit("msg").alias("message"), F.lit(feedback.SUGGESTED_ACTION.get(code)).cast("string").alias("suggested_action"))

    def shown(lang, *issues):
        return one(spark, feedback.render(F.lit("schema_invalid"), F.array(*issues), F.lit(lang)))

    assert shown("en", issue("wrong_argument_value", None, '"4G"')).split("\n")[1] == "• Wrong value for `arguments.x` (you used '4G'). → Suggested: fix the arguments then call the tool."
    assert "Should be 'x'" in shown("en", issue("wrong_argument_value", '"x"', "true"))
    assert shown("fr", issue("missing_arg")).startswith("Phản hồi có lỗi schema:\n• Thiếu tham số bắt buộc `arguments.x`.")
    assert "msg" in shown("en", issue("invalid_enum")) and "msg" in shown("en", issue("no_such_code"))
    assert one(spark, feedback.render(F.lit("ok"), F.array(issue("missing_arg")), F.lit("en"))) == feedback.VALID["en"]


def test_values(spark):
    assert one(spark, values.first_filled(F.array().cast("array<string>"), F.array(F.lit("b")))) == ["b"]
    assert one(spark, values.slot_recall(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("b")))) == 0.5
    assert [one(spark, values.python_repr(F.lit(x))) for x in ('"a"', "true", "null", "1.5")] == ["'a'", "True", "None", "1.5"]


def test_other_json_shapes(spark):
    assert one(spark, J.string_array(F.lit('```json\n["a", 1]\n```'))) == ["a", "1"]
    assert one(spark, J.string_array(F.lit("none"))) == []
    assert one(spark, F.size(J.tool_call_blocks(F.lit('<tool_call>{"name": "a"}</tool_call><tool_call>bad</tool_call><tool_call>{"x": 1}</tool_call>')))) == 1
    assert [one(spark, J.coerce_query(F.lit(x))) for x in ("plain", '{"q": "b"}', '{"zz": "c"}')] == ["plain", "b", "c"]
    assert one(spark, J.call_signature(F.lit("t"), F.lit('{"b": 1, "a": "x"}'))) == 't(a="x",b=1)'


@pytest.mark.parametrize(("text", "kind", "value"), [("abc", "STRING", '"abc"'), ('["a", 1]', "ARRAY<VARIANT>", '["a",1]'), ('{"a": 1}', "OBJECT<a: BIGINT>", '{"a":1}'), ("{broken", "STRING", '"{broken"'), ("", "STRING", '""')])
def test_maybe_json(spark, text, kind, value):
    from toolloom.functions.json import maybe_json

    row = spark.createDataFrame([(text,)], "t string").select(F.schema_of_variant(maybe_json(F.col("t"))).alias("k"), F.to_json(maybe_json(F.col("t"))).alias("v")).first()
    assert row["v"] == value and (row["k"] == kind or kind.startswith("ARRAY"))


@pytest.mark.parametrize("value", [{}, [], {"a": 1}, {"a": [], "b": {}}, {"a": [1, 2, {"b": "x,{y}: \"q\""}], "c": None, "d": True}, "plain", 7])
def test_indented_json(spark, value):
    import json

    from toolloom.functions.json import indented_json

    text = json.dumps(value, separators=(",", ":"))
    assert spark.createDataFrame([(text,)], "t string").select(indented_json(F.col("t")).alias("x")).first()["x"] == json.dumps(value, indent=2)


def test_masked_tools_show_known_keys_only(spark):
    from toolloom.operators.retrieval import shown_tool

    texts = ['{"secret": 1, "deprecated": false, "name": "f", "parameters": {"b": [1], "a": null}, "original_name": "g", "status": null}', '{}', "[1]", "no", None]
    found = [r["x"] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(shown_tool(F.col("t")).alias("x")).collect()]
    assert found[1:] == ["{}", None, None, None]
    assert list(json.loads(found[0]).items()) == [("name", "f"), ("parameters", {"a": None, "b": [1]}), ("status", None), ("deprecated", False)]


def test_importance_ratio_is_clipped(spark):
    row = spark.createDataFrame([(0.0, 0.0), (5.0, -5.0), (-100.0, 100.0)], "n double, o double").select(scores.importance_ratio(F.col("n"), F.col("o")).alias("r")).collect()
    assert [r["r"] for r in row] == [1.0, 2.0, pytest.approx(2.718281828 ** -20, rel=1e-6)]
    none = spark.range(1).select(scores.distillation_loss(*(F.array().cast(t) for t in ("array<array<double>>", "array<array<double>>", "array<double>", "array<double>"))).alias("x")).first()
    assert none["x"] == 0.0
