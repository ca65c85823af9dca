"""Evaluation reports: labels as expected actions, rules on documents as predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from toolloom.functions import scores as S
from toolloom.functions.feedback import render, suggested_action
from toolloom.functions.json import with_predictions
from toolloom.operators import audit, reports, scoring
from toolloom.operators.validation import ISSUE
from toolloom.plans.base import Plans, table

plans = Plans()

_SCORED_SQL = """
    WITH rows AS (
        SELECT d.doc_id AS id, lang AS split, source, n_chars AS n,
               CASE WHEN l.quality = 0 THEN 'abstain' WHEN n_chars % 10 = 3 THEN 'ask_clarification' ELSE 'call_function' END AS expected,
               CASE WHEN n_chars < 400 THEN 'abstain' WHEN n_chars % 4 = 3 THEN 'ask_clarification' ELSE 'call_function' END AS predicted,
               n_chars % 17 = 0 AS bad
        FROM labels l JOIN documents d ON l.doc_id = d.doc_id),
    m AS (
        SELECT *, CASE WHEN bad THEN 0.0 WHEN expected = predicted THEN 1.0 ELSE 0.0 END AS action,
               CASE WHEN n % 2 = 0 THEN 1.0 ELSE 0.5 END AS recall,
               CASE WHEN split = 'en' THEN 1.0 ELSE 0.0 END AS func,
               CASE WHEN n % 3 = 0 THEN 1.0 ELSE 0.5 END AS keyf1,
               CASE WHEN n % 7 = 0 THEN 0.25 ELSE 1.0 END AS valacc,
               CASE WHEN n % 5 = 0 THEN 'schema_invalid' WHEN n % 11 = 0 THEN 'contract_invalid' ELSE 'ok' END AS status
        FROM rows),
    c AS (
        SELECT *, NOT bad AND expected = 'call_function' AND predicted = 'call_function' AS called,
               CASE WHEN status = 'schema_invalid' THEN 0.0 ELSE 1.0 END AS schema_v,
               CASE WHEN status = 'contract_invalid' THEN 0.0 ELSE 1.0 END AS contract_v,
               CASE WHEN status = 'ok' THEN 1.0 ELSE 0.0 END AS exec_v
        FROM m),
    r AS (
        SELECT *, CASE WHEN bad THEN 0.0
                    WHEN expected = 'ask_clarification' THEN 0.6 * action + 0.4 * recall
                    WHEN expected = 'abstain' THEN action
                    WHEN called THEN 0.10 * action + 0.20 * func + 0.15 * keyf1 + 0.15 * valacc + 0.15 * schema_v + 0.15 * contract_v + 0.10 * exec_v
                    ELSE 0.1 * action END AS soft,
               CASE WHEN bad THEN 0.0
                    WHEN expected = 'ask_clarification' THEN CASE WHEN predicted = 'ask_clarification' AND recall = 1.0 THEN 1.0 ELSE 0.0 END
                    WHEN expected = 'abstain' THEN action
                    WHEN called AND action = 1 AND func = 1 AND keyf1 = 1 AND valacc = 1 AND status = 'ok' THEN 1.0
                    ELSE 0.0 END AS strict
        FROM c)
"""


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``id, split, is_real, expected, predicted, parse_error, status`` with metrics and rewards."""
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars"), table(spark, sf_dir, "labels").select("doc_id", "quality")
    n = F.col("n_chars")
    rows = labels.join(docs, "doc_id").select(
        F.col("doc_id").alias("id"), F.col("lang").alias("split"), "source", n.alias("n"),
        F.when(F.col("quality") == 0, "abstain").when(n % 10 == 3, "ask_clarification").otherwise("call_function").alias("expected"),
        F.when(n < 400, "abstain").when(n % 4 == 3, "ask_clarification").otherwise("call_function").alias("predicted"),
        F.when(n % 17 == 0, "Invalid JSON").alias("parse_error"),
        F.array(F.lit("a"), F.lit("b")).alias("missing"),
        F.when(n % 2 == 0, F.array(F.lit("a"), F.lit("b"), F.lit("c"))).otherwise(F.array(F.lit("b"))).alias("asked"),
        F.when(n % 5 == 0, "schema_invalid").when(n % 11 == 0, "contract_invalid").otherwise("ok").alias("status"),
    )
    n, status = F.col("n"), F.col("status")
    call = {
        "function_selection_accuracy": (F.col("split") == "en").cast("double"),
        "argument_key_f1": F.when(n % 3 == 0, 1.0).otherwise(0.5),
        "argument_value_accuracy": F.when(n % 7 == 0, 0.25).otherwise(1.0),
        "schema_validity": (status != "schema_invalid").cast("double"),
        "contract_validity": (status != "contract_invalid").cast("double"),
        "execution_success_rate": (status == "ok").cast("double"),
    }
    out = scoring.single(F.col("expected"), F.col("predicted"), F.col("parse_error"), F.col("missing"), F.col("asked"), call, status, F.lit(None), S.TRANSACTIONAL)
    return rows.select("id", "split", (F.col("source") == "src0").alias("is_real"), "expected", "predicted", "parse_error", "status", *(v.alias(k) for k, v in out.items()))


@plans.query(
    _SCORED_SQL
    + """SELECT split, count(*) AS n, round(avg(round(soft, 6)), 6) AS avg_soft, round(avg(round(strict, 6)), 6) AS avg_strict,
                round(avg(round(0.5 * soft + 0.5 * strict, 6)), 6) AS avg_total, sum(CASE WHEN strict = 1 THEN 1 ELSE 0 END)::BIGINT AS strict_success,
                sum(CASE WHEN bad THEN 1 ELSE 0 END)::BIGINT AS parse_errors FROM r GROUP BY split"""
)
def eval_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir).groupBy("split").agg(
        F.count("*").alias("n"), *(F.round(F.avg(f"reward_{k}"), 6).alias(f"avg_{k}") for k in ("soft", "strict", "total")),
        F.count_if(F.col("reward_strict") == 1).alias("strict_success"), F.count_if(F.col("parse_error").isNotNull()).alias("parse_errors"),
    )


@plans.query(_SCORED_SQL + "SELECT source = 'src0' AS is_real, split, round(avg(round(0.5 * soft + 0.5 * strict, 6)), 6) AS avg_reward, count(*) AS n, round(coalesce(avg(CASE WHEN called THEN func END), 0.0), 6) AS func FROM r GROUP BY 1, 2")
def reward_by_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    results = scored(spark, sf_dir).withColumnsRenamed({"reward_total": "reward", "function_selection_accuracy": "func"})
    out = reports.reward_by_split(results, ["func"])
    return out.select("is_real", "split", F.round("avg_reward", 6).alias("avg_reward"), "n", F.round("func", 6).alias("func"))


@plans.query(_SCORED_SQL + "SELECT count(*) AS n, sum(CASE WHEN round(0.5 * soft + 0.5 * strict, 6) = 1 THEN 1 ELSE 0 END)::BIGINT AS strict_success, sum(CASE WHEN bad THEN 1 ELSE 0 END)::BIGINT AS parse_errors FROM r")
def strict_success(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.totals(scored(spark, sf_dir).withColumnRenamed("reward_total", "reward"))


@plans.query(_SCORED_SQL + "SELECT split, round(coalesce(avg(CASE WHEN called THEN keyf1 END), 0.0), 6) AS present_only, round(avg(CASE WHEN called THEN keyf1 ELSE 0.0 END), 3) AS missing_zero FROM r GROUP BY split")
def metric_avg_nullskip(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.col("argument_key_f1")
    return scored(spark, sf_dir).groupBy("split").agg(F.round(reports.mean_where_present(m), 6).alias("present_only"), reports.mean_missing_zero(m).alias("missing_zero"))


@plans.query(_SCORED_SQL + "SELECT split, sum(CASE WHEN status = 'ok' THEN 1 ELSE 0 END)::BIGINT AS matched, count(*) AS n FROM r GROUP BY ROLLUP (split)")
def status_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.status_match(scored(spark, sf_dir).withColumn("expected_status", F.lit(None).cast("string")), "split")


@plans.query(_SCORED_SQL + ", a AS (SELECT split, round(avg(round(soft, 6)), 6) AS a FROM r WHERE expected <> 'abstain' GROUP BY split), b AS (SELECT split, round(avg(round(soft, 6)), 6) AS b FROM r WHERE split <> 'de' GROUP BY split) SELECT split, a, b, round(b - a, 6) AS delta FROM a FULL JOIN b USING (split)")
def split_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scored(spark, sf_dir)
    mean = F.round(F.avg("reward_soft"), 6).alias("v")
    return reports.compare(rows.where("expected <> 'abstain'").groupBy("split").agg(mean), rows.where("split <> 'de'").groupBy("split").agg(mean), "split", "v")


@plans.query(
    _SCORED_SQL
    + """SELECT CASE WHEN bad THEN 'format_error' WHEN expected IN ('ask_clarification', 'abstain') AND strict = 0 THEN 'wrong_action'
                     WHEN expected = 'call_function' AND predicted <> 'call_function' THEN 'wrong_action' ELSE status END AS machine_status,
                CASE WHEN strict = 1 THEN NULL WHEN expected = 'ask_clarification' THEN 'missing_slot_not_handled' WHEN expected = 'abstain' THEN 'unsafe_or_forbidden_action'
                     WHEN predicted <> 'call_function' THEN 'wrong_action' END AS issue_type, count(*) AS n FROM r GROUP BY 1, 2"""
)
def machine_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    status = scoring.machine_status(c("expected"), c("predicted"), c("parse_error"), c("reward_strict"), c("status"))
    kind = scoring.action_issue_type(c("expected"), c("reward_strict"), c("predicted"))
    return scored(spark, sf_dir).groupBy(status.alias("machine_status"), kind.alias("issue_type")).agg(F.count("*").alias("n"))


@plans.query(_SCORED_SQL + "SELECT id, status FROM r WHERE status <> 'ok'")
def gold_self_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.self_check(scored(spark, sf_dir).withColumn("expected_status", F.lit(None).cast("string"))).select("id", "status")


@plans.query(
    """WITH s AS (SELECT c_custkey AS step, (c_custkey % 120) / 100.0 AS p FROM customer),
            w AS (SELECT step, p, 0.3 + 0.6 / (1 + exp(-10.0 * (least(1.0, greatest(0.0, p)) - 0.35))) AS lam FROM s)
       SELECT step, round(lam, 6) AS strict_weight, round((1 - lam) * 0.25 + lam * 0.75, 6) AS blended, 1.0 AS strict_only, 0.0 AS soft_only,
              round(CASE WHEN p < 0.2 THEN 0.3 WHEN p < 0.5 THEN 0.3 + 0.6 * (p - 0.2) / 0.3 ELSE 0.9 END, 6) AS ramp FROM w"""
)
def progressive_lambda(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("step"), ((F.col("c_custkey") % 120) / 100).alias("p"))
    p = F.col("p")
    weight = {k: S.strict_weight(p, *v) for k, v in S.SCHEDULES.items()}
    return steps.select("step", F.round(weight["progressive"], 6).alias("strict_weight"), F.round(S.blend(F.lit(0.25), F.lit(0.75), p), 6).alias("blended"), weight["strict_only"].alias("strict_only"), weight["soft_only"].alias("soft_only"), F.round(S.ramp(p), 6).alias("ramp"))


@plans.query(
    """SELECT CASE event_id % 8 WHEN 0 THEN 'call_function' WHEN 1 THEN 'abstain' WHEN 2 THEN 'call_functions' WHEN 3 THEN 'ask_clarification' WHEN 4 THEN 'abstain'
                                WHEN 5 THEN 'abstain' WHEN 6 THEN 'call_function' ELSE 'call_functions' END AS action,
              CASE event_id % 8 WHEN 0 THEN 1 WHEN 2 THEN 2 WHEN 6 THEN 1 WHEN 7 THEN 2 ELSE 0 END AS n_calls,
              event_id % 8 IN (4, 5) AS failed, sum(CASE WHEN event_id % 8 IN (0, 2, 6, 7) THEN CAST(json_extract_string(props, '$.k') AS BIGINT) END)::BIGINT AS sum_k, count(*) AS n
       FROM events GROUP BY 1, 2, 3"""
)
def parse_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw outputs of eight kinds: bare, reasoning, several calls, questions, no JSON, bad union, fenced, objects one after another."""
    events = table(spark, sf_dir, "events").select("event_id", "event_type", "props")
    call = F.concat(F.lit('{"tool_name": "'), "event_type", F.lit('", "arguments": '), "props", F.lit("}"))
    one = F.concat(F.lit('{"action": "call_function", "call": '), call, F.lit("}"))
    kind = F.col("event_id") % 8
    raw = (
        F.when(kind == 0, one)
        .when(kind == 1, F.concat(F.lit('<think>maybe {"a": 1}</think> {"action": "abstain", "reason": "'), "event_type", F.lit('"}')))
        .when(kind == 2, F.concat(F.lit('{"action": "call_functions", "calls": ['), call, F.lit(", "), call, F.lit("]}")))
        .when(kind == 3, F.lit('so: {"action": "ask_clarification", "asked_slots": ["k"]} thanks'))
        .when(kind == 4, F.lit("no object at all"))
        .when(kind == 5, F.lit('{"action": "call_function", "call": {"arguments": {}}}'))
        .when(kind == 6, F.concat(F.lit("```json\n"), one, F.lit("\n```")))
        .otherwise(F.concat(one, F.lit("\n"), one))
    )
    parsed = with_predictions(events.select(raw.alias("raw")), F.col("raw"), "p")
    calls = F.coalesce(F.col("p.calls"), F.array().cast("array<struct<tool_name:string,arguments:string>>"))
    k = F.get_json_object(F.try_element_at(calls, F.lit(1))["arguments"], "$.k").cast("long")
    return parsed.groupBy(F.col("p.action").alias("action"), F.size(calls).alias("n_calls"), F.col("p.parse_error").isNotNull().alias("failed")).agg(F.sum(k).alias("sum_k"), F.count("*").alias("n"))


#: What the feedback says of an issue at {p} with expected value x and actual value {a}: English, Vietnamese (fixed values, whole lines).
SAID = {
    "unknown_tool": ("Tool `{p}` does not exist in the registry. → Suggested: abstain safely, do not call any tool (abstain).", "Hàm `{p}` không tồn tại trong danh mục. → Gợi ý: từ chối an toàn, không gọi hàm (abstain)."),
    "deprecated_tool": ("Tool `{p}` is deprecated. → Suggested: abstain safely, do not call any tool (abstain).", "Hàm `{p}` đã ngừng hỗ trợ (deprecated). → Gợi ý: từ chối an toàn, không gọi hàm (abstain)."),
    "missing_arg": ("Missing required argument `{p}`. → Suggested: ask the user for a valid value (ask_clarification).", "Thiếu tham số bắt buộc `{p}`. → Gợi ý: hỏi lại người dùng giá trị hợp lệ (ask_clarification)."),
    "invalid_enum": ("Argument `{p}` invalid: expected one of x, got {a}. → Suggested: ask the user for a valid value (ask_clarification).", "Tham số `{p}` không hợp lệ: Kỳ vọng một trong x, thực tế {a}. → Gợi ý: hỏi lại người dùng giá trị hợp lệ (ask_clarification)."),
    "invalid_type": ("Argument `{p}` has wrong type: expected x, got {a}. → Suggested: fix the arguments then call the tool.", "Sai kiểu tham số `{p}`: Kỳ vọng kiểu x, thực tế {a}. → Gợi ý: sửa lại tham số rồi gọi hàm."),
    "precondition_failed": ("Precondition failed at `{p}`: expected 'x', got {a}. → Suggested: abstain safely, do not call any tool (abstain).", "Vi phạm điều kiện nghiệp vụ tại `{p}`: Kỳ vọng 'x', thực tế {a}. → Gợi ý: từ chối an toàn, không gọi hàm (abstain)."),
    "permission_denied": ("Permission denied: the action requires a verified customer (`{p}`). → Suggested: abstain safely, do not call any tool (abstain).", "Thiếu quyền: thao tác yêu cầu khách hàng đã được xác minh (`{p}`). → Gợi ý: từ chối an toàn, không gọi hàm (abstain)."),
    "wrong_function": ("Wrong function `{p}` selected. Use `x` instead. → Suggested: call the required function (call_function).", "Gọi sai hàm `{p}`. Nên dùng `x`. → Gợi ý: gọi đúng hàm yêu cầu (call_function)."),
    "wrong_argument_value": ("Wrong value for `{p}` (you used {a}). Should be 'x'. → Suggested: fix the arguments then call the tool.", "Sai giá trị tham số `{p}` (bạn dùng {a}). Đúng phải là 'x'. → Gợi ý: sửa lại tham số rồi gọi hàm."),
    "missing_argument": ("Missing argument `{p}` required by the request. → Suggested: fix the arguments then call the tool.", "Thiếu tham số `{p}` mà câu hỏi yêu cầu. → Gợi ý: sửa lại tham số rồi gọi hàm."),
    "extra_argument": ("Unnecessary argument `{p}` (value {a}). → Suggested: fix the arguments then call the tool.", "Thừa tham số `{p}` (giá trị {a}) không cần thiết. → Gợi ý: sửa lại tham số rồi gọi hàm."),
    "invalid_code": ("Code `{p}` = {a} is not in the valid catalogue. → Suggested: fix the arguments then call the tool.", "Mã `{p}` = {a} không có trong danh mục mã hợp lệ. → Gợi ý: sửa lại tham số rồi gọi hàm."),
    "unnecessary_call": ("said so → Suggested: issue all required calls (call_functions).", "said so → Gợi ý: gọi đủ các hàm cần thiết (call_functions)."),
    "missing_subscriber": ("said so → Suggested: ask the user for a valid value (ask_clarification).", "said so → Gợi ý: hỏi lại người dùng giá trị hợp lệ (ask_clarification)."),
    "parse_error": ("said so", "said so"),
}
#: Headers by status and language (fixed values).
HEADED = {
    "schema_invalid": ("The response has schema errors:", "Phản hồi có lỗi schema:"), "contract_invalid": ("The response violates business preconditions:", "Phản hồi vi phạm điều kiện nghiệp vụ:"),
    "execution_failed": ("The response failed at execution:", "Phản hồi gây lỗi khi thực thi:"), "wrong_call": ("The response calls the wrong function or arguments:", "Phản hồi gọi sai (hàm hoặc tham số):"), "other": ("The response is incorrect:", "Phản hồi chưa đúng:"),
}


def _said_sql() -> str:
    quoted = lambda text: "'" + text.replace("'", "''") + "'"
    lines = ", ".join(f"({i}, {quoted(code)}, {quoted(en)}, {quoted(vi)})" for i, (code, (en, vi)) in enumerate(SAID.items()))
    heads = ", ".join(f"({i}, {quoted(en)}, {quoted(vi)})" for i, (en, vi) in enumerate(HEADED.values()))
    return f"""SELECT event_id, code, CASE WHEN event_id % 2 = 0 THEN h.en ELSE h.vi END || chr(10) || '• ' || replace(replace(CASE WHEN event_id % 2 = 0 THEN l.en ELSE l.vi END, '{{p}}', event_type), '{{a}}', props) AS text
               FROM events JOIN (VALUES {lines}) AS l(i, code, en, vi) ON event_id % {len(SAID)} = l.i JOIN (VALUES {heads}) AS h(i, en, vi) ON event_id % {len(HEADED)} = h.i"""


@plans.query(_said_sql())
def issue_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feedback for every issue code and status in two languages, word for word."""
    codes, statuses = list(SAID), list(HEADED)
    turn = lambda values: F.element_at(F.array(*map(F.lit, values)), (F.col("event_id") % len(values)).cast("int") + 1)
    code = turn(codes)
    one = F.struct(code.alias("code"), F.col("event_type").alias("path"), F.lit('"x"').alias("expected"), F.col("props").alias("actual"), F.lit("said so").alias("message"), suggested_action(code).alias("suggested_action")).cast(ISSUE)
    text = render(turn(statuses), F.array(one), F.when(F.col("event_id") % 2 == 0, "en").otherwise("vi"))
    return table(spark, sf_dir, "events").select("event_id", code.alias("code"), text.alias("text"))
