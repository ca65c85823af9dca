"""Feedback texts from structured issues, in Vietnamese or English.

An issue is a struct ``code, path, expected, actual, message, suggested_action``; expected and actual are
JSON texts or null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from toolloom.functions.values import python_repr

# Texts that readers of the feedback were trained on.
SUGGESTION = {
    "vi": {
        "ask_clarification": "hỏi lại người dùng giá trị hợp lệ (ask_clarification)",
        "abstain": "từ chối an toàn, không gọi hàm (abstain)",
        "fix_arguments": "sửa lại tham số rồi gọi hàm",
        "call_function": "gọi đúng hàm yêu cầu (call_function)",
        "call_functions": "gọi đủ các hàm cần thiết (call_functions)",
    },
    "en": {
        "ask_clarification": "ask the user for a valid value (ask_clarification)",
        "abstain": "abstain safely, do not call any tool (abstain)",
        "fix_arguments": "fix the arguments then call the tool",
        "call_function": "call the required function (call_function)",
        "call_functions": "issue all required calls (call_functions)",
    },
}
HEADER = {
    "vi": {
        "schema_invalid": "Phản hồi có lỗi schema:",
        "contract_invalid": "Phản hồi vi phạm điều kiện nghiệp vụ:",
        "execution_failed": "Phản hồi gây lỗi khi thực thi:",
        "wrong_call": "Phản hồi gọi sai (hàm hoặc tham số):",
        "_default": "Phản hồi chưa đúng:",
    },
    "en": {
        "schema_invalid": "The response has schema errors:",
        "contract_invalid": "The response violates business preconditions:",
        "execution_failed": "The response failed at execution:",
        "wrong_call": "The response calls the wrong function or arguments:",
        "_default": "The response is incorrect:",
    },
}
VALID = {
    "vi": "Phản hồi hợp lệ: gọi hàm đã qua kiểm tra schema, hợp đồng và thực thi.",
    "en": "Valid response: the call passed schema, contract, and execution checks.",
}
#: Corrective action for an issue code (fixed values).
SUGGESTED_ACTION = {
    "unknown_tool": "abstain",
    "deprecated_tool": "abstain",
    "missing_arg": "ask_clarification",
    "invalid_enum": "ask_clarification",
    "invalid_type": "fix_arguments",
    "pattern_mismatch": "fix_arguments",
    "unknown_arg": "fix_arguments",
    "permission_denied": "abstain",
    "precondition_failed": "abstain",
    "missing_subscriber": "ask_clarification",
    "execution_failed": "ask_clarification",
    "unnecessary_call": "call_functions",
    "wrong_function": "call_function",
    "missing_argument": "fix_arguments",
    "wrong_argument_value": "fix_arguments",
    "extra_argument": "fix_arguments",
    "invalid_code": "fix_arguments",
    "parse_error": "fix_format",
}
#: Lines by code (fixed values): {p} path, {e} expected, {E} expected as Python shows it, {A} actual as Python shows it. In brackets: only if that value is there.
LINES = {
    "vi": {
        "invalid_enum": "Tham số `{p}` không hợp lệ: Kỳ vọng một trong {e}, thực tế {A}.",
        "invalid_type": "Sai kiểu tham số `{p}`: Kỳ vọng kiểu {e}, thực tế {A}.",
        "missing_arg": "Thiếu tham số bắt buộc `{p}`.",
        "precondition_failed": "Vi phạm điều kiện nghiệp vụ tại `{p}`: Kỳ vọng {E}, thực tế {A}.",
        "permission_denied": "Thiếu quyền: thao tác yêu cầu khách hàng đã được xác minh (`{p}`).",
        "deprecated_tool": "Hàm `{p}` đã ngừng hỗ trợ (deprecated).",
        "unknown_tool": "Hàm `{p}` không tồn tại trong danh mục.",
        "wrong_function": "Gọi sai hàm `{p}`.[ Nên dùng `{e}`.]",
        "wrong_argument_value": "Sai giá trị tham số `{p}`[ (bạn dùng {A})].[ Đúng phải là {E}.]",
        "missing_argument": "Thiếu tham số `{p}` mà câu hỏi yêu cầu.",
        "extra_argument": "Thừa tham số `{p}`[ (giá trị {A})] không cần thiết.",
        "invalid_code": "Mã `{p}` = {A} không có trong danh mục mã hợp lệ.",
    },
    "en": {
        "invalid_enum": "Argument `{p}` invalid: expected one of {e}, got {A}.",
        "invalid_type": "Argument `{p}` has wrong type: expected {e}, got {A}.",
        "missing_arg": "Missing required argument `{p}`.",
        "precondition_failed": "Precondition failed at `{p}`: expected {E}, got {A}.",
        "permission_denied": "Permission denied: the action requires a verified customer (`{p}`).",
        "deprecated_tool": "Tool `{p}` is deprecated.",
        "unknown_tool": "Tool `{p}` does not exist in the registry.",
        "wrong_function": "Wrong function `{p}` selected.[ Use `{e}` instead.]",
        "wrong_argument_value": "Wrong value for `{p}`[ (you used {A})].[ Should be {E}.]",
        "missing_argument": "Missing argument `{p}` required by the request.",
        "extra_argument": "Unnecessary argument `{p}`[ (value {A})].",
        "invalid_code": "Code `{p}` = {A} is not in the valid catalogue.",
    },
}
NEEDS_VALUES = ("invalid_enum", "invalid_type", "precondition_failed")


def suggested_action(code: Column) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in SUGGESTED_ACTION.items() for x in pair)), code)


def _plain(value: Column) -> Column:
    """A JSON text without the quotes of a string."""
    return F.regexp_replace(value, r'^"(.*)"$', "$1")


def _fill(template: str, issue: Column) -> Column:
    import re

    values = {"p": F.coalesce(issue["path"], F.lit("")), "e": F.coalesce(_plain(issue["expected"]), F.lit("None")), "E": python_repr(issue["expected"]), "A": python_repr(issue["actual"])}
    parts = []
    for plain, optional in re.findall(r"([^\[\]]+)|\[([^\]]*)\]", template):
        pieces = [values[x[1]] if x.startswith("{") else F.lit(x) for x in re.split(r"(\{\w\})", plain or optional) if x]
        text = F.concat(*pieces)
        if optional:
            needed = issue["expected"] if "{e}" in optional or "{E}" in optional else issue["actual"]
            text = F.when(needed.isNotNull(), text).otherwise("")
        parts.append(text)
    return F.concat(*parts)


def issue_line(issue: Column, lang: str) -> Column:
    """One issue as a line with its suggestion; codes without a line show their message."""
    line = None
    for code, template in LINES[lang].items():
        hit = issue["code"] == code
        if code in NEEDS_VALUES:
            hit = hit & (issue["expected"].isNotNull() | issue["actual"].isNotNull())
        line = F.when(hit, _fill(template, issue)) if line is None else line.when(hit, _fill(template, issue))
    line = F.coalesce(line, issue["message"], F.lit(""))
    hints = F.create_map(*(F.lit(x) for pair in SUGGESTION[lang].items() for x in pair))
    hint = F.try_element_at(hints, F.coalesce(issue["suggested_action"], F.lit("")))
    return F.concat(line, F.when(hint.isNotNull(), F.concat(F.lit(" → Gợi ý: " if lang == "vi" else " → Suggested: "), hint, F.lit("."))).otherwise(""))


def render(status: Column, issues: Column, lang: Column) -> Column:
    """The whole feedback text; languages other than ``en`` are Vietnamese."""

    def one(code: str) -> Column:
        header = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for pair in HEADER[code].items() for x in pair)), F.coalesce(status, F.lit(""))), F.lit(HEADER[code]["_default"]))
        lines = F.transform(issues, lambda i: F.concat(F.lit("• "), issue_line(i, code)))
        return F.when((F.coalesce(status, F.lit("")) == "ok") | (F.coalesce(F.size(issues), F.lit(0)) <= 0), VALID[code]).otherwise(F.array_join(F.concat(F.array(header), lines), "\n"))

    return F.when(lang == "en", one("en")).otherwise(one("vi"))


def feedback_or_texts(status: Column, issues: Column, texts: Column, lang: Column, default: str) -> Column:
    """Rendered issues, else the plain texts joined, else a constant."""
    return F.when(F.size(issues) > 0, render(status, issues, lang)).when(F.size(texts) > 0, F.array_join(texts, " ")).otherwise(default)
