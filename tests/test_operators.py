import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from toolloom.functions.json import args_map
from toolloom.operators import audit, bandit, dedup, derivation, executor, normalise, pairing, registry, reports, validation
from toolloom.sources import readers


@pytest.fixture(scope="module")
def tools(spark):
    props = '{"code": {"type": "string", "pattern": "[A-Z]{3}"}, "n": {"type": "integer"}, "share": {"type": "number"}, "flag": {"type": "boolean"}, "net": {"type": "string", "enum": ["4G", "5G"]}}'
    rows = [(0, "t", "d", False, props, ["code", "n"]), (1, "old", "d", True, "{}", [])]
    raw = spark.createDataFrame(rows, "pos int, name string, description string, deprecated boolean, properties string, required array<string>")
    return registry.tools(raw.select("pos", "name", "description", "deprecated", F.struct("required", F.from_json("properties", "map<string,variant>").alias("properties")).alias("parameters")))


@pytest.mark.parametrize(
    ("tool", "arguments", "codes"),
    [
        ("t", '{"code": "ABC", "n": 1}', []),
        ("t", '{"n": 1}', ["missing_arg"]),
        ("t", '{"code": "ABCD", "n": 1}', ["pattern_mismatch"]),
        ("t", '{"code": 5, "n": 1}', ["invalid_type"]),
        ("t", '{"code": "ABC", "n": "1"}', ["invalid_type"]),
        ("t", '{"code": "ABC", "n": true}', []),
        ("t", '{"code": "ABC", "n": 1.5}', ["invalid_type"]),
        ("t", '{"code": "ABC", "n": 1, "share": 2, "flag": false}', []),
        ("t", '{"code": "ABC", "n": 1, "net": 6}', ["invalid_type", "invalid_enum"]),
        ("t", '{"code": "ABC", "n": 1, "net": "6G", "z": 0}', ["unknown_arg", "invalid_enum"]),
        ("t", None, ["missing_arg", "missing_arg"]),
        ("none", "{}", ["unknown_tool"]),
        (None, "{}", ["unknown_tool"]),
        ("old", '{"z": 1}', ["deprecated_tool"]),
    ],
)
def test_schema_issues(spark, tools, tool, arguments, codes):
    calls = spark.createDataFrame([(1, tool, arguments)], "id int, tool_name string, arguments string")
    row = validation.validate_calls(calls, tools, ["id"]).first()
    assert [i["code"] for i in row["schema_issues"]] == codes


@pytest.mark.parametrize(
    ("op", "value", "actual", "ok"),
    [
        ("eq", '"active"', '"active"', True), ("eq", '"active"', None, False), ("ne", '"cancelled"', None, True), ("ne", '"x"', '"x"', False),
        ("in", '["a","b"]', '"b"', True), ("in", '["a","b"]', None, False), ("gte", "1", "10", True), ("gte", "1", None, False), ("lte", "2", "10", False), ("eq", "true", "true", True),
    ],
)
def test_contract_ops(spark, op, value, actual, ok):
    row = spark.createDataFrame([(op, value, actual)], "op string, v string, a string").select(validation.passes(F.col("a"), F.col("op"), F.col("v")).alias("p")).first()
    assert row["p"] is ok


def test_unmatched_call_gives_one_issue(spark):
    p, g = args_map(F.lit('{"a": 1, "b": 2}')), args_map(F.lit("{}"))
    issues = spark.range(1).select(validation.gold_issues(F.lit("t"), p, F.lit(None).cast("string"), g).alias("i")).first()["i"]
    assert [i["code"] for i in issues] == ["unnecessary_call"]


def test_waiting_values_are_not_compared_and_gold_stays_hidden(spark):
    p, g = args_map(F.lit('{"a": "<from_step_1>", "b": 2}')), args_map(F.lit('{"a": "x", "b": 3}'))
    issues = spark.range(1).select(validation.gold_issues(F.lit("t"), p, F.lit("t"), g).alias("i")).first()["i"]
    assert [(i["code"], i["expected"]) for i in issues] == [("wrong_argument_value", None)]


def greedy_pairs(gold, pred):
    left, out = list(enumerate(pred)), 0
    for g in gold:
        for k, (_, p) in enumerate(left):
            if p == g:
                out += 1
                left.pop(k)
                break
    return out


def test_unordered_pairs_equal_the_greedy_loop(spark):
    rng = random.Random(4)
    lists = [([rng.choice("abc") for _ in range(rng.randrange(5))], [rng.choice("abc") for _ in range(rng.randrange(5))]) for _ in range(60)]

    def frame(side):
        return spark.createDataFrame([(i, k, t, "{}") for i, pair in enumerate(lists) for k, t in enumerate(pair[side])], "id int, pos int, tool_name string, arguments string")

    got = {r["id"]: r["count"] for r in pairing.unordered(frame(0), frame(1)).groupBy("id").count().collect()}
    assert [got.get(i, 0) for i in range(60)] == [greedy_pairs(*pair) for pair in lists]


def test_state_is_folded_in_order(spark):
    state = F.from_json(F.lit('{"status": "active", "outstanding_balance": 50.0, "lost_sim_reported": false}'), executor.STATE)
    calls = F.array(*(F.struct(F.lit(t).alias("tool_name"), F.lit(a).alias("arguments")) for t, a in (("report_lost_sim", "{}"), ("pay_bill", '{"amount": 80}'), ("suspend_line", "{}"), ("get_balance", "{}"))))
    after = spark.range(1).select(executor.fold(state, calls, args_map).alias("s")).first()["s"]
    assert (after["status"], after["outstanding_balance"], after["lost_sim_reported"]) == ("suspended", 0.0, True)


def reference_greedy(rows, threshold=0.85, phrasings=3):
    kept, counts, out = [], {}, []
    for key, pos, tokens, sig, exempt in sorted(rows, key=lambda r: r[1]):
        if not exempt and counts.get((key, sig), 0) >= phrasings:
            continue
        a = set(tokens)
        if any(k == key and a and b and len(a & b) / len(a | b) > threshold for k, b in kept):
            continue
        kept.append((key, a))
        counts[key, sig] = counts.get((key, sig), 0) + 1
        out.append(pos)
    return out


def test_greedy_equals_the_loop(spark):
    rng = random.Random(9)
    base = [[f"w{rng.randrange(30)}" for _ in range(rng.randrange(1, 14))] for _ in range(12)]
    rows = []
    for pos in range(120):
        words = list(rng.choice(base))
        if rng.random() < 0.6:
            words[rng.randrange(len(words))] = f"w{rng.randrange(30)}"
        tokens = sorted(set(words)) if rng.random() > 0.05 else []
        rows.append((rng.choice("xy"), pos, tokens, f"s{rng.randrange(6)}", rng.random() < 0.2))
    df = spark.createDataFrame(rows, "key string, pos int, tokens array<string>, signature string, exempt boolean")
    assert sorted(r["pos"] for r in dedup.greedy(df).collect()) == reference_greedy(rows)


def test_threshold_is_strict(spark):
    tokens = [f"w{i}" for i in range(17)]
    rows = [("k", 1, tokens + ["a", "b", "c"]), ("k", 2, tokens), ("k", 3, tokens + ["d"])]
    pairs = dedup.similar_pairs(spark.createDataFrame(rows, "key string, pos int, tokens array<string>")).collect()
    assert {(r["earlier"], r["later"]) for r in pairs} == {(2, 3)}  # 17 / 20 = 0.85 stays


def test_dates_and_cities(spark):
    def ok(a):
        calls = F.array(F.struct(F.lit("t").alias("tool_name"), args_map(F.lit(a)).alias("arguments")))
        return spark.range(1).select(audit.dates_ok(calls).alias("v")).first()["v"]

    assert ok('{"from_date": "2024-99-01", "to_date": "2024-99-02"}') and not ok('{"date": "1/2/2024"}')
    assert not ok('{"from_date": "2024-02-01", "to_date": "2024-01-01"}') and ok('{"date": "<from_step_1>"}')


def test_date_pairs_are_dropped_together(spark):
    df = spark.createDataFrame([(0,), (1,), (2,)], "i int").select("i", F.array(*map(F.lit, ("from_date", "to_date", "kpi_code"))).alias("required"), args_map(F.lit('{"from_date": 1, "to_date": 2, "kpi_code": 3}')).alias("args"))
    rows = {r["i"]: (r["missing_slots"], sorted(r["checker_arguments"])) for r in derivation.missing_slot(df).collect()}
    assert rows == {0: (["from_date", "to_date"], ["kpi_code"]), 1: (["kpi_code"], ["from_date", "to_date"]), 2: (["from_date", "to_date"], ["kpi_code"])}


def test_placeholder_must_not_leak(spark):
    df = spark.createDataFrame([("1", "s", "do it", "call_function")], "id string, source string, instruction string, expected_action string")
    with pytest.raises(Exception, match="placeholder"):
        derivation.chat_record(df, F.lit("sys"), F.lit("<from_step_1>")).collect()


def test_dialects(spark):
    rows = {r["record_id"]: (r["expected_action"], r["malformed"]) for r in normalise.normalise(readers.demo_rows(spark)).collect()}
    assert rows == {
        "public_xlam_000000": ("call_function", False), "public_toolace_000001": ("call_function", False), "public_apigen_mt_000002": ("call_function", False),
        "public_hermes_fc_000003": ("call_functions", False), "public_xlam_irrelevance_000004": ("abstain", False), "public_xlam_000005": ("abstain", True),
    }
    with pytest.raises(Exception, match="unsupported source"):
        normalise.normalise(spark.createDataFrame([(1, "other", "{}")], "pos int, source string, json string")).collect()


def test_linucb_equals_a_plain_loop(spark):
    rng = np.random.default_rng(1)
    rows = [(i, "s", [float(x) for x in rng.integers(0, 2, 6)], float(rng.random() > 0.5), float(rng.random() > 0.3)) for i in range(80)]
    df = spark.createDataFrame(rows, "id long, split string, x array<double>, reward_a double, reward_b double")
    got = bandit.linucb(df, spark.createDataFrame([(1.0, 7)], "alpha double, seed long")).toPandas()
    order = [r["id"] for r in df.select("id", F.xxhash64("id", F.lit(7).cast("long")).alias("h")).orderBy("h").collect()]
    a, b, hits = [np.eye(6), np.eye(6)], [np.zeros(6), np.zeros(6)], {}
    for i in order:
        x, rewards = np.array(rows[i][2]), rows[i][3:]
        ucb = [float(np.linalg.inv(a[k]) @ b[k] @ x) + float(np.sqrt(x @ np.linalg.inv(a[k]) @ x)) for k in (0, 1)]
        k = int(ucb[1] > ucb[0] + bandit.TIE)
        a[k] += np.outer(x, x)
        b[k] += rewards[k] * x
        hits[i] = float(rewards[k] >= 1)
    assert {i: h for i, h in zip(got["id"], got["hit"], strict=True)} == hits


def test_markdown_refuses_to_cut_rows(spark):
    assert reports.markdown("Ids", spark.range(20), limit=20).count("\n") == 24
    with pytest.raises(ValueError, match="more than 19 rows"):
        reports.markdown("Ids", spark.range(20), limit=19)


def test_copies_do_not_meet(spark):
    rows = [("k", i, [f"w{j}" for j in range(20)] + ([f"x{i % 3}"] if i % 2 else []), f"s{i}", False) for i in range(3000)]
    df = spark.createDataFrame(rows, "key string, pos int, tokens array<string>, signature string, exempt boolean")
    pairs = {(r["earlier"], r["later"]) for r in dedup.similar_pairs(df).collect()}
    assert pairs == {(0, 1), (0, 3), (0, 5), (1, 3), (1, 5), (3, 5)}
    assert [r["pos"] for r in dedup.drop_similar(df).collect()] == [0]
    assert sorted(r["pos"] for r in dedup.greedy(df).collect()) == reference_greedy(rows[:60])


@pytest.mark.parametrize("seed", range(3))
def test_greedy_with_copies_and_caps_equals_the_loop(spark, seed):
    rng = random.Random(seed)
    pool = [sorted(rng.sample([f"w{i}" for i in range(25)], rng.randrange(0, 14))) for _ in range(15)]
    rows = [(rng.choice("xy"), pos, rng.choice(pool), f"s{rng.randrange(4)}", rng.random() < 0.2) for pos in range(150)]
    df = spark.createDataFrame(rows, "key string, pos int, tokens array<string>, signature string, exempt boolean")
    assert sorted(r["pos"] for r in dedup.greedy(df).collect()) == reference_greedy(rows)


def test_evaluator_routes_and_self_check(spark):
    from toolloom.operators import evaluator
    from toolloom.plans.end_to_end import contracts, read_only_tools, transactional_tools

    who = '{"customer_id": "1"}'
    call = ("get_balance", who)
    kinds = "id int, source string, expected_action string, expected_status string, customer_verified boolean, missing_slots array<string>, gold_call struct<tool_name:string,arguments:string>, gold_calls array<struct<tool_name:string,arguments:string>>, gold_steps array<struct<tool_name:string,arguments:string>>"
    samples = spark.createDataFrame([(1, "o", "call_function", None, True, None, call, None, None), (2, None, "abstain", None, None, None, None, None, None), (3, "o", "call_function", None, True, None, ("get_balance", '{"customer_id": "2"}'), None, None), (4, "o", "call_function", None, True, None, None, None, None)], kinds)
    state = spark.createDataFrame([("1", '{"customer_id": "1", "balance": 3}')], "customer_id string, s string").select("customer_id", F.from_json("s", executor.STATE).alias("state"))
    samples = samples.withColumn("raw", evaluator.mock_output(samples))
    out = evaluator.evaluate(samples, "raw", transactional_tools(spark), contracts(spark), state)
    rows = {r["id"]: (r["machine_status"], r["reward_strict"], r["error_type"]) for r in out.collect()}
    assert rows == {1: ("ok", 1.0, None), 2: (None, 1.0, None), 3: ("execution_failed", 0.0, "execution_failed"), 4: ("format_error", 0.0, "format_error")}
    with pytest.raises(Exception, match="does not reach"):
        evaluator.self_checked(samples, out).collect()
    assert evaluator.evaluate_read_only(samples.limit(0), "raw", read_only_tools(spark)).count() == 0


@pytest.mark.parametrize("cap", [1, 3])
def test_rounds_decide_one_key_as_the_loop(spark, cap):
    """Chains and hubs of similar rows, many rows of one signature and of one class, exempt ones among them."""
    rng = random.Random(cap)
    n, groups = 400, 150
    links = {frozenset((a, b)) for a, b in [(i, i + 1) for i in range(0, 60)] + [(70, rng.randrange(groups)) for _ in range(60)] + [(rng.randrange(groups), rng.randrange(groups)) for _ in range(80)] if a != b}
    rows = [("x", i, f"s{0 if rng.random() < 0.3 else rng.randrange(40)}", rng.random() < 0.2, None if rng.random() < 0.1 else 5 if rng.random() < 0.2 else rng.randrange(groups)) for i in range(n)]
    kept, counts = [], {}
    for _, pos, sig, exempt, cid in rows:
        near = cid is not None and any(c is not None and (c == cid or frozenset((c, cid)) in links) for c, _ in kept)
        if not near and (exempt or counts.get(sig, 0) < cap):
            kept.append((cid, pos))
            counts[sig] = counts.get(sig, 0) + 1
    df = spark.createDataFrame(rows, "key string, pos int, signature string, exempt boolean, cid int").repartition(3)
    pairs = spark.createDataFrame([("x", a, b) for x in links for a, b in (tuple(x), tuple(x)[::-1])], "key string, cid int, other int")
    out, rounds = dedup.in_rounds(df, pairs, cap)
    assert sorted(r["pos"] for r in out.collect()) == sorted(p for _, p in kept)
    assert 1 < rounds < 40  # of 400 rows
    assert dedup.in_rounds(df.limit(0), pairs, cap)[1] == 0


SAMPLE = "id int, source string, expected_action string, expected_status string, customer_verified boolean, missing_slots array<string>, gold_call struct<tool_name:string,arguments:string>, gold_calls array<struct<tool_name:string,arguments:string>>, gold_steps array<struct<tool_name:string,arguments:string>>"


def _people(spark):
    rows = [(str(i), json.dumps({"customer_id": str(i), "status": "active", "plan_id": "P1", "outstanding_balance": 50.0, "balance": 7.0})) for i in (1, 2)]
    return spark.createDataFrame(rows, "customer_id string, s string").select("customer_id", F.from_json("s", executor.STATE).alias("state"))


def test_two_customers_null_and_repeated_ids(spark):
    """Writes are seen by later calls on the same customer only; tickets are numbered in the sample; equal rows stay apart."""
    from toolloom.operators import evaluator
    from toolloom.plans.end_to_end import contracts, transactional_tools

    pay, bal, plan = (lambda c, n: ("pay_bill", f'{{"customer_id": "{c}", "amount": {n}}}')), (lambda c: ("get_balance", f'{{"customer_id": "{c}"}}')), (lambda c, p: ("change_plan", f'{{"customer_id": "{c}", "new_plan": "{p}"}}'))
    steps = [pay(1, 10), bal(2), bal(1), pay(1, 100), bal(1), plan(2, "P2"), plan(2, "P2"), plan(1, "P2")]
    rows = [(i, "o", "call_functions", None, True, None, None, None, steps) for i in (None, None, 5, 5)]
    samples = spark.createDataFrame(rows, SAMPLE)
    out = evaluator.evaluate(samples.withColumn("raw", evaluator.mock_output(samples)), "raw", transactional_tools(spark), contracts(spark), _people(spark)).collect()
    assert sorted(str(r["id"]) for r in out) == ["5", "5", "None", "None"]
    for r in out:
        said = [json.loads(x) if x else None for x in r["execution_output"]]
        assert [x and x.get("outstanding_balance") for x in said] == [40.0, 50.0, 40.0, 0.0, 0.0, None, None, None]
        assert [i["code"] for i in r["issues"]] == ["precondition_failed"] and said[6] is None and said[5]["plan_id"] == said[7]["plan_id"] == "P2"
        assert r["machine_status"] == "contract_invalid" and r["execution_success_rate"] == 7 / 8


def test_tickets_are_numbered_in_the_sample(spark):
    from toolloom.operators import evaluator
    from toolloom.plans.end_to_end import _tools, contracts

    tools = _tools(spark, [("open_support_ticket", False, '{"customer_id": {"type": "string"}, "category": {"type": "string"}}', ["customer_id"])])
    calls = [("open_support_ticket", f'{{"customer_id": "{c}", "category": "x"}}') for c in (1, 2, 1)]
    samples = spark.createDataFrame([(1, "o", "call_functions", None, True, None, None, calls, None)], SAMPLE)
    out = evaluator.evaluate(samples.withColumn("raw", evaluator.mock_output(samples)), "raw", tools, contracts(spark), _people(spark)).first()
    assert [json.loads(x)["ticket_id"] for x in out["execution_output"]] == ["T0001", "T0002", "T0003"]


def test_a_registry_of_200000_tools(spark):
    """Large registries and catalogues are joined, not held beside a row; the plan scans the samples once."""
    from toolloom.operators import evaluator
    from toolloom.plans.end_to_end import contracts, read_only_tools, transactional_tools

    who = '{"name": "customer_id", "type": "string", "required": true, "place": 0}'
    kind = transactional_tools(spark).schema["params"].dataType.simpleString()
    many = spark.range(200_000).select(F.concat(F.lit("tool_"), F.col("id").cast("string")).alias("name"), F.lit(False).alias("deprecated"), F.from_json(F.lit(f"[{who}]"), kind).alias("params"))
    tools = transactional_tools(spark).select("name", "deprecated", "params").unionByName(read_only_tools(spark).select("name", "deprecated", "params")).unionByName(many)
    codes = spark.range(150_000).select(F.lit("location_code").alias("param"), F.concat(F.lit("L"), F.col("id").cast("string")).alias("code"))
    seen = ("station_info", '{"location_code": "L149999"}'), ("station_info", '{"location_code": "L150000"}')
    rows = [(1, "o", "call_function", None, True, None, ("get_balance", '{"customer_id": "1"}'), None, None), (2, "o", "call_function", "execution_failed", True, None, ("tool_199999", '{"customer_id": "2"}'), None, None), (3, "real_tool_xlsx", "call_function", None, True, None, seen[0], None, None), (4, "real_tool_xlsx", "call_function", None, True, None, seen[1], None, None)]
    samples = spark.createDataFrame(rows, SAMPLE)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = evaluator.route(samples.withColumn("raw", evaluator.mock_output(samples)), "raw", tools, contracts(spark), _people(spark), codes)
        assert {r["id"]: (r["read_only"], r["machine_status"]) for r in out.collect()} == {1: (False, "ok"), 2: (False, "execution_failed"), 3: (True, "ok"), 4: (True, "wrong_call")}
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert plan.split("Initial Plan")[-1].count("ArrowEvalPython") == 1  # parsed once
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_lookups_keep_rows_and_order(spark):
    from toolloom.operators.lookup import with_lookups

    held = spark.createDataFrame([(f"k{i}", i) for i in range(50)] + [("k7", 7)], "key string, value int")
    rng = random.Random(1)
    rows = [(rng.choice([None, 1, 2]), None if rng.random() < 0.1 else [rng.choice([None, "zz", *(f"k{i}" for i in range(50))]) for _ in range(rng.randrange(5))]) for _ in range(200)]
    df = spark.createDataFrame(rows, "key int, keys array<string>").repartition(5)
    found = sorted(((r["key"], r["keys"], r["_found"]) for r in with_lookups(df, F.col("keys"), held).collect()), key=repr)
    assert found == sorted(((k, ks, [int(x[1:]) if x and x != "zz" else None for x in ks or []]) for k, ks in rows), key=repr)
    assert with_lookups(df.limit(0), F.col("keys"), held).collect() == []


def test_names_in_texts_equal_trying_each_name(spark):
    import re

    from toolloom.operators import audit

    names = [("Hà Nội", "A"), (" hà nội ", "B"), ("TP. Hồ Chí Minh", "C"), ("Bà Rịa - Vũng Tàu", "D"), ("Hue", "E"), ("a-b c", "F"), ("....", "G"), ("Minh", "H"), ("(x) ab", "I"), (None, "J")]
    texts = ["đi Hà Nội hôm nay", "hà nội2", "TP. Hồ Chí Minh!", "TP Hồ Chí Minh", "bà rịa - vũng tàu và hà nội", "bà rịa-vũng tàu", "at hue", "x a-b c.", "wait ....", "a....b", "(x) ab", "y(x) ab", "", None, "MINH minh"]
    low: dict = {}
    for n, c in names:
        if n and len(n.strip()) >= 4:
            low[n.strip().lower()] = min(c, low.get(n.strip().lower(), c))
    word = r"[^\W]"

    def wanted(t):
        return sorted(c for n, c in low.items() if t and re.search(rf"(?<!{word}){re.escape(n)}(?!{word})", t.lower()))

    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    found = audit.with_named(df, "text", spark.createDataFrame(names, "name string, code string")).collect()
    assert {r["id"]: sorted(x["code"] for x in r["named"] or []) for r in found} == {i: wanted(t) for i, t in enumerate(texts)}


def test_hand_written_samples(spark):
    from toolloom.operators import generation

    rows = [generation.call_spec("a", "seen", "s", "do", "t", "{}", gold_calls=[("t", "{}"), ("u", "{}")]), generation.question_spec("b", "seen", "s", "what", ["x"]), generation.refusal_spec("c", "seen", "s", "no", "why")]
    df = generation.specs(spark, rows)
    assert [(r["id"], r["expected_action"], r["scenario_family"]) for r in df.orderBy("id").collect()] == [("a", "call_functions", "single_step_valid"), ("b", "ask_clarification", "missing_slot"), ("c", "abstain", "abstention")]
    with pytest.raises(ValueError, match="repeated"):
        generation.specs(spark, rows + rows[:1])
    with pytest.raises(ValueError, match="no such fields"):
        generation.call_spec("d", "seen", "s", "do", "t", "{}", typo=1)


def test_similarity_join_makes_no_rows_of_sets_that_share_a_few_words(spark):
    """Long and short sets of a small vocabulary, so that all meet at some token: what the join hands on are the similar pairs, and none is lost."""
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(4000)]
    sets = [sorted(rng.sample(vocabulary, n)) for n in (30, 120, 250, 256, 300, 520, 1100) for _ in range(25)]
    for base in sets[::3]:  # near copies, some of them below the threshold, some cut into other groups
        for share in (0.03, 0.07, 0.12):
            gone = set(rng.sample(base, max(1, int(len(base) * share))))
            sets.append([w for w in base if w not in gone] + [f"x{rng.randrange(9)}"])
    rows = [("k" if i % 7 else "other", i, s) for i, s in enumerate(sets)]
    df = spark.createDataFrame(rows, "key string, pos int, tokens array<string>")
    held = [(k, p, set(s)) for k, p, s in rows]
    wanted = {(p, q) for k, p, s in held for other, q, t in held if k == other and p < q and len(s & t) / len(s | t) > 0.85}
    assert {(r["earlier"], r["later"]) for r in dedup.similar_pairs(df).collect()} == wanted and len(wanted) > 100
    met = dedup._candidates(dedup.classes(dedup.cut_up(df)), dedup.THRESHOLD).count()
    assert len(wanted) <= met < 2 * len(wanted)


def test_issue_counts_hold_no_ids(spark):
    rng = random.Random(3)
    rows = [(rng.choice("abc"), rng.choice("xy"), rng.choice([None, *range(4000)])) for _ in range(6000)] + [("one", "x", 7)] * 3
    df = spark.createDataFrame(rows, "tool string, code string, id long").repartition(4)
    out = {(r["tool"], r["code"]): (r["n"], r["examples"]) for r in reports.issue_counts(df, ["tool", "code"], "id", 3).collect()}
    wanted = {}
    for group in {(t, c) for t, c, _ in rows}:
        ids = [i for t, c, i in rows if (t, c) == group]
        least = sorted(set(ids), key=lambda i: (i is not None, i or 0))[:3]
        wanted[group] = (len(ids), ",".join(str(i) for i in least if i is not None))
    assert out == wanted
    plan = reports.issue_counts(df, ["tool", "code"], "id", 3)._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [tool#" in plan and not any("count(1)" in line and ", id#" in line.split("]")[0] for line in plan.splitlines() if "Aggregate" in line)  # no count of each id
