import json
import random
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from toolloom.functions.json import args_map
from toolloom.operators import executor, retrieval
from toolloom.sources import writers

ARGS = {"new_plan": ["P1", "P2", "P3"], "email": ["a@b", "c@d"], "amount": [5, 12.5, 0, -3, 700], "eid": ["E"], "sim_type": ["esim", "sim"], "new_limit": [1, 2], "limit": [3.5], "new_owner_id": ["9"]}


def _calls(rng, n, customers):
    tools = [*executor.WRITES, "get_balance", "none such"]
    return [(rng.choice(customers), i, rng.choice(tools), json.dumps({k: rng.choice(v) for k, v in ARGS.items() if rng.random() < 0.8})) for i in range(n)]


def _states(spark):
    rows = [("1", '{"customer_id": "1", "outstanding_balance": 40.0, "status": "active"}'), ("2", '{"customer_id": "2", "tickets": 4}'), ("3", '{"customer_id": "3", "plan_id": "P9"}')]
    return spark.createDataFrame(rows, "customer_id string, s string").select("customer_id", F.from_json("s", executor.STATE).alias("state"))


def _by_fold(spark, calls):
    held = spark.createDataFrame(calls, CALLS).groupBy("customer_id").agg(F.array_sort(F.collect_list(F.struct("pos", "tool_name", "arguments"))).alias("calls"))
    after = _states(spark).join(held, "customer_id", "left").select("customer_id", F.coalesce(executor.fold(F.col("state"), F.col("calls"), args_map), F.col("state")).alias("state"))
    return {r["customer_id"]: _rounded(r["state"]) for r in after.collect()}


def _rounded(state):
    return {k: round(v, 6) if isinstance(v, float) else v for k, v in state.asDict().items()}


CALLS = "customer_id string, pos int, tool_name string, arguments string"


def test_parallel_fold_is_the_fold(spark, monkeypatch):
    monkeypatch.setattr(executor, "STRETCH", 3)
    calls = _calls(random.Random(1), 600, ["1", "2", "4", None])
    out = executor.fold_table(_states(spark), spark.createDataFrame(calls, CALLS).repartition(5)).collect()
    assert {r["customer_id"]: _rounded(r["state"]) for r in out} == _by_fold(spark, calls)
    assert executor.fold_table(_states(spark), spark.createDataFrame([], CALLS)).count() == 3


def test_many_calls_on_one_customer(spark):
    n = 300_000
    calls = spark.range(0, n, numPartitions=8).select(F.lit("1").alias("customer_id"), F.col("id").alias("pos"), F.when(F.col("id") % 2 == 0, "pay_bill").otherwise("open_support_ticket").alias("tool_name"), F.when(F.col("id") < n - 2, '{"amount": 1}').otherwise('{"amount": -7}').alias("arguments"))
    state = executor.fold_table(_states(spark), calls).where("customer_id = '1'").first()["state"]
    assert state["outstanding_balance"] == 7.0 and state["tickets"] == n // 2


def test_streamed_fold_agrees(spark, tmp_path):
    from toolloom.streaming import scoring

    calls = _calls(random.Random(2), 90, ["1", "2", "3"])
    for i in range(3):
        spark.createDataFrame(calls[30 * i : 30 * i + 30], CALLS).coalesce(1).write.json(str(tmp_path / "in" / f"{i}"))
    table = str(tmp_path / "states")
    scoring.start_states(_states(spark), table)
    for i in range(3):  # in order; the same source goes on
        stream = spark.readStream.schema(CALLS).json(str(tmp_path / "in" / f"{i}"))
        scoring.fold_calls(stream, table, str(tmp_path / f"check{i}")).trigger(availableNow=True).start().awaitTermination()
        spark.createDataFrame([(r["customer_id"], r["state"]) for r in writers.current(spark, table, scoring.STATES).collect()], _states(spark).schema)  # readable
        held = writers.current(spark, table, scoring.STATES).withColumn("batch", F.lit(-1).cast("long"))
        writers.replace(held, table)
    out = writers.current(spark, table, scoring.STATES).collect()
    assert {r["customer_id"]: _rounded(r["state"]) for r in out} == _by_fold(spark, calls)


def test_a_repeated_batch_changes_nothing(spark, tmp_path):
    from toolloom.streaming import scoring

    table, source = str(tmp_path / "states"), str(tmp_path / "in")
    scoring.start_states(_states(spark), table)
    spark.createDataFrame([("1", 0, "pay_bill", '{"amount": 5}')], CALLS).coalesce(1).write.json(source)
    for check in ("a", "b"):  # a lost checkpoint: the batch comes again
        scoring.fold_calls(spark.readStream.schema(CALLS).json(source), table, str(tmp_path / check)).trigger(availableNow=True).start().awaitTermination()
    assert writers.current(spark, table, scoring.STATES).where("customer_id = '1'").first()["state"]["outstanding_balance"] == 35.0


def test_two_writers_at_once(spark, tmp_path):
    table = str(tmp_path / "t")
    writers.replace(spark.createDataFrame([(0,)], "n long"), table)
    with ThreadPoolExecutor(4) as pool:  # no update is lost
        list(pool.map(lambda _: writers.update(spark, table, lambda df: df.select((F.col("n") + 1).alias("n")), "n long", tries=30), range(4)))
        assert writers.current(spark, table).first()["n"] == 4
        numbers = list(pool.map(lambda i: writers.replace(spark.createDataFrame([(i,)], "n long"), table), range(4)))
    assert len(set(numbers)) == 4
    with pytest.raises(writers.Conflict):
        writers.replace(spark.createDataFrame([(9,)], "n long"), table, base=0)
    assert not list((tmp_path / "t").glob("_new-*"))


def test_a_writer_that_is_gone_holds_nobody_up(spark, tmp_path):
    table = str(tmp_path / "t")
    writers.replace(spark.createDataFrame([(0,)], "n long"), table)
    (tmp_path / "t" / "_claims" / f"{1:09d}").touch()
    assert writers.replace(spark.createDataFrame([(1,)], "n long"), table, base=0, patience=0.3) == 2
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "_appending").touch()
    writers.append_missing(spark.range(3).withColumnRenamed("id", "pos"), str(tmp_path / "a"), "pos", lambda df: df, patience=0.3)
    assert spark.read.parquet(str(tmp_path / "a")).count() == 3


def test_two_appends_at_once(spark, tmp_path):
    target = str(tmp_path / "a")
    jobs = spark.range(20).withColumnRenamed("id", "pos")
    with ThreadPoolExecutor(3) as pool:
        list(pool.map(lambda _: writers.append_missing(jobs, target, "pos", lambda df: df.withColumn("x", F.lit(1))), range(3)))
    assert sorted(r["pos"] for r in spark.read.parquet(target).collect()) == list(range(20))


@pytest.mark.parametrize("seed", range(2))
def test_bounded_retrieval_is_the_whole_one(spark, seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    text = lambda n: " ".join(rng.choices(words, [1 / (i + 1) for i in range(60)], k=n))
    docs = spark.createDataFrame([(i, text(rng.randrange(0, 40))) for i in range(300)], "doc_id int, text string")
    queries = spark.createDataFrame([(i, text(rng.randrange(0, 12))) for i in range(30)], "query_id int, text string")
    for asked, postings in (retrieval.bm25_terms(queries, docs), retrieval.overlap_terms(queries, docs)):
        whole = asked.join(postings, "token").groupBy("query_id", "doc_id").agg(F.round(F.sum(F.col("weight") * F.col("part")), 6).alias("score"))
        scores: dict = {}
        for r in whole.collect():
            scores.setdefault(r["query_id"], []).append((-r["score"], r["doc_id"]))
        top, met = retrieval.bounded_top_k(asked, postings, 5, "query_id", "doc_id")
        assert sorted((r["query_id"], r["rank"], r["doc_id"], r["score"]) for r in top.collect()) == sorted((q, i + 1, d, -s) for q, v in scores.items() for i, (s, d) in enumerate(sorted(v)[:5]))
        assert met.count() < 0.8 * whole.count()


def test_hard_jobs_become_verified_samples(spark):
    """Jobs of all families, answered by a generator, pass the verifier as samples; places are the least used ones."""
    from toolloom.operators import audit, hard
    from toolloom.plans.end_to_end import _tools

    props = '{"location_code": {"type": "string"}, "from_date": {"type": "string"}, "to_date": {"type": "string"}, "kpi_code": {"type": "string"}}'
    tools = _tools(spark, [("kpi", False, props, ["location_code", "from_date", "to_date", "kpi_code"]), ("other", False, props, ["location_code"])]).withColumn("description", F.lit("Shows it. More"))
    args = lambda i, loc: json.dumps({"location_code": loc, "from_date": f"2024-01-0{i % 9 + 1}", "to_date": "2024-01-31", "kpi_code": "K1"})
    grid = spark.createDataFrame([(t, i, args(i, "L1"), {"location_code": "Da Nang", "_time": "now"}) for t in ("kpi", "other") for i in range(6)], "name string, i int, arguments string, hints map<string,string>")
    call = "struct<tool_name:string,arguments:string>"
    train = spark.createDataFrame([(("kpi", args(i, "L1")), None, None) for i in range(3)], f"gold_call {call}, gold_calls array<{call}>, gold_steps array<{call}>")
    codes = spark.createDataFrame([("location_code", c) for c in ("L1", "L2", "L3")] + [("kpi_code", "K1")], "param string, code string")
    contrasts = spark.createDataFrame([(0, "kpi", "other", "a", "b")], "pair int, a string, b string, a_text string, b_text string")
    pairs = spark.createDataFrame([(0, "kpi", "other")], "pair int, a string, b string")
    jobs = hard.hard_jobs(tools, grid, train, codes, contrasts, pairs, 6, 2)
    rows = jobs.collect()
    assert len({r["job_id"] for r in rows}) == len(rows)
    assert {json.loads(r["arguments"])["location_code"] for r in rows if r["scenario"] == "hard_rare_location"} == {"L2", "L3"}
    fresh = [(r["tool_name"], r["i"]) for r in rows if r["scenario"] == "hard_no_train_overlap"]
    assert len(fresh) == 6 and not {("kpi", i) for i in range(3)} & set(fresh)
    assert all(("KHÔNG nêu" in r["spec"]) == (r["scenario"] != "hard_missing_natural") for r in rows if r["missing_slots"])
    texts = jobs.select("job_id", F.concat(F.lit("<think>x</think>please show "), "job_id").alias("raw"))
    samples = hard.hard_samples(jobs, texts).withColumns({"gold_steps": F.lit(None).cast(f"array<{call}>"), "reason": F.lit(None).cast("string"), "masked_tool": F.lit(None).cast("struct<name:string,deprecated:boolean,params:array<struct<name:string,type:string,required:boolean,enum:array<string>,pattern:string,default:string,place:int>>>")})
    samples = samples.withColumn("masked_tool", F.lit(None).cast(f"struct<name:string,deprecated:boolean,params:{tools.schema['params'].dataType.simpleString()}>"))
    assert samples.count() == len(rows)
    names = spark.createDataFrame([("Da Nang", "L1")], "name string, code string")
    assert audit.verify(samples, tools, codes, names).where("first_fail is not null").count() == 0


def test_bm25_sums_in_its_tasks_and_shuffles_no_pairs(spark, monkeypatch):
    """Every (query, document) pair against plain sums: documents in several rows, without an id or a word, ties, lots of queries."""
    import math
    import random
    from collections import Counter

    rng = random.Random(5)
    words = [f"w{i}" for i in range(30)]
    said = lambda n: " ".join(rng.choice(words[: rng.randint(2, 30)]) for _ in range(n))
    docs = [(i // 2 if i < 20 else i, said(rng.randint(0, 12))) for i in range(150)] + [(None, said(9)), (None, "w1"), (500, None), (501, "w3 w4"), (502, "W4 w3")]
    asked = [(i, said(rng.randint(1, 6))) for i in range(12)] + [(50, "nobody says this"), (51, "")]
    queries, table = spark.createDataFrame(asked, "query_id long, text string"), spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    held = {}
    for d, text in docs:
        held[d] = held.get(d, Counter()) + Counter((text or "").lower().split())
    df, mean = Counter(w for c in held.values() for w in c), sum(sum(c.values()) for c in held.values()) / len(docs)
    want = set()
    for q, text in asked:
        scores = []
        for d, c in held.items():
            parts = [n * math.log(1 + (len(docs) - df[w] + 0.5) / (df[w] + 0.5)) * c[w] * 2.5 / (c[w] + 1.5 * (0.25 + 0.75 * sum(c.values()) / mean)) for w, n in Counter(text.split()).items() if w in c]
            if d is not None and parts:
                scores.append((-round(sum(parts), 6), d))
        want |= {(q, d, -s, i + 1) for i, (s, d) in enumerate(sorted(scores)[:4])}
    for lot, block in ((retrieval.LOT_TERMS, retrieval.BLOCK), (10, 7)):
        monkeypatch.setattr(retrieval, "LOT_TERMS", lot)
        monkeypatch.setattr(retrieval, "BLOCK", block)
        top = retrieval.bm25_top_k(queries, table, 4)
        assert {(r.query_id, r.doc_id, round(r.score, 6), r["rank"]) for r in top.collect()} == want
    plan = top._jdf.queryExecution().executedPlan().toString()
    assert not [line for line in plan.splitlines() if "Exchange" in line and "doc_id" in line]


def test_copies_go_before_hard_rows_are_verified(spark, monkeypatch):
    """Verification sees a row of each content; rows without a word, which are like no other, all come and those that are exempt stay."""
    from toolloom.operators import audit, generation
    from toolloom.plans.end_to_end import DEFECTS, defect_samples

    samples, known, codes, names = defect_samples(spark, "/root/testdata/sf0.001")
    samples = samples.withColumn("pos", F.col("id")).withColumn("filter_overlap", F.col("turn") == 0)
    silent = samples.where("id % 7 = 3").withColumns({c: F.lit(None).cast(samples.schema[c].dataType) for c in ("gold_call", "gold_calls", "gold_steps", "checker_call", "masked_tool", "missing_slots")})
    silent = silent.withColumns({"instruction": F.lit("?!?!?!?!?!"), "scenario_family": F.lit("hard_abstain"), "expected_action": F.lit("abstain"), "reason": F.lit("no"), "filter_overlap": F.lit(False), "pos": F.col("pos") + 10**6, "id": F.col("id") + 10**6})
    train, verify, seen = samples.where("turn = 0"), audit.verify, []
    plain = {tuple(r) for r in generation.hard_sets(samples, known, codes, names, train, 5).select("split", "id").collect()}
    monkeypatch.setattr(audit, "verify", lambda rows, *more: seen.append(rows.count()) or verify(rows, *more))
    got = {tuple(r) for r in generation.hard_sets(samples.unionByName(silent), known, codes, names, train, 5).select("split", "id").collect()}
    n = silent.count()
    assert n > 20 and got - plain == {("eval_real_hard_abstain", r["id"]) for r in silent.select("id").collect()} and plain <= got
    assert seen[0] - n <= len(DEFECTS) < samples.count()


def test_hard_jobs_read_the_training_table_once(spark):
    from toolloom.operators import hard
    from toolloom.plans.end_to_end import _tools

    tools = _tools(spark, [("kpi", False, '{"location_code": {"type": "string"}}', ["location_code"])])
    grid = spark.createDataFrame([("kpi", i, json.dumps({"location_code": f"L{i % 3}"}), {"_time": "now"}) for i in range(9)], "name string, i int, arguments string, hints map<string,string>")
    call = "struct<tool_name:string,arguments:string>"
    rows = spark.createDataFrame([(("kpi", json.dumps({"location_code": f"L{i % 2}"})), None, None) for i in range(40)], f"gold_call {call}, gold_calls array<{call}>, gold_steps array<{call}>")
    read = spark.sparkContext.accumulator(0)

    def told(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    codes = spark.createDataFrame([("location_code", c) for c in ("L0", "L1", "L2")], "param string, code string")
    contrasts, pairs = spark.createDataFrame([], "pair int, a string, b string, a_text string, b_text string"), spark.createDataFrame([], "pair int, a string, b string")
    jobs = hard.hard_jobs(tools, grid, rows.mapInArrow(told, rows.schema), codes, contrasts, pairs, 4, 2).collect()
    assert {json.loads(r["arguments"])["location_code"] for r in jobs if r["scenario"] == "hard_rare_location"} == {"L0", "L2"}
    assert [r["i"] for r in jobs if r["scenario"] == "hard_no_train_overlap"] == [2, 5]
    assert read.value == 40


@pytest.mark.parametrize("read_only", [False, True])
def test_pairs_of_calls_are_scored_in_their_samples_part(spark, read_only):
    """Against plain loops over random calls: unknown tools, no arguments, equal texts in another order, samples without calls; no shuffle by tool."""
    from toolloom.operators import scoring
    from toolloom.operators.validation import PLACEHOLDER

    rng = random.Random(3)
    texts = ['{"a":1,"b":2}', '{"b":2,"a":1}', '{"a":1}', "{}", None, json.dumps({"a": PLACEHOLDER}), '{"a":"1"}']
    side = lambda: [(i, p, rng.choice(["x", "x", "y", None]), rng.choice(texts)) for i in range(40) for p in range(rng.choice([0, 1, 3, 5]))]
    gold, pred = side(), side()
    told = {(i, p): rng.choice(["ok", "ok", "schema_invalid", "contract_invalid"]) for i, p, *_ in pred}
    args = lambda t: json.loads(t or "{}")
    mean = lambda xs: sum(xs) / len(xs) if xs else 0.0

    def f1(p, g):
        both = len(args(p).keys() & args(g).keys())
        return 1.0 if not args(p) and not args(g) else 2 * both / (len(args(p)) + len(args(g)))

    def values(p, g):
        return mean([v == args(p).get(k) and type(v) is type(args(p).get(k)) for k, v in args(g).items()]) if args(g) else float(not args(p))

    want = {}
    for i in range(41):
        g, p = [x[1:] for x in gold if x[0] == i], [x[1:] for x in pred if x[0] == i]
        pairs = []
        if read_only:
            for _, tool, text in p:
                held = [x for x in g if x[1] == tool and tool]
                pairs.append((text, held[-1][2] if held else None, bool(held)))
            matched = sum(x[2] for x in pairs) / max(len(g), len(p), 1)
        else:
            for tool in ("x", "y"):
                a, b = ([x for x in s if x[1] == tool] for s in (p, g))
                pairs += [(x[2], y[2], True) for x in a for y in b if x[0] == y[0]] if i % 2 == 0 else [(x[2], y[2], True) for x, y in zip(a, b, strict=False)]
            matched = len(pairs) / len(g) if g else 1.0
        right = [1.0 if read_only and x and PLACEHOLDER in x else values(x, y) for x, y, _ in pairs]
        state = [told[i, x[0]] for x in p]
        want[i] = (matched, mean([f1(x, y) for x, y, _ in pairs]), mean(right), mean([x != "schema_invalid" for x in state]), *(() if read_only else (mean([x == "ok" for x in state]),)))
    call = "id int, pos int, tool_name string, arguments string"
    gold, pred = spark.createDataFrame(gold, call), spark.createDataFrame(pred, call)
    status = spark.createDataFrame([(*k, s) for k, s in told.items()], "id int, pos int, status string")
    samples = spark.range(41).select(F.col("id").cast("int"), (F.col("id") % 2 == 0).alias("ordered"), F.lit("call_functions").alias("predicted_action"), F.lit(None).cast("string").alias("expected_status"))
    if read_only:
        out = scoring.multi_read_only(samples, gold, pred, status.select("id", "pos", (F.col("status") != "schema_invalid").alias("ok")))
    else:
        out = scoring.multi(samples, gold, pred, status)
    names = ["function_selection_accuracy", "argument_key_f1", "argument_value_accuracy", "schema_validity", *([] if read_only else ["execution_success_rate"])]
    got = {r["id"]: tuple(r[n] for n in names) for r in out.collect()}
    assert {i: pytest.approx(v) for i, v in want.items()} == got
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert not [line for line in plan.splitlines() if "hashpartitioning" in line and ("tool_name" in line.split("hashpartitioning")[1] or "pos" in line.split("hashpartitioning")[1].split("]")[0])]
