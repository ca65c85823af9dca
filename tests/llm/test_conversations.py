import hashlib
import heapq
import random
import re
import zlib

from hypothesis import given, settings
from hypothesis import strategies as st

from toolloom.llm import conversations as C

FIELDS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def cheapest(rows):
    """(cost, audit, repaired lines) by Dijkstra over all edits; rows are (role, text, fault)."""
    follows = {"": ("user", None), "s": ("user", None), "u": ("assistant", None), "a": ("user", None)}
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, state, lines = heapq.heappop(heap)
        if (i, state) in done:
            continue
        done.add((i, state))
        if i == len(rows) and state in ("", "a"):
            return cost, audit, lines
        nxt = follows[state][0]
        heapq.heappush(heap, (cost + 2, audit + "I", i, nxt[0], (*lines, nxt + ":")))
        if i == len(rows):
            continue
        role, text, fault = rows[i]
        heapq.heappush(heap, (cost + 3, audit + "D", i + 1, state, lines))
        if fault in ("blank", "duplicate"):
            continue
        more = fault == "truncated"
        heapq.heappush(heap, (cost + 2 + more, audit + "R", i + 1, nxt[0], (*lines, f"{nxt}:{text}")))
        first = role[:1]
        if first == nxt[0] or (first == "s" and state == ""):
            heapq.heappush(heap, (cost + more, audit + "K", i + 1, first, (*lines, f"{role}:{text}")))


def by_loop(table, damage):
    """The report by plain loops; ``table`` has (conv_id, turn, role, text)."""
    out = {}
    for conv in {r[0] for r in table}:
        rows = []
        for c, turn, role, text in table:
            if c != conv:
                continue
            role, text = (" " if x is None else x for x in (role, text))
            kind = zlib.crc32(":".join(" " if x is None else str(x) for x in (c, turn)).encode()) % 20 if damage else 99
            text = "" if kind == 1 else re.sub(r"[.!?]", "", text) if kind == 2 else text
            rows += [(turn, "user" if kind == 4 else role, text)] * {0: 0, 3: 2}.get(kind, 1)
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.sha256(r[2].encode()).hexdigest()))
        seen, faulty = set(), []
        for _, role, text in rows:
            bare = text.strip(" \t\n\v\f\r")
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "sound"
            seen.add((role, text))
            faulty.append((role, text, fault))
        turns = {r[0] for r in rows if r[0] is not None}
        count = lambda f: sum(x[2] == f for x in faulty)  # noqa: E731, B023
        illegal = sum((a[0][:1] + b[0][:1]) not in ("su", "ua", "au") for a, b in zip(faulty, faulty[1:], strict=False))
        cost, audit, lines = cheapest(faulty)
        out[conv] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, count("blank"), count("duplicate"), count("truncated"), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=C.LETTERS, max_size=9))
def test_a_signature_is_solved_as_by_search(signature):
    rows = []
    for s in signature:
        fault, initial = divmod(C.LETTERS.index(s), 4)
        rows.append((("system", "user", "assistant", "tool")[initial], "x", ("sound", "truncated", "blank", "duplicate")[fault]))
    cost, audit, _ = cheapest(rows)
    assert C.solve(signature) == (cost, audit)


def test_long_signatures():
    rng = random.Random(3)
    signature = "".join(rng.choice("abcdefgm") for _ in range(3000))
    rows = [(("system", "user", "assistant", "tool")[C.LETTERS.index(s) % 4], "x", ("sound", "truncated", "blank", "duplicate")[C.LETTERS.index(s) // 4]) for s in signature]
    cost, audit, lines = cheapest(rows)
    assert C.solve(signature) == (cost, audit)
    assert re.fullmatch("(s?(ua)+)?", "".join(x[0] for x in lines))


SCHEMA = "conv_id long, turn long, role string, text string"


def random_table(rng, conversations):
    texts = ["Hi there.", "What now?", "no end", " \t\n", "", "Done!", "é ü. ", "x" * 3000 + ".", None, " \xa0 "]
    roles = ["system", "user", "assistant", "user", "assistant", "tool", "", None, "agent", "User"]
    out = []
    for c in range(conversations):
        for t in range(rng.randint(1, 9)):
            out.append((None if c == 1 else c, rng.choice([None, t, t, t + 3, t // 2]), rng.choice(roles), rng.choice(texts)))
            if rng.random() < 0.1:
                out.append(out[-1])
    return out


def test_report_agrees_with_loops(spark):
    table = random_table(random.Random(5), 120)
    df = spark.createDataFrame(table, SCHEMA).repartition(5)
    for damage in (False, True):
        found = C.report(C.damaged(df) if damage else df).collect()
        assert {r["conv_id"]: tuple(r[f] for f in FIELDS) for r in found} == by_loop(table, damage)
        assert len(found) == len({r[0] for r in table})


def test_one_long_conversation(spark, monkeypatch):
    rng = random.Random(6)
    table = [(7, t, rng.choice(["user", "assistant"]), rng.choice(["a.", "b?", "c", f"own {t}."])) for t in range(3000)] + [(8, 0, "user", "q?"), (8, 1, "assistant", "a.")]
    found = C.report(spark.createDataFrame(table, SCHEMA)).collect()
    assert {r["conv_id"]: tuple(r[f] for f in FIELDS) for r in found} == by_loop(table, False)


def test_repaired_rows(spark):
    table = random_table(random.Random(8), 40)
    df = spark.createDataFrame(table, SCHEMA)
    told = {r["conv_id"]: r["repaired_sha256"] for r in C.report(df).collect()}
    lines: dict = {}
    for r in sorted(C.repair(df).collect(), key=lambda r: r["place"]):
        held = lines.setdefault(r["conv_id"], [])
        assert len(held) == r["place"]
        held.append(r["role"] + ":" + r["text"])
    for conv, sha in told.items():
        assert hashlib.sha256("\n".join(lines.get(conv, [])).encode()).hexdigest() == sha


def test_empty_and_clashing(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert C.report(C.damaged(empty)).collect() == [] and C.repair(empty).collect() == []
    df = spark.createDataFrame([(1, 0, "user", "q?", 5, "x"), (1, 1, "assistant", "a.", 6, "y")], SCHEMA + ", digest long, signature string")
    assert [r["audit"] for r in C.report(df).collect()] == ["KK"]
    gone = spark.createDataFrame([(3, 0, "user", "q?", 0)], SCHEMA + ", times int")
    assert [tuple(r) for r in C.report(gone).collect()] == [(3, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
