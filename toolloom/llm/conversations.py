"""Repair of the structure of conversations by cheapest edits.

Every row becomes a letter: its role's initial (s, u, a or another) with its first fault (none, truncated, blank,
duplicate). The letters of a conversation in order are its signature, one byte a row. Every distinct signature is
solved once, by recursion on its halves with kept answers, and its audit (the initials of the cheapest edits) is
joined back to all conversations that have it. Texts are read again and moved once, to replay the edits over the
rows of each conversation in order.

Nothing gathers the rows of a conversation: equal rows are counted before anything moves, duplicates are found by a
minimum a (role, text), the order comes from a range sort that cuts long conversations, and signatures are put
together from pieces of at most ``PIECE`` rows. Only what is one value by its nature, a signature, an audit or a hash
of a whole conversation, is made in one place, the latter two as a stream in bounded memory but for the audit.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from toolloom.llm import common

#: States of the wanted form (s?(ua)+)?: nothing yet, after s, after u, after a.
OPEN, SYSTEM, USER, ASSISTANT = range(4)
STATES = range(4)
#: What the next turn between user and assistant is in each state, and its role.
ANSWER = (USER, USER, ASSISTANT, USER)
ROLES = {USER: "user", ASSISTANT: "assistant"}
#: Faults of a row; one from BLANK on must be deleted.
SOUND, TRUNCATED, BLANK, DUPLICATE = range(4)
DELETE, REROLE, INSERT = 3, 2, 2
#: Letters of a signature: four initials for each fault.
LETTERS = "abcdefghijklmnop"
INITIALS = "sua"
#: Costs of closing a conversation in each state by insertions.
CLOSING = (0, 2 * INSERT, INSERT, 0)
#: Signatures up to this length are kept with their answers.
KEEP = 64
#: Rows of a piece of a signature, as a power of two.
PIECE = 9
#: White space by which a text is blank.
BLANKS = r"\x20\x09-\x0D"


def letter(initial: str, fault: int) -> str:
    return LETTERS[4 * fault + (INITIALS.find(initial) if initial and initial in INITIALS else 3)]


def _moves(symbol: str, state: int, after: tuple[int, ...]) -> Iterator[tuple[str, int, int]]:
    """(edit, cost to the end, state after it) of the edits that use up a row."""
    fault, initial = divmod(LETTERS.index(symbol), 4)
    yield "D", DELETE + after[state], state
    if fault < BLANK:
        yield "R", REROLE + fault + after[ANSWER[state]], ANSWER[state]
        kept = (SYSTEM, USER, ASSISTANT, None)[initial]
        if kept is not None and (kept == ANSWER[state] or (kept == SYSTEM and state == OPEN)):
            yield "K", fault + after[kept], kept


def _row(symbol: str, after: tuple[int, ...]) -> tuple[int, ...]:
    """Least costs before a row in each state; insertions before it are at most one of each role."""
    used = [min(cost for _, cost, _ in _moves(symbol, state, after)) for state in STATES]
    return tuple(min(used[s], INSERT + used[ANSWER[s]], 2 * INSERT + used[ANSWER[ANSWER[s]]]) for s in STATES)


def _solved(signature: str, after: tuple[int, ...]) -> tuple[int, ...]:
    if len(signature) == 1:
        return _row(signature, after)
    half = len(signature) // 2
    return costs(signature[:half], costs(signature[half:], after))


def _written(signature: str, state: int, after: tuple[int, ...]) -> tuple[str, int]:
    if len(signature) > 1:
        half = len(signature) // 2
        first, state = edits(signature[:half], state, costs(signature[half:], after))
        rest, state = edits(signature[half:], state, after)
        return first + rest, state
    out, before = "", _row(signature, after)
    while True:
        ways = [(e, s) for e, cost, s in _moves(signature, state, after) if cost == before[state]]
        if INSERT + before[ANSWER[state]] == before[state]:
            ways.append(("I", ANSWER[state]))
        edit, state = min(ways)
        out += edit
        if edit != "I":
            return out, state


_kept_costs, _kept_edits = lru_cache(1 << 16)(_solved), lru_cache(1 << 16)(_written)


def costs(signature: str, after: tuple[int, ...] = CLOSING) -> tuple[int, ...]:
    """Least costs of a signature from each state at its start, for the costs from each state at its end."""
    if not signature:
        return after
    least = min(after)
    solve = _kept_costs if len(signature) <= KEEP else _solved
    return tuple(cost + least for cost in solve(signature, tuple(cost - least for cost in after)))


def edits(signature: str, state: int = OPEN, after: tuple[int, ...] = CLOSING) -> tuple[str, int]:
    """The cheapest edits' initials, ASCII-least of equally cheap ones, and the state that they lead to.

    Of two different sequences between the same states neither begins with the other (the rest would be insertions,
    at a cost), so the least sequence of the whole is made of the least ones of its parts, the state between them
    being chosen letter by letter.
    """
    if not signature:
        return "", state
    least = min(after)
    write = _kept_edits if len(signature) <= KEEP else _written
    return write(signature, state, tuple(cost - least for cost in after))


def solve(signature: str) -> tuple[int, str]:
    """Cost and audit of a signature."""
    audit, state = edits(signature)
    return costs(signature)[OPEN], audit + {USER: "I", SYSTEM: "II"}.get(state, "")


def _counts(signature: str) -> tuple[int, int, int, int]:
    """Blank, duplicate and truncated rows, and neighbours whose initials are not su, ua or au."""
    places = [LETTERS.index(s) for s in signature]
    faults, initials = [p // 4 for p in places], [p % 4 for p in places]
    illegal = sum(pair not in ((0, 1), (1, 2), (2, 1)) for pair in zip(initials, initials[1:], strict=False))
    return faults.count(BLANK), faults.count(DUPLICATE), faults.count(TRUNCATED), illegal


def damaged(conversations: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, times``: rows damaged by a checksum of ``conv_id:turn``, nulls as one space.

    ``times`` says how often a row is there: 0 where it is dropped, 2 where it is repeated.
    """
    one = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(one("conv_id"), F.lit(":"), one("turn"))) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.translate(one("text"), ".!?", "")).otherwise(one("text"))
    times = F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1)
    return conversations.select("conv_id", "turn", F.when(kind == 4, "user").otherwise(one("role")).alias("role"), text.alias("text"), times.alias("times"))


def _rows(conversations: DataFrame) -> DataFrame:
    """The columns that matter, with the digest of a row's text and how often the row is there."""
    one = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" "))
    times = F.col("times") if "times" in conversations.columns else F.lit(1)
    rows = conversations.select("conv_id", "turn", one("role").alias("role"), one("text").alias("text"), times.cast("long").alias("times"))
    return rows.withColumn("digest", F.sha2("text", 256))


def _order(*more: str) -> list[Column]:
    return [F.asc_nulls_first("conv_id"), *(F.asc(c) for c in more), F.asc_nulls_first("turn"), F.asc("role"), F.asc("digest")]


def signatures(rows: DataFrame) -> DataFrame:
    """``conv_id, signature`` of every conversation that has rows."""
    fault = F.when(~F.col("text").rlike(f"[^{BLANKS}]"), BLANK).when(~F.col("text").rlike(rf"[.!?][{BLANKS}]*\z"), TRUNCATED).otherwise(SOUND)
    small = rows.where("times > 0").select("conv_id", "turn", "role", "digest", "times", fault.alias("fault"))
    # equal rows are counted before they move
    small = small.groupBy("conv_id", "turn", "role", "digest", "fault").agg(F.sum("times").alias("times"))
    small = common.written(small, "conversation-rows")
    at = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn"))  # nulls come first
    first = small.groupBy(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d")).agg(F.min(at).alias("first"))
    told = small.join(first, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("digest") == F.col("d")))
    told = told.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("times"))))
    again = (F.col("copy") > 1) | ~F.col("turn").eqNullSafe(F.col("first.turn"))
    fault = F.when((F.col("fault") != BLANK) & again, DUPLICATE).otherwise(F.col("fault"))
    initial = F.when(F.col("role").startswith("s"), 0).when(F.col("role").startswith("u"), 1).when(F.col("role").startswith("a"), 2).otherwise(3)
    told = told.select("conv_id", "turn", "role", "digest", "copy", F.substring(F.lit(LETTERS), (1 + 4 * fault + initial).cast("int"), F.lit(1)).alias("letter"))
    # a range sort cuts long conversations; the number of a row keeps its order and says its piece
    by = [*_order(), F.asc("copy")]
    told = told.repartitionByRange(*by).sortWithinPartitions(*by).select("conv_id", F.monotonically_increasing_id().alias("row"), "letter")
    told = common.written(told, "conversation-letters")
    joined = lambda items, name: F.array_join(F.transform(F.array_sort(F.collect_list(items)), lambda x: x[name]), "")
    pieces = told.groupBy("conv_id", F.shiftright("row", PIECE).alias("piece")).agg(joined(F.struct("row", "letter"), "letter").alias("letters"))
    return pieces.groupBy("conv_id").agg(joined(F.struct("piece", "letters"), "letters").alias("signature"))


def _audits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    common.own_cache("conversations")
    for batch in batches:
        out = [(s, *_counts(s), *solve(s)) for s in batch["signature"]]
        yield pd.DataFrame(out, columns=["signature", "blank", "duplicate", "truncated", "illegal", "cost", "audit"])


def audits(held: DataFrame) -> DataFrame:
    """``conv_id`` with its ``signature`` and what follows from it; each distinct signature is solved once."""
    solved = held.select("signature").distinct().mapInPandas(_audits, "signature string, blank long, duplicate long, truncated long, illegal long, cost long, audit string")
    return held.join(solved, "signature")


class Replay:
    """The edits of one conversation, replayed over its rows in order."""

    def __init__(self, audit: str):
        self.audit, self.place, self.state = audit, 0, OPEN

    def inserted(self) -> Iterator[tuple[str, str, str]]:
        """(edit, role, text) of rows that are inserted next."""
        while self.audit[self.place : self.place + 1] == "I":
            self.place, self.state = self.place + 1, ANSWER[self.state]
            yield "I", ROLES[self.state], ""

    def row(self, role: str, text: str) -> Iterator[tuple[str, str, str]]:
        """What becomes of a row, with the rows inserted before it."""
        yield from self.inserted()
        edit, self.place = self.audit[self.place], self.place + 1
        if edit == "K":
            self.state = SYSTEM if role[0] == "s" else ANSWER[self.state]
            yield edit, role, text
        elif edit == "R":
            self.state = ANSWER[self.state]
            yield edit, ROLES[self.state], text


def _streamed(rows: DataFrame, heads: DataFrame, act: Callable[[Iterator], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``act`` over all conversations: each one's head row comes first, its rows follow in order."""
    head = heads.select("conv_id", F.lit(0).alias("kind"), *(F.lit(None).cast(t).alias(c) for c, t in (("turn", rows.schema["turn"].dataType), ("role", "string"), ("text", "string"), ("digest", "string"), ("times", "long"))), F.struct(*[c for c in heads.columns if c != "conv_id"]).alias("head"))
    body = rows.where("times > 0").select("conv_id", F.lit(1).alias("kind"), "turn", "role", "text", "digest", "times", F.lit(None).cast(head.schema["head"].dataType).alias("head"))
    both = head.unionByName(body).repartition("conv_id").sortWithinPartitions(*_order("kind"))

    def items(batches):
        common.own_cache("conversations")
        for batch in batches:
            yield from zip(*(batch.column(c).to_pylist() for c in ("kind", "conv_id", "role", "text", "times", "head")), strict=True)

    return both.select("kind", "conv_id", "role", "text", "times", "head").mapInArrow(lambda batches: act(items(batches)), schema)


REPORT = {"conv_id": None, "gaps": "long", "blank": "long", "duplicate": "long", "truncated": "long", "illegal": "long", "cost": "long", "audit": "string", "repaired_sha256": "string"}


def _heads(rows: DataFrame) -> DataFrame:
    """A row for every conversation, those without rows included: counts and audit."""
    there = F.when(F.col("times") > 0, F.col("turn"))
    gaps = F.coalesce(F.max(there) - F.min(there) + 1 - F.count_distinct(there), F.lit(0)).cast("long")
    stats = rows.groupBy(F.col("conv_id").alias("c")).agg(gaps.alias("gaps"))
    told = audits(common.written(signatures(rows), "conversation-signatures"))
    zero = [F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "cost")]
    heads = stats.join(told, F.col("c").eqNullSafe(F.col("conv_id")), "left")
    return heads.select(F.col("c").alias("conv_id"), "gaps", *zero, F.coalesce("audit", F.lit("")).alias("audit"))


def report(conversations: DataFrame) -> DataFrame:
    """``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256``: a row for every conversation.

    ``conversations(conv_id, turn, role, text[, times])``; ``times`` says how often a row is there (0: it only names
    its conversation). Rows go by turn, nulls first, then by role and by the SHA-256 of their text. Null roles and
    texts count as one space, a null conv_id is a conversation of its own, repeated rows are rows. A conversation
    without rows has zeros, an empty audit and the hash of the empty string; an empty table gives no rows. Long texts
    are hashed as a stream; other columns are not read.
    """
    rows = _rows(conversations)
    columns = [c for c in REPORT if c not in ("conv_id", "repaired_sha256")]
    kind = conversations.schema["conv_id"].dataType

    def act(items):
        from pyspark.sql.pandas.types import to_arrow_type

        done, conv, head, replay, sha, empty = [], None, None, None, None, True

        def add(lines):
            nonlocal empty
            for _, role, text in lines:
                sha.update((("" if empty else "\n") + role + ":" + text).encode())
                empty = False

        def close():
            if head is not None:
                add(replay.inserted())
                done.append([conv, *(head[c] for c in columns), sha.hexdigest()])

        def flushed():
            types = {"long": pa.int64(), "string": pa.string(), None: to_arrow_type(kind)}
            out = pa.RecordBatch.from_arrays([pa.array(list(x), types[REPORT[c]]) for c, x in zip(REPORT, zip(*done, strict=True), strict=True)], list(REPORT))
            done.clear()
            return out

        for k, c, role, text, times, first in items:
            if k == 0:
                close()
                conv, head, replay, sha, empty = c, first, Replay(first["audit"]), hashlib.sha256(), True
                if len(done) >= common.BATCH_ROWS:
                    yield flushed()
                continue
            for _ in range(times):
                add(replay.row(role, text))
        close()
        if done:
            yield flushed()

    schema = ", ".join(f"{c} {t or kind.simpleString()}" for c, t in REPORT.items())
    return _streamed(rows, _heads(rows), act, schema)


def repair(conversations: DataFrame) -> DataFrame:
    """``conv_id, place, edit, role, text``: the repaired rows in order, from 0; edit is K, R or I.

    Input, order and odd values as in ``report``; a conversation that nothing is left of has no rows.
    """
    rows = _rows(conversations)
    kind = conversations.schema["conv_id"].dataType

    def act(items):
        from pyspark.sql.pandas.types import to_arrow_type

        types, names = [to_arrow_type(kind), pa.int64(), pa.string(), pa.string(), pa.string()], ["conv_id", "place", "edit", "role", "text"]
        done, size, conv, replay, place = [], 0, None, None, 0

        def flushed():
            out = pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(zip(*done, strict=True), types, strict=True)], names)
            done.clear()
            return out

        def lines():
            for k, c, role, text, times, first in items:
                if k == 0:
                    if replay:
                        yield from replay.inserted()
                    yield c, first["audit"]
                    continue
                for _ in range(times):
                    yield from replay.row(role, text)
            if replay:
                yield from replay.inserted()

        for line in lines():
            if len(line) == 2:
                conv, replay, place = line[0], Replay(line[1]), 0
                continue
            done.append((conv, place, *line))
            place, size = place + 1, size + len(line[2])
            if len(done) >= common.BATCH_ROWS or size >= common.BATCH_BYTES:
                size = 0
                yield flushed()
        if done:
            yield flushed()

    return _streamed(rows, _heads(rows).select("conv_id", "audit"), act, f"conv_id {kind.simpleString()}, place long, edit string, role string, text string")
