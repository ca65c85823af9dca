"""Periodic runs of words, after Kolpakov and Kucherov, and texts without their repetitions.

A suffix automaton gives the Lempel-Ziv factors of a word sequence. A run whose end lies in a factor either begins at
or before the factor's first word, and is then found by Main's search around that border, or lies strictly within
the factor, and is then a copy of a run in the factor's earlier occurrence. Both take linear time.

Before, a sieve that never loses a run cuts away what cannot be part of one: each five words in a row that lie in a run
of exponent 4 come again in it, at a distance of at most a quarter of its length. Few texts have anything left.
"""

from __future__ import annotations

import hashlib
import zlib
from array import array
from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from toolloom.llm import common

#: A run has at least so many periods and words.
EXPONENT, LEAST = 4, 6
#: Words of a window of the sieve, and its rounds at most: fewer only let more through.
WINDOW, ROUNDS = 5, 8

Run = tuple[int, int, int]


def factors(word: list[int]) -> list[tuple[int, int, int]]:
    """(start, end, start of an earlier occurrence or -1): each factor is the longest that occurred before, or a new letter.

    The automaton's states lie in arrays; a state's edges but its first are in a dictionary.
    """
    length, link, first = array("i", [0]), array("i", [-1]), array("i", [-1])
    letter, to, more = array("i", [-1]), array("i", [-1]), {}
    last = 0
    for i, c in enumerate(word):
        new = len(length)
        length.append(length[last] + 1)
        link.append(0)
        first.append(i)
        letter.append(-1)
        to.append(-1)
        p = last
        while p >= 0:
            if letter[p] == c:
                q = to[p]
                break
            if letter[p] < 0:
                letter[p], to[p] = c, new
            else:
                edges = more.setdefault(p, {})
                if c in edges:
                    q = edges[c]
                    break
                edges[c] = new
            p = link[p]
        else:
            last = new
            continue
        if length[p] + 1 != length[q]:
            twin = len(length)
            length.append(length[p] + 1)
            link.append(link[q])
            first.append(first[q])
            letter.append(letter[q])
            to.append(to[q])
            if q in more:
                more[twin] = dict(more[q])
            while p >= 0:
                if letter[p] == c:
                    if to[p] != q:
                        break
                    to[p] = twin
                elif p in more and more[p].get(c) == q:
                    more[p][c] = twin
                else:
                    break
                p = link[p]
            link[q] = twin
            q = twin
        link[new] = q
        last = new
    out, start, n = [], 0, len(word)
    while start < n:
        state, end, before = 0, start, -1
        while end < n:
            c = word[end]
            following = to[state] if letter[state] == c else more.get(state, {}).get(c, -1)
            if following < 0 or first[following] >= end:
                break
            state, end = following, end + 1
            before = first[state]
        if end == start:
            out.append((start, start + 1, -1))
        else:
            out.append((start, end, before + 1 - (end - start)))
        start = out[-1][1]
    return out


def _prefixes(s: list[int]) -> list[int]:
    """Of each place of ``s``, how long what begins there agrees with what ``s`` begins with."""
    n = len(s)
    z = [0] * n
    left = right = 0
    for i in range(1, n):
        k = min(right - i, z[i - left]) if i < right else 0
        while i + k < n and s[k] == s[i + k]:
            k += 1
        if i + k > right:
            left, right = i, i + k
        z[i] = k
    return z


def _around(word: list[int], before: int, border: int, end: int, found: Callable[[int, int, int], None]) -> None:
    """Main's search: runs that begin at or before ``border`` and end between it and ``end``; the factor before it begins at ``before``.

    Had such a run begun more than a period before that factor, the factor would have reached the run's end. So it has fewer
    than the factor's words and a period on the left, and four periods are fewer words than both factors and a period have.
    """
    right, most = end - border, (end - before - 1) // (EXPONENT - 1)
    if most < 1:
        return
    left, near = min(border, border - before + most), min(most, border)
    own = word[border:end]
    forward = _prefixes(own + [-1] + word[border - near : end])  # of the factor, and of what begins up to a period before it
    inner = min(most, right)
    behind = word[border - left : border][::-1]
    backward = _prefixes(behind + [-2] + word[border - left : border + inner][::-1])
    for q in range(1, most + 1):
        if q <= near:  # a period lies before the border
            r, a = forward[right + 1 + near - q], backward[q] if q < left else 0
            if q + a + r >= max(LEAST, EXPONENT * q):
                found(border - q - a, border + r, q)
        if q <= inner:  # a period lies behind the border
            r, a = forward[q] if q < right else 0, backward[left + 1 + inner - q]
            if a + q + r >= max(LEAST, EXPONENT * q):
                found(border - a, border + q + r, q)


def runs(word: list[int]) -> list[Run]:
    """(start, end, smallest period) of all runs of a sequence of letters from 0, by start and period."""
    n, periods, starting = len(word), {}, {}

    def found(s: int, t: int, q: int) -> None:
        if (s > 0 and word[s - 1] == word[s - 1 + q]) or (t < n and word[t] == word[t - q]):
            return  # goes on: another border shows all of it
        held = periods.get((s, t))
        if held is None:
            starting.setdefault(s, []).append(t)
        if held is None or q < held:
            periods[s, t] = q  # a smaller period of the same stretch is the period

    before = 0
    for start, end, earlier in [*factors(word), (n, n, -1)]:
        if start:
            _around(word, before, start, end, found)
        if earlier >= 0 and starting:
            shift, stop = start - earlier, earlier + end - start
            for s in range(earlier + 1, stop):
                for t in starting.get(s, ()):
                    if t < stop:
                        found(s + shift, t + shift, periods[s, t])
        before = start
    return sorted(((s, t, q) for (s, t), q in periods.items()), key=lambda r: (r[0], r[2]))


def _grouped(alive: np.ndarray, document: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last + 1 of windows that follow each other, all in one document."""
    new = np.flatnonzero((np.diff(alive) > 1) | (document[alive[1:]] != document[alive[:-1]])) + 1
    return np.r_[0, new], np.r_[new, len(alive)]


def stretches(ids: np.ndarray, document: np.ndarray) -> list[tuple[int, int]]:
    """Stretches of documents laid end to end outside which there is no run."""
    n = len(ids) - WINDOW + 1
    if n < 2:
        return []
    mixed = np.zeros(n, np.uint64)
    for k in range(WINDOW):
        mixed = (mixed ^ ids[k : k + n].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    mixed ^= document[:n].astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    places = np.flatnonzero(document[:n] == document[WINDOW - 1 :])
    mixed = mixed[places]
    order = np.argsort(mixed, kind="stable")  # equal windows come together in order; different ones that meet only let more through
    same = np.flatnonzero(mixed[order[1:]] == mixed[order[:-1]])
    here, there = places[order[same]], places[order[same + 1]]
    gap = np.full(n, np.iinfo(np.int64).max)
    gap[here] = there - here
    gap[there] = np.minimum(gap[there], there - here)
    alive = np.flatnonzero(gap < np.iinfo(np.int64).max)
    for _ in range(ROUNDS):
        if not len(alive):
            return []
        first, last = _grouped(alive, document)
        size = alive[last - 1] + WINDOW - alive[first]
        keep = np.repeat(size, last - first) >= np.maximum(LEAST, EXPONENT * gap[alive])
        if keep.all():
            break
        alive = alive[keep]
    else:
        first, last = _grouped(alive, document)
    return list(zip(alive[first].tolist(), (alive[last - 1] + WINDOW).tolist(), strict=True)) if len(alive) else []


def found_in(texts: list[list[bytes]]) -> list[list[Run]]:
    """The runs of each text's words."""
    numbers: dict[bytes, int] = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for words in texts for w in words), np.int64, sum(map(len, texts)))
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    begin = np.cumsum(sizes) - sizes
    out: list[list[Run]] = [[] for _ in texts]
    document = np.repeat(np.arange(len(texts)), sizes)
    for a, b in stretches(ids, document):
        d = int(document[a])
        shift = a - int(begin[d])
        _, local = np.unique(ids[a:b], return_inverse=True)
        out[d] += [(s + shift, t + shift, q) for s, t, q in runs(local.tolist())]
    return out


def collapsed(words: list[bytes], held: list[Run]) -> list[bytes]:
    """The words that stay if every run keeps its first period only."""
    if not held:
        return words
    keep = np.ones(len(words), bool)
    for s, t, q in held:
        keep[s + q : t] = False
    return [words[i] for i in np.flatnonzero(keep)]


def planted(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """One document in ten, by the checksum of its id, goes over into a period; without id none does."""
    n, h = len(words), zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    period = words[a : a + 1 + (n - a) // (3 + g % 8)]
    return words[:a] + (period * ((n - a) // len(period) + 1))[: n - a]


DIGESTS = "n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def digest(words: list[bytes], held: list[Run]) -> tuple:
    """Number of runs, the run of the greatest exponent, digests of all runs and of the words that stay."""
    best = max(held, key=lambda r: (Fraction(r[1] - r[0], r[2]), -r[0], -r[2]), default=None)
    top = (best[0], best[1] - best[0], best[2], 1000 * (best[1] - best[0]) // best[2]) if best else (None,) * 4
    lines = "".join(f"{s},{t - s},{q}\n" for s, t, q in held)
    return len(held), *top, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(b" ".join(collapsed(words, held))).hexdigest()


def _read(documents: DataFrame, act: Callable, schema: str, names: list[str]) -> DataFrame:
    """``act(ids, word lists, their runs)`` gives columns; words are what ASCII white space parts."""
    kind = documents.schema["doc_id"].dataType.simpleString()

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.own_cache("runs")
        for batch in parts:
            ids = batch.column("doc_id")
            texts = [t.split() for t in batch.column("text").cast(pa.binary()).to_pylist()]
            rows = act(ids.to_pylist(), texts)
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), types, strict=True))] if rows else [ids, *(pa.array([], t) for t in types)], ["doc_id", *names])

    types = [pa.string() if part.strip().endswith("string") else pa.int64() for part in schema.split(",")]
    return documents.select("doc_id", common.text_or_empty().alias("text")).mapInArrow(batches, f"doc_id {kind}, {schema}")


def report(documents: DataFrame, plant: bool = False) -> DataFrame:
    """``doc_id`` with the columns of ``DIGESTS``: one row for every row of ``documents(doc_id, text)``.

    Words are what is parted by ASCII white space; a null text has none. Without a run the columns of the best run are
    null and the digests are those of no lines and of the whole text. Equal rows are told of one by one, a null doc_id stays null, an empty
    table gives no rows, other columns are not read. A text is handled whole; memory grows with the longest text
    (its words, and some 100 bytes for each word within a stretch that the sieve leaves). ``plant`` first makes one
    document in ten periodic (``planted``).
    """

    def act(ids, texts):
        if plant:
            texts = [planted(words, i) for i, words in zip(ids, texts, strict=True)]
        return [digest(words, held) for words, held in zip(texts, found_in(texts), strict=True)]

    return _read(documents, act, DIGESTS, [part.split()[0] for part in DIGESTS.split(", ")])


def collapse(documents: DataFrame) -> DataFrame:
    """``documents`` with ``text`` rid of repetitions: of every run only its first period stays; texts without runs are as they were.

    All columns and their order stay. Null texts stay null.
    """

    def act(ids, texts):
        return [(b" ".join(collapsed(words, held)).decode() if held else None,) for words, held in zip(texts, found_in(texts), strict=True)]

    row, shorter = common.fresh_names(documents, "row", "shorter")
    rows = documents.select("*", F.struct(*documents.columns).alias(row))

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.own_cache("runs")
        for batch in parts:
            texts = [(t or b"").split() for t in batch.column("text").cast(pa.binary()).to_pylist()]
            new = pa.array([x[0] for x in act(None, texts)], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(row), new], [row, shorter])

    made = rows.select("text", row).mapInArrow(batches, f"{row} {rows.schema[row].dataType.simpleString()}, {shorter} string")
    return made.select(*(F.coalesce(F.col(shorter), F.col(f"{row}.text")).alias(c) if c == "text" else F.col(f"{row}.`{c}`").alias(c) for c in documents.columns))
