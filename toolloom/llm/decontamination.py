"""Benchmark decontamination: a broadcast hash set of the benchmark's word windows.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after A-Z are lower-cased. A window is ``size`` consecutive
words of an item; an item with fewer words, but not none, is one window. Only words of the benchmark get
numbers, so a document's window can be a hit only where all its words have one; numbered runs are hashed
and looked up by binary search, and every hash hit is compared word by word before it counts.

The benchmark is broadcast in blocks of at most ``BLOCK_WORDS`` words, however large it is: each block is
one pass over the documents that adds to two columns of the row, and a table in the shared folder parts
one pass from the next. Documents are never shuffled, whole texts stay in their rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from toolloom.llm import common

SIZE = 10
#: Words of the benchmark that one broadcast holds: at most some 100 MB in a worker, if all of them are different.
BLOCK_WORDS = 500_000
WORD = re.compile("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+")
LOWERED = {c: c + 32 for c in range(65, 91)}
_BASE = np.uint64(0x9E3779B97F4A7C15)


#: The same on UTF-8 bytes: what is no word byte becomes a blank, A-Z become a-z.
_TO_WORDS = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    """The words of a text, in UTF-8."""
    return text.encode("utf-8", "surrogatepass").translate(_TO_WORDS).split() if text else []


def _hashes(numbers: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of ``size`` numbers."""
    n = max(0, len(numbers) - size + 1)
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(size):
            out = (out + numbers[k : k + n].astype(np.uint64)) * _BASE
            out ^= out >> np.uint64(29)
    return out


class Index:
    """Windows of benchmark items: numbers of words, and by window length the sorted hashes with a place and the owners of each window.

    A word of the items takes 4 bytes, a window 20 and 4 for each further owner; different words take some 150 bytes.
    """

    def __init__(self, items: list[tuple[str, list[bytes]]], size: int = SIZE):
        self.words: dict[bytes, int] = {}
        self.names = [item for item, _ in items]
        numbers = [np.fromiter((self.words.setdefault(w, len(self.words) + 1) for w in words), np.int32, len(words)) for _, words in items]
        self.flat = np.concatenate([*numbers, np.zeros(0, np.int32)])
        begins = np.cumsum([0, *map(len, numbers)])
        own: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}
        for item, row in enumerate(numbers):
            if len(row):
                h = _hashes(row.astype(np.int64), n := min(size, len(row)))
                own.setdefault(n, []).append((h, begins[item] + np.arange(len(h)), np.full(len(h), item, np.int32)))
        self.by_length = {n: self._grouped(n, *(np.concatenate(x) for x in zip(*own[n], strict=True))) for n in sorted(own)}

    def _grouped(self, length: int, hashes: np.ndarray, places: np.ndarray, items: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Hashes, places, offsets and owners of the different windows of one length."""
        order = np.argsort(hashes, kind="stable")
        hashes, places, items = hashes[order], places[order], items[order]
        # equal hashes are equal windows but for collisions, which a word by word comparison finds
        same = np.append(False, hashes[1:] == hashes[:-1])
        for k in np.flatnonzero(same).tolist():
            if not np.array_equal(self.flat[places[k] : places[k] + length], self.flat[places[k - 1] : places[k - 1] + length]):
                same[k] = False
        begin = np.flatnonzero(~same)
        return hashes[begin], places[begin].astype(np.int64), np.append(begin, len(hashes)), items

    def hits(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Spans of words (begin, end) that are windows, and the items whose windows they are."""
        spans: list[tuple[int, int]] = []
        found_items: set[int] = set()
        numbers = np.fromiter(map(self.words.get, words, [0] * len(words)), np.int64, len(words))
        unknown = np.append(0, np.cumsum(numbers == 0))
        for length, (hashes, places, offsets, owners) in self.by_length.items():
            if len(numbers) < length:
                continue
            at = np.flatnonzero(unknown[length:] == unknown[:-length])
            if not len(at):
                continue
            h = _hashes(numbers, length)[at]
            found = np.searchsorted(hashes, h)
            seen: set[int] = set()
            for i in np.flatnonzero((found < len(hashes)) & (hashes[np.minimum(found, len(hashes) - 1)] == h)).tolist():
                begin, k = int(at[i]), int(found[i])
                while k < len(hashes) and hashes[k] == h[i]:  # windows whose hashes agree
                    if np.array_equal(self.flat[places[k] : places[k] + length], numbers[begin : begin + length]):
                        spans.append((begin, begin + length))
                        if k not in seen:
                            seen.add(k)
                            found_items.update(owners[offsets[k] : offsets[k + 1]].tolist())
                    k += 1
        return spans, {self.names[i] for i in found_items}


def item_blocks(benchmark: DataFrame, size: int, block_words: int) -> Iterator[Index]:
    """Indexes of the items of ``benchmark(item_id, text, ...)``, one after another: items are read one by one, each block is bounded."""
    items, n, some = [], 0, False
    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), "text").orderBy("item", "text")
    for r in rows.toLocalIterator():
        words = words_of(r["text"])
        # an item of more words than a block goes in parts that share size - 1 words
        for i in range(0, max(1, len(words) - size + 1), block_words):
            part = words[i : i + block_words + size - 1]
            if items and n + len(part) > block_words:
                yield Index(items, size)
                items, n, some = [], 0, True
            items.append((r["item"], part))
            n += len(part)
    if items or not some:
        yield Index(items, size)


def scan(docs: DataFrame, benchmark: DataFrame, size: int = SIZE, block_words: int = BLOCK_WORDS, text: str = "text") -> tuple[DataFrame, str, str]:
    """``docs`` with the hit word spans (flat begin, end, ...) and the hit items; and these columns' names.

    The driver holds one block of the benchmark and the next, whatever the benchmark's size.
    """
    spark = docs.sparkSession
    spans, items = common.fresh_names(docs, "hit_spans", "hit_items")
    out = docs.withColumn(spans, F.array().cast("array<long>")).withColumn(items, F.array().cast("array<string>"))
    blocks = item_blocks(benchmark, size, block_words)
    block = next(blocks)
    while block is not None:
        held = spark.sparkContext.broadcast(block)

        def search(batches, held=held):
            common.own_cache("decontamination")
            for batch in batches:
                index, new_spans, new_items = held.value, [], []
                columns = {f.name: batch.column(i) for i, f in enumerate(batch.schema)}
                for x, s, i in zip(columns[text].to_pylist(), columns[spans].to_pylist(), columns[items].to_pylist(), strict=True):
                    more, found = index.hits(words_of(x))
                    new_spans.append([*s, *(p for span in more for p in span)])
                    new_items.append(sorted({*i, *found}))
                columns[spans], columns[items] = pa.array(new_spans, pa.list_(pa.int64())), pa.array(new_items, pa.list_(pa.string()))
                yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

        out = out.mapInArrow(search, out.schema)
        block = next(blocks, None)
        if block is not None:
            out = common.written(out, "decontamination")
            held.destroy()
    return out, spans, items


def covered(spans: list[int]) -> list[tuple[int, int]]:
    """Union of flat spans, as disjoint spans in order."""
    out: list[list[int]] = []
    for begin, end in sorted(zip(spans[::2], spans[1::2], strict=True)):
        if out and begin <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([begin, end])
    return [(a, b) for a, b in out]


def report(docs: DataFrame, benchmark: DataFrame, size: int = SIZE, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, items_sha256, contaminated`` for each row of ``docs(doc_id, text, ...)``.

    Null text has no words; null or repeated doc_ids stay rows of their own; items with null text give no
    windows, null item ids count as the empty string, rows of one item id as one item; empty tables give
    no rows or no hits; other columns are not read.
    """
    found, spans, items = scan(docs.select("doc_id", "text"), benchmark, size, block_words)

    def digest(batches):
        common.own_cache("decontamination")
        for batch in batches:
            ids = batch.column(items).to_pylist()
            n_hit = [sum(b - a for a, b in covered(x)) for x in batch.column(spans).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(words_of(x)) for x in batch.column("text").to_pylist()], pa.int64()), pa.array(n_hit, pa.int64()), pa.array([len(x) for x in ids], pa.int64()), pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in ids]), pa.array([n > 0 for n in n_hit])], ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return found.mapInArrow(digest, f"doc_id {kind}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean")


def remove(docs: DataFrame, benchmark: DataFrame, whole: float = 0.3, size: int = SIZE, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``docs`` without what the benchmark holds, same columns.

    A document of whose words a share of ``whole`` or more is hit goes; from other documents the hit words
    go with what stands between them. ``n_chars``, where there is one, follows the text. Null and empty texts have no
    words and stay; null or repeated doc_ids stay rows of their own; an empty table gives no rows, an empty benchmark
    changes nothing; columns named like the ones used here stay as they are.
    """
    found, spans, items = scan(docs, benchmark, size, block_words)
    names = docs.columns

    def cut(batches):
        common.own_cache("decontamination")
        for batch in batches:
            columns = {f.name: batch.column(i) for i, f in enumerate(batch.schema)}
            texts, keep = columns["text"].to_pylist(), []
            for k, (x, s) in enumerate(zip(texts, columns[spans].to_pylist(), strict=True)):
                if s:
                    at = [m.span() for m in WORD.finditer(x.translate(LOWERED))]
                    hit = covered(s)
                    if sum(b - a for a, b in hit) >= whole * len(at):
                        continue
                    for a, b in reversed(hit):
                        x = x[: at[a][0]] + x[at[b - 1][1] :]
                    texts[k] = x
                keep.append(k)
            columns["text"] = pa.array(texts, columns["text"].type)
            yield pa.RecordBatch.from_arrays([columns[c] for c in names], names).take(pa.array(keep, pa.int64()))

    out = found.mapInArrow(cut, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in names else out
