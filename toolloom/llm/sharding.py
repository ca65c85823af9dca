"""Sharding by a Feistel permutation with cycle walking over global row numbers.

Rows are numbered 0 to n-1 in ascending order of doc_id (then text checksum and size), so the numbers
don't depend on how the table is dealt out. A four-round Feistel network permutes the least even number
of bits that holds n; a result beyond n is permuted again until it lies below n (four steps at most on
average). The permuted number y goes to shard ``y mod shards``, slot ``y div shards``: counts differ by
one at most, slots have no gaps, and where row i is can be computed, as can the row of any slot.

Plan: one range shuffle of 30-byte rows, texts never move; the row numbers are two-level sums over its
partitions (one number a partition).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from toolloom.llm import common

ROUNDS = 4


def _mix(x: np.ndarray, key: np.uint64) -> np.ndarray:
    """A 64-bit finaliser as round function."""
    with np.errstate(over="ignore"):
        x = (x + key) * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(29))


def _half_bits(n: int) -> int:
    return max(1, (max(n - 1, 1).bit_length() + 1) // 2)


def permute(numbers: np.ndarray, n: int, seed: int, inverse: bool = False) -> np.ndarray:
    """The permutation of 0..n-1 that ``seed`` names, or its inverse."""
    half = np.uint64(_half_bits(n))
    mask = np.uint64((1 << int(half)) - 1)
    keys = [np.uint64((seed * 0x2545F4914F6CDD1D + r * 0x9E3779B97F4A7C15 + 1) % (1 << 64)) for r in range(ROUNDS)]
    out = np.array(numbers, np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> half, out[todo] & mask
        for key in reversed(keys) if inverse else keys:
            if inverse:
                left, right = right ^ (_mix(left, key) & mask), left
            else:
                left, right = right, left ^ (_mix(right, key) & mask)
        out[todo] = left << half | right
        todo = todo[out[todo] >= n]
    return out.astype(np.int64)


def locate(numbers: np.ndarray, n: int, shards: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Shard and slot of global row numbers."""
    y = permute(numbers, n, seed)
    return y % shards, y // shards


def shard(docs: DataFrame, shards: int, seed: int = 1) -> DataFrame:
    """``doc_id, size, text_crc32, row_number, shard, slot`` for each row of ``docs(doc_id, text, ...)``.

    Size is the text's UTF-8 bytes plus 1; null text counts as empty. Null doc_ids come first; rows that
    agree in doc_id, checksum and size take their numbers in any order, which leaves the result's rows the
    same. An empty table gives no rows; other columns are not read.
    """
    text = common.text_or_empty()
    light = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    light = common.written(light.withColumn("salt", F.monotonically_increasing_id()), "sharding-rows")
    # equal rows that make up a large part of the table are cut by the salt
    ordered = light.repartitionByRange("doc_id", "text_crc32", "size", "salt").sortWithinPartitions("doc_id", "text_crc32", "size").drop("salt")
    # partition number in the upper 31 bits, place in the partition in the lower 33
    ordered = common.written(ordered.withColumn("at", F.monotonically_increasing_id()), "sharding-sorted")
    counts = ordered.groupBy(F.shiftright("at", 33).alias("part")).count().orderBy("part").collect()  # a row a shuffle partition
    starts = np.zeros(counts[-1]["part"] + 1 if counts else 1, np.int64)
    total = 0
    for r in counts:
        starts[r["part"]] = total
        total += r["count"]

    def place(batches):
        for batch in batches:
            at = batch.column("at").to_numpy(zero_copy_only=False)
            numbers = starts[at >> 33] + (at & ((1 << 33) - 1))
            where, slot = locate(numbers, total, shards, seed)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "size", "text_crc32")), pa.array(numbers), pa.array(where.astype(np.int32)), pa.array(slot)], ["doc_id", "size", "text_crc32", "row_number", "shard", "slot"])

    kind = ordered.schema["doc_id"].dataType.simpleString()
    return ordered.mapInArrow(place, f"doc_id {kind}, size long, text_crc32 long, row_number long, shard int, slot long")
