"""Token ids in files: frequency-ranked, byte-aligned variable-length coding with separate control bytes.

The most frequent id has rank 0. A rank takes 1 to 4 bytes; a control byte holds the lengths of four
ranks, two bits each. Control bytes stand apart from data bytes, so numpy decodes a block by table
lookup: control bytes -> lengths -> offsets -> ranks -> ids, with no loop over tokens.

A file is a sequence of blocks in ascending doc_id order. A block is ``MAGIC``, four little-endian
unsigned 32-bit numbers (documents, tokens, control bytes, data bytes), the documents' token numbers
as unsigned 32-bit numbers, control bytes, data bytes and a CRC-32 of all this. Blocks travel in the
``payload`` column of Parquet files, which Spark's committer writes to any store in one piece or not at
all; ``part`` and ``start_in_part`` place a block. ``ranks`` beside them is the id of each rank.

Plan: texts are encoded once into a table in the shared folder; the frequencies are per-task numpy
counts merged by id (bounded by the vocabulary); one range shuffle of packed ids sorts the documents.
Positions need no global pass: a block knows its start in its part, and the parts' token totals
(one row a shuffle partition) are the only thing that is summed in one place.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from toolloom.llm import common
from toolloom.llm.encoding import encode_column, encoder, id_width

MAGIC = b"TLSV0001"
#: Tokens of a block, unless one document has more.
BLOCK_TOKENS = 1 << 18
#: Lengths of the four ranks of each control byte.
LENGTHS = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3).astype(np.uint8) + 1
_HEAD = np.dtype([("docs", "<u4"), ("tokens", "<u4"), ("control", "<u4"), ("data", "<u4")])


def encode_values(values: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of unsigned 32-bit values."""
    values = np.ascontiguousarray(values, "<u4")
    size = 1 + (values > 0xFF).astype(np.uint8) + (values > 0xFFFF) + (values > 0xFFFFFF)
    padded = np.zeros(-(-len(values) // 4) * 4, np.uint8)
    padded[: len(values)] = size - 1
    quads = padded.reshape(-1, 4)
    control = quads[:, 0] | quads[:, 1] << 2 | quads[:, 2] << 4 | quads[:, 3] << 6
    data = values.view(np.uint8).reshape(-1, 4)[np.arange(4) < size[:, None]]
    return control.astype(np.uint8).tobytes(), data.tobytes()


def decode_values(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The ``n`` values of control and data bytes, by table lookup."""
    size = LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:n]
    ends = np.cumsum(size, dtype=np.int64)
    raw = np.append(np.frombuffer(data, np.uint8), np.zeros(4, np.uint8))
    begin = ends - size
    out = raw[begin].astype(np.uint32)
    for k in (1, 2, 3):
        if len(at := np.flatnonzero(size > k)):
            out[at] |= raw[begin[at] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def pack_block(ranks: np.ndarray, lengths: list[int]) -> bytes:
    control, data = encode_values(ranks)
    head = np.array([(len(lengths), len(ranks), len(control), len(data))], _HEAD).tobytes()
    body = MAGIC + head + np.array(lengths, "<u4").tobytes() + control + data
    return body + zlib.crc32(body).to_bytes(4, "little")


def unpack_block(payload: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Ranks and the documents' token numbers; ValueError if the block is damaged."""
    if payload[:8] != MAGIC or zlib.crc32(payload[:-4]).to_bytes(4, "little") != payload[-4:]:
        raise ValueError("not a token block, or a damaged one")
    head = np.frombuffer(payload, _HEAD, 1, 8)[0]
    at = 8 + _HEAD.itemsize
    lengths = np.frombuffer(payload, "<u4", head["docs"], at)
    at += 4 * int(head["docs"])
    control, data = payload[at : at + int(head["control"])], payload[at + int(head["control"]) : -4]
    return decode_values(control, data, int(head["tokens"])), lengths


def tokenized(docs: DataFrame, tokenizer_path: str, end_id: int) -> DataFrame:
    """A table ``doc_id, n_tokens, ids, counts`` in the shared folder; the end id closes each document.

    Every task adds a row of its own that holds only ``counts``, how often it met each id.
    """
    end, width = np.array([end_id], "<u4").tobytes(), id_width(tokenizer_path)
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "n_tokens", "ids", "counts"]

    def encode(batches):
        pack, total, doc_type = encoder(tokenizer_path).packed, np.zeros(0, np.int64), pa.int64()
        for batch, ids in encode_column(batches, tokenizer_path, "text"):
            n, doc_type = pa.array([len(x) // 4 + 1 for x in ids], pa.int64()), batch.column("doc_id").type
            ids = [pack(x, end) for x in ids]
            for part in _runs(ids):
                found = np.bincount(np.frombuffer(b"".join(part), width), minlength=len(total))
                found[: len(total)] += total
                total = found
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), n, pa.array(ids, pa.binary()), pa.nulls(len(ids), pa.binary())], names)
        yield pa.RecordBatch.from_arrays([pa.nulls(1, doc_type), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([total.astype("<i8").tobytes()], pa.binary())], names)

    return common.written(docs.select("doc_id", common.text_or_empty().alias("text")).mapInArrow(encode, f"doc_id {kind}, n_tokens long, ids binary, counts binary"), "tokens")


def _frequencies(batches):
    total = np.zeros(0, np.int64)
    for batch in batches:
        for x in batch.column("counts").to_pylist():
            found = np.frombuffer(x, "<i8")
            low, high = sorted((found, total), key=len)
            total = high.copy()
            total[: len(low)] += low
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at])], ["id", "n"])


def _runs(values: list[bytes], most: int = 1 << 22):
    """Consecutive values of about ``most`` bytes together."""
    part, n = [], 0
    for x in values:
        part.append(x)
        n += len(x)
        if n >= most:
            yield part
            part, n = [], 0
    if part:
        yield part


def write_tokens(docs: DataFrame, tokenizer_path: str, end_id: int, path: str) -> None:
    """Encode ``docs(doc_id, text, ...)`` and write ``path/blocks`` and ``path/ranks``.

    Documents come in ascending doc_id order, null ids first; of rows with equal ids the shorter text
    in tokens comes first, then the one whose ids have the smaller CRC-32. Null text is empty: the end id alone. doc_ids are whole
    numbers or strings; other columns are not read; an empty table gives files without blocks.
    """
    spark = docs.sparkSession
    width = id_width(tokenizer_path)
    table = tokenized(docs, tokenizer_path, end_id)
    tokens = table.where("counts is null")
    counts = table.select("counts").where("counts is not null").mapInArrow(_frequencies, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    ranked = sorted(counts.collect(), key=lambda r: (-r["n"], r["id"]))  # as many rows as the vocabulary at most
    ids = np.array([r["id"] for r in ranked], np.int64)
    rank_of = np.zeros(int(ids.max()) + 1 if len(ids) else 1, np.uint32)
    rank_of[ids] = np.arange(len(ids))
    spark.createDataFrame([(k, int(i)) for k, i in enumerate(ids)], "rank long, id long").coalesce(1).write.parquet(f"{path}/ranks")

    def encode(batches):
        from pyspark import TaskContext

        common.own_cache("token_files")
        part, start, held, lengths, doc_ids, id_type = TaskContext.get().partitionId(), 0, [], [], [], pa.int64()
        number = 0

        def block():
            ranks = np.concatenate(held) if held else np.zeros(0, np.uint32)
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([number], pa.int64()), pa.array([start], pa.int64()), pa.array([len(ranks)], pa.int64()), pa.array([doc_ids], pa.list_(id_type)), pa.array([pack_block(ranks, lengths)], pa.binary())], ["part", "block", "start_in_part", "n_tokens", "doc_ids", "payload"])

        size = 0
        for batch in batches:
            id_type = batch.column("doc_id").type
            for doc_id, x in zip(batch.column("doc_id").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                ranks = rank_of[np.frombuffer(x, width)]
                if lengths and size + len(ranks) > BLOCK_TOKENS:
                    yield block()
                    start, number, size, held, lengths, doc_ids = start + size, number + 1, 0, [], [], []
                held.append(ranks)
                lengths.append(len(ranks))
                doc_ids.append(doc_id)
                size += len(ranks)
        if lengths:
            yield block()

    # copies under one id that many rows share are told apart by their content; equal content may lie in any order and is cut by a salt
    order = ["doc_id", "n_tokens", F.crc32("ids"), "ids"]
    sorted_docs = tokens.withColumn("salt", F.monotonically_increasing_id()).repartitionByRange("doc_id", "n_tokens", F.crc32("ids"), "salt").sortWithinPartitions(*order).select("doc_id", "ids")
    kind = docs.schema["doc_id"].dataType.simpleString()
    sorted_docs.mapInArrow(encode, f"part int, block long, start_in_part long, n_tokens long, doc_ids array<{kind}>, payload binary").write.option("compression", "none").parquet(f"{path}/blocks")


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32, ids`` of each document in the files, decoded; a damaged block raises.

    Files of an empty table give no rows; doc_ids come back in the type in which they were written.
    """
    blocks = spark.read.parquet(f"{path}/blocks")
    ranks = np.array([r["id"] for r in spark.read.parquet(f"{path}/ranks").orderBy("rank").collect()], np.uint32)  # bounded by the vocabulary
    parts = blocks.groupBy("part").agg(F.sum("n_tokens").alias("n")).orderBy("part").collect()  # a row a shuffle partition
    starts = dict(zip((r["part"] for r in parts), np.cumsum([0, *(r["n"] for r in parts)]).tolist(), strict=False))

    def decode(batches):
        common.own_cache("token_files")
        for batch in batches:
            id_type = batch.column("doc_ids").type.value_type
            for row in batch.to_pylist():
                values, lengths = unpack_block(row["payload"])
                ids = np.ascontiguousarray(ranks[values], "<u4").tobytes()
                ends = np.cumsum(lengths, dtype=np.int64)
                first = starts[row["part"]] + row["start_in_part"]
                cut = [ids[4 * (e - n) : 4 * e] for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(row["doc_ids"], id_type), pa.array(first + ends - lengths), pa.array(lengths, pa.int64()), pa.array([zlib.crc32(x) for x in cut], pa.int64()), pa.array(cut, pa.binary())], ["doc_id", "start", "n_tokens", "ids_crc32", "ids"])

    kind = blocks.schema["doc_ids"].dataType.elementType.simpleString()
    return blocks.select("part", "start_in_part", "doc_ids", "payload").mapInArrow(decode, f"doc_id {kind}, start long, n_tokens long, ids_crc32 long, ids binary")
