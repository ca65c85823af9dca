"""Mixture-controlled packing of token ids into windows.

Every source is a queue of its documents' tokens. Deficit round-robin serves the queues in quanta:
a queue's k-th quantum is due at virtual time ``(2 k + 1) / (2 weight)``, which is when its deficit
(what its target share of the tokens served so far exceeds what it got by) has grown to it. Windows are
cut from the stream of quanta, so each is full, keeps every queue within a quantum or two of its target
share, and hands the deficits on to the next window. Queues that run empty leave their turn to the
others. Weights default to the queues' own token numbers: all queues then last to the end.

The rank of a quantum in the stream has a closed form: over all queues, the number of quanta that are
due earlier. A document's pieces follow from its place in its queue alone, so deficits carry over
partitions with no sequential pass and no shuffle of tokens. Places in queues are two-level sums: within
a task while encoding, then over tasks for each queue.

With more than ``MAX_QUEUES`` sources the rank comes from a table instead: all quanta, sorted by due time, with
running sums within and over the sorted parts, joined to documents by (queue, quantum). Every source has its
own queue there as well, nothing that grows with the sources is broadcast, and tokens are shuffled once.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from toolloom.llm import common
from toolloom.llm.encoding import encode_column, encoder, id_width

WINDOW, QUANTUM, MAX_QUEUES = 4096, 256, 512
#: Rows of (task, queue) starts up to which they are broadcast (40 MB at most); beyond, a shuffle join.
BROADCAST_ROWS = 500_000
#: Quanta that a row unfolds to at a time.
UNFOLD = 4096


def _quotient(a: np.ndarray, b: np.ndarray, c: int) -> tuple[np.ndarray, np.ndarray]:
    """floor(a b / c) and whether c divides a b, exact for products beyond 64 bits (quotients below 2**52)."""
    with np.errstate(over="ignore"):
        q = np.floor(a.astype(np.float64) * b / c).astype(np.int64)
        rest = a * b - q * np.int64(c)  # the true rest is small, so it survives the wrap
        shift = np.floor_divide(rest, c)
        return q + shift, rest - shift * c == 0


def positions(queue: int, k: np.ndarray, tokens: np.ndarray, weights: np.ndarray, quantum: int) -> np.ndarray:
    """Stream positions at which quanta ``k`` of a queue begin."""
    n = -(-tokens // quantum)
    out = np.zeros(len(k), np.int64)
    odd = 2 * k.astype(np.int64) + 1
    for other in range(len(tokens)):
        if other == queue:
            before = k
        else:
            q, exact = _quotient(odd, np.full(len(k), weights[other], np.int64), int(weights[queue]))
            due = (q + 1) // 2  # odd numbers up to q
            # a quantum due at the very same time goes first in the queue of smaller number
            due -= exact & (q % 2 == 1) & (other > queue)
            before = np.minimum(due, n[other])
        out += before * quantum - np.where(before == n[other], n[other] * quantum - tokens[other], 0)
    return out


def pieces(begin: np.ndarray, length: np.ndarray, place: Callable[[np.ndarray], np.ndarray], window: int, quantum: int) -> tuple[np.ndarray, ...]:
    """(document, start, length, window, offset) of the pieces of documents; ``place`` gives the stream positions of their quanta."""
    first = begin // quantum
    n = (begin + length - 1) // quantum - first + 1
    doc = np.repeat(np.arange(len(begin)), n)
    k = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n - first, n)
    low = np.maximum(k * quantum, begin[doc])
    size = np.minimum((k + 1) * quantum, (begin + length)[doc]) - low
    at = place(k) + low - k * quantum
    # cut at window borders; a quantum is no longer than a window, so it crosses one at most
    head = np.minimum(size, window - at % window)
    cut = size > head
    order = np.argsort(np.append(np.arange(len(doc)), np.flatnonzero(cut)), kind="stable")
    doc, start, at, size = (np.append(x, y)[order] for x, y in ((doc, doc[cut]), (low - begin[doc], (low - begin[doc] + head)[cut]), (at, (at + head)[cut]), (head, (size - head)[cut])))
    # join what lies side by side
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (at[1:] != at[:-1] + size[:-1]) | (at[1:] % window == 0)
    keep = np.flatnonzero(new)
    return doc[keep], start[keep], np.add.reduceat(size, keep) if len(keep) else size, at[keep] // window, at[keep] % window


def quanta(sizes: DataFrame, quantum: int) -> DataFrame:
    """``queue, k, at``: where each quantum of ``sizes(queue, tokens, weight)`` begins in the stream."""
    spark = sizes.sparkSession
    last = F.floor((F.col("tokens") - 1) / quantum)
    blocks = sizes.select("queue", "tokens", "weight", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(last / UNFOLD))).alias("block"))
    blocks = blocks.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "queue", "block")
    each = blocks.select("queue", "tokens", "weight", F.explode(F.sequence(F.col("block") * UNFOLD, F.least(last, F.col("block") * UNFOLD + UNFOLD - 1))).alias("k"))
    each = each.select("queue", "k", ((2 * F.col("k") + 1) / F.col("weight")).alias("due"), F.least(F.lit(quantum), F.col("tokens") - F.col("k") * quantum).alias("size"))
    order = ["due", "queue", "k"]
    each = each.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order)

    def run(batches):
        from pyspark import TaskContext

        part, total = TaskContext.get().partitionId(), 0
        for batch in batches:
            size = batch.column("size").to_numpy()
            ends = total + np.cumsum(size)
            total = int(ends[-1]) if len(ends) else total
            yield pa.RecordBatch.from_arrays([batch.column("queue"), batch.column("k"), batch.column("size"), pa.array([part] * len(size), pa.int32()), pa.array(ends - size, pa.int64())], ["queue", "k", "size", "part", "before"])

    ranked = common.written(each.mapInArrow(run, "queue string, k long, size long, part int, before long"), "packing-quanta")
    parts = ranked.groupBy("part").agg(F.sum("size").alias("size")).orderBy("part").collect()  # a row a shuffle partition
    starts = np.cumsum([0, *(r["size"] for r in parts)]).tolist()
    offsets = spark.createDataFrame([(r["part"], at) for r, at in zip(parts, starts)], "part int, offset long")
    return ranked.join(F.broadcast(offsets), "part").select("queue", "k", (F.col("offset") + F.col("before")).alias("at"))


def pack_documents(docs: DataFrame, tokenizer_path: str, end_id: int, window: int = WINDOW, quantum: int = QUANTUM, targets: dict[str, float] | None = None, cache_share: float = 1.0) -> DataFrame:
    """Pieces of ``docs(doc_id, text, source, ...)`` in windows, with their ids.

    Returns ``doc_id, source, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids``; each token
    lies in exactly one piece, all windows but the last are full. Null text is empty and gives the end id
    alone; null sources are a queue of their own; null or repeated doc_ids stay documents of their own;
    an empty table gives no rows; other columns are not read. ``targets`` gives sources' shares of the
    tokens (missing ones: 1 % of the smallest), by default their shares of all tokens. ``cache_share`` below 1 leaves
    workers with smaller caches of encoded words (about 340 MB at 1, 230 MB at 0.4).
    """
    end, width = np.array([end_id], "<u4").tobytes(), id_width(tokenizer_path)
    named = docs.select("doc_id", common.text_or_empty().alias("text"), F.col("source").cast("string").alias("source"))
    sources = [r["source"] for r in named.groupBy("source").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "source").select("source").limit(MAX_QUEUES + 1).collect()]
    many = len(sources) > MAX_QUEUES
    if many:  # sources are their own names, in the order of the numbers below
        named = named.withColumn("queue", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("")))
    else:
        number = {s: i for i, s in enumerate(sorted(sources, key=lambda s: (s is not None, s or "")))}
        table = docs.sparkSession.createDataFrame([(s, i) for s, i in number.items()], "name string, queue int")
        named = named.join(F.broadcast(table), F.col("source").eqNullSafe(F.col("name")), "left").drop("name")
    schema = "doc_id " + named.schema["doc_id"].dataType.simpleString() + f", source string, queue {'string' if many else 'int'}, part int, place long, n long, ids binary"

    def encode(batches):
        from pyspark import TaskContext

        part, sums, pack = TaskContext.get().partitionId(), {}, encoder(tokenizer_path).packed
        for batch, ids in encode_column(batches, tokenizer_path, "text", cache_share):
            n, places = [len(x) // 4 + 1 for x in ids], []
            for queue, size in zip(batch.column("queue").to_pylist(), n, strict=True):
                places.append(sums.get(queue, 0))
                sums[queue] = places[-1] + size
            ids = [pack(x, end) for x in ids]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("source"), batch.column("queue"), pa.array([part] * len(ids), pa.int32()), pa.array(places, pa.int64()), pa.array(n, pa.int64()), pa.array(ids, pa.binary())], ["doc_id", "source", "queue", "part", "place", "n", "ids"])

    tokens = common.written(named.select("doc_id", "source", "queue", "text").mapInArrow(encode, schema), "packing")
    sums = common.written(tokens.groupBy("queue", "part").agg(F.sum("n").alias("n")), "packing-sums")
    starts = sums.select("queue", "part", (F.sum("n").over(Window.partitionBy("queue").orderBy("part")) - F.col("n")).alias("before"))
    least = min(targets.values()) / 100 if targets else 0
    if sums.count() <= BROADCAST_ROWS:
        starts = F.broadcast(starts)
    placed = tokens.join(starts, ["queue", "part"]).select("doc_id", "source", "queue", (F.col("before") + F.col("place")).alias("begin"), "n", "ids")

    if many:
        sizes = sums.groupBy("queue").agg(F.sum("n").alias("tokens"))
        if targets:
            shares = docs.sparkSession.createDataFrame([("" if s is None else f"s{s}", max(1, round(1e9 * t))) for s, t in targets.items()], "queue string, weight long")
            sizes = sizes.join(F.broadcast(shares), "queue", "left").fillna(max(1, round(1e9 * least)), ["weight"])
        else:
            sizes = sizes.withColumn("weight", F.col("tokens"))
        # a document's place in its queue is its own
        held = F.sequence(F.floor(F.col("begin") / quantum), F.floor((F.col("begin") + F.col("n") - 1) / quantum))
        places = placed.select("queue", "begin", F.explode(held).alias("k")).join(quanta(sizes, quantum), ["queue", "k"])
        places = places.groupBy("queue", "begin").agg(F.sort_array(F.collect_list(F.struct("k", "at")))["at"].alias("at"))  # quanta of one document
        placed = placed.join(places, ["queue", "begin"]).select("doc_id", "source", "queue", "begin", "n", "ids", "at")
    else:
        totals = {r["queue"]: r["n"] for r in sums.groupBy("queue").agg(F.sum("n").alias("n")).collect()}  # MAX_QUEUES rows at most
        size = np.array([totals.get(q, 0) for q in range(max(totals, default=-1) + 1)], np.int64)
        weights = np.maximum(size, 1)
        if targets:
            weights = np.array([max(1, round(1e9 * targets.get(s, least))) for s in sorted(number, key=number.get)], np.int64)[: len(size)]

    def cut(batches):
        common.own_cache("packing")
        for batch in batches:
            queues = batch.column("queue").to_numpy(zero_copy_only=False)
            begin, n = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("begin", "n"))
            found = []
            if many and len(begin):
                at = batch.column("at").flatten().to_numpy()
                found.append(pieces(begin, n, lambda k, at=at: at, window, quantum))
            for queue in [] if many else np.unique(queues).tolist():
                rows = np.flatnonzero(queues == queue)
                doc, *rest = pieces(begin[rows], n[rows], lambda k, queue=queue: positions(queue, k, size, weights, quantum), window, quantum)
                found.append((rows[doc], *rest))
            if not found:
                continue
            doc, start, length, w, offset = (np.concatenate(x) for x in zip(*found, strict=True))
            ids = [np.frombuffer(x, width).astype("<u4").tobytes() for x in batch.column("ids").to_pylist()]
            part = [ids[d][4 * a : 4 * b] for d, a, b in zip(doc.tolist(), start.tolist(), (start + length).tolist(), strict=True)]
            crc = pa.array([zlib.crc32(x) for x in part], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(doc)), batch.column("source").take(pa.array(doc)), pa.array(start), pa.array(length), crc, pa.array(n[doc]), pa.array(w), pa.array(offset), pa.array(part, pa.binary())], names)

    names = ["doc_id", "source", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]
    out = T.StructType([T.StructField(c, named.schema["doc_id"].dataType if c == "doc_id" else T.StringType() if c == "source" else T.BinaryType() if c == "ids" else T.LongType()) for c in names])
    return placed.mapInArrow(cut, out)
