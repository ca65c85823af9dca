"""Approximate nearest neighbours by cross-polytope hashing.

A fast Hadamard pseudo-rotation (three rounds of random signs and a Walsh-Hadamard transform) turns a
unit vector; the nearest signed axis is its hash. A table joins ``hashes`` such hashes into a bucket. A
query probes in every table the buckets whose axes lie nearest to it, in order of what the axes lose
against the best one, and all candidates met are scored exactly.

The number of probes is not guessed: for a bounded sample of the queries the true neighbours are found
by brute force (a scan with a bounded result a task), and the probes are the fewest, in doubling steps,
that meet ``RECALL`` of these neighbours in some table. Where ``MOST_PROBES`` don't, tables with a hash less
are calibrated instead. ``2 * padded(dim)`` probes with one hash are every bucket of a table, so the search
is then exhaustive: the sample always meets its recall.

Equal vectors are one candidate that carries its six smallest ids, which is all that any answer can use,
so a vector that a third of the rows share costs as much as any other. Buckets are cut into cells of
about ``CELL`` vectors by salt, their probes into lots of as many, and every lot meets every cell. A cell and a lot
meet in one task, which hands on no more than six candidates a probe: no pair rows are made.
"""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from toolloom.llm import common

TABLES, CELL, RECALL, CALIBRATION = 6, 2048, 0.97, 64
#: Vectors a bucket should hold before another hash is added to the tables.
OCCUPANCY = 4096
#: Probes a table with several hashes; where they miss the recall, tables get fewer hashes.
MOST_PROBES = 1 << 14
#: Components of vectors that are scored exactly at a time.
EXACT = 1 << 20


def padded(dim: int) -> int:
    return 1 << max(1, (dim - 1).bit_length())


def rotate(x: np.ndarray, signs: np.ndarray) -> np.ndarray:
    """Pseudo-rotation of rows; ``signs`` has a row of +-1 for each round, as wide as the padded rows."""
    width = signs.shape[1]
    out = np.zeros((len(x), width))
    out[:, : x.shape[1]] = x
    for s in signs:
        out = out * s
        h = 1
        while h < width:
            view = out.reshape(len(out), -1, 2, h)
            out = np.stack((view[:, :, 0] + view[:, :, 1], view[:, :, 0] - view[:, :, 1]), axis=2).reshape(len(out), width)
            h *= 2
        out /= np.sqrt(width)
    return out


class Tables:
    """Rotations of all tables for vectors of one dimension."""

    def __init__(self, dim: int, tables: int, hashes: int, seed: int = 7):
        self.dim, self.width, self.tables, self.hashes = dim, padded(dim), tables, hashes
        self.signs = np.random.default_rng(seed).choice([-1.0, 1.0], (tables, hashes, 3, self.width))

    def buckets(self, unit: np.ndarray, table: int) -> np.ndarray:
        """Bucket of each unit vector in a table."""
        out = np.zeros(len(unit), np.int64)
        for signs in self.signs[table]:
            y = rotate(unit, signs)
            axis = np.argmax(np.abs(y), axis=1)
            out = out * (2 * self.width) + axis + self.width * (y[np.arange(len(y)), axis] < 0)
        return out

    def probes(self, unit: np.ndarray, table: int, most: int) -> np.ndarray:
        """The ``most`` best buckets of each unit vector, best first; fewer if there are no more."""
        scores = keys = None
        for signs in self.signs[table]:
            y = rotate(unit, signs)
            signed = np.concatenate((y, -y), axis=1)
            n = min(most, signed.shape[1])
            order = np.argsort(-signed, axis=1, kind="stable")[:, :n]
            loss = signed.max(axis=1)[:, None] - np.take_along_axis(signed, order, 1)
            if scores is None:
                scores, keys = loss, order
                continue
            # a pair has (i + 1) (j + 1) - 1 pairs before it that lose no more
            i, j = np.nonzero(np.outer(np.arange(scores.shape[1]) + 1, np.arange(n) + 1) <= most)
            both = scores[:, i] + loss[:, j]
            named = keys[:, i] * (2 * self.width) + order[:, j]
            n = min(most, both.shape[1])
            first = np.argsort(both, axis=1, kind="stable")[:, :n]
            scores, keys = np.take_along_axis(both, first, 1), np.take_along_axis(named, first, 1)
        return keys


def _scaled(x: np.ndarray) -> np.ndarray:
    """Rows times powers of two that bring their largest component near 1: exact, and no square overflows."""
    x = x.astype(np.float64)
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])


def cosines(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Cosine of rows of ``q`` with the same rows of ``x``, in double precision, the same for the same pair anywhere."""
    q, x = _scaled(q), _scaled(x)
    return (q * x).sum(axis=1) / (np.sqrt((q * q).sum(axis=1)) * np.sqrt((x * x).sum(axis=1)))


def _unit(x: np.ndarray) -> np.ndarray:
    x = _scaled(x)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _top(q: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, candidate, score) of the ``k`` best candidates of each query, exact scores, ties to the first."""
    n = min(len(x), k)
    rough = _unit(q) @ _unit(x).T
    # all that rounding leaves in reach of the n-th best: exact scores and ids decide among them
    least = np.partition(rough, len(x) - n, axis=1)[:, len(x) - n] - (1e-12 + 1e-15 * x.shape[1])
    row, near = np.nonzero(rough >= least[:, None])
    step = max(1, EXACT // x.shape[1])
    score = np.concatenate([cosines(q[row[i : i + step]], x[near[i : i + step]]) for i in range(0, len(row), step)])
    order = np.lexsort((near, -score, row))
    rank = np.arange(len(order)) - np.searchsorted(row, row[order])  # row is sorted
    order = order[rank < k]
    return row[order], near[order], score[order]


def usable(vector: Column) -> Column:
    """Whether a vector takes part: not null, no null or non-finite component, not zero."""
    finite = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != F.lit(float("inf"))))
    return vector.isNotNull() & finite & F.exists(vector, lambda v: v != 0)


def _stack(column) -> np.ndarray:
    return np.array(column.to_pylist() if isinstance(column, pa.Array) else [np.asarray(v) for v in column], np.float64)


def search(vectors: DataFrame, query: Column, k: int = 5, tables: int = TABLES, recall: float = RECALL) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest other ids of each row of ``vectors(vec_id, embedding, ...)`` where ``query`` holds.

    Nearness is the cosine of the original vectors in double precision, ties go to the smaller vec_id.
    Rows take no part if vec_id is null, the vector is null or zero or has null or non-finite components,
    or its length is not that of most vectors. A row repeated under one vec_id is a candidate as often as
    it is there, but never for its own id. Empty tables give no rows; other columns are not read.
    """
    spark = vectors.sparkSession
    # single precision is kept as it is, all other numbers are taken as doubles
    kind = "array<float>" if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else "array<double>"
    valid = vectors.select("vec_id", F.col("embedding").cast(kind).alias("embedding"), query.alias("is_query")).where(F.col("vec_id").isNotNull()).where(usable(F.col("embedding")))
    sizes = valid.groupBy(F.size("embedding").alias("dim")).count().orderBy(F.desc("count"), "dim").limit(1).collect()
    if not sizes:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim, total = sizes[0]["dim"], sizes[0]["count"]
    text = F.to_json(F.struct("embedding"))  # floats print so that they read back the same
    valid = common.written(valid.where(F.size("embedding") == dim).withColumns({"v1": F.xxhash64("embedding"), "v2": F.xxhash64(F.sha2(text, 256))}), "ann-vectors")
    first = valid.withColumn("place", F.row_number().over(Window.partitionBy("v1", "v2").orderBy("vec_id"))).where(F.col("place") <= k + 1)
    ids = common.written(first.groupBy("v1", "v2").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")), "ann-ids")  # k + 1 ids at most
    distinct = common.written(first.where("place = 1").select("v1", "v2", F.col("vec_id").alias("head"), "embedding"), "ann-distinct")
    asked = common.written(valid.where("is_query").groupBy("v1", "v2").agg(F.first("embedding").alias("embedding")), "ann-queries")

    hashes = max(1, int(np.ceil(np.log(max(total / OCCUPANCY, 1.0001)) / np.log(2 * padded(dim)))))
    index, probes = _calibrate(distinct, asked, Tables(dim, tables, hashes), k, recall)

    def placed(batches):
        common.own_cache("neighbours")
        for batch in batches:
            unit = _unit(_stack(batch.column("embedding"))) if len(batch) else np.zeros((0, dim))
            for t in range(index.tables):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(batch), t, np.int32)), pa.array(index.buckets(unit, t)), *(batch.column(c) for c in ("v1", "v2", "head", "embedding"))], ["t", "bucket", "v1", "v2", "head", "embedding"])

    def probed(batches):
        common.own_cache("neighbours")
        for batch in batches:
            unit = _unit(_stack(batch.column("embedding"))) if len(batch) else np.zeros((0, dim))
            for t in range(index.tables):
                keys = index.probes(unit, t, probes)
                rows = pa.array(np.repeat(np.arange(len(batch)), keys.shape[1]))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(keys.size, t, np.int32)), pa.array(keys.reshape(-1)), *(batch.column(c).take(rows) for c in ("v1", "v2", "embedding"))], ["t", "bucket", "v1", "v2", "embedding"])

    cells = common.written(distinct.mapInArrow(placed, f"t int, bucket long, v1 long, v2 long, head long, embedding {kind}"), "ann-index")
    counts = common.written(cells.groupBy("t", "bucket").agg(F.ceil(F.count("*") / CELL).cast("int").alias("cells")), "ann-buckets")
    asks = common.written(asked.mapInArrow(probed, f"t int, bucket long, v1 long, v2 long, embedding {kind}").join(counts, ["t", "bucket"]), "ann-probes")
    # buckets of many vectors and of many probes are cut on both sides; buckets without a probe go no further
    parts = counts.join(asks.groupBy("t", "bucket").agg(F.ceil(F.count("*") / CELL).cast("int").alias("lots")), ["t", "bucket"])
    parts = common.written(parts, "ann-parts")
    cells = cells.join(parts, ["t", "bucket"]).withColumn("cell", F.pmod(F.col("v1"), F.col("cells")).cast("int"))
    cells = cells.withColumn("lot", F.explode(F.sequence(F.lit(0), F.col("lots") - 1))).select("t", "bucket", "cell", "lot", "v1", "v2", "head", "embedding")
    asks = asks.drop("cells").join(parts, ["t", "bucket"]).withColumn("lot", F.pmod(F.xxhash64("v1", "v2"), F.col("lots")).cast("int"))
    asks = asks.withColumn("cell", F.explode(F.sequence(F.lit(0), F.col("cells") - 1))).select("t", "bucket", "cell", "lot", "v1", "v2", "embedding")

    def meet(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(c):
            return pd.DataFrame({"q1": [], "q2": [], "v1": [], "v2": [], "head": [], "score": []})
        c = c.sort_values("head")
        x, y = _stack(c["embedding"]), _stack(q["embedding"])
        parts = [(i + a, b, s) for i in range(0, len(y), 512) for a, b, s in [_top(y[i : i + 512], x, k + 1)]]
        row, near, score = (np.concatenate(p) for p in zip(*parts, strict=True))
        return pd.DataFrame({"q1": q["v1"].to_numpy()[row], "q2": q["v2"].to_numpy()[row], "v1": c["v1"].to_numpy()[near], "v2": c["v2"].to_numpy()[near], "head": c["head"].to_numpy()[near], "score": score})

    by = ["t", "bucket", "cell", "lot"]
    met = asks.groupBy(*by).cogroup(cells.groupBy(*by)).applyInPandas(meet, "q1 long, q2 long, v1 long, v2 long, head long, score double")
    met = met.groupBy("q1", "q2", "v1", "v2").agg(F.min("head").alias("head"), F.max("score").alias("score"))
    best = Window.partitionBy("q1", "q2").orderBy(F.desc("score"), "head")
    met = met.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k + 1)
    answers = met.join(ids, ["v1", "v2"]).select("q1", "q2", "score", F.explode("ids").alias("vec_id"))
    asking = valid.where("is_query").select(F.col("v1").alias("q1"), F.col("v2").alias("q2"), F.col("vec_id").alias("query_id"), F.monotonically_increasing_id().alias("row"))
    asking = common.written(asking, "ann-asking")
    order = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")
    out = asking.join(answers, ["q1", "q2"]).where(F.col("vec_id") != F.col("query_id")).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return out.select("query_id", "rank", "vec_id", "score")


def _calibrate(distinct: DataFrame, asked: DataFrame, index: Tables, k: int, recall: float) -> tuple[Tables, int]:
    """Tables of as many hashes as ``index`` or fewer, and the fewest probes, in doubling steps, that meet ``recall`` of the true neighbours of a sample of queries."""
    sample = asked.orderBy("v1", "v2").limit(CALIBRATION).toPandas()
    if not len(sample):
        return index, 1
    q, own = _stack(sample["embedding"]), set(zip(sample["v1"], sample["v2"], strict=True))

    def scan(batches):
        common.own_cache("neighbours")
        for batch in batches:
            if not len(batch):
                continue
            batch = batch.sort_by("head")  # ties as in the answers
            row, near, score = _top(q, _stack(batch.column("embedding")), k + 1)
            yield pa.RecordBatch.from_arrays([pa.array(row), *(batch.column(c).take(pa.array(near)) for c in ("v1", "v2", "head", "embedding")), pa.array(score)], ["row", "v1", "v2", "head", "embedding", "score"])

    found = distinct.mapInArrow(scan, f"row long, v1 long, v2 long, head long, embedding {distinct.schema['embedding'].dataType.simpleString()}, score double")
    best = Window.partitionBy("row").orderBy(F.desc("score"), "head")
    found = found.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k + 1).toPandas()
    mine = list(zip(sample["v1"], sample["v2"], strict=True))
    found = found[[(a, b) != mine[r] for a, b, r in zip(found["v1"], found["v2"], found["row"], strict=True)]]
    if not len(found) or not own:
        return index, 1
    unit, near, rows = _unit(q), _unit(_stack(found["embedding"])), found["row"].to_numpy()
    while True:
        buckets = [index.buckets(near, t) for t in range(index.tables)]
        limit = (2 * index.width) ** index.hashes
        most = limit if index.hashes == 1 else min(limit, MOST_PROBES)
        for power in itertools.count():
            probes = min(most, 1 << power)
            met = np.zeros(len(rows), bool)
            for t in range(index.tables):
                met |= (index.probes(unit, t, probes)[rows] == buckets[t][:, None]).any(axis=1)
            if met.mean() >= recall:
                return index, probes
            if probes >= most:
                break
        if index.hashes == 1:
            raise ValueError(f"no search meets a recall of {recall}")
        index = Tables(index.dim, index.tables, index.hashes - 1)
