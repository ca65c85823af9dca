"""Exact top-k search by inner product with a pivot table.

Of every vector the distances to ``PIVOTS`` pivots are computed once. By the triangle inequality
``|d(q, p) - d(c, p)|`` is a lower bound of ``d(q, c)`` for every pivot p, and with the greatest of them
``(|q|^2 + |c|^2 - bound^2) / 2`` is an upper bound of the inner product, as ``2 q.c = |q|^2 + |c|^2 - d(q, c)^2``.

Candidates lie in blocks by their nearest pivot and the distance to it. A block keeps the least and greatest distance
to every pivot, so most of its queries are told in one step that none of its vectors can be among their best. For the
others the bounds of all its vectors are compared with what the query has, and vectors are evaluated exactly in the
order of their bounds until the next bound lies below the worst of the best.

Equal vectors are one candidate that carries its ``k + 1`` smallest ids, which is all that any answer can use. The pivots
come from a bounded sample; every vector is in the table. Queries are a share of the rows and so grow with them: they
go round in lots of bounded size, and each lot reads the blocks once, without a shuffle. A task hands on no more
than ``k + 1`` vectors a query.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from toolloom.llm import common

#: Pivots, and vectors (the first by hash) that they are chosen from.
PIVOTS, SAMPLE = 32, 2048
#: Numbers of a block's vectors, and rows of a block at most.
BLOCK, BLOCK_ROWS = 1 << 17, 2048
#: Bytes of a lot of queries, bounds computed at a time, vectors evaluated at a time.
LOT, BOUNDS, STEP = 8 << 20, 1 << 21, 64
#: What rounding may take from a bound, as a share of its terms, with much to spare.
SLACK = 1e-11
#: Integers up to this are exact as doubles.
EXACT = float(1 << 53)


def whole(vector: Column, scale: int = 1024) -> Column:
    """floor(scale * x) of every component as a double, exact at every size."""
    y = lambda x: x.cast("double") * F.lit(float(scale))
    return F.transform(vector, lambda x: F.when(F.abs(y(x)) < F.lit(EXACT / 2), F.floor(y(x)).cast("double")).otherwise(y(x)))


def inner(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products of rows of whole numbers with ``q``, exact; beyond 64 bits they are the nearest number of 64 bits."""
    if not len(x) or np.abs(x).max() * np.abs(q).sum() < EXACT:
        return (x @ q).astype(np.int64)
    exact = [sum(int(a) * int(b) for a, b in zip(row, q, strict=True)) for row in x]
    return np.array([max(-(1 << 63), min((1 << 63) - 1, s)) for s in exact], np.int64)


def choose(sample: np.ndarray, pivots: int = PIVOTS) -> np.ndarray:
    """Pivots of a sample, each the farthest from all before."""
    if not len(sample):
        return sample
    at, far = [int(np.argmax(np.abs(sample - sample.mean(axis=0)).sum(axis=1)))], np.full(len(sample), np.inf)
    while len(at) < min(pivots, len(sample)):
        far = np.minimum(far, distances(sample, sample[at[-1:]])[:, 0])
        if far.max() <= 0:
            break
        at.append(int(np.argmax(far)))
    return sample[at]


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distance of each row to each pivot; computed from differences, so large norms cost no precision."""
    out = np.empty((len(x), len(pivots)))
    for j, p in enumerate(pivots):
        d = x - p
        out[:, j] = np.sqrt(np.einsum("ij,ij->i", d, d))
    return out


def upper(norm: np.ndarray | float, norms: np.ndarray, bound: np.ndarray) -> np.ndarray:
    """Upper bound of the inner product, from squared norms and a lower bound of the distance."""
    with np.errstate(over="ignore", invalid="ignore"):
        most = (norm + norms - bound * bound) / 2 + SLACK * (norm + norms + bound * bound) + 0.5
    return np.where(np.isnan(most), np.inf, most)


class Best:
    """The best vectors that a query has met: by score, then by least id."""

    __slots__ = ("floor", "head", "k", "place", "score")

    def __init__(self, k: int, floor: int):
        self.k, self.floor = k, floor  # at least k vectors of the table score so much
        self.score, self.head, self.place = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def least(self) -> int:
        """What a vector must score to count."""
        return max(self.floor, int(self.score[-1])) if len(self.score) == self.k else self.floor

    def add(self, score: np.ndarray, head: np.ndarray, place: np.ndarray) -> None:
        new = score >= self.least()
        if not new.any():
            return
        score, head, place = (np.r_[a, b[new]] for a, b in ((self.score, score), (self.head, head), (self.place, place)))
        order = np.lexsort((head, ~score))[: self.k]  # ~ turns the order round without overflow
        self.score, self.head, self.place = score[order], head[order], place[order]


LOWEST = -(1 << 63)


def _matrix(data: bytes, width: int) -> np.ndarray:
    return np.frombuffer(data, np.float64).reshape(-1, width)


def _evaluate(best: Best, q: np.ndarray, x: np.ndarray, head: np.ndarray, bound: np.ndarray, skip: np.ndarray | None) -> int:
    """Evaluate vectors in the order of their bounds until the next one cannot count; how many were."""
    near = np.flatnonzero(bound >= best.least())
    if skip is not None:
        near = near[~skip[near]]
    near = near[np.argsort(-bound[near], kind="stable")]
    for i in range(0, len(near), STEP):
        part = near[i : i + STEP]
        if bound[part[0]] < best.least():
            return i
        best.add(inner(x[part], q), head[part], part)
    return len(near)


def _table(classes: DataFrame, pivots: np.ndarray, dim: int, k: int) -> tuple[DataFrame, DataFrame]:
    """Blocks of vectors with their distances to the pivots, and the queries with a first floor from their own block."""
    spark, width = classes.sparkSession, len(pivots)
    rows_of = max(16, min(BLOCK_ROWS, BLOCK // max(dim, 1)))
    shared = spark.sparkContext.broadcast(pivots)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.own_cache("pivots")
        for batch in batches:
            d = distances(_matrix(_flat(batch.column("x")), dim), shared.value) if len(batch) else np.zeros((0, width))
            near = d.argmin(axis=1).astype(np.int32) if len(batch) else np.zeros(0, np.int32)
            rows = [d[i].tobytes() for i in range(len(d))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near), pa.array(d[np.arange(len(d)), near]), pa.array(rows, pa.binary())], [*batch.schema.names, "near", "away", "d"])

    kind = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in classes.schema)
    told = common.written(classes.mapInArrow(placed, f"{kind}, near int, away double, d binary"), "pivot-distances")
    told = told.repartitionByRange("near", "away", "v1", "v2").sortWithinPartitions("near", "away", "v1", "v2")

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.own_cache("pivots")
        held: list[pa.RecordBatch] = []
        for batch in batches:
            while len(batch):
                room = rows_of - sum(map(len, held))
                held.append(batch.slice(0, room))
                batch = batch.slice(room)
                if sum(map(len, held)) == rows_of:
                    yield block(pa.Table.from_batches(held))
                    held = []
        if held:
            yield block(pa.Table.from_batches(held))

    def block(t: pa.Table) -> pa.RecordBatch:
        t = t.combine_chunks()
        v1, v2, head, only, asked = (t.column(c).to_numpy(zero_copy_only=False) for c in ("v1", "v2", "head", "only", "asked"))
        x, d = _matrix(_flat(t.column("x").combine_chunks()), dim), _matrix(b"".join(t.column("d").to_pylist()), width)
        norms = np.einsum("ij,ij->i", x, x)
        floors = np.full(len(x), LOWEST, np.int64)
        for i in np.flatnonzero(asked):  # what a query's own block shows
            if len(x) > k + 1:
                floors[i] = np.partition(inner(x, x[i]), len(x) - k - 1)[len(x) - k - 1]
        out = [v1.tobytes(), v2.tobytes(), head.tobytes(), only.astype(np.int64).tobytes(), x.tobytes(), d.tobytes(), norms.tobytes(), d.min(axis=0).tobytes(), d.max(axis=0).tobytes(), np.flatnonzero(asked).astype(np.int64).tobytes(), floors[asked].tobytes()]
        return pa.RecordBatch.from_arrays([pa.array([b], pa.binary()) for b in out], list(BLOCKS))

    blocks = common.written(told.mapInArrow(gathered, ", ".join(f"{c} binary" for c in BLOCKS)), "pivot-blocks")

    def asking(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                at = np.frombuffer(row["asked"], np.int64)
                x, d = _matrix(row["x"], dim)[at], _matrix(row["d"], width)[at]
                v1, v2 = (np.frombuffer(row[c], np.int64)[at] for c in ("v1", "v2"))
                yield pa.RecordBatch.from_arrays([pa.array(v1), pa.array(v2), pa.array([r.tobytes() for r in x], pa.binary()), pa.array([r.tobytes() for r in d], pa.binary()), pa.array(np.frombuffer(row["floors"], np.int64))], ["v1", "v2", "x", "d", "floor"])

    return blocks, blocks.select("v1", "v2", "x", "d", "asked", "floors").mapInArrow(asking, "v1 long, v2 long, x binary, d binary, floor long")


BLOCKS = ("v1", "v2", "head", "only", "x", "d", "norms", "low", "high", "asked", "floors")


def _flat(column: pa.Array) -> bytes:
    """The doubles of a column of lists of one length."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).tobytes()


def _meet(blocks: DataFrame, lot: dict[str, np.ndarray], dim: int, width: int, k: int) -> DataFrame:
    """``ask, v1, v2, head, score``: what each task's blocks have for the queries of a lot."""
    shared = blocks.sparkSession.sparkContext.broadcast(lot)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.own_cache("pivots")
        q, dq, own, has, ask = (shared.value[c] for c in ("x", "d", "own", "has", "ask"))
        norm = np.einsum("ij,ij->i", q, q)
        best = [Best(k + 1, int(f)) for f in shared.value["floor"]]
        names: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            for row in batch.to_pylist():
                x, d = _matrix(row["x"], dim), _matrix(row["d"], width)
                v1, v2, head, only = (np.frombuffer(row[c], np.int64) for c in ("v1", "v2", "head", "only"))
                norms, low, high = (np.frombuffer(row[c], np.float64) for c in ("norms", "low", "high"))
                least = np.array([b.least() for b in best], np.float64)
                # the whole block at once: its distances to a pivot lie between low and high
                gap = np.maximum(np.maximum(low - dq, dq - high), 0).max(axis=1)
                alive = np.flatnonzero(upper(norm, norms.max(), gap) >= least)
                step = max(1, BOUNDS // len(x))
                for i in range(0, len(alive), step):
                    some = alive[i : i + step]
                    bound = np.zeros((len(some), len(x)))
                    for p in range(width):
                        np.maximum(bound, np.abs(dq[some, p, None] - d[None, :, p]), out=bound)
                    most = upper(norm[some, None], norms[None, :], bound)
                    for at, bounds in zip(some, most, strict=True):
                        skip = only == own[at] if has[at] else None  # nothing but the query's own id
                        b = Best(k + 1, best[at].least())
                        if _evaluate(b, q[at], x, head, bounds, skip) and len(b.score):
                            best[at].add(b.score, b.head, (len(names) << 32) + b.place)
                names.append((v1, v2))
        rows = [(ask[i], *(names[p >> 32][j][p & 0xFFFFFFFF] for j in (0, 1)), h, s) for i, b in enumerate(best) for s, h, p in zip(b.score.tolist(), b.head.tolist(), b.place.tolist(), strict=True)]
        columns = list(zip(*rows, strict=True)) if rows else [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(np.array(c, np.int64)) for c in columns], ["ask", "v1", "v2", "head", "score"])

    return blocks.select([c for c in BLOCKS if c not in ("asked", "floors")]).mapInArrow(scan, "ask long, v1 long, v2 long, head long, score long")


def search(vectors: DataFrame, query: Column, k: int = 10, scale: int = 1024, pivots: int = PIVOTS, lot_bytes: int = LOT) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` other ids of the greatest inner products for each row of ``vectors(vec_id, embedding, ...)`` where ``query`` holds.

    Components are floor(scale * x) in double precision; scores are exact, ties go to the smaller vec_id. Rows take no part if vec_id
    is null, the vector is null or has null or non-finite components (zero vectors do) or is empty, or its length is not
    that of most vectors. A row repeated under one vec_id is a candidate as often as it is there, but never for its own id, and asks
    as often. Scores beyond 64 bits are the nearest number of 64 bits. Empty tables give no rows; other columns are not read.
    """
    spark = vectors.sparkSession
    schema = "query_id long, rank int, vec_id long, score long"
    valid = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("e"), query.alias("asks")).where(F.col("vec_id").isNotNull() & common.finite(F.col("e")) & (F.size("e") > 0))
    sizes = valid.groupBy(F.size("e").alias("dim")).count().orderBy(F.desc("count"), "dim").limit(1).collect()
    if not sizes:
        return spark.createDataFrame([], schema)
    dim = sizes[0]["dim"]
    valid = valid.where(F.size("e") == dim).select("vec_id", whole(F.col("e"), scale).alias("x"), F.coalesce("asks", F.lit(False)).alias("asks"))
    valid = valid.withColumns({"v1": F.xxhash64("x"), "v2": F.xxhash64(F.sha2(F.to_json(F.struct("x")), 256))})
    # rows of one id and vector are counted before anything else moves
    each = common.written(valid.groupBy("v1", "v2", "vec_id").agg(F.first("x").alias("x"), F.count("*").alias("times"), F.count_if("asks").alias("asks")), "pivot-vectors")
    place = Window.partitionBy("v1", "v2").orderBy("vec_id")
    few = each.select("v1", "v2", "vec_id", F.least("times", F.lit(k)).alias("times"), F.row_number().over(place).alias("place")).where(F.col("place") <= k + 1)
    ids = common.written(few.groupBy("v1", "v2").agg(F.sort_array(F.collect_list(F.struct("vec_id", "times"))).alias("ids")), "pivot-ids")  # k + 1 at most
    several = each.groupBy("vec_id").count().where("count > 1").select(F.col("vec_id").alias("own"))
    lone = F.when(F.min("vec_id") == F.max("vec_id"), F.min("vec_id"))
    classes = each.groupBy("v1", "v2").agg(F.first("x").alias("x"), F.min("vec_id").alias("head"), F.coalesce(lone, F.lit(LOWEST)).alias("only"), (F.max("asks") > 0).alias("asked"))
    classes = common.written(classes, "pivot-classes")

    sample = classes.orderBy("v1", "v2").limit(SAMPLE).select("x").collect()
    chosen = choose(np.array([r["x"] for r in sample], np.float64).reshape(len(sample), dim), pivots)
    blocks, asked = _table(classes, chosen, dim, k)
    # an id that has several vectors must not be found by itself: its queries go one by one, all others by vector
    asking = each.where("asks > 0").join(several, F.col("vec_id") == F.col("own"), "left").select("v1", "v2", "vec_id", "asks", "own")
    asking = common.written(asking, "pivot-asking")
    questions = asking.select("v1", "v2", "own").distinct().join(asked, ["v1", "v2"])
    lots = max(1, -(-questions.count() * 8 * (dim + len(chosen) + 6) // lot_bytes))
    questions = common.written(questions.withColumn("ask", F.monotonically_increasing_id()).withColumn("lot", F.pmod(F.xxhash64("v1", "v2", "own"), F.lit(lots)).cast("int")), "pivot-questions")

    met = None
    for i in range(lots):
        rows = questions.where(F.col("lot") == i).select("ask", "x", "d", "floor", F.col("own").isNotNull().alias("has"), F.coalesce("own", F.lit(0)).alias("own")).toPandas()  # of bounded size
        if not len(rows):
            continue
        has = rows["has"].to_numpy(bool)
        lot = {"x": _matrix(b"".join(map(bytes, rows["x"])), dim), "d": _matrix(b"".join(map(bytes, rows["d"])), len(chosen)), "own": rows["own"].to_numpy(np.int64), "has": has, "ask": rows["ask"].to_numpy(np.int64), "floor": np.where(has, LOWEST, rows["floor"].to_numpy(np.int64))}
        found = _meet(blocks, lot, dim, len(chosen), k)
        met = found if met is None else met.unionByName(found)
    if met is None:
        return spark.createDataFrame([], schema)
    best = Window.partitionBy("ask").orderBy(F.desc("score"), "head")
    met = met.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k + 1)
    answers = met.join(ids, ["v1", "v2"]).select("ask", "score", F.explode("ids").alias("id")).select("ask", "score", "id.vec_id", "id.times")
    named = questions.select("ask", F.col("v1").alias("q1"), F.col("v2").alias("q2"), F.col("own").alias("o")).join(asking, (F.col("q1") == F.col("v1")) & (F.col("q2") == F.col("v2")) & F.col("o").eqNullSafe(F.col("own")) & (F.col("own").isNull() | (F.col("own") == F.col("vec_id"))))
    named = named.select("ask", F.col("vec_id").alias("query_id"), F.explode(F.sequence(F.lit(1), F.col("asks"))).alias("time"))
    out = named.join(answers, "ask").where(F.col("vec_id") != F.col("query_id")).withColumn("each", F.explode(F.sequence(F.lit(1), F.col("times"))))
    order = Window.partitionBy("query_id", "ask", "time").orderBy(F.desc("score"), "vec_id")
    out = out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return out.select("query_id", "rank", "vec_id", "score")
