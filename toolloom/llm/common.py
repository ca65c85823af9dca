"""What the operators share: tables in the shared folder, row columns, batches and workers' caches."""

from __future__ import annotations

import contextlib
import contextvars
import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes and rows of a batch that goes to a Python worker: whole texts are long, and a batch is held several times over.
BATCH_BYTES, BATCH_ROWS = 4 << 20, 2048


class Scope:
    """Tables that were written within a ``scratch`` block."""

    def __init__(self, keep_all: bool = False):
        self.keep_all, self.tables, self.kept = keep_all, [], []

    def keep(self, *tables: DataFrame) -> None:
        """Tables that the block's result reads and that hence outlive it."""
        self.kept += tables


_scope: contextvars.ContextVar[Scope | None] = contextvars.ContextVar("scope", default=None)
#: Tables that lazy results still read, by owner.
_results: dict[str | None, list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where a session on one machine leaves it unset, as in tests, a folder below the warehouse is
    taken and set as the checkpoint folder; on a cluster a missing setting is an error.
    """
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found.rstrip("/")
    if (own := spark.sparkContext._jsc.sc().getCheckpointDir()).isDefined():
        return own.get().rstrip("/")
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    path = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"
    spark.sparkContext.setCheckpointDir(path)
    return path


def unique() -> str:
    return uuid.uuid4().hex


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder; it belongs to the innermost scope, and without one to ``release``."""
    path = f"{shared_dir(spark)}/tables/{name}-{unique()}"
    scope = _scope.get()
    if scope is None:
        _results.setdefault(None, []).append(path)
    else:
        scope.tables.append((None, path))
    return path


def written(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """``df`` as a table in the shared folder, read back: lineage ends here and lost executors cost nothing."""
    spark = df.sparkSession
    path = new_path(spark, name)
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    table = spark.read.schema(spark.read.parquet(path).schema).parquet(path)
    if (scope := _scope.get()) is not None:
        scope.tables[-1] = (table, path)
    return table


@contextlib.contextmanager
def scratch(spark: SparkSession, owner: str | None = None, keep_all: bool = False) -> Iterator[Scope]:
    """Tables written in the block are removed at its end, but for those that are kept.

    Kept ones go to the block around it, or are results of ``owner`` until ``release``.
    """
    scope, outer = Scope(keep_all), _scope.get()
    token = _scope.set(scope)
    done = False
    try:
        yield scope
        done = True
    finally:
        _scope.reset(token)
        for table, path in scope.tables:
            if done and (scope.keep_all or any(table is k for k in scope.kept)):
                if outer is None:
                    _results.setdefault(owner, []).append(path)
                else:
                    outer.tables.append((table, path))
            else:
                delete(spark, path)


@contextlib.contextmanager
def results_of(spark: SparkSession, owner: str) -> Iterator[None]:
    """In the block a lazy result of ``owner`` is built; the tables of the owner's last one go."""
    release(spark, owner)
    with scratch(spark, owner, keep_all=True):
        yield


def release(spark: SparkSession, owner: str | None = None) -> None:
    """Remove the tables that ``owner``'s results read; call it when these results are stored."""
    for path in _results.pop(owner, []):
        delete(spark, path)


def delete(spark: SparkSession, path: str) -> None:
    """Remove a path of any file system that Spark knows."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table; from now on the session hands rows to Python workers in batches of bounded bytes."""
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Batches of at most ``BATCH_BYTES`` (or one row) and ``BATCH_ROWS``; a session that asks for less keeps it."""
    for name, most in (("maxBytesPerBatch", BATCH_BYTES), ("maxRecordsPerBatch", BATCH_ROWS)):
        key = f"spark.sql.execution.arrow.{name}"
        held = spark.conf.get(key, str(most)).lower().removesuffix("b")
        if not held.isdigit() or not 0 < int(held) <= most:
            spark.conf.set(key, str(most))


#: Bits of a sieve a key, and of a whole sieve at most (16 MB); a fuller one lets more rows pass, which the join behind it removes.
SIEVE_BITS, MOST_SIEVE_BITS = 16, 1 << 27


def with_mark(rows: DataFrame, key: str, keys: DataFrame, mark: str) -> DataFrame:
    """``rows`` with ``mark``: false only where ``keys`` (one column of longs) lacks ``key``.

    A Bloom filter of the keys stands beside the rows as one array of longs, so a join of rows with few keys need
    not move all rows, whatever their number.
    """
    spark = rows.sparkSession
    name = keys.columns[0]
    bits = 1 << min(MOST_SIEVE_BITS.bit_length() - 1, max(10, (SIEVE_BITS * keys.count()).bit_length()))

    def places(column: Column) -> list[Column]:
        return [F.pmod(F.xxhash64(column, F.lit(seed)), F.lit(bits)) for seed in (11, 12)]

    def bit(place: Column) -> Column:
        return F.call_function("shiftleft", F.lit(1).cast("long"), place.bitwiseAND(F.lit(63)).cast("int"))

    held = keys.select(F.explode(F.array(*places(F.col(name)))).alias("p"))
    found = held.groupBy(F.shiftright("p", 6).alias("word")).agg(F.bit_or(bit(F.col("p"))).alias("bits")).toPandas()  # a word of the sieve a row
    words = np.zeros(bits // 64, np.int64)
    words[found["word"].to_numpy(np.int64)] = found["bits"].to_numpy(np.int64)
    sieve = spark.createDataFrame(pa.table({"_words": pa.array([words], pa.list_(pa.int64()))}))
    hit = F.lit(True)
    for place in places(F.col(key)):
        hit = hit & (F.element_at("_words", (F.shiftright(place, 6) + 1).cast("int")).bitwiseAND(bit(place)) != 0)
    return rows.crossJoin(F.broadcast(sieve)).withColumn(mark, hit).drop("_words")  # one row of bounded size


def matched(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """``rows`` joined with ``keys``, whose first column is ``key``; of the rows only those that may match are moved."""
    return with_mark(rows, key, keys.select(key).distinct(), "_may").where("_may").drop("_may").join(keys, key)


#: What empties the caches that this worker holds, by operator.
_caches: dict[str, Callable[[], None]] = {}


def cache(owner: str, clear: Callable[[], None]) -> None:
    """Name a cache of this process and what empties it."""
    _caches[owner] = clear


#: The operator whose task ran in this worker last.
_last_owner: list[str] = []


def own_cache(owner: str) -> None:
    """A task of ``owner`` begins in this worker: caches that other operators left in it are emptied, and their memory goes back."""
    if _last_owner and _last_owner[-1] != owner:
        for name, clear in _caches.items():
            if name != owner:
                clear()
        gc.collect()
        with contextlib.suppress(OSError, AttributeError):  # only glibc has it
            ctypes.CDLL(None).malloc_trim(0)
    _last_owner[:] = [owner]


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def finite(vector: Column) -> Column:
    """Whether a vector is there and all its components are finite."""
    return vector.isNotNull() & F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != F.lit(float("inf"))))


def fresh_names(df: DataFrame, *wanted: str) -> list[str]:
    """Column names that start with ``wanted`` and clash with none of ``df``."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in wanted:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out
