"""Writers: JSON lines, one folder a split, replacement of a table, resumable appends, reports."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from toolloom.operators.ranks import first_k
from toolloom.operators.reports import markdown

#: Seconds after which a writer that has claimed a version, or an append, counts as gone.
PATIENCE = 60.0


def json_lines(df: DataFrame, path: str) -> None:
    """UTF-8 JSON lines, nothing escaped that needn't be."""
    df.write.mode("overwrite").json(path)


def by_split(df: DataFrame, path: str, split: str = "split") -> DataFrame:
    """One folder a split; returns the counts."""
    df.write.mode("overwrite").partitionBy(split).json(path)
    return df.groupBy(split).agg(F.count("*").alias("n"))


class Conflict(RuntimeError):
    """Another writer has replaced the version that a change was made from."""


def _fs(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def _taken(spark: SparkSession, path: str) -> bool:
    """Create a file that is not there yet; False if it is: of several writers one succeeds."""
    fs, target = _fs(spark, path)
    try:
        fs.create(target, False).close()
    except Py4JJavaError as e:
        if "FileAlreadyExists" in e.java_exception.getClass().getName() or fs.exists(target):
            return False
        raise
    return True


def replace(df: DataFrame, path: str, base: int | None = None, patience: float = PATIENCE) -> int:
    """Replace a JSON table that ``df`` may itself read, and return the number of the new version.

    ``path`` holds folders ``v=<number>``; a version counts once it has its ``_SUCCESS``, and readers (``current``) take
    the last that counts, so they see the old table or the new one, whole. The data is written aside; then the
    writer claims the next number, which only one can, and moves it there. If ``base`` is given, the version that ``df`` was made
    from, and another one follows it by then, ``Conflict`` is raised and nothing is replaced. A claim whose writer is gone is
    passed over after ``patience`` seconds. The version before stays for readers that have begun, older ones go.
    """
    spark = df.sparkSession
    aside = f"{path}/_new-{uuid.uuid4().hex}"
    df.write.json(aside)
    fs, moved = _fs(spark, aside)
    number = None
    try:
        while True:
            done = versions(spark, path)
            last = done[-1] if done else -1
            if base is not None and last != base:
                raise Conflict(f"version {last} of {path} follows version {base}")
            number = last + 1 if number is None else max(number, last + 1)
            if _taken(spark, f"{path}/_claims/{number:09d}"):
                fs.rename(moved, _fs(spark, f"{path}/v={number:09d}")[1])
                break
            until = time.monotonic() + patience
            while number not in versions(spark, path) and time.monotonic() < until:
                time.sleep(0.1)
            number += 1
    finally:
        fs.delete(moved, True)  # where it was not moved
    for old in done[:-1]:
        fs.delete(_fs(spark, f"{path}/v={old:09d}")[1], True)
    return number


def update(spark: SparkSession, path: str, change: Callable[[DataFrame], DataFrame], schema: str | None = None, tries: int = 10) -> int:
    """Replace a table by ``change`` of its current version; made anew from the newer one if another writer comes first."""
    for left in reversed(range(tries)):
        done = versions(spark, path)
        if not done:
            raise ValueError(f"no finished version below {path}")
        read = spark.read.schema(schema) if schema else spark.read
        try:
            return replace(change(read.json(f"{path}/v={done[-1]:09d}")), path, done[-1])
        except Conflict:
            if not left:
                raise
    raise ValueError("no tries")


def versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the finished versions of a replaced table, in order."""
    to = spark._jvm.org.apache.hadoop.fs.Path
    fs = to(path).getFileSystem(spark._jsc.hadoopConfiguration())
    found = fs.globStatus(to(f"{path}/v=*/_SUCCESS")) or []
    return sorted(int(f.getPath().getParent().getName()[2:]) for f in found)


def current(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """The last finished version of a replaced table; ValueError where there is none."""
    done = versions(spark, path)
    if not done:
        raise ValueError(f"no finished version below {path}")
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.json(f"{path}/v={done[-1]:09d}")


def append_missing(jobs: DataFrame, path: str, key: str, work: Callable[[DataFrame], DataFrame], patience: float = PATIENCE) -> None:
    """Append ``work(jobs that the table lacks)``; a repeated call does what an interrupted one left.

    Results are written aside and appended by one writer at a time, without those whose keys another one has brought
    by then, so calls at once leave every key once. A writer that is gone holds others up for ``patience`` seconds at most.
    """
    spark = jobs.sparkSession

    def missing(df: DataFrame) -> DataFrame:
        fs, _ = _fs(spark, path)
        held = fs.globStatus(_fs(spark, f"{path}/part-*")[1])
        return df.join(spark.read.parquet(path).select(key).distinct(), key, "left_anti") if held else df

    aside, lock = f"{path}/_new-{uuid.uuid4().hex}", f"{path}/_appending"
    work(missing(jobs)).write.parquet(aside)
    fs, held = _fs(spark, lock)
    until = time.monotonic() + patience
    while not _taken(spark, lock):
        if time.monotonic() > until:
            fs.delete(held, True)  # its writer is gone
        time.sleep(0.1)
    try:
        new = spark.read.schema(spark.read.parquet(aside).schema).parquet(aside)
        missing(new).write.mode("append").parquet(path)
    finally:
        fs.delete(held, True)
        fs.delete(_fs(spark, aside)[1], True)


def messages_with_tail(df: DataFrame, path: str, position: str = "pos", share: int = 10) -> None:
    """Messages only, the last ``max(1, n // share)`` rows by a whole number as validation set; every row goes to one side, null positions to training."""
    last, rest = first_k(df, max(1, df.count() // share), [F.bitwise_not(F.col(position).cast("long"))])
    rest.select("messages").write.mode("overwrite").json(f"{path}/train")
    last.select("messages").write.mode("overwrite").json(f"{path}/valid")


def report(df: DataFrame, title: str, path: str) -> str:
    """A small aggregate as Markdown, written as one text file."""
    text = markdown(title, df)
    df.sparkSession.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)
    return text


def tail(df: DataFrame, n: int, position: str) -> DataFrame:
    """The last ``n`` rows by position, a whole number, the last one first."""
    return first_k(df, n, [F.bitwise_not(F.col(position).cast("long"))])[0].orderBy(F.desc(position))
