"""Registration of queries with their oracle SQL, and the readers they share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt out to all shuffle partitions: a small file of few columns is one task, however much is made of each of its rows."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism))


class Plans:
    """The queries of one module; ``@plans.query(sql)`` adds one under its function's name."""

    def __init__(self) -> None:
        self.QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.ORACLES: dict[str, str] = {}

    def query(self, sql: str | None = None):
        def add(f):
            self.QUERIES[f.__name__] = f
            if sql:
                self.ORACLES[f.__name__] = sql
            return f

        return add
