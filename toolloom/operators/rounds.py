"""Cutting lineage between the rounds of an iterative job."""

from __future__ import annotations

from pyspark.sql import DataFrame


def settled(df: DataFrame) -> DataFrame:
    """``df`` stored in the folder that ``spark.checkpoint.dir`` names, so that a lost executor costs no earlier round.

    A session on one machine that names none gets a folder below its warehouse; on a cluster that is an error.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        if not (folder := spark.conf.get("spark.checkpoint.dir", None)):
            if context.master.split("[")[0] != "local":
                raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
            folder = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
        context.setCheckpointDir(folder)
    return df.checkpoint()
