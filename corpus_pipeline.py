"""From raw documents to packed windows: each stage calls one operator and works on all its predecessor kept.

Stages take (spark, docs, sf_dir) and return a table that is written as Parquet and read again as the
next one's docs. All but the last keep the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from toolloom.llm import common, decontamination, near_duplicates, packing, pii, quality
from toolloom.llm.encoding import vocabulary

#: A document goes below this score.
GOOD = 0.7
#: The id that closes a document.
END = 2
#: Workers have other stages' tables and modules in memory as well, so they keep fewer encoded words.
CACHE_SHARE = 0.4
#: Whose tables a stage's result reads; they go when the next stage begins.
OWNER = "pipeline"


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go; the held-out fold's labels are not learnt from.

    Null and empty texts are scored like any other, long texts whole; equal rows stay or go together; an empty table stays empty.
    """
    with common.results_of(spark, OWNER):
        return quality.keep_good(docs, common.read(spark, sf_dir, "labels"), GOOD)


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, the one with the least doc_id.

    Null and empty texts are one group; of equal ids the first row stays; long texts count whole; an empty table stays empty.
    """
    with common.results_of(spark, OWNER):
        return near_duplicates.keep_one(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of the benchmark go, and documents of which they are a large part.

    Null and empty texts stay as they are; equal rows are treated alike; without a benchmark nothing changes; an empty table stays empty.
    """
    with common.results_of(spark, OWNER):
        return decontamination.remove(docs, common.read(spark, sf_dir, "benchmark"))


def personal_data_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is masked by its kind.

    Null texts stay null; long texts are searched whole in overlapping windows; equal rows are treated alike; an empty table stays empty.
    """
    with common.results_of(spark, OWNER):
        return pii.redact(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of full windows, sources in proportion to their tokens.

    Null texts are empty and have the closing id alone; null sources are a source; long texts are cut; equal rows are packed one by one; an
    empty table gives no pieces.
    """
    with common.results_of(spark, OWNER):
        return packing.pack_documents(docs, vocabulary("word_bpe_49k.json"), END, cache_share=CACHE_SHARE)


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicates_stage),
    ("decontamination", decontamination_stage),
    ("personal_data", personal_data_stage),
    ("packing", packing_stage),
]

#: MinHash, boosting, LSTM and BPE are beyond SQL: tests/llm compares near duplicates, decontamination, packing and periods with brute force and
#: the classifier and the tagger by held-out accuracy; tests/llm/test_pipeline.py checks that each stage applies its operator to all rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written to the shared folder and read again."""
    docs, outputs = common.read(spark, sf_dir, "documents"), []
    for name, stage in STAGES:
        path = f"{common.shared_dir(spark)}/pipeline/{name}-{common.unique()}"
        stage(spark, docs, sf_dir).write.parquet(path)
        outputs.append(path)
        docs = spark.read.parquet(path)
        for old in outputs[:-1]:
            common.delete(spark, old)
        del outputs[:-1]
    common.release(spark, OWNER)
    return docs


QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
