"""Token counts with a digest cache.

A stored count belongs to two digests: one of the normalised content, one of the tokenizer's version.
Documents join the cache on both; only distinct contents that miss are encoded, and their counts are
appended. Contents are normalised by null -> empty text only, since whatever else changes a text may
change its count.

Plan: one shuffle of the distinct missing texts, spread by digest (equal contents are merged before
the shuffle, so a text that a third of the rows share crosses it once a task); after that only
digests and numbers move. The last join is a plain sort-merge join of rows of 60 bytes, which
adaptive execution splits where one digest is hot.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from toolloom.llm import common
from toolloom.llm.encoding import encode_column, version_digest

CACHE_SCHEMA = "tokenizer_digest string, content_digest string, n_tokens long"


def content_digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def cached(spark: SparkSession, cache: str, tokenizer: str) -> DataFrame:
    """Stored counts of one tokenizer version. An append that was repeated after a failure counts once."""
    if not common.exists(spark, cache):
        return spark.createDataFrame([], "content_digest string, n_tokens long")
    stored = spark.read.schema(CACHE_SCHEMA).parquet(cache).where(F.col("tokenizer_digest") == tokenizer)
    return stored.groupBy("content_digest").agg(F.max("n_tokens").alias("n_tokens"))


def _counter(path: str):
    def count(batches):
        for batch, ids in encode_column(batches, path, "text"):
            yield pa.RecordBatch.from_arrays([batch.column("content_digest"), pa.array([len(x) // 4 for x in ids], pa.int64())], ["content_digest", "n_tokens"])

    return count


def count_misses(docs: DataFrame, tokenizer_path: str, cache: str) -> None:
    """Encode the distinct contents of ``docs(text)`` that the cache lacks and append their counts.

    With a cache only digests are shuffled to find what is missing; a sieve of the missing ones then picks the texts.
    """
    spark, version = docs.sparkSession, version_digest(tokenizer_path)
    with common.scratch(spark):
        texts = docs.select(common.text_or_empty().alias("text")).withColumn("content_digest", content_digest(F.col("text")))
        if common.exists(spark, cache):
            missing = texts.select("content_digest").distinct().join(cached(spark, cache, version), "content_digest", "left_anti")
            missing = common.written(missing.select("content_digest"), "missing-digests")
            keyed = texts.withColumn("key", F.xxhash64("content_digest"))
            marked = common.with_mark(keyed, "key", missing.select(F.xxhash64("content_digest").alias("key")), "may").where("may")
            # copies are merged before the shuffle, so a text that a third of the rows share crosses it once a task
            wanted = marked.groupBy("content_digest").agg(F.first("text").alias("text")).join(missing, "content_digest", "left_semi")
        else:
            wanted = texts.groupBy("content_digest").agg(F.first("text").alias("text"))
        counts = wanted.select("content_digest", "text").mapInArrow(_counter(tokenizer_path), "content_digest string, n_tokens long")
        counts.select(F.lit(version).alias("tokenizer_digest"), "content_digest", "n_tokens").write.mode("append").parquet(cache)


def token_counts(docs: DataFrame, tokenizer_path: str, cache: str, limit: int) -> DataFrame:
    """Token counts of ``docs(doc_id, text, ...)``: ``doc_id, n_bytes, n_tokens, over_limit``, a row for each row.

    Null text counts as empty (0 bytes, 0 tokens); null or repeated doc_ids stay rows of their own;
    an empty table gives no rows; other columns are not read.
    """
    count_misses(docs, tokenizer_path, cache)
    text = common.text_or_empty()
    keyed = docs.select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), content_digest(text).alias("content_digest"))
    counts = cached(docs.sparkSession, cache, version_digest(tokenizer_path))
    return keyed.join(counts, "content_digest", "left").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
