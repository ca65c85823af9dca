"""URL filters: a blocked Bloom filter in front of an exact hash join.

A rule is a host, a path prefix and a verdict; it fits its host and all its subdomains where the path
starts with the rule's. A canonical key is ``host + path``. A url can only match rules whose shape
(number of host labels, length of path) it contains, so a url has as many candidate keys as there are
shapes among the rules. Candidates are tested in the Bloom filter (one 512-bit block and ``PROBES`` bits
a key); only possible hits reach the exact join with the rules, which removes false positives; the
longest rule wins.

Everything is done on the distinct (host, path) pairs: a page or host that many rows share costs once,
and rows meet their decision in a sort-merge join of small rows that adaptive execution can split.
The filter takes 16 bits a rule; it is broadcast up to ``MAX_FILTER_BYTES``. Longer lists skip the
filter and go to the exact join at once. The rules of that join are broadcast only if Spark finds them
small.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PROBES, BITS_PER_KEY, BLOCK_BITS = 8, 16, 512
MAX_FILTER_BYTES = 64 << 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end; empty for null or without ``://``."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


class BlockedBloom:
    """Bits of a key lie in one 64-byte block, so a test touches one cache line."""

    def __init__(self, hashes: np.ndarray):
        self.blocks = max(1, -(-len(hashes) * BITS_PER_KEY // BLOCK_BITS))
        self.words = np.zeros(self.blocks * (BLOCK_BITS // 64), np.uint64)
        for at, bit in self._bits(hashes):
            np.bitwise_or.at(self.words, at, bit)

    def _bits(self, hashes: np.ndarray):
        h = hashes.astype(np.int64).view(np.uint64)
        with np.errstate(over="ignore"):
            block = ((h >> np.uint64(32)) * np.uint64(self.blocks)) >> np.uint64(32)
            step = (h * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
            for k in range(PROBES):
                place = (h + np.uint64(k) * step) >> np.uint64(55)  # 0 to 511
                yield block * np.uint64(BLOCK_BITS // 64) + (place >> np.uint64(6)), np.uint64(1) << (place & np.uint64(63))

    def may_hold(self, hashes: np.ndarray) -> np.ndarray:
        out = np.ones(len(hashes), bool)
        for at, bit in self._bits(hashes):
            out &= self.words[at] & bit != 0
        return out


def _candidates(shapes: list[tuple[int, int]]) -> Column:
    """Array of (host suffix, path prefix) of the shapes that a url has."""
    labels = F.size(F.split("host", r"\."))
    items = []
    for n, length in shapes:
        fits = (labels >= n) & (F.length("host") > 0) & (F.length("path") >= length)
        items.append(F.when(fits, F.struct(F.substring_index("host", ".", -n).alias("host"), F.substring("path", 1, length).alias("path"))))
    return F.filter(F.array(*items), lambda x: x.isNotNull())


def decide(keys: DataFrame, rules: DataFrame) -> DataFrame:
    """``host, path, rule, rule_verdict`` of those distinct ``keys(host, path)`` that a rule fits.

    ``rules(host, path, verdict)``: rows with null or empty host or null verdict count as absent; a rule
    given twice with different verdicts blocks.
    """
    spark = keys.sparkSession
    rules = rules.select(F.translate("host", UPPER, LOWER).alias("rule_host"), F.coalesce("path", F.lit("")).alias("rule_path"), "verdict").where("rule_host <> '' and verdict is not null")
    rules = rules.groupBy("rule_host", "rule_path").agg(F.max("verdict").alias("rule_verdict"))
    shapes = sorted((r[0], r[1]) for r in rules.select(F.size(F.split("rule_host", r"\.")), F.length("rule_path")).distinct().collect())  # label counts times path lengths
    if not shapes:
        return keys.select("host", "path", F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("rule_verdict")).where("false")
    found = keys.withColumn("c", F.explode(_candidates(shapes))).select("host", "path", F.col("c.host").alias("rule_host"), F.col("c.path").alias("rule_path"))
    if (n := rules.count()) * BITS_PER_KEY // 8 <= MAX_FILTER_BYTES:
        hashes = rules.select(F.xxhash64("rule_host", "rule_path").alias("h")).toPandas()["h"].to_numpy(np.int64) if n else np.zeros(0, np.int64)
        held = spark.sparkContext.broadcast(BlockedBloom(hashes))

        @F.pandas_udf(T.BooleanType())
        def may_hold(h: pd.Series) -> pd.Series:
            return pd.Series(held.value.may_hold(h.to_numpy(np.int64)))

        found = found.where(may_hold(F.xxhash64("rule_host", "rule_path")))
    hits = found.join(rules, ["rule_host", "rule_path"])
    rule = F.concat("rule_host", "rule_path")
    best = F.max(F.struct(F.length(rule).alias("n"), F.length("rule_host").alias("h"), rule.alias("rule"), F.col("rule_verdict").alias("verdict")))
    return hits.groupBy("host", "path").agg(best.alias("best")).select("host", "path", F.col("best.rule").alias("rule"), F.col("best.verdict").alias("rule_verdict"))


def filter_urls(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """``page_id, host, path, rule, verdict`` for each row of ``pages(page_id, url, ...)``.

    Null urls and urls without ``://`` have empty host and path, no rule and the default verdict; null or
    repeated page_ids stay rows of their own; an empty table gives no rows; other columns are not read.
    """
    rows = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    decided = decide(rows.select("host", "path").distinct(), rules)
    out = rows.join(decided, ["host", "path"], "left")
    return out.select("page_id", "host", "path", "rule", F.coalesce("rule_verdict", F.lit(default)).alias("verdict"))
