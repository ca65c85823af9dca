"""Deterministic sampling, hold-outs, cycles, ids and argument grids: hashes instead of random generators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from toolloom.operators.ranks import first_k, numbered

#: The ten-step cycle of difficulty tiers, and that of masking modes.
TIERS = ["simple"] * 3 + ["medium"] * 4 + ["complex"] * 3
MASK_MODES = ["fn", "fn", "param", "renamed"]


def arithmetic_hash(key: Column, modulus: int = 1_000_003, seed: int = 0) -> Column:
    """A hash of a small non-negative integer that any SQL engine can compute."""
    return (key * 7919 + 104729 * (seed + 1)) % modulus


def hash_order(seed: int, *keys: str) -> Column:
    return F.xxhash64(*keys, F.lit(seed))


def hold_out(df: DataFrame, k: int, key: str, order: Column | None = None, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(held out, rest): the ``k`` rows that come first in hash order, cut by a histogram of the hashes."""
    return first_k(df, k, [hash_order(seed, key) if order is None else order, key])


def sample_cap(df: DataFrame, k: int, key: str, seed: int = 0) -> DataFrame:
    return first_k(df, k, [hash_order(seed, key), key])[0]


def numbered_ids(df: DataFrame, prefix: Column, order: list[str], by: list[str], width: int = 4) -> DataFrame:
    """Ids ``prefix`` + zero-padded number within ``by`` in ``order``, for groups of any size."""
    return numbered(df, by, order, "_n").withColumn("id", F.concat(prefix, F.format_string(f"%0{width}d", "_n"))).drop("_n")


def tier(position: Column) -> Column:
    from toolloom.functions.values import cycled

    return cycled(position, TIERS)


def pick(pool: Column, *keys: Column) -> Column:
    """The pool's item that a hash of the keys names; null for an empty pool."""
    return F.try_element_at(pool, F.pmod(F.xxhash64(*keys), F.greatest(F.size(pool), F.lit(1))).cast("int") + 1)


def argument_grid(tools: DataFrame, pools: DataFrame, n: int) -> DataFrame:
    """``n`` argument sets a tool: each required parameter takes an item of its pool for the tier.

    ``pools(param, tier, items, period)``: params of one period share one pick, so date pairs agree.
    """
    jobs = tools.select("name", "params").withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("tier", tier(F.col("i")))
    wanted = jobs.select("name", "i", "tier", F.explode(F.filter("params", lambda p: p["required"])).alias("p")).select("name", "i", "tier", F.col("p.name").alias("param"))
    met = wanted.join(pools, ["param", "tier"])
    drawn = met.withColumn("value", pick(F.col("items"), F.col("name"), F.col("tier"), F.col("i"), F.coalesce("period", F.col("param"))))
    return drawn.groupBy("name", "i", "tier").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("param", "value")))).alias("arguments"))


def over_generated(n: int, factor: float = 1.6) -> int:
    """How many candidates to make so that ``n`` survive the checks."""
    return int(n * factor)


def first_n(df: DataFrame, n: int, position: str) -> DataFrame:
    """The first ``n`` rows by position."""
    return first_k(df, n, [position])[0]


def station_catalogue(locations: DataFrame, per_location: int = 3, cap: int = 300) -> DataFrame:
    """Stations of ``locations(code, name, is_province, pos)``: provinces first, numbered, up to ``cap``."""
    per = locations.withColumn("j", F.explode(F.sequence(F.lit(1), F.lit(per_location))))
    per = numbered(per, [], [F.desc("is_province"), "pos", "j"]).withColumn("n", F.col("n") + 1)
    return per.where(F.col("n") <= cap).select(F.format_string("EHB%05d", "n").alias("station_code"), F.col("code").alias("location_code"), F.concat_ws(" ", "name", F.col("j").cast("string")).alias("name"))


def stations_of(requests: DataFrame, stations: DataFrame, k: int = 3) -> DataFrame:
    """The first ``k`` stations of each request's location, of the whole catalogue where it has none."""
    ranked = stations.withColumn("r", F.row_number().over(Window.partitionBy("location_code").orderBy("station_code"))).where(F.col("r") <= k)
    own = ranked.groupBy("location_code").agg(F.array_sort(F.collect_list("station_code")).alias("own"))
    anywhere = stations.orderBy("station_code").limit(k).agg(F.array_sort(F.collect_list("station_code")).alias("anywhere"))
    return requests.join(own, "location_code", "left").crossJoin(F.broadcast(anywhere)).withColumn("stations", F.coalesce("own", "anywhere")).drop("own", "anywhere")
