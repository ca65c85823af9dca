"""Near-duplicate removal within keys, phrasing caps, decontamination by signature.

Two rules with two names: ``greedy`` keeps a row unless an earlier *kept* row is too similar, so it depends
on order; ``drop_similar`` drops a row if any earlier row is too similar, kept or not, which drops a
superset and is plain relational algebra.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from toolloom.functions.text import jaccard
from toolloom.operators.rounds import settled

#: Similarity above which a row is a near duplicate (strictly), and phrasings kept of one signature.
THRESHOLD, PHRASINGS = 0.85, 3


#: Bins of the table of counts by which tokens are ordered (a byte each), bins of a piece of it, and tokens of a group, between this and twice as many.
BINS, PIECE, GROUP = 1 << 24, 1 << 18, 128
#: What rounding may hide.
SLACK = 1e-9


def _digest(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def _hashed(df: DataFrame, *more: Column) -> DataFrame:
    """``key, pos, _set, h`` and more of all rows: the digest of the set (null: no tokens), and a hash of each token with its key."""
    digest = F.when(F.size("tokens") > 0, _digest(F.array_join("tokens", "\n")))
    return df.select("key", "pos", digest.alias("_set"), F.transform("tokens", lambda t: F.xxhash64(F.col("key"), t)).alias("h"), *more)


def _table(bins: DataFrame, code: Callable[[np.ndarray], np.ndarray], none: int) -> np.ndarray:
    """A byte for each of ``BINS``: that of the count in ``bins(bin, count)``, ``none`` where there is no row."""

    def packed(keys: tuple, t: pa.Table) -> pa.Table:
        piece = np.full(PIECE, none, np.uint8)
        piece[t["bin"].to_numpy() % PIECE] = code(t["count"].to_numpy())
        return pa.table({"at": [keys[0].as_py()], "codes": [piece.tobytes()]}, schema=pa.schema([("at", pa.int64()), ("codes", pa.binary())]))

    out = np.full(BINS, none, np.uint8)
    for at, piece in bins.withColumn("at", F.floor(F.col("bin") / PIECE)).groupBy("at").applyInArrow(packed, "at long, codes binary").collect():  # 64 at most
        out[at * PIECE : (at + 1) * PIECE] = np.frombuffer(piece, np.uint8)
    return out


def _binned(h: Column) -> Column:
    return F.pmod(h, F.lit(BINS)).alias("bin")


def _codes(hashed: DataFrame) -> np.ndarray:
    """For each bin of hashes a byte that grows with its tokens: their number up to 16, then eight steps a doubling; 1 where there is one or none."""
    counted = hashed.select(F.explode("h").alias("h")).groupBy(_binned(F.col("h"))).count().where("count > 1")
    return _table(counted, lambda n: np.minimum(np.where(n <= 16, n, 16 + np.ceil(8 * np.log2(n / 16))), 255), 1)


def _sieved(df: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows of ``df`` that ``wanted(key, pos)`` holds, and a few more: the others go before anything of them is computed or moved."""
    held = df.sparkSession.sparkContext.broadcast(_table(wanted.groupBy(_binned(F.xxhash64("key", "pos"))).count(), np.ones_like, 0))

    @F.pandas_udf("boolean")
    def likely(h: pd.Series) -> pd.Series:
        return pd.Series(held.value[h.to_numpy() & (BINS - 1)] > 0)

    return df.where(likely(F.xxhash64("key", "pos")))


def _groups_of(n: np.ndarray) -> np.ndarray:
    """The groups, a power of two, into which a set of ``n`` tokens is cut."""
    return 1 << np.floor(np.log2(np.maximum(n // GROUP, 1))).astype(np.int64)


GROUPS = "array<struct<cut:long,own:boolean,m:int,s0:long,s1:long,prefix:array<long>>>"


def _grouped(offsets: np.ndarray, h: np.ndarray, codes: np.ndarray, threshold: float) -> pa.Array:
    """For each set its groups (``GROUPS``) with what ``_candidates`` compares."""
    n = np.diff(offsets)
    own = _groups_of(n)
    more = _groups_of(np.floor(n / threshold + SLACK).astype(np.int64))  # of the largest set that may be similar
    wider = np.flatnonzero(more > own)
    row, cut = np.concatenate([np.arange(len(n)), wider]), np.concatenate([own, more[wider]])
    order = np.argsort(row, kind="stable")
    row, cut = row[order], cut[order]
    mine = cut == own[row]
    first = np.cumsum(cut) - cut  # of the groups of a cut set
    size, total = n[row], int(cut.sum())
    at = np.repeat(offsets[row] - (np.cumsum(size) - size), size) + np.arange(size.sum())
    x = h[at]
    group = np.repeat(first, size) + ((x >> 24) & np.repeat(cut - 1, size))
    code = codes[x & (BINS - 1)]
    # the order of tokens is one for all sets; tokens equal in it count as one and the same
    rank = (code.astype(np.uint64) << np.uint64(55)) | (x.view(np.uint64) >> np.uint64(9))
    by = np.lexsort((rank, group))
    m = np.bincount(group, minlength=total)
    place = np.arange(len(by)) - np.repeat(np.cumsum(m) - m, m)
    left = m - np.ceil(threshold * m - SLACK).astype(np.int64) + 1
    taken = (place < np.repeat(left, m)) & (code[by] > 1)  # a token of one set alone meets nobody
    bits = np.bincount(group * 128 + ((x >> 40) & 127), minlength=total * 128).astype(np.uint8).reshape(-1, 128) & 1
    sketch = np.packbits(bits, axis=1, bitorder="little").view(np.int64).reshape(-1, 2)
    ends = np.concatenate([[0], np.cumsum(np.bincount(group[by][taken], minlength=total))])
    prefix = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(rank[by][taken].view(np.int64)))
    number = np.repeat(cut, cut) * 2**32 + np.arange(total) - np.repeat(first, cut)
    parts = [pa.array(number), pa.array(np.repeat(mine, cut)), pa.array(m.astype(np.int32)), pa.array(sketch[:, 0].copy()), pa.array(sketch[:, 1].copy()), prefix]
    held = np.concatenate([[0], np.cumsum(np.bincount(row, weights=cut, minlength=len(n)).astype(np.int64))])
    return pa.ListArray.from_arrays(pa.array(held, pa.int32()), pa.StructArray.from_arrays(parts, ["cut", "own", "m", "s0", "s1", "prefix"]))


def cut_up(df: DataFrame, threshold: float = THRESHOLD, *more: Column) -> DataFrame:
    """``key, pos, _set, n, groups`` and more of all rows, stored: token sets themselves are not, but a digest, and of each group the rarest tokens and a sketch."""
    held = df.sparkSession.sparkContext.broadcast(_codes(_hashed(df)))  # 16 MB
    hashed = _hashed(df, *more)
    at = hashed.columns.index("h")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 512):
                rows = b.slice(i, 512)
                h = rows.column(at)
                offsets = np.concatenate([[0], np.cumsum(h.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))]).astype(np.int64)
                groups = _grouped(offsets, h.flatten().to_numpy(), held.value, threshold)
                others = [n for n in rows.schema.names if n != "h"]
                yield pa.RecordBatch.from_arrays([*(rows.column(n) for n in others), h.value_lengths(), groups], [*others, "n", "groups"])

    kinds = ", ".join(f"{c} {kind}" for c, kind in hashed.dtypes if c != "h")
    return settled(hashed.mapInArrow(cut, f"{kinds}, n int, groups {GROUPS}"))


def classes(cut: DataFrame) -> DataFrame:
    """``key, _set, pos, n, groups`` of the different token sets of each key of ``cut_up``: the first row stands for all; rows without tokens have none."""
    return cut.where("_set is not null").groupBy("key", "_set").agg(F.min(F.struct("pos", "n", "groups")).alias("_first")).select("key", "_set", "_first.*")


def similar_pairs(df: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(key, earlier, later, similarity) of the classes (by their first rows) of ``key, pos, tokens`` (distinct) above the threshold.

    Rows with equal sets are one class, so copies never meet. Whom a set meets is told by hashes (``_candidates``), without a loss; only
    sets that meet another are compared in full.
    """
    return _pairs(df, cut_up(df, threshold), threshold)


def _pairs(df: DataFrame, cut: DataFrame, threshold: float) -> DataFrame:
    met = settled(_candidates(classes(cut), threshold))
    involved = settled(met.select("key", F.col("earlier").alias("pos")).union(met.select("key", "later")).distinct())
    held = _sieved(df.select("key", "pos", "tokens"), involved).join(involved, ["key", "pos"], "left_semi")
    left, right = (held.select("key", F.col("pos").alias(p), F.col("tokens").alias(f"t_{p}")) for p in ("earlier", "later"))
    scored = met.join(left, ["key", "earlier"]).join(right, ["key", "later"]).withColumn("similarity", jaccard(F.col("t_earlier"), F.col("t_later")))
    return scored.where(F.col("similarity") > threshold).select("key", "earlier", "later", "similarity")


def _candidates(held: DataFrame, threshold: float) -> DataFrame:
    """(key, earlier, later) of ``classes`` that may be similar, among them all that are.

    If tokens are dealt out to groups, the share of common ones in all is a weighted mean of the shares in the groups, so two sets with a
    Jaccard similarity above t are above t in one group at least. There they share a token among the first ``m - ceil(t m) + 1`` of
    each, whatever the order, and differ in less than (1 - t) / (1 + t) of their tokens, and in no more bits of a sketch that holds
    for 128 hash values whether the tokens with it are even or odd in number. All of that is asked in the join itself, so that sets which
    have but some words in common give no row. Both sets are cut as the larger one is.
    """
    each = held.select("key", "pos", "n", F.explode("groups").alias("g")).select("key", "pos", "n", F.col("g.cut").alias("cut"), "g.own", "g.m", "g.s0", "g.s1", F.explode("g.prefix").alias("token"))
    each = each.withColumn("at", F.xxhash64("key", "cut", "token"))
    a, b = (each.select("at", *(F.col(c).alias(f"{c}_{p}") for c in ("key", "pos", "n", "own", "m", "s0", "s1"))) for p in ("a", "b"))
    c = F.col
    alike = lambda x: F.least(f"{x}_a", f"{x}_b") >= threshold * F.greatest(f"{x}_a", f"{x}_b") - SLACK
    unlike = F.bit_count(c("s0_a").bitwiseXOR(c("s0_b"))) + F.bit_count(c("s1_a").bitwiseXOR(c("s1_b")))
    near = (c("pos_a") < c("pos_b")) & (c("key_a") == c("key_b")) & (c("own_a") | c("own_b")) & alike("n") & alike("m") & (unlike <= (c("m_a") + c("m_b")) * ((1 - threshold) / (1 + threshold)) + SLACK)
    return a.join(b, ["at"]).where(near).select(c("key_a").alias("key"), c("pos_a").alias("earlier"), c("pos_b").alias("later")).distinct()


def drop_similar(df: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Rows without any earlier similar row of their key: the first rows of classes without an earlier similar class, and rows without tokens."""
    cut = cut_up(df, threshold)
    later = _pairs(df, cut, threshold).select("key", F.col("later").alias("pos")).distinct()
    first = cut.where("_set is not null").groupBy("key", "_set").agg(F.min("pos").alias("pos")).select("key", "pos")
    kept = first.join(later, ["key", "pos"], "left_anti").unionByName(cut.where("n = 0").select("key", "pos"))
    return df.join(kept, ["key", "pos"], "left_semi")


def cap_per_signature(df: DataFrame, signature: list[str], position: str, n: int = PHRASINGS, exempt: Column | None = None) -> DataFrame:
    """The first ``n`` rows of each signature; exempt rows all stay."""
    place = F.row_number().over(Window.partitionBy(*signature).orderBy(position))
    keep = F.col("_place") <= n
    return df.withColumn("_place", place).where(keep if exempt is None else keep | exempt).drop("_place")


def greedy(df: DataFrame, threshold: float = THRESHOLD, phrasings: int = PHRASINGS) -> DataFrame:
    """``key, pos`` of rows ``key, pos, tokens, signature, exempt`` that the order-dependent rule keeps.

    Of the rows of a key with one token set, signature and exemption only the first can stay, so the others go at
    once. Of the rest only those are decided in turn whose set has a similar one or several signatures, or whose
    signature has more than ``phrasings`` rows; all others stay as they are. They are decided in rounds (``in_rounds``), over
    positions, set numbers and signatures, not over texts; no key is gathered in one task.
    """
    # a signature may be as long as its text, so it goes by its digest
    cut = cut_up(df, threshold, _digest(F.col("signature").cast("string")).alias("signature"), F.col("exempt"))
    pairs = settled(_pairs(df, cut, threshold))
    both = pairs.select("key", F.col("earlier").alias("cid"), F.col("later").alias("other")).unionByName(pairs.select("key", F.col("later").alias("cid"), F.col("earlier").alias("other")))
    similar = both.select("key", "cid").distinct().withColumn("_similar", F.lit(True))
    light = cut.select("key", "pos", "_set", "signature", "exempt")
    first = light.where("_set is not null").groupBy("key", "_set", "signature", "exempt").agg(F.min("pos").alias("pos"))
    variants = first.groupBy("key", "_set").agg(F.min("pos").alias("cid"), F.count("*").alias("variants"))
    first = first.join(variants, ["key", "_set"]).drop("_set").join(similar, ["key", "cid"], "left")
    # rows without tokens are like no other: they only count for their signature
    empty = light.where("_set is null").select("key", "pos", "signature", "exempt")
    counted = empty.withColumn("_place", F.row_number().over(Window.partitionBy("key", "signature", "exempt").orderBy("pos"))).where(F.col("_place") <= phrasings).drop("_place")
    spare = empty.where("exempt").join(counted, ["key", "pos"], "left_anti").select("key", "pos")
    rows = first.unionByName(counted, allowMissingColumns=True)
    crowded = rows.groupBy("key", "signature").agg(F.count("*").alias("_n")).where(F.col("_n") > phrasings).select("key", "signature", F.lit(True).alias("_crowded"))
    rows = rows.join(crowded, ["key", "signature"], "left")
    involved = F.col("_similar").isNotNull() | F.col("_crowded").isNotNull() | (F.coalesce(F.col("variants"), F.lit(1)) > 1)

    rows = settled(rows.withColumn("_involved", involved).select("key", "pos", "signature", "exempt", "cid", "_involved"))
    waiting = rows.where("_involved").drop("_involved")
    kept, _ = in_rounds(waiting, both, phrasings)
    return kept.union(rows.where("not _involved").select("key", "pos")).union(spare)


def in_rounds(rows: DataFrame, pairs: DataFrame, phrasings: int) -> tuple[DataFrame, int]:
    """``key, pos`` of what stays if rows are taken in order, and the number of rounds: the first independent set by position.

    ``rows(key, pos, signature, exempt, cid)`` and ``pairs(key, cid, other)``, both directions, of classes of rows (``cid``, null: alike to none). A
    row stays unless an earlier one of its class or of a paired class stays, or, if it is not exempt, ``phrasings`` earlier ones of its signature do.
    In a round every row is decided whose earlier neighbours are decided or that a kept one already rules out, so a round
    decides the first open row of every key, and mostly far more. Classes hand on two positions, signatures two.
    """
    by, n = ["key", "cid"], phrasings
    open_rows, kept, rounds = rows, None, 0
    near_to = pairs.select("key", "cid", "other").unionByName(rows.where("cid is not null").select("key", "cid", F.col("cid").alias("other")).distinct())
    near_to = settled(near_to)
    while not open_rows.isEmpty():
        rounds += 1
        seen = open_rows.select(*rows.columns, F.lit(False).alias("_kept"))
        if kept is not None:
            seen = seen.unionByName(kept.withColumn("_kept", F.lit(True)))
        of_class = seen.where("cid is not null").groupBy(*by).agg(F.min(F.when(F.col("_kept"), F.col("pos"))).alias("k"), F.min(F.when(~F.col("_kept"), F.col("pos"))).alias("u"))
        near = near_to.join(of_class.withColumnRenamed("cid", "other"), ["key", "other"]).groupBy(*by).agg(F.min("k").alias("k"), F.min("u").alias("u"))
        # the place of the last row that a signature can still hold: of kept ones, and of kept and open ones
        place = Window.partitionBy("key", "signature").orderBy("pos")
        full = [x.withColumn("_n", F.row_number().over(place)).where(F.col("_n") <= n).groupBy("key", "signature").agg(F.max(F.when(F.col("_n") == n, F.col("pos"))).alias(name)) for x, name in ((seen.where("_kept"), "sure"), (seen, "most"))]
        told = open_rows.join(near, by, "left").join(full[0], ["key", "signature"], "left").join(full[1], ["key", "signature"], "left")
        before = lambda c: F.coalesce(F.col(c) < F.col("pos"), F.lit(False))
        out = before("k") | (~F.col("exempt") & before("sure"))
        stays = ~before("u") & (F.col("exempt") | ~before("most"))
        told = settled(told.select(*rows.columns, F.when(out, "out").when(stays, "kept").otherwise("open").alias("_state")))
        new = told.where("_state = 'kept'").drop("_state")
        kept = new if kept is None else kept.unionByName(new)
        open_rows = told.where("_state = 'open'").drop("_state")
    return (rows.limit(0) if kept is None else kept).select("key", "pos"), rounds


def decontaminate(train: DataFrame, held_out: DataFrame, signature: str = "signature") -> DataFrame:
    """Training rows whose signature no held-out row has."""
    return train.join(held_out.select(signature).distinct(), signature, "left_anti")
