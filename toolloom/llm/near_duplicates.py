"""N-gram Jaccard join by MinHash banding.

Words are those of ``decontamination``; a document's set holds its runs of five words (one run of all its
words where it has fewer). Documents with equal sets form a class; only one row of a class goes on, so
copies never meet each other. Band and row counts follow from the target recall at the threshold; classes
whose sets agree in a band meet in a bucket.

Pairs of a bucket are sifted by sketches (a byte of each MinHash value): a pair goes on if as many bytes agree
as all but ``SIFT_LOSS`` of the pairs at the threshold have. The sieve hands on no pairs, only enough of them to
connect what they connect, so a bucket of m classes gives less than m rows. Their connected components are the
candidate groups, and every two sets of a candidate group are verified in full: as 0/1 matrices over the
shingles that the sets share, whose product counts common shingles exactly. A task of this hands on a row a
set: its number of links and the least set that it is joined to. Groups are the components of these links.

So a pair of sets at the threshold is lost only where no band and sketch catches it or a chain of pairs:
with 20 bands of 5 rows 0.0005 of the pairs at 0.8, and fewer above.

Plan: one pass writes rows with their digests, bands and sketches. Classes, buckets and sketches move as rows of
24 to 330 bytes; buckets with the very same members are looked at once. The text of a set that is in a candidate
group moves once, whatever its number of pairs, texts of other sets don't (a sieve of at most 16 MB keeps them back), and
sets move to their tasks as hashes. Large buckets and groups
are dealt to blocks by salt, two blocks a task, small ones are packed together, so no task and no row grows with a
group; the product of a group's pairs is work inside these tasks, not rows. Buckets and classes are counted by
partial aggregates and joined back, where adaptive execution splits hot keys.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from toolloom.llm import common
from toolloom.llm.decontamination import words_of

SHINGLE, THRESHOLD, RECALL, MAX_HASHES = 5, 0.8, 0.9995, 128
#: Share of the pairs at the threshold that the sketches may lose.
SIFT_LOSS = 1e-4
#: Classes of a block of a large bucket, and rows that small buckets are packed to.
BLOCK_CLASSES, PACK_ROWS = 2048, 1 << 15
#: Sets and shingles of a block of a large group, shingles that small groups are packed to, columns of a matrix.
BLOCK_SETS, BLOCK_SHINGLES, PACK_SHINGLES, COLUMNS = 2048, 1 << 19, 1 << 20, 4096
#: Links that one task joins to components; with more of them tasks do so for their shares, and rounds follow.
LOCAL_LINKS = 1 << 20
_C1, _C2, _C3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def banding(threshold: float = THRESHOLD, recall: float = RECALL, max_hashes: int = MAX_HASHES) -> tuple[int, int]:
    """(bands, rows): the most rows for which the bands that reach ``recall`` at ``threshold`` fit in ``max_hashes``."""
    best = None
    for rows in range(1, 33):
        p = threshold**rows
        bands = math.ceil(math.log(1 - recall) / math.log(1 - p)) if p < 1 else 1
        if bands * rows <= max_hashes:
            best = bands, rows
    if best is None:
        raise ValueError("no banding with so few hashes")
    return best


def sieve(hashes: int, threshold: float = THRESHOLD, loss: float = SIFT_LOSS) -> int:
    """The agreeing bytes of two sketches that a pair at ``threshold`` falls short of with a chance of ``loss`` at most."""
    p, below = threshold + (1 - threshold) / 256, 0.0
    for k in range(hashes + 1):
        below += math.comb(hashes, k) * p**k * (1 - p) ** (hashes - k)
        if below > loss:
            return k
    return hashes


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _C2
    x = (x ^ (x >> np.uint64(27))) * _C3
    return x ^ (x >> np.uint64(31))


class _Words(dict):
    """64-bit hashes of words; a worker keeps a bounded number of them."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_words = _Words()
common.cache("near_duplicates", _words.clear)


def shingles(text: str | None, n: int = SHINGLE) -> np.ndarray:
    """The sorted set of 64-bit hashes of a text's runs of ``n`` words."""
    words = words_of(text)
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    k = min(n, len(h))
    with np.errstate(over="ignore"):
        out = np.full(len(h) - k + 1, k, np.uint64)
        for i in range(k):
            out = _mix(out * _C1 + h[i : i + len(out)])
    return np.unique(out)


def set_digest(values: np.ndarray) -> tuple[int, int]:
    """128 bits of a set, as two signed 64-bit integers."""
    with np.errstate(over="ignore"):
        a, b = _mix(values + _C1).sum(dtype=np.uint64), _mix(values ^ _C2).sum(dtype=np.uint64)
        return int((a * _C2 + np.uint64(len(values))).astype(np.int64)), int(b.astype(np.int64))


def signature_seeds(hashes: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240229)
    return rng.integers(0, 1 << 32, hashes, np.uint64).astype(np.uint32) | np.uint32(1), rng.integers(0, 1 << 32, hashes, np.uint64).astype(np.uint32)


def signature(values: np.ndarray, seeds: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The MinHash signature of a set."""
    mult, add = seeds
    low = np.full(len(mult), 0xFFFFFFFF, np.uint32)
    high, base = (values >> np.uint64(32)).astype(np.uint32), values.astype(np.uint32)
    with np.errstate(over="ignore"):
        for i in range(0, len(values), 2048):
            x = high[i : i + 2048] * mult[:, None]
            x += base[i : i + 2048]
            x ^= x >> np.uint32(15)
            x *= add[:, None] | np.uint32(1)
            np.minimum(low, x.min(axis=1), out=low)
    return low


def band_hashes(low: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A 64-bit hash of each band of a signature."""
    with np.errstate(over="ignore"):
        out = np.arange(bands, dtype=np.uint64) + np.uint64(1)
        for r in low.reshape(bands, rows).T:
            out = _mix(out * _C1 + r)
    return out.view(np.int64)


def sketch(low: np.ndarray) -> bytes:
    """A byte of each value of a signature; not of its upper bits, which are small in all of them."""
    return _mix(low.astype(np.uint64) + _C1).astype(np.uint8).tobytes()


def joined(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The least member of the component of each of ``0..n-1`` under the edges ``a, b``."""
    low = np.arange(n)
    while True:
        x, y = low[a], low[b]
        if (x == y).all():
            return low
        np.minimum.at(low, np.maximum(x, y), np.minimum(x, y))
        while not (low[low] == low).all():
            low = low[low]


def _rows(docs: DataFrame, columns: list[str], bands: int, rows: int) -> DataFrame:
    """Table ``row, text, rid, h1, h2, n, bands, sketch``: ``row`` holds ``columns`` under their own names."""
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"), F.col("text").alias("text"))
    added = [("rid", T.LongType()), ("h1", T.LongType()), ("h2", T.LongType()), ("n", T.LongType()), ("bands", T.ArrayType(T.LongType())), ("sketch", T.BinaryType())]
    schema = T.StructType([packed.schema["row"], packed.schema["text"], *(T.StructField(*f) for f in added)])

    def sign(batches):
        from pyspark import TaskContext

        common.own_cache("near_duplicates")
        rid, seeds = TaskContext.get().partitionId() << 33, signature_seeds(bands * rows)
        for batch in batches:
            n, digests, found, sketches = [], [], [], []
            for text in batch.column("text").to_pylist():
                values = shingles(text)
                low = signature(values, seeds)
                n.append(len(values))
                digests.append(set_digest(values))
                found.append(band_hashes(low, bands, rows) if len(values) else [])
                sketches.append(sketch(low) if len(values) else None)
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("text"), pa.array(range(rid, rid + len(n)), pa.int64()), pa.array([d[0] for d in digests], pa.int64()), pa.array([d[1] for d in digests], pa.int64()), pa.array(n, pa.int64()), pa.array(found, pa.list_(pa.int64())), pa.array(sketches, pa.binary())], schema.names)
            rid += len(n)

    return common.written(packed.mapInArrow(sign, schema), "minhash-rows")


def _cells(members: DataFrame, name: str, blocks: Column, packs: int) -> DataFrame:
    """``members`` dealt to ``pack, cell, i, j``, the task's own block as ``own``: by packs where ``name`` has one block, else by two blocks of it."""
    one = F.col("_blocks") == 1
    dealt = members.withColumn("_blocks", blocks.cast("int")).withColumn("own", F.pmod(F.xxhash64("cid", name), F.col("_blocks")).cast("int"))
    dealt = dealt.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    return dealt.select(*members.columns, "own", F.when(one, F.pmod(F.xxhash64(name), F.lit(packs))).otherwise(-1).cast("int").alias("pack"), F.when(one, F.lit(0).cast("long")).otherwise(F.col(name)).alias("cell"), F.least("own", "_other").alias("i"), F.greatest("own", "_other").alias("j"))


def _segments(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of the runs of equal values."""
    begin = np.flatnonzero(np.append(True, values[1:] != values[:-1])) if len(values) else np.zeros(0, np.int64)
    return begin, np.append(begin[1:], len(values))


def _alike(x: np.ndarray, y: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of two matrices of sketches that agree in ``least`` bytes or more."""
    found = []
    for k in range(0, len(x), 1024):
        part = x[k : k + 1024]
        same = np.zeros((len(part), len(y)), np.uint8)
        for c in range(x.shape[1]):
            same += part[:, c, None] == y[None, :, c]
        a, b = np.nonzero(same >= least)
        found.append((a + k, b))
    return tuple(np.concatenate(f) for f in zip(*found, strict=True))


def _candidates(classes: DataFrame, threshold: float, hashes: int) -> DataFrame:
    """Links ``a, b`` that connect what shares a bucket and has like sketches."""
    least = sieve(hashes, threshold)
    keys = classes.select("cid", F.explode("bands").alias("key"))
    sized = keys.groupBy("key").agg(F.count("*").alias("m"), F.bit_xor(F.xxhash64("cid")).alias("x"), F.bit_xor(F.xxhash64("cid", F.lit(1))).alias("y")).where("m > 1")
    buckets = common.written(sized.groupBy("m", "x", "y").agg(F.min("key").alias("key")).select("key", "m"), "minhash-buckets")
    rows = buckets.agg(F.sum("m")).first()[0] or 0
    members = common.matched(keys, buckets, "key").join(classes.select("cid", "n", "sketch"), "cid")
    cells = _cells(members, "key", F.ceil(F.col("m") / BLOCK_CLASSES), -(-rows // PACK_ROWS) or 1)

    def sift(cell: pa.Table) -> pa.Table:
        key, cid, n, own = (cell.column(c).to_numpy() for c in ("key", "cid", "n", "own"))
        marks = np.frombuffer(b"".join(cell.column("sketch").to_pylist()), np.uint8).reshape(len(cid), hashes)
        i, j = cell.column("i")[0].as_py(), cell.column("j")[0].as_py()
        if i != j:
            left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
            a, b = _alike(marks[left], marks[right], least) if len(left) and len(right) else (np.zeros(0, np.int64),) * 2
            a, b = left[a], right[b]
        else:
            order = np.argsort(key, kind="stable")
            begin, end = _segments(key[order])
            two = begin[end - begin == 2]
            met = [np.stack((order[two], order[two + 1]))[:, (marks[order[two]] == marks[order[two + 1]]).sum(axis=1) >= least]]
            for p, q in zip(begin.tolist(), end.tolist(), strict=True):
                if q - p > 2:
                    rows = order[p:q]
                    met.append(rows[np.stack(_alike(marks[rows], marks[rows], least))])
            a, b = np.concatenate(met, axis=1)
        fits = (a != b) & (np.minimum(n[a], n[b]) >= threshold * np.maximum(n[a], n[b]) - 1e-9)
        ids, at = np.unique(cid, return_inverse=True)
        low = joined(at[a[fits]], at[b[fits]], len(ids))
        rest = np.flatnonzero(low != np.arange(len(ids)))
        return pa.table({"a": ids[low[rest]], "b": ids[rest]})

    return common.written(cells.groupBy("pack", "cell", "i", "j").applyInArrow(sift, "a long, b long"), "minhash-candidates")


def components(links: DataFrame) -> DataFrame:
    """``cid, root`` of every end of ``links(a, b)``: root is the least cid of its connected component.

    Tasks join the links that they hold in one go. Where one task holds them all, this is the answer; else
    large and small stars follow in turns until nothing changes.
    """

    def contract(batches):
        found = [(b.column("a").to_numpy(), b.column("b").to_numpy()) for b in batches if len(b)]
        if found:
            a, b = (np.concatenate(x) for x in zip(*found, strict=True))
            ids, at = np.unique(np.append(a, b), return_inverse=True)
            low = joined(at[: len(a)], at[len(a) :], len(ids))
            rest = np.flatnonzero(low != np.arange(len(ids)))
            yield pa.RecordBatch.from_arrays([pa.array(ids[rest]), pa.array(ids[low[rest]])], ["a", "b"])

    def contracted(edges: DataFrame, n: int) -> DataFrame:
        parts = -(-n // LOCAL_LINKS)
        dealt = edges.select("a", "b").repartition(parts, F.least("a", "b")) if parts > 1 else edges.select("a", "b").coalesce(1)
        return common.written(dealt.mapInArrow(contract, "a long, b long"), "minhash-edges")

    links = links.select("a", "b").where("a <> b")
    n, last = links.count(), None
    while True:
        edges = contracted(links, n)
        if n > LOCAL_LINKS:
            # large star: neighbours greater than the node go to the least of its neighbourhood
            both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
            least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
            edges = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")).where("a <> b").distinct()
            # small star: smaller neighbours and the node itself go to the least of them
            least = edges.groupBy("a").agg(F.min("b").alias("low"))
            edges = edges.join(least, "a").where("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b")).union(least.select("a", F.col("low").alias("b"))).distinct()
            edges = common.written(edges, "minhash-edges")
            state = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
            if state != last:
                links, n, last = edges, state["n"], state
                continue
        return edges.select(F.col("a").alias("cid"), F.col("b").alias("root")).union(edges.select("b", "b").distinct())


def linked(x: list[np.ndarray], y: list[np.ndarray] | None, threshold: float) -> np.ndarray:
    """Which sets of ``x`` (rows) have a link to which of ``y`` (columns), or to others of ``x`` without ``y``."""
    sizes = [np.array([len(v) for v in side], np.int64) for side in (x, x if y is None else y)]
    flat = [np.concatenate(side) for side in (x, x if y is None else y)]
    if y is None:
        shared, times = np.unique(flat[0], return_counts=True)
        shared = shared[times > 1]
    else:
        shared = np.intersect1d(*flat)
    cells = []
    for values, size in zip(flat, sizes, strict=True):
        at = np.searchsorted(shared, values)
        hit = np.flatnonzero(np.append(shared, np.uint64(0))[at] == values) if len(shared) else np.zeros(0, np.int64)
        hit = hit[at[hit] < len(shared)]
        order = np.argsort(at[hit], kind="stable")
        cells.append((np.repeat(np.arange(len(size)), size)[hit][order], at[hit][order]))
    both = np.zeros((len(sizes[0]), len(sizes[1])), np.float32)  # whole numbers below 2**24, so exact
    for low in range(0, len(shared), COLUMNS):
        parts = []
        for (row, at), size in zip(cells, sizes, strict=True):
            a, b = np.searchsorted(at, (low, low + COLUMNS))
            part = np.zeros((len(size), min(COLUMNS, len(shared) - low)), np.float32)
            part[row[a:b], at[a:b] - low] = 1
            parts.append(part)
        both += parts[0] @ parts[1].T
    both = both.astype(np.float64)
    out = both / (sizes[0][:, None] + sizes[1][None, :] - both) >= threshold - 1e-12
    if y is None:
        np.fill_diagonal(out, False)
    return out


def _verified(table: DataFrame, classes: DataFrame, candidates: DataFrame, threshold: float) -> DataFrame:
    """``cid, root, n_links`` of the classes in candidate groups, every two sets of a group compared in full."""
    roots = components(candidates).join(classes.select("cid", "n"), "cid")
    roots = common.written(roots, "minhash-candidate-roots")
    sizes = roots.groupBy("root").agg(F.count("*").alias("sets"), F.sum("n").alias("shingles"))
    total = roots.agg(F.sum("n")).first()[0] or 0
    placed = common.written(roots.select("cid", "root").join(sizes, "root"), "minhash-placed")

    def sets(batches):
        common.own_cache("near_duplicates")
        for batch in batches:
            found = pa.array([shingles(t).tobytes() for t in batch.column("text").to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("cid", "root", "sets", "shingles")), found], ["cid", "root", "sets", "shingles", "held"])

    texts = common.matched(table.select(F.col("rid").alias("cid"), "text"), placed.select("cid", "root", "sets", "shingles"), "cid").select("cid", "root", "sets", "shingles", "text")
    held = texts.mapInArrow(sets, "cid long, root long, sets long, shingles long, held binary")
    cells = _cells(held, "root", F.ceil(F.greatest(F.col("sets") / BLOCK_SETS, F.col("shingles") / BLOCK_SHINGLES)), -(-total // PACK_SHINGLES) or 1)

    def compare(cell: pa.Table) -> pa.Table:
        cid, root, own = (cell.column(c).to_numpy() for c in ("cid", "root", "own"))
        found = [np.frombuffer(v, np.uint64) for v in cell.column("held").to_pylist()]
        i, j, pack = (cell.column(c)[0].as_py() for c in ("i", "j", "pack"))
        n, low = np.zeros(len(cid), np.int64), cid.copy()
        if i != j:
            parts = [(np.flatnonzero(own == i), np.flatnonzero(own == j))]
        else:
            order = np.argsort(root, kind="stable")
            parts = [(order[p:q], None) for p, q in zip(*_segments(root[order]), strict=True)]
        for x, y in parts:
            if not len(x) or (y is not None and not len(y)):
                continue
            met = linked([found[r] for r in x], None if y is None else [found[r] for r in y], threshold)
            n[x] = met.sum(axis=1)
            if y is not None:
                n[y] = met.sum(axis=0)
            a, b = np.nonzero(met)
            rows = x if y is None else np.concatenate((x, y))
            rank = np.argsort(np.argsort(cid[rows]))  # so that the least place is the least cid
            at = joined(rank[a], rank[b if y is None else b + len(x)], len(rows))
            low[rows] = np.sort(cid[rows])[at[rank]]
        return pa.table({"cid": cid, "low": low, "n_links": n, "whole": np.full(len(cid), pack >= 0)})

    found = common.written(cells.groupBy("pack", "cell", "i", "j").applyInArrow(compare, "cid long, low long, n_links long, whole boolean"), "minhash-found")
    known = found.where("whole").select("cid", F.col("low").alias("root"), "n_links")
    parts = found.where("not whole")
    if parts.isEmpty():
        return known
    over = common.written(components(parts.select(F.col("low").alias("a"), F.col("cid").alias("b"))), "minhash-roots")
    parts = parts.groupBy("cid").agg(F.sum("n_links").alias("n_links")).join(over, "cid", "left")
    return known.union(parts.select("cid", F.coalesce("root", "cid"), "n_links"))


def _grouped(docs: DataFrame, columns: list[str], threshold: float, recall: float) -> tuple[DataFrame, DataFrame]:
    """The table of rows, and ``rid, doc_id, root, n_links`` of each."""
    bands, rows = banding(threshold, recall)
    with common.scratch(docs.sparkSession) as held:
        table = _rows(docs, columns, bands, rows)
        classes = table.groupBy("h1", "h2").agg(F.min("rid").alias("cid"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"))
        classes = common.written(classes, "minhash-classes")
        known = _verified(table, classes, _candidates(classes.where("n > 0"), threshold, bands * rows), threshold)
        named = classes.select("h1", "h2", "cid").join(known, "cid", "left").select("h1", "h2", F.coalesce("root", "cid").alias("root"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"))
        members = table.select("rid", F.col("row.doc_id").alias("doc_id"), "h1", "h2").join(named, ["h1", "h2"])
        members = common.written(members.drop("h1", "h2"), "minhash-members")
        held.keep(table, members)
    return table, members


def groups(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """``doc_id, class_id, n_links`` for each row of ``docs(doc_id, text, ...)``.

    ``class_id`` is the least doc_id of the group (documents with equal sets, joined by links of at least
    ``threshold`` between different sets); ``n_links`` is the number of other sets of its candidate group that
    the document's set has a link to, whatever the group's size. Null and empty texts have the empty set and
    are one group. Null doc_ids stay rows; a group without any doc_id gets ``-1 - row number``. Repeated rows and
    ids stay rows. An empty table gives no rows; other columns don't matter.
    """
    _, members = _grouped(docs, ["doc_id"], threshold, recall)
    named = members.groupBy("root").agg(F.min("doc_id").alias("least_id")).select("root", F.coalesce("least_id", -1 - F.col("root")).alias("class_id"))
    return members.join(named, "root").select("doc_id", "class_id", "n_links")


def keep_one(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """The rows of ``docs(doc_id, text, ...)`` with the least doc_id of each group of ``groups``; same columns.

    Of equal ids the first row stays, null ids come last; so of all rows with null or empty text one stays. An
    empty table gives no rows. Only texts whose row may go (by a sieve of the rows that do) are joined with them.
    """
    table, members = _grouped(docs, docs.columns, threshold, recall)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rid")).alias("first")
    several = members.groupBy("root").agg(first, F.count("*").alias("rows")).where("rows > 1").select("root", F.col("first.rid").alias("kept"))
    gone = common.written(members.join(several, "root").where("rid <> kept").select("rid"), "minhash-gone")
    marked = common.with_mark(table.select("rid", "row"), "rid", gone, "_may")
    return marked.where("not _may").unionByName(marked.where("_may").join(gone, "rid", "left_anti")).select("row.*")
