"""Quality classifier: a generalised additive model with pairwise interactions.

Each feature has bins at quantiles and a lookup table of log odds; chosen pairs of features have
two-dimensional tables. The tables are learnt by cyclic boosting: round by round, every feature in turn
gets a small step of a shallow tree (three leaves) grown on its histogram of gradients; then the
pairs with the largest gain on what is left get trees of two crossed cuts. A document's score is a
sum of table entries, one vectorised bin addition a feature and pair.

The model is fitted on at most ``SAMPLE`` labelled rows (those with the least hash of their id), on the
driver; features are read from every whole text in one pass without a shuffle, and so are scores.
"""

from __future__ import annotations

import itertools
import math
import operator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from toolloom.llm import common

#: Labelled rows that the model is fitted on, at most.
SAMPLE = 20_000
BINS, PAIR_BINS, PAIRS = 32, 8, 6
ROUNDS, PAIR_ROUNDS, RATE, RIDGE = 120, 60, 0.1, 5.0

FEATURES = ["log_words", "word_length", "upper", "digits", "symbols", "exclaims", "pipes", "stops", "high_bytes", "repeats", "distinct", "line_words", "same_lines", "open_lines", "log_longest", "odd_words"]

_CLASSES = np.zeros((256, 7), np.float64)
for _k, _chars in enumerate(["ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "#$%&*+/<=>@[\\]^_`{}~\"()", "!?", "|", ".,;:"]):
    _CLASSES[[ord(c) for c in _chars], _k] = 1
_CLASSES[128:, 6] = 1


def features(text: str | None) -> list[float]:
    """The features of one whole text; an empty text has zeros."""
    text = text or ""
    words = text.split()
    if not words:
        return [0.0] * len(FEATURES)
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    n, letters = len(words), max(1, len(raw))
    lines = [x for x in text.split("\n") if x.strip()]
    shares = (np.bincount(raw, minlength=256) @ _CLASSES / letters).tolist()
    repeats = sum(map(operator.eq, words, itertools.islice(words, 1, None))) / n
    longest = max(map(len, words))
    return [
        math.log1p(n), sum(map(len, words)) / n, *shares, repeats, len(set(words)) / n, n / len(lines),
        1 - len(set(lines)) / len(lines), sum(x.rstrip()[-1] not in ".!?:;\"" for x in lines) / len(lines),
        math.log1p(longest), sum(not w[0].isalpha() or not w[-1].isalpha() for w in words) / n,
    ]


def _best_steps(gradient: np.ndarray, hessian: np.ndarray) -> np.ndarray:
    """Steps for the bins of one feature: the three-leaf tree with the largest gain."""
    g, h = np.cumsum(gradient), np.cumsum(hessian)

    def gain(a, b):
        return a * a / (b + RIDGE)

    size = len(g)
    if size == 1:
        return np.array([-g[0] / (h[0] + RIDGE)])
    i, j = np.triu_indices(size, 1)  # leaves (..i], (i..j], (j..]; j = size - 1 leaves two
    total = gain(g[i], h[i]) + gain(g[j] - g[i], h[j] - h[i]) + gain(g[-1] - g[j], h[-1] - h[j])
    k = int(np.argmax(total))
    i, j = int(i[k]), int(j[k])
    out = np.empty(size)
    out[: i + 1] = -g[i] / (h[i] + RIDGE)
    out[i + 1 : j + 1] = -(g[j] - g[i]) / (h[j] - h[i] + RIDGE)
    out[j + 1 :] = -(g[-1] - g[j]) / (h[-1] - h[j] + RIDGE)
    return out


def _best_crossed(gradient: np.ndarray, hessian: np.ndarray) -> tuple[float, np.ndarray]:
    """Gain and steps of the best two crossed cuts of a pair's histogram."""
    g, h = gradient.cumsum(0).cumsum(1), hessian.cumsum(0).cumsum(1)
    a, b = g[:-1, :-1], h[:-1, :-1]
    corners = [(a, b), (g[:-1, -1:] - a, h[:-1, -1:] - b), (g[-1:, :-1] - a, h[-1:, :-1] - b)]
    corners.append((g[-1, -1] - sum(x for x, _ in corners), h[-1, -1] - sum(y for _, y in corners)))
    total = sum(x * x / (y + RIDGE) for x, y in corners)
    i, j = np.unravel_index(int(np.argmax(total)), total.shape)
    out = np.empty(gradient.shape)
    for (rows, cols), (x, y) in zip(itertools.product((slice(0, i + 1), slice(i + 1, None)), (slice(0, j + 1), slice(j + 1, None))), corners, strict=True):
        out[rows, cols] = -x[i, j] / (y[i, j] + RIDGE)
    return float(total[i, j]), out


class AdditiveModel:
    """Lookup tables of features and pairs; ``score`` adds them up."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        rate = (y.sum() + 1) / (len(y) + 2)
        self.base = math.log(rate / (1 - rate))
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) if len(c) else np.zeros(0) for c in x.T]
        self.coarse = [np.unique(np.quantile(c, np.linspace(0, 1, PAIR_BINS + 1)[1:-1])) if len(c) else np.zeros(0) for c in x.T]
        self.tables = [np.zeros(len(e) + 1) for e in self.edges]
        self.pairs: list[tuple[int, int, np.ndarray]] = []
        if 0 < y.sum() < len(y):
            self._fit(x, y)

    def _fit(self, x: np.ndarray, y: np.ndarray) -> None:
        logit = np.full(len(y), self.base)
        bins = self._bins(x, self.edges)
        for _ in range(ROUNDS):
            for k, b in enumerate(bins):
                p = 1 / (1 + np.exp(-logit))
                step = RATE * _best_steps(np.bincount(b, p - y, len(self.tables[k])), np.bincount(b, p * (1 - p), len(self.tables[k])))
                self.tables[k] += step
                logit += step[b]
        bins = self._bins(x, self.coarse)
        wide = [k for k, e in enumerate(self.coarse) if len(e)]

        def crossed(i, j):
            p, shape = 1 / (1 + np.exp(-logit)), (len(self.coarse[i]) + 1, len(self.coarse[j]) + 1)
            at, size = bins[i] * shape[1] + bins[j], shape[0] * shape[1]
            return at, *_best_crossed(np.bincount(at, p - y, size).reshape(shape), np.bincount(at, p * (1 - p), size).reshape(shape))

        ranked = sorted(((crossed(i, j)[1], i, j) for i, j in itertools.combinations(wide, 2)), reverse=True)
        chosen = {(i, j): 0.0 for _, i, j in ranked[:PAIRS]}
        for _ in range(PAIR_ROUNDS):
            for i, j in chosen:
                at, _, step = crossed(i, j)
                chosen[i, j] = chosen[i, j] + RATE * step
                logit += RATE * step.reshape(-1)[at]
        self.pairs = [(i, j, t) for (i, j), t in chosen.items()]

    @staticmethod
    def _bins(x: np.ndarray, edges: list[np.ndarray]) -> list[np.ndarray]:
        return [np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T, strict=True)]

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for rows of features."""
        x = np.nan_to_num(np.asarray(x, np.float64).reshape(-1, len(self.edges)))
        logit = np.full(len(x), self.base)
        for t, b in zip(self.tables, self._bins(x, self.edges), strict=True):
            logit += t[b]
        coarse = self._bins(x, self.coarse) if self.pairs else []
        for i, j, t in self.pairs:
            logit += t[coarse[i], coarse[j]]
        return 1 / (1 + np.exp(-np.clip(logit, -500, 500)))


def fold(doc_id: Column) -> Column:
    """``crc32(doc_id as text) mod 4``; null ids count as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4


HELD_OUT = 2


def _featured_texts(texts: list[str | None]) -> np.ndarray:
    return np.array([features(x) for x in texts], np.float64).reshape(-1, len(FEATURES))


def _featured(batch: pa.RecordBatch, column: str) -> np.ndarray:
    return _featured_texts(batch.column(batch.schema.names.index(column)).to_pylist())


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> AdditiveModel:
    """The model of ``labels(doc_id, quality)`` outside the held-out fold, on ``docs(doc_id, text)``.

    Ids that are labelled several times take the least label, of documents with one id the shortest is learnt from;
    null ids or labels, and labels other than 0 and 1, don't count. Without labelled rows every score is 0.5.
    """
    usable = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & (fold(F.col("doc_id")) != HELD_OUT))
    chosen = usable.groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    schema = f"quality int, {', '.join(f'{c} double' for c in FEATURES)}"

    def read(batches):
        common.own_cache("quality")
        for batch in batches:
            x = _featured(batch, "text")
            yield pa.RecordBatch.from_arrays([batch.column("quality"), *(pa.array(c) for c in x.T)], ["quality", *FEATURES])

    # the sample is bounded, so its ids and labels are: some hundred kilobytes
    labelled = docs.select("doc_id", common.text_or_empty().alias("text")).join(F.broadcast(chosen), "doc_id")
    first = F.min_by(F.struct("quality", "text"), F.struct(F.octet_length("text"), F.xxhash64("text"), "text")).alias("r")  # of the texts of one id the shortest
    rows = labelled.groupBy("doc_id").agg(first).select("r.quality", "r.text").mapInArrow(read, schema).toPandas()
    return AdditiveModel(rows[FEATURES].to_numpy(np.float64), rows["quality"].to_numpy(np.float64))


def with_scores(docs: DataFrame, model: AdditiveModel, name: str) -> DataFrame:
    """``docs`` with the score in a new column ``name``."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # some kilobytes

    def add(batches):
        common.own_cache("quality")
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(held.value.score(_featured(batch, "text")))], [*batch.schema.names, name])

    from pyspark.sql import types as T

    return docs.mapInArrow(add, T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())]))


def scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, sample: int = SAMPLE) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for each row of ``docs(doc_id, text, ...)``.

    Null text counts as empty and is scored like it; null or repeated doc_ids stay rows of their own; an
    empty table gives no rows; other columns are not read.
    """
    out = with_scores(docs.select("doc_id", "text"), fit(docs, labels, sample), "score")
    return out.select("doc_id", (fold(F.col("doc_id")) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, sample: int = SAMPLE) -> DataFrame:
    """The rows of ``docs`` that score ``threshold`` or more, same columns.

    Null and empty texts are scored like any other; null or repeated doc_ids stay rows of their own; an empty table
    gives no rows; a column that is named ``score`` stays as it is.
    """
    (name,) = common.fresh_names(docs, "score")
    return with_scores(docs, fit(docs, labels, sample), name).where(F.col(name) >= threshold).drop(name)
