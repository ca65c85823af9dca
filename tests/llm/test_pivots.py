import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from toolloom.llm import pivots as P


def by_loop(rows, k, scale=1024, each=3):
    dims = [len(e) for i, e in rows if i is not None and e and all(x is not None and math.isfinite(x) for x in e)]
    dim = max(sorted(set(dims)), key=dims.count, default=0)
    held = [(i, [math.floor(scale * x) for x in e]) for i, e in rows if i is not None and e and len(e) == dim and all(x is not None and math.isfinite(x) for x in e)]
    out = []
    for i, q in held:
        if i % each == 0:
            scores = sorted((-max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(q, x, strict=True)))), j) for j, x in held if j != i)
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scores[:k])]
    return sorted(out)


def found(spark, rows, k=4, kind="double", **more):
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>").repartition(3)
    return sorted(map(tuple, P.search(df, F.col("vec_id") % 3 == 0, k=k, **more).collect()))


@pytest.mark.parametrize("seed", range(3))
def test_agrees_with_all_pairs(spark, seed, monkeypatch):
    monkeypatch.setattr(P, "BLOCK", 16 * 8)  # blocks of 16
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, 8))
    x = centres[rng.integers(6, size=400)] + rng.normal(size=(400, 8)) * (0.05, 0.5, 3)[seed]
    x[50:130] = x[50]  # one vector for a fifth
    x[200:240] = np.round(x[200:240])  # ties
    rows = [(int(i), [float(v) for v in e]) for i, e in zip(rng.permutation(400), x, strict=True)]
    assert found(spark, rows, lot_bytes=4096) == by_loop(rows, 4)


def test_blocks_and_bounds_skip_work():
    rng = np.random.default_rng(1)
    x = np.floor(1024 * (np.repeat(rng.normal(size=(8, 16)), 250, axis=0) + rng.normal(size=(2000, 16)) * 0.02))
    pivots = P.choose(x)
    d, norms = P.distances(x, pivots), (x * x).sum(axis=1)
    scored = 0
    for i in range(0, 2000, 100):
        bound = P.upper(norms[i], norms, np.abs(d - d[i]).max(axis=1))
        assert (bound >= x @ x[i]).all()
        best = P.Best(10, P.LOWEST)
        scored += P._evaluate(best, x[i], x, np.arange(2000), bound, None)
        assert best.score.tolist() == sorted((x @ x[i]).astype(int).tolist(), reverse=True)[:10]
    assert scored < 0.3 * 20 * 2000  # of all pairs


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (1, [nan, 1.0]), (2, [inf, 1.0]), (3, None), (4, [None, 1.0]), (5, [0.0, 0.0]), (6, [-1e-20, 3.0]), (7, [5.0]), (None, [1.0, 1.0]), (8, []), (9, [1.0, 2.0]), (9, [1.0, 2.0]), (10, [1.0, 2.0]), (12, [-4.0, 0.5])]
    assert found(spark, rows) == by_loop(rows, 4)
    # repeated rows ask and answer as often as they are there
    rows = [(0, [1.0, 1.0]), (3, [2.0, 1.0]), (3, [0.5, 9.0]), (3, [2.0, 1.0]), (4, [2.0, 1.0]), (5, [9.0, 9.0])]
    got, want = found(spark, rows, k=9), by_loop(rows, 9)
    assert len(got) == len(want) and [g[0] for g in got] == [w[0] for w in want] and {g[2:] for g in got} == {w[2:] for w in want}


def test_large_numbers_stay_exact(spark):
    rng = random.Random(2)
    rows = [(i, [rng.choice([1e6, 3e7, -2e6, 1e12, 0.25]) * rng.random() for _ in range(5)]) for i in range(60)] + [(60, [1e300, 1.0, 0.0, 0.0, 0.0]), (61, [-1e300, 1.0, 0.0, 0.0, 0.0])]
    assert found(spark, rows) == by_loop(rows, 4)


def test_empty_tables(spark):
    assert found(spark, []) == [] and found(spark, [(1, None), (3, [])]) == []
    assert found(spark, [(0, [1.0])]) == []
    assert found(spark, [(0, [0.5]), (1, [0.25])], kind="float") == [(0, 1, 1, 512 * 256)]
