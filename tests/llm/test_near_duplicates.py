import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from toolloom.llm import near_duplicates as nd


def brute(rows):
    """doc_id -> (class_id, links to other sets) by comparing all sets."""
    sets = {i: frozenset(nd.shingles(t).tolist()) for i, (_, t) in enumerate(rows)}
    distinct = list(dict.fromkeys(sets.values()))
    root = list(range(len(distinct)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    links = Counter()
    for i, a in enumerate(distinct):
        for j in range(i):
            b = distinct[j]
            if a and b and len(a & b) >= 0.8 * len(a | b):
                links[a] += 1
                links[b] += 1
                root[find(i)] = find(j)
    at = {s: k for k, s in enumerate(distinct)}
    least = defaultdict(lambda: 1 << 60)
    for i, (doc_id, _) in enumerate(rows):
        r = find(at[sets[i]])
        least[r] = min(least[r], doc_id)
    return sorted((doc_id, least[find(at[sets[i]])], links[sets[i]]) for i, (doc_id, _) in enumerate(rows))


def texts(seed, near, other):
    """A large group of near copies with some at the rim, and unlike texts."""
    rng = random.Random(seed)
    base = [f"w{rng.randrange(5000)}" for _ in range(150)]
    out = []
    for _ in range(near):
        words = list(base)
        for _ in range(rng.randrange(4)):
            words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
        out.append(" ".join(words))
    for _ in range(other):
        out.append(" ".join(f"w{rng.randrange(5000)}" for _ in range(rng.randrange(1, 60))))
    return out


def test_banding_reaches_recall():
    bands, rows = nd.banding(0.8, 0.9995)
    assert 1 - (1 - 0.8**rows) ** bands >= 0.9995 and bands * rows <= nd.MAX_HASHES


def test_groups_equal_brute_force(spark):
    rows = list(enumerate(texts(1, 60, 60) + ["", "one two", "One  TWO.", "one two three"]))
    rows += [(1000 + i, t) for i, t in enumerate(texts(1, 5, 0))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(map(tuple, nd.groups(df).collect())) == brute(rows)


def test_blocks_and_packs_change_nothing(spark, monkeypatch):
    rows = list(enumerate(texts(4, 250, 30) + texts(5, 3, 0) + texts(6, 12, 3)))
    want = brute(rows)
    assert max(links for *_, links in want) > 150
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(map(tuple, nd.groups(df).collect())) == want
    for name, value in {"BLOCK_CLASSES": 20, "PACK_ROWS": 100, "BLOCK_SETS": 60, "PACK_SHINGLES": 5000, "COLUMNS": 50, "LOCAL_LINKS": 40}.items():
        monkeypatch.setattr(nd, name, value)
    assert sorted(map(tuple, nd.groups(df).collect())) == want
    kept = {r["doc_id"] for r in nd.keep_one(df).collect()}
    assert kept == {c for _, c, _ in want}


def test_unlike_texts_of_one_bucket_are_sifted(spark):
    rng = random.Random(9)
    shared = " ".join(f"w{rng.randrange(5000)}" for _ in range(100))
    rows = [(i, shared + " " + " ".join(f"v{rng.randrange(10**6)}" for _ in range(90))) for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, nd.groups(df).collect())) == brute(rows) == [(i, i, 0) for i in range(120)]


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(100, 101)], "a long, b long")
    got = {r["cid"]: r["root"] for r in nd.components(links).collect()}
    assert got == {**dict.fromkeys(range(31), 0), 100: 100, 101: 100}


def test_components_in_rounds_equal_those_of_one_task(spark, monkeypatch):
    rng = random.Random(3)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 7) for i in range(400, 500)]
    links = spark.createDataFrame(pairs, "a long, b long")
    whole = sorted(map(tuple, nd.components(links).collect()))
    monkeypatch.setattr(nd, "LOCAL_LINKS", 30)
    assert sorted(map(tuple, nd.components(links).collect())) == whole
    assert nd.components(links.limit(0)).count() == 0


def test_nulls_ties_empty_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, None, "a"), (None, "", "b"), (1, "x y z", None), (1, "x y z", None), (7, "q " * 5000, "c")], "doc_id long, text string, rid string")
    got = sorted(map(tuple, nd.groups(df).collect()), key=repr)
    assert got == sorted([(1, 1, 0), (None, 1, 0), (1, 1, 0), (1, 1, 0), (7, 7, 0)], key=repr)
    kept = nd.keep_one(df)
    assert kept.columns == df.columns and kept.count() == 3
    empty = df.limit(0)
    assert nd.groups(empty).count() == 0 and nd.keep_one(empty).count() == 0


@pytest.mark.parametrize("similarity", [0.8, 0.9])
def test_recall_of_banding_and_sketches(similarity):
    bands, rows = nd.banding()
    hashes = bands * rows
    seeds, least = nd.signature_seeds(hashes), nd.sieve(hashes)
    rng, met, n = np.random.default_rng(3), 0, 600
    for _ in range(n):
        both = round(200 * 2 * similarity / (1 + similarity))
        a = rng.integers(0, 1 << 63, 200).astype(np.uint64)
        b = np.append(a[:both], rng.integers(0, 1 << 63, 200 - both).astype(np.uint64))
        x, y = nd.signature(a, seeds), nd.signature(b, seeds)
        alike = sum(p == q for p, q in zip(nd.sketch(x), nd.sketch(y), strict=True)) >= least
        met += alike and bool((nd.band_hashes(x, bands, rows) == nd.band_hashes(y, bands, rows)).any())
    assert met >= 0.995 * n


def test_recall_end_to_end(spark):
    """Pairs just at the threshold, each a group of its own, are found nearly always."""
    rng = random.Random(12)
    rows = []
    for i in range(300):
        words = [f"w{rng.randrange(10**6)}" for _ in range(184)]
        other = list(words)
        for k in rng.sample(range(4), 1) + [60, 110, 160]:  # four changed words: 20 of 180 runs
            other[k + 5] = f"x{rng.randrange(10**6)}"
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(other))]
    want = brute(rows)
    assert all(links == 1 for *_, links in want)
    got = {r["doc_id"]: r["class_id"] for r in nd.groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert np.mean([got[d] == c for d, c, _ in want]) >= 0.99


def test_sieve_is_the_quantile():
    rng = np.random.default_rng(1)
    agree = rng.binomial(100, 0.8 + 0.2 / 256, 400_000)
    assert (agree < nd.sieve(100)).mean() <= 2e-4 < (agree < nd.sieve(100) + 3).mean()
