import hashlib
import random
import zlib

from hypothesis import given, settings
from hypothesis import strategies as st

from toolloom.llm import runs as R


def by_loop(words):
    """All runs from every period and place."""
    n, out = len(words), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(6, 4 * q) and j > i:
                out.setdefault((i, j + q), q)
            i = j + 1
    return sorted(((s, t, q) for (s, t), q in out.items()), key=lambda r: (r[0], r[2]))


def told(words, doc_id, plant):
    n = len(words)
    if plant and doc_id is not None and n and (h := zlib.crc32(str(doc_id).encode())) % 10 == 0:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    held = by_loop(words)
    best = None
    for s, t, q in held:  # in order, so of equal ones the first stays
        if best is None or (t - s) * best[2] > (best[1] - best[0]) * q:
            best = (s, t, q)
    gone = {i for s, t, q in held for i in range(s + q, t)}
    top = (best[0], best[1] - best[0], best[2], 1000 * (best[1] - best[0]) // best[2]) if best else (None,) * 4
    lines = "".join(f"{s},{t - s},{q}\n" for s, t, q in held)
    return (len(held), *top, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(" ".join(w for i, w in enumerate(words) if i not in gone).encode()).hexdigest())


def made(rng, most=80, letters=4):
    words = [f"w{rng.randrange(rng.randint(1, letters))}" for _ in range(rng.randint(0, most))]
    for _ in range(rng.randint(0, 4)):
        if words:
            a, p = rng.randrange(len(words)), rng.randint(1, 6)
            words[a:a] = words[a : a + p] * rng.randint(2, 7)
    return words


@settings(max_examples=500, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=60))
def test_small_alphabets(word):
    assert R.runs(word) == by_loop(word)


def test_random_repetitions():
    rng = random.Random(1)
    for _ in range(2000):
        words = made(rng)
        names = {w: i for i, w in enumerate(dict.fromkeys(words))}
        assert R.runs([names[w] for w in words]) == by_loop(words)


def test_factors_are_the_longest_that_occurred_before():
    rng = random.Random(2)
    for _ in range(300):
        word = [rng.randrange(3) for _ in range(rng.randint(0, 40))]
        at = 0
        for start, end, before in R.factors(word):
            longest = max((next((k for k in range(len(word) - start) if word[p + k] != word[start + k]), len(word) - start) for p in range(start)), default=0)
            assert start == at and end - start == max(1, longest)
            assert before < 0 if not longest else before < start and word[before : before + longest] == word[start:end]
            at = end
        assert at == len(word)


def test_the_sieve_loses_nothing():
    rng = random.Random(3)
    for _ in range(400):
        texts = [[w.encode() for w in made(rng)] for _ in range(rng.randint(0, 8))]
        assert R.found_in(texts) == [by_loop(t) for t in texts]


def test_a_very_long_text():
    rng = random.Random(4)
    words = [b"%d" % rng.randrange(5000) for _ in range(60000)]
    text = words[:20000] + words[5000:15000] * 9 + [b"x"] * 20000 + words
    held = R.found_in([text])[0]
    assert (20000 - 5000 + 5000, 110000, 10000) in held or any(q == 10000 and t - s >= 90000 for s, t, q in held)
    assert any(q == 1 and t - s == 20000 for s, t, q in held) and len(R.collapsed(text, held)) < 20000 + 10001 + 1 + 60001


def test_report_agrees_with_loops(spark):
    rng = random.Random(5)
    gaps = [" ", "  ", "\t", "\n", "\r\n", " \x0b", "\x0c "]
    rows = [(i, "".join(w + rng.choice(gaps) for w in made(rng))) for i in range(300)]
    rows += [(None, "a b " * 6), (1, None), (2, ""), (3, " \n "), (4, "é\xa0é " * 9), (4, "é\xa0é " * 9), (5, "x\x85 " * 7)]
    df = spark.createDataFrame([(*r, 1, "k") for r in rows], "doc_id long, text string, n_runs int, start string").repartition(4)
    for plant in (False, True):
        found = sorted((tuple(r) for r in R.report(df, plant).collect()), key=repr)
        import re

        wanted = sorted(((i, *told(re.findall(r"[^\x20\x09-\x0D]+", t or ""), i, plant)) for i, t in rows), key=repr)
        assert found == wanted


def test_collapse_keeps_the_rest(spark):
    df = spark.createDataFrame([(1, "go " * 8 + "home", "x"), (2, "as  it was", "y"), (3, None, "z")], "doc_id long, text string, row string")
    assert sorted(map(tuple, R.collapse(df).collect())) == [(1, "go home", "x"), (2, "as  it was", "y"), (3, None, "z")]
    assert R.collapse(df).columns == df.columns
    assert R.report(df.limit(0)).collect() == [] and R.collapse(df.limit(0)).collect() == []
