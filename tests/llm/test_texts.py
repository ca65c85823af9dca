import hashlib
import random
import re
import zlib
from pathlib import Path

import numpy as np
import pytest

from toolloom.llm import decontamination as dc
from toolloom.llm import neighbours, pii, quality, urls


def test_bytes_and_pattern_give_the_same_words():
    for t in ("Ab-c É1_x\x7f ñ", "", "a  B", "漢字 Kana", "x\x00y"):
        assert dc.words_of(t) == [w.encode() for w in dc.WORD.findall(t.translate(dc.LOWERED))]


def brute_hits(text, items, size=10):
    words = dc.words_of(text)
    hit, found = set(), set()
    for item, body in items:
        other = dc.words_of(body)
        n = min(size, len(other))
        for i in range(max(1, len(other) - size + 1) if other else 0):
            for k in range(len(words) - n + 1):
                if words[k : k + n] == other[i : i + n]:
                    hit |= set(range(k, k + n))
                    found.add("" if item is None else str(item))
    return len(words), len(hit), sorted(found)


def test_decontamination_equals_brute_force(spark):
    rng = random.Random(6)

    def some(n):
        return " ".join(rng.choice("abcde") + rng.choice("xyz") for _ in range(n))

    items = [(i, some(rng.randrange(0, 30))) for i in range(8)] + [(3, "ax by"), (None, "cx cz dy"), (50, None), (51, "")]
    docs = [(i, some(10) + " " + (items[i % 8][1][: rng.randrange(80)] or "") + " " + some(20), "c") for i in range(40)] + [(None, None, "c"), (1, "", "c"), (2, "AX, By!", "c"), (2, "AX, By!", None)]
    d = spark.createDataFrame(docs, "doc_id long, text string, hit_spans string")
    b = spark.createDataFrame(items, "item_id long, text string")
    want = []
    for doc_id, text, _ in docs:
        n, hit, found = brute_hits(text, items)
        want.append((doc_id, n, hit, len(found), hashlib.sha256(",".join(found).encode()).hexdigest(), hit > 0))
    for block in (dc.BLOCK_WORDS, 25):  # one block, and many that add up
        got = dc.report(d, b, block_words=block).collect()
        assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    kept = dc.remove(d, b)
    assert kept.columns == d.columns
    assert not any(r["contaminated"] for r in dc.report(kept, b.where("item_id = 3 and text = 'ax by'")).collect() if r["doc_id"] == 2)
    assert dc.report(d.limit(0), b).count() == 0 and dc.report(d, b.limit(0)).where("contaminated").count() == 0


def luhn_card(prefix):
    for c in "0123456789":
        if pii.luhn(prefix + c):
            return prefix + c
    raise AssertionError


CARD = luhn_card("453212345678901")


def plain_base(text):
    """The patterns as they are given."""
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append(("email", *m.span()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        if 14 <= len(d) <= 19 and pii.luhn(d):
            out.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append(("phone", *m.span()))
    return sorted(out, key=lambda s: (s[1], pii.KINDS.index(s[0]), s[2]))


def test_base_spans_are_those_of_the_patterns():
    rng = random.Random(8)
    alphabet = "0123456789..@@+-() ab\n"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(3000)]
    texts += [f"x {CARD} y a.b@c.de, 1.2.3.4.5.6.7.8 +1 (555) 555-1234", "a@b@c.d.e", "@a.b", "é@x.y", "٣.1.1.1", "256.1.1.1 1.1.1.1"]
    for t in texts:
        assert pii.base_spans(t) == plain_base(t), t


@pytest.fixture(scope="module")
def tagger():
    model = pii.Tagger()
    snippets = ["And then it went on to the old house, as ever. So they came and 3 of 4"] * 300
    model.train(*pii.training_set(snippets))
    return model


def test_added_spans_find_what_the_patterns_miss(tagger):
    """Recall and precision on held-out texts with items in plain and in broken layouts."""
    rng = np.random.default_rng(77)
    plain = ["Over the hill and far away, the river was as it had been", "und dann war es so weit, wie immer im alten Haus", "Le soir il est venu, comme toujours."]
    items = base_found = found = added = right = 0
    for _ in range(400):
        text, gold = plain[rng.integers(3)] + " ", []
        for _ in range(rng.integers(1, 4)):
            while True:
                kind, item = pii._invented(rng)
                if pii.passes(kind, item):
                    break
            gold.append((kind, len(text), len(text) + len(item)))
            text += item + str(rng.choice([" ", ", ", "; ", ". ", "\n"]))
        base, more = pii.find([text + plain[rng.integers(3)]], tagger)[0]
        items, base_found, found = items + len(gold), base_found + len(set(gold) & set(base)), found + len(set(gold) & set(base + more))
        added, right = added + len(more), right + len(set(more) & set(gold))
    assert found - base_found >= 0.3 * items and found >= 0.9 * items
    assert right >= 0.97 * added


def test_gradients_are_those_of_the_loss():
    x, y = pii.training_set(["abc 1.2.3.4 d"], 6)
    model = pii.Tagger(3, 4)
    _, d = model._gradients(x[:3, :20], y[:3, :20])
    for k, g in d.items():
        i = np.unravel_index(np.argmax(np.abs(g)), g.shape)
        old = model.p[k][i]
        model.p[k][i] = old + 1e-2
        up, _ = model._gradients(x[:3, :20], y[:3, :20])
        model.p[k][i] = old - 1e-2
        down, _ = model._gradients(x[:3, :20], y[:3, :20])
        model.p[k][i] = old
        assert (up - down) / 2e-2 == pytest.approx(g[i], rel=0.05, abs=1e-3), k


def test_held_out_tags(tagger):
    x, y = pii.training_set(["Over the hill and far away, the river was as it had been"] * 3, 300, seed=77)
    tags, _ = tagger.decode(x)
    pairs = [(set(pii.spans_of(a)), set(pii.spans_of(b))) for a, b in zip(tags, y, strict=True)]
    both, found, real = (sum(len(f(a, b)) for a, b in pairs) for f in (lambda a, b: a & b, lambda a, b: a, lambda a, b: b))
    assert 2 * both / (found + real) > 0.6


def test_added_spans_keep_base_ones(tagger):
    texts = [f"call +1 (269) 555-3296 {CARD} now", "plain words only", "", "version 2.0 of 1984", "x" * 200_000 + "@" + "1" * 200_000, f"{'and so on ' * 30}mail a.b@c.de and 10.0.0.1"]
    for text, (base, more) in zip(texts, pii.find(texts, tagger), strict=True):
        assert base == plain_base(text) if len(text) < 1000 else True
        for kind, a, b in more:
            assert pii.passes(kind, text[a:b]) and not any(a < y and x < b for _, x, y in base)
    assert [m for _, m in pii.find(texts[1:4], tagger)] == [[], [], []]


def test_windows_without_anchor_add_nothing(tagger):
    text = "word " * 100 + "mail me at joe@example.org or +44 20 7946 0958 " + "word " * 100
    every = [b for b in range(0, len(text), pii.WINDOW // 2)]
    assert list(pii.windows("word " * 99 + "joe [at] host (dot) org " + "word " * 99)) and not list(pii.windows("he sat at home, a dot on the line " * 30))
    assert set(pii.windows(text)) < set(every)
    assert {b for b in every if re.search("[0-9@]", text[b : b + pii.WINDOW])} == set(pii.windows(text))


def test_report_and_redaction(spark, tagger):
    rows = [(1, f"pay {CARD} to a@b.cd", "x"), (None, None, "x"), (1, "", None), (2, "+1 (269) 555-3296", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    got = {(r["doc_id"], r["n_card"], r["n_email"], r["n_phone"]) for r in pii.report(df, tagger).collect()}
    assert got == {(1, 1, 1, 0), (None, 0, 0, 0), (1, 0, 0, 0), (2, 0, 0, 1)}
    clean = [r["text"] for r in pii.redact(df, tagger).collect()]
    assert clean == ["pay [CARD] to [EMAIL]", None, "", "[PHONE]"]
    assert pii.report(df.limit(0), tagger).count() == 0


def test_rules_equal_brute_force(spark):
    rng = random.Random(3)
    hosts = ["a.net", "net", "x.example.net", "example.com", "b.org", "xnet", "NET", "deep.a.b.c.net", "net.org", ""]
    pages = [(i, f"{rng.choice(['http', 'HTTPS', ''])}://{rng.choice(hosts)}{rng.choice(['', '/', '/en/x', '/de/', '/fr/y?z', '?q', '#f', '/EN/'])}", "c") for i in range(300)]
    pages += [(None, None, "c"), (5, "no scheme", "c"), (5, "http://a.net/" + "p/" * 5000, None), (6, "http://" + "a." * 3000 + "net/x", "c")]
    rules = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"), (None, "/", "block"), ("", "/", "block")]
    df = spark.createDataFrame(pages, "page_id long, url string, host string")

    def judged(page_id, url):
        url = url or ""
        m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url)
        host, path = (m[1].translate({c: c + 32 for c in range(65, 91)}), m[2]) if m else ("", "")
        fits = [(len(h + p), h + p, v) for h, p, v in rules if h and (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, default=(0, None, "allow"))
        return page_id, host, path, best[1], best[2]

    table = spark.createDataFrame(rules, "host string, path string, verdict string")
    got = urls.filter_urls(df, table).collect()
    assert sorted(map(tuple, got), key=repr) == sorted((judged(*p[:2]) for p in pages), key=repr)
    assert urls.filter_urls(df.limit(0), table).count() == 0
    assert urls.filter_urls(df, table.limit(0)).where("verdict = 'block'").count() == 0


def test_bloom_has_no_false_negatives():
    rng = np.random.default_rng(1)
    keys = rng.integers(-(2**63), 2**63 - 1, 5000)
    bloom = urls.BlockedBloom(keys)
    assert bloom.may_hold(keys).all()
    assert bloom.may_hold(rng.integers(-(2**63), 2**63 - 1, 20000)).mean() < 0.02


def good_text(rng):
    return ". ".join(" ".join("".join(rng.choice("abcdeiou") for _ in range(rng.randrange(2, 8))) for _ in range(rng.randrange(4, 12))).capitalize() for _ in range(rng.randrange(3, 9))) + "."


def test_quality_on_held_out_texts(spark):
    rng = random.Random(2)
    rows = []
    for i in range(400):
        text = good_text(rng)
        if i % 3 == 0:
            text = rng.choice([lambda t: t.upper().replace(" ", "!! "), lambda t: " ".join(w for w in t.split()[:6] for _ in range(9)), lambda t: t.replace(" ", "$$$ ")])(text)
        rows.append((i, text, int(i % 3 != 0)))
    rows += [(1000, None, 1), (None, "x", 0), (1001, "", 0)]
    docs = spark.createDataFrame([(i, t, "c") for i, t, _ in rows], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, q) for i, _, q in rows] + [(0, None), (1, 7), (None, 1)], "doc_id long, quality int")
    got = {r["doc_id"]: r for r in quality.scores(docs, labels).collect()}
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got.values())
    held = [(i, q) for i, _, q in rows if i is not None and i < 1000 and zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(got[i]["held_out"] for i, _ in held)
    assert np.mean([got[i]["predicted"] == q for i, q in held]) > 0.95
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(r["predicted"] for r in got.values())
    assert quality.scores(docs.limit(0), labels).count() == 0
    assert {r["score"] for r in quality.scores(docs, labels.limit(0)).collect()} == {0.5}


def test_neighbours_against_brute_force(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 24)).astype(np.float32)
    x[1::9] = x[0]  # a large group of equal vectors
    rows = [(int(i), v.tolist()) for i, v in enumerate(x)]
    rows += [(500, None), (510, [0.0] * 24), (520, [float("nan")] * 24), (530, [None] + [1.0] * 23), (540, [1.0, 2.0]), (None, [1.0] * 24), (550, [float("inf")] * 24)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("t", __import__("pyspark").sql.functions.lit(1))
    got = neighbours.search(df, df["vec_id"] % 10 == 0).collect()
    unit = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    hits = total = 0
    for q in range(0, 400, 10):
        score = unit @ unit[q]
        score[q] = -9
        want = np.lexsort((np.arange(400), -np.round(score, 12)))[:5].tolist()
        mine = sorted((r["rank"], r["vec_id"], r["score"]) for r in got if r["query_id"] == q)
        assert [m[0] for m in mine] == [1, 2, 3, 4, 5]
        hits, total = hits + len({m[1] for m in mine} & set(want)), total + 5
        for _, v, s in mine:
            assert s == pytest.approx(float(unit[q] @ unit[v]), abs=1e-12)
    assert hits / total >= 0.9
    assert {r["query_id"] for r in got} == set(range(0, 400, 10))
    assert neighbours.search(df.limit(0), df["vec_id"] % 10 == 0).count() == 0


def test_ties_of_scaled_vectors_go_to_the_smaller_id(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(300, 16)).astype(np.float32)
    ids = rng.permutation(300)[:50]
    for i, v in enumerate(ids):
        x[v] = x[ids[0]] * np.float32(2.0 ** (i - 25))  # scores equal to the last bit
    _, near, _ = neighbours._top(x[ids[:1]], x, 6)
    assert near.tolist() == sorted(ids.tolist())[:6]
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = neighbours.search(df, df["vec_id"].isin(ids.tolist())).orderBy("query_id", "rank").collect()
    for q in ids.tolist():
        assert [r["vec_id"] for r in got if r["query_id"] == q] == [v for v in sorted(ids.tolist()) if v != q][:5]


def test_recall_is_met_where_probes_are_capped(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "OCCUPANCY", 0.05)  # three hashes, two million buckets
    x = np.random.default_rng(8).normal(size=(1500, 64)).astype(np.float32)
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = neighbours.search(df, df["vec_id"] % 300 == 0).collect()
    hits = 0
    for q in range(0, 1500, 300):  # all of them are calibrated on
        score = neighbours.cosines(np.tile(x[q], (1500, 1)), x)
        score[q] = -9
        hits += len({r["vec_id"] for r in got if r["query_id"] == q} & set(np.argsort(-score)[:5].tolist()))
    assert hits >= neighbours.RECALL * 25


def test_pruned_probes_are_the_best():
    index, unit = neighbours.Tables(8, 1, 2), neighbours._unit(np.random.default_rng(9).normal(size=(5, 8)))
    every = index.probes(unit, 0, 256)
    assert sorted(every[0].tolist()) == list(range(256))
    for most in (1, 2, 7, 30, 200):
        assert (index.probes(unit, 0, most) == every[:, :most]).all()


def test_readme_states_the_training_windows():
    row = next(x for x in (Path(__file__).parents[2] / "README.md").read_text().splitlines() if x.startswith("| 5 personal data"))
    assert f"{pii.CORPUS_WINDOWS:,} windows" in row and f"{pii.INVENTED_WINDOWS:,} with invented" in row


def test_double_vectors_keep_their_precision(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(60, 8))
    x[1], x[2] = x[0] * (1 + 1e-15), x[0] + 1e-9 * rng.normal(size=8)
    x[3] = np.where(np.arange(8) == 0, 1e300, 1e290)
    x[4] = x[3] * np.where(np.arange(8) == 1, 1.0 + 1e-6, 1.0)
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    rows = neighbours.search(df, df["vec_id"].isin(0, 3)).orderBy("query_id", "rank").collect()
    assert [r["vec_id"] for r in rows if r["query_id"] == 0][:2] == [1, 2]
    assert [r["vec_id"] for r in rows if r["query_id"] == 3][0] == 4
    for r in rows:
        q, v = x[r["query_id"]], x[r["vec_id"]]
        q, v = q / np.abs(q).max(), v / np.abs(v).max()
        assert r["score"] == pytest.approx(q @ v / np.sqrt(q @ q) / np.sqrt(v @ v), abs=1e-14)


def test_cells_and_lots_change_nothing(spark, monkeypatch):
    x = np.random.default_rng(3).normal(size=(300, 12)).astype(np.float32)
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    want = sorted(map(tuple, neighbours.search(df, df["vec_id"] % 3 == 0).collect()))
    monkeypatch.setattr(neighbours, "CELL", 7)
    assert sorted(map(tuple, neighbours.search(df, df["vec_id"] % 3 == 0).collect())) == want


def test_windows_that_many_items_share(spark):
    shared = " ".join(f"s{i}" for i in range(12))
    items = [(i, f"{shared} own{i}") for i in range(300)] + [(999, "nothing of it " * 5)]
    docs = [(1, f"before {shared} after"), (2, "s0 s1 s2"), (3, None), (4, f"{shared} own7 " * 3)]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for block in (dc.BLOCK_WORDS, 600):
        rows = {r["doc_id"]: r for r in dc.report(d, b, block_words=block).collect()}
        for doc_id, text in docs:
            n, hit, found = brute_hits(text, items)
            assert (rows[doc_id]["n_words"], rows[doc_id]["n_hit"], rows[doc_id]["n_items"]) == (n, hit, len(found))
    long = spark.createDataFrame([(1, "filler " * 300_000 + shared)], "doc_id long, text string")
    assert dc.report(long, b).first()["n_hit"] == 12
    assert dc.remove(d.limit(0), b).count() == 0 and dc.remove(d, b.limit(0)).count() == 4


def test_one_id_under_several_texts_is_learnt_once(spark):
    rng = random.Random(4)
    rows = [(i, good_text(rng)) for i in range(200)] + [(i, good_text(rng).upper().replace(" ", "!! ")) for i in range(200, 300)] + [(5, "x " * 50)] * 30
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 200)) for i in range(300)], "doc_id long, quality int")
    first = sorted(map(tuple, quality.scores(docs, labels, sample=150).collect()))
    assert sorted(map(tuple, quality.scores(docs.repartition(7), labels, sample=150).collect())) == first
    assert quality.keep_good(docs.limit(0), labels).count() == 0


def test_redaction_of_empty_tables_and_clashing_columns(spark, tagger):
    df = spark.createDataFrame([(1, "So they came to see joe77 [at] host (dot) org and went on to the old house", "s", 9), (None, "", None, 0)], "doc_id long, text string, spans string, n_chars long")
    rows = pii.redact(df, tagger).collect()
    assert [(r["spans"], r["n_chars"]) for r in rows] == [("s", len(rows[0]["text"])), (None, 0)] and "host" not in rows[0]["text"]
    assert pii.redact(df.limit(0), tagger).count() == 0


def test_quality_scores_are_sums_of_table_entries():
    """Bin additions against a plain loop over features and pairs."""
    import bisect
    import math

    rng = np.random.default_rng(3)
    x = np.round(rng.normal(size=(600, len(quality.FEATURES))), 1)
    y = ((x[:, 0] + x[:, 1] * x[:, 2] + rng.normal(size=600) * 0.3) > 0).astype(float)
    model = quality.AdditiveModel(x, y)
    assert len(model.pairs) == quality.PAIRS
    for row, score in zip(x[:100], model.score(x[:100]), strict=True):
        logit = model.base + sum(t[bisect.bisect_left(list(e), v)] for t, e, v in zip(model.tables, model.edges, row, strict=True))
        logit += sum(t[bisect.bisect_left(list(model.coarse[i]), row[i])][bisect.bisect_left(list(model.coarse[j]), row[j])] for i, j, t in model.pairs)
        assert math.isclose(score, 1 / (1 + math.exp(-logit)), rel_tol=1e-9)
    assert ((model.score(x) >= 0.5) == y).mean() > 0.9


def test_shallow_trees_take_the_best_cuts():
    """Three leaves and crossed cuts against trying all of them."""
    rng = np.random.default_rng(4)
    part = lambda g, h: g.sum() ** 2 / (h.sum() + quality.RIDGE)
    for _ in range(50):
        g, h = rng.normal(size=9), rng.random(9)
        steps = quality._best_steps(g, h)
        ends = [0, *(np.flatnonzero(np.diff(steps)) + 1), 9]
        best = max(part(g[:i], h[:i]) + part(g[i:j], h[i:j]) + part(g[j:], h[j:]) for i in range(1, 9) for j in range(i + 1, 10))  # the last leaf may be empty
        assert len(ends) <= 4 and np.isclose(sum(part(g[a:b], h[a:b]) for a, b in zip(ends, ends[1:], strict=False)), best)
        g, h = rng.normal(size=(5, 4)), rng.random((5, 4))
        gain, step = quality._best_crossed(g, h)
        cuts = [sum(part(g[a, b], h[a, b]) for a in (slice(0, i), slice(i, 5)) for b in (slice(0, j), slice(j, 4))) for i in range(1, 5) for j in range(1, 4)]
        assert np.isclose(gain, max(cuts)) and step.shape == g.shape
