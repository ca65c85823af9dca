import random
import zlib
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from toolloom.llm import common, packing, sharding, token_counts, token_files
from toolloom.llm.encoding import Encoder, vocabulary

FILES = ["word_bpe_49k.json", "byte_bpe_50k.json"]
ODD = ["", " ", "\n\n a  b\t \n c", "don't it's 'S", "<|endoftext|> a<|startoftext|>b <|endoftext|>", "é́ é àb", "ΑΣ Σ", "x\xa0y\x85z\x1c w \x1d\n", "İstanbul ǅ ﬁ ß", "漢字 かな　x", "a,b. c!? 12 3.4 #@ .. ,", " lead", "trail ", "a\r\nb", "a\0b c", "\0 x", "ÀÉ É.", "x" * 3000, "word " * 50]


@pytest.fixture(scope="module", params=FILES)
def enc(request):
    return Encoder(vocabulary(request.param))


def library(enc, texts):
    return [np.array(e.ids, "<u4").tobytes() for e in enc.tok.encode_batch(texts, add_special_tokens=False)]


def test_cached_ids_are_the_library_s(enc):
    assert enc.batch(ODD) == library(enc, ODD)
    assert enc.batch(ODD) == library(enc, ODD)  # now from what is kept


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list("abÉß .,!\n\t'1@é̈\0Σ ")), max_size=40), max_size=5))
def test_any_text(texts):
    for f in FILES:
        e = _encoders.setdefault(f, Encoder(vocabulary(f)))
        assert e.batch(texts) == library(e, texts)


_encoders: dict = {}


def test_full_caches_change_nothing(enc, monkeypatch):
    from toolloom.llm import encoding

    monkeypatch.setattr(encoding, "KEEP_CHUNKS", 5)
    monkeypatch.setattr(encoding, "KEEP_WORDS", 3)
    rng = random.Random(2)
    texts = [" ".join(rng.choice(["alpha", "beta.", "Gamma", "x1", "été,"]) + rng.choice("ab") for _ in range(20)) for _ in range(20)]
    fresh = Encoder.__new__(Encoder)
    fresh.__dict__.update(enc.__dict__ | {"words": {}, "chunks": {}, "share": 0.8})
    for t in texts:
        assert fresh.batch([t]) == library(enc, [t])


@given(st.lists(st.integers(0, 2**32 - 1), max_size=50))
def test_values_round_trip(values):
    control, data = token_files.encode_values(np.array(values, np.uint32))
    assert token_files.decode_values(control, data, len(values)).tolist() == values


def test_damaged_block_is_refused():
    block = token_files.pack_block(np.array([1, 300, 70000], np.uint32), [2, 0, 1])
    ranks, lengths = token_files.unpack_block(block)
    assert ranks.tolist() == [1, 300, 70000] and lengths.tolist() == [2, 0, 1]
    with pytest.raises(ValueError, match="damaged"):
        token_files.unpack_block(block[:-6] + b"x" + block[-5:])


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(5)
    words = ["the", "Of", "thation.", "12", "über", "x,y", "no"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(0, 120))), f"s{rng.randrange(3)}", "clash") for i in range(60)]
    rows += [(100, None, "s0", "c"), (101, "", None, "c"), (None, "null id", "s1", None), (7, "twice", "s0", "c"), (7, "twice", "s0", "c"), (200, "long " * 4000, "s0", "c")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, ids string").repartition(4)


def expected(enc, docs, end):
    rows = docs.select("doc_id", "text").collect()
    out = []
    for r, x in zip(rows, library(enc, [r["text"] or "" for r in rows]), strict=True):
        out.append((r["doc_id"], x + np.array([end], "<u4").tobytes()))
    return out


def test_files_round_trip(spark, docs):
    enc = Encoder(vocabulary(FILES[0]))
    path = common.new_path(spark, "test")
    token_files.write_tokens(docs, vocabulary(FILES[0]), 1, path)
    got = token_files.read_tokens(spark, path).orderBy("start").collect()
    width = token_files.id_width(vocabulary(FILES[0]))
    packed = lambda x: zlib.crc32(np.frombuffer(x, "<u4").astype(width).tobytes())
    want = sorted(expected(enc, docs, 1), key=lambda r: (r[0] is not None, r[0] or 0, len(r[1]), packed(r[1])))
    assert [(r["doc_id"], r["n_tokens"]) for r in got] == [(d, len(x) // 4) for d, x in want]
    assert [r["ids_crc32"] for r in got] == [zlib.crc32(x) for _, x in want]
    assert [r["start"] for r in got] == np.cumsum([0, *(len(x) // 4 for _, x in want)])[:-1].tolist()


def test_packing_is_whole_and_full(spark, docs):
    enc = Encoder(vocabulary(FILES[0]))
    rows = packing.pack_documents(docs, vocabulary(FILES[0]), 2, window=256, quantum=64).collect()
    place = sorted((r["sequence_id"], r["offset"], r["length"], r["ids"], r["source"]) for r in rows)
    at = 0
    for s, o, n, ids, _ in place:
        assert s * 256 + o == at and o + n <= 256 and len(ids) == 4 * n
        at += n
    want = expected(enc, docs, 2)
    assert at == sum(len(x) // 4 for _, x in want)
    pieces = {}
    for r in rows:
        assert zlib.crc32(r["ids"]) == r["ids_crc32"]
        if r["doc_id"] not in (7,):
            pieces.setdefault(r["doc_id"], []).append((r["start"], r["ids"]))
    assert {d: b"".join(x for _, x in sorted(p)) for d, p in pieces.items()} == {d: x for d, x in want if d != 7}
    # every full window but the last ones holds each source within two quanta of its share
    total, share = at, {}
    for *_, n, _, source in [(0, 0, p[2], p[3], p[4]) for p in place]:
        share[source] = share.get(source, 0) + n
    for w in range(max(p[0] for p in place) - 1):
        for source, n in share.items():
            held = sum(p[2] for p in place if p[0] == w and p[4] == source)
            assert abs(held - 256 * n / total) <= 2 * 64


def test_packing_targets_and_folded_queues(spark, docs, monkeypatch):
    tokens = np.array([6400, 6400], np.int64)
    first = packing.positions(0, np.arange(100), tokens, np.array([3, 1], np.int64), 64)
    assert abs(np.sum(first < 4000) * 64 - 3000) <= 128  # three quarters while both last
    monkeypatch.setattr(packing, "MAX_QUEUES", 2)
    rows = packing.pack_documents(docs, vocabulary(FILES[0]), 2).collect()
    at = 0
    for s, o, n in sorted((r["sequence_id"], r["offset"], r["length"]) for r in rows):
        assert s * packing.WINDOW + o == at
        at += n


@pytest.mark.parametrize("targets", [None, {"s0": 0.5, "s2": 0.4, None: 0.1}])
def test_many_sources_are_packed_like_few(spark, docs, monkeypatch, targets):
    few = packing.pack_documents(docs, vocabulary(FILES[0]), 2, window=256, quantum=64, targets=targets)
    few = sorted(map(tuple, few.collect()), key=repr)
    monkeypatch.setattr(packing, "MAX_QUEUES", 2)
    monkeypatch.setattr(packing, "UNFOLD", 5)
    many = packing.pack_documents(docs, vocabulary(FILES[0]), 2, window=256, quantum=64, targets=targets)
    assert sorted(map(tuple, many.collect()), key=repr) == few


def test_quotients_beyond_64_bits():
    a, b, c = np.array([2 * 10**11 + 1, 5, 99], np.int64), np.array([10**11, 10**11 - 7, 3], np.int64), 99999999977
    q, exact = packing._quotient(a, b, c)
    assert [int(v) for v in q] == [int(x) * int(y) // c for x, y in zip(a, b, strict=True)] and not exact.any()
    assert packing._quotient(np.array([6]), np.array([4]), 8)[1].all()


def test_counts_and_cache(spark, docs):
    enc, cache = Encoder(vocabulary(FILES[1])), common.new_path(spark, "cache")
    want = sorted(((d, len(x) // 4 - 1) for d, x in expected(enc, docs, 0)), key=repr)
    for _ in range(2):
        got = token_counts.token_counts(docs, vocabulary(FILES[1]), cache, 100).collect()
        assert sorted(((r["doc_id"], r["n_tokens"]) for r in got), key=repr) == want
        assert all(r["over_limit"] == (r["n_tokens"] > 100) for r in got)
    stored = spark.read.parquet(cache)
    assert stored.count() == stored.select("content_digest").distinct().count() == docs.fillna("", ["text"]).select("text").distinct().count()


@pytest.mark.parametrize("n", [1, 2, 3, 7, 64, 1000])
def test_permutation(n):
    y = sharding.permute(np.arange(n), n, 3)
    assert sorted(y) == list(range(n)) and (sharding.permute(y, n, 3, inverse=True) == np.arange(n)).all()


def test_shards(spark, docs):
    rows = sharding.shard(docs, 8).collect()
    counts = [sum(r["shard"] == s for r in rows) for s in range(8)]
    assert max(counts) - min(counts) <= 1 and len(rows) == docs.count()
    for s in range(8):
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(counts[s]))
    again = sharding.shard(docs.repartition(7), 8).collect()
    assert sorted(map(tuple, again), key=repr) == sorted(map(tuple, rows), key=repr)
    assert {r["doc_id"]: r["size"] for r in rows}[100] == 1


def test_empty_tables(spark, docs):
    none, path = docs.limit(0), common.new_path(spark, "none")
    assert packing.pack_documents(none, vocabulary(FILES[0]), 2).count() == 0
    assert sharding.shard(none, 8).count() == 0
    assert token_counts.token_counts(none, vocabulary(FILES[1]), common.new_path(spark, "cache"), 1).count() == 0
    token_files.write_tokens(none, vocabulary(FILES[0]), 1, path)
    assert token_files.read_tokens(spark, path).count() == 0


def sequential_round_robin(tokens, weights, quantum):
    """Stream positions of the quanta of each queue, one served after the other: the queue whose deficit is due first."""
    served, at, out = [0] * len(tokens), 0, [[] for _ in tokens]
    while True:
        open_queues = [q for q in range(len(tokens)) if served[q] * quantum < tokens[q]]
        if not open_queues:
            return out
        q = min(open_queues, key=lambda q: (Fraction(2 * served[q] + 1, 2 * weights[q]), q))
        out[q].append(at)
        at += min(quantum, tokens[q] - served[q] * quantum)
        served[q] += 1


@pytest.mark.parametrize("seed", range(6))
def test_places_are_those_of_a_sequential_round_robin(seed):
    rng = random.Random(seed)
    tokens = np.array([rng.randrange(1, 4000) for _ in range(rng.randrange(1, 7))], np.int64)
    weights = tokens if seed % 2 else np.array([rng.randrange(1, 9) for _ in tokens], np.int64)
    want = sequential_round_robin(tokens.tolist(), weights.tolist(), 64)
    for q in range(len(tokens)):
        k = np.arange(-(-tokens[q] // 64))
        assert packing.positions(q, k, tokens, weights, 64).tolist() == want[q]


def test_rows_lie_where_their_numbers_say(spark, docs):
    rows = sharding.shard(docs, 5, seed=9).collect()
    numbers = np.array([r["row_number"] for r in rows])
    where, slot = sharding.locate(numbers, len(rows), 5, 9)
    assert sorted(numbers.tolist()) == list(range(len(rows)))
    assert [(r["shard"], r["slot"]) for r in rows] == list(zip(where.tolist(), slot.tolist()))
    back = sharding.permute(slot * 5 + where, len(rows), 9, inverse=True)
    assert back.tolist() == numbers.tolist()


def test_filled_cache_with_a_hot_text_encodes_only_what_is_new(spark):
    cache, path = common.new_path(spark, "cache"), vocabulary(FILES[1])
    old = spark.createDataFrame([(i, f"text {i}") for i in range(50)], "doc_id long, text string")
    token_counts.token_counts(old, path, cache, 10).collect()
    hot = [(100 + i, "a hot text " * 3) for i in range(400)] + [(900, None), (901, "text 3"), (None, "text 4"), (902, "new")]
    rows = token_counts.token_counts(spark.createDataFrame(hot, "doc_id long, text string").repartition(5), path, cache, 5).collect()
    enc = Encoder(path)
    want = {t: len(enc.tok.encode(t or "", add_special_tokens=False).ids) for _, t in hot}
    assert len(rows) == len(hot) and {r["doc_id"]: r["n_tokens"] for r in rows} == {d: want[t] for d, t in hot}
    stored = spark.read.parquet(cache)
    assert stored.count() == stored.select("content_digest").distinct().count() == 50 + 3


def test_string_ids_in_files(spark):
    rows = [("b", "x y"), ("a", "z"), (None, "q"), ("a", "z"), ("c", None)]
    path = common.new_path(spark, "ids")
    token_files.write_tokens(spark.createDataFrame(rows, "doc_id string, text string"), vocabulary(FILES[0]), 1, path)
    got = token_files.read_tokens(spark, path).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == [None, "a", "a", "b", "c"] and got[-1]["n_tokens"] == 1


def test_very_long_texts(spark):
    long = "word and word, " * 200_000
    df = spark.createDataFrame([(1, long, "s"), (2, "short", "s")], "doc_id long, text string, source string")
    rows = packing.pack_documents(df, vocabulary(FILES[0]), 2).collect()
    enc = Encoder(vocabulary(FILES[0]))
    assert sum(r["length"] for r in rows if r["doc_id"] == 1) == len(enc.tok.encode(long, add_special_tokens=False).ids) + 1
