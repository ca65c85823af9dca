import random

import corpus_pipeline
import pytest

from test_near_duplicates import brute
from test_texts import brute_hits, good_text
from toolloom.llm import common, decontamination, pii, quality


@pytest.fixture(scope="module")
def fixture_dir(spark, tmp_path_factory):
    """Documents good and bad, copied, contaminated, with personal data, null and empty, and columns that clash with the operators' own."""
    rng, rows = random.Random(7), []
    item = " ".join(f"question{i}" for i in range(25))
    for i in range(240):
        text = good_text(rng) + " " + good_text(rng)
        if i % 6 == 0:
            text = text.upper().replace(" ", "$$ ")
        elif i % 6 == 1:
            text += f" {item} {good_text(rng)} {good_text(rng)}"
        elif i % 6 == 2:
            text += f" Mail joe{i}@host.org or 10.0.{i}.1."
        rows.append((i, text))
    rows += [(1000 + i, rows[6 * i + 3][1]) for i in range(20)] + [(1100 + i, rows[6 * i + 4][1] + " tail") for i in range(20)]
    rows += [(2000, None), (2001, ""), (None, rows[5][1]), (7, rows[7][1])]
    folder = tmp_path_factory.mktemp("pipeline")
    columns = "doc_id long, text string, lang string, source string, n_chars long, score double, rid long, spans string, hit_items string"
    docs = [(d, t, "en", f"src{k % 3}" if k % 7 else None, len(t or ""), 0.5, k, "s", None) for k, (d, t) in enumerate(rows)]
    spark.createDataFrame(docs, columns).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, int(i % 6 != 0), 0) for i in range(240)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(0, item), (1, None), (2, "")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def test_stages_equal_brute_force(spark, fixture_dir):
    read = lambda name: common.read(spark, fixture_dir, name)
    docs, stages = read("documents"), dict(corpus_pipeline.STAGES)
    names = docs.columns

    def run(name, docs):
        path = common.shared_dir(spark) + f"/test-{common.unique()}"
        out = stages[name](spark, docs, fixture_dir)
        if name != "packing":
            assert out.columns == names
        out.write.parquet(path)
        return spark.read.parquet(path)

    rows = lambda df: sorted(((r["rid"], r["doc_id"], r["text"]) for r in df.collect()), key=lambda r: r[0])
    model = quality.fit(docs, read("labels"))
    good = [r for r in rows(docs) if model.score(quality._featured_texts([r[2]]))[0] >= corpus_pipeline.GOOD]
    kept = run("quality", docs)
    assert rows(kept) == good and 0 < len(good) < docs.count()

    # one of each group stays: the least doc_id, null ids last
    classes = {r: c for r, c, _ in brute([(rid, text) for rid, _, text in good])}
    first = {}
    for rid, doc_id, text in good:
        key = classes[rid]
        first[key] = min(first.get(key, (True, 0, 1 << 60)), (doc_id is None, doc_id or 0, rid))
    want = sorted(r for *_, r in first.values())
    unique = run("near_duplicates", kept)
    assert [r[0] for r in rows(unique)] == want and len(want) < len(good)

    items = [(r["item_id"], r["text"]) for r in read("benchmark").collect()]
    clean = run("decontamination", unique)
    left = {r[0]: r[2] for r in rows(clean)}
    for rid, _, text in rows(unique):
        n, hit, _ = brute_hits(text, items)
        if hit and hit >= 0.3 * n:
            assert rid not in left
        elif not hit:
            assert left[rid] == text
        else:
            assert brute_hits(left[rid], items)[1] == 0 and len(decontamination.words_of(left[rid])) >= n - hit - 1

    model = pii.fit(clean)
    private = run("personal_data", clean)
    found = pii.find([t or "" for _, _, t in rows(clean)], model)
    assert [r[2] for r in rows(private)] == [None if t is None else pii.mask(t, b + m) for (_, _, t), (b, m) in zip(rows(clean), found)]
    assert [r["n_chars"] for r in private.orderBy("rid").collect()] == [len(t) if t is not None else None for _, _, t in rows(private)]

    pieces = run("packing", private)
    at = 0
    for r in pieces.orderBy("sequence_id", "offset").collect():
        assert r["sequence_id"] * 4096 + r["offset"] == at
        at += r["length"]
    assert pieces.where("start = 0").count() == private.count()


def test_run_and_empty_tables(spark, fixture_dir, tmp_path):
    once = corpus_pipeline.run(spark, fixture_dir)
    assert once.count() > 0
    for name in ("documents", "labels", "benchmark"):
        common.read(spark, fixture_dir, name).limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_stages_keep_columns_and_take_effect(spark):
    sf = "/root/testdata/sf0.001"
    docs = common.read(spark, sf, "documents")
    names, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        path = common.shared_dir(spark) + f"/test-{common.unique()}"
        out = stage(spark, docs, sf)
        assert out.columns == names
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        seen[name] = docs.count()
    assert 0 < seen["near_duplicates"] <= seen["quality"] and seen["personal_data"] == seen["decontamination"]
    assert docs.where("text rlike '[0-9]{1,3}([.][0-9]{1,3}){3}' and not text rlike '[.0-9]{20}'").count() == 0
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert pieces.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()
