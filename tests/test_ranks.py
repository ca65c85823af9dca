import random

import pytest
from pyspark.sql import functions as F

from toolloom.operators import ranks


def _shuffled(rows, seed):
    return random.Random(seed).sample(rows, len(rows))


@pytest.mark.parametrize("values", [[5] * 300, list(range(-150, 150)), [2**62, -(2**62), 0, None] * 75, [random.Random(1).randrange(-3, 3) for _ in range(300)]])
def test_cuts_are_those_of_a_sort(spark, values, monkeypatch):
    monkeypatch.setattr(ranks, "FEW", 20)
    rows = _shuffled([(v, i) for i, v in enumerate(values)], 3)
    df = spark.createDataFrame(rows, "v long, i int").repartition(5)
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    for k in (0, 1, 150, 299, 300, 400):
        first, rest = ranks.first_k(df, k, ["v", "i"])
        assert sorted(map(tuple, first.collect()), key=repr) == sorted(order[:k], key=repr)
        assert sorted(map(tuple, rest.collect()), key=repr) == sorted(order[k:], key=repr)


def test_cuts_by_other_orders(spark):
    rows = [(f"s{i % 7}", i) for i in range(60)]
    first, rest = ranks.first_k(spark.createDataFrame(_shuffled(rows, 1), "v string, i int"), 25, ["v", F.desc("i")])
    order = sorted(rows, key=lambda r: (r[0], -r[1]))
    assert sorted(map(tuple, first.collect())) == sorted(order[:25]) and sorted(map(tuple, rest.collect())) == sorted(order[25:])


def test_numbers_within_groups(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["a", "a", "a", "b", None]), rng.randrange(20), i) for i in range(500)]
    out = ranks.numbered(spark.createDataFrame(_shuffled(rows, 2), "g string, v int, i int").repartition(7), ["g"], ["v", F.desc("i")]).collect()
    for g in ("a", "b", None):
        wanted = sorted((r for r in rows if r[0] == g), key=lambda r: (r[1], -r[2]))
        assert [(r["g"], r["v"], r["i"]) for r in sorted((r for r in out if r["g"] == g), key=lambda r: r["n"])] == wanted
        assert sorted(r["n"] for r in out if r["g"] == g) == list(range(len(wanted)))


def test_equal_rows_are_cut_into_parts(spark):
    df = spark.range(0, 20000, numPartitions=4).select(F.lit(1).alias("g"))
    out = ranks.numbered(df, ["g"], [])
    assert out.agg(F.min("n"), F.max("n"), F.count_distinct("n")).first()[:] == (0, 19999, 20000)
    assert ranks.numbered(df.limit(0), [], ["g"]).collect() == []


def test_no_row_of_a_share_goes_through_one_task(spark):
    from toolloom.operators import sampling

    df = spark.range(0, 5000, numPartitions=4)
    held, rest = sampling.hold_out(df, 500, "id")
    ids = sampling.numbered_ids(df, F.lit("x"), ["id"], [])
    for out in (held, rest, ids):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "TakeOrdered" not in plan and "GlobalLimit" not in plan
    assert held.count() == 500 and rest.count() == 4500 and held.intersect(rest).isEmpty()
    assert "SinglePartition" not in held._jdf.queryExecution().executedPlan().toString()
