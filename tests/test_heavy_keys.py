from collections import Counter

import pytest
from pyspark.sql import functions as F

from loglattice.operators import heavy_keys as hk


def test_pack_splits_large_keys_and_levels_tasks():
    loads = {"a": 5000, "b": 800, "c": 10}
    shards, filled = hk.pack(loads, 8000, 8)
    assert len(shards["a"]) >= 8 and "c" not in shards
    assert max(filled) <= 1.6 * 8000 / 8
    assert sum(filled) == pytest.approx(8000)


def test_pack_of_nothing():
    assert hk.pack({}, 0, 4) == ({}, [0.0] * 4)


@pytest.fixture(scope="module")
def skewed(spark):
    rows = [(i, "hot" if i % 3 else (None if i % 30 == 0 else f"k{i % 97}"), i % 5 if i % 7 else None, "x") for i in range(6000)]
    return spark.createDataFrame(rows, "id long, k string, v long, n_rows string"), rows


def test_totals_equal_a_plain_count(spark, skewed):
    df, rows = skewed
    got = {r["k"]: (r["n_rows"], r["sum_v"]) for r in hk.key_totals(df, "k", ["v"]).collect()}
    n = Counter(r[1] for r in rows)
    sums = {k: sum(r[2] for r in rows if r[1] == k and r[2] is not None) for k in n}
    assert got == {k: (n[k], sums[k]) for k in n}


def test_rows_are_combined_before_they_move(spark, skewed):
    df, _ = skewed
    spread = df.repartition(6, "id")
    partial = hk.partial_totals(spread, "k", ["v"])
    assert partial.where("k = 'hot'").count() == 6
    plan = partial._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in plan and plan.count("partial_count") >= 1
    loads = hk.plan_loads(partial, "k", tasks=64)  # of the partial rows
    assert loads.total_rows == partial.count() and sum(loads.task_load) == pytest.approx(partial.count())


def test_a_hot_key_is_split_over_tasks(spark, skewed):
    df, _ = skewed
    plan = hk.plan_loads(df, "k", tasks=4)
    assert len(plan.shards["vhot"]) > 1
    per_task = hk.place(hk.fragment(df, "k", F.col("id"), plan), plan).groupBy(F.spark_partition_id()).count().collect()
    assert max(r["count"] for r in per_task) < 2 * 6000 / 4


def test_join_matches_a_plain_join_and_keeps_clashing_columns(spark, skewed):
    df, rows = skewed
    other = spark.createDataFrame([("hot", 1, "a"), ("hot", 2, "b"), ("k3", 3, "c"), (None, 4, "d")], "k string, v long, w string")
    for how in ("inner", "left", "left_semi", "left_anti"):
        plan = hk.plan_loads(df, "k", tasks=5)
        got = hk.fragment_replicate_join(df, other, "k", ["id"], how, plan)
        want = df.join(other.where("k is not null").withColumnRenamed("v", "ov").withColumnRenamed("w", "ow"), "k", how)
        assert got.count() == want.count(), how
    got = hk.fragment_replicate_join(df, other, "k", ["id"], "inner")
    assert {"v", "other_v", "w"} <= set(got.columns)
    with pytest.raises(ValueError):
        hk.fragment_replicate_join(df, other, "k", ["id"], "right")


def test_heavy_keys_compare_exactly(spark):
    df = spark.createDataFrame([("a", 1)] * 1 + [("b", None)] * 1 + [("c", 5)] * 48, "k string, v long")
    found = hk.heavy_keys(df, "k", (1, 50), ["v"])
    assert {r[0] for r in found["rows"].collect()} == {"a", "b", "c"}  # 50 * 1 >= 50
    assert {r[0] for r in found["v"].collect()} == {"c"}


def test_empty_table_and_null_keys(spark):
    empty = spark.createDataFrame([], "k string, v long")
    assert hk.key_totals(empty, "k", ["v"]).count() == 0
    assert all(f.count() == 0 for f in hk.heavy_keys(empty, "k", (1, 50), ["v"]).values())
    nulls = spark.createDataFrame([(None, None)] * 3, "k string, v long")
    assert hk.key_totals(nulls, "k", ["v"]).collect() == [(None, 3, None)]
    assert hk.heavy_keys(nulls, "k", (1, 50))["rows"].count() == 0


def test_join_stays_where_the_plan_puts_it(spark, skewed):
    df, _ = skewed
    other = spark.range(50).selectExpr("concat('k', id) as k", "id as w")
    plan = hk.fragment_replicate_join(df, other, "k", ["id"], "left")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange shufflepartitionidpassthrough") == 2 and "Exchange hashpartitioning(_ll_task" not in plan
