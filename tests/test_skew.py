from __future__ import annotations

import random

from pyspark.sql import functions as F

from sigloom.operators.skew import aggregate_beside_rows, heavy_digests, heavy_keys, key_digest, least, rows, salted_aggregate, skewed_aggregate, skewed_join, split_heavy, total


def skewed(spark, n=4000):
    """A third of the rows with one key, a fifth with null, the rest rare."""
    rnd = random.Random(5)
    data = []
    for i in range(n):
        p = rnd.random()
        key = "hot" if p < 0.33 else None if p < 0.53 else f"k{rnd.randrange(n)}"
        data.append((key, i, rnd.randrange(100)))
    return spark.createDataFrame(data, "key string, id bigint, v bigint"), data


def test_per_key_results_equal_a_plain_group_by(spark):
    df, data = skewed(spark)
    got = {r["key"]: (r["n"], r["first"], r["sum_v"]) for r in skewed_aggregate(df, ["key"], [rows("n"), least("first", F.col("id")), total("sum_v", F.col("v"))]).collect()}
    want: dict = {}
    for k, i, v in data:
        n, first, s = want.get(k, (0, i, 0))
        want[k] = (n + 1, min(first, i), s + v)
    assert got == want


def test_heavy_keys_are_found_null_among_them(spark):
    df, _ = skewed(spark)
    heavy = {r[0] for r in heavy_digests(df, ["key"], 0.1).collect()}
    want = {r[0] for r in spark.createDataFrame([("hot",), (None,)], "key string").select(key_digest(["key"])).collect()}
    assert heavy == want


def test_rows_take_one_road_each(spark):
    df, data = skewed(spark)
    hot, rest = split_heavy(df, ["key"], heavy_keys(df, ["key"], 0.1))
    assert hot.count() + rest.count() == len(data)
    assert {r["key"] for r in hot.select("key").distinct().collect()} == {"hot", None}


def test_join_equals_a_plain_join_and_null_matches_nothing(spark):
    df, data = skewed(spark)
    dim = spark.createDataFrame([("hot", 1), ("k1", 2), ("k2", 3), (None, 4)], "key string, w int")
    got = sorted((r["key"], r["id"], r["w"]) for r in skewed_join(df, dim, ["key"], 0.1).collect())
    weights = {"hot": 1, "k1": 2, "k2": 3}
    assert got == sorted((k, i, weights[k]) for k, i, _ in data if k in weights)


def test_empty_table(spark):
    df = spark.createDataFrame([], "key string, id bigint")
    assert heavy_digests(df, ["key"]).count() == 0
    assert skewed_aggregate(df, ["key"], [rows("n")]).count() == 0
    assert skewed_join(df, spark.createDataFrame([("a", 1)], "key string, w int"), ["key"]).count() == 0


def test_repeated_rows_ties_and_odd_column_names(spark):
    df = spark.createDataFrame([("a", 1, "x")] * 500 + [("b", 2, "y")], "key string, n bigint, `a.b` string")
    out = {r["key"]: (r["rows"], r["least"]) for r in skewed_aggregate(df, ["key"], [rows("rows"), least("least", F.col("`a.b`"))]).collect()}
    assert out == {"a": (500, "x"), "b": (1, "y")}
    assert salted_aggregate(df, ["a.b"], [rows("rows")]).count() == 2


def test_clashing_columns_of_a_join(spark):
    df, _ = skewed(spark, 300)
    out = skewed_join(df, spark.createDataFrame([("hot", 7)], "key string, v int"), ["key"], 0.1)
    assert out.columns == ["key", "id", "v", "v_right"] and {r["v_right"] for r in out.collect()} == {7}


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_heavy_keys_are_constants_of_the_plan(spark):
    df, _ = skewed(spark)
    plan = plan_of(skewed_aggregate(df, ["key"], [rows("n")]))
    assert "Join" not in plan and "Cartesian" not in plan
    even = spark.range(5000).select(F.col("id").cast("string").alias("key"))
    assert heavy_keys(even, ["key"], 0.1) == [] and plan_of(skewed_aggregate(even, ["key"], [rows("n")], 0.1)).count("Exchange") == 1


def test_many_heavy_keys_come_as_a_table(spark, monkeypatch):
    from sigloom.operators import skew

    df, data = skewed(spark)
    monkeypatch.setattr(skew, "IN_FILTER", 1)
    hot, rest = split_heavy(df, ["key"], heavy_keys(df, ["key"], 0.1))
    assert plan_of(hot).count("BroadcastHashJoin") == 1
    assert hot.count() + rest.count() == len(data) and {r["key"] for r in hot.select("key").distinct().collect()} == {"hot", None}


def test_aggregates_beside_rows(spark):
    df, data = skewed(spark)
    got = sorted((r["key"], r["id"], r["n"], r["first"]) for r in aggregate_beside_rows(df, ["key"], [rows("n"), least("first", F.col("id"))]).collect())
    per: dict = {}
    for k, i, _ in data:
        per.setdefault(k, []).append(i)
    assert got == sorted((k, i, len(per[k]), min(per[k])) for k, i, _ in data if k is not None)
    assert aggregate_beside_rows(df.limit(0), ["key"], [rows("n")]).count() == 0
