from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from sigloom.llm import frequent as M


def data(n=6000, seed=3):
    rnd = random.Random(seed)
    return [None if rnd.random() < 0.05 else f"h{int(rnd.paretovariate(0.6)) % 5000}" for _ in range(n)]


@pytest.mark.parametrize("counters", [5, 40, 400])
def test_bounds_hold_and_no_frequent_item_is_missing(spark, counters):
    items = data()
    df = spark.createDataFrame([(x,) for x in items], "x string").repartition(7)
    truth = Counter(x for x in items if x is not None)
    n = sum(truth.values())
    got = {r["item"]: r for r in M.frequent_items(df, "x", counters).collect()}
    assert len(got) <= counters
    assert all(r["lower_bound"] <= truth[k] <= r["upper_bound"] for k, r in got.items())
    assert all(k in got for k, c in truth.items() if c > n / (counters + 1))
    assert all(r["n_rows"] == len(items) and r["n_items"] == n and r["upper_bound"] - r["lower_bound"] <= n / (counters + 1) for r in got.values())


def test_merging_subtracts_the_next_largest_counter():
    values, counts = M.reduce_counters(pa.array(list("abcde")), np.array([9, 7, 5, 3, 3]), 2)
    assert dict(zip(values.to_pylist(), counts)) == {"a": 4, "b": 2}
    values, counts = M.reduce_counters(pa.array(list("abc")), np.array([3, 3, 3]), 2)
    assert len(values) == 0
    assert M.reduce_counters(pa.array(["a"]), np.array([1]), 2)[1].tolist() == [1]


def test_exact_shares(spark):
    items = data()
    df = spark.createDataFrame([(x,) for x in items], "x string").repartition(5)
    truth = {k: c for k, c in Counter(items).items() if k is not None and c >= 0.01 * len(items)}
    assert {r["item"]: r["n"] for r in M.frequent_exact(df, "x", 0.01, 200).collect()} == truth
    with pytest.raises(ValueError):
        M.frequent_exact(df, "x", 0.01, 50)


@pytest.mark.parametrize("rows", [[], [(None,)] * 9])
def test_no_items(spark, rows):
    df = spark.createDataFrame(rows, "x string")
    assert M.frequent_items(df, "x").count() == 0 and M.frequent_exact(df, "x", 0.5).count() == 0


def test_one_value_only_ties_and_extra_columns(spark):
    df = spark.createDataFrame([("a", 1, "z"), ("b", 2, "z"), ("a", 3, None), ("b", 4, None)], "x string, item int, n_rows string")
    assert {(r["item"], r["n"]) for r in M.frequent_exact(df, "x", 0.5).collect()} == {("a", 2), ("b", 2)}
    assert {(r["item"], r["lower_bound"]) for r in M.frequent_items(df, "item").collect()} == {(str(i), 1) for i in range(1, 5)}


def test_small_chunks_give_the_same_guarantee():
    items = data(2000)
    batches = [pa.record_batch({"x": pa.array(items[i : i + 37], pa.string())}) for i in range(0, len(items), 37)]
    out = pa.Table.from_batches(list(M.summarise(iter(batches), 20, chunk=64))).to_pylist()
    truth = Counter(x for x in items if x is not None)
    slack = sum(truth.values()) / 21
    kept = {r["item"]: r["counter"] for r in out if r["item"] is not None}
    assert all(truth[k] - slack <= c <= truth[k] for k, c in kept.items())
    assert all(k in kept for k, c in truth.items() if c > slack)


def test_merging_many_summaries_in_small_chunks():
    items = data(3000)
    parts = [list(M.summarise(iter([pa.record_batch({"x": pa.array(items[i : i + 200], pa.string())})]), 25)) for i in range(0, len(items), 200)]
    out = list(M.merge_summaries((b for p in parts for b in p), 25, chunk=30))[0].to_pylist()
    truth = Counter(x for x in items if x is not None)
    assert out[-1]["n_rows"] == 3000 and out[-1]["n_items"] == sum(truth.values())
    slack = (out[-1]["n_items"] - sum(r["counter"] for r in out)) / 26
    kept = {r["item"]: r["counter"] for r in out[:-1]}
    assert all(truth[k] - slack <= c <= truth[k] for k, c in kept.items()) and all(k in kept for k, c in truth.items() if c > slack)
