from __future__ import annotations

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sigloom.functions.hexes import address_text, hash_text, trimmed
from sigloom.operators import copydiff
from sigloom.operators.copydiff import diff_copies, latest_rows

FIELDS = ["a", "b"]
SCHEMA = "k string, e string, id bigint, a string, b bigint"


def brute(left, right):
    def latest(rows):
        out = {}
        for r in sorted(rows, key=lambda r: r[2]):
            out[r[0], r[1]] = r
        return out

    m, c = latest(left), latest(right)
    out = []
    for key in {*m, *c}:
        if key not in c:
            out.append((*key, "missing_in_copy", None, None))
        elif key not in m:
            out.append((*key, "missing_in_main", None, None))
        else:
            for i, f in enumerate(FIELDS, start=3):
                x, y = m[key][i], c[key][i]
                if x != y:
                    out.append((*key, f, None if x is None else str(x), None if y is None else str(y)))
    return sorted(out, key=str)


def run(spark, left, right, **more):
    keys = {"k": F.col("k"), "e": F.col("e")}
    got = diff_copies(spark.createDataFrame(left, SCHEMA), spark.createDataFrame(right, SCHEMA), keys, "id", FIELDS, **more)
    return sorted((tuple(r) for r in got.collect()), key=str)


def table(rnd, n, keys):
    return [(rnd.choice([None, "", *keys]), rnd.choice(["1", "2", None]), i, rnd.choice(["x", "y", None, ""]), rnd.choice([1, 2, None])) for i in range(n)]


@pytest.mark.parametrize("seed", range(4))
def test_equals_brute_force(spark, seed):
    rnd = random.Random(seed)
    left, right = table(rnd, 300, [f"c{i}" for i in range(120)]), table(rnd, 280, [f"c{i}" for i in range(60, 180)])
    assert run(spark, left, right) == brute(left, right)


def test_hot_key_is_folded_and_still_right(spark):
    rnd = random.Random(1)
    left = [("hot", "1", i, rnd.choice("xyz"), i % 7) for i in range(3000)] + [(f"r{i}", "1", 9000 + i, "x", 1) for i in range(2000)]
    right = [("hot", "1", i, rnd.choice("xyz"), i % 5) for i in range(2500)] + [(f"r{i}", "1", 9000 + i, "x", i % 2) for i in range(2100)]
    assert run(spark, left, right, heavy_share=0.01) == brute(left, right)


def test_empty_sides(spark):
    rows = [("a", "1", 1, "x", 1), ("a", "1", 2, "y", 1), (None, None, 3, None, None)]
    assert run(spark, rows, []) == brute(rows, [])
    assert run(spark, [], rows) == brute([], rows)
    assert run(spark, [], []) == []
    assert run(spark, rows, rows) == []


def test_null_against_value_and_null(spark):
    left = [("a", "1", 1, None, None), ("b", "1", 2, None, 5)]
    right = [("a", "1", 7, None, None), ("b", "1", 8, "", None)]
    assert run(spark, left, right) == [("b", "1", "a", None, ""), ("b", "1", "b", "5", None)]


def test_extra_columns_with_clashing_names(spark):
    left = spark.createDataFrame([("a", 1, "x", "s", 0, "p")], "k string, id bigint, f string, __side string, difference int, `dot.ted` string")
    right = spark.createDataFrame([("a", 5, "y", 3.5)], "k string, id bigint, f string, __order double")
    got = diff_copies(left, right, {"k": F.col("k")}, "id", ["f"]).collect()
    assert [tuple(r) for r in got] == [("a", "f", "x", "y")]


def test_spelling_of_hashes_and_addresses(spark):
    left = spark.createDataFrame([(" A1 ", "0x0010", 1, "0XFF_FF"), ("b", "20", 2, "n/a")], "k string, e string, id bigint, h string")
    right = spark.createDataFrame([("A1", "10", 1, " ffff\t"), ("b", "0x20", 2, None)], "k string, e string, id bigint, h string")
    assert diff_copies(left, right, {"k": trimmed("k"), "e": address_text("e")}, "id", ["h"], {"h": hash_text}).count() == 0


def test_latest_rows_keeps_nulls_of_the_winner(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, None), (None, 1, "z")], "k string, id bigint, v string")
    assert sorted(map(tuple, latest_rows(df, ["k"], "id").collect()), key=str) == [("a", 2, None), (None, 1, "z")]


@pytest.mark.parametrize("size", [1, 2, 3, 7])
def test_merge_over_any_batch_borders(size):
    rnd = random.Random(size)
    rows = sorted([(f"{rnd.randrange(12):02d}", rnd.randrange(2), i, rnd.choice("xy")) for i in range(60)])
    schema = pa.schema([("k", pa.string()), ("difference", pa.string()), ("left_value", pa.string()), ("right_value", pa.string())])
    batches = [pa.record_batch({"__k0": [r[0] for r in part], "__side": pa.array([r[1] for r in part], pa.int8()), "f": [r[3] for r in part]}) for part in (rows[i : i + size] for i in range(0, len(rows), size))]

    def out(chunk):
        return sorted(tuple(r.values()) for b in copydiff._merge(iter(batches), ["__k0"], ["f"], schema, chunk) for r in b.to_pylist())

    assert out(size) == out(10**6)


def test_one_range_exchange_for_both_copies(spark):
    left = spark.createDataFrame([("a", "1", 1, "x", 1)], SCHEMA)
    plan = diff_copies(left, left, {"k": F.col("k"), "e": F.col("e")}, "id", FIELDS)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("rangepartitioning") == 1 and "SortMergeJoin" not in plan and "Cartesian" not in plan


def test_ranges_follow_the_size_of_the_input(spark, tmp_path, monkeypatch):
    from sigloom.plans.session import input_bytes

    spark.range(50_000).select(F.concat(F.lit("k"), "id").alias("k"), F.lit("e").alias("e"), "id", F.sha2(F.col("id").cast("string"), 256).alias("a"), F.col("id").alias("b")).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    assert 1_000_000 < input_bytes(df) < 20_000_000 and input_bytes(spark.createDataFrame([("a",)], "k string")) < 1_000_000
    monkeypatch.setattr(copydiff, "RANGE_BYTES", 100_000)
    out = diff_copies(df, df.where("id % 1000 <> 7"), {"k": F.col("k"), "e": F.col("e")}, "id", FIELDS)
    assert out.count() == 50 and out.select("difference").distinct().count() == 1
    assert out._jdf.queryExecution().optimizedPlan().toString().count("RepartitionByExpression") == 1
