from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sigloom.llm import setsketch as S


def numbers(spark, lo, hi, group="g"):
    return spark.range(lo, hi).select(F.lit(group).alias("g"), F.col("id").cast("string").alias("x"))


@pytest.mark.parametrize(("m", "base"), [(1024, 1.05), (1024, 2.0), (4096, 1.02), (256, 1.5)])
@pytest.mark.parametrize("n", [1, 30, 700, 20000])
def test_counts_stay_within_four_standard_errors(spark, m, base, n):
    got = S.estimate(S.sketch(numbers(spark, 0, n), ["g"], "x", m, base), ["g"], m, base).first()
    assert abs(got["distinct_estimate"] - n) <= max(4 * S.relative_error(m, base) * n, 1.0)
    assert got["n_rows"] == n


def test_repeats_change_rows_only_and_nulls_are_no_items(spark):
    df = numbers(spark, 0, 500)
    twice = df.unionByName(df).unionByName(spark.createDataFrame([("g", None), (None, "1")], "g string, x string"))
    got = {r["g"]: (round(r["distinct_estimate"], 6), r["n_rows"]) for r in S.estimate(S.sketch(twice, ["g"], "x"), ["g"]).collect()}
    alone = S.estimate(S.sketch(df, ["g"], "x"), ["g"]).first()
    assert got["g"] == (round(alone["distinct_estimate"], 6), 1000)
    assert got[None][1] == 1


def test_partial_results_combine_to_the_whole(spark):
    whole = S.sketch(numbers(spark, 0, 3000), ["g"], "x")
    parts = S.merge(S.sketch(numbers(spark, 0, 1800), ["g"], "x"), S.sketch(numbers(spark, 1200, 3000), ["g"], "x"))
    assert {(r["register"], r["value"]) for r in whole.collect()} == {(r["register"], r["value"]) for r in parts.collect()}


def test_empty_table_has_no_registers(spark):
    cells = S.sketch(spark.createDataFrame([], "g string, x string"), ["g"], "x")
    assert cells.count() == 0 and S.estimate(cells, ["g"]).count() == 0


def test_coarser_groups_come_from_registers(spark):
    df = numbers(spark, 0, 900, "a").withColumn("h", F.lit("u")).unionByName(numbers(spark, 600, 1500, "a").withColumn("h", F.lit("v")))
    cells = S.sketch(df, ["g", "h"], "x")
    rolled = S.estimate(S.rollup_sets(cells, ["g", "h"], [["g", "h"], ["g"]]), ["g", "h"])
    got = {(r["g"], r["h"]): (r["distinct_estimate"], r["n_rows"]) for r in rolled.collect()}
    assert set(got) == {("a", "u"), ("a", "v"), ("a", "*")}
    assert got["a", "*"][1] == 1800 and abs(got["a", "*"][0] - 1500) < 4 * S.relative_error() * 1500


def registers(items, m, base):
    rnd = {x: random.Random(f"{x}-s") for x in items}
    k = np.zeros(m, dtype=np.int64)
    for x in items:
        r = rnd[x]
        i = r.randrange(m)
        k[i] = max(k[i], math.floor(1 - math.log(1 - r.random()) / math.log(base)))
    return k


@pytest.mark.parametrize(("only_left", "only_right", "both"), [(4000, 4000, 4000), (500, 9000, 300), (3000, 3000, 0), (0, 0, 5000), (40, 60, 30), (0, 5000, 700)])
def test_joint_estimate_stays_within_its_error(only_left, only_right, both):
    m, base = 1024, 1.05
    shared = [f"s{i}" for i in range(both)]
    k1 = registers([f"l{i}" for i in range(only_left)] + shared, m, base)
    k2 = registers([f"r{i}" for i in range(only_right)] + shared, m, base)
    got = S.joint_estimate(k1, k2, m, base)
    union = only_left + only_right + both
    assert abs(got["union"] - union) <= 4 * got["union_error"]
    assert abs(got["intersection"] - both) <= 4 * got["intersection_error"]
    assert abs(got["jaccard"] - both / union) <= 4 * got["jaccard_error"]


def drawn(rng, n, m, base):
    k = np.zeros(m, dtype=np.int64)
    np.maximum.at(k, rng.integers(0, m, n), np.floor(1 - np.log(1 - rng.random(n)) / np.log(base)).astype(np.int64))
    return k


@pytest.mark.parametrize(("only_left", "only_right", "both"), [(4000, 4000, 4000), (20000, 20000, 20000), (500, 9000, 300)])
def test_stated_errors_are_those_of_repeated_draws(only_left, only_right, both):
    rng, m, base = np.random.default_rng(5), 1024, 1.05
    union, runs = only_left + only_right + both, []
    for _ in range(60):
        left, right, shared = (drawn(rng, n, m, base) for n in (only_left, only_right, both))
        runs.append(S.joint_estimate(np.maximum(left, shared), np.maximum(right, shared), m, base))
    for name, truth in (("union", union), ("intersection", both), ("jaccard", both / union)):
        seen = math.sqrt(np.mean([(r[name] - truth) ** 2 for r in runs]))
        assert 0.7 * seen <= np.mean([r[f"{name}_error"] for r in runs]) <= 1.4 * seen, name


@pytest.mark.parametrize(("only_left", "only_right", "both"), [(4000, 4000, 4000), (500, 9000, 300), (3000, 3000, 0), (0, 0, 5000), (40, 60, 30), (0, 5000, 700), (49_100, 100, 900)])
def test_nine_draws_in_ten_lie_within_twice_the_stated_error(only_left, only_right, both):
    rng, m, base = np.random.default_rng(7), 1024, 1.05
    union, runs = only_left + only_right + both, []
    for _ in range(80):
        left, right, shared = (drawn(rng, n, m, base) for n in (only_left, only_right, both))
        runs.append(S.joint_estimate(np.maximum(left, shared), np.maximum(right, shared), m, base))
    for name, truth in (("union", union), ("intersection", both), ("jaccard", both / union)):
        assert np.mean([abs(r[name] - truth) <= 2 * r[f"{name}_error"] for r in runs]) >= 0.9, name


@pytest.mark.parametrize("base", [1.001, 1.05, 2.0, 4.0])
def test_joint_estimate_of_very_unequal_sets(base):
    rng, m = np.random.default_rng(6), 256
    for only_left, only_right, both in ((1, 1_000_000, 0), (0, 300_000, 1), (0, 0, 1), (1, 1, 0), (0, 200_000, 200_000), (3, 0, 200_000)):
        left, right, shared = (drawn(rng, n, m, base) for n in (only_left, only_right, both))
        got = S.joint_estimate(np.maximum(left, shared), np.maximum(right, shared), m, base)
        union = only_left + only_right + both
        assert all(math.isfinite(x) and x >= 0 for x in got.values())
        assert abs(got["union"] - union) <= 4.5 * max(got["union_error"], 1) and got["intersection"] <= got["union"]


def test_joint_estimate_of_empty_sets():
    none = np.zeros(64, dtype=np.int64)
    assert S.joint_estimate(none, none, 64, 1.2)["union"] == 0
    assert S.joint_estimate(none, registers(["a", "b"], 64, 1.2), 64, 1.2)["jaccard"] == 0


def test_overlap_of_groups(spark):
    a, b = S.sketch(numbers(spark, 0, 4000), ["g"], "x"), S.sketch(numbers(spark, 2000, 6000), ["g"], "x")
    lone = S.sketch(numbers(spark, 0, 50, None), ["g"], "x")
    got = {r["g"]: r for r in S.overlap(S.merge(a, lone), b, ["g"]).collect()}
    assert abs(got["g"]["jaccard"] - 1 / 3) < 0.06 and abs(got["g"]["union"] - 6000) < 900
    assert got[None]["intersection"] == 0


def test_exact_counts_of_every_group(spark):
    rows = [("a", "x", 1), ("a", "x", 1), ("a", "y", 1), ("b", "x", 2), ("b", None, 3), ("b", "x", None)]
    df = spark.createDataFrame(rows, "g string, t string, x int")
    got = {(r["g"], r["t"]): r["distinct_exact"] for r in S.exact_counts(df, ["g", "t"], [["g", "t"], ["g"]], "x").collect()}
    assert got == {("a", "x"): 1, ("a", "y"): 1, ("b", "x"): 1, ("b", None): 1, ("a", "*"): 1, ("b", "*"): 2}
    assert S.exact_counts(df.limit(0), ["g"], [["g"]], "x").count() == 0


def test_parameters_are_checked(spark):
    for m, base in ((100, 2.0), (1024, 1.0), (8, 2.0)):
        with pytest.raises(ValueError):
            S.sketch(numbers(spark, 0, 1), ["g"], "x", m, base)


def test_extra_columns_with_clashing_names(spark):
    df = numbers(spark, 0, 10).withColumns({"register": F.lit(1), "value": F.lit(2), "a.b": F.lit("z")})
    assert S.sketch(df, ["g", "a.b"], "x").count() > 0
