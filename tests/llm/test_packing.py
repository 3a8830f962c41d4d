from __future__ import annotations

import random

import numpy as np
import pytest

from pyspark.sql import functions as F

from sigloom.llm import packing
from sigloom.llm.packing import Limits, fill, pack, pieces

KIND = "id bigint, n bigint, p bigint"


def check(rows, packed, limits):
    """Every item once, whole unless it exceeds a limit, no container over a limit."""
    by: dict = {}
    for r in packed:
        by.setdefault(r["id"], []).append(r)
    assert set(by) == {i for i, _, _ in rows}
    for i, n, p in rows:
        n, p = n or 0, min(p or 0, n or 0)
        got = sorted(by[i], key=lambda r: r["piece"])
        assert [(r["token_start"], r["n_tokens"], r["n_loss"]) for r in got] == pieces(n, p, limits)
        assert sum(r["n_tokens"] for r in got) == n and sum(r["n_loss"] for r in got) == n - p
        assert len(got) == 1 or n > limits.tokens or n - p > limits.loss
    boxes: dict = {}
    for r in packed:
        b = boxes.setdefault(r["container"], [0, 0, 0, set()])
        b[0] += r["n_tokens"]
        b[1] += 1
        b[2] += r["n_loss"]
        b[3].add(r["position"])
    for tokens, segments, loss, places in boxes.values():
        assert tokens <= limits.tokens and segments <= limits.segments and loss <= limits.loss and places == set(range(segments))
    return boxes


def items(n, seed, most=3000):
    rnd = random.Random(seed)
    return [(i, int(min(rnd.paretovariate(0.7) * 20, most)), rnd.choice([0, 0, 5, 50])) for i in range(n)]


@pytest.mark.parametrize(("limits", "slack"), [(Limits(), 0.03), (Limits(1024, 6, 1024), None), (Limits(512, 64, 300), 0.75)])
def test_limits_hold_and_little_is_left(spark, limits, slack):
    rows = items(900, 1)
    packed = pack(spark.createDataFrame(rows, KIND), "id", "n", "p", limits).collect()
    boxes = check(rows, packed, limits)
    if slack:
        assert len(boxes) <= (1 + slack) * max(sum(n for _, n, _ in rows) / limits.tokens, len(rows) / limits.segments, sum(max(0, n - p) for _, n, p in rows) / limits.loss) + 2


def test_several_groups_and_buffers(spark):
    rows = items(1200, 2)
    packed = pack(spark.createDataFrame(rows, KIND), "id", "n", "p", group=150, count=len(rows)).collect()
    check(rows, packed, Limits())
    assert len({r["container"].split("-")[0] for r in packed}) == 8


def test_result_does_not_depend_on_partitions(spark):
    df = spark.createDataFrame(items(400, 3), KIND)
    a = sorted(map(tuple, pack(df.repartition(3), "id", "n", "p", group=100).collect()))
    assert a == sorted(map(tuple, pack(df.repartition(11), "id", "n", "p", group=100).collect()))


def test_edges(spark):
    rows = [(1, 0, 0), (2, None, None), (3, 2048, 0), (4, 2049, 0), (5, 10_000, 9_000), (6, 1, 5)]
    check(rows, pack(spark.createDataFrame(rows, KIND), "id", "n", "p").collect(), Limits())
    assert pack(spark.createDataFrame([], KIND), "id", "n", "p").count() == 0
    assert sorted(map(str, (r["id"] for r in pack(spark.createDataFrame([(None, 5, None), (1, None, 3)], KIND), "id", "n", "p").collect()))) == ["1", "None"]
    same = spark.createDataFrame([(7, 5, 0)] * 100, KIND)
    assert pack(same, "id", "n", "p").count() == 100


def test_many_repeated_ids_stay_in_bounded_buffers(spark):
    rows = [(1, 100, 0)] * 500 + [(i, 30, 0) for i in range(2, 400)]
    packed = pack(spark.createDataFrame(rows, KIND), "id", "n", "p", group=50).collect()
    assert len(packed) == len(rows)
    total: dict = {}
    for r in packed:
        total[r["container"]] = total.get(r["container"], 0) + r["n_tokens"]
    assert max(total.values()) <= 2048


def test_one_group_is_one_task(spark):
    packed = pack(spark.createDataFrame(items(3000, 4), KIND), "id", "n", "p", group=100)
    spread = packed.select(F.split("container", "-")[0].alias("group"), F.spark_partition_id().alias("task")).distinct()
    assert spread.count() == spread.select("group").distinct().count() == spread.select("task").distinct().count() == 30


def test_items_without_id_are_spread(spark):
    packed = pack(spark.createDataFrame([(None, 5, 0)] * 1000, KIND), "id", "n", "p", group=100)
    assert packed.count() == 1000 and packed.select(F.split("container", "-")[0]).distinct().count() == 10


def test_check_finds_nothing_wrong_and_every_fault(spark):
    limits = Limits(512, 64, 300)
    rows = spark.createDataFrame([*items(300, 5), (None, 7, 0), (None, 7, 0), (5000, 2000, 100), (5001, None, None)], KIND)
    packed = pack(rows, "id", "n", "p", limits)
    good = packing.check(rows, packed, "id", "n", "p", limits).first().asDict()
    assert good.pop("n_items") == 304 and not any(good.values())
    faults = {
        "n_lost_or_repeated": packed.where("id <> 17"),
        "n_changed_sizes": packed.withColumn("n_tokens", F.when(F.col("id") == 17, F.col("n_tokens") + 1).otherwise(F.col("n_tokens"))),
        "n_misplaced_pieces": packed.withColumn("token_start", F.lit(0).cast("bigint")),
        "n_over_limits": packed.withColumn("container", F.lit("x")),
        "n_shared_positions": packed.withColumn("position", F.lit(0)),
    }
    for name, wrong in faults.items():
        assert packing.check(rows, wrong, "id", "n", "p", limits).first()[name] > 0, name
    assert packing.check(rows, packed, "id", "n", "p", Limits(4096, 64, 4096)).first()["n_cut_needlessly"] > 0
    empty = rows.limit(0)
    assert sum(packing.check(empty, pack(empty, "id", "n", "p"), "id", "n", "p").first()) == 0


def test_dot_product_prefers_what_uses_scarce_space():
    # tokens are scarce, segments are not: the long item goes first
    c, p = fill(np.array([10, 90, 10]), np.array([0, 0, 0]), Limits(100, 10, 100))
    assert c.tolist() == [0, 0, 1] and p.tolist() == [1, 0, 0]
    assert fill(np.array([], dtype=int), np.array([], dtype=int), Limits())[0].tolist() == []


def test_limits_are_checked():
    with pytest.raises(ValueError):
        Limits(0, 1, 1)
