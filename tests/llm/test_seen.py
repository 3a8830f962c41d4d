from __future__ import annotations

import os
import random

import pytest
from pyspark.sql import functions as F

from sigloom.llm.seen import first_or_repeat, store_for

def keys():
    return [F.col("a"), F.col("b")]

INCOMING = "incoming_id bigint, at string, a string, b bigint"


def brute(history, incoming):
    known = {(a, b) for a, b in history if a is not None and b is not None}
    out = {}
    for i, _, a, b in sorted(incoming, key=lambda r: (r[1] is not None, r[1] or "", r[0])):
        if a is None or b is None:
            out[i] = None
        else:
            out[i] = (a, b) in known
            known.add((a, b))
    return out


def run(spark, history, incoming):
    got = first_or_repeat(spark.createDataFrame(history, "a string, b bigint"), keys(), spark.createDataFrame(incoming, INCOMING), keys(), "incoming_id", ["at"])
    rows = got.collect()
    assert len(rows) == len(incoming)
    return {r["incoming_id"]: r["seen_before"] for r in rows}


@pytest.mark.parametrize("seed", range(2))
def test_equals_brute_force(spark, seed):
    rnd = random.Random(seed)
    pick = lambda: (rnd.choice(["x", "y", None, "", "z"]), rnd.choice([None, *range(12)]))
    history = [pick() for _ in range(60)]
    ids = list(range(150))
    rnd.shuffle(ids)
    incoming = [(i, rnd.choice([None, "t1", "t2", "t3"]), *pick()) for i in ids]
    assert run(spark, history, incoming) == brute(history, incoming)


def test_empty_inputs(spark):
    incoming = [(2, "t1", "x", 1), (1, "t1", "x", 1), (3, "t0", "y", None)]
    assert run(spark, [], incoming) == {1: False, 2: True, 3: None}
    assert run(spark, [("x", 1)], []) == {}
    assert run(spark, [(None, 1)], [(1, "t", "x", 1)]) == {1: False}


def test_one_key_with_a_third_of_all_rows(spark):
    history = [("hot", 1)] * 400 + [("r", i) for i in range(800)]
    incoming = [(i, f"{i:04d}", "hot" if i % 3 == 0 else f"k{i}", 1 if i % 3 == 0 else i % 50) for i in range(600)]
    assert run(spark, history, incoming) == brute(history, incoming)


def flags(df):
    return {r["id"]: r["seen"] for r in df.collect()}


def test_state_outlives_a_turn_and_never_expires(spark):
    """Later turns read their own rows only: what went in before is gone from the folder, and still known."""
    rows = lambda *r: spark.createDataFrame(list(r), "id bigint, k string")
    store = store_for(rows((1, "a")), [F.col("k")], ["id"])
    store.load(spark.createDataFrame([("a",), ("b",), ("a",)], "k string"), [F.col("k")])
    assert not os.path.exists(f"{store.path}/input/turn=0".removeprefix("file:"))
    one = store.mark(rows((1, "a"), (2, "c"), (3, "c")), [F.col("k")], "id", ["id"], "seen")
    assert flags(one) == {1: True, 2: False, 3: True}
    two = store.mark(rows((0, "c"), (5, "d"), (4, "d"), (6, "b")), [F.col("k")], "id", ["id"], "seen")
    assert flags(two) == {0: True, 5: True, 4: False, 6: True}
    assert flags(one) == {1: True, 2: False, 3: True}
    store.forget()
    assert flags(two) == {0: True, 5: True, 4: False, 6: True}


def test_many_small_batches_give_the_same(spark):
    rows = spark.range(400).select("id", (F.col("id") % 100).alias("k")).repartition(5)
    store = store_for(rows, [F.col("k")], ["id"], partitions=3, batch_bytes=1)
    store.load(spark.range(200).select((F.col("id") % 60).alias("k")).repartition(6), [F.col("k")])
    got = flags(store.mark(rows, [F.col("k")], "id", ["id"], "seen"))
    assert sorted(i for i, seen in got.items() if not seen) == list(range(60, 100)) and len(got) == 400


def test_folders_are_removed_on_an_error(spark):
    bad = spark.createDataFrame([(1, "x")], "id bigint, k string").select("id", F.expr("raise_error('no')").cast("string").alias("k"))
    store = store_for(bad, [F.col("k")], ["id"])
    with pytest.raises(Exception, match="no"):
        store.load(bad, [F.col("k")])
    assert not os.path.exists(f"{store.path}/input/turn=0".removeprefix("file:"))


def test_streaming_settings_are_put_back(spark):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    run(spark, [("x", 1)], [(1, "t", "x", 1)])
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == before


def test_clashing_columns(spark):
    incoming = spark.createDataFrame([(1, "t", "x", 1, "k", 5, True)], INCOMING + ", k0 string, tag int, own boolean")
    got = first_or_repeat(spark.createDataFrame([("x", 1)], "a string, b bigint"), keys(), incoming, keys(), "incoming_id", ["at"])
    assert got.first()["seen_before"] is True and got.first()["tag"] == 5
    again = first_or_repeat(incoming, keys(), incoming.withColumn("seen_before", F.lit("old")), keys(), "incoming_id", ["at"])
    assert again.columns == [*incoming.columns, "seen_before"] and again.first()["seen_before"] is True


def test_rows_without_id_or_time(spark):
    assert run(spark, [], [(None, "t", "x", 1), (1, "t", "x", 1), (2, None, "x", 1)]) == {None: None, 1: True, 2: False}
