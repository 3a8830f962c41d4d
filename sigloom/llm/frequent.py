"""Most frequent items in bounded memory: Misra-Gries summaries.

Each partition keeps at most ``counters`` counters. A batch adds its counts;
when more than ``counters`` remain, the next largest counter (the one after the
kept ones) is subtracted from all and the non-positive ones go. Summaries merge
by the same rule. With c counters over n items a counter is too low by at most
(n - sum of counters) / (c + 1) <= n / (c + 1), never too high, so every item
above that frequency is among them. Memory, shuffle and result do not depend on
the number of distinct values: (partitions x counters) rows at most, merged in
three levels, each merger with one summary and a chunk of rows in memory.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

COUNTERS = 2047
#: Mergers of the levels before the last one; each takes its share of the summaries below it.
FANS = (4096, 64)


def reduce_counters(values: pa.Array, counts: np.ndarray, counters: int) -> tuple[pa.Array, np.ndarray]:
    """At most ``counters`` of the counters, by subtracting the next largest."""
    if len(counts) <= counters:
        return values, counts
    cut = np.partition(counts, len(counts) - counters - 1)[len(counts) - counters - 1]
    left = counts - cut
    keep = left > 0
    return values.filter(pa.array(keep)), left[keep]


def add_counters(values: pa.Array, counts: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """One counter per value."""
    t = pa.table({"v": values, "c": pa.array(counts, pa.int64())}).group_by("v").aggregate([("c", "sum")])
    v = t.column("v").combine_chunks()
    return (pa.concat_arrays(v.chunks) if isinstance(v, pa.ChunkedArray) else v), t.column("c_sum").to_numpy()


def summarise(batches: Iterator[pa.RecordBatch], counters: int, chunk: int = 1 << 17) -> Iterator[pa.RecordBatch]:
    """Values of one column -> one row per counter, and a row without item for the totals."""
    values, counts = pa.array([], pa.string()), np.zeros(0, dtype=np.int64)
    rows = items = 0
    held: list[pa.Array] = []
    size = 0

    def fold() -> None:
        nonlocal values, counts, held, size
        if not held:
            return
        seen = pc.value_counts(pa.chunked_array(held))
        held, size = [], 0
        both = pa.concat_arrays([values, seen.field(0).cast(pa.string())])
        values, counts = reduce_counters(*add_counters(both, np.concatenate([counts, seen.field(1).to_numpy()])), counters)

    for b in batches:
        c = b.column(0)
        rows += len(c)
        c = c.drop_null()
        items += len(c)
        held.append(c)
        size += len(c)
        if size >= chunk:
            fold()
    fold()
    yield pa.record_batch({"item": pa.concat_arrays([values, pa.nulls(1, pa.string())]), "counter": np.append(counts, 0), "n_rows": np.append(np.zeros(len(counts), np.int64), rows), "n_items": np.append(np.zeros(len(counts), np.int64), items)})


def merge_summaries(batches: Iterator[pa.RecordBatch], counters: int, chunk: int = 1 << 17) -> Iterator[pa.RecordBatch]:
    """Rows of any number of summaries -> one summary, totals in the row without item. Memory: counters and a chunk."""
    values, counts = pa.array([], pa.string()), np.zeros(0, dtype=np.int64)
    rows = items = 0
    held: list[pa.RecordBatch] = []
    size = 0

    def fold() -> None:
        nonlocal values, counts, held, size
        if not held:
            return
        t = pa.Table.from_batches(held)
        held, size = [], 0
        both = pa.concat_arrays([values, *t.column("item").cast(pa.string()).chunks])
        values, counts = reduce_counters(*add_counters(both, np.concatenate([counts, t.column("counter").to_numpy()])), counters)

    for b in batches:
        rows += pc.sum(b.column("n_rows")).as_py() or 0
        items += pc.sum(b.column("n_items")).as_py() or 0
        some = b.filter(pc.is_valid(b.column("item")))
        if some.num_rows:
            held.append(some.select(["item", "counter"]))
            size += some.num_rows
        if size >= chunk:
            fold()
    fold()
    zero = np.zeros(len(counts), np.int64)
    yield pa.record_batch({"item": pa.concat_arrays([values, pa.nulls(1, pa.string())]), "counter": np.append(counts, 0), "n_rows": np.append(zero, rows), "n_items": np.append(zero, items)})


_SUMMARY = "item string, counter bigint, n_rows bigint, n_items bigint"


def frequent_items(df: DataFrame, column: str, counters: int = COUNTERS) -> DataFrame:
    """item, lower_bound, upper_bound, n_rows, n_items: at most ``counters`` rows.

    Items are the column's values as strings; nulls are no items but count in
    ``n_rows``. An empty table gives no rows. Every item with more than
    ``n_items / (counters + 1)`` occurrences is present; its true count lies
    between the bounds.
    """
    summary = df.select(F.col(f"`{column}`").cast("string").alias("item")).mapInArrow(lambda it: summarise(it, counters), _SUMMARY)
    for fan in FANS:
        spread = summary.withColumn("__part", F.pmod(F.spark_partition_id(), F.lit(fan))).repartition("__part").drop("__part")
        summary = spread.mapInArrow(lambda it: merge_summaries(it, counters), _SUMMARY)

    def bounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in merge_summaries(batches, counters):
            n_rows, n_items, kept = b.column("n_rows")[-1].as_py(), b.column("n_items")[-1].as_py(), b.slice(0, b.num_rows - 1)
            low = kept.column("counter").to_numpy()
            slack = (n_items - int(low.sum())) // (counters + 1)
            yield pa.record_batch({"item": kept.column("item"), "lower_bound": low, "upper_bound": low + slack, "n_rows": np.full(len(low), n_rows), "n_items": np.full(len(low), n_items)})

    return summary.repartition(1).mapInArrow(bounds, "item string, lower_bound bigint, upper_bound bigint, n_rows bigint, n_items bigint")


def frequent_exact(df: DataFrame, column: str, share: float, counters: int = COUNTERS) -> DataFrame:
    """item, n, n_rows of the items that at least ``share`` of all rows carry.

    Candidates come from the summary (those whose upper bound reaches the
    share); a second scan counts them alone, by a broadcast of at most
    ``counters`` rows. Needs ``share > 1 / (counters + 1)``.
    """
    if share * (counters + 1) <= 1:
        raise ValueError("too few counters for this share")
    found = frequent_items(df, column, counters).where(F.col("upper_bound") >= F.col("n_rows") * F.lit(share)).select("item", "n_rows")
    hits = df.select(F.col(f"`{column}`").cast("string").alias("item")).join(F.broadcast(found), "item")
    return hits.groupBy("item", "n_rows").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= F.col("n_rows") * F.lit(share)).select("item", "n", "n_rows")
