"""Compatibility matrix of labelled sets of functions.

Within a case the last row of an entry point counts. For every ordered pair of
cases: functions of each, entry points they share, how many of these agree in
the full hash, the specific hash and both, and which share of either side is
retained. Pairs that share nothing have rows too.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigloom.functions.text import percent_text
from sigloom.plans.session import settled


def last_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The row of each key that is last by ``order``, with all its columns, nulls included."""
    rest = [c for c in df.columns if c not in keys]
    row = F.struct(*[F.col(f"`{c}`") for c in rest])
    return df.groupBy(*[F.col(f"`{k}`") for k in keys]).agg(F.max_by(row, F.struct(*[F.col(f"`{o}`") for o in order])).alias("__row")).select(*[F.col(f"`{k}`") for k in keys], "__row.*").select(*df.columns)


def case_counts(df: DataFrame, case: str, entry: str) -> DataFrame:
    """Rows of each case as they come, and functions once repeated entry points are folded."""
    per = df.groupBy(case, entry).agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy(case).agg(F.sum("n").alias("raw_rows"), F.count(F.lit(1)).alias("hashable"))


def compat_matrix(df: DataFrame, case: str, entry: str, full: str, specific: str, order: Sequence[str]) -> DataFrame:
    """One row per ordered pair of cases, the diagonal included.

    Hashes are compared null-safe; a null entry point reads ``None``. The rows
    of an entry point (one per case at most) meet in one group and the pairs
    are counted where they arise, so only counters cross the last exchange.
    The counters, one row per pair that shares something, are computed when
    this is called; the grid of all pairs is made from them.
    """
    last = last_rows(df.select(F.col(case).alias("c"), F.coalesce(F.col(entry).cast("string"), F.lit("None")).alias("e"), F.col(full).alias("f"), F.col(specific).alias("s"), *[F.col(o).alias(f"o{i}") for i, o in enumerate(order)]), ["c", "e"], [f"o{i}" for i in range(len(order))])
    at = last.groupBy("e").agg(F.collect_list(F.struct("c", "f", "s")).alias("rows"))
    pairs = at.select(F.explode("rows").alias("r"), "rows").select("r", F.explode("rows").alias("k"))
    counts = pairs.groupBy(F.col("r.c").alias("reference_case"), F.col("k.c").alias("comparison_case")).agg(
        F.count(F.lit(1)).alias("shared_entrypoints"),
        F.count_if(F.col("r.f").eqNullSafe(F.col("k.f"))).alias("full_hash_equal"),
        F.count_if(F.col("r.s").eqNullSafe(F.col("k.s"))).alias("specific_hash_equal"),
        F.count_if(F.col("r.f").eqNullSafe(F.col("k.f")) & F.col("r.s").eqNullSafe(F.col("k.s"))).alias("dual_hash_equal"),
    )
    counts = settled(counts, "pairs")
    # the diagonal counts every function of a case once
    sizes = counts.where(F.col("reference_case") == F.col("comparison_case")).select(F.col("reference_case").alias("case_"), F.col("shared_entrypoints").alias("n"))
    left = sizes.select(F.col("case_").alias("reference_case"), F.col("n").alias("reference_hashable"))
    right = sizes.select(F.col("case_").alias("comparison_case"), F.col("n").alias("comparison_hashable"))
    grid = left.crossJoin(F.broadcast(right))  # cases, not rows: as many as there are labels, whose square is the result
    numbers = ["shared_entrypoints", "full_hash_equal", "specific_hash_equal", "dual_hash_equal"]
    return (
        grid.join(counts, ["reference_case", "comparison_case"], "left")
        .select("reference_case", "comparison_case", "reference_hashable", "comparison_hashable", *[F.coalesce(n, F.lit(0)).alias(n) for n in numbers])
        .withColumn("reference_retained_pct", percent_text("dual_hash_equal", "reference_hashable"))
        .withColumn("comparison_retained_pct", percent_text("dual_hash_equal", "comparison_hashable"))
    )


def pivot_matrix(matrix: DataFrame, cases: Sequence[str]) -> DataFrame:
    """Retained share of the reference as one column per comparison case."""
    return matrix.groupBy("reference_case").pivot("comparison_case", list(cases)).agg(F.first("reference_retained_pct"))


def shared_entries(df: DataFrame, case: str, entry: str, left: str, right: str) -> DataFrame:
    """Entry points that both cases have."""
    return df.where(F.col(case) == left).select(entry).intersect(df.where(F.col(case) == right).select(entry))


def missing_entries(df: DataFrame, case: str, entry: str, left: str, right: str) -> DataFrame:
    """Entry points of ``left`` that ``right`` lacks."""
    return df.where(F.col(case) == left).select(entry).distinct().join(df.where(F.col(case) == right).select(entry).distinct(), entry, "left_anti")
