"""Per-key results when a few keys hold most rows.

Heavy keys are found with a bounded frequent-items sketch over a 64-bit digest
of the key (one scan of the key columns, nothing is shuffled but sketches) when
a plan is made; it then holds their digests, few by construction, as constants,
and a road that no row would take drops out of it. Their rows take a road of their own: aggregates go through (key, salt) groups
first, joins get the dimension rows of the heavy keys by broadcast. All other
rows take the ordinary shuffle; the two results are united. Which keys count
as heavy only decides the road a row takes, never the result.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigloom.plans.session import input_bytes

#: A key with this share of the rows is heavy.
HEAVY_SHARE = 0.001
#: Counters of the sketch; its counts are off by at most 3.5 / 16384 of the rows.
TRACKED = 10_000
#: A plan holds at most so many digests of heavy keys (8 bytes each).
MOST_HEAVY = 100_000
#: Up to so many are compared in a filter; more come as a broadcast table.
IN_FILTER = 1_000
#: Bytes of input for a partition of a shuffle.
PARTITION_BYTES = 64 << 20
#: First-level combiners of the partitions' sketches.
FAN = 512
#: Ways in which the rows of a heavy key are divided.
SALTS = 64

_DIGEST = "__key_digest"


def key_digest(keys: Sequence[str]) -> Column:
    return F.xxhash64(*[F.col(f"`{k}`") for k in keys])


def heavy_digests(df: DataFrame, keys: Sequence[str], share: float = HEAVY_SHARE, tracked: int = TRACKED) -> DataFrame:
    """Digests of the keys with about ``share`` of the rows or more: at most ``2 / share`` rows.

    Null is a key like any other. An empty table has no heavy key. Sketches of
    the input's partitions are combined in two levels, so no task gathers more
    than ``FAN`` of them however many partitions there are.
    """
    k = min(MOST_HEAVY, math.ceil(2 / share))
    size = max(tracked, k)
    # one row more: sketches of nothing cannot be combined
    digests = df.select(key_digest(keys).alias(_DIGEST)).unionByName(df.sparkSession.range(1, numPartitions=1).select(F.lit(0).cast("bigint").alias(_DIGEST)))
    parts = digests.withColumn("part", F.pmod(F.spark_partition_id(), F.lit(FAN)))
    some = parts.groupBy("part").agg(F.expr(f"approx_top_k_accumulate({_DIGEST}, {size})").alias("s"), F.count(F.lit(1)).alias("n"))
    top = some.agg(F.expr(f"approx_top_k_combine(s, {size})").alias("s"), F.sum("n").alias("n")).select(F.expr(f"approx_top_k_estimate(s, {k})").alias("top"), "n")
    return top.where("n > 1").select(F.explode("top").alias("t"), "n").where(F.col("t.count") >= F.col("n") * F.lit(share)).select(F.col("t.item").alias(_DIGEST))


def heavy_keys(df: DataFrame, keys: Sequence[str], share: float = HEAVY_SHARE) -> list[int]:
    """The digests of :func:`heavy_digests`, fetched: at most ``min(2 / share, MOST_HEAVY)`` numbers."""
    return sorted(r[0] for r in heavy_digests(df, keys, share).collect())


def join_share(df: DataFrame) -> float:
    """The share of the rows that is half a partition of a shuffle of them: the session's partitions, or one for 64 MB of input."""
    partitions = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), input_bytes(df) // PARTITION_BYTES)
    return max(0.5 / partitions, 2 / MOST_HEAVY)


def split_heavy(df: DataFrame, keys: Sequence[str], heavy: Sequence[int]) -> tuple[DataFrame, DataFrame]:
    """Rows with a heavy key, and all others."""
    if not heavy:
        return df.where(F.lit(False)), df
    if len(heavy) <= IN_FILTER:
        hot = key_digest(keys).isin(*heavy)
        return df.where(hot), df.where(~hot)
    small = F.broadcast(df.sparkSession.createDataFrame([(d,) for d in heavy], f"{_DIGEST} bigint"))
    tagged = df.withColumn(_DIGEST, key_digest(keys))
    return tagged.join(small, _DIGEST, "left_semi").drop(_DIGEST), tagged.join(small, _DIGEST, "left_anti").drop(_DIGEST)


@dataclass(frozen=True)
class Agg:
    """An aggregate that can be merged: ``partial`` over rows, ``merge`` over the partial column."""

    name: str
    partial: Column
    merge: Callable[[str], Column]


def rows(name: str) -> Agg:
    return Agg(name, F.count(F.lit(1)), F.sum)


def least(name: str, value: Column) -> Agg:
    return Agg(name, F.min(value), F.min)


def greatest(name: str, value: Column) -> Agg:
    return Agg(name, F.max(value), F.max)


def total(name: str, value: Column) -> Agg:
    return Agg(name, F.sum(value), F.sum)


def _salt(df: DataFrame, salts: int) -> Column:
    plain = [f"`{f.name}`" for f in df.schema.fields if "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()]
    return F.pmod(F.xxhash64(*[F.col(c) for c in plain], F.lit(17)), F.lit(salts))


def salted_aggregate(df: DataFrame, keys: Sequence[str], aggs: Sequence[Agg], salts: int = SALTS) -> DataFrame:
    """Two-level aggregate: (key, salt) first, then key. Equal rows share a salt; the map-side combine folds them."""
    first = df.withColumn("__salt", _salt(df, salts)).groupBy(*[F.col(f"`{k}`") for k in keys], "__salt").agg(*[a.partial.alias(a.name) for a in aggs])
    return first.groupBy(*[F.col(f"`{k}`") for k in keys]).agg(*[a.merge(a.name).alias(a.name) for a in aggs])


def _roads(df: DataFrame, keys: Sequence[str], aggs: Sequence[Agg], heavy: Sequence[int], salts: int) -> tuple[tuple[DataFrame, DataFrame], tuple[DataFrame, DataFrame]]:
    """Rows and results of the heavy keys, and of all others."""
    hot, rest = split_heavy(df, keys, heavy)
    ordinary = rest.groupBy(*[F.col(f"`{k}`") for k in keys]).agg(*[a.partial.alias(a.name) for a in aggs])
    return (hot, salted_aggregate(hot, keys, aggs, salts)), (rest, ordinary)


def skewed_aggregate(df: DataFrame, keys: Sequence[str], aggs: Sequence[Agg], share: float = HEAVY_SHARE, heavy: Sequence[int] | None = None, salts: int = SALTS) -> DataFrame:
    """``groupBy(keys).agg(...)`` without slow tasks for heavy keys. Null keys form a group; no rows give no groups."""
    (_, hot), (_, ordinary) = _roads(df, keys, aggs, heavy_keys(df, keys, share) if heavy is None else heavy, salts)
    return hot.unionByName(ordinary)


def aggregate_beside_rows(df: DataFrame, keys: Sequence[str], aggs: Sequence[Agg], share: float | None = None, heavy: Sequence[int] | None = None, salts: int = SALTS) -> DataFrame:
    """Every row with the aggregates of its key; rows with a null in their key drop out.

    Heavy keys (by default those of half a partition, see :func:`join_share`)
    are looked for once. Their results (at most ``2 / share`` rows) are
    broadcast to their rows; rows and results of all other keys meet by one
    shuffle. Aggregates must not be named like columns.
    """
    (hot, few), (rest, others) = _roads(df, keys, aggs, heavy_keys(df, keys, share or join_share(df)) if heavy is None else heavy, salts)
    return hot.join(F.broadcast(few), list(keys)).unionByName(rest.join(others, list(keys)))


def skewed_join(fact: DataFrame, dim: DataFrame, on: Sequence[str], share: float | None = None, heavy: Sequence[int] | None = None) -> DataFrame:
    """Inner join with a dimension that has one row per key.

    Heavy keys are by default those of half a partition, see :func:`join_share`.
    Their dimension rows (at most ``2 / share``) are broadcast to the rows with these keys; all others are joined by shuffle. Null keys match
    nothing. Columns of the dimension that the fact has too get ``_right`` at their end.
    """
    clash = [c for c in dim.columns if c in fact.columns and c not in on]
    dim = dim.withColumnsRenamed({c: f"{c}_right" for c in clash})
    heavy = heavy_keys(fact, on, share or join_share(fact)) if heavy is None else heavy
    hot, rest = split_heavy(fact, on, heavy)
    if not heavy:
        return rest.join(dim, list(on))
    some, _ = split_heavy(dim, on, heavy)
    return hot.join(F.broadcast(some), list(on)).unionByName(rest.join(dim, list(on)))
