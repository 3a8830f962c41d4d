"""Differences between two copies of a table, field by field.

Both copies go through one range exchange, so the split points are shared;
rows are sorted within each partition by key and copy, and a two-pointer merge
streams over the sorted rows with the last key as its only memory. A key that
holds a large part of a range is folded to its latest row before the exchange;
the number of ranges follows the size of the input, and that part follows it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sigloom.operators.skew import MOST_HEAVY, PARTITION_BYTES, heavy_keys, split_heavy
from sigloom.plans.session import input_bytes

#: Bytes of input in a range, and the most ranges.
RANGE_BYTES, MOST_RANGES = PARTITION_BYTES, 200_000

MISSING_RIGHT = "missing_in_copy"
MISSING_LEFT = "missing_in_main"


def _differs(a: pa.ChunkedArray, b: pa.ChunkedArray) -> pa.ChunkedArray:
    unequal = pc.fill_null(pc.not_equal(a, b), False)
    return pc.or_(unequal, pc.xor(pc.is_null(a), pc.is_null(b)))


def _same_as_next(t: pa.Table, names: Sequence[str]) -> pa.ChunkedArray | pa.BooleanArray:
    same = None
    for name in names:
        c = t.column(name)
        eq = pc.invert(_differs(c.slice(0, len(c) - 1), c.slice(1)))
        same = eq if same is None else pc.and_(same, eq)
    return same


def _merge(batches: Iterator[pa.RecordBatch], keys: list[str], fields: list[str], schema: pa.Schema, chunk: int = 100_000) -> Iterator[pa.RecordBatch]:
    """Batches sorted by keys, side, order -> one row per difference."""

    def winners(t: pa.Table) -> pa.Table:
        """The last row of each (key, side)."""
        if t.num_rows < 2:
            return t
        again = _flat(_same_as_next(t, [*keys, "__side"]))
        return t.filter(pc.invert(pa.concat_arrays([again, pa.array([False])])))

    def compare(t: pa.Table) -> Iterator[pa.RecordBatch]:
        """Whole keys, at most one row for each side."""
        n = t.num_rows
        if not n:
            return
        paired = pa.concat_arrays([_flat(_same_as_next(t, keys)), pa.array([False])]) if n > 1 else pa.array([False])
        second = pa.concat_arrays([pa.array([False]), paired.slice(0, n - 1)])
        alone = t.filter(pc.invert(pc.or_(paired, second)))
        if alone.num_rows:
            what = pc.if_else(pc.equal(alone.column("__side"), 0), MISSING_RIGHT, MISSING_LEFT)
            none = pa.nulls(alone.num_rows, pa.string())
            yield from pa.table([*(alone.column(k).cast(pa.string()) for k in keys), what, none, none], schema=schema).to_batches()
        left, right = t.filter(paired), t.filter(second)
        for f in fields:
            unequal = _differs(left.column(f), right.column(f))
            a, b = left.filter(unequal), right.filter(unequal)
            if a.num_rows:
                yield from pa.table([*(a.column(k).cast(pa.string()) for k in keys), pa.array([f] * a.num_rows), a.column(f).cast(pa.string()), b.column(f).cast(pa.string())], schema=schema).to_batches()

    held: list[pa.RecordBatch] = []
    rows = 0
    carry: pa.Table | None = None

    def flush(last: bool) -> Iterator[pa.RecordBatch]:
        nonlocal carry, held, rows
        parts = ([carry] if carry is not None else []) + ([pa.Table.from_batches(held)] if held else [])
        held, rows = [], 0
        if not parts:
            return
        t = winners(pa.concat_tables(parts).combine_chunks())
        carry = None
        if not last and t.num_rows:
            # the last key may go on in the next batch: hold back its one or two rows
            keep = 1 + (t.num_rows > 1 and _flat(_same_as_next(t.slice(t.num_rows - 2), keys))[0].as_py())
            carry = t.slice(t.num_rows - keep)
            t = t.slice(0, t.num_rows - keep)
        yield from compare(t)

    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= chunk:
            yield from flush(False)
    yield from flush(True)


def _flat(a: pa.ChunkedArray | pa.Array) -> pa.Array:
    return pa.concat_arrays(a.chunks) if isinstance(a, pa.ChunkedArray) and a.num_chunks else (pa.array([], a.type) if isinstance(a, pa.ChunkedArray) else a)


def latest_rows(df: DataFrame, keys: Sequence[str], order: str, salts: int = 64) -> DataFrame:
    """The row with the greatest ``order`` of each key, through (key, salt) groups first."""
    others = [c for c in df.columns if c not in keys]
    row = F.struct(*[F.col(f"`{c}`") for c in others]).alias("__row")
    salted = df.select(*[F.col(f"`{k}`") for k in keys], row, F.pmod(F.xxhash64(f"`{order}`"), F.lit(salts)).alias("__salt"))
    top = lambda name: F.max_by(name, F.struct(F.col(f"{name}.`{order}`")))
    once = salted.groupBy(*[F.col(f"`{k}`") for k in keys], "__salt").agg(top("__row").alias("__row"))
    best = once.groupBy(*[F.col(f"`{k}`") for k in keys]).agg(top("__row").alias("__row"))
    return best.select(*[F.col(f"`{k}`") for k in keys], "__row.*").select(*df.columns)


def diff_copies(
    left: DataFrame,
    right: DataFrame,
    keys: Mapping[str, Column],
    order: str,
    fields: Sequence[str],
    normalise: Mapping[str, Callable[[str], Column]] | None = None,
    heavy_share: float | None = None,
    ranges: int | None = None,
) -> DataFrame:
    """One row per key on one side only and one per unequal field of a key on both.

    ``keys`` maps output names to expressions over the input (each cast to
    string). In each copy the row of a key is the one with the greatest
    ``order`` (null orders first). ``normalise`` is applied to fields after the
    exchange. Columns: the keys, ``difference`` (``missing_in_copy``,
    ``missing_in_main`` or the field), ``left_value``, ``right_value``.

    ``ranges`` is the number of partitions of the exchange: by default one for
    each ``RANGE_BYTES`` of input, at least those of the session. A key with
    ``heavy_share`` of the rows, by default half a range, is folded first.

    Null keys are keys like any other; two nulls are equal; empty inputs give
    the other side's keys as missing; columns not named are ignored, whatever
    they are called.
    """
    names = list(keys)

    def side(df: DataFrame, k: int) -> DataFrame:
        return df.select(*[e.cast("string").alias(f"__k{i}") for i, e in enumerate(keys.values())], F.lit(k).cast("tinyint").alias("__side"), F.col(f"`{order}`").alias("__order"), *[F.col(f"`{f}`").alias(f"__f{i}") for i, f in enumerate(fields)])

    ks = [f"__k{i}" for i in range(len(names))]
    both = side(left, 0).unionByName(side(right, 1))
    ranges = ranges or max(int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(MOST_RANGES, -(-(input_bytes(left) + input_bytes(right)) // RANGE_BYTES)))
    heavy = heavy_keys(both, ks, heavy_share or max(0.5 / ranges, 2 / MOST_HEAVY))
    hot, folded = split_heavy(both, ks, heavy)
    if heavy:
        folded = folded.unionByName(latest_rows(hot, [*ks, "__side"], "__order").select(*folded.columns))
    ordered = folded.repartitionByRange(ranges, *ks).sortWithinPartitions(*ks, "__side", "__order")
    change = normalise or {}
    ready = ordered.select(*ks, "__side", *[(change[f](f"__f{i}") if f in change else F.col(f"__f{i}")).alias(f) for i, f in enumerate(fields)])
    out = T.StructType([*[T.StructField(n, T.StringType()) for n in names], T.StructField("difference", T.StringType()), T.StructField("left_value", T.StringType()), T.StructField("right_value", T.StringType())])
    arrow = pa.schema([(f.name, pa.string()) for f in out.fields])
    listed = list(fields)
    return ready.mapInArrow(lambda it: _merge(it, ks, listed, arrow), out)
