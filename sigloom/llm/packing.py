"""Filling containers under several limits at once: vector bin packing.

An item has three sizes: tokens, segments (one per item) and loss-bearing
tokens. A container has a limit for each. Containers are filled one at a time:
among the items that still fit, the one with the greatest weighted dot product
of its sizes with the container's free space goes in next; weights are the
total demand in each dimension relative to its limit.

Items are divided by a hash of id and sizes into groups of about ``GROUP`` items
(their number follows the count of items), each packed by one task of its own in
bounded memory, so the work is linear in the number of items. Only the last container
of a group is left with space that other items could have used: one in some
thousands.

An item that alone exceeds a limit is cut into the longest pieces that fit; all
but its last piece get containers of their own. No other item is cut.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GROUP = 16_384
#: More groups than this share tasks.
MOST_TASKS = 20_000


@dataclass(frozen=True)
class Limits:
    tokens: int = 2048
    segments: int = 64
    loss: int = 2048

    def __post_init__(self) -> None:
        if min(self.tokens, self.segments, self.loss) < 1:
            raise ValueError("limits must be positive")


def pieces(n_tokens: int, n_prompt: int, limits: Limits) -> list[tuple[int, int, int]]:
    """(start, tokens, loss tokens) of each piece; one piece unless a limit is exceeded. The prompt comes first."""
    if n_tokens <= limits.tokens and n_tokens - n_prompt <= limits.loss:
        return [(0, n_tokens, n_tokens - n_prompt)]
    out, at = [], 0
    while at < n_tokens:
        end = min(at + limits.tokens, max(at, n_prompt) + limits.loss, n_tokens)
        out.append((at, end - at, max(0, end - max(at, n_prompt))))
        at = end
    return out


def fill(tokens: np.ndarray, loss: np.ndarray, limits: Limits) -> tuple[np.ndarray, np.ndarray]:
    """Container and position of each item, all of which fit alone. Ties go to the earlier item."""
    n = len(tokens)
    container, position = np.full(n, -1, dtype=np.int64), np.zeros(n, dtype=np.int64)
    if not n:
        return container, position
    cap = np.array([limits.tokens, limits.segments, limits.loss], dtype=float)
    size = np.stack([tokens, np.ones(n), loss], axis=1) / cap
    weight = size.sum(0)
    weight /= weight.max()
    # equal sizes are one kind: the work depends on kinds, not items
    kinds, of = np.unique(np.stack([tokens, loss], axis=1), axis=0, return_inverse=True)
    order = np.argsort(of.ravel(), kind="stable")
    left = np.bincount(of.ravel(), minlength=len(kinds))
    begin = np.concatenate([[0], np.cumsum(left)[:-1]])
    kind = np.stack([kinds[:, 0], np.ones(len(kinds)), kinds[:, 1]], axis=1) / cap
    alive = np.arange(len(kinds))
    current = 0
    remaining = n
    while remaining:
        free, placed = np.ones(3), 0
        fits = alive
        while len(fits):
            ok = (kind[fits] <= free + 1e-12).all(1)
            fits = fits[ok]
            if not len(fits):
                break
            k = fits[int(np.argmax(kind[fits] @ (weight * free)))]
            item = order[begin[k]]
            container[item], position[item] = current, placed
            begin[k] += 1
            left[k] -= 1
            remaining -= 1
            placed += 1
            free = free - kind[k]
            if not left[k]:
                fits = fits[fits != k]
        alive = alive[left[alive] > 0]
        current += 1
    return container, position


_OUT = "id bigint, piece int, token_start bigint, n_tokens bigint, n_loss bigint, container string, position int"
_ARROW = pa.schema([("id", pa.int64()), ("piece", pa.int32()), ("token_start", pa.int64()), ("n_tokens", pa.int64()), ("n_loss", pa.int64()), ("container", pa.string()), ("position", pa.int32())])


def _pack(batches: Iterator[pa.RecordBatch], limits: Limits, most: int) -> Iterator[pa.RecordBatch]:
    """Rows (shard, id, n_tokens, n_prompt) sorted by shard and id."""
    shard, part, rows = None, 0, []

    def flush() -> Iterator[pa.RecordBatch]:
        nonlocal rows, part
        if not rows:
            return
        cut = [(i, k, s, n, loss, len(ps) - 1) for i, n_tokens, n_prompt in rows for ps in [pieces(n_tokens, n_prompt, limits)] for k, (s, n, loss) in enumerate(ps)]
        single = np.array([k < last for _, k, _, _, _, last in cut])
        n = np.array([c[3] for c in cut], dtype=np.int64)
        loss = np.array([c[4] for c in cut], dtype=np.int64)
        container, position = np.zeros(len(cut), dtype=np.int64), np.zeros(len(cut), dtype=np.int64)
        container[~single], position[~single] = fill(n[~single], loss[~single], limits)
        begin = int(container[~single].max()) + 1
        container[single] = begin + np.arange(int(single.sum()))
        names = [f"{shard}-{part}-{c}" for c in container]
        yield pa.record_batch([pa.array([c[0] for c in cut], pa.int64()), pa.array([c[1] for c in cut], pa.int32()), pa.array([c[2] for c in cut], pa.int64()), pa.array(n), pa.array(loss), pa.array(names), pa.array(position.astype(np.int32))], schema=_ARROW)
        rows, part = [], part + 1

    for b in batches:
        for s, i, n_tokens, n_prompt in zip(*(b.column(k).to_pylist() for k in range(4))):
            if s != shard or len(rows) >= most:
                yield from flush()
                if s != shard:
                    shard, part = s, 0
            rows.append((i, n_tokens, n_prompt))
    yield from flush()


def pack(items: DataFrame, item_id: str, n_tokens: str, n_prompt: str, limits: Limits = Limits(), group: int = GROUP, count: int | None = None) -> DataFrame:
    """id, piece, token_start, n_tokens, n_loss, container, position: every item exactly once, cut items in pieces.

    Items without tokens (null sizes count as none) take a segment. Ids should
    be unique; repeated ones are items of their own. The result depends on the
    items alone, not on partitions, but for items without id, which are spread
    by where they are read. No items give no rows. ``count``, the number of
    items, is counted where the caller does not know it. A group of more than
    ``2 group`` items (many that are equal in id and sizes) is packed in parts.
    """
    count = items.count() if count is None else count
    shards = max(1, -(-count // group))
    tokens, prompt = F.coalesce(F.col(f"`{n_tokens}`"), F.lit(0)).cast("bigint"), F.coalesce(F.col(f"`{n_prompt}`"), F.lit(0)).cast("bigint")
    listed = items.select(F.col(f"`{item_id}`").cast("bigint").alias("id"), tokens.alias("n"), F.least(prompt, tokens).alias("p"), F.monotonically_increasing_id().alias("at"))
    place = F.when(F.col("id").isNull(), F.xxhash64("n", "p", "at")).otherwise(F.xxhash64("id", "n", "p"))
    rows = listed.select(F.pmod(place, F.lit(shards)).alias("shard"), "id", "n", "p")
    tasks = min(shards, MOST_TASKS)
    # by number, not by hash of the number: one group, one task
    spread = rows.repartitionById(tasks, F.pmod("shard", F.lit(tasks)).cast("int"))
    return spread.sortWithinPartitions("shard", "id", "n", "p").mapInArrow(lambda it: _pack(it, limits, 2 * group), _OUT)


def check(items: DataFrame, packed: DataFrame, item_id: str, n_tokens: str, n_prompt: str, limits: Limits = Limits()) -> DataFrame:
    """One row of counts: items, and everything that would be wrong with a packing of them.

    Items lost, with tokens lost or added, or cut though within the limits;
    pieces that do not follow on each other; containers over a limit. Ids that
    are null or repeated are compared by their sums.
    """
    n, p = F.coalesce(F.col(f"`{n_tokens}`"), F.lit(0)).cast("bigint"), F.coalesce(F.col(f"`{n_prompt}`"), F.lit(0)).cast("bigint")
    given = items.select(F.col(f"`{item_id}`").cast("bigint").alias("id"), n.alias("n"), (n - F.least(n, p)).alias("loss"))
    want = given.select("id", F.lit(1).alias("items"), "n", "loss", F.lit(0).alias("pieces"), F.lit(0).alias("firsts"), ((F.col("n") > limits.tokens) | (F.col("loss") > limits.loss)).cast("int").alias("over"), F.lit(0).alias("starts"))
    # the first piece begins at the first token, every other one after it
    got = packed.select("id", F.lit(0).alias("items"), -F.col("n_tokens"), -F.col("n_loss"), F.lit(1).alias("pieces"), (F.col("piece") == 0).cast("int").alias("firsts"), F.lit(0).alias("over"), F.when(F.col("piece") == 0, (F.col("token_start") != 0).cast("int")).otherwise((F.col("token_start") <= 0).cast("int")).alias("starts"))
    per = want.union(got).groupBy("id").agg(*[F.sum(c).alias(c) for c in ("items", "n", "loss", "pieces", "firsts", "over", "starts")])
    wrong = per.agg(
        F.sum("items").alias("n_items"),
        F.count_if(F.col("items") != F.col("firsts")).alias("n_lost_or_repeated"),
        F.count_if((F.col("n") != 0) | (F.col("loss") != 0)).alias("n_changed_sizes"),
        F.count_if((F.col("pieces") > F.col("items")) & (F.col("over") == 0)).alias("n_cut_needlessly"),
        F.count_if(F.col("starts") > 0).alias("n_misplaced_pieces"),
    )
    full = packed.groupBy("container").agg(F.sum("n_tokens").alias("n"), F.count(F.lit(1)).alias("k"), F.sum("n_loss").alias("loss"), F.count_distinct("position").alias("places"))
    over = full.agg(F.count_if((F.col("n") > limits.tokens) | (F.col("k") > limits.segments) | (F.col("loss") > limits.loss)).alias("n_over_limits"), F.count_if(F.col("places") != F.col("k")).alias("n_shared_positions"))
    both = wrong.unionByName(over, allowMissingColumns=True)
    return both.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in both.columns])
