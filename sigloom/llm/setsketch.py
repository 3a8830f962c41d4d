"""Distinct counts from mergeable registers with a tunable logarithmic base.

A set is summarised by ``m`` registers. An element's 64-bit digest picks one
register and a uniform ``u`` in (0, 1); the register keeps the maximum of
``floor(1 - log_b(u))``. Union of sets is the maximum per register, so partial
results of any partition, day or group combine in any order.

For n elements P(register <= k) = exp(-n / m * b^-k), including k = 0 (empty).
With base b the relative standard error of a count is

    sqrt(((b + 1) / (b - 1) * ln b - 1) / m)

(1.04 / sqrt(m) at b = 2, 1 / sqrt(m) as b -> 1): 3.1 % with the defaults. Two
sketches are compared by maximum likelihood over the pairs of registers, which
gives union, intersection and Jaccard with standard errors from the information
of all three rates.

Registers are rows (group columns, register, value, n_rows): the sketch of a
group never exceeds ``m`` rows whatever the set holds, everything up to the
estimate stays in the JVM with map-side combination, and no group is a task.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

REGISTERS = 1024
BASE = 1.05


def relative_error(m: int = REGISTERS, base: float = BASE) -> float:
    """Relative standard error of a distinct count."""
    return math.sqrt(((base + 1) / (base - 1) * math.log(base) - 1) / m)


def _check(m: int, base: float) -> int:
    bits = m.bit_length() - 1
    if m != 1 << bits or not 4 <= bits <= 20 or base <= 1:
        raise ValueError("registers must be a power of two from 16 to 2^20, and the base above 1")
    return bits


def sketch(df: DataFrame, groups: Sequence[str], item: str, m: int = REGISTERS, base: float = BASE) -> DataFrame:
    """Registers of each group's set of ``item`` values: groups, register, value, n_rows.

    Rows with a null item belong to no set. Null group values form a group.
    Repeated rows change only ``n_rows``; an empty table gives no registers.
    """
    bits = _check(m, base)
    digest = F.xxhash64(F.col(f"`{item}`"))
    u = (F.shiftrightunsigned("__d", bits).cast("double") + F.lit(0.5)) / F.lit(float(1 << (64 - bits)))
    return (
        df.where(F.col(f"`{item}`").isNotNull())
        .select(*[F.col(f"`{g}`") for g in groups], digest.alias("__d"))
        .select(*[F.col(f"`{g}`") for g in groups], F.col("__d").bitwiseAND(F.lit(m - 1)).cast("int").alias("register"), F.floor(1 - F.log(u) / F.lit(math.log(base))).cast("int").alias("value"))
        .groupBy(*[F.col(f"`{g}`") for g in groups], "register")
        .agg(F.max("value").alias("value"), F.count(F.lit(1)).alias("n_rows"))
    )


def merge(*parts: DataFrame) -> DataFrame:
    """The union of sketches with the same columns."""
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    keys = [c for c in both.columns if c not in ("value", "n_rows")]
    return both.groupBy(*[F.col(f"`{k}`") for k in keys]).agg(F.max("value").alias("value"), F.sum("n_rows").alias("n_rows"))


def rollup_sets(cells: DataFrame, groups: Sequence[str], sets: Sequence[Sequence[str]], all_label: str = "*") -> DataFrame:
    """Sketches of coarser groups by merging finer ones; columns not grouped by read ``all_label``.

    Group columns come back as strings. Sums over days or groups touch
    registers only, never the rows they came from.
    """
    keep = [F.when(F.grouping(g) == 1, F.lit(all_label)).otherwise(F.col(f"`{g}`").cast("string")).alias(g) for g in groups]
    merged = cells.groupingSets([[*[F.col(f"`{g}`") for g in s], F.col("register")] for s in sets], *[F.col(f"`{g}`") for g in groups], F.col("register"))
    return merged.agg(*[k.alias(f"__{i}") for i, k in enumerate(keep)], F.max("value").alias("value"), F.sum("n_rows").alias("n_rows")).select(*[F.col(f"__{i}").alias(g) for i, g in enumerate(groups)], "register", "value", "n_rows")


def estimate(cells: DataFrame, groups: Sequence[str], m: int = REGISTERS, base: float = BASE) -> DataFrame:
    """groups, distinct_estimate, std_error, n_rows.

    Empty registers enter by the series x + (b-1) sum b^(k-1) x^(b^k), x the
    empty share, so small sets are as well estimated as large ones. The stated
    error is at least half an element: in a few elements one that shares a
    register with another is missed whole.
    """
    _check(m, base)
    terms = math.ceil(math.log(60.0 * m) / math.log(base)) + 1
    per = cells.groupBy(*[F.col(f"`{g}`") for g in groups]).agg(F.sum(F.pow(F.lit(base), -F.col("value"))).alias("__s"), F.count(F.lit(1)).alias("__c"), F.sum("n_rows").alias("n_rows"))
    x = (F.lit(m) - F.col("__c")) / F.lit(float(m))
    tail = F.aggregate(F.sequence(F.lit(1), F.lit(terms)), x, lambda acc, k: acc + F.lit(base - 1) * F.pow(F.lit(base), k - 1) * F.pow(x, F.pow(F.lit(base), k)))
    n = F.lit(m * m * (1 - 1 / base) / math.log(base)) / (F.lit(float(m)) * F.when(x > 0, tail).otherwise(0.0) + F.col("__s"))
    return per.select(*[F.col(f"`{g}`") for g in groups], n.alias("distinct_estimate"), F.greatest(n * F.lit(relative_error(m, base)), F.lit(0.5)).alias("std_error"), "n_rows")


def _count(k: np.ndarray, m: int, base: float) -> float:
    """The estimate of :func:`estimate` for the registers of one set."""
    x = float(np.mean(k == 0))
    if x == 1:
        return 0.0
    t = np.arange(1, math.ceil(math.log(60.0 * m) / math.log(base)) + 2, dtype=float)
    tail = x + float(np.sum((base - 1) * base ** (t - 1) * np.power(x, base**t))) if x > 0 else 0.0
    return m * m * (1 - 1 / base) / math.log(base) / (m * tail + float(np.sum(np.power(base, -k[k > 0].astype(float)))))


def _pair_scores(rates: np.ndarray, pairs: np.ndarray, base: float) -> tuple[np.ndarray, np.ndarray]:
    """Logarithm of the probability of register pairs, and its derivatives by the three rates."""
    a, b, c = rates
    lo, hi, less, more = pairs.min(0).astype(float), pairs.max(0).astype(float), pairs[0] < pairs[1], pairs[0] > pairs[1]

    def within(x: np.ndarray, rate: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Probability that a register of this rate is x, and its derivative."""
        q = np.power(base, -x)
        here, under = np.exp(-rate * q), np.where(x > 0, np.exp(-rate * q * base), 0.0)
        return here - under, q * (base * under - here)

    # unequal registers: the lower one bounds its own part and the shared one, the higher one only its own part
    low, d_low = within(lo, np.where(less, a, b) + c)
    high, d_high = within(hi, np.where(less, b, a))
    # equal ones: by inclusion and exclusion
    q = np.power(base, -lo)
    same, d_same = np.zeros(len(q)), np.zeros((3, len(q)))
    for sign, i, j, k in ((1, 1, 1, 1), (-1, base, 1, base), (-1, 1, base, base), (1, base, base, base)):
        term = sign * np.exp(-q * (i * a + j * b + k * c)) * ((lo > 0) | (k == 1))
        same += term
        d_same -= np.outer((i, j, k), q * term)
    apart = less | more
    p = np.maximum(np.where(apart, low * high, same), 1e-300)
    by_low, by_high = d_low * high, low * d_high
    d = np.where(apart, np.stack([np.where(less, by_low, by_high), np.where(less, by_high, by_low), by_low]), d_same)
    return np.log(p), d / p


def joint_estimate(k1: np.ndarray, k2: np.ndarray, m: int, base: float) -> dict[str, float]:
    """Union, intersection and Jaccard of two sets from their registers (0: empty), by maximum likelihood.

    With rates A (only left), B (only right) and C (both) per register,
    P(K1 <= i, K2 <= j) = exp(-A b^-i - B b^-j - C b^-min(i, j)). The likelihood
    of the register pairs is maximised over all three by scoring; the inverse
    of the 3 x 3 information (outer products of the scores) gives the errors.
    """
    n1, n2 = _count(k1, m, base), _count(k2, m, base)
    most = min(n1, n2)
    if most == 0:
        union = max(n1, n2)
        return {"union": union, "intersection": 0.0, "jaccard": 0.0, "union_error": union * relative_error(m, base), "intersection_error": 0.0, "jaccard_error": 0.0}
    pairs, times = np.unique(np.stack([k1, k2]), axis=1, return_counts=True)
    top = (n1 + n2) / m
    floor = 1e-7 * top

    def at(rates: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """Likelihood, its gradient and the information."""
        logs, d = _pair_scores(rates, pairs, base)
        return float(times @ logs), d @ times, (d * times) @ d.T + np.eye(3) / top**2

    rates = np.maximum(np.array([n1 - most / 2, n2 - most / 2, most / 2]) / m, 0.01 * top)
    value, gradient, information = at(rates)
    for _ in range(200):
        # no rate falls below a tenth at once: those that would are set there, and the others follow
        least = np.maximum(0.1 * rates, floor) - rates
        free, step = np.ones(3, dtype=bool), np.zeros(3)
        while free.any():
            step[free] = np.linalg.solve(information[np.ix_(free, free)], gradient[free] - information[np.ix_(free, ~free)] @ step[~free])
            low = free & (step < least)
            if not low.any():
                break
            step[low] = least[low]
            free &= ~low
        for part in 0.5 ** np.arange(40):
            new = rates + part * step
            got = at(new)
            if got[0] > value:
                break
        else:
            break
        gain = got[0] - value
        rates, (value, gradient, information) = new, got
        if part == 1 and gain < 1e-8:
            break
    a, b, c = rates * (rates > 2 * floor)
    # errors half an element or more inside the bounds
    spread = np.linalg.inv(at(np.maximum(rates, max(0.5 / m, 1e-4 * top)))[2])
    total = a + b + c
    jaccard = c / total
    slope = np.array([-jaccard, -jaccard, 1 - jaccard]) / total
    return {
        "union": float(m * total),
        "intersection": float(m * c),
        "jaccard": float(jaccard),
        "union_error": float(m * math.sqrt(spread.sum())),
        "intersection_error": float(min(m * math.sqrt(spread[2, 2]), most)),
        "jaccard_error": float(min(math.sqrt(slope @ spread @ slope), 1.0)),
    }


def overlap(cells_left: DataFrame, cells_right: DataFrame, groups: Sequence[str], m: int = REGISTERS, base: float = BASE) -> DataFrame:
    """Union, intersection and Jaccard of the two sketches of each group that either side has; see :func:`overlap_sides`."""
    sides = [c.select(*[F.col(f"`{k}`").cast("string").alias(k) for k in groups], "register", "value", F.lit(i).alias("side")) for i, c in enumerate((cells_left, cells_right))]
    return overlap_sides(sides[0].unionByName(sides[1]), groups, m, base)


def overlap_sides(cells: DataFrame, groups: Sequence[str], m: int = REGISTERS, base: float = BASE) -> DataFrame:
    """Union, intersection and Jaccard of the sketches ``side`` 0 and 1 of each group, in one exchange of registers.

    Each group is one task of at most ``2 m`` registers. Group columns come back as strings.
    """
    g = [F.coalesce(F.col(f"`{k}`").cast("string"), F.lit("\0")).alias(k) for k in groups]
    names = list(groups)

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        k = np.zeros((2, m), dtype=np.int64)
        k[pdf["side"].to_numpy(), pdf["register"].to_numpy()] = pdf["value"].to_numpy()
        r = joint_estimate(k[0], k[1], m, base)
        return pd.DataFrame([{n: (None if pdf[n].iat[0] == "\0" else pdf[n].iat[0]) for n in names} | r])

    out = ", ".join([*(f"`{n}` string" for n in names), "`union` double", "intersection double", "jaccard double", "union_error double", "intersection_error double", "jaccard_error double"])
    return cells.select(*g, "register", "value", "side").groupBy(*names).applyInPandas(solve, out)


def exact_counts(df: DataFrame, groups: Sequence[str], sets: Sequence[Sequence[str]], item: str, all_label: str = "*") -> DataFrame:
    """Exact distinct counts of the same groups as :func:`rollup_sets` gives, to hold estimates against.

    Rows are folded to distinct (groups, item) first; each of these stands for
    itself in every set, and the distinct ones are counted.
    """
    once = df.where(F.col(f"`{item}`").isNotNull()).select(*[F.col(f"`{g}`").cast("string").alias(g) for g in groups], F.col(f"`{item}`").alias("__item")).distinct()
    views = F.array(*[F.struct(*[(F.col(f"`{g}`") if g in s else F.lit(all_label)).alias(g) for g in groups]) for s in sets])
    each = once.select(F.explode(views).alias("v"), "__item").select(*[F.col(f"v.`{g}`").alias(g) for g in groups], "__item").distinct()
    return each.groupBy(*[F.col(f"`{g}`") for g in groups]).agg(F.count(F.lit(1)).alias("distinct_exact"))
