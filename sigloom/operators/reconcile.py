"""Listings held against each other: multisets, repeats, exactly-one matches."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigloom.functions.text import basename, suffix

#: Suffixes of object files (fixed values).
OBJECT_SUFFIXES = (".o", ".obj")


def multiset_difference(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Members whose number differs: keys, n_left, n_right. Nulls are members.

    One exchange of pre-counted members, not two and a join.
    """
    both = left.select(*keys, F.lit(1).alias("l"), F.lit(0).alias("r")).unionByName(right.select(*keys, F.lit(0).alias("l"), F.lit(1).alias("r")))
    return both.groupBy(*keys).agg(F.sum("l").alias("n_left"), F.sum("r").alias("n_right")).where("n_left <> n_right")


def repeated(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with their number."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def match_counts(expected: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """Every expected key with the number of matches and whether it is exactly one."""
    n = found.groupBy(key).agg(F.count(F.lit(1)).alias("__n"))
    return expected.join(n, key, "left").select(*expected.columns, F.coalesce("__n", F.lit(0)).alias("n_matches")).withColumn("exactly_one", F.col("n_matches") == 1)


def invalid_member(name: Column) -> Column:
    """Nested, or no object file."""
    return (name != basename(name)) | ~F.lower(suffix(name)).isin(*OBJECT_SUFFIXES)


def archive_violations(listed: DataFrame, extracted: DataFrame, archive: str, member: str) -> DataFrame:
    """First broken rule per archive: duplicate_members, invalid_members, no_objects, not_reconciled, unexpected_entries.

    ``extracted`` may have a boolean ``is_file``; archives without rows on
    either side have no objects only if they are listed with a null member.
    """
    files = extracted if "is_file" in extracted.columns else extracted.withColumn("is_file", F.lit(True))
    is_object = F.lower(suffix(member)).isin(*OBJECT_SUFFIXES)
    rows = listed.select(archive, member, F.lit(True).alias("__listed"), F.lit(False).alias("__object")).unionByName(files.select(archive, member, F.lit(False).alias("__listed"), (F.col("is_file") & is_object).alias("__object")))
    per = rows.groupBy(archive, member).agg(F.count_if("__listed").alias("l"), F.count_if("__object").alias("o"), F.count_if(~F.col("__listed")).alias("e"))
    here = F.col(member).isNotNull()
    facts = per.groupBy(archive).agg(
        F.bool_or(here & (F.col("l") > 1)).alias("dup"),
        F.bool_or(here & (F.col("l") > 0) & invalid_member(F.col(member))).alias("bad"),
        F.sum(F.when(here, F.col("o"))).alias("objects"),
        F.bool_or(here & (F.col("l") != F.col("o"))).alias("differs"),
        F.bool_or(here & (F.col("e") > 0) & ((F.col("l") == 0) | (F.col("o") == 0))).alias("extra"),
    )
    rule = F.when(F.col("dup"), "duplicate_members").when(F.col("bad"), "invalid_members").when(F.coalesce("objects", F.lit(0)) == 0, "no_objects").when(F.col("differs"), "not_reconciled").when(F.col("extra"), "unexpected_entries")
    return facts.select(archive, rule.alias("violation"))
