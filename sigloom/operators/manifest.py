"""The provenance manifest: wide records, status changes and roll-ups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sigloom.functions.text import pack, unpack
from sigloom.operators.planning import applies_to, flags_for

#: What a failed group loses; identity columns stay (fixed values).
RESET = ("fidb_path", "fidb_sha256", "fidb_bytes", "fid_programs", "fid_attempted", "fid_added", "fid_excluded")

#: What is known only after a build or later: blank in a record that is made anew (fixed values).
BUILT = (
    "compiler_path", "compiler_sha256", "compiler_version", "archiver_path", "archiver_sha256", "archiver_version", "ranlib_path", "ranlib_sha256", "ranlib_version",
    "static_archive_path", "static_archive_sha256", "analysis_artifact_kind", "analysis_artifact_path", "analysis_artifact_sha256", "object_count",
    "ghidra_version", "ghidra_release", "ghidra_build", "ghidra_application_properties_sha256", "ghidra_headless_path", "pyghidra_version", "pyghidra_launcher_path", "java_path", "java_version", *RESET,
)

#: Error text of an unsupported cell (fixed value).
UNSUPPORTED = "treatment is not valid for this route"


def with_defaults(df: DataFrame) -> DataFrame:
    """No nulls: empty text and zero, the status ``requested``."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if f.name == "status":
            c = F.coalesce(c, F.lit("requested"))
        elif isinstance(f.dataType, T.StringType):
            c = F.coalesce(c, F.lit(""))
        elif isinstance(f.dataType, (T.LongType, T.IntegerType)):
            c = F.coalesce(c, F.lit(0).cast(f.dataType))
        out.append(c.alias(f.name))
    return df.select(*out)


def base_records(cells: DataFrame) -> DataFrame:
    """The twenty columns known before a build, from library, route, treatment and detection columns of a cell."""
    words = lambda c: pack(c, " ")
    return cells.select(
        "library", "version", "route", "treatment",
        F.col("factor").alias("sensitivity_factor"), F.col("description").alias("treatment_description"),
        "target_os", "architecture", "binary_format",
        pack("languages").alias("detected_languages"), F.col("build_system").alias("detected_build_system"), pack("evidence").alias("detection_evidence"),
        F.col("url").alias("source_url"), F.lower("sha256").alias("source_sha256"),
        words("compiler").alias("compiler_command"), words(flags_for(F.col("compiler_flags"), F.col("remove_flags"), F.col("append_flags"))).alias("compiler_flags"),
        words("archiver").alias("archiver_command"), words(F.coalesce("ranlib", "archiver")).alias("ranlib_command"),
        "ghidra_language", F.coalesce("ghidra_compiler_spec", F.lit("default")).alias("ghidra_compiler_spec"),
        F.when(applies_to(F.col("supported_routes"), F.col("route")), "requested").otherwise("unsupported").alias("status"),
        F.when(applies_to(F.col("supported_routes"), F.col("route")), "").otherwise(UNSUPPORTED).alias("error"),
    )


def fail_builds(df: DataFrame, failed: Column, message: Column) -> DataFrame:
    """Rows whose build failed, as if made anew: base columns stay, all others are blank, status and error say so.

    Columns that no record has (ids and the like) stay too.
    """
    hit = F.coalesce(failed, F.lit(False)) & F.col("status").isin("requested", "built")
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if f.name == "status":
            c = F.when(hit, "build_failed").otherwise(c)
        elif f.name == "error":
            c = F.when(hit, message).otherwise(c)
        elif f.name in BUILT:
            c = F.when(hit, F.lit("" if isinstance(f.dataType, T.StringType) else 0).cast(f.dataType)).otherwise(c)
        out.append(c.alias(f.name))
    return df.select(*out)


def fail_groups(df: DataFrame, group: Sequence[str], failed: Column, message: Column) -> DataFrame:
    """All-or-nothing groups: where ``failed`` holds for one built or complete member, every such member becomes ``fid_failed``.

    Groups without a built member are left alone. The failing groups (route x
    treatment, not records) are found first and joined back, so no group is
    gathered in one task.
    """
    live = F.col("status").isin("built", "complete")
    bad = df.where(live & F.coalesce(failed, F.lit(False))).groupBy(*group).agg(F.min(message).alias("__message"))
    joined = df.join(bad, list(group), "left")
    hit = live & F.col("__message").isNotNull()
    out = []
    for f in df.schema.fields:
        c = F.col(f.name)
        if f.name == "status":
            c = F.when(hit, "fid_failed").otherwise(c)
        elif f.name == "error":
            c = F.when(hit, F.col("__message")).otherwise(c)
        elif f.name in RESET:
            c = F.when(hit, F.lit("" if isinstance(f.dataType, T.StringType) else 0).cast(f.dataType)).otherwise(c)
        out.append(c.alias(f.name))
    return joined.select(*out)


def complete(df: DataFrame, populations: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Built records with their population counts become ``complete``.

    A key that the report names more than once completes nothing and multiplies no record.
    """
    counts = {"fid_programs": "program_count", "fid_attempted": "attempted", "fid_added": "added", "fid_excluded": "excluded"}
    once = populations.groupBy(*keys).agg(*[F.min(c).alias(c) for c in counts.values()], F.count(F.lit(1)).alias("__n"))
    found = once.where("__n = 1").select(*keys, *counts.values(), F.lit(True).alias("__found"))
    joined = df.join(found, list(keys), "left")
    hit = (F.col("status") == "built") & F.coalesce("__found", F.lit(False))
    return joined.select(*[(F.when(hit, F.col(counts[c])).otherwise(F.col(c)) if c in counts else F.when(hit, "complete").otherwise(F.col(c)) if c == "status" else F.col(c)).alias(c) for c in df.columns])


def status_rollup(df: DataFrame) -> DataFrame:
    return df.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def rollup_text(df: DataFrame) -> DataFrame:
    """One line ``status=count, ...`` in order of status."""
    n = status_rollup(df).agg(F.array_sort(F.collect_list(F.struct("status", "n"))).alias("a"))
    return n.select(F.array_join(F.transform("a", lambda x: F.concat(x["status"], F.lit("="), x["n"].cast("string"))), ", ").alias("line"))


def incomplete(df: DataFrame) -> DataFrame:
    return df.where(~F.col("status").eqNullSafe("complete"))


def shown_status(status: Column) -> Column:
    return F.when(status == "built", "compiled").otherwise(status)


def zip_packed(df: DataFrame, keys: Sequence[str], left: str, right: str) -> DataFrame:
    """Packed lists side by side, one row per position from 1; only rows whose lists are of one length."""
    a, b = unpack(left), unpack(right)
    rows = df.where(F.size(a) == F.size(b)).select(*keys, F.posexplode(F.arrays_zip(a.alias("l"), b.alias("r"))).alias("p", "z"))
    return rows.select(*keys, (F.col("p") + 1).alias("position"), F.col("z.l").alias(left), F.col("z.r").alias(right))


def first_program(df: DataFrame, group: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """The first row's value of each group."""
    return df.groupBy(*group).agg(F.min_by(F.struct(value), F.struct(*order)).alias("f")).select(*group, F.col(f"f.{value}").alias(value))


def single_row(df: DataFrame) -> DataFrame:
    """The only row; an error where there is none or more than one."""
    n = len(df.limit(2).collect())
    if n != 1:
        raise ValueError("expected exactly one row")
    return df
