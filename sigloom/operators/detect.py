"""Build systems and languages from the listing of a source tree."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigloom.functions.text import suffix

#: Marker files of build systems and suffixes of languages (fixed values).
BUILD_MARKERS = [("openssl-configure", "Configure"), ("autoconf", "configure"), ("cmake", "CMakeLists.txt"), ("meson", "meson.build"), ("make", "Makefile"), ("cargo", "Cargo.toml"), ("go", "go.mod")]
LANGUAGE_SUFFIXES = [(".c", "C"), (".cc", "C++"), (".cpp", "C++"), (".cxx", "C++"), (".rs", "Rust"), (".go", "Go")]


def marker_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(BUILD_MARKERS, "build_system string, marker string")


def suffix_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(LANGUAGE_SUFFIXES, "suffix string, language string")


def programs(listing: DataFrame, path: str, kind: str, wanted: str) -> DataFrame:
    """Files of one content type in order of path."""
    return listing.where(F.col(kind) == wanted).orderBy(path)


def detected_systems(listing: DataFrame, project: str, path: str) -> DataFrame:
    """Build systems whose marker lies at the top of a project, letter case exact: project, build_system, evidence."""
    hits = listing.select(project, F.col(path).alias("marker")).join(F.broadcast(marker_table(listing.sparkSession)), "marker")
    return hits.select(project, "build_system", F.col("marker").alias("evidence")).distinct()


def detected_languages(listing: DataFrame, project: str, path: str) -> DataFrame:
    """Sorted languages of a project's files, by suffix in any letter case."""
    low = listing.select(project, F.lower(suffix(path)).alias("suffix")).distinct()
    hits = low.join(F.broadcast(suffix_table(listing.sparkSession)), "suffix")
    return hits.groupBy(project).agg(F.array_sort(F.collect_set("language")).alias("languages"))


def detect_projects(listing: DataFrame, recipes: DataFrame, project: str, path: str) -> DataFrame:
    """First broken rule, evidence and languages per project.

    ``recipes`` has one row per project with project_markers,
    allowed_build_systems and preferred_build_system. Rules in order:
    missing_markers, unexpected_systems, preferred_not_detected, no_language.
    """
    none = F.array().cast("array<string>")
    top = listing.groupBy(project).agg(F.collect_set(F.when(~F.contains(F.col(path), F.lit("/")), F.col(path))).alias("top"))
    systems = detected_systems(listing, project, path).groupBy(project).agg(F.array_sort(F.collect_set("build_system")).alias("systems"), F.array_sort(F.collect_set("evidence")).alias("evidence"))
    joined = recipes.join(top, project, "left").join(systems, project, "left").join(detected_languages(listing, project, path), project, "left")
    for c in ("top", "systems", "evidence", "languages"):
        joined = joined.withColumn(c, F.coalesce(c, none))
    rule = (
        F.when(F.size(F.array_except("project_markers", "top")) > 0, "missing_markers")
        .when(F.size(F.array_except("systems", "allowed_build_systems")) > 0, "unexpected_systems")
        .when(~F.array_contains("systems", F.col("preferred_build_system")), "preferred_not_detected")
        .when(F.size("languages") == 0, "no_language")
    )
    return joined.select(project, F.col("preferred_build_system").alias("build_system"), "evidence", "languages", rule.alias("violation"))
