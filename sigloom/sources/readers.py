"""Strict readers: what a lenient scan would guess or drop becomes an error row.

Every reader keeps the place a row came from, so "last wins" has an order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sigloom.functions.text import strip
from sigloom.operators.requests import COLUMNS

_S, _A = T.StringType(), T.ArrayType(T.StringType())

RECIPE = T.StructType([*[T.StructField(n, _S) for n in ("schema_version", "name", "version", "url", "sha256", "source_directory", "preferred_build_system")], *[T.StructField(n, _A) for n in ("project_markers", "allowed_build_systems", "static_archives")]])
ROUTE = T.StructType([*[T.StructField(n, _S) for n in ("id", "target_os", "architecture", "binary_format", "linked_suffix", "ghidra_language", "ghidra_compiler_spec")], *[T.StructField(n, _A) for n in ("compiler", "archiver", "ranlib", "compiler_flags", "object_file_markers", "linked_file_markers", "compiler_version_markers")]])
TREATMENT = T.StructType([*[T.StructField(n, _S) for n in ("id", "factor", "description", "phase")], *[T.StructField(n, _A) for n in ("remove_flags", "append_flags", "supported_routes")]])
WORKER = T.StructType([T.StructField("schema_version", _S), T.StructField("recipe_directory", _S), T.StructField("requested_libraries", _A), T.StructField("routes", T.ArrayType(ROUTE)), T.StructField("treatments", T.ArrayType(TREATMENT)), T.StructField("profiles", T.MapType(_S, _A))])


#: Splits whose offsets are broadcast; more are joined by shuffle.
MOST_SPLITS = 200_000


def lines(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """path, line_no (from 1), value. Files are split and read in parallel; numbers come from one count per split.

    A table of files and partitions bounds the number of splits before
    anything is read: up to ``MOST_SPLITS`` their offsets are broadcast and the
    text is not shuffled.
    """
    raw = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("id"))
    splits = raw.groupBy("path", "start").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
    from pyspark.sql import Window

    before = F.coalesce(F.sum("n").over(Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = splits.withColumn("before", before)
    if len(raw.inputFiles()) + raw.rdd.getNumPartitions() <= MOST_SPLITS:
        offsets = F.broadcast(offsets)
    return raw.join(offsets, ["path", "start"]).select("path", (F.col("before") + F.col("id") - F.col("first") + 1).alias("line_no"), "value")


def json_rows(spark: SparkSession, path: str | Sequence[str], fields: dict[str, str]) -> DataFrame:
    """JSON lines: path, line_no, ``fields`` (name -> SQL type) and ``problem``.

    Blank lines are skipped. ``problem`` is invalid_json, not_an_object or null.
    Values keep their JSON type: a number field takes whole numbers only, not
    ``true``, ``15.0`` or ``"15"``, which come back as null.
    """
    rows = lines(spark, path).where(strip("value") != "").withColumn("v", F.try_parse_json("value"))
    kind = F.schema_of_variant("v")
    problem = F.when(F.col("v").isNull(), "invalid_json").when(~kind.startswith("OBJECT"), "not_an_object")
    got = []
    for name, sql_type in fields.items():
        at = F.try_variant_get("v", f"$.{name}", "variant")
        value = F.try_variant_get("v", f"$.{name}", sql_type)
        strict = {"bigint": "BIGINT", "string": "STRING", "double": "DOUBLE"}.get(sql_type)
        got.append((F.when(F.schema_of_variant(at) == strict, value) if strict else value).alias(name))
    return rows.withColumn("problem", problem).select("path", "line_no", *got, "problem")


def properties(spark: SparkSession, path: str, comments: bool = True) -> DataFrame:
    """key, value of ``key=value`` lines; the last line of a key wins. With ``comments``, lines with ``#`` in front are skipped."""
    rows = lines(spark, path).where(F.contains("value", F.lit("=")))
    if comments:
        rows = rows.where(~strip("value").startswith("#"))
    parts = F.split("value", "=", 2)
    kv = rows.select(strip(parts[0]).alias("key"), strip(parts[1]).alias("text"), "line_no")
    return kv.groupBy("key").agg(F.max_by("text", "line_no").alias("value"))


def required_properties(found: DataFrame, required: Sequence[str]) -> list[str]:
    """Required keys that are absent or empty, sorted. The keys asked for are few; only they are fetched."""
    there = {r["key"] for r in found.where(F.col("key").isin(*required) & (F.col("value") != "")).collect()}
    return sorted(set(required) - there)


def worker_configuration(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """routes, treatments, profiles (profile, pos, treatment) and requested_libraries (pos, request) of one document, with defaults."""
    doc = spark.read.schema(WORKER).option("multiLine", True).json(path)
    none = F.array().cast("array<string>")
    routes = doc.select(F.posexplode("routes").alias("pos", "r")).select("pos", "r.*")
    routes = routes.withColumns({"ranlib": F.coalesce("ranlib", "archiver"), "compiler_flags": F.coalesce("compiler_flags", none), "compiler_version_markers": F.coalesce("compiler_version_markers", none), "ghidra_compiler_spec": F.coalesce("ghidra_compiler_spec", F.lit("default"))})
    treatments = doc.select(F.posexplode("treatments").alias("pos", "t")).select("pos", "t.*")
    treatments = treatments.withColumns({c: F.coalesce(c, none) for c in ("remove_flags", "append_flags", "supported_routes")}).withColumn("phase", F.coalesce("phase", F.lit("compile")))
    profiles = doc.select(F.explode("profiles").alias("profile", "ids")).select("profile", F.posexplode("ids").alias("pos", "treatment"))
    return {
        "document": doc.select("schema_version", F.coalesce("recipe_directory", F.lit("recipes")).alias("recipe_directory")),
        "routes": routes,
        "treatments": treatments,
        "profiles": profiles,
        "requested_libraries": doc.select(F.posexplode("requested_libraries").alias("pos", "request")),
    }


def recipes(spark: SparkSession, directory: str) -> DataFrame:
    """One row per ``*.json`` document, in order of path; digests in lower case."""
    rows = spark.read.schema(RECIPE).option("multiLine", True).option("pathGlobFilter", "*.json").json(directory)
    return rows.withColumn("sha256", F.lower("sha256")).withColumn("path", F.col("_metadata.file_path")).orderBy("path")


def request_queue(spark: SparkSession, path: str) -> DataFrame:
    """The queue file with its row order; a missing file is an empty queue, another header an error."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], T.StructType([T.StructField("row_no", T.LongType()), *[T.StructField(c, _S) for c in COLUMNS]]))
    head = spark.read.text(path).limit(1).collect()
    if not head or head[0]["value"].split(",") != COLUMNS:
        raise ValueError(f"unsupported columns in {path}")
    rows = spark.read.schema(T.StructType([T.StructField(c, _S) for c in COLUMNS])).option("header", True).option("escape", '"').option("multiLine", True).csv(path)
    return rows.na.fill("").withColumn("row_no", F.monotonically_increasing_id())


def csv_rows(spark: SparkSession, path: str) -> DataFrame:
    """A manifest read back: all columns text, empty stays empty."""
    return spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(path).na.fill("")


def tsv_rows(spark: SparkSession, path: str, columns: Sequence[str] = ("library", "version", "variant", "folder_path", "fidb_path")) -> DataFrame:
    """line_no, columns, problem (wrong_field_count or null); blank lines and those with ``#`` in front are skipped."""
    rows = lines(spark, path).where((strip("value") != "") & ~strip("value").startswith("#"))
    f = F.split("value", "\t")
    return rows.select("line_no", *[F.get(f, F.lit(i)).alias(c) for i, c in enumerate(columns)], F.when(F.size(f) != len(columns), "wrong_field_count").alias("problem"))


def listing(spark: SparkSession, directory: str, pattern: str = "*") -> DataFrame:
    """path and length of all files below a directory; contents are not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(directory).select("path", "length")


def fingerprints(spark: SparkSession, paths: Sequence[str]) -> dict[str, tuple[int, int, int]]:
    """Lines, and two sums over numbered lines, of each of a few text files of any size: equal for equal texts.

    One row per file is fetched; no line passes the driver.
    """
    rows = lines(spark, list(dict.fromkeys(paths))).groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("line_no", "value")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "value", "line_no")).alias("y"))
    return {r["path"]: (r["n"], r["x"], r["y"]) for r in rows.collect()}


def digests(spark: SparkSession, directory: str, pattern: str = "*") -> DataFrame:
    """path, length and SHA-256 of all files below a directory (each under 2 GB)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(directory)
    return files.select("path", "length", F.sha2("content", 256).alias("sha256"))
