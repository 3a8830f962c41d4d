"""Cells of libraries, routes and treatments; requests and the catalogue."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_NONE = "array<string>"


def applies_to(supported: Column, route: Column) -> Column:
    """No list, or an empty one, means every route."""
    listed = F.coalesce(supported, F.array().cast(_NONE))
    return (F.size(listed) == 0) | F.coalesce(F.array_contains(listed, route), F.lit(False))


def flags_for(flags: Column, remove: Column, append: Column) -> Column:
    """Flags without every removed one, in order and with repeats, then the appended ones."""
    removed = F.coalesce(remove, F.array().cast(_NONE))
    kept = F.filter(F.coalesce(flags, F.array().cast(_NONE)), lambda f: ~F.array_contains(removed, f))
    return F.concat(kept, F.coalesce(append, F.array().cast(_NONE)))


def catalogue_keys(recipes: DataFrame) -> DataFrame:
    """Every recipe under its three request keys: name, name-version, name@version."""
    keys = F.array(F.col("name"), F.concat_ws("-", "name", "version"), F.concat_ws("@", "name", "version"))
    return recipes.select(F.explode(keys).alias("request_key"), *recipes.columns)


def ambiguous_keys(recipes: DataFrame) -> DataFrame:
    """Request keys that more than one recipe answers to."""
    return catalogue_keys(recipes).groupBy("request_key").agg(F.count(F.lit(1)).alias("n_recipes")).where("n_recipes > 1")


def resolve_requests(requests: DataFrame, request: str, recipes: DataFrame) -> DataFrame:
    """Requests with their recipes; an ambiguous key yields each of its recipes."""
    keys = catalogue_keys(recipes)
    return requests.join(keys, requests[request] == keys["request_key"])


def missing_requests(requests: DataFrame, request: str, recipes: DataFrame) -> DataFrame:
    """Requests no recipe answers to, null ones included."""
    keys = catalogue_keys(recipes).select("request_key").distinct()
    return requests.join(keys, requests[request] == keys["request_key"], "left_anti")


def duplicate_resolutions(resolved: DataFrame) -> DataFrame:
    """Recipes that more than one request resolves to."""
    return resolved.groupBy("name", "version").agg(F.count(F.lit(1)).alias("n_requests")).where("n_requests > 1")


def positions(spark: SparkSession, values: Sequence[str], name: str) -> DataFrame:
    """A short list as rows (pos, value)."""
    return spark.createDataFrame(list(enumerate(values)), T.StructType([T.StructField("pos", T.IntegerType(), False), T.StructField(name, T.StringType(), False)]))


def select_in_order(table: DataFrame, key: str, wanted: Sequence[str]) -> DataFrame:
    """Rows in the order asked for; what is asked twice comes twice."""
    return positions(table.sparkSession, wanted, key).join(table, key)


def unknown_ids(table: DataFrame, key: str, wanted: Sequence[str]) -> DataFrame:
    """Ids asked for that the table lacks, sorted."""
    return positions(table.sparkSession, wanted, key).select(key).distinct().join(table, key, "left_anti").orderBy(key)


def plan_cells(libraries: DataFrame, routes: DataFrame, treatments: DataFrame) -> DataFrame:
    """Every library, route and treatment with its plan status.

    The three are catalogues (documents people write), so their product is the
    plan itself and stays small. Libraries need ``identifier``, routes
    ``route``, treatments ``id`` and ``supported_routes``. Routes and treatments
    go to the libraries: partitions do not multiply.
    """
    cells = libraries.select("identifier").crossJoin(F.broadcast(routes.select("route"))).crossJoin(F.broadcast(treatments.select(F.col("id").alias("treatment"), "supported_routes")))
    return cells.select("identifier", "route", "treatment", F.when(applies_to(F.col("supported_routes"), F.col("route")), "runnable").otherwise("unsupported").alias("plan_status"))


def plan_summary(cells: DataFrame) -> DataFrame:
    """The headline of a plan."""
    n = cells.agg(F.count_distinct("identifier").alias("a"), F.count_distinct("route").alias("b"), F.count_distinct("treatment").alias("c"), F.count(F.lit(1)).alias("d"), F.count_if(F.col("plan_status") == "runnable").alias("e"))
    return n.select(F.format_string("Plan: %d libraries; %d routes; %d treatments; %d cells (%d runnable)", "a", "b", "c", "d", "e").alias("line"))


def plan_lines(cells: DataFrame) -> DataFrame:
    return cells.select(F.concat(F.lit("- "), F.concat_ws(" | ", "identifier", "route", "treatment", "plan_status")).alias("line"))


#: Texts of build and link commands below are fixed values.


def build_steps(system: Column, jobs: int, compiler: Column, archiver: Column, ranlib: Column, flags: Column, archive: Column) -> Column:
    """Command lines of the two implemented build systems (words joined by blanks); null for others."""
    make = [F.concat(F.lit("make -j"), F.lit(jobs).cast("string")), archive]
    configured = F.array(F.lit("sh configure --static"), F.concat_ws(" ", *make, F.concat(F.lit("AR="), archiver), F.lit("ARFLAGS=rc"), F.concat(F.lit("RANLIB="), ranlib)))
    plain = F.array(F.concat_ws(" ", *make, F.concat(F.lit("CC="), compiler), F.concat(F.lit("CFLAGS=-Wall -Winline -D_FILE_OFFSET_BITS=64 "), flags), F.concat(F.lit("AR="), archiver), F.concat(F.lit("RANLIB="), ranlib)))
    return F.when(system == "autoconf", configured).when(system == "make", plain)


def build_environment(system: Column, compiler: Column, archiver: Column, ranlib: Column, flags: Column) -> Column:
    """Variables set for a configured build; none for others."""
    some = F.create_map(F.lit("CC"), compiler, F.lit("AR"), archiver, F.lit("RANLIB"), ranlib, F.lit("CFLAGS"), flags)
    return F.when(system == "autoconf", some).otherwise(F.create_map().cast("map<string,string>"))


def allowed_environment(env: Column, allowed: Sequence[str], fixed: dict[str, str], extra: Column) -> Column:
    """Allowed names of ``env``, then fixed values, then ``extra``; later ones win."""
    kept = F.map_filter(env, lambda k, _: k.isin(*allowed))
    constants = F.create_map(*[F.lit(x) for kv in fixed.items() for x in kv])
    over = F.map_filter(kept, lambda k, _: ~F.map_contains_key(constants, k) & ~F.map_contains_key(extra, k))
    low = F.map_filter(constants, lambda k, _: ~F.map_contains_key(extra, k))
    return F.map_concat(over, low, extra)


def link_command(target_os: Column, compiler: Column, flags: Column, archives: Column, factor: Column, output: Column) -> Column:
    """Words of the link step; null where the target has no linker here."""
    head = F.concat(compiler, flags, F.array(F.lit("-shared"), F.lit("-nostdlib"), F.lit("-Wl,--whole-archive")), archives, F.array(F.lit("-Wl,--no-whole-archive")))
    gc = F.when(factor == "linker_transformation", F.array(F.lit("-Wl,--gc-sections"))).otherwise(F.array().cast(_NONE))
    return F.when(target_os == "linux", F.concat(head, gc, F.array(F.lit("-o"), output)))
