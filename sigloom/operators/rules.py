"""Ordered rules: the first broken one of each row, as data."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigloom.functions.text import CASE_LABEL, first_part, missing_markers, safe_component, second_part, strip

Rule = tuple[str, Column]

#: Version texts of the documents (fixed values).
WORKER_SCHEMA, RECIPE_SCHEMA = "fidb-worker/v2", "fidb-recipe/v2"


def first_broken(rules: Sequence[Rule]) -> Column:
    """Name of the first rule whose predicate does not hold (null counts as broken), else null."""
    out = F.when(F.lit(False), F.lit(""))
    for name, holds in rules:
        out = out.when(~F.coalesce(holds, F.lit(False)), F.lit(name))
    return out


def first_violation(df: DataFrame, rules: Sequence[Rule], name: str = "violation") -> DataFrame:
    return df.withColumn(name, first_broken(rules))


def _filled(c: str) -> Column:
    return F.size(F.coalesce(F.col(c), F.array().cast("array<string>"))) > 0


def recipe_rules(schema: str = RECIPE_SCHEMA) -> list[Rule]:
    """Rules of a recipe row in order. ``schema`` is the version text it has to have."""
    required = ["name", "version", "url", "sha256", "source_directory", "project_markers", "allowed_build_systems", "preferred_build_system", "static_archives"]
    return [
        ("schema_version", F.col("schema_version") == schema),
        *[(f"missing_{c}", F.col(c).isNotNull()) for c in required],
        *[(f"unsafe_{c}", safe_component(c)) for c in ("name", "version", "source_directory")],
        ("unsafe_static_archive", F.forall("static_archives", safe_component)),
        ("sha256_length", F.length("sha256") == 64),
        ("incomplete_detection", _filled("project_markers") & _filled("static_archives")),
        ("preferred_not_allowed", F.array_contains("allowed_build_systems", F.col("preferred_build_system"))),
    ]


def route_rules() -> list[Rule]:
    """Rules of a route row in order."""
    return [
        ("unsafe_id", safe_component("id")),
        ("empty_tool_command", _filled("compiler") & _filled("archiver")),
        ("incomplete_linked_output", F.col("linked_suffix").startswith(".") & _filled("linked_file_markers")),
    ]


def treatment_rules() -> list[Rule]:
    return [("unsafe_id", safe_component("id")), ("phase", F.col("phase").isin("compile", "link"))]


def identity_rules(library: Column, version: Column, variant: Column, path: Column) -> list[Rule]:
    """Rules of a population row's identity (library, version, variant, fidb_path) against what was asked for, in order."""
    return [
        ("wrong_library", F.col("library") == library),
        ("wrong_version", F.col("version") == version),
        ("wrong_variant", F.col("variant") == variant),
        ("unexpected_path", plain_path(F.coalesce("fidb_path", F.lit(""))) == plain_path(path)),
    ]


def file_rules(size: Column) -> list[Rule]:
    """The file a population row points at is there and holds something; the last rule of a row."""
    return [("empty_file", size > 0)]


def population_violations(populations: DataFrame, libraries: DataFrame, files: DataFrame, group: str, directory: str) -> DataFrame:
    """pos, name, violation: the first broken rule of each library of a group's population report.

    ``libraries``: pos, name, version, identifier, expected_programs; ``files``:
    path, bytes. If the report's names are not those of the libraries, each as
    often, every library has the violation ``names``. A report covers the
    libraries of a run, so one row says whether its names are right.
    """
    counts = libraries.select(F.col("name"), F.lit(1).alias("k")).unionByName(populations.select(F.col("library").alias("name"), F.lit(-1).alias("k"))).groupBy("name").agg(F.sum("k").alias("k"))
    names = counts.agg(F.coalesce(F.bool_and(F.col("k") == 0), F.lit(True)).alias("names_match"))
    # where names match, a library has one row; where they do not, which one is of no importance
    one = populations.groupBy("library").agg(*[F.min(c).alias(c) for c in ("version", "variant", "fidb_path", "program_count", "attempted", "added", "excluded")])
    path = F.concat(F.lit(directory.rstrip("/") + "/"), "identifier", F.lit(f"-{group}.fidb"))
    wanted = libraries.select("pos", F.col("name").alias("w_name"), F.col("version").alias("w_version"), path.alias("w_path"), "expected_programs")
    rows = wanted.join(one, wanted["w_name"] == one["library"], "left").join(files.select(F.col("path").alias("w_path"), "bytes"), "w_path", "left").join(F.broadcast(names))
    checks = [("names", F.col("names_match")), *identity_rules(F.col("w_name"), F.col("w_version"), F.lit(group), F.col("w_path")), *population_rules(F.col("expected_programs")), *file_rules(F.col("bytes"))]
    return first_violation(rows, checks).select("pos", F.col("w_name").alias("name"), "violation")


def tool_rules(exit_code: Column, version: Column, markers: Column) -> list[Rule]:
    """A tool said what it is (exit 0 and some text), and the text holds every marker."""
    return [("not_identified", (exit_code == 0) & (strip(version) != "")), ("missing_markers", F.size(missing_markers(markers, version)) == 0)]


def checkout_violation(listing: DataFrame, root: str, config: str, sentinels: Sequence[str]) -> DataFrame:
    """violation, missing: root_not_directory, configuration_outside, missing_sentinels or null.

    ``listing``: path and is_directory of what is there, links resolved.
    ``sentinels`` are paths below the root that a checkout holds.
    """
    p = plain_path(F.col("path"))
    top = plain_path(F.lit(root))
    seen = listing.select(p.alias("p"), "is_directory")
    wanted = F.array(*[F.lit(s) for s in sentinels]).cast("array<string>")
    full = [F.concat(F.when(top == "/", "").otherwise(top), F.lit(f"/{s}")) for s in sentinels]
    facts = seen.agg(
        F.coalesce(F.bool_or((F.col("p") == top) & F.col("is_directory")), F.lit(False)).alias("rooted"),
        F.coalesce(F.bool_or((F.col("p") == plain_path(F.lit(config))) & ~F.col("is_directory") & strictly_inside(F.col("p"), top)), F.lit(False)).alias("configured"),
        *[F.coalesce(F.bool_or(F.col("p") == s), F.lit(False)).alias(f"s{i}") for i, s in enumerate(full)],
    )
    there = F.array(*[F.col(f"s{i}") for i in range(len(sentinels))]).cast("array<boolean>")
    missing = F.transform(F.filter(F.arrays_zip(wanted.alias("w"), there.alias("t")), lambda z: ~z["t"]), lambda z: z["w"])
    rule = F.when(~F.col("rooted"), "root_not_directory").when(~F.col("configured"), "configuration_outside").when(F.size(missing) > 0, "missing_sentinels")
    return facts.select(rule.alias("violation"), missing.alias("missing"))


def population_rules(expected: Column) -> list[Rule]:
    """Rules of a population row's counts (program_count, attempted, added, excluded) in order."""
    counts = ["program_count", "attempted", "added", "excluded"]
    whole = F.lit(True)
    for c in counts:
        whole = whole & F.coalesce(F.col(c) >= 0, F.lit(False))
    return [
        ("invalid_counts", whole),
        ("empty", (F.col("program_count") > 0) & (F.col("attempted") > 0)),
        ("no_expected_count", expected.isNotNull()),
        ("program_count", F.col("program_count") == expected),
        ("not_reconciled", F.col("attempted") == F.col("added") + F.col("excluded")),
        ("none_added", F.col("added") > 0),
    ]


def queue_rules() -> list[Rule]:
    """Rules of a queue row: a name, and a priority of 0, 1 or 2."""
    return [("empty_name", strip("library_request") != ""), ("priority", strip("priority").isin("0", "1", "2"))]


def parse_cases(df: DataFrame, column: str) -> DataFrame:
    """``LABEL=ID`` texts as label, language_id and the first broken rule."""
    parsed = df.withColumn("label", first_part(column)).withColumn("language_id", second_part(column))
    rules = [("not_label_and_id", (F.col("label") != "") & (F.col("language_id") != "")), ("label_characters", F.col("label").rlike(CASE_LABEL))]
    return first_violation(parsed, rules)


def case_set_violation(cases: DataFrame) -> DataFrame:
    """One row: too_few_cases, repeated_labels or null."""
    n = cases.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("label").alias("d"))
    return n.select(F.when(F.col("n") < 2, "too_few_cases").when(F.col("n") != F.col("d"), "repeated_labels").alias("violation"))


def http_retry(code: Column, attempt: Column, attempts: int = 3) -> Column:
    """Whether a failed fetch is tried again: 429 or 5xx, and an attempt is left (attempts count from 0)."""
    return ((code == 429) | code.between(500, 599)) & (attempt < attempts - 1)


def plain_path(path: Column) -> Column:
    """Without repeated slashes, single dots and a slash at the end; upward steps stay and fail the checks below."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(path, r"/+(\./+)*", "/"), r"(?<=/)\.\z", ""), r"(?<=[^/])/\z", "")


def strictly_inside(path: Column, root: Column) -> Column:
    """Whether a path lies below a root (not the root itself) by its text, without upward steps."""
    p, r = plain_path(path), plain_path(root)
    return F.coalesce(p.startswith(F.concat(F.when(r == "/", "").otherwise(r), F.lit("/"))) & (p != r) & ~F.array_contains(F.split(p, "/"), ".."), F.lit(False))


def directory_violations(roots: DataFrame, project: str) -> DataFrame:
    """First broken rule of each generated root (name, path, is_symlink).

    symbolic_link, not_a_directory (if there is a column ``is_directory``, null
    for what is not there), outside_project, unexpected_path (if there is a
    column ``expected``), overlapping_roots. A run names a handful of roots;
    they are compared as one array.
    """
    every = roots.agg(F.collect_list(F.struct("name", plain_path(F.col("path")).alias("p"))).alias("every"))
    mine = plain_path(F.col("path"))
    below = lambda a, b: a.startswith(F.concat(b, F.lit("/")))
    overlap = F.exists("every", lambda o: (o["name"] != F.col("name")) & ((o["p"] == mine) | below(o["p"], mine) | below(mine, o["p"])))
    rule = F.when(F.col("is_symlink"), "symbolic_link")
    if "is_directory" in roots.columns:
        rule = rule.when(~F.col("is_directory"), "not_a_directory")
    rule = rule.when(~strictly_inside(F.col("path"), F.lit(project)), "outside_project")
    if "expected" in roots.columns:
        rule = rule.when(mine != plain_path(F.col("expected")), "unexpected_path")
    rule = rule.when(overlap, "overlapping_roots")
    return roots.crossJoin(F.broadcast(every)).select("name", "path", rule.alias("violation"))


def changed_inputs(before: DataFrame, after: DataFrame) -> DataFrame:
    """Paths whose digest differs between two listings (path, sha256), or that one of them lacks."""
    b, a = before.select("path", F.col("sha256").alias("before")), after.select("path", F.col("sha256").alias("after"))
    return b.join(a, "path", "full_outer").where(~F.col("before").eqNullSafe(F.col("after")))
