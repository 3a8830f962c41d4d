"""Whole runs, put together from the operators: plan, probe, queue and manifest.

Configuration documents are small by nature; what decides about a run (broken
rules, unknown names) is fetched to the driver, function rows and records never are.
"""

from __future__ import annotations

import os
import sys
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigloom.errors import RequestsUnknown, RuleBroken, RunIncomplete
from sigloom.functions import text as X
from sigloom.operators import manifest, matrix, planning, requests, rules
from sigloom.plans.session import shared_dir
from sigloom.sources import publish, readers

#: Fields of an exported function, and columns of the matrix in file order (fixed values).
FUNCTION_FIELDS = {"case": "string", "source_sha256": "string", "program": "string", "language_id": "string", "compiler_spec": "string", "entry_point": "string", "function_name": "string", "code_unit_size": "bigint", "full_hash": "string", "specific_hash": "string", "specific_hash_additional_size": "bigint"}

MATRIX_COLUMNS = ["reference_case", "comparison_case", "reference_hashable", "comparison_hashable", "shared_entrypoints", "full_hash_equal", "specific_hash_equal", "dual_hash_equal", "reference_retained_pct", "comparison_retained_pct"]


@dataclass(frozen=True)
class Configuration:
    """Libraries (in request order), routes, treatments and profiles of a run."""

    libraries: DataFrame
    routes: DataFrame
    treatments: DataFrame
    profiles: DataFrame


def _stop_at_first(df: DataFrame, entity: str, label: str, checks: Sequence[rules.Rule]) -> None:
    bad = rules.first_violation(df, checks).where("violation is not null").select(F.col(label).cast("string"), "violation").first()
    if bad:
        raise RuleBroken(f"{entity} {bad[0]}", bad[1])


def _unique(df: DataFrame, column: str, what: str) -> None:
    twice = df.groupBy(column).count().where("count > 1").first()
    if twice:
        raise RuleBroken(f"{what} {twice[0]}", "not_unique")


def load(spark: SparkSession, path: str, requested: Sequence[str] | None = None, schema: str = rules.WORKER_SCHEMA, recipe_schema: str = rules.RECIPE_SCHEMA) -> Configuration:
    """Reads and checks a worker document and its recipes; the first broken rule stops it.

    All unknown requests are reported together, before requests that resolve to
    one recipe twice.
    """
    doc = readers.worker_configuration(spark, path)
    head = doc["document"].first()
    if head is None or head["schema_version"] != schema:
        raise RuleBroken("configuration", "schema_version")
    recipes = readers.recipes(spark, os.path.join(os.path.dirname(path), head["recipe_directory"])).drop("path").cache()
    _stop_at_first(recipes, "recipe", "name", rules.recipe_rules(recipe_schema))
    clash = planning.ambiguous_keys(recipes).first()
    if clash:
        raise RuleBroken(f"recipe key {clash['request_key']}", "not_unique")
    asked = planning.positions(spark, list(requested), "request") if requested else doc["requested_libraries"]
    if not asked.take(1):
        raise RuleBroken("configuration", "no_requests")
    missing = [r["request"] for r in planning.missing_requests(asked, "request", recipes).orderBy("pos").collect()]
    if missing:
        raise RequestsUnknown(tuple(missing), tuple(sorted({r["name"] for r in recipes.select("name").collect()})))
    libraries = planning.resolve_requests(asked, "request", recipes).withColumn("identifier", X.identifier("name", "version"))
    _unique(libraries, "identifier", "requested library")
    routes, treatments = doc["routes"], doc["treatments"]
    for df, what in ((routes, "route"), (treatments, "treatment")):
        if not df.take(1):
            raise RuleBroken("configuration", f"no_{what}s")
        _unique(df, "id", what)
    _stop_at_first(routes, "route", "id", rules.route_rules())
    stray = doc["profiles"].join(treatments.select(F.col("id").alias("treatment")), "treatment", "left_anti").first()
    if stray:
        raise RuleBroken(f"profile {stray['profile']}", "unknown_treatments")
    _stop_at_first(treatments, "treatment", "id", rules.treatment_rules())
    return Configuration(libraries, routes, treatments, doc["profiles"])


def select(config: Configuration, routes: Sequence[str] | None = None, treatments: Sequence[str] | None = None, profile: str = "default") -> Configuration:
    """The part asked for, in the order asked for. Treatments override the profile, which is then not looked at."""
    if treatments:
        wanted = list(treatments)
    else:
        wanted = [r["treatment"] for r in config.profiles.where(F.col("profile") == profile).orderBy("pos").collect()]
        if not wanted and not config.profiles.where(F.col("profile") == profile).take(1):
            raise RuleBroken(f"profile {profile}", "unknown")
    chosen = list(routes) if routes else [r["id"] for r in config.routes.orderBy("pos").select("id").collect()]
    for table, ids, what in ((config.routes, chosen, "routes"), (config.treatments, wanted, "treatments")):
        unknown = [r["id"] for r in planning.unknown_ids(table, "id", ids).collect()]
        if unknown:
            raise RuleBroken(f"{what} {', '.join(unknown)}", "unknown")
    return replace(config, routes=planning.select_in_order(config.routes.drop("pos"), "id", chosen), treatments=planning.select_in_order(config.treatments.drop("pos"), "id", wanted))


def plan(config: Configuration) -> list[str]:
    """Headline and one line per cell: libraries, then routes, then treatments in their order."""
    cells = (
        config.libraries.select("identifier", F.col("pos").alias("p1"))
        .crossJoin(F.broadcast(config.routes.select(F.col("id").alias("route"), F.col("pos").alias("p2"))))
        .crossJoin(F.broadcast(config.treatments.select(F.col("id").alias("treatment"), "supported_routes", F.col("pos").alias("p3"))))
        .withColumn("plan_status", F.when(planning.applies_to(F.col("supported_routes"), F.col("route")), "runnable").otherwise("unsupported"))
        .orderBy("p1", "p2", "p3")
    )
    rows = cells.select("identifier", "route", "treatment", "plan_status").collect()
    n = [len(df.select("pos").collect()) for df in (config.libraries, config.routes, config.treatments)]
    runnable = sum(r["plan_status"] == "runnable" for r in rows)
    return [f"Plan: {n[0]} libraries; {n[1]} routes; {n[2]} treatments; {len(rows)} cells ({runnable} runnable)", *("- " + " | ".join(r) for r in rows)]


def probe(spark: SparkSession, cases: Mapping[str, str], out_dir: str) -> dict[str, str]:
    """Function rows of labelled cases (label -> JSON-lines path) -> functions.csv, matrix.csv and manifest.json.

    A line that is no object stops the run with its place; so do fewer than two
    cases, odd labels, a case without functions, an output folder that is the
    folder of an input or lies around or inside it, and inputs that are not the
    same after the run as before.
    """
    labels = planning.positions(spark, list(cases), "label")
    broken = rules.case_set_violation(labels).first()["violation"]
    if broken:
        raise RuleBroken("cases", broken)
    _stop_at_first(labels, "case", "label", [("label_characters", F.col("label").rlike(X.CASE_LABEL))])
    _apart(spark, list(cases.values()), out_dir)
    before = readers.fingerprints(spark, list(cases.values()))
    parts = []
    for pos, (label, path) in enumerate(cases.items()):
        rows = readers.json_rows(spark, path, FUNCTION_FIELDS)
        bad = rows.where("problem is not null").orderBy("line_no").select("line_no", "problem").first()
        if bad:
            raise RuleBroken(f"{path}:{bad['line_no']}", bad["problem"])
        if not rows.take(1):
            raise RuleBroken(f"case {label}", "no_functions")
        parts.append(rows.drop("problem", "path").withColumn("case", F.lit(label)).withColumn("__pos", F.lit(pos)))
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    pairs = matrix.compat_matrix(every, "case", "entry_point", "full_hash", "specific_hash", ["line_no"])
    order = planning.positions(spark, list(cases), "case")
    pairs = pairs.join(order.select(F.col("case").alias("reference_case"), F.col("pos").alias("p")), "reference_case").join(order.select(F.col("case").alias("comparison_case"), F.col("pos").alias("q")), "comparison_case")
    out = {"functions": os.path.join(out_dir, "functions.csv"), "matrix": os.path.join(out_dir, "matrix.csv"), "manifest": os.path.join(out_dir, "manifest.json")}
    publish.write_csv(every, out["functions"], ["__pos", "line_no"], list(FUNCTION_FIELDS))
    publish.write_csv(pairs, out["matrix"], ["p", "q"], MATRIX_COLUMNS)
    digests = {os.path.basename(p): publish.file_digest(spark, p) for p in (out["functions"], out["matrix"])}
    after = readers.fingerprints(spark, list(cases.values()))
    changed = sorted(p for p in before.keys() | after.keys() if before.get(p) != after.get(p))
    if changed:
        raise RuleBroken(", ".join(changed), "changed_during_the_run")
    counted = {r["case"]: r["n"] for r in every.groupBy("case").agg(F.count(F.lit(1)).alias("n")).collect()}
    listed = [(c, cases[c], counted[c]) for c in cases]
    document = spark.createDataFrame([(listed, digests)], "cases array<struct<label:string,source:string,hashable_functions:bigint>>, outputs map<string,string>")
    publish.write_document(document, out["manifest"])
    return out


def _apart(spark: SparkSession, inputs: Sequence[str], out_dir: str) -> None:
    """The output folder is no input and holds none; it is no link."""
    places = [("output", os.path.abspath(out_dir), os.path.islink(out_dir)), *[(f"input {i}", os.path.abspath(p), False) for i, p in enumerate(dict.fromkeys(inputs))]]
    roots = spark.createDataFrame(places, "name string, path string, is_symlink boolean")
    broken = rules.directory_violations(roots, "/").where("name = 'output' and violation is not null").first()
    if broken:
        raise RuleBroken(f"output {out_dir}", broken["violation"])


def record_missing(spark: SparkSession, path: str, names: Sequence[str], priority: int, routes: Sequence[str] = (), now: str | None = None) -> str:
    """Adds requests nobody could answer to the queue file and rewrites it in one step."""
    if priority not in (0, 1, 2):
        raise RuleBroken("priority", "not_0_1_or_2")
    if any(not (n or "").strip() for n in names):
        raise RuleBroken("request", "empty_name")
    for token in (*names, *routes):
        broken = spark.createDataFrame([(token,)], "t string").select(X.token_violation(X.strip("t")).alias("v")).first()["v"]
        if broken:
            raise RuleBroken(f"token {token!r}", broken)
    now = now or datetime.now(timezone.utc).replace(microsecond=0).isoformat()
    incoming = spark.createDataFrame([(i, n, str(priority), ";".join(routes), now) for i, n in enumerate(names)], "seq bigint, library string, priority string, routes string, at string")
    old = readers.request_queue(spark, path)
    merged = requests.upsert_requests(old, "row_no", requests.fold_requests(incoming, "seq", "library", "priority", "routes", "at"))
    # rows that are there stay in their order, new ones follow as they were asked for
    return publish.write_csv(merged.withColumn("is_new", F.col("place").isNull()), path, ["is_new", "place", "first_seq"], requests.COLUMNS)


def finish(records: DataFrame, path: str, order: Sequence[str]) -> str:
    """Writes the manifest, then reports: the roll-up line, or an error naming every incomplete cell."""
    publish.write_csv(manifest.with_defaults(records), path, order)
    left = manifest.incomplete(records).select("library", "route", "treatment", "status").orderBy("library", "route", "treatment").collect()
    if left:
        raise RunIncomplete(tuple(f"{r['library']}/{r['route']}/{r['treatment']}={r['status']}" for r in left), path)
    return manifest.rollup_text(records).first()["line"]


def health(spark: SparkSession, config: str | None = None) -> list[tuple[str, bool, str]]:
    """What a run needs, whether it is there, and what was found: (name, ok, text)."""
    java = spark.sparkContext._jvm.System.getProperty("java.version")
    found = [("spark", int(spark.version.split(".")[0]) >= 4, spark.version), ("java", int(java.split(".")[0]) >= 17, java), ("python", True, ".".join(map(str, sys.version_info[:3])))]
    try:
        found.append(("shared folder", True, shared_dir(spark)))
    except RuntimeError as error:
        found.append(("shared folder", False, str(error)))
    if config:
        try:
            c = load(spark, config)
            found.append(("configuration", True, f"{c.libraries.count()} libraries; {c.routes.count()} routes; {c.treatments.count()} treatments"))
        except Exception as error:  # whatever is wrong with it is the report
            found.append(("configuration", False, str(error).splitlines()[0]))
    return found
