"""Registered queries of documents, listings, digests, identities and rule sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigloom.functions import text as X
from sigloom.operators import detect, manifest, reconcile, rules
from sigloom.plans.session import fresh_dir, table
from sigloom.sources import publish, readers

Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        Q[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


def _worker(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """A worker document made of the catalogues, read back with its defaults."""
    t = table(spark, sf_dir, "treatment").select("id", "factor", "description", F.nullif("phase", F.lit("compile")).alias("phase"), "remove_flags", "append_flags", "supported_routes")
    r = table(spark, sf_dir, "build_record").where("route <> ''").groupBy(F.col("route").alias("id")).agg(F.min("ghidra_language").alias("ghidra_language"), F.min("ghidra_compiler_spec").alias("ghidra_compiler_spec"), F.min("archiver_command").alias("archiver_command"))
    routes = r.select("id", "ghidra_language", F.nullif("ghidra_compiler_spec", F.lit("default")).alias("ghidra_compiler_spec"), F.split("archiver_command", " ").alias("archiver"))
    listed = lambda df, c: df.agg(F.array_sort(F.collect_list(F.struct(*df.columns))).alias(c))
    names = table(spark, sf_dir, "recipe").select(X.identifier("name", "version").alias("n"))
    doc = (
        listed(t, "treatments")
        .join(listed(routes, "routes"))
        .join(names.agg(F.array_sort(F.collect_list("n")).alias("requested_libraries")))
        .withColumn("profiles", F.create_map(F.lit("default"), F.transform("treatments", lambda x: x["id"]), F.lit("first"), F.array(F.col("treatments")[0]["id"])))
        .withColumn("schema_version", F.lit(rules.WORKER_SCHEMA))
    )
    return readers.worker_configuration(spark, publish.write_document(doc, f"{fresh_dir(spark, 'worker')}/worker.json"))


@query("SELECT (row_number() OVER (ORDER BY id) - 1)::INTEGER AS pos, id, factor, phase, coalesce(len(remove_flags), 0)::INTEGER AS n_remove, array_to_string(coalesce(append_flags, []::VARCHAR[]), ' ') AS append_flags, array_to_string(coalesce(supported_routes, []::VARCHAR[]), ';') AS supported_routes FROM treatment")
def worker_treatments(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _worker(spark, sf_dir)["treatments"]
    return t.select("pos", "id", "factor", "phase", F.size("remove_flags").alias("n_remove"), X.pack("append_flags", " ").alias("append_flags"), X.pack("supported_routes").alias("supported_routes"))


@query("SELECT (row_number() OVER (ORDER BY id) - 1)::INTEGER AS pos, id, language, coalesce(spec, 'default') AS spec, coalesce(archiver, '') AS ranlib FROM (SELECT route AS id, min(ghidra_language) AS language, min(ghidra_compiler_spec) AS spec, min(archiver_command) AS archiver FROM build_record WHERE route <> '' GROUP BY 1)")
def worker_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Routes with their defaults: ranlib is the archiver, the compiler description ``default``."""
    r = _worker(spark, sf_dir)["routes"]
    return r.select("pos", "id", F.col("ghidra_language").alias("language"), F.col("ghidra_compiler_spec").alias("spec"), X.pack(F.coalesce("ranlib", F.array().cast("array<string>")), " ").alias("ranlib"))


@query("SELECT 'default' AS profile, (row_number() OVER (ORDER BY id) - 1)::INTEGER AS pos, id AS treatment FROM treatment UNION ALL SELECT 'first', 0, min(id) FROM treatment")
def worker_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _worker(spark, sf_dir)["profiles"]


@query("SELECT (row_number() OVER (ORDER BY n) - 1)::INTEGER AS pos, n AS request FROM (SELECT name || '-' || version AS n FROM recipe)")
def worker_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _worker(spark, sf_dir)["requested_libraries"]


@query("SELECT name, version, lower(sha256) AS sha256, array_to_string(static_archives, ';') AS static_archives, len(project_markers)::INTEGER AS n_markers FROM recipe")
def recipe_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A folder of one JSON document a recipe."""
    at = fresh_dir(spark, "recipes")
    table(spark, sf_dir, "recipe").write.option("maxRecordsPerFile", 1).json(at)
    return readers.recipes(spark, at).select("name", "version", "sha256", X.pack("static_archives").alias("static_archives"), F.size("project_markers").alias("n_markers"))


def _texts(spark: SparkSession, sf_dir: str) -> str:
    """A tree of files: the address of each recipe below folders of its name and version."""
    at = fresh_dir(spark, "tree")
    table(spark, sf_dir, "recipe").select("name", "version", F.col("url").alias("value")).write.partitionBy("name", "version").option("maxRecordsPerFile", 1).text(at)
    return at


def _owner(df: DataFrame) -> DataFrame:
    return df.select(F.regexp_extract("path", "/name=([^/]*)/", 1).alias("name"), F.regexp_extract("path", "/version=([^/]*)/", 1).alias("version"), *[c for c in df.columns if c != "path"])


@query("SELECT name, version, strlen(url)::BIGINT + 1 AS length FROM recipe")
def directory_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _owner(readers.listing(spark, _texts(spark, sf_dir), "*.txt"))


@query("SELECT name, version, strlen(url)::BIGINT + 1 AS length, sha256(url || chr(10)) AS sha256 FROM recipe")
def file_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _owner(readers.digests(spark, _texts(spark, sf_dir), "*.txt"))


@query("SELECT record_id, analysis_artifact_path AS path FROM build_record WHERE analysis_artifact_kind = 'shared_object'")
def enumerated_programs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Artifacts of one content type, in order of path."""
    b = table(spark, sf_dir, "build_record").select("record_id", F.col("analysis_artifact_path").alias("path"), "analysis_artifact_kind")
    return detect.programs(b, "path", "analysis_artifact_kind", "shared_object").select("record_id", "path")


@query("SELECT record_id, replace(version_text, chr(10), ' | ') AS line FROM (SELECT record_id, compiler_version || chr(10) || archiver_version || chr(10) || ranlib_version AS version_text FROM build_record)")
def version_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Version texts of several lines in one."""
    text = F.concat("compiler_version", F.lit("\n"), "archiver_version", F.lit("\n"), "ranlib_version")
    return table(spark, sf_dir, "build_record").select("record_id", X.one_line(text).alias("line"))


@query("SELECT record_id, CASE WHEN suffix = '' THEN name ELSE name[:-len(suffix) - 1] END AS stem, CASE WHEN suffix = '' THEN name ELSE name[:-len(suffix) - 1] END || '-' || sha[:12] AS probe_id FROM (SELECT record_id, analysis_artifact_sha256 AS sha, parse_filename(analysis_artifact_path) AS name, coalesce(regexp_extract(parse_filename(analysis_artifact_path), '^\\.*[^.].*?(\\.[^.]+)$', 1), '') AS suffix FROM build_record WHERE analysis_artifact_path IS NOT NULL)")
def probe_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "build_record").where(F.col("analysis_artifact_path").isNotNull())
    return b.select("record_id", X.stem("analysis_artifact_path").alias("stem"), X.probe_id("analysis_artifact_path", "analysis_artifact_sha256").alias("probe_id"))


@query("SELECT incoming_id, strftime(arrived_at, '%Y-%m-%dT%H:%M:%S+00:00') AS arrived FROM incoming_hashes")
def utc_seconds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "incoming_hashes").select("incoming_id", X.utc_text("arrived_at").alias("arrived"))


@query("SELECT library || '.' || record_id AS key, ghidra_version AS value FROM build_record WHERE record_id % 3 = 0 AND library <> '' AND ghidra_version <> '' UNION ALL SELECT '#' || library || '.' || record_id, ghidra_version FROM build_record WHERE record_id % 3 > 0 AND library <> '' AND ghidra_version <> ''")
def properties_with_comments_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The plainer kind of ``key=value`` file, where a leading ``#`` belongs to the key."""
    b = table(spark, sf_dir, "build_record").where("library <> '' and ghidra_version <> ''")
    mark = F.when(F.col("record_id") % 3 == 0, "").otherwise("#")
    path = publish.write_lines(b.select("record_id", F.concat(mark, "library", F.lit("."), F.col("record_id").cast("string"), F.lit("= "), "ghidra_version").alias("value")), f"{fresh_dir(spark, 'plain')}/application.properties", ["record_id"])
    return readers.properties(spark, path, comments=False)


@query("SELECT unnest(['application.build', 'application.release']) AS missing")
def missing_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Required keys that a file lacks or leaves empty, sorted; in comments they do not count."""
    v = table(spark, sf_dir, "build_record").agg(F.max("ghidra_version").alias("v"))
    lines = v.select(F.explode(F.array(F.concat(F.lit("application.version = "), "v"), F.lit("#application.build=1"), F.lit("application.release = "), F.lit(""))).alias("value"))
    path = publish.write_lines(lines, f"{fresh_dir(spark, 'required')}/application.properties")
    missing = readers.required_properties(readers.properties(spark, path), ["application.version", "application.release", "application.build"])
    return spark.createDataFrame([(m,) for m in missing], "missing string")


_TREE = """SELECT b.project, unnest(list_concat(list_filter(string_split(coalesce(evidence, ''), ';'), lambda x: x <> ''), [CASE l WHEN 'C' THEN 'src/a.c' WHEN 'CXX' THEN 'src/b.CXX' WHEN 'ASM' THEN 'src/c.S' ELSE 'README' END])) AS path
FROM (SELECT name AS project, detection_evidence AS evidence, unnest(string_split(coalesce(detected_languages, ''), ';')) AS l FROM (SELECT DISTINCT library AS name, detection_evidence, detected_languages FROM build_record WHERE library IS NOT NULL)) b"""


def _tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """project, path: evidence and a source file for every detected language of a library."""
    b = table(spark, sf_dir, "build_record").where(F.col("library").isNotNull()).select("library", "detection_evidence", "detected_languages").distinct()
    language = F.explode(F.split(F.coalesce("detected_languages", F.lit("")), ";")).alias("l")
    source = F.when(F.col("l") == "C", "src/a.c").when(F.col("l") == "CXX", "src/b.CXX").when(F.col("l") == "ASM", "src/c.S").otherwise("README")
    return b.select(F.col("library").alias("project"), "detection_evidence", language).select("project", F.explode(F.concat(X.unpack("detection_evidence"), F.array(source))).alias("path"))


@query(f"SELECT project, array_to_string(list_sort(list_distinct(list(language))), ';') AS languages FROM ({_TREE}) JOIN (VALUES ('.c', 'C'), ('.cc', 'C++'), ('.cpp', 'C++'), ('.cxx', 'C++'), ('.rs', 'Rust'), ('.go', 'Go')) s(suffix, language) ON lower(regexp_extract(path, '\\.[^./]+$')) = suffix GROUP BY 1")
def extension_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of a tree by the suffixes of its files, in any letter case."""
    return detect.detected_languages(_tree(spark, sf_dir), "project", "path").select("project", X.pack("languages").alias("languages"))


@query(f"""WITH t AS ({_TREE}), r AS (SELECT name AS project, any_value(allowed_build_systems) AS allowed, any_value(preferred_build_system) AS preferred FROM recipe GROUP BY 1 HAVING count(*) = 1),
s AS (SELECT project, list_sort(list_distinct(list(path))) AS top FROM t WHERE NOT contains(path, '/') GROUP BY 1),
d AS (SELECT DISTINCT project, build_system, marker FROM t JOIN (VALUES ('openssl-configure', 'Configure'), ('autoconf', 'configure'), ('cmake', 'CMakeLists.txt'), ('meson', 'meson.build'), ('make', 'Makefile'), ('cargo', 'Cargo.toml'), ('go', 'go.mod')) m(build_system, marker) ON path = marker),
g AS (SELECT project, list_sort(list(build_system)) AS systems, list_sort(list(marker)) AS evidence FROM d GROUP BY 1),
l AS (SELECT project, count(*) AS n FROM t WHERE lower(regexp_extract(path, '\\.[^./]+$')) IN ('.c', '.cc', '.cpp', '.cxx', '.rs', '.go') GROUP BY 1)
SELECT r.project, preferred AS build_system, array_to_string(coalesce(evidence, []), ';') AS evidence, CASE WHEN NOT coalesce(list_contains(top, 'Makefile'), false) AND NOT coalesce(list_contains(top, 'configure'), false) AND NOT coalesce(list_contains(top, 'CMakeLists.txt'), false) THEN 'missing_markers'
WHEN len(list_filter(coalesce(systems, []), lambda x: NOT list_contains(allowed, x))) > 0 THEN 'unexpected_systems' WHEN NOT coalesce(list_contains(systems, preferred), false) THEN 'preferred_not_detected' WHEN coalesce(n, 0) = 0 THEN 'no_language' END AS violation
FROM r LEFT JOIN s USING (project) LEFT JOIN g USING (project) LEFT JOIN l USING (project)""")
def source_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First broken rule of each library's tree: markers, build systems, languages."""
    tree = _tree(spark, sf_dir)
    top = tree.where(F.col("path").isin("Makefile", "configure", "CMakeLists.txt")).groupBy("project").agg(F.array_sort(F.collect_set("path")).alias("seen"))
    r = table(spark, sf_dir, "recipe").groupBy(F.col("name").alias("project")).agg(F.count(F.lit(1)).alias("n"), F.any_value("allowed_build_systems").alias("allowed_build_systems"), F.any_value("preferred_build_system").alias("preferred_build_system")).where("n = 1").drop("n")
    r = r.join(top, "project", "left").withColumn("project_markers", F.coalesce("seen", F.array(F.lit("Makefile")))).drop("seen")
    return detect.detect_projects(tree, r, "project", "path").select("project", "build_system", X.pack("evidence").alias("evidence"), "violation")


_MEMBER = "program || CASE WHEN row_id % 997 = 0 THEN '.txt' ELSE '.o' END"


@query(f"""WITH l AS (SELECT source_sha256 AS archive, {_MEMBER} || row_id % 40 AS member, count(*) AS l, 0 AS o, 0 AS e FROM export_fid_hashes WHERE source_sha256 IS NOT NULL AND program IS NOT NULL GROUP BY 1, 2),
m AS (SELECT archive, replace(replace(member, '.o', '_'), '.txt', '-') || CASE WHEN contains(member, '.txt') THEN '.txt' ELSE '.o' END AS member, l FROM l),
f AS (SELECT archive, member, sum(l)::BIGINT AS l, sum(e)::BIGINT AS e FROM (SELECT archive, member, l, 0 AS e FROM m UNION ALL SELECT archive, member, 0, 1 FROM m WHERE NOT contains(member, '_7.')) GROUP BY 1, 2),
g AS (SELECT archive, bool_or(l > 1) AS dup, bool_or(l > 0 AND NOT ends_with(member, '.o')) AS bad, sum(CASE WHEN ends_with(member, '.o') THEN e ELSE 0 END) AS objects, bool_or(l <> CASE WHEN ends_with(member, '.o') THEN e ELSE 0 END) AS differs FROM f GROUP BY 1)
SELECT archive, CASE WHEN dup THEN 'duplicate_members' WHEN bad THEN 'invalid_members' WHEN objects = 0 THEN 'no_objects' WHEN differs THEN 'not_reconciled' END AS violation FROM g""")
def archive_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First broken rule of each artifact taken as an archive: its members as listed, and those extracted."""
    e = table(spark, sf_dir, "export_fid_hashes").where("source_sha256 is not null and program is not null")
    odd = F.col("row_id") % 997 == 0
    name = F.concat("program", F.when(odd, "-").otherwise("_"), (F.col("row_id") % 40).cast("string"), F.when(odd, ".txt").otherwise(".o"))
    listed = e.select(F.col("source_sha256").alias("archive"), name.alias("member"))
    extracted = listed.where(~F.contains("member", F.lit("_7."))).distinct()
    return reconcile.archive_violations(listed, extracted, "archive", "member")


@query("""SELECT record_id, CASE WHEN status = 'build_failed' OR coalesce(compiler_version, '') = '' THEN 'not_identified' WHEN NOT contains(compiler_version, '7') OR NOT contains(compiler_version, ghidra_compiler_spec) THEN 'missing_markers' END AS violation FROM build_record""")
def tool_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a compiler said what it is, and its text holds a version and the name that is expected."""
    b = table(spark, sf_dir, "build_record")
    markers = F.filter(F.array(F.lit("7"), "ghidra_compiler_spec"), lambda m: m.isNotNull())
    ran = F.when(F.col("status") == "build_failed", 1).otherwise(0)
    return rules.first_violation(b, rules.tool_rules(ran, F.col("compiler_version"), markers)).select("record_id", "violation")


@query("SELECT 'missing_sentinels' AS violation, 'c/none' AS missing")
def checkout_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A project folder of which one expected file is not there."""
    names = table(spark, sf_dir, "treatment").select(F.concat(F.lit("/work/p/t/"), "id").alias("path"), F.lit(False).alias("is_directory"))
    more = spark.createDataFrame([("/work/p", True), ("/work/p/./worker.json", False), ("/work/p/src", True)], "path string, is_directory boolean")
    return rules.checkout_violation(names.unionByName(more), "/work/p/", "/work/p/worker.json", ["src", "t/plain_q2", "c/none"]).select("violation", X.pack("missing").alias("missing"))


@query("""WITH b AS (SELECT *, row_number() OVER (PARTITION BY library, route, treatment ORDER BY record_id) AS k FROM build_record WHERE library IS NOT NULL AND route IS NOT NULL AND treatment IS NOT NULL),
one AS (SELECT library, route, treatment, max(object_count) AS programs FROM b GROUP BY 1, 2, 3 HAVING count(*) = 1)
SELECT record_id, CASE WHEN status = 'built' AND programs IS NOT NULL THEN 'complete' ELSE status END AS status, CASE WHEN status = 'built' AND one.library IS NOT NULL THEN programs ELSE fid_programs END AS fid_programs FROM b LEFT JOIN one USING (library, route, treatment)""")
def complete_by_cell(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records by library, route and treatment; a cell that the report names twice completes nothing."""
    b = table(spark, sf_dir, "build_record").dropna(subset=["library", "route", "treatment"])
    n = F.col("object_count")
    report = b.select("library", "route", "treatment", n.alias("program_count"), n.alias("attempted"), n.alias("added"), F.lit(0).cast("bigint").alias("excluded"))
    done = manifest.complete(b, report, ["library", "route", "treatment"])
    return done.select("record_id", "status", "fid_programs")


_BLANK = ", ".join(f"CASE WHEN hit THEN {'0' if c in ('object_count', 'fidb_bytes', 'fid_programs', 'fid_attempted', 'fid_added', 'fid_excluded') else chr(39) * 2} ELSE {c} END AS {c}" for c in manifest.BUILT)


@query(f"SELECT record_id, library, compiler_command, CASE WHEN hit THEN 'build_failed' ELSE status END AS status, CASE WHEN hit THEN 'odd record' ELSE error END AS error, {_BLANK} FROM (SELECT *, record_id % 2 = 1 AND coalesce(status IN ('requested', 'built'), false) AS hit FROM build_record)")
def failed_builds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failed builds are made anew from what was known before: everything found out in the build is blank."""
    b = table(spark, sf_dir, "build_record")
    return manifest.fail_builds(b, F.col("record_id") % 2 == 1, F.lit("odd record")).select("record_id", "library", "compiler_command", "status", "error", *manifest.BUILT)


@query("""WITH l AS (SELECT name, version, (row_number() OVER (ORDER BY name, version) - 1)::INTEGER AS pos FROM recipe), b AS (SELECT library, max(version) AS version, max(fid_programs) AS programs, max(fid_attempted) AS attempted, max(fid_added) AS added, max(fid_excluded) AS excluded FROM build_record WHERE library IS NOT NULL GROUP BY 1),
k AS (SELECT * FROM (SELECT name, count(*) AS n FROM l GROUP BY 1) FULL JOIN (SELECT library AS name, 1 AS m FROM b) USING (name))
SELECT pos, name, CASE WHEN EXISTS (SELECT 1 FROM k WHERE n IS DISTINCT FROM m) THEN 'names' END AS violation FROM l""")
def population_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report that names libraries other than those asked for, or one of them not as often, is wrong as a whole."""
    return _report(spark, sf_dir, table(spark, sf_dir, "recipe"))


_REPORT = """WITH b AS (SELECT library AS name, max(version) AS version, max(fid_programs) AS programs, max(fid_attempted) AS attempted, max(fid_added) AS added, max(fid_excluded) AS excluded FROM build_record WHERE library IS NOT NULL GROUP BY 1)
SELECT (row_number() OVER (ORDER BY name) - 1)::INTEGER AS pos, name, CASE WHEN starts_with(version, '2.') THEN 'wrong_version' WHEN NOT coalesce(programs >= 0 AND attempted >= 0 AND added >= 0 AND excluded >= 0, false) THEN 'invalid_counts' WHEN programs = 0 OR attempted = 0 THEN 'empty'
WHEN length(name) = 6 THEN 'no_expected_count' WHEN length(name) = 7 THEN 'program_count' WHEN attempted <> added + excluded THEN 'not_reconciled' WHEN added = 0 THEN 'none_added' WHEN version IS NULL THEN 'wrong_version' END AS violation FROM b"""


def _report(spark: SparkSession, sf_dir: str, libraries: DataFrame) -> DataFrame:
    per = table(spark, sf_dir, "build_record").where(F.col("library").isNotNull()).groupBy("library").agg(F.max("version").alias("version"), F.max("fid_programs").alias("program_count"), F.max("fid_attempted").alias("attempted"), F.max("fid_added").alias("added"), F.max("fid_excluded").alias("excluded"))
    populations = per.select("library", "version", F.lit("g").alias("variant"), F.concat(F.lit("/out/./"), "library", F.lit("-g.fidb")).alias("fidb_path"), "program_count", "attempted", "added", "excluded")
    sized = F.length("name")
    wanted = libraries.join(per.select(F.col("library").alias("name"), "program_count"), "name", "left").select("name", "version", F.col("name").alias("identifier"), F.when(sized == 6, F.lit(None)).when(sized == 7, F.col("program_count") + 1).otherwise(F.col("program_count")).cast("bigint").alias("expected_programs"))
    ordered = wanted.agg(F.array_sort(F.collect_list(F.struct("name", "version", "identifier", "expected_programs"))).alias("a")).select(F.posexplode("a").alias("pos", "l")).select("pos", "l.*")
    files = populations.select(F.concat(F.lit("/out/"), "library", F.lit("-g.fidb")).alias("path"), F.lit(1).alias("bytes"))
    return rules.population_violations(populations, ordered, files, "g", "/out/")


@query(_REPORT)
def population_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first broken rule of each library of a report: identity, path, counts, file."""
    names = table(spark, sf_dir, "build_record").where(F.col("library").isNotNull()).groupBy(F.col("library").alias("name")).agg(F.max("version").alias("version"))
    return _report(spark, sf_dir, names.withColumn("version", F.when(F.col("version").startswith("2."), "other").otherwise(F.col("version"))))


@query("SELECT NULL::VARCHAR AS violation UNION ALL SELECT 'repeated_labels' UNION ALL SELECT 'too_few_cases'")
def probe_case_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Treatments as labels of a run, the same labels twice, and one label alone."""
    labels = table(spark, sf_dir, "treatment").select(F.col("id").alias("label"))
    sets = [labels, labels.unionByName(labels), labels.where("label = 'plain_q2'")]
    out = [rules.case_set_violation(s) for s in sets]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query("""SELECT id AS name, CASE WHEN id = 'plain_q2' THEN 'symbolic_link' WHEN id = 'plain_q3' THEN 'not_a_directory' WHEN factor = 'level' THEN 'outside_project' WHEN phase = 'link' THEN 'unexpected_path' ELSE NULL END AS violation FROM treatment""")
def generated_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roots of a run (a handful): links, files, paths outside the project or elsewhere than expected."""
    t = table(spark, sf_dir, "treatment")
    own = F.concat(F.lit("/p/out/./"), "id", F.lit("/"))
    roots = t.select(
        F.col("id").alias("name"),
        F.when(F.col("factor") == "level", F.concat(F.lit("/p/../out/"), "id")).when(F.col("phase") == "link", F.concat(F.lit("/p/else/"), "id")).otherwise(own).alias("path"),
        (F.col("id") == "plain_q2").alias("is_symlink"),
        (F.col("id") != "plain_q3").alias("is_directory"),
        F.concat(F.lit("/p/out/"), "id").alias("expected"),
    )
    return rules.directory_violations(roots, "/p").select("name", "violation")


@query("""WITH a AS (SELECT program AS path, max(full_hash) AS before FROM export_fid_hashes WHERE program IS NOT NULL GROUP BY 1), b AS (SELECT program AS path, max(full_hash) AS after FROM export_fid_hashes_copy WHERE program IS NOT NULL GROUP BY 1)
SELECT path, before, after FROM a FULL JOIN b USING (path) WHERE before IS DISTINCT FROM after""")
def unstable_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths whose digest is not the same in two listings, or that one of them lacks."""
    seen = lambda name: table(spark, sf_dir, name).where(F.col("program").isNotNull()).groupBy(F.col("program").alias("path")).agg(F.max("full_hash").alias("sha256"))
    return rules.changed_inputs(seen("export_fid_hashes"), seen("export_fid_hashes_copy"))


@query("SELECT record_id, (code = 429 OR code BETWEEN 500 AND 599) AND attempt < 2 AS again FROM (SELECT record_id, (400 + record_id % 250)::INTEGER AS code, (record_id % 4)::INTEGER AS attempt FROM build_record)")
def fetch_retries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a failed fetch is tried again, by its code and attempt."""
    b = table(spark, sf_dir, "build_record")
    return b.select("record_id", rules.http_retry(F.lit(400) + F.col("record_id") % 250, F.col("record_id") % 4).alias("again"))


@query("SELECT record_id, library, status FROM build_record WHERE record_id = 17")
def one_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A lookup that has to give exactly one row."""
    b = table(spark, sf_dir, "build_record").where("record_id = 17").select("record_id", "library", "status")
    return manifest.single_row(b)


QUERIES = Q
