"""Registered queries of the catalogue, planning, queue, reconciliation, matrix and manifest operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigloom.functions import text as X
from sigloom.functions.hexes import address_text, hash_text, trimmed, unsigned_hex
from sigloom.operators import detect, manifest, matrix, planning, reconcile, requests, rules
from sigloom.plans.problems import empty_is_null, sql_address, sql_hash
from sigloom.plans.session import fresh_dir, table
from sigloom.sources import publish, readers
from sigloom.streaming.queue import current_queue, merge_stream

Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def matrix_sql(source: str) -> str:
    """``source`` gives columns c, e, f, s, o."""
    return f"""
WITH r AS ({source}), d AS (SELECT c, e, arg_max({{'f': f, 's': s}}, o) AS x FROM r GROUP BY 1, 2),
g AS (SELECT c, count(*) AS n FROM d GROUP BY 1),
p AS (SELECT a.c AS i, b.c AS j, count(*) AS sh, count(*) FILTER (a.x.f IS NOT DISTINCT FROM b.x.f) AS fe, count(*) FILTER (a.x.s IS NOT DISTINCT FROM b.x.s) AS se,
count(*) FILTER (a.x.f IS NOT DISTINCT FROM b.x.f AND a.x.s IS NOT DISTINCT FROM b.x.s) AS de FROM d a JOIN d b USING (e) GROUP BY 1, 2)
SELECT a.c AS reference_case, b.c AS comparison_case, a.n AS reference_hashable, b.n AS comparison_hashable, coalesce(sh, 0) AS shared_entrypoints, coalesce(fe, 0) AS full_hash_equal,
coalesce(se, 0) AS specific_hash_equal, coalesce(de, 0) AS dual_hash_equal, printf('%.6f', 100.0::DOUBLE * coalesce(de, 0) / a.n) AS reference_retained_pct, printf('%.6f', 100.0::DOUBLE * coalesce(de, 0) / b.n) AS comparison_retained_pct
FROM g a CROSS JOIN g b LEFT JOIN p ON p.i = a.c AND p.j = b.c"""


LINE_ORDER = ["l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice", "l_quantity", "l_linestatus"]


@query(matrix_sql("SELECT l_returnflag AS c, l_partkey::VARCHAR AS e, l_linestatus AS f, l_quantity AS s, (l_orderkey, l_linenumber, l_suppkey, l_extendedprice, l_quantity, l_linestatus) AS o FROM lineitem"))
def compat_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matrix.compat_matrix(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_partkey", "l_linestatus", "l_quantity", LINE_ORDER)


def exported(spark: SparkSession, sf_dir: str, name: str = "export_fid_hashes") -> DataFrame:
    return table(spark, sf_dir, name).select("row_id", trimmed("case").alias("case_label"), address_text("entry_point").alias("entry_point"), "language_id", "compiler_spec", "program", empty_is_null("function_name").alias("function_name"), hash_text("full_hash").alias("full_hash"), hash_text("specific_hash").alias("specific_hash"))


_EXPORTED = f"""SELECT row_id, trim("case", ' \t\n\r') AS case_label, {sql_address('entry_point')} AS entry_point, language_id, compiler_spec, program, nullif(function_name, '') AS function_name, {sql_hash('full_hash')} AS full_hash, {sql_hash('specific_hash')} AS specific_hash FROM """


@query(matrix_sql(f"SELECT language_id AS c, entry_point AS e, full_hash AS f, specific_hash AS s, row_id AS o FROM ({_EXPORTED} export_fid_hashes)"))
def language_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The matrix with languages as cases, over all exported functions."""
    return matrix.compat_matrix(exported(spark, sf_dir), "language_id", "entry_point", "full_hash", "specific_hash", ["row_id"])


@query("SELECT reference_case, max(CASE WHEN comparison_case = 'A' THEN p END) AS \"A\", max(CASE WHEN comparison_case = 'N' THEN p END) AS \"N\", max(CASE WHEN comparison_case = 'R' THEN p END) AS \"R\" FROM (SELECT reference_case, comparison_case, reference_retained_pct AS p FROM (" + SQL["compat_matrix"] + ")) GROUP BY 1")
def matrix_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matrix.pivot_matrix(compat_matrix(spark, sf_dir), ["A", "N", "R"])


@query(f"SELECT case_label, sum(n)::BIGINT AS raw_rows, count(*) AS hashable FROM (SELECT case_label, entry_point, count(*) AS n FROM ({_EXPORTED} export_fid_hashes) GROUP BY 1, 2) GROUP BY 1")
def case_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matrix.case_counts(exported(spark, sf_dir), "case_label", "entry_point")


@query(f"SELECT case_label, entry_point, max(row_id) AS row_id, arg_max({{'x': function_name}}, row_id).x AS function_name, arg_max({{'x': full_hash}}, row_id).x AS full_hash FROM ({_EXPORTED} export_fid_hashes) GROUP BY 1, 2")
def last_wins_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = exported(spark, sf_dir).select("case_label", "entry_point", "row_id", "function_name", "full_hash")
    return matrix.last_rows(rows, ["case_label", "entry_point"], ["row_id"])


_CASES = "qcc", "default"
_TWO = tuple(f"'{c}'" for c in _CASES)


@query(f"WITH x AS ({_EXPORTED} export_fid_hashes) SELECT full_hash FROM x WHERE compiler_spec = {_TWO[0]} INTERSECT SELECT full_hash FROM x WHERE compiler_spec = {_TWO[1]}")
def shared_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hashes that functions of two compilers have in common (null is a value of a set)."""
    return matrix.shared_entries(exported(spark, sf_dir), "compiler_spec", "full_hash", *_CASES)


@query(f"SELECT entry_point FROM ({_EXPORTED} export_fid_hashes) INTERSECT SELECT entry_point FROM ({_EXPORTED} export_fid_hashes_copy)")
def shared_entrypoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entry points that both copies have."""
    both = exported(spark, sf_dir).withColumn("copy", F.lit("main")).unionByName(exported(spark, sf_dir, "export_fid_hashes_copy").withColumn("copy", F.lit("copy")))
    return matrix.shared_entries(both, "copy", "entry_point", "main", "copy")


@query(f"WITH x AS ({_EXPORTED} export_fid_hashes) SELECT DISTINCT entry_point FROM x WHERE language_id = 'Orba:LE:64:default' AND entry_point NOT IN (SELECT entry_point FROM x WHERE language_id = 'Orba:LE:32:default')")
def missing_entrypoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matrix.missing_entries(exported(spark, sf_dir), "language_id", "entry_point", "Orba:LE:64:default", "Orba:LE:32:default")


@query(f"WITH u AS ({_EXPORTED} export_fid_hashes UNION ALL {_EXPORTED} export_fid_hashes_copy) SELECT case_label, count(*) AS n_rows, count(full_hash) AS n_hashed FROM u GROUP BY 1")
def functions_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = exported(spark, sf_dir).unionByName(exported(spark, sf_dir, "export_fid_hashes_copy"))
    return both.groupBy("case_label").agg(F.count(F.lit(1)).alias("n_rows"), F.count("full_hash").alias("n_hashed"))


@query(f"SELECT row_id, full_hash FROM ({_EXPORTED} export_fid_hashes) WHERE full_hash IS NOT NULL")
def hashed_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Functions without a hash are left out, as the exporter does."""
    return exported(spark, sf_dir).where(F.col("full_hash").isNotNull()).select("row_id", "full_hash")


@query("SELECT row_id, printf('%016x', row_id) AS hex, printf('%016x', -row_id) AS negated_hex FROM export_fid_hashes")
def unsigned_hex_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "export_fid_hashes").select("row_id", unsigned_hex("row_id").alias("hex"), unsigned_hex(-F.col("row_id")).alias("negated_hex"))


def _routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "build_record").where(F.col("route") != "").select("route").distinct()


_CELLS = """WITH c AS (SELECT name || '-' || version AS identifier, r.route, t.id AS treatment,
CASE WHEN coalesce(len(t.supported_routes), 0) = 0 OR list_contains(t.supported_routes, r.route) THEN 'runnable' ELSE 'unsupported' END AS plan_status
FROM recipe CROSS JOIN (SELECT DISTINCT route FROM build_record WHERE route <> '') r CROSS JOIN treatment t)"""


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    libraries = table(spark, sf_dir, "recipe").select(X.identifier("name", "version").alias("identifier"))
    return planning.plan_cells(libraries, _routes(spark, sf_dir), table(spark, sf_dir, "treatment"))


@query(_CELLS + "SELECT * FROM c")
def plan_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cells(spark, sf_dir)


@query(_CELLS + "SELECT printf('Plan: %d libraries; %d routes; %d treatments; %d cells (%d runnable)', count(DISTINCT identifier), count(DISTINCT route), count(DISTINCT treatment), count(*), count(*) FILTER (plan_status = 'runnable')) AS line FROM c")
def plan_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planning.plan_summary(cells(spark, sf_dir))


@query(_CELLS + "SELECT '- ' || identifier || ' | ' || route || ' | ' || treatment || ' | ' || plan_status AS line FROM c")
def plan_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planning.plan_lines(cells(spark, sf_dir))


_KEYS = "WITH k AS (SELECT unnest([name, name || '-' || version, name || '@' || version]) AS request_key, name, version FROM recipe)"


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "request_queue").select("request_seq", X.normalise_request("library_request").alias("request"))


_REQ = "SELECT request_seq, lower(trim(library_request, ' \t\n\r')) AS request FROM request_queue"


@query(_KEYS + f"SELECT request_seq, request, name, version FROM ({_REQ}) JOIN k ON request = request_key")
def resolve_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planning.resolve_requests(_requests(spark, sf_dir), "request", table(spark, sf_dir, "recipe")).select("request_seq", "request", "name", "version")


@query(_KEYS + f"SELECT request_seq, request FROM ({_REQ}) WHERE request IS NULL OR request NOT IN (SELECT request_key FROM k)")
def missing_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planning.missing_requests(_requests(spark, sf_dir), "request", table(spark, sf_dir, "recipe"))


@query(_KEYS + "SELECT request_key, count(*) AS n_recipes FROM k GROUP BY 1 HAVING count(*) > 1")
def ambiguous_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planning.ambiguous_keys(table(spark, sf_dir, "recipe"))


@query(_KEYS + f"SELECT name, version, count(*) AS n_requests FROM ({_REQ}) JOIN k ON request = request_key GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_resolutions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planning.duplicate_resolutions(planning.resolve_requests(_requests(spark, sf_dir), "request", table(spark, sf_dir, "recipe")))


WANTED = ["small_qs", "plain_q2", "no_such", "small_qs", "linkwide_q2"]
_WANTED = "(VALUES " + ", ".join(f"({i}, '{w}')" for i, w in enumerate(WANTED)) + ") w(pos, id)"


@query(f"SELECT w.pos::INTEGER AS pos, id, factor, phase FROM {_WANTED} JOIN treatment USING (id)")
def select_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planning.select_in_order(table(spark, sf_dir, "treatment"), "id", WANTED).select("pos", "id", "factor", "phase")


@query(f"SELECT DISTINCT id FROM {_WANTED} WHERE id NOT IN (SELECT id FROM treatment)")
def unknown_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planning.unknown_ids(table(spark, sf_dir, "treatment"), "id", WANTED)


_JOINED = "build_record b JOIN treatment t ON t.id = lower(trim(b.treatment, ' \t\n\r'))"


def _recorded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records with their treatment's row (a catalogue of six rows that does not grow)."""
    t = table(spark, sf_dir, "treatment").select("id", "factor", "remove_flags", "append_flags", "supported_routes", "phase")
    return table(spark, sf_dir, "build_record").withColumn("id", F.lower(trimmed("treatment"))).join(t, "id")


@query(f"SELECT record_id, array_to_string(list_concat(list_filter(string_split(compiler_flags, ' '), lambda f: NOT list_contains(coalesce(remove_flags, []::VARCHAR[]), f)), coalesce(append_flags, []::VARCHAR[])), ' ') AS flags FROM {_JOINED} WHERE compiler_flags IS NOT NULL")
def flags_for(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _recorded(spark, sf_dir).where(F.col("compiler_flags").isNotNull())
    return rows.select("record_id", X.pack(planning.flags_for(F.split("compiler_flags", " "), F.col("remove_flags"), F.col("append_flags")), " ").alias("flags"))


@query(f"SELECT record_id, coalesce(len(supported_routes), 0) = 0 OR coalesce(list_contains(supported_routes, route), false) AS applies FROM {_JOINED}")
def applies_to(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _recorded(spark, sf_dir).select("record_id", planning.applies_to(F.col("supported_routes"), F.col("route")).alias("applies"))


@query("""SELECT record_id, CASE detected_build_system WHEN 'autoconf' THEN 'sh configure --static' || chr(10) || 'make -j4 lib' || library || '.a AR=' || archiver_command || ' ARFLAGS=rc RANLIB=' || ranlib_command
WHEN 'make' THEN 'make -j4 lib' || library || '.a CC=' || compiler_command || ' CFLAGS=-Wall -Winline -D_FILE_OFFSET_BITS=64 ' || compiler_flags || ' AR=' || archiver_command || ' RANLIB=' || ranlib_command END AS commands
FROM build_record WHERE library IS NOT NULL AND compiler_command IS NOT NULL AND compiler_flags IS NOT NULL AND archiver_command IS NOT NULL AND ranlib_command IS NOT NULL""")
def build_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "build_record").dropna(subset=["library", "compiler_command", "compiler_flags", "archiver_command", "ranlib_command"])
    steps = planning.build_steps(F.col("detected_build_system"), 4, F.col("compiler_command"), F.col("archiver_command"), F.col("ranlib_command"), F.col("compiler_flags"), F.concat(F.lit("lib"), "library", F.lit(".a")))
    return b.select("record_id", X.pack(steps, "\n").alias("commands"))


@query("""SELECT record_id, CASE WHEN target_os = 'nixish' THEN coalesce(compiler_command, '') || ' ' || coalesce(compiler_flags, '') || ' -shared -nostdlib -Wl,--whole-archive ' || coalesce(static_archive_path, '') || ' -Wl,--no-whole-archive' || CASE WHEN sensitivity_factor = 'linker_transformation' THEN ' -Wl,--gc-sections' ELSE '' END || ' -o out.so' END AS linker,
CASE WHEN detected_build_system = 'autoconf' THEN 'AR=' || coalesce(archiver_command, '') || chr(10) || 'CC=' || coalesce(compiler_command, '') || chr(10) || 'CFLAGS=' || coalesce(compiler_flags, '') || chr(10) || 'RANLIB=' || coalesce(ranlib_command, '') ELSE '' END AS environment FROM build_record""")
def build_environment(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "build_record")
    env = planning.build_environment(F.col("detected_build_system"), F.coalesce("compiler_command", F.lit("")), F.coalesce("archiver_command", F.lit("")), F.coalesce("ranlib_command", F.lit("")), F.coalesce("compiler_flags", F.lit("")))
    word = lambda c: F.array(F.coalesce(c, F.lit("")))
    link = planning.link_command(F.when(F.col("target_os") == "nixish", "linux"), word("compiler_command"), word("compiler_flags"), word("static_archive_path"), F.col("sensitivity_factor"), F.lit("out.so"))
    return b.select("record_id", X.pack(link, " ").alias("linker"), _listed(env).alias("environment"))


def _listed(env):
    """A map as sorted NAME=VALUE lines."""
    return X.pack(F.array_sort(F.transform(F.map_entries(env), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), "\n")


_ALLOWED, _FIXED = ["PATH", "HOME", "CC"], {"LC_ALL": "C", "HOME": "/work"}


@query("""SELECT record_id, CASE WHEN ranlib_command IS NULL THEN '' ELSE 'CC=' || coalesce(compiler_command, '') || chr(10) END || 'HOME=/work' || chr(10) || 'LC_ALL=' || CASE WHEN ranlib_command IS NULL THEN 'extra' ELSE 'C' END || CASE WHEN ranlib_command IS NULL THEN '' ELSE chr(10) || 'PATH=' || coalesce(compiler_path, '') END AS environment FROM build_record""")
def environment_allow_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Allowed names, then fixed values, then extra ones; later ones win."""
    b = table(spark, sf_dir, "build_record")
    none = F.create_map().cast("map<string,string>")
    env = F.create_map(F.lit("PATH"), F.coalesce("compiler_path", F.lit("")), F.lit("HOME"), F.lit("/root"), F.lit("CC"), F.coalesce("compiler_command", F.lit("")), F.lit("SECRET"), F.col("source_sha256"))
    there = F.col("ranlib_command").isNotNull()
    env, extra = F.when(there, env).otherwise(none), F.when(there, none).otherwise(F.create_map(F.lit("LC_ALL"), F.lit("extra")))
    return b.select("record_id", _listed(planning.allowed_environment(env, _ALLOWED, _FIXED, extra)).alias("environment"))


_FOLD = """
WITH r AS (SELECT request_seq AS seq, trim(library_request, ' \t\n\r') AS library, regexp_replace(lower(trim(library_request, ' \t\n\r')), '[ \t\n\r]+', ' ', 'g') AS request_key, try_cast(trim(priority) AS INTEGER) AS priority,
list_filter(string_split(coalesce(requested_routes, ''), ';'), lambda x: x <> '') AS routes, last_requested_utc AS said FROM request_queue),
f AS (SELECT request_key, arg_min({'x': library}, seq).x AS library_request, min(priority) AS priority, 'pending' AS status, 'source_discovery' AS resolution_lane,
array_to_string(list_sort(list_distinct(flatten(list(routes)))), ';') AS requested_routes, arg_min({'x': said}, seq).x AS first_requested_utc, arg_max({'x': said}, seq).x AS last_requested_utc,
count(*) AS request_count, '' AS candidate_version, '' AS candidate_source_url, '' AS candidate_sha256, '' AS notes, min(seq) AS first_seq FROM r WHERE request_key <> '' AND seq > CUT GROUP BY 1)
"""


def fold(df: DataFrame) -> DataFrame:
    return requests.fold_requests(df, "request_seq", "library_request", "priority", "requested_routes", "last_requested_utc")


@query(_FOLD.replace("CUT", "0") + "SELECT * FROM f")
def queue_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fold(table(spark, sf_dir, "request_queue"))


_OLD = """, o AS (SELECT *, regexp_replace(lower(trim(library_request, ' \t\n\r')), '[ \t\n\r]+', ' ', 'g') AS request_key, row_number() OVER (PARTITION BY regexp_replace(lower(trim(library_request, ' \t\n\r')), '[ \t\n\r]+', ' ', 'g') ORDER BY request_seq DESC) AS k FROM request_queue WHERE request_seq <= 100)
SELECT o.request_key, o.library_request, CASE WHEN h THEN least(try_cast(trim(o.priority) AS INTEGER), f.priority)::VARCHAR ELSE o.priority END AS priority, o.status, o.resolution_lane,
CASE WHEN h THEN array_to_string(list_sort(list_distinct(list_filter(string_split(coalesce(o.requested_routes, ''), ';') || string_split(f.requested_routes, ';'), lambda x: x <> ''))), ';') ELSE o.requested_routes END AS requested_routes,
o.first_requested_utc, CASE WHEN h THEN f.last_requested_utc ELSE o.last_requested_utc END AS last_requested_utc, CASE WHEN h THEN (coalesce(try_cast(trim(o.request_count) AS BIGINT), 0) + f.request_count)::VARCHAR ELSE o.request_count END AS request_count,
o.candidate_version, o.candidate_source_url, o.candidate_sha256, o.notes, o.request_seq AS place, NULL::BIGINT AS first_seq FROM (SELECT *, k = 1 AND request_key IN (SELECT request_key FROM f) AS h FROM o) o LEFT JOIN f ON o.h AND f.request_key = o.request_key
UNION ALL SELECT f.request_key, f.library_request, f.priority::VARCHAR, f.status, f.resolution_lane, f.requested_routes, f.first_requested_utc, f.last_requested_utc, f.request_count::VARCHAR, '', '', '', '', NULL, f.first_seq FROM f WHERE f.request_key NOT IN (SELECT request_key FROM o WHERE request_key IS NOT NULL)"""


@query(_FOLD.replace("CUT", "100") + _OLD)
def queue_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first hundred rows are the existing queue, the others arrive."""
    q = table(spark, sf_dir, "request_queue")
    return requests.upsert_requests(q.where("request_seq <= 100"), "request_seq", fold(q.where("request_seq > 100")))


@query("SELECT request_seq, regexp_replace(lower(trim(library_request, ' \t\n\r')), '[ \t\n\r]+', ' ', 'g') AS request FROM request_queue")
def normalise_request(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _requests(spark, sf_dir)


@query("""SELECT request_seq, CASE WHEN library_request IS NULL OR library_request = '' OR library_request <> trim(library_request, ' \t\n\r') THEN 'outer_whitespace_or_empty' WHEN library_request[1] IN ('=', '+', '-', '@') THEN 'formula_marker'
WHEN regexp_matches(library_request, '[\\x00-\\x1f\\x7f]') THEN 'control_character' END AS violation FROM request_queue""")
def token_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "request_queue").select("request_seq", X.token_violation("library_request").alias("violation"))


@query("SELECT request_seq, CASE WHEN coalesce(trim(library_request, ' \t\n\r') <> '', false) = false THEN 'empty_name' WHEN coalesce(trim(priority, ' \t\n\r') IN ('0', '1', '2'), false) = false THEN 'priority' END AS violation FROM request_queue")
def queue_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.first_violation(table(spark, sf_dir, "request_queue"), rules.queue_rules()).select("request_seq", "violation")


_L, _R = (f"SELECT case_label, function_name FROM ({_EXPORTED} {t})" for t in ("export_fid_hashes", "export_fid_hashes_copy"))


@query(f"SELECT case_label, function_name, sum(l)::BIGINT AS n_left, sum(r)::BIGINT AS n_right FROM (SELECT *, 1 AS l, 0 AS r FROM ({_L}) UNION ALL SELECT *, 0, 1 FROM ({_R})) GROUP BY 1, 2 HAVING sum(l) <> sum(r)")
def multiset_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Function names per case: how often each copy lists them, where that differs."""
    return reconcile.multiset_difference(exported(spark, sf_dir), exported(spark, sf_dir, "export_fid_hashes_copy"), ["case_label", "function_name"])


@query(f"SELECT case_label, entry_point, count(*) AS n FROM ({_EXPORTED} export_fid_hashes) GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconcile.repeated(exported(spark, sf_dir), ["case_label", "entry_point"])


@query("SELECT a.source_sha256, count(b.record_id) AS n_matches, count(b.record_id) = 1 AS exactly_one FROM (SELECT DISTINCT source_sha256 FROM export_fid_hashes) a LEFT JOIN build_record b ON b.analysis_artifact_sha256 = a.source_sha256 GROUP BY 1")
def exactly_one_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exported artifacts and how many manifest records each has."""
    artifacts = table(spark, sf_dir, "export_fid_hashes").select("source_sha256").distinct()
    return reconcile.match_counts(artifacts, table(spark, sf_dir, "build_record").select(F.col("analysis_artifact_sha256").alias("source_sha256")), "source_sha256")


def _populated(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "build_record")
    return b.withColumnsRenamed({"fid_programs": "program_count", "fid_attempted": "attempted", "fid_added": "added", "fid_excluded": "excluded"})


_POPULATION = """CASE WHEN NOT coalesce(fid_programs >= 0 AND fid_attempted >= 0 AND fid_added >= 0 AND fid_excluded >= 0, false) THEN 'invalid_counts' WHEN fid_programs = 0 OR fid_attempted = 0 THEN 'empty'
WHEN object_count IS NULL THEN 'no_expected_count' WHEN fid_programs <> object_count THEN 'program_count' WHEN fid_attempted <> fid_added + fid_excluded THEN 'not_reconciled' WHEN fid_added = 0 THEN 'none_added' END"""


@query(f"SELECT record_id, {_POPULATION} AS violation FROM build_record")
def first_violation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.first_violation(_populated(spark, sf_dir), rules.population_rules(F.col("object_count"))).select("record_id", "violation")


_SAFE = "regexp_full_match({}, '[A-Za-z0-9][A-Za-z0-9._+-]*')"


@query(f"""SELECT name, version, CASE WHEN NOT coalesce(schema_version = 'fidb-recipe/v2', false) THEN 'schema_version' WHEN name IS NULL THEN 'missing_name' WHEN version IS NULL THEN 'missing_version' WHEN url IS NULL THEN 'missing_url' WHEN sha256 IS NULL THEN 'missing_sha256'
WHEN source_directory IS NULL THEN 'missing_source_directory' WHEN project_markers IS NULL THEN 'missing_project_markers' WHEN allowed_build_systems IS NULL THEN 'missing_allowed_build_systems' WHEN preferred_build_system IS NULL THEN 'missing_preferred_build_system' WHEN static_archives IS NULL THEN 'missing_static_archives'
WHEN NOT {_SAFE.format('name')} THEN 'unsafe_name' WHEN NOT {_SAFE.format('version')} THEN 'unsafe_version' WHEN NOT {_SAFE.format('source_directory')} THEN 'unsafe_source_directory' WHEN len(list_filter(static_archives, lambda x: NOT {_SAFE.format('x')})) > 0 THEN 'unsafe_static_archive'
WHEN length(sha256) <> 64 THEN 'sha256_length' WHEN len(project_markers) = 0 OR len(static_archives) = 0 THEN 'incomplete_detection' WHEN NOT list_contains(allowed_build_systems, preferred_build_system) THEN 'preferred_not_allowed' END AS violation FROM recipe""")
def recipe_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.first_violation(table(spark, sf_dir, "recipe"), rules.recipe_rules()).select("name", "version", "violation")


@query("SELECT name, version, name || '-' || version AS identifier, lower(sha256) AS sha256, array_to_string(project_markers, ';') AS markers FROM recipe")
def recipe_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "recipe").select("name", "version", X.identifier("name", "version").alias("identifier"), F.lower("sha256").alias("sha256"), X.pack("project_markers").alias("markers"))


@query(f"SELECT row_id, coalesce({_SAFE.format('function_name')}, false) AS safe FROM export_fid_hashes")
def safe_component(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "export_fid_hashes").select("row_id", X.safe_component("function_name").alias("safe"))


@query("SELECT record_id, coalesce(analysis_artifact_path <> '' AND NOT starts_with(analysis_artifact_path, '/') AND NOT list_contains(string_split(analysis_artifact_path, '/'), '..'), false) AS safe FROM build_record")
def member_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "build_record").select("record_id", X.safe_member_path("analysis_artifact_path").alias("safe"))


@query("""SELECT record_id, parse_filename(analysis_artifact_path) AS name, coalesce(regexp_extract(parse_filename(analysis_artifact_path), '^\\.*[^.].*?(\\.[^.]+)$', 1), '') AS suffix FROM build_record WHERE analysis_artifact_path IS NOT NULL""")
def suffix_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "build_record").where(F.col("analysis_artifact_path").isNotNull())
    return b.select("record_id", X.basename("analysis_artifact_path").alias("name"), X.suffix("analysis_artifact_path").alias("suffix"))


@query("""SELECT DISTINCT record_id, m.build_system, e AS evidence FROM (SELECT record_id, unnest(string_split(detection_evidence, ';')) AS e FROM build_record)
JOIN (VALUES ('openssl-configure', 'Configure'), ('autoconf', 'configure'), ('cmake', 'CMakeLists.txt'), ('meson', 'meson.build'), ('make', 'Makefile'), ('cargo', 'Cargo.toml'), ('go', 'go.mod')) m(build_system, marker) ON e = m.marker""")
def detect_systems(spark: SparkSession, sf_dir: str) -> DataFrame:
    listing = table(spark, sf_dir, "build_record").select("record_id", F.explode(X.unpack("detection_evidence")).alias("path"))
    return detect.detected_systems(listing, "record_id", "path")


@query("SELECT language, count(*) AS n FROM (SELECT unnest(list_filter(string_split(detected_languages, ';'), lambda x: x <> '')) AS language FROM build_record) GROUP BY 1")
def unpack_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "build_record").select(F.explode(X.unpack("detected_languages")).alias("language")).groupBy("language").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT record_id, array_to_string(list_filter(string_split(regexp_extract(compiler_command, '[^/]*$'), ' ') || ['7'], lambda m: NOT contains(compiler_version, m)), ';') AS missing FROM build_record WHERE compiler_version IS NOT NULL AND compiler_command IS NOT NULL")
def marker_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markers (words of the compiler's name, a major version) that the version text lacks."""
    b = table(spark, sf_dir, "build_record").dropna(subset=["compiler_version", "compiler_command"])
    markers = F.concat(F.split(F.regexp_extract("compiler_command", r"[^/]*\z", 0), " "), F.array(F.lit("7")))
    return b.select("record_id", X.pack(X.missing_markers(markers, "compiler_version")).alias("missing"))


@query("SELECT record_id, try_cast(CASE WHEN string_split(v, '.')[1] = '1' THEN string_split(v, '.')[2] ELSE string_split(v, '.')[1] END AS INTEGER) AS major, try_cast(CASE WHEN string_split(v, '.')[1] = '1' THEN string_split(v, '.')[2] ELSE string_split(v, '.')[1] END AS INTEGER) >= 21 AS supported FROM (SELECT record_id, regexp_extract(java_version, '(\\d+(?:\\.\\d+)*)', 1) AS v FROM build_record)")
def java_major(spark: SparkSession, sf_dir: str) -> DataFrame:
    major = X.dotted_major("java_version")
    return table(spark, sf_dir, "build_record").select("record_id", major.alias("major"), (major >= 21).alias("supported"))


@query("SELECT status, count(*) AS n FROM build_record GROUP BY 1")
def status_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.status_rollup(table(spark, sf_dir, "build_record"))


@query("SELECT string_agg(status || '=' || n, ', ' ORDER BY status) AS line FROM (SELECT status, count(*) AS n FROM build_record GROUP BY 1)")
def rollup_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.rollup_text(table(spark, sf_dir, "build_record"))


@query("SELECT record_id, CASE WHEN status = 'built' THEN 'compiled' ELSE status END AS shown FROM build_record WHERE status IS DISTINCT FROM 'complete'")
def incomplete_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.incomplete(table(spark, sf_dir, "build_record")).select("record_id", manifest.shown_status(F.col("status")).alias("shown"))


@query(f"""WITH v AS (SELECT *, {_POPULATION} AS violation FROM build_record), g AS (SELECT route, treatment, min(violation) AS m FROM v WHERE status IN ('built', 'complete') AND violation = 'none_added' OR status IN ('built', 'complete') AND object_count > 225 GROUP BY 1, 2),
j AS (SELECT v.*, status IN ('built', 'complete') AND g.route IS NOT NULL AS hit FROM v LEFT JOIN g ON g.route = v.route AND g.treatment = v.treatment)
SELECT record_id, CASE WHEN hit THEN 'fid_failed' ELSE status END AS status, CASE WHEN hit THEN 'group failed' ELSE error END AS error, CASE WHEN hit THEN '' ELSE fidb_path END AS fidb_path, CASE WHEN hit THEN 0 ELSE fidb_bytes END AS fidb_bytes, CASE WHEN hit THEN 0 ELSE fid_added END AS fid_added, analysis_artifact_path FROM j""")
def group_atomic_failure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One oversized or empty member fails its whole (route, treatment) group."""
    b = table(spark, sf_dir, "build_record")
    v = rules.first_violation(_populated(spark, sf_dir), rules.population_rules(F.col("object_count"))).select("record_id", "violation")
    failed = manifest.fail_groups(b.join(v, "record_id"), ["route", "treatment"], (F.col("violation") == "none_added") | (F.col("object_count") > 225), F.lit("group failed"))
    return failed.select("record_id", "status", "error", "fidb_path", "fidb_bytes", "fid_added", "analysis_artifact_path")


@query("""SELECT record_id, CASE WHEN b.status = 'built' AND a.n IS NOT NULL THEN 'complete' ELSE b.status END AS status, CASE WHEN b.status = 'built' AND a.n IS NOT NULL THEN a.n ELSE b.fid_added END AS fid_added
FROM build_record b LEFT JOIN (SELECT source_sha256, count(*) AS n FROM export_fid_hashes GROUP BY 1) a ON a.source_sha256 = b.analysis_artifact_sha256""")
def apply_population(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Built records complete with the counts of their exported functions."""
    n = table(spark, sf_dir, "export_fid_hashes").groupBy(F.col("source_sha256").alias("analysis_artifact_sha256")).agg(F.count(F.lit(1)).alias("added"))
    populations = n.select("analysis_artifact_sha256", F.lit(1).cast("bigint").alias("program_count"), F.col("added").alias("attempted"), "added", F.lit(0).cast("bigint").alias("excluded"))
    return manifest.complete(table(spark, sf_dir, "build_record"), populations, ["analysis_artifact_sha256"]).select("record_id", "status", "fid_added")


@query("SELECT * EXCLUDE (recorded_at) REPLACE (" + "coalesce(status, 'requested') AS status) FROM (SELECT record_id, coalesce(COLUMNS(lambda c: c NOT IN ('record_id', 'recorded_at', 'status', 'object_count', 'fidb_bytes', 'fid_programs', 'fid_attempted', 'fid_added', 'fid_excluded')), ''), coalesce(COLUMNS(['object_count', 'fidb_bytes', 'fid_programs', 'fid_attempted', 'fid_added', 'fid_excluded']), 0), status, recorded_at FROM build_record)")
def provenance_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All manifest columns without nulls."""
    return manifest.with_defaults(table(spark, sf_dir, "build_record")).drop("recorded_at")


_WORDS = "array_to_string(list_concat(list_filter(string_split(coalesce({0}, ''), ' '), lambda f: NOT list_contains(coalesce(remove_flags, []::VARCHAR[]), f)), coalesce(append_flags, []::VARCHAR[])), ' ')"
_ROUTE = ["target_os", "architecture", "binary_format", "detected_languages", "detection_evidence", "compiler_command", "archiver_command", "ranlib_command", "ghidra_language", "ghidra_compiler_spec"]


@query(f"""SELECT library, b.version, route, id AS treatment, factor AS sensitivity_factor, description AS treatment_description, target_os, architecture, binary_format,
array_to_string(list_filter(string_split(coalesce(detected_languages, ''), ';'), lambda x: x <> ''), ';') AS detected_languages, preferred_build_system AS detected_build_system, array_to_string(list_filter(string_split(coalesce(detection_evidence, ''), ';'), lambda x: x <> ''), ';') AS detection_evidence,
url AS source_url, lower(r.sha256) AS source_sha256, coalesce(compiler_command, '') AS compiler_command, {_WORDS.format('compiler_flags')} AS compiler_flags, coalesce(archiver_command, '') AS archiver_command, coalesce(ranlib_command, archiver_command, '') AS ranlib_command,
ghidra_language, coalesce(ghidra_compiler_spec, 'default') AS ghidra_compiler_spec, CASE WHEN coalesce(len(supported_routes), 0) = 0 OR list_contains(supported_routes, route) THEN 'requested' ELSE 'unsupported' END AS status,
CASE WHEN coalesce(len(supported_routes), 0) = 0 OR list_contains(supported_routes, route) THEN '' ELSE 'treatment is not valid for this route' END AS error
FROM (SELECT DISTINCT library, version, route, compiler_flags, {', '.join(_ROUTE)} FROM build_record WHERE library IS NOT NULL AND version IS NOT NULL AND route IS NOT NULL) b JOIN recipe r ON r.name = b.library AND r.version = b.version CROSS JOIN treatment""")
def base_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records before a build, for every recorded library and route under every treatment (a catalogue that does not grow)."""
    b = table(spark, sf_dir, "build_record").dropna(subset=["library", "version", "route"]).select("library", "version", "route", "compiler_flags", *_ROUTE).distinct()
    r = table(spark, sf_dir, "recipe").select(F.col("name").alias("library"), "version", "url", "sha256", F.col("preferred_build_system").alias("build_system"))
    t = table(spark, sf_dir, "treatment").withColumnRenamed("id", "treatment")
    wide = b.join(r, ["library", "version"]).crossJoin(F.broadcast(t)).withColumn("compiler_flags", F.split(F.coalesce("compiler_flags", F.lit("")), " "))
    words = {c: F.when(F.col(f"{c}_command").isNotNull(), F.split(f"{c}_command", " ")) for c in ("compiler", "archiver", "ranlib")}
    words["ranlib"] = F.coalesce(words["ranlib"], words["archiver"])
    wide = wide.withColumns({c: F.coalesce(w, F.array().cast("array<string>")) for c, w in words.items()} | {"languages": X.unpack("detected_languages"), "evidence": X.unpack("detection_evidence")})
    return manifest.base_records(wide)


_PACKED = """WITH p AS (SELECT library, route, string_agg(analysis_artifact_path, ';' ORDER BY record_id) AS analysis_artifact_path, string_agg(analysis_artifact_sha256, ';' ORDER BY record_id) AS analysis_artifact_sha256, count(*) AS n
FROM build_record WHERE analysis_artifact_path <> '' AND analysis_artifact_sha256 <> '' GROUP BY 1, 2)"""


def packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "build_record").where("analysis_artifact_path <> '' and analysis_artifact_sha256 <> ''")
    listed = b.groupBy("library", "route").agg(F.array_sort(F.collect_list(F.struct("record_id", "analysis_artifact_path", "analysis_artifact_sha256"))).alias("a"), F.count(F.lit(1)).alias("n"))
    return listed.select("library", "route", X.pack(F.col("a.analysis_artifact_path")).alias("analysis_artifact_path"), X.pack(F.col("a.analysis_artifact_sha256")).alias("analysis_artifact_sha256"), "n")


@query(_PACKED + "SELECT * FROM p")
def packed_artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(spark, sf_dir)


@query(_PACKED + "SELECT library, route, unnest(range(1, len(string_split(analysis_artifact_path, ';')) + 1))::INTEGER AS position, unnest(string_split(analysis_artifact_path, ';')) AS analysis_artifact_path, unnest(string_split(analysis_artifact_sha256, ';')) AS analysis_artifact_sha256 FROM p")
def unpack_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.zip_packed(packed(spark, sf_dir), ["library", "route"], "analysis_artifact_path", "analysis_artifact_sha256")


@query("SELECT record_id, CASE WHEN len(i) >= 4 THEN i ELSE lpad(i, 4, '0') END || '-' || parse_filename(analysis_artifact_path) AS artifact_name FROM (SELECT *, row_number() OVER (PARTITION BY library, route ORDER BY record_id)::VARCHAR AS i FROM build_record WHERE analysis_artifact_path IS NOT NULL)")
def artifact_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Artifacts numbered from 1 within library and route, at least four digits."""
    from pyspark.sql import Window

    b = table(spark, sf_dir, "build_record").where(F.col("analysis_artifact_path").isNotNull())
    i = F.row_number().over(Window.partitionBy("library", "route").orderBy("record_id"))
    return b.select("record_id", F.concat(X.zero_padded(i, 4), F.lit("-"), X.basename("analysis_artifact_path")).alias("artifact_name"))


@query("SELECT route, lower(trim(treatment)) AS treatment, arg_min(analysis_artifact_path, record_id) AS analysis_artifact_path FROM build_record WHERE status IN ('built', 'complete') AND analysis_artifact_path IS NOT NULL GROUP BY 1, 2")
def first_program(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "build_record").where("status in ('built', 'complete') and analysis_artifact_path is not null").withColumn("treatment", F.lower(F.trim("treatment")))
    return manifest.first_program(b, ["route", "treatment"], ["record_id"], "analysis_artifact_path")


@query("SELECT record_id, library || '-' || version || '-' || route || '-' || lower(trim(treatment)) AS cell_id, 'p_' || replace(route || '-' || lower(trim(treatment)), '-', '_') AS project FROM build_record WHERE library IS NOT NULL AND version IS NOT NULL AND route IS NOT NULL AND treatment IS NOT NULL")
def cell_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "build_record").dropna(subset=["library", "version", "route", "treatment"])
    t = F.lower(F.trim("treatment"))
    return b.select("record_id", X.cell_id(X.identifier("library", "version"), "route", t).alias("cell_id"), X.project_name(X.cell_id("route", t), "p_").alias("project"))


@query("SELECT doc_id, sha256(text) AS digest FROM documents WHERE text IS NOT NULL")
def content_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where(F.col("text").isNotNull()).select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("digest"))


@query("SELECT sha256(text) AS digest, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def repeated_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconcile.repeated(content_digest(spark, sf_dir), ["digest"])


@query("SELECT library || '=' || language AS text, library AS label, language AS language_id, CASE WHEN NOT regexp_full_match(library, '[A-Za-z0-9_-]+') THEN 'label_characters' END AS violation FROM (SELECT DISTINCT library, ghidra_language AS language FROM build_record WHERE library <> '' AND ghidra_language <> '')")
def probe_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """LABEL=ID texts taken apart; identifiers keep their colons."""
    b = table(spark, sf_dir, "build_record").where("library <> '' and ghidra_language <> ''").select(F.concat("library", F.lit("="), "ghidra_language").alias("text")).distinct()
    return rules.parse_cases(b, "text").select("text", "label", "language_id", "violation")


@query("SELECT library, version, sum(object_count)::BIGINT AS objects, sum(fid_added)::BIGINT AS added, count(*) FILTER (status = 'complete') AS n_complete, bool_or(status = 'built') AS any_built FROM build_record GROUP BY 1, 2")
def library_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "build_record")
    return b.groupBy("library", "version").agg(F.sum("object_count").alias("objects"), F.sum("fid_added").alias("added"), F.count_if(F.col("status") == "complete").alias("n_complete"), F.bool_or(F.col("status") == "built").alias("any_built"))


@query("""SELECT * FROM (SELECT library, version, row_number() OVER (PARTITION BY library ORDER BY version DESC, record_id DESC) AS k, analysis_artifact_path FROM build_record WHERE library IS NOT NULL AND version IS NOT NULL) WHERE k = 1""")
def newest_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first of each library's records in descending order."""
    b = table(spark, sf_dir, "build_record").dropna(subset=["library", "version"])
    top = b.groupBy("library").agg(F.max(F.struct("version", "record_id", "analysis_artifact_path")).alias("t"))
    return top.select("library", "t.version", F.lit(1).cast("bigint").alias("k"), "t.analysis_artifact_path")


def _written(spark: SparkSession, df: DataFrame, kind: str, **options) -> str:
    """A table put into the shared folder in a text format, to be read back strictly."""
    path = fresh_dir(spark, kind)
    df.write.options(**options).format("csv" if kind in ("csv", "tsv") else "text").save(path)
    return path


_COUNTS = ["fid_programs", "fid_attempted", "fid_added", "fid_excluded"]


@query("SELECT library, version, " + ", ".join(_COUNTS) + ", CASE WHEN fid_attempted = fid_added + fid_excluded THEN 'reconciled' ELSE 'open' END AS state FROM build_record")
def jsonl_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Population rows written as one file of JSON lines, read back with strict types."""
    b = table(spark, sf_dir, "build_record").select("record_id", "library", "version", *_COUNTS)
    path = publish.write_json_lines(b, f"{fresh_dir(spark, 'jsonl')}/population.jsonl", ["record_id"])
    rows = readers.json_rows(spark, path, {"library": "string", "version": "string"} | dict.fromkeys(_COUNTS, "bigint"))
    done = F.coalesce(F.col("fid_attempted") == F.col("fid_added") + F.col("fid_excluded"), F.lit(False))
    return rows.where("problem is null").select("library", "version", *_COUNTS, F.when(done, "reconciled").otherwise("open").alias("state"))


@query("SELECT record_id::VARCHAR AS record_id, coalesce(library, '') AS library, coalesce(error, '') AS error, coalesce(compiler_flags, '') AS compiler_flags FROM build_record")
def csv_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A manifest written with quotes only where needed and read back, empty texts kept."""
    b = table(spark, sf_dir, "build_record").select("record_id", "library", "error", "compiler_flags")
    return readers.csv_rows(spark, publish.write_csv(b, f"{fresh_dir(spark, 'csv')}/manifest.csv", ["record_id"]))


_TEXTS = ", ".join(f"coalesce({c}, '') AS {c}" for c in requests.COLUMNS)


@query(f"SELECT row_number() OVER (ORDER BY request_seq) - 1 AS row_no, {_TEXTS} FROM request_queue")
def queue_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The request queue written as its file and read back by its exact header, order kept."""
    path = publish.write_csv(table(spark, sf_dir, "request_queue"), f"{fresh_dir(spark, 'queue')}/pending.csv", ["request_seq"], requests.COLUMNS)
    return readers.request_queue(spark, path)


@query("""SELECT line_no, CASE WHEN kind < 4 THEN kind END AS kind, CASE WHEN kind = 0 THEN fid_added END AS added, CASE WHEN kind = 4 THEN 'invalid_json' WHEN kind = 5 THEN 'not_an_object' END AS problem
FROM (SELECT row_number() OVER (ORDER BY record_id) AS line_no, record_id % 6 AS kind, fid_added FROM build_record)""")
def strict_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that hold a whole number, a decimal, a truth value or a text in its place, no JSON, and no object."""
    kind = F.col("record_id") % 6
    n = F.coalesce(F.col("fid_added").cast("string"), F.lit("null"))
    value = F.when(kind == 0, n).when(kind == 1, "15.0").when(kind == 2, "true").otherwise('"15"')
    text = F.when(kind == 4, "{not json").when(kind == 5, "[1]").otherwise(F.concat(F.lit('{"kind": '), kind.cast("string"), F.lit(', "added": '), value, F.lit("}")))
    path = publish.write_lines(table(spark, sf_dir, "build_record").select("record_id", text.alias("value")), f"{fresh_dir(spark, 'strict')}/rows.jsonl", ["record_id"])
    return readers.json_rows(spark, path, {"kind": "bigint", "added": "bigint"}).select("line_no", "kind", "added", "problem")


@query("SELECT library, version, route, folder, path FROM (SELECT library, version, route, '/' || treatment AS folder, analysis_artifact_path AS path FROM build_record) WHERE library <> '' AND version <> '' AND route <> '' AND folder <> '' AND path <> '' AND folder = trim(folder)")
def tsv_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of exactly five tab-separated fields."""
    b = table(spark, sf_dir, "build_record").select("library", "version", "route", F.concat(F.lit("/"), "treatment").alias("folder"), F.col("analysis_artifact_path").alias("path"))
    b = b.where("library <> '' and version <> '' and route <> '' and folder <> '' and path <> '' and folder = trim(folder)")
    rows = readers.tsv_rows(spark, publish.write_tsv(b, f"{fresh_dir(spark, 'tsv')}/listing.tsv", ["library", "version", "route", "folder", "path"]), ["library", "version", "route", "folder", "path"])
    return rows.where("problem is null").drop("line_no", "problem")


@query("SELECT library || '.' || record_id AS key, compiler_flags AS value FROM build_record WHERE library <> '' AND compiler_flags <> ''")
def properties_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``key=value`` lines, split at the first separator."""
    b = table(spark, sf_dir, "build_record").where("library <> '' and compiler_flags <> ''")
    return readers.properties(spark, _written(spark, b.select(F.concat("library", F.lit("."), F.col("record_id").cast("string"), F.lit(" = "), "compiler_flags").alias("value")), "properties"))


@query(_FOLD.replace("CUT", "0") + "SELECT library_request, priority::VARCHAR AS priority, status, resolution_lane, requested_routes, first_requested_utc, last_requested_utc, request_count::VARCHAR AS request_count, candidate_version, candidate_source_url, candidate_sha256, notes FROM f")
def queue_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same requests as a stream into an empty queue (an extension: micro-batches, exactly once)."""
    source = table(spark, sf_dir, "request_queue")
    at = fresh_dir(spark, "queue")
    source.write.parquet(f"{at}/arriving")
    stream = spark.readStream.schema(source.schema).parquet(f"{at}/arriving")
    merge_stream(stream, f"{at}/versions", f"{at}/checkpoint").awaitTermination()
    return current_queue(spark, f"{at}/versions")


QUERIES = Q
