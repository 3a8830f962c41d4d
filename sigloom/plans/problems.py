"""Registered queries of the general problems: copy differences (3) and heavy keys (4)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigloom.functions.hexes import address_text, hash_text, trimmed
from sigloom.operators.copydiff import diff_copies
from sigloom.operators.skew import aggregate_beside_rows, least, rows, skewed_aggregate
from sigloom.plans.session import table

FIELDS = ["source_sha256", "program", "language_id", "compiler_spec", "function_name", "code_unit_size", "specific_hash_additional_size", "full_hash", "specific_hash"]


def empty_is_null(name: str):
    return F.when(F.col(name) != "", F.col(name))


def export_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff_copies(
        table(spark, sf_dir, "export_fid_hashes"),
        table(spark, sf_dir, "export_fid_hashes_copy"),
        {"case_label": trimmed("case"), "entry_point": address_text("entry_point")},
        "row_id",
        FIELDS,
        {"full_hash": hash_text, "specific_hash": hash_text, "function_name": empty_is_null},
    )


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return export_differences(spark, sf_dir).select("case_label", "entry_point", "difference")


def p3_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The differing values of both sides."""
    return export_differences(spark, sf_dir).where(~F.col("difference").isin("missing_in_copy", "missing_in_main"))


def p3_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return export_differences(spark, sf_dir).groupBy("difference").agg(F.count(F.lit(1)).alias("n"))


def keyed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """key_field, key_value, row_id, exported_at: each exported function under its hash and under its name."""
    keys = F.array(F.struct(F.lit("full_hash").alias("key_field"), hash_text("full_hash").alias("key_value")), F.struct(F.lit("function_name").alias("key_field"), empty_is_null("function_name").alias("key_value")))
    return table(spark, sf_dir, "export_fid_hashes").select("row_id", "exported_at", F.explode(keys).alias("k")).select("k.*", "row_id", "exported_at").where(F.col("key_value").isNotNull())


def key_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """key_field, key_value, n, row_id of the earliest row, for every value of both fields, in one pass over the rows of each road."""
    first = F.when(F.col("exported_at").isNotNull(), F.struct("exported_at", "row_id"))
    found = skewed_aggregate(keyed_rows(spark, sf_dir), ["key_field", "key_value"], [rows("n"), least("first", first)])
    return found.select("key_field", "key_value", "n", F.col("first.row_id").alias("row_id"))


def p4_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return key_results(spark, sf_dir)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    n_all = table(spark, sf_dir, "export_fid_hashes").select(F.count(F.lit(1)).alias("n_all")).scalar()
    return key_results(spark, sf_dir).where((F.col("n") >= n_all * F.lit(0.005)) & F.col("row_id").isNotNull()).select("key_field", "key_value", "row_id")


def p4_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each exported function beside its hash's earliest row: heavy hashes meet it by broadcast, all others by shuffle."""
    facts = table(spark, sf_dir, "export_fid_hashes").select("row_id", "exported_at", hash_text("full_hash").alias("full_hash")).where(F.col("full_hash").isNotNull())
    earliest = F.when(F.col("exported_at").isNotNull(), F.struct("exported_at", "row_id"))
    return aggregate_beside_rows(facts, ["full_hash"], [rows("n"), least("first", earliest)]).select("row_id", "full_hash", "n", F.col("first.row_id").alias("first_row_id"))


QUERIES = {f.__name__: f for f in (p3_found, p3_values, p3_summary, p4_found, p4_keys, p4_rows)}


def sql_hash(c: str) -> str:
    digits = f"regexp_replace(regexp_replace(lower(regexp_replace({c}, '^\\s+|\\s+$|_', '', 'g')), '^0x', ''), '^0+([0-9a-f])', '\\1')"
    return f"CASE WHEN regexp_full_match({digits}, '[0-9a-f]{{1,16}}') THEN lpad({digits}, 16, '0') END"


def sql_address(c: str) -> str:
    digits = f"regexp_replace(regexp_replace(lower(trim({c}, ' \t\n\r')), '^0x', ''), '^0+([0-9a-f])', '\\1')"
    return f"lpad({digits}, 8, '0')"


def _side(t: str) -> str:
    values = [sql_hash(f) + f" AS {f}" if f.endswith("_hash") else "nullif(function_name, '') AS function_name" if f == "function_name" else f for f in FIELDS]
    return f"""(SELECT * EXCLUDE (k) FROM (SELECT trim("case", ' \t\n\r') AS case_label, {sql_address('entry_point')} AS entry_point, {', '.join(values)}, row_number() OVER (PARTITION BY trim("case", ' \t\n\r'), {sql_address('entry_point')} ORDER BY row_id DESC) AS k FROM {t}) WHERE k = 1)"""


_DIFF = f"""
WITH a AS MATERIALIZED {_side('export_fid_hashes')}, b AS MATERIALIZED {_side('export_fid_hashes_copy')},
d AS (
SELECT case_label, entry_point, 'missing_in_copy' AS difference, NULL::VARCHAR AS left_value, NULL::VARCHAR AS right_value FROM a ANTI JOIN b USING (case_label, entry_point)
UNION ALL SELECT case_label, entry_point, 'missing_in_main', NULL, NULL FROM b ANTI JOIN a USING (case_label, entry_point)
{' '.join(f"UNION ALL SELECT case_label, entry_point, '{f}', a.{f}::VARCHAR, b.{f}::VARCHAR FROM a JOIN b USING (case_label, entry_point) WHERE a.{f} IS DISTINCT FROM b.{f}" for f in FIELDS)})
"""

_KEYS = f"""
WITH k AS (SELECT 'full_hash' AS key_field, {sql_hash('full_hash')} AS key_value, row_id, exported_at FROM export_fid_hashes
UNION ALL SELECT 'function_name', nullif(function_name, ''), row_id, exported_at FROM export_fid_hashes),
g AS (SELECT key_field, key_value, count(*) AS n, (min({{'t': exported_at, 'r': row_id}}) FILTER (exported_at IS NOT NULL)).r AS row_id FROM k WHERE key_value IS NOT NULL GROUP BY 1, 2)
"""

SQL = {
    "p3_found": _DIFF + "SELECT case_label, entry_point, difference FROM d",
    "p3_values": _DIFF + "SELECT * FROM d WHERE difference NOT LIKE 'missing%'",
    "p3_summary": _DIFF + "SELECT difference, count(*) AS n FROM d GROUP BY 1",
    "p4_found": _KEYS + "SELECT key_field, key_value, row_id FROM g WHERE row_id IS NOT NULL AND n >= 0.005 * (SELECT count(*) FROM export_fid_hashes)",
    "p4_keys": _KEYS + "SELECT key_field, key_value, n, row_id FROM g",
    "p4_rows": _KEYS + f"SELECT e.row_id, g.key_value AS full_hash, g.n, g.row_id AS first_row_id FROM export_fid_hashes e JOIN g ON g.key_field = 'full_hash' AND g.key_value = {sql_hash('e.full_hash')}",
}
