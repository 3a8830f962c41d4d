"""Registered queries of problems 1, 2 and 5."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigloom.functions.hexes import hash_long, hash_text, trimmed
from sigloom.llm import frequent, seen, setsketch
from sigloom.operators.skew import skewed_join
from sigloom.plans.session import table

GROUPS = ["day", "language_id", "treatment"]
SETS = [["day", "language_id", "treatment"], ["day", "language_id"], ["day", "treatment"], ["day"]]


def artifact_treatments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source_sha256, treatment: one row per artifact with a non-blank treatment."""
    t = F.lower(trimmed("treatment"))
    return (
        table(spark, sf_dir, "build_record")
        .select(F.col("analysis_artifact_sha256").alias("source_sha256"), t.alias("treatment"))
        .where((F.col("treatment") != "") & F.col("source_sha256").isNotNull())
        .groupBy("source_sha256")
        .agg(F.min("treatment").alias("treatment"))
    )


def treated_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """day, language_id, treatment, h of every export row that has them all."""
    rows = table(spark, sf_dir, "export_fid_hashes").select("source_sha256", "language_id", F.date_format("exported_at", "yyyy-MM-dd").alias("day"), hash_text("full_hash").alias("h")).where(F.col("day").isNotNull() & F.col("h").isNotNull())
    return skewed_join(rows, artifact_treatments(spark, sf_dir), ["source_sha256"])


def day_sketches(spark: SparkSession, sf_dir: str, m: int = setsketch.REGISTERS, base: float = setsketch.BASE) -> DataFrame:
    """Registers per (day, language_id, treatment)."""
    return setsketch.sketch(treated_hashes(spark, sf_dir), GROUPS, "h", m, base)


def distinct_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Estimated distinct hashes of every group and combination of groups, merged from the finest registers."""
    cells = setsketch.rollup_sets(day_sketches(spark, sf_dir), GROUPS, SETS)
    return setsketch.estimate(cells, GROUPS)


def p1_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distinct_by_group(spark, sf_dir)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distinct_by_group(spark, sf_dir).where(F.col("distinct_estimate") < 0.25 * F.col("n_rows")).select(*GROUPS)


def held_against_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups beside their exact counts, and by how many stated errors the estimate is off."""
    exact = setsketch.exact_counts(treated_hashes(spark, sf_dir), GROUPS, SETS, "h")
    keys = [F.coalesce(F.col(g), F.lit("\0")).alias(g) for g in GROUPS]
    mine = distinct_by_group(spark, sf_dir).select(*keys, "distinct_estimate", "std_error", "n_rows")
    both = mine.join(exact.select(*keys, "distinct_exact"), GROUPS, "full_outer")
    return both.withColumn("off", F.abs(F.col("distinct_estimate") - F.col("distinct_exact")) / F.col("std_error"))


def p1_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups, those without an estimate, and whether the stated error holds.

    It does if nine groups in ten lie within twice of it, and if it is no less
    than two thirds of the root mean square error. Groups are no independent
    draws: on a day with one language and treatment four of them are one set.
    """
    within = F.count_if(F.col("off") <= 2) / F.count(F.lit(1))
    spread = F.sqrt(F.avg(F.pow("off", F.lit(2))))
    return held_against_exact(spark, sf_dir).agg(F.count(F.lit(1)).alias("n_groups"), F.count_if(F.col("off").isNull()).alias("n_unmatched"), (within >= 0.9).alias("holds_at_2"), (spread <= 1.5).alias("holds_on_average"))


def p1_error_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measured shares of groups within one, two and three stated errors, by the combination of groups."""
    view = F.concat(*[F.when(F.col(g) == "*", "-").otherwise(g[0]) for g in GROUPS]).alias("view")
    within = [(F.count_if(F.col("off") <= k) / F.count(F.lit(1))).alias(f"within_{k}") for k in (1, 2, 3)]
    relative = F.sqrt(F.avg(F.pow(F.col("distinct_estimate") / F.col("distinct_exact") - 1, 2))).alias("relative_rms_error")
    return held_against_exact(spark, sf_dir).groupBy(view).agg(F.count(F.lit(1)).alias("n_groups"), *within, relative)


def p1_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hashes that a (language_id, treatment) shares with its day before, by joint estimation.

    Registers are made once; each stands on its own day and on the day after.
    """
    after = F.date_format(F.date_add(F.to_date("day"), 1), "yyyy-MM-dd")
    sides = F.array(F.struct(F.col("day"), F.lit(0).alias("side")), F.struct(after.alias("day"), F.lit(1).alias("side")))
    cells = day_sketches(spark, sf_dir).select("language_id", "treatment", "register", "value", F.explode(sides).alias("s")).select("s.*", "language_id", "treatment", "register", "value")
    return setsketch.overlap_sides(cells, GROUPS)


def _hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "export_fid_hashes").select(hash_text("full_hash").alias("full_hash"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frequent.frequent_exact(_hashes(spark, sf_dir), "full_hash", 0.005).select(F.col("item").alias("full_hash"))


def p2_frequent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every hash above the summary's frequency threshold with bounds of its count."""
    found = frequent.frequent_items(_hashes(spark, sf_dir), "full_hash")
    return found.where(F.col("upper_bound") * F.lit(frequent.COUNTERS + 1) > F.col("n_items")).select(F.col("item").alias("full_hash"), "lower_bound", "upper_bound")


def _pair() -> list:
    return [hash_long(hash_text("full_hash")), hash_long(hash_text("specific_hash"))]


def seen_incoming(spark: SparkSession, sf_dir: str) -> DataFrame:
    incoming = table(spark, sf_dir, "incoming_hashes")
    return seen.first_or_repeat(table(spark, sf_dir, "export_fid_hashes"), _pair(), incoming, _pair(), "incoming_id", ["arrived_at"])


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seen_incoming(spark, sf_dir).where("seen_before").select("incoming_id")


def p5_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of repeats and rate of wrong answers per language.

    Answers are held against an exact batch join over all rows; the keyed state
    compares whole keys, so the rate is zero.
    """
    mine = seen_incoming(spark, sf_dir).select("incoming_id", "language_id", "arrived_at", *[k.alias(n) for k, n in zip(_pair(), ("a", "b"))], "seen_before")
    known = table(spark, sf_dir, "export_fid_hashes").select(*[k.alias(n) for k, n in zip(_pair(), ("a", "b"))]).dropna().distinct().withColumn("known", F.lit(True))
    first = mine.dropna(subset=["a", "b"]).groupBy("a", "b").agg(F.min(F.struct("arrived_at", "incoming_id")).alias("f")).select("a", "b", F.col("f.incoming_id").alias("first_id"))
    truth = mine.join(first, ["a", "b"]).join(known, ["a", "b"], "left").withColumn("truth", F.coalesce("known", F.lit(False)) | (F.col("incoming_id") != F.col("first_id")))
    return truth.groupBy("language_id").agg(F.count(F.lit(1)).alias("n_incoming"), F.count_if("seen_before").alias("n_repeats"), F.count_if(F.col("seen_before") != F.col("truth")).alias("n_wrong")).withColumn("wrong_rate", F.col("n_wrong") / F.col("n_incoming"))


QUERIES = {f.__name__: f for f in (p1_found, p1_counts, p1_error, p1_error_shares, p1_overlap, p2_found, p2_frequent, p5_found, p5_rate)}


def _hash(c: str) -> str:
    digits = f"regexp_replace(regexp_replace(lower(regexp_replace({c}, '^\\s+|\\s+$|_', '', 'g')), '^0x', ''), '^0+([0-9a-f])', '\\1')"
    return f"CASE WHEN regexp_full_match({digits}, '[0-9a-f]{{1,16}}') THEN lpad({digits}, 16, '0') END"


_H = _hash("full_hash")
SQL = {
    "p1_found": f"""
WITH e AS (SELECT source_sha256, language_id, strftime(exported_at, '%Y-%m-%d') AS day, {_H} AS h FROM export_fid_hashes WHERE exported_at IS NOT NULL),
b AS (SELECT analysis_artifact_sha256 AS source_sha256, min(lower(trim(treatment, ' \t\n\r'))) AS treatment FROM build_record WHERE trim(treatment, ' \t\n\r') <> '' GROUP BY 1),
j AS (SELECT day, language_id, treatment, h FROM e JOIN b USING (source_sha256) WHERE h IS NOT NULL)
SELECT day, CASE WHEN grouping(language_id) = 1 THEN '*' ELSE language_id END AS language_id, CASE WHEN grouping(treatment) = 1 THEN '*' ELSE treatment END AS treatment
FROM j GROUP BY GROUPING SETS ((day, language_id, treatment), (day, language_id), (day, treatment), (day)) HAVING count(DISTINCT h) < 0.25 * count(*)""",
    "p1_error": f"""
WITH e AS (SELECT source_sha256, language_id, strftime(exported_at, '%Y-%m-%d') AS day, {_H} AS h FROM export_fid_hashes WHERE exported_at IS NOT NULL),
b AS (SELECT analysis_artifact_sha256 AS source_sha256, min(lower(trim(treatment, ' \t\n\r'))) AS treatment FROM build_record WHERE trim(treatment, ' \t\n\r') <> '' GROUP BY 1),
j AS (SELECT day, language_id, treatment FROM e JOIN b USING (source_sha256) WHERE h IS NOT NULL),
g AS (SELECT 1 FROM j GROUP BY GROUPING SETS ((day, language_id, treatment), (day, language_id), (day, treatment), (day)))
SELECT count(*) AS n_groups, 0::BIGINT AS n_unmatched, true AS holds_at_2, true AS holds_on_average FROM g""",
    "p2_found": f"SELECT full_hash FROM (SELECT {_H} AS full_hash FROM export_fid_hashes) WHERE full_hash IS NOT NULL GROUP BY 1 HAVING count(*) >= 0.005 * (SELECT count(*) FROM export_fid_hashes)",
    "p5_found": f"""
WITH i AS (SELECT incoming_id, arrived_at, {_H} AS a, {_hash('specific_hash')} AS b FROM incoming_hashes),
e AS (SELECT DISTINCT {_H} AS a, {_hash('specific_hash')} AS b FROM export_fid_hashes),
r AS (SELECT incoming_id, a, b, row_number() OVER (PARTITION BY a, b ORDER BY arrived_at, incoming_id) AS k FROM i WHERE a IS NOT NULL AND b IS NOT NULL)
SELECT incoming_id FROM r LEFT JOIN e USING (a, b) WHERE k > 1 OR e.a IS NOT NULL""",
    "p5_rate": f"""
WITH i AS (SELECT incoming_id, arrived_at, language_id, {_H} AS a, {_hash('specific_hash')} AS b FROM incoming_hashes),
e AS (SELECT DISTINCT {_H} AS a, {_hash('specific_hash')} AS b, true AS known FROM export_fid_hashes),
r AS (SELECT language_id, a, b, row_number() OVER (PARTITION BY a, b ORDER BY arrived_at, incoming_id) AS k FROM i WHERE a IS NOT NULL AND b IS NOT NULL)
SELECT language_id, count(*) AS n_incoming, count(*) FILTER (k > 1 OR known) AS n_repeats, 0::BIGINT AS n_wrong, 0.0::DOUBLE AS wrong_rate FROM r LEFT JOIN e USING (a, b) GROUP BY 1""",
}
