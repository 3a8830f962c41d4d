from __future__ import annotations

import os
from pathlib import Path

import pytest

SMALL = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")


def test_all_problems_are_registered():
    import __spark_entry__ as e

    names = set(e.queries())
    assert {"p1_found", "p2_found", "p3_found", "p4_found", "p5_found", "p6_ids", "p8_found"} <= names
    assert any(n.startswith("p7_") for n in names)


def test_queries_equal_their_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    from sigloom.llm import registry
    from tools.compare import cell

    duck = duckdb.connect()
    for p in Path(SMALL).glob("*.parquet"):
        duck.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    for name, sql in registry.SQL.items():
        df = registry.QUERIES[name](spark, SMALL)
        rel = duck.sql(sql)
        assert sorted(df.columns) == sorted(rel.columns), name
        mine = sorted(repr([cell(r[c]) for c in sorted(df.columns)]) for r in df.collect())
        theirs = sorted(repr([cell(dict(zip(rel.columns, r))[c]) for c in sorted(df.columns)]) for r in rel.fetchall())
        assert mine == theirs, name


def test_distinct_counts_against_exact_ones(spark):
    from pyspark.sql import functions as F

    from sigloom.functions.hexes import hash_text
    from sigloom.llm import setsketch, sketch_queries
    from sigloom.plans.session import table

    rows = table(spark, SMALL, "export_fid_hashes").select("source_sha256", "language_id", F.date_format("exported_at", "yyyy-MM-dd").alias("day"), hash_text("full_hash").alias("h")).dropna(subset=["day", "h"])
    joined = rows.join(sketch_queries.artifact_treatments(spark, SMALL), "source_sha256")
    exact = {(r["day"], r["language_id"], r["treatment"]): (r["d"], r["n"]) for r in joined.groupBy("day", "language_id", "treatment").agg(F.count_distinct("h").alias("d"), F.count("h").alias("n")).collect()}
    got = {(r["day"], r["language_id"], r["treatment"]): (r["distinct_estimate"], r["n_rows"]) for r in sketch_queries.p1_counts(spark, SMALL).collect()}
    assert all(got[k][1] == n and abs(got[k][0] - d) <= 5 * setsketch.relative_error() * d + 1 for k, (d, n) in exact.items())


@pytest.mark.parametrize("name", ["p1_overlap", "p2_frequent", "p6_ids", "p6_round_trip", "p7_pack", "p7_instruction", "p7_fill", "p8_found", "p8_scores", "p8_rates"])
def test_queries_without_sql_run(spark, name):
    from sigloom.llm import registry

    rows = registry.QUERIES[name](spark, SMALL).collect()
    assert rows
    if name == "p6_round_trip":
        assert all(r["n_changed"] == 0 for r in rows)
    if name == "p7_fill":
        assert rows[0]["unused_share"] < 0.1 and rows[0]["most_tokens"] <= 2048
