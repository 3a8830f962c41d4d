from __future__ import annotations

import importlib.util
import os
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
SMALL = "/root/testdata/sf0.001"


def test_every_sql_belongs_to_a_query():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")
def test_entry_runs(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 9


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")
def test_core_queries_equal_their_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    import __spark_entry__ as e
    from tools.compare import cell

    duck = duckdb.connect()
    for p in Path(SMALL).glob("*.parquet"):
        duck.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    from sigloom.plans import checks, core, problems

    for name, q in {**core.QUERIES, **checks.QUERIES, **problems.QUERIES}.items():
        df = q(spark, SMALL)
        rel = duck.sql(e.oracle_sql()[name])
        assert sorted(df.columns) == sorted(rel.columns), name
        mine = sorted(repr([cell(r[c]) for c in sorted(df.columns)]) for r in df.collect())
        theirs = sorted(repr([cell(dict(zip(rel.columns, r))[c]) for c in sorted(df.columns)]) for r in rel.fetchall())
        assert mine == theirs, name


def test_core_imports_without_the_optional_subpackage(tmp_path):
    code = "import sys; sys.modules['sigloom.llm'] = None\nimport sigloom.plans.core, sigloom.plans.problems, sigloom.sources.readers, sigloom.sources.publish, sigloom.streaming.queue"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)
    for p in (ROOT / "sigloom").rglob("*.py"):
        if "llm" not in p.parts:
            assert "sigloom.llm" not in p.read_text(), p
    assert importlib.util.find_spec("sigloom")


@pytest.mark.parametrize("blocked", ["ahocorasick", "sigloom.llm"])
def test_queries_of_the_core_stay_where_a_dependency_is_missing(blocked):
    code = f"""
import sys, warnings
sys.modules[{blocked!r}] = None
warnings.simplefilter("ignore")
import __spark_entry__ as e
from sigloom.plans import checks, core, problems
mine = dict(core.QUERIES) | checks.QUERIES | problems.QUERIES
assert set(mine) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries()), len(e.queries())
assert len(e.queries()) >= 100
"""
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)


def test_the_package_reaches_python_workers(spark):
    import io
    import zipfile

    from sigloom.plans.session import package_bytes, ship

    names = zipfile.ZipFile(io.BytesIO(package_bytes())).namelist()
    assert "sigloom/operators/skew.py" in names and "sigloom/__init__.py" in names
    ship(spark)
    ship(spark)
    assert sum("sigloom.zip" in f for f in spark.sparkContext.listFiles) == 1
