from __future__ import annotations

import csv
import hashlib
import json

import pytest
from pyspark.sql import functions as F

from sigloom.__main__ import main
from sigloom.errors import RequestsUnknown, RuleBroken, RunIncomplete
from sigloom.plans import flows

RECIPE = {"schema_version": "fidb-recipe/v2", "name": "zlib", "version": "1.3", "url": "u", "sha256": "A" * 64, "source_directory": "zlib-1.3", "preferred_build_system": "autoconf", "project_markers": ["zlib.h"], "allowed_build_systems": ["autoconf"], "static_archives": ["libz.a"]}
ROUTE = {"id": "r1", "target_os": "linux", "architecture": "a", "binary_format": "ELF", "compiler": ["cc"], "archiver": ["ar"], "linked_suffix": ".so", "linked_file_markers": ["ELF"]}
DOC = {"schema_version": "fidb-worker/v2", "requested_libraries": ["zlib"], "routes": [ROUTE, ROUTE | {"id": "r2"}], "treatments": [{"id": "t1"}, {"id": "t2", "supported_routes": ["r2"]}], "profiles": {"default": ["t1"], "all": ["t2", "t1"]}}


@pytest.fixture
def project(tmp_path):
    (tmp_path / "recipes").mkdir()

    def write(doc=DOC, *recipes):
        for r in recipes or (RECIPE, RECIPE | {"name": "bzip2", "version": "1.0"}):
            (tmp_path / "recipes" / f"{r['name']}-{r['version']}.json").write_text(json.dumps(r))
        (tmp_path / "worker.json").write_text(json.dumps(doc))
        return str(tmp_path / "worker.json")

    return write


def test_plan_in_order(spark, project):
    config = flows.load(spark, project(), ["bzip2", "zlib@1.3"])
    assert flows.plan(flows.select(config, ["r1"], None, "default")) == ["Plan: 2 libraries; 1 routes; 1 treatments; 2 cells (2 runnable)", "- bzip2-1.0 | r1 | t1 | runnable", "- zlib-1.3 | r1 | t1 | runnable"]
    assert flows.plan(flows.select(config, None, None, "all"))[1:3] == ["- bzip2-1.0 | r1 | t2 | unsupported", "- bzip2-1.0 | r1 | t1 | runnable"]
    assert len(flows.plan(flows.select(config, ["r1", "r1"], ["t1"], "no such profile"))) == 5


def test_all_unknown_requests_together(spark, project):
    with pytest.raises(RequestsUnknown) as e:
        flows.load(spark, project(), ["a", "zlib", "b"])
    assert e.value.requests == ("a", "b") and e.value.known == ("bzip2", "zlib")


@pytest.mark.parametrize(
    ("doc", "rule"),
    [({"schema_version": "v1"}, "schema_version"), ({"schema_version": "x-worker/v2"}, "schema_version"), ({"requested_libraries": []}, "no_requests"), ({"requested_libraries": ["zlib", "zlib-1.3"]}, "not_unique"), ({"routes": [ROUTE, ROUTE]}, "not_unique"), ({"routes": [ROUTE | {"id": "../../src"}]}, "unsafe_id"), ({"routes": [ROUTE | {"linked_suffix": "so"}]}, "incomplete_linked_output"), ({"routes": [ROUTE | {"compiler": []}]}, "empty_tool_command"), ({"routes": []}, "no_routes"), ({"treatments": [{"id": "t1", "phase": "x"}]}, "unknown_treatments"), ({"treatments": [{"id": "t1", "phase": "x"}], "profiles": {"p": ["t1"]}}, "phase")],
)
def test_first_broken_rule_stops(spark, project, doc, rule):
    with pytest.raises(RuleBroken) as e:
        flows.load(spark, project(DOC | doc))
    assert e.value.rule == rule


def test_two_versions_of_a_name_clash(spark, project):
    with pytest.raises(RuleBroken) as e:
        flows.load(spark, project(DOC, RECIPE, RECIPE | {"version": "2"}))
    assert e.value.rule == "not_unique"


@pytest.mark.parametrize("more", [{"routes": ["r9"]}, {"treatments": ["t9"]}, {"profile": "p9"}])
def test_unknown_selection(spark, project, more):
    with pytest.raises(RuleBroken):
        flows.select(flows.load(spark, project()), **more)


def rows(*functions):
    return "".join(json.dumps({"entry_point": e, "full_hash": f, "specific_hash": s}) + "\n" for e, f, s in functions)


def test_probe(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text(rows(*((f"e{i}", f"f{i}", f"s{i}") for i in range(6))))
    (tmp_path / "b.jsonl").write_text(rows(("e0", "zz", "zz"), ("e1", "other", "s1"), ("e9", "f9", "s9"), ("e2", "f2", "s2"), ("e0", "f0", "s0")))
    out = flows.probe(spark, {"b": str(tmp_path / "b.jsonl"), "a": str(tmp_path / "a.jsonl")}, str(tmp_path / "out"))
    m = list(csv.DictReader(open(out["matrix"], newline="")))
    assert [(r["reference_case"], r["comparison_case"]) for r in m] == [("b", "b"), ("b", "a"), ("a", "b"), ("a", "a")]
    assert (m[2]["shared_entrypoints"], m[2]["full_hash_equal"], m[2]["specific_hash_equal"], m[2]["reference_retained_pct"]) == ("3", "2", "3", "33.333333")
    doc = json.load(open(out["manifest"]))
    assert [(c["label"], c["hashable_functions"]) for c in doc["cases"]] == [("b", 5), ("a", 6)]
    assert doc["outputs"]["matrix.csv"] == hashlib.sha256(open(out["matrix"], "rb").read()).hexdigest()
    assert [r["case"] for r in csv.DictReader(open(out["functions"], newline=""))] == ["b"] * 5 + ["a"] * 6


@pytest.mark.parametrize(("text", "rule"), [("not json\n", "invalid_json"), ("[1]\n", "not_an_object"), ("\n", "no_functions")])
def test_probe_stops_at_bad_rows(spark, tmp_path, text, rule):
    (tmp_path / "a.jsonl").write_text(rows(("1", "a", "b")))
    (tmp_path / "b.jsonl").write_text(text)
    with pytest.raises(RuleBroken) as e:
        flows.probe(spark, {"a": str(tmp_path / "a.jsonl"), "b": str(tmp_path / "b.jsonl")}, str(tmp_path / "out"))
    assert e.value.rule == rule
    with pytest.raises(RuleBroken):
        flows.probe(spark, {"a": str(tmp_path / "a.jsonl")}, str(tmp_path / "out"))


def test_missing_requests_are_queued_and_merged(spark, tmp_path):
    path = str(tmp_path / "q" / "pending.csv")
    flows.record_missing(spark, path, ["OrnKit"], 2, ["r1"], "t1")
    flows.record_missing(spark, path, ["ornkit", "other", "ornkit"], 0, [], "t2")
    got = list(csv.DictReader(open(path, newline="")))
    assert [(r["library_request"], r["priority"], r["request_count"], r["requested_routes"], r["first_requested_utc"], r["last_requested_utc"], r["status"]) for r in got] == [("OrnKit", "0", "3", "r1", "t1", "t2", "pending"), ("other", "0", "1", "", "t2", "t2", "pending")]
    for names, priority in ((["x"], 5), ([" "], 1), (["=x"], 1)):
        with pytest.raises(RuleBroken):
            flows.record_missing(spark, path, names, priority)


def test_new_requests_follow_in_the_order_they_came(spark, tmp_path):
    path = str(tmp_path / "q.csv")
    flows.record_missing(spark, path, ["zeta", "alpha"], 1, [], "t1")
    flows.record_missing(spark, path, ["omega", "Alpha", "beta", "omega"], 0, [], "t2")
    assert [(r["library_request"], r["request_count"]) for r in csv.DictReader(open(path, newline=""))] == [("zeta", "1"), ("alpha", "2"), ("omega", "2"), ("beta", "1")]
    text = open(path, newline="").read()
    open(path, "w", newline="").write(text + text.splitlines()[2].replace("alpha", "ALPHA") + "\r\n")
    flows.record_missing(spark, path, ["alpha"], 0, [], "t3")
    assert [(r["library_request"], r["request_count"]) for r in csv.DictReader(open(path, newline=""))] == [("zeta", "1"), ("alpha", "2"), ("omega", "2"), ("beta", "1"), ("ALPHA", "3")]


def test_probe_stops_at_changed_inputs_and_overlapping_folders(spark, tmp_path, monkeypatch):
    for n in "ab":
        (tmp_path / f"{n}.jsonl").write_text(rows(("1", "x", "y")))
    cases = {n: str(tmp_path / f"{n}.jsonl") for n in "ab"}
    with pytest.raises(RuleBroken) as e:
        flows.probe(spark, cases, str(tmp_path))
    assert e.value.rule == "overlapping_roots"
    (tmp_path / "link").symlink_to(tmp_path / "elsewhere")
    with pytest.raises(RuleBroken) as e:
        flows.probe(spark, cases, str(tmp_path / "link"))
    assert e.value.rule == "symbolic_link"
    write = flows.publish.write_csv

    def meddle(*args, **more):
        (tmp_path / "b.jsonl").write_text(rows(("1", "x", "z")))
        return write(*args, **more)

    monkeypatch.setattr(flows.publish, "write_csv", meddle)
    with pytest.raises(RuleBroken) as e:
        flows.probe(spark, cases, str(tmp_path / "out"))
    assert e.value.rule == "changed_during_the_run" and "b.jsonl" in str(e.value)


def test_manifest_is_written_before_the_error(spark, tmp_path):
    kind = "library string, route string, treatment string, status string, n bigint"
    path = str(tmp_path / "m.csv")
    with pytest.raises(RunIncomplete) as e:
        flows.finish(spark.createDataFrame([("z", "r", "t", "complete", 1), ("b", "r", "t", "build_failed", None)], kind), path, ["library"])
    assert e.value.cells == ("b/r/t=build_failed",) and open(path).read().splitlines()[1] == "b,r,t,build_failed,0"
    assert flows.finish(spark.createDataFrame([("z", "r", "t", "complete", 1)], kind), path, ["library"]) == "complete=1"


def test_the_error_names_every_incomplete_cell(spark, tmp_path):
    path = str(tmp_path / "m.csv")
    records = spark.range(1500).selectExpr("format_string('l%04d', id) as library", "'r' as route", "'t' as treatment", "if(id % 3 = 0, 'complete', 'build_failed') as status")
    many = records.unionByName(records.withColumn("route", F.lit("s")))
    with pytest.raises(RunIncomplete) as e:
        flows.finish(many, path, ["library", "route"])
    assert e.value.cells == tuple(f"l{i:04d}/{r}/t=build_failed" for i in range(1500) if i % 3 for r in "rs")
    assert len(e.value.cells) == 2000 and all(c in str(e.value) for c in (e.value.cells[0], e.value.cells[-1], path))


def test_command_line(spark, project, tmp_path, capsys):
    path = project()
    assert main(["plan", "--config", path, "--route", "r1"]) == 0
    assert capsys.readouterr().out.splitlines()[0] == "Plan: 1 libraries; 1 routes; 1 treatments; 1 cells (1 runnable)"
    queue = str(tmp_path / "queue.csv")
    assert main(["plan", "--config", path, "--route", "r1", "--library", "nope", "--queue", queue]) == 1
    assert "nope" in open(queue).read()
    for wrong in (["plan", "--config", path], ["plan", "--config", path, "--route", "r1", "--priority", "3"]):
        with pytest.raises(SystemExit) as e:
            main(wrong)
        assert e.value.code == 2
    assert list(csv.DictReader(open(queue, newline="")))[0]["priority"] == "0"
    capsys.readouterr()
    assert main(["doctor", "--config", path]) == 0 and "ok   configuration: 1 libraries; 2 routes; 2 treatments" in capsys.readouterr().out
    assert main(["doctor", "--config", path + "x"]) == 1 and "FAIL configuration" in capsys.readouterr().out
    spark.createDataFrame([("z", "r", "t", "complete")], "library string, route string, treatment string, status string").write.parquet(str(tmp_path / "records"))
    assert main(["manifest", "--records", str(tmp_path / "records"), "--output", str(tmp_path / "m.csv")]) == 0 and capsys.readouterr().out == "complete=1\n"
