from __future__ import annotations

import csv
import hashlib
import json
import os

import pytest
from pyspark.sql import functions as F

from sigloom.operators.requests import COLUMNS
from sigloom.sources import publish, readers
from sigloom.streaming.queue import current_queue, merge_stream


def test_line_numbers_over_several_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\r\ntwo\n\nfour")
    (tmp_path / "b.txt").write_text("x\ny\n")
    got = sorted((r["path"][-5:], r["line_no"], r["value"]) for r in readers.lines(spark, str(tmp_path)).collect())
    assert got == [("a.txt", 1, "one"), ("a.txt", 2, "two"), ("a.txt", 3, ""), ("a.txt", 4, "four"), ("b.txt", 1, "x"), ("b.txt", 2, "y")]


def test_line_numbers_when_a_file_is_split(spark, tmp_path):
    (tmp_path / "big.txt").write_text("".join(f"line {i}\n" for i in range(1, 5001)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        rows = readers.lines(spark, str(tmp_path / "big.txt"))
        assert all(r["value"] == f"line {r['line_no']}" for r in rows.collect()) and rows.count() == 5000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_line_numbers_by_shuffle(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(readers, "MOST_SPLITS", 0)
    (tmp_path / "a.txt").write_text("one\ntwo\n")
    assert sorted((r["line_no"], r["value"]) for r in readers.lines(spark, str(tmp_path)).collect()) == [(1, "one"), (2, "two")]


def test_strict_json_lines(spark, tmp_path):
    p = tmp_path / "r.jsonl"
    p.write_text('{"library": "z", "added": 15}\n\n[1]\n{"added": 15.0}\n{"added": true}\n{"added": "15"}\nnot json\n')
    got = [(r["line_no"], r["library"], r["added"], r["problem"]) for r in readers.json_rows(spark, str(p), {"library": "string", "added": "bigint"}).orderBy("line_no").collect()]
    assert got == [(1, "z", 15, None), (3, None, None, "not_an_object"), (4, None, None, None), (5, None, None, None), (6, None, None, None), (7, None, None, "invalid_json")]


def test_properties(spark, tmp_path):
    p = tmp_path / "a.properties"
    p.write_text("# c=1\napplication.version = 12.1 \nx=a=b\napplication.version=12.2\nno separator\n")
    assert {r["key"]: r["value"] for r in readers.properties(spark, str(p)).collect()} == {"application.version": "12.2", "x": "a=b"}
    assert "# c" in {r["key"] for r in readers.properties(spark, str(p), comments=False).collect()}
    assert readers.required_properties(readers.properties(spark, str(p)), ["x", "b", "a"]) == ["a", "b"]


def test_worker_configuration_defaults(spark, tmp_path):
    doc = {"schema_version": "v", "requested_libraries": ["zlib", "bzip2"], "routes": [{"id": "r", "archiver": ["ar"], "compiler": ["cc"]}], "treatments": [{"id": "t"}, {"id": "u", "phase": "link", "supported_routes": ["r"]}], "profiles": {"p": ["u", "t"]}}
    (tmp_path / "w.json").write_text(json.dumps(doc, indent=1))
    got = readers.worker_configuration(spark, str(tmp_path / "w.json"))
    r = got["routes"].first()
    assert (r["ranlib"], r["compiler_flags"], r["ghidra_compiler_spec"]) == (["ar"], [], "default")
    assert [(t["id"], t["phase"], t["supported_routes"]) for t in got["treatments"].orderBy("pos").collect()] == [("t", "compile", []), ("u", "link", ["r"])]
    assert [(x["pos"], x["treatment"]) for x in got["profiles"].orderBy("pos").collect()] == [(0, "u"), (1, "t")]
    assert got["document"].first()["recipe_directory"] == "recipes"


def test_recipes_in_order_of_path(spark, tmp_path):
    for n in ("b", "a"):
        (tmp_path / f"{n}.json").write_text(json.dumps({"name": n, "sha256": "AB"}))
    (tmp_path / "x.txt").write_text("no")
    assert [(r["name"], r["sha256"]) for r in readers.recipes(spark, str(tmp_path)).collect()] == [("a", "ab"), ("b", "ab")]


def test_queue_round_trip_header_and_missing_file(spark, tmp_path):
    path = str(tmp_path / "q.csv")
    assert readers.request_queue(spark, path).count() == 0
    row = dict.fromkeys(COLUMNS, "") | {"library_request": 'needs "quoted", notes', "notes": "two\nlines"}
    publish.write_csv(spark.createDataFrame([row]).select(*COLUMNS), path)
    raw = open(path, newline="").read()
    assert raw.startswith(",".join(COLUMNS) + "\r\n") and '"needs ""quoted"", notes"' in raw
    assert list(csv.DictReader(open(path, newline="")))[0] == row
    assert readers.request_queue(spark, path).first()["notes"].replace("\r\n", "\n") == "two\nlines"
    (tmp_path / "bad.csv").write_text("a,b\n")
    with pytest.raises(ValueError):
        readers.request_queue(spark, str(tmp_path / "bad.csv"))


def test_publishing_refuses_empty_tables_and_leaves_no_trace(spark, tmp_path):
    with pytest.raises(ValueError):
        publish.write_csv(spark.createDataFrame([], "a string"), str(tmp_path / "m.csv"))
    assert list(tmp_path.iterdir()) == []


def test_json_tsv_and_document(spark, tmp_path):
    df = spark.createDataFrame([(2, "b"), (1, None)], "z int, a string")
    publish.write_json_lines(df, str(tmp_path / "x.jsonl"), ["z"])
    assert (tmp_path / "x.jsonl").read_text() == '{"a":null,"z":1}\n{"a":"b","z":2}\n'
    publish.write_tsv(df, str(tmp_path / "x.tsv"), ["z"])
    assert (tmp_path / "x.tsv").read_text() == "1\t\n2\tb\n"
    publish.write_document(df.where("z = 2"), str(tmp_path / "d.json"))
    assert (tmp_path / "d.json").read_text() == '{\n  "a": "b",\n  "z": 2\n}\n'
    assert sorted(p.name for p in tmp_path.iterdir()) == ["d.json", "x.jsonl", "x.tsv"]


def test_published_files_are_one_sorted_part_whatever_the_partitions(spark, tmp_path):
    path = str(tmp_path / "deep" / "m.csv")
    df = spark.range(5000).select((F.col("id") % 7).alias("g"), "id", F.lit('say "x", or\r\nnot').alias("t")).repartition(9)
    assert publish.write_csv(df, path, ["g", "id"], ["id", "t"]) == path
    rows = list(csv.reader(open(path, newline="")))
    assert rows[0] == ["id", "t"] and [int(r[0]) for r in rows[1:]] == sorted(range(5000), key=lambda i: (i % 7, i)) and {r[1] for r in rows[1:]} == {'say "x", or\r\nnot'}
    publish.write_csv(df.where("id < 2"), path, ["id"], ["id"])
    assert open(path, newline="").read() == "id\r\n0\r\n1\r\n" and os.stat(path).st_mode & 0o777 == 0o644
    publish.write_csv(df.limit(0), path, ["id"], allow_empty=True)
    assert open(path, newline="").read() == "g,id,t\r\n"
    assert publish.file_digest(spark, path) == hashlib.sha256(b"g,id,t\r\n").hexdigest()
    assert [p.name for p in (tmp_path / "deep").iterdir()] == ["m.csv"]


def test_a_failing_writer_leaves_the_old_file(spark, tmp_path):
    path = str(tmp_path / "m.csv")
    publish.write_csv(spark.range(1), path)
    with pytest.raises(Exception, match="stop"):
        publish.write_csv(spark.range(3).select(F.expr("if(id = 2, raise_error('stop'), id)").alias("id")), path, ["id"])
    assert open(path, newline="").read() == "id\r\n0\r\n" and [p.name for p in tmp_path.iterdir()] == ["m.csv"]


def test_fingerprints_of_texts(spark, tmp_path):
    (tmp_path / "a").write_text("x\ny\n")
    (tmp_path / "b").write_text("y\nx\n")
    prints = readers.fingerprints(spark, [str(tmp_path / "a"), str(tmp_path / "b")])
    assert len(set(prints.values())) == 2 and prints == readers.fingerprints(spark, [str(tmp_path / "b"), str(tmp_path / "a")])


def test_tsv_rows(spark, tmp_path):
    (tmp_path / "l.tsv").write_text("# c\n\nz\t1\tv\t/f\t/p\nz\t1\n")
    assert [(r["line_no"], r["library"], r["problem"]) for r in readers.tsv_rows(spark, str(tmp_path / "l.tsv")).orderBy("line_no").collect()] == [(3, "z", None), (4, "z", "wrong_field_count")]


def test_listing_and_digests(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.o").write_bytes(b"abc")
    assert [(r["path"][-5:], r["length"]) for r in readers.listing(spark, str(tmp_path)).collect()] == [("d/a.o", 3)]
    assert readers.digests(spark, str(tmp_path), "*.o").first()["sha256"] == hashlib.sha256(b"abc").hexdigest()


def test_stream_of_requests(spark, tmp_path):
    src, state, check = (str(tmp_path / n) for n in ("in", "queue", "check"))
    schema = "request_seq bigint, library_request string, priority string, requested_routes string, last_requested_utc string"
    spark.createDataFrame([(1, "OrnKit", "2", "b", "t1"), (2, "zlib", "1", "", "t2")], schema).write.parquet(f"{src}/1")
    stream = lambda: spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(src)
    merge_stream(stream(), state, check).awaitTermination()
    spark.createDataFrame([(3, "ornkit", "0", "a", "t3")], schema).write.parquet(f"{src}/2")
    merge_stream(stream(), state, check).awaitTermination()
    got = {r["library_request"]: (r["priority"], r["requested_routes"], r["request_count"], r["last_requested_utc"]) for r in current_queue(spark, state).collect()}
    assert got == {"OrnKit": ("0", "a;b", "2", "t3"), "zlib": ("1", "", "1", "t2")}
    # old versions go, places stay
    for n in (3, 4):
        spark.createDataFrame([(n + 5, f"new{n}", "1", "", "t")], schema).write.parquet(f"{src}/{n}")
        merge_stream(stream(), state, check).awaitTermination()
    assert sorted(p for p in os.listdir(state)) == ["version=2", "version=3"]
    places = spark.read.parquet(f"{state}/version=3").orderBy("place").select("library_request", "place.batch").collect()
    assert [tuple(r) for r in places] == [("OrnKit", 0), ("zlib", 0), ("new3", 2), ("new4", 3)]
