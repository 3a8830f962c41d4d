"""Fixtures of single rules and order traps."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from sigloom.functions import text as X
from sigloom.functions.hexes import address_text, hash_long, hash_text, unsigned_hex
from sigloom.operators import detect, manifest, matrix, planning, reconcile, requests, rules

HASH = "case string, entry string, full string, specific string, n bigint"


def cells(df, *cols):
    return [tuple(r[c] for c in cols) for r in df.collect()]


def one(spark, expr, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expr(F.col("x")).alias("y")).first()["y"]


# matrix


def test_matrix_fixture(spark):
    old = [("old", f"e{i}", f"f{i}", f"s{i}", i) for i in range(7)]
    new = [("new", "e0", "f0", "s0", 10), ("new", "e1", "f1", "other", 11), ("new", "e2", "other", "s2", 12), ("new", "e3", "f3", "s3", 13), ("new", "e9", "f9", "s9", 14)]
    m = matrix.compat_matrix(spark.createDataFrame(old + new, HASH), "case", "entry", "full", "specific", ["n"])
    row = m.where("reference_case = 'old' and comparison_case = 'new'").first()
    assert tuple(row)[2:] == (7, 5, 4, 3, 3, 2, "28.571429", "40.000000")
    assert m.where("reference_case = comparison_case and reference_retained_pct = '100.000000'").count() == 2


def test_matrix_last_row_wins_nulls_equal_and_pairs_without_overlap(spark):
    rows = [("a", "1", "x", None, 1), ("a", "1", "y", None, 2), ("b", "1", "y", None, 3), ("c", "9", None, None, 4), ("a", None, "z", "z", 5), ("b", "None", "z", "z", 6)]
    m = matrix.compat_matrix(spark.createDataFrame(rows, HASH), "case", "entry", "full", "specific", ["n"])
    got = {(r[0], r[1]): tuple(r)[2:] for r in m.collect()}
    assert got["a", "b"] == (2, 2, 2, 2, 2, 2, "100.000000", "100.000000")
    assert got["a", "c"] == (2, 1, 0, 0, 0, 0, "0.000000", "0.000000")
    assert len(got) == 9


def test_percentages_round_from_the_exact_value(spark):
    pairs = [(p, w) for w in (0, 3, 512, 2560, 64000) for p in (0, 1, 29, w)] + [(random.Random(0).randrange(512), 512)]
    df = spark.createDataFrame(pairs, "p bigint, w bigint").select("p", "w", X.percent_text("p", "w").alias("t"))
    assert all(r["t"] == ("0.000000" if r["w"] == 0 else f"{100.0 * r['p'] / r['w']:.6f}") for r in df.collect())
    assert spark.createDataFrame([(29, 64000)], "p bigint, w bigint").select(X.percent_text("p", "w")).first()[0] == "0.045312"


def test_case_counts_before_and_after_folding(spark):
    df = spark.createDataFrame([("a", "1"), ("a", "1"), ("a", "2"), ("b", None)], "case string, entry string")
    assert sorted(cells(matrix.case_counts(df, "case", "entry"), "case", "raw_rows", "hashable")) == [("a", 3, 2), ("b", 1, 1)]


def test_matrix_of_nothing(spark):
    assert matrix.compat_matrix(spark.createDataFrame([], HASH), "case", "entry", "full", "specific", ["n"]).count() == 0


# hexes and text


@pytest.mark.parametrize(
    ("text", "want"),
    [("FF", "00000000000000ff"), (" 0Xff\t", "00000000000000ff"), ("c5_75", "000000000000c575"), ("0" * 20 + "1", "0000000000000001"), ("0", "0" * 16), ("f" * 16, "f" * 16), ("f" * 17, None), ("n/a", None), ("", None), ("-", None), ("None", None), ("0x", None), ("12 34", None), ("ff\n", "00000000000000ff"), (None, None)],
)
def test_hash_text(spark, text, want):
    assert one(spark, hash_text, text) == want


@pytest.mark.parametrize(("text", "want"), [("0x0E0AE570", "0e0ae570"), ("2499e00", "02499e00"), ("123456789a", "123456789a"), (" odd ", "odd"), (None, None)])
def test_address_text(spark, text, want):
    assert one(spark, address_text, text) == want


def test_hash_long_is_a_bijection(spark):
    texts = ["0" * 16, "f" * 16, "8" + "0" * 15, "7" + "f" * 15, "00000000000000ff"]
    got = [one(spark, hash_long, t) for t in texts]
    assert got == [0, -1, -(2**63), 2**63 - 1, 255]
    assert [one(spark, unsigned_hex, v, "bigint") for v in got] == texts


@pytest.mark.parametrize(("text", "want"), [("  OrnKit \t x ", "ornkit x"), ("a\x1c\x1fb", "a b"), (" é ", "é"), ("", ""), (None, None)])
def test_normalise_request(spark, text, want):
    assert one(spark, X.normalise_request, text) == want


@pytest.mark.parametrize(("path", "name", "end", "bare"), [("a/b/x.so.1.2", "x.so.1.2", ".2", "x.so.1"), (".bashrc", ".bashrc", "", ".bashrc"), ("lib.a", "lib.a", ".a", "lib"), ("dir/", "dir", "", "dir"), ("x.", "x.", "", "x."), (".a.b", ".a.b", ".b", ".a")])
def test_paths(spark, path, name, end, bare):
    assert (one(spark, X.basename, path), one(spark, X.suffix, path), one(spark, X.stem, path)) == (name, end, bare)


def test_packed_lists(spark):
    assert one(spark, lambda c: X.unpack(c), "a;;b;") == ["a", "b"]
    assert one(spark, lambda c: X.unpack(c), "") == [] and one(spark, lambda c: X.unpack(c), None) == []
    assert one(spark, lambda c: X.unpack(c, "|"), "a|b") == ["a", "b"]


@pytest.mark.parametrize(("n", "want"), [(7, "0007"), (12345, "12345"), (0, "0000")])
def test_zero_padding_never_cuts(spark, n, want):
    assert one(spark, lambda c: X.zero_padded(c, 4), n, "int") == want


@pytest.mark.parametrize(("token", "want"), [("zlib", None), ("=cmd", "formula_marker"), ("@x", "formula_marker"), (" x", "outer_whitespace_or_empty"), ("", "outer_whitespace_or_empty"), (None, "outer_whitespace_or_empty"), ("a\x07b", "control_character"), ("x\n", "outer_whitespace_or_empty")])
def test_token_rules(spark, token, want):
    assert one(spark, X.token_violation, token) == want


@pytest.mark.parametrize(("value", "want"), [("zlib-1.3", True), ("../../src", False), ("zlib\n", False), ("", False), ("-x", False), (None, False)])
def test_safe_component(spark, value, want):
    assert one(spark, X.safe_component, value) is want


@pytest.mark.parametrize(("value", "want"), [("a/b", True), ("/a", False), ("a/../b", False), ("a..b", True), ("", False), (None, False)])
def test_member_paths(spark, value, want):
    assert one(spark, X.safe_member_path, value) is want


@pytest.mark.parametrize(("value", "want"), [("21.0.3", 21), ('openjdk version "1.8.0_1"', 8), ("23", 23), ("none", None)])
def test_java_major(spark, value, want):
    assert one(spark, X.dotted_major, value) == want


def test_first_separator_only(spark):
    df = spark.createDataFrame([("e500=PowerPC:BE:32:e500",), ("a=b=c",), ("alone",)], "t string")
    assert cells(df.select(X.first_part("t").alias("l"), X.second_part("t").alias("r")), "l", "r") == [("e500", "PowerPC:BE:32:e500"), ("a", "b=c"), ("alone", None)]


# planning


def recipe(name, version="1"):
    return (name, version)


def test_requests_resolve_under_three_keys(spark):
    recipes = spark.createDataFrame([recipe("zlib", "1.3"), recipe("bz", "1"), recipe("bz", "2")], "name string, version string")
    asked = spark.createDataFrame([(0, "zlib"), (1, "zlib@1.3"), (2, "bz"), (3, "none"), (4, None), (5, "bz-2")], "pos int, request string")
    assert sorted(cells(planning.resolve_requests(asked, "request", recipes), "pos", "version")) == [(0, "1.3"), (1, "1.3"), (2, "1"), (2, "2"), (5, "2")]
    assert sorted(cells(planning.missing_requests(asked, "request", recipes), "pos")) == [(3,), (4,)]
    assert cells(planning.ambiguous_keys(recipes), "request_key", "n_recipes") == [("bz", 2)]


def test_selection_keeps_order_and_repeats(spark):
    t = spark.createDataFrame([("a", 1), ("b", 2)], "id string, v int")
    assert cells(planning.select_in_order(t, "id", ["b", "a", "b"]).orderBy("pos"), "id") == [("b",), ("a",), ("b",)]
    assert cells(planning.unknown_ids(t, "id", ["z", "a", "y"]), "id") == [("y",), ("z",)]


def test_flags_keep_order_and_repeats(spark):
    df = spark.createDataFrame([(["-O2", "-g", "-O2", "-g"], ["-O2"], ["-O3"]), (["-g"], None, None), (None, ["-g"], ["-x"])], "f array<string>, r array<string>, a array<string>")
    assert cells(df.select(planning.flags_for(F.col("f"), F.col("r"), F.col("a")).alias("x")), "x") == [(["-g", "-g", "-O3"],), (["-g"],), (["-x"],)]


def test_plan_text(spark):
    lib = spark.createDataFrame([("zlib-1.3",)], "identifier string")
    routes = spark.createDataFrame([("r1",), ("r2",)], "route string")
    treatments = spark.createDataFrame([("t", ["r1"]), ("u", []), ("v", None)], "id string, supported_routes array<string>")
    plan = planning.plan_cells(lib, routes, treatments)
    assert planning.plan_summary(plan).first()["line"] == "Plan: 1 libraries; 2 routes; 3 treatments; 6 cells (5 runnable)"
    assert cells(plan.where("plan_status = 'unsupported'"), "route", "treatment") == [("r2", "t")]
    assert "- zlib-1.3 | r1 | t | runnable" in [r["line"] for r in planning.plan_lines(plan).collect()]


def test_environment_later_values_win(spark):
    df = spark.range(1).select(planning.allowed_environment(F.create_map(F.lit("PATH"), F.lit("p"), F.lit("CFLAGS"), F.lit("c"), F.lit("TZ"), F.lit("x")), ["PATH", "TZ"], {"TZ": "UTC", "LANG": "C"}, F.create_map(F.lit("LANG"), F.lit("de"))).alias("e"))
    assert df.first()["e"] == {"PATH": "p", "TZ": "UTC", "LANG": "de"}


def test_link_step_only_for_one_target(spark):
    df = spark.createDataFrame([("linux", "linker_transformation"), ("linux", "x"), ("windows", "x")], "os string, factor string")
    words = planning.link_command(F.col("os"), F.array(F.lit("cc")), F.array(F.lit("-g")), F.array(F.lit("a.a")), F.col("factor"), F.lit("o"))
    got = [r["w"] for r in df.select(words.alias("w")).collect()]
    assert got[0] == ["cc", "-g", "-shared", "-nostdlib", "-Wl,--whole-archive", "a.a", "-Wl,--no-whole-archive", "-Wl,--gc-sections", "-o", "o"]
    assert "-Wl,--gc-sections" not in got[1] and got[2] is None


# queue

ROWS = "request_seq bigint, library_request string, priority string, requested_routes string, last_requested_utc string"


def sequential(rows):
    out: dict = {}
    for _, library, priority, routes, at in sorted(rows):
        key = " ".join((library or "").strip().lower().split())
        if not key:
            continue
        p = int(priority) if priority and priority.strip().isdigit() else None
        mine = {r for r in (routes or "").split(";") if r}
        if key not in out:
            out[key] = [library.strip(), p, mine, at, at, 1]
        else:
            o = out[key]
            o[1] = p if o[1] is None else o[1] if p is None else min(o[1], p)
            o[2] |= mine
            o[4] = at
            o[5] += 1
    return {k: (v[0], v[1], ";".join(sorted(v[2])), v[3], v[4], v[5]) for k, v in out.items()}


@pytest.mark.parametrize("seed", range(3))
def test_fold_equals_a_sequential_loop(spark, seed):
    rnd = random.Random(seed)
    rows = [(i, rnd.choice(["OrnKit", " ornkit", "zlib", "Z  Lib", "", None]), rnd.choice(["0", "1", "2", "", None, "x"]), rnd.choice(["", "b;a", "c", None, ";a;"]), f"2020-01-{rnd.randrange(1, 28):02d}") for i in range(80)]
    got = requests.fold_requests(spark.createDataFrame(rows, ROWS), "request_seq", "library_request", "priority", "requested_routes", "last_requested_utc")
    assert {r["request_key"]: (r["library_request"], r["priority"], r["requested_routes"], r["first_requested_utc"], r["last_requested_utc"], r["request_count"]) for r in got.collect()} == sequential(rows)


def test_upsert_updates_the_last_duplicate_only(spark):
    base = dict.fromkeys(requests.COLUMNS, "")
    old = [base | {"library_request": "OrnKit", "priority": "2", "request_count": "1", "notes": "first", "o": 1}, base | {"library_request": "ornkit ", "priority": "2", "requested_routes": "r2;r1", "request_count": "3", "notes": "second", "o": 2}, base | {"library_request": "other", "o": 3}]
    existing = spark.createDataFrame(old, ", ".join(f"{c} string" for c in requests.COLUMNS) + ", o int")
    incoming = spark.createDataFrame([(1, "ORNKIT", "0", "r3", "t1"), (2, "new one", "1", "", "t2")], ROWS)
    merged = requests.upsert_requests(existing, "o", requests.fold_requests(incoming, "request_seq", "library_request", "priority", "requested_routes", "last_requested_utc"))
    got = {(r["library_request"], r["notes"]): (r["priority"], r["requested_routes"], r["request_count"], r["last_requested_utc"]) for r in merged.collect()}
    assert got == {("OrnKit", "first"): ("2", "", "1", ""), ("ornkit ", "second"): ("0", "r1;r2;r3", "4", "t1"), ("other", ""): ("", "", "", ""), ("new one", ""): ("1", "", "1", "t2")}


# reconciliation


def test_multiset_difference_counts_repeats_and_nulls(spark):
    a = spark.createDataFrame([("x",), ("x",), (None,), ("y",)], "m string")
    b = spark.createDataFrame([("x",), (None,), (None,), ("y",)], "m string")
    assert sorted(cells(reconcile.multiset_difference(a, b, ["m"]), "m", "n_left", "n_right"), key=str) == [("x", 2, 1), (None, 1, 2)]


def test_exactly_one(spark):
    e = spark.createDataFrame([("a",), ("b",), ("c",)], "n string")
    f = spark.createDataFrame([("a",), ("b",), ("b",)], "n string")
    assert sorted(cells(reconcile.match_counts(e, f, "n"), "n", "n_matches", "exactly_one")) == [("a", 1, True), ("b", 2, False), ("c", 0, False)]


@pytest.mark.parametrize(
    ("listed", "extracted", "want"),
    [(["a.o", "b.OBJ"], ["a.o", "b.OBJ"], None), (["a.o", "a.o"], ["a.o"], "duplicate_members"), (["d/a.o"], ["a.o"], "invalid_members"), (["a.txt"], ["a.txt"], "invalid_members"), ([None], [None], "no_objects"), (["a.o", "b.o"], ["a.o"], "not_reconciled"), (["a.o"], ["a.o", "x.txt"], "unexpected_entries")],
)
def test_archive_rules(spark, listed, extracted, want):
    mk = lambda names: spark.createDataFrame([("z", n) for n in names], "archive string, member string")
    assert reconcile.archive_violations(mk(listed), mk(extracted), "archive", "member").first()["violation"] == want


# rules


@pytest.mark.parametrize(
    ("counts", "expected", "want"),
    [((15, 124, 113, 11), 15, None), ((15, 124, 113, 10), 15, "not_reconciled"), ((15, 124, 113, 11), 14, "program_count"), ((15, None, 113, 11), 15, "invalid_counts"), ((15, -1, 0, 0), 15, "invalid_counts"), ((0, 1, 1, 0), 0, "empty"), ((15, 124, 113, 11), None, "no_expected_count"), ((15, 11, 0, 11), 15, "none_added")],
)
def test_population_rules(spark, counts, expected, want):
    df = spark.createDataFrame([(*counts, expected)], "program_count bigint, attempted bigint, added bigint, excluded bigint, e bigint")
    assert rules.first_violation(df, rules.population_rules(F.col("e"))).first()["violation"] == want


GOOD = {"schema_version": "fidb-recipe/v2", "name": "z", "version": "1", "url": "u", "sha256": "a" * 64, "source_directory": "z-1", "preferred_build_system": "make", "project_markers": ["m"], "allowed_build_systems": ["make"], "static_archives": ["z.a"]}


@pytest.mark.parametrize(
    ("change", "want"),
    [({}, None), ({"schema_version": "v1"}, "schema_version"), ({"name": None}, "missing_name"), ({"source_directory": "../x"}, "unsafe_source_directory"), ({"static_archives": ["a/b"]}, "unsafe_static_archive"), ({"sha256": "ab"}, "sha256_length"), ({"project_markers": []}, "incomplete_detection"), ({"preferred_build_system": "cmake"}, "preferred_not_allowed")],
)
def test_recipe_rules(spark, change, want):
    kind = ", ".join(f"{k} {'array<string>' if isinstance(v, list) else 'string'}" for k, v in GOOD.items())
    assert rules.first_violation(spark.createDataFrame([GOOD | change], kind), rules.recipe_rules()).first()["violation"] == want


def test_probe_cases(spark):
    df = spark.createDataFrame([("e500=PowerPC:BE:32:e500",), ("=x",), ("a/b=x",), ("alone",)], "t string")
    assert cells(rules.parse_cases(df, "t"), "label", "violation") == [("e500", None), ("", "not_label_and_id"), ("a/b", "label_characters"), ("alone", "not_label_and_id")]
    mk = lambda labels: spark.createDataFrame([(x,) for x in labels], "label string")
    assert [rules.case_set_violation(mk(x)).first()[0] for x in (["a"], ["a", "a"], ["a", "b"])] == ["too_few_cases", "repeated_labels", None]


def test_retry_rule(spark):
    df = spark.createDataFrame([(429, 0), (503, 1), (503, 2), (404, 0)], "code int, n int")
    assert cells(df.select(rules.http_retry(F.col("code"), F.col("n")).alias("r")), "r") == [(True,), (True,), (False,), (False,)]


# manifest and detection


def test_group_failure_is_all_or_nothing(spark):
    kind = "route string, treatment string, status string, error string, fidb_path string, fidb_bytes bigint, keep string, bad boolean"
    rows = [("r", "t", "complete", "", "p", 5, "k", False), ("r", "t", "built", "", "", 0, "k", True), ("r", "t", "build_failed", "e", "", 0, "k", False), ("r", "u", "complete", "", "p", 5, "k", False), ("s", "t", "unsupported", "", "", 0, "k", True)]
    got = manifest.fail_groups(spark.createDataFrame(rows, kind), ["route", "treatment"], F.col("bad"), F.lit("boom"))
    assert sorted(cells(got, "route", "treatment", "status", "error", "fidb_path", "fidb_bytes", "keep")) == [("r", "t", "build_failed", "e", "", 0, "k"), ("r", "t", "fid_failed", "boom", "", 0, "k"), ("r", "t", "fid_failed", "boom", "", 0, "k"), ("r", "u", "complete", "", "p", 5, "k"), ("s", "t", "unsupported", "", "", 0, "k")]


def test_rollup_text_and_incomplete(spark):
    df = spark.createDataFrame([("complete",), ("build_failed",), ("complete",)], "status string")
    assert manifest.rollup_text(df).first()["line"] == "build_failed=1, complete=2"
    assert cells(manifest.incomplete(df), "status") == [("build_failed",)]


def test_defaults_and_zip(spark):
    df = spark.createDataFrame([(None, None, None)], "a string, n bigint, status string")
    assert tuple(manifest.with_defaults(df).first()) == ("", 0, "requested")
    packed = spark.createDataFrame([("k", "a;b", "1;2"), ("l", "a", "1;2")], "k string, l string, r string")
    assert cells(manifest.zip_packed(packed, ["k"], "l", "r"), "k", "position", "l", "r") == [("k", 1, "a", "1"), ("k", 2, "b", "2")]


def test_single_row(spark):
    with pytest.raises(ValueError):
        manifest.single_row(spark.range(2))
    assert manifest.single_row(spark.range(1)).count() == 1


@pytest.mark.parametrize(
    ("paths", "want"),
    [(["example.h", "configure", "src/a.C"], None), (["configure", "a.c"], "missing_markers"), (["example.h", "configure", "go.mod", "a.c"], "unexpected_systems"), (["example.h", "Makefile", "a.c"], "preferred_not_detected"), (["example.h", "configure", "a.txt"], "no_language")],
)
def test_detection(spark, paths, want):
    listing = spark.createDataFrame([("p", x) for x in paths], "project string, path string")
    recipe_row = spark.createDataFrame([("p", ["example.h"], ["autoconf", "make"], "autoconf")], "project string, project_markers array<string>, allowed_build_systems array<string>, preferred_build_system string")
    row = detect.detect_projects(listing, recipe_row, "project", "path").first()
    assert row["violation"] == want
    if want is None:
        assert (row["languages"], row["evidence"]) == (["C"], ["configure"])


@pytest.mark.parametrize(("path", "want"), [("/p/work", True), ("/p", False), ("/p/", False), ("/p/./work/", True), ("/p/../x", False), ("/pwork", False), ("//p//a", True), (None, False)])
def test_paths_inside_a_root(spark, path, want):
    assert one(spark, lambda c: rules.strictly_inside(c, F.lit("/p/")), path) is want


def test_generated_roots(spark):
    df = spark.createDataFrame([("work", "/p/work", False), ("out", "/p/work/out", False), ("logs", "/p/logs", False), ("link", "/p/l", True), ("far", "/q", False)], "name string, path string, is_symlink boolean")
    assert dict(cells(rules.directory_violations(df, "/p"), "name", "violation")) == {"work": "overlapping_roots", "out": "overlapping_roots", "logs": None, "link": "symbolic_link", "far": "outside_project"}


def test_changed_inputs(spark):
    mk = lambda rows: spark.createDataFrame(rows, "path string, sha256 string")
    got = rules.changed_inputs(mk([("a", "1"), ("b", "1"), ("c", "1")]), mk([("a", "1"), ("b", "2"), ("d", "1")]))
    assert sorted(cells(got, "path")) == [("b",), ("c",), ("d",)]
