"""Scores, scanners and differences against rows worked out by hand."""

import pytest
from pyspark.sql import functions as F

from codequarry.functions import text as tx
from codequarry.operators import metrics, quality
from codequarry.sources import fixtures as fx


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def files(spark, *parts):
    return spark.createDataFrame([(i, p, g, c) for i, (p, g, c) in enumerate(parts)], "id int, path string, language string, content string")


def test_weights_add_up():
    assert sum(quality.HEALTH_WEIGHTS.values()) == 100 and quality.HEALTH_WEIGHTS["structure"] == 15 and quality.HEALTH_WEIGHTS["coverage"] == 10


@pytest.mark.parametrize(
    ("path", "chain", "index"),
    [
        ("tests/a.py", False, True), ("src/tests/a.py", True, True), ("src/spec/a.rb", False, True), ("test_a.py", True, True), ("pkg/test_a.py", True, False), ("test_support/a.py", False, False),
        ("a_test.go", True, True), ("a_test.java", True, False), ("A.SPEC.TS", True, True), ("a.test.jsx", False, True), ("fixtures/x.go", False, True), ("src\\\\test\\\\A.java", True, True), ("testdata/x", False, True), ("latest/a.py", False, False),
    ],
)
def test_test_paths(spark, path, chain, index):
    r = spark.range(1).select(tx.is_test_path(F.lit(path)).alias("a"), tx.is_test_path_canonical(F.lit(path)).alias("b")).collect()[0]
    assert (r["a"], r["b"]) == (chain, index)


@pytest.mark.parametrize(("text", "n"), [("f()", 0), ("f( )", 0), ("f(a)", 1), ("f(Map<K, List<Pair<V, W>>> b, int c)", 2), ("f(a, b, c)", 3), ("no brackets", 0)])
def test_parameters(spark, text, n):
    assert spark.range(1).select(tx.param_count(F.lit(text)).alias("n")).collect()[0]["n"] == n


@pytest.mark.parametrize(("text", "name"), [("public static int go(int a) {", "go"), ("List<int> all(x)", "all"), ("def f(x):", "f"), ("function g(x) {", "g"), ("class A {", "unknown"), ("x = 1", "unknown")])
def test_declared_names(spark, text, name):
    assert spark.range(1).select(tx.name_of(F.lit(text)).alias("n")).collect()[0]["n"] == name


def test_copies_with_other_names_and_comments_have_one_fingerprint(spark):
    texts = ['def f(a):\n    """Doc."""\n    return a + 1  # note\n', "def  g( b ):\n\n    return b+1\n", "/* c */ def f(a): return a + 1 // d", "def f(a): return a + 2"]
    got = [r["f"] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(tx.fingerprint(F.col("t")).alias("f")).collect()]
    assert got[0] == got[1] == got[2] != got[3]


def test_blocks_of_three_lines(spark):
    ten = "\n".join(["a", " b", "c", "a", "b ", "c", "", "", "", "d"])
    nine = "\n".join(["a", "b", "c"] * 3)
    got = metrics.duplicate_blocks(files(spark, ("x", "", ten), ("y", "", nine), ("z", "", ""), ("e", "", "\n" * 12)))
    assert rows(got) == [(0, 6, 1), (1, 0, 0), (2, 0, 0), (3, 0, 0)]


def test_docstring_lines(spark):
    text = ['"""one line"""', "x", '"""', "inside", "'''", '"""', "y = '''a", "b'''", "z"]
    got = spark.createDataFrame([(text,)], "v array<string>").select(quality.docstring_lines(F.col("v")).alias("d")).collect()[0]["d"]
    assert got == [1, 3, 4, 5, 6, 7, 8]


def test_programs_hold_what_is_listed(spark):
    many = [(p, g) for p in range(len(fx.PROGRAMS)) for g in ("python", "java", "go", "javascript", "typescript", "rust", "english")]
    f = files(spark, *[("src/a", g, "x = 1\n" + fx.PROGRAMS[p] + "\n") for p, g in many])
    got = {(*many[i], issue, severity, n) for i, issue, severity, n in rows(quality.security(f))}
    want = {(p, g, i, s, n) for p, gs, i, s, n in fx.FOUND_SECURITY for g in gs.split()} | {(0, g, "hardcoded_secret", "critical", 2) for g in ("rust", "english")}
    assert got == want
    assert {(*many[i], r, n) for i, r, n in rows(quality.anti_patterns(f))} == {(p, g, r, n) for p, gs, r, n in fx.FOUND_ANTI_PATTERNS for g in gs.split()}


def test_security_in_tests_and_strings(spark):
    f = files(spark, ("tests/a.py", "python", "assert x\neval(y)"), ("a.py", "python", "t = 'it''s' + eval(z)\nu = \"\\\" eval(z)\"\nv = 1  # assert x"), ("b.py", "python", None), ("c.py", "python", ""))
    assert rows(quality.security(f)) == [(0, "eval_usage", "critical", 2), (1, "eval_usage", "critical", 1)]


def test_print_counts_within_thirty_lines_of_a_def(spark):
    f = files(spark, ("a.py", "python", "def f():\n" + "    x\n" * 28 + "    print(1)\n    print(2)\n"), ("b.py", "python", "# print(\n'''\ndef g(x=[]): print(3)\n'''\n"))
    assert rows(quality.anti_patterns(f)) == [(0, "AP003", 30)]


def test_unreachable_statements():
    source = "def f(x):\n    while x:\n        break\n        a()\n    try:\n        raise E\n        b()\n    except E:\n        return 1\n        c()\n    exit()\n    d()\n    pass\nif True:\n    e()\nelse:\n    g()\n"
    assert [(u["function"], u["start"]) for u in quality.unreachable(source)] == [("f", 4), ("f", 7), ("f", 10), ("f", 12), ("", 17)]
    assert quality.unreachable("def (") == quality.unreachable(None) == []


def test_priorities_of_untested_symbols(spark):
    s = spark.createDataFrame([(1, "A", "class", None, 1), (2, "f", "function", None, 21), (3, "m", "method", "A", 6), (4, "g", "function", None, 2), (5, "h", "function", None, 3)], "id int, name string, kind string, class string, complexity int")
    got = quality.untested(s, spark.createDataFrame([("h",), (None,)], "target string"))
    assert rows(got) == [(1, 5, "medium"), (2, 31, "critical"), (3, 11, "critical"), (4, 2, "low")]


def test_smells_of_symbols(spark):
    s = spark.createDataFrame([(0, "class", 1, 301), (0, "function", 1, 51), (0, "method", 1, 101), (1, "class", 1, 600), (1, "class", 1, 2)], "id int, kind string, line int, end_line int")
    f = files(spark, ("a", "", "TODO\n" * 6), ("b", "", "x"))
    assert rows(quality.smells(f, s)) == [(0, "god_class", "warning"), (0, "long_method", "critical"), (0, "long_method", "warning"), (0, "technical_debt", "info")]


@pytest.mark.parametrize(
    ("path", "node", "change", "name", "preview", "want"),
    [
        ("conftest.py", "function", "added", "f", "", ("test_change", 0.9)), ("a/readme.md", "function", "added", "f", "", ("documentation", 0.9)), ("a.py", "import", "added", "f", "", ("import_change", 0.85)),
        ("a.py", "function", "signature_changed", "f", "", ("api_change", 0.85)), ("a.py", "function", "signature_changed", "_f", "export _f", ("api_change", 0.6)), ("a.py", "function", "signature_changed", "_f", "", ("refactor", 0.7)),
        ("a.py", "function", "renamed", "__f", "", ("api_change", 0.8)), ("a.py", "class", "removed", None, "", ("feature_removal", 0.7)), ("a.py", "variable", "removed", "f", "", ("internal_change", 0.5)), (None, "class", "moved", "f", None, ("unknown", 0.3)),
    ],
)
def test_classified_changes(spark, path, node, change, name, preview, want):
    d = spark.createDataFrame([(path, node, change, name, preview)], "path string, node string, change string, name string, preview string")
    c, p = quality.classify_change(*[F.col(x) for x in d.columns])
    assert tuple(d.select(c.alias("c"), p.alias("p")).collect()[0]) == want


def test_diff_matches_by_name_then_by_members(spark):
    schema = "file string, pos int, kind string, name string, signature string, body string, digest string, members array<string>"
    old = [("f", 1, "function", "a", "s", "b", "1", []), ("f", 2, "function", "a", "s", "b", "2", []), ("f", 3, "class", "C", "s", "b", "3", ["x", "y"]), ("f", 4, "class", "D", "s", "b", "4", ["x"]), ("f", 5, "import", None, "s", "b", "5", []), ("f", 6, "method", "m", "s", "b", "6", []), ("f", 7, "variable", "v", "s", "b", "7", ["q"])]
    new = [("f", 1, "function", "a", "s", "b", "1", []), ("f", 2, "class", "E", "s", "b", "8", ["x"]), ("f", 3, "class", "G", "s", "b", "9", ["x", "y"]), ("f", 4, "method", "m", "t", "c", "6b", []), ("f", 5, "variable", "w", "s", "b", "7b", ["q"])]
    got = {(r["kind"], r["old_name"], r["new_name"]): r["change"] for r in quality.diff(spark.createDataFrame(old, schema), spark.createDataFrame(new, schema)).collect()}
    assert got == {
        ("function", "a", "a"): "unchanged", ("function", "a", None): "removed", ("class", "C", "G"): "renamed", ("class", "D", "E"): "renamed", ("import", None, None): "removed",
        ("method", "m", "m"): "signature_changed", ("variable", "v", None): "removed", ("variable", None, "w"): "added",
    }


def test_hierarchy_risk_stops_at_a_hundred(spark):
    r = spark.range(1).select(quality.hierarchy_risk(F.lit(20), F.lit(50), F.lit(9)).alias("a"), quality.hierarchy_risk(F.lit(1), F.lit(1), F.lit(1)).alias("b")).collect()[0]
    assert (r["a"], r["b"]) == (90, 3)


@pytest.mark.parametrize(("down", "grade", "tests", "init", "edit", "deps", "want"), [(20, "A", 1, False, "fix_bug", 0, "safe"), (21, "A", 1, False, "fix_bug", 0, "caution"), (6, "A", 1, False, "refactor", 0, "caution"), (5, "A", 1, False, "refactor", 0, "safe"), (6, "D", 0, False, "fix_bug", 0, "dangerous"), (0, "A", 0, False, "rename", 11, "caution")])
def test_safe_edits(spark, down, grade, tests, init, edit, deps, want):
    assert spark.range(1).select(quality.safe_edit(*map(F.lit, (down, grade, tests, init, edit, deps))).alias("v")).collect()[0]["v"] == want


def test_cochange_with_targets_and_large_commits(spark):
    c = spark.createDataFrame([(s, f) for s, fs in {"1": "abc", "2": "ab", "3": "ab", "4": "abcdefgh"}.items() for f in fs], "sha string, file string")
    everything = {(r["file_a"], r["file_b"]): (r["shared"], r["lift"]) for r in metrics.cochange(c, 2).collect()}
    assert everything[("a", "b")] == (4, 1.0) and everything[("a", "c")] == (2, 1.0)
    assert rows(metrics.cochange(c, 2, targets=spark.createDataFrame([("c",)], "file string")).select("file_a", "file_b")) == [("a", "c"), ("b", "c")]
    assert rows(metrics.cochange(c, 2, max_files=3).select("file_a", "file_b", "shared")) == [("a", "b", 3)]
