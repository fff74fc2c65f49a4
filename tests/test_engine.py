"""The facade over one small project."""

import pytest

from codequarry.engine import Project

SYMBOLS = [(1, "run", "function", "src/a.py", "python", None, 1, 9, 4), (2, "start", "method", "src/a.py", "python", "App", 12, 20, 12), (3, "test_run", "function", "tests/test_a.py", "python", None, 1, 5, 1), (4, "lost", "function", "src/b.py", "python", None, 1, 5, 30)]


@pytest.fixture(scope="module")
def project(spark):
    s = spark.createDataFrame(SYMBOLS, "id bigint, name string, kind string, file string, language string, class string, line int, end_line int, complexity int")
    return Project(
        s, spark.createDataFrame([(2, 1), (3, 2)], "src bigint, dst bigint"), spark.createDataFrame([("src/a.py", "src/b.py")], "src string, dst string"),
        spark.createDataFrame([(1, "src/a.py", "python", "one\npassword = 'abcdefgh'\nthree")], "id bigint, path string, language string, content string"),
        spark.createDataFrame([("calls", "start", "src/a.py", "run", "src/a.py")], "kind string, src_name string, src_file string, dst_name string, dst_file string"),
    )


def names(df):
    return [r["name"] for r in df.collect()]


def test_actions(project):
    assert names(project.search.symbol("run")) == ["run", "test_run"]
    assert names(project.search.query("start")) == ["start"]
    assert names(project.search.select("*:calls(#run)")) == ["start"]
    assert names(project.search.chain("search('run').callers()")) == ["start"]
    assert names(project.nav.callers("run", 2)) == ["start", "test_run"] and names(project.nav.test_map("run")) == ["test_run"] and names(project.nav.impact("run")) == ["start"]
    assert [r["path"] for r in project.nav.call_path(3, 1).collect()] == [[3, 2, 1]]
    assert names(project.structure.outline("src/a.py")) == ["run", "start"]
    assert [r["line"] for r in project.structure.read("src/a.py", 1, 1).collect()] == ["one"]
    assert {r["node"]: r["reason"] for r in project.health.dead().collect()} == {4: "orphan_no_callers_no_callees"}
    assert [r["rule"] for r in project.health.patterns().collect()] == ["hardcoded_secret"]
    assert [(r["file_a"], r["file_b"], r["score"]) for r in project.health.matrix().orderBy("file_a").collect()] == [("src/a.py", "src/b.py", 2.0), ("src/a.py", "tests/test_a.py", 1.0)]
    assert project.health.unreachable().collect() == [] and project.health.cycles().collect() == [] and project.health.affected_tests(project.imports.selectExpr("dst as file")).collect() == []
    assert project.health.constraints([{"id": "r", "from": "tests/**", "to": "src/*"}]).count() == 1


def test_edit_index_and_drawings(project, spark):
    assert {r["file"]: (r["downstream"], r["verdict"]) for r in project.edit.safe("rename").collect()} == {"src/a.py": (1, "caution"), "src/b.py": (0, "dangerous"), "tests/test_a.py": (0, "caution")}
    schema = "file string, pos int, kind string, name string, signature string, body string, digest string, members array<string>"
    old = spark.createDataFrame([("a.py", 1, "function", "f", "s", "b", "1", [])], schema)
    new = spark.createDataFrame([("a.py", 1, "function", "f", "t", "b", "2", []), ("a.py", 2, "class", "C", "s", "b", "3", [])], schema)
    assert sorted((r["change"], r["category"], r["confidence"]) for r in project.edit.diff(old, new).collect()) == [("added", "feature_addition", 0.8), ("signature_changed", "api_change", 0.85)]
    assert project.viz.calls().split("\n")[0] == "flowchart LR" and '"start"' in project.viz.calls() and project.viz.imports("TB").count("-->") == 1
    assert project.viz.graph_json().count() == 6 and project.index.audit().first()["total"] == 2
    assert sorted((r["section"], r["other"]) for r in project.nav.xref("start").collect()) == [("callee", "run"), ("caller", "test_run"), ("definition", "start"), ("dependent", "src/a.py")]


def test_actions_need_their_tables(project):
    bare = Project(project.symbols, project.calls)
    for action in (lambda: bare.search.content("x"), lambda: bare.search.select("*"), lambda: bare.health.deps()):
        with pytest.raises(ValueError):
            action()
