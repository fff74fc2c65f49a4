"""Parsers, streaming state, sets, ranges and scores."""

import json

import pytest
from pyspark.sql import functions as F

from codequarry.functions import text as tx
from codequarry.operators import metrics, quality, resolve, search, sets
from codequarry.sources import parsers
from codequarry.streaming import stateful


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_python_rows_and_broken_source():
    got = parsers.python_rows("m.py", "import os\nclass A(B):\n    def f(self, x):\n        if x:\n            return g(x)\n")
    assert [(r["kind"], r["name"], r["class"], r["complexity"]) for r in got] == [("import", "os", None, 0), ("class", "A", None, 0), ("method", "f", "A", 2)]
    assert parsers.python_rows("m.py", "def (")[0]["kind"] == "parse_failed"
    assert parsers.python_rows("m.py", None) == []


def test_filter_results(spark):
    d = spark.createDataFrame([("getName", "public"), ("setName", "private"), (None, "public")], "name string, visibility string")
    assert rows(parsers.filter_results(d, "name=~get*,visibility=public")) == [("getName", "public")]
    for bad in ("name", "nope=1"):
        with pytest.raises(ValueError):
            parsers.filter_results(d, bad)


def test_git_log_coverage_and_rules():
    assert parsers.git_log("commit abcdef1 12\n\na.py\nb.py\ncommit abcdef2 13\n") == [{"sha": "abcdef1", "epoch": 12, "files": ["a.py", "b.py"]}, {"sha": "abcdef2", "epoch": 13, "files": []}]
    assert parsers.coverage_lines(json.dumps({"files": {"a.py": {"executed_lines": [1, 3]}}})) == [("a.py", 1), ("a.py", 3)]
    text = "version: 1\nconstraints:\n  - id: r1\n    from: 'ui/**'\n    to: db/**\n    exceptions:\n      - ui/x.py\n"
    assert parsers.rules(text) == [{"id": "r1", "from": "ui/**", "to": "db/**", "exceptions": ["ui/x.py"]}]
    for bad in ("rules: 1", "constraints:\n  - id: r1\n"):
        with pytest.raises(ValueError):
            parsers.rules(bad)


def test_walk(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "node_modules").mkdir()
    for p in ("src/a.py", "src/b.txt", "node_modules/c.py"):
        (tmp_path / p).write_text("x = 1\n")
    got = parsers.walk(spark, str(tmp_path), ["py"]).select("path", "size").collect()
    assert [(r["path"].rsplit("/", 1)[1], r["size"]) for r in got] == [("a.py", 6)]


def test_globs():
    import re

    m = lambda g, p: bool(re.match(tx.glob_regex(g), p))
    assert m("src/*.py", "src/a.py") and not m("src/*.py", "src/x/a.py")
    assert m("src/**/a.py", "src/a.py") and m("src/**/a.py", "src/x/y/a.py") and m("src/**", "src/x/y") and not m("a?c", "a/c")


def test_words_strip_suffixes(spark):
    got = spark.range(1).select(tx.words(F.lit("parseUsersRunning_x/buses")).alias("w")).collect()[0]["w"]
    assert got == ["parse", "user", "runn", "bus"]  # what is left of a word has three letters or more


def test_content_modes(spark):
    f = spark.createDataFrame([(1, "a", "foo\nbar\nFoo"), (2, "b", "baz"), (3, "c", ""), (4, "d", None)], "id int, path string, content string")
    assert rows(search.content(f, "foo")) == [(1, "a", 1, "foo")]
    assert rows(search.content(f, "foo", case="smart", mode="per_file")) == [(1, "a", 2)]
    assert rows(search.content(f, "foo", mode="files_without")) == [(2, "b"), (3, "c")]
    assert rows(search.content(f, "ba.", mode="total")) == [(2, 2)]
    assert rows(search.content(f, "bar", context=1).select("id", "line_no", "hit")) == [(1, 1, False), (1, 2, True), (1, 3, False)]
    assert rows(search.content(f, "foo", case="insensitive", max_count=1)) == [(1, "a", 1, "foo")]
    with pytest.raises(ValueError):
        search.content(f, "x", mode="nope")


def test_enclosing_takes_the_tightest_span(spark):
    spans = spark.createDataFrame([(1, "f", 1, 200), (2, "f", 50, 60), (3, "g", 1, 2)], "span_id bigint, file string, line int, end_line int")
    points = spark.createDataFrame([(10, "f", 55), (11, "f", 100), (12, "g", 9), (13, "h", 1)], "point_id bigint, file string, line int")
    assert rows(resolve.enclosing(points, spans)) == [(10, 2, True), (11, 1, True), (12, 3, False), (13, None, False)]


def test_replace_edges_and_delta(spark):
    s = "src string, dst string, kind string, line int, file string"
    old = spark.createDataFrame([("a", "b", "calls", 1, "f"), ("c", "d", "calls", 1, "g")], s)
    fresh = spark.createDataFrame([("a", "x", "calls", 2, "f")], s)
    assert rows(sets.replace_edges(old, fresh, spark.createDataFrame([("f",)], "file string"))) == [("a", "x", "calls", 2, "f"), ("c", "d", "calls", 1, "g")]
    assert rows(sets.delta(old.select("src"), fresh.select("src"))) == [("c", "removed")]


def test_coverage_needs_a_body_line(spark):
    s = spark.createDataFrame([(1, "f", 1, 5), (2, "f", 7, 7), (3, "f", 8, 9)], "id int, file string, line int, end_line int")
    e = spark.createDataFrame([("f", 5), ("f", 7), ("f", 8)], "file string, line int")
    assert rows(quality.covered(s, e)) == [(1, True), (2, False), (3, False)]


def test_violations_and_exceptions(spark):
    e = spark.createDataFrame([("ui/a.py", "db/x.py"), ("ui/b.py", "db/x.py"), ("api/a.py", "db/x.py")], "caller_file string, callee_file string")
    rule = {"id": "r", "from": "ui/*", "to": "db/**", "exceptions": ["ui/b.py"]}
    assert rows(quality.violations(e, [rule])) == [("r", "error", "ui/a.py", "db/x.py", 1)]


READINGS = [("f", 1, 95.0, 0), ("f", 2, 40.0, 10), ("f", 3, 95.0, 20), ("f", 4, 40.0, 30), ("f", 5, 40.0, 5000), ("g", 6, 20.0, 0)]


def health(spark):
    return spark.createDataFrame(READINGS, "file string, id bigint, total double, t int").select("file", "id", "total", F.timestamp_seconds("t").alias("ts"))


def test_alerts_with_and_without_cooldown(spark):
    assert [r[0] for r in rows(metrics.alerts(health(spark)))] == [2, 4, 6]
    assert sorted(r["id"] for r in stateful.alerts_with_cooldown(health(spark), cooldown_s=60).collect()) == [2, 6]


def test_alert_stream_equals_its_batch_twin(spark, tmp_path):
    health(spark).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(health(spark).schema).parquet(str(tmp_path / "in"))
    q = stateful.alert_stream(stream, cooldown_s=60).writeStream.format("memory").queryName("alerts").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert rows(spark.table("alerts")) == rows(stateful.alerts_with_cooldown(health(spark), cooldown_s=60))


def test_debounce_and_subscriptions(spark):
    e = spark.createDataFrame([(1, 0), (1, 2), (1, 5), (2, 0)], "user_id int, t int").select("user_id", F.timestamp_seconds("t").alias("ts"))
    assert rows(stateful.debounced(e, 2).select("user_id", "events")) == [(1, 1), (1, 2), (2, 1)]
    state = {"rows": [("a", "f", 1)]}
    subs = stateful.Subscriptions(lambda s: spark.createDataFrame(state["rows"], "name string, file string, line int"), 5)
    subs.subscribe("s", "*", 0)
    assert subs.push(10) == {}
    state["rows"] = [("b", "f", 1)]
    assert subs.push(12) == {}
    assert [(r["name"], r["change"]) for r in subs.push(20)["s", "*"].orderBy("name").collect()] == [("a", "removed"), ("b", "added")]
    assert subs.unsubscribe("s", "*") and not subs.unsubscribe("s", "*")
