"""The two query languages: reading, errors, and results on a small project."""

import pytest

from codequarry.plans import chain, selector

SYMBOLS = [
    (1, "run", "function", "src/a.py", "python", None, 1, 9, 4),
    (2, "run", "function", "src/b.go", "go", None, 1, 9, 4),
    (3, "App", "class", "src/a.py", "python", None, 10, 90, 0),
    (4, "start", "method", "src/a.py", "python", "App", 12, 20, 12),
    (5, "stop", "method", "src/a.py", "python", "App", 21, 30, 2),
    (6, "test_run", "function", "tests/test_a.py", "python", None, 1, 5, 1),
]
CALLS = [(4, 1), (6, 1), (1, 5), (6, 4)]


@pytest.fixture(scope="module")
def symbols(spark):
    return spark.createDataFrame(SYMBOLS, "id bigint, name string, kind string, file string, language string, class string, line int, end_line int, complexity int").cache()


@pytest.fixture(scope="module")
def compiler(spark, symbols):
    by = {s[0]: s for s in SYMBOLS}
    e = [("calls", by[a][1], by[a][3], by[b][1], by[b][3]) for a, b in CALLS] + [("contains", "App", None, "start", None), ("imports", "a", "src/a.py", "os.path", None)]
    return selector.Compiler(symbols, spark.createDataFrame(e, "kind string, src_name string, src_file string, dst_name string, dst_file string"))


@pytest.mark.parametrize(
    ("text", "ids"),
    [
        ("#run", {1, 2}), (".function", {1, 2, 4, 5, 6}), (".method", {4, 5}), (".struct", {3}), ("*", {1, 2, 3, 4, 5, 6}),
        (".function[language=python]", {1, 4, 5, 6}), ("*[file=tests]", {6}), ("*[owner=x]", set()),
        ("*:calls(#run)", {4, 6}), ("#run:called-by(.method)", {1}), ("#stop:callees(#run)", {5}),
        (".class:has(#start)", {3}), ("*:not(.function)", {3}), ("*:in(tests/)", {6}), ("*:imports(path)", {1, 3, 4, 5}),
        (".method:first-child", {4}), (".method:nth-child(2)", {5}), (".method:only-child", set()),
        (".class > .method", {4, 5}), (".class .method", {4, 5}), ("#start ~ .method", {4, 5}), ("#run, #App", {1, 2, 3}),
    ],
)
def test_selector(compiler, text, ids):
    assert {r["id"] for r in compiler.select(text).collect()} == ids


@pytest.mark.parametrize("text", ["", "run", "#", ".function[", "*:calls(", "*:nope(#a)", "#a,", "#a >", "*)"])
def test_selector_errors(compiler, text):
    with pytest.raises(selector.SelectorError):
        compiler.select(text)


@pytest.fixture(scope="module")
def engine(spark, symbols):
    return chain.Engine(symbols, spark.createDataFrame(CALLS, "src bigint, dst bigint"))


@pytest.mark.parametrize(
    ("text", "ids"),
    [
        ("search('run')", [1, 2]), ("search(['run', 'App'])", [1, 2, 3]), ("search('run').callers()", [4, 6]),
        ("search('run').callers(depth=2).exclude(test=true)", [4]), ("search('run').callees(1)", [5]), ("search('run').related()", [4, 5, 6]),
        ("search('run').filter(language='go')", [2]), ("search('run').not(language='go')", [1]), ("search('run').filter()", [1, 2]),
        ("search('run').has(callers=true, kind='method')", [1]), ("search(['start', 'stop']).sort(by='complexity', desc=true).take(1)", [4]),
        ("search('run').filter(regex='^src/.*go$')", [2]), ("search('run').take(0)", []), ("run", [1, 4, 5, 6]),
    ],
)
def test_chain(engine, text, ids):
    assert sorted(r["id"] for r in engine.run(text).collect()) == ids


@pytest.mark.parametrize("text", ["", "nope('x')", "search('x', depth=1)", "a | b", "search(open('x'))", "filter(name='x')", "search('x').take(-1)", "search('x').has(kind='a')", "search('" + "x" * 200 + "')", "search('x')" + ".related()" * 20, "search('x'"])
def test_chain_errors(engine, text):
    with pytest.raises(chain.ChainError):
        engine.run(text)


def test_chain_keywords_and_facets(engine, spark, symbols):
    ids = lambda text: sorted(r["id"] for r in engine.run(text).collect())
    assert ids("search(query='run').take(limit=1)") == [1] and ids("search('run').related(depth=1, limit=5)") == [4, 5, 6] and ids("search('stop').has(callers=true, depth=2, test=true)") == [5]
    got = {r["id"]: r for r in engine.run("search(['run', 'start']).include(complexity=true, risk=true, affected_tests=true, callers=true)").collect()}
    assert {i: (r["fan_in"], r["grade"], r["risk"], r["affected_tests"]) for i, r in got.items()} == {1: (2, "A", "ok", ["tests/test_a.py"]), 2: (0, "A", "ok", []), 4: (1, "A", "review", ["tests/test_a.py"])}
    engine.run("search(['run', 'start', 'stop']).uml(direction='TB', max_edges=1).answer(compact=true)")
    assert [(r["src"], r["dst"], r["direction"]) for r in engine.facets["uml"].collect()] == [(1, 5, "TB")] and engine.facets["compact"]
    engine.run("explore('run', max_files=1)")
    assert engine.facets["files"].count() == 1
    files = spark.createDataFrame([("src/b.go", "one\ntwo")], "file string, content string")
    full = chain.Engine(symbols, engine.calls, files)
    assert [r["source"] for r in full.run("search('run').filter(language='go').with('source')").collect()] == ["one\ntwo"]
    for bad in ("search('run').include('nothing')", "search('run').include(source=true)", "search('run').sort(by='nothing')", "search('run').callers(depth=0)", "search('run').take(limit='x')", "semantic()"):
        with pytest.raises(chain.ChainError):
            engine.run(bad)
