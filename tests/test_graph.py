"""Traversals on small graphs with cycles, collisions and empty input."""

from codequarry.operators import graph


def edges(spark, pairs):
    return spark.createDataFrame(pairs, "src string, dst string")


def seeds(spark, *nodes):
    return spark.createDataFrame([(n,) for n in nodes], "node string")


def rows(df):
    return sorted(map(tuple, df.collect()))


CYCLE = [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("b", "c")]


def test_reach_stops_on_cycles_and_keeps_least_depth(spark):
    assert rows(graph.reach(edges(spark, CYCLE), seeds(spark, "a"))) == [("a", "b", 1), ("a", "c", 2), ("a", "d", 3)]


def test_reach_respects_depth_and_many_seeds(spark):
    assert rows(graph.reach(edges(spark, CYCLE), seeds(spark, "a", "c"), 1)) == [("a", "b", 1), ("c", "a", 1), ("c", "d", 1)]


def test_reach_without_edges(spark):
    assert rows(graph.reach(edges(spark, []), seeds(spark, "a"))) == []


def test_chain_has_each_edge_at_least_depth(spark):
    assert rows(graph.chain(edges(spark, CYCLE), seeds(spark, "a"), 2)) == [("a", "b", 1), ("b", "c", 2)]


def test_shortest_paths_are_all_and_ordered(spark):
    e = edges(spark, [("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("a", "x"), ("x", "y"), ("y", "d")])
    assert rows(graph.shortest_paths(e, "a", "d", 5)) == [(["a", "b", "d"], 2), (["a", "c", "d"], 2)]
    assert rows(graph.shortest_paths(e, "d", "a", 5)) == []
    assert rows(graph.shortest_paths(e, "a", "d", 1)) == []


def test_tree_marks_circular_leaves(spark):
    got = rows(graph.tree(edges(spark, [("a", "b"), ("b", "a")]), "a", 5))
    assert got == [(["a"], "a", 0, False), (["a", "b"], "b", 1, False), (["a", "b", "a"], "a", 2, True)]


def test_cycles_are_rotated(spark):
    got = rows(graph.two_cycles_and_three(edges(spark, [("b", "a"), ("a", "b"), ("b", "c"), ("c", "a"), ("a", "a")])))
    assert got == [(["a", "b"], 2), (["a", "b", "c"], 3)]


def test_pagerank_adds_up_to_one_with_dangling_nodes(spark):
    r = graph.pagerank(edges(spark, [("a", "b"), ("b", "c"), ("b", "c")]), seeds(spark, "a", "b", "c", "z")).collect()
    assert abs(sum(x["rank"] for x in r) - 1) < 1e-9
    assert {x["node"]: x["inbound"] for x in r} == {"a": 0, "b": 1, "c": 2, "z": 0}


def test_dead_reasons(spark):
    e = edges(spark, [("main", "a"), ("x", "y"), ("y", "x"), ("p", "q")])
    got = rows(graph.dead(e, seeds(spark, "main", "a", "x", "y", "p", "q", "lone"), seeds(spark, "main")))
    assert got == [("lone", "orphan_no_callers_no_callees"), ("p", "no_callers_has_dead_callees"), ("q", "unreachable_from_entry"), ("x", "unreachable_from_entry"), ("y", "unreachable_from_entry")]


def test_hierarchy_summary(spark):
    assert rows(graph.hierarchy_summary(edges(spark, [("a", "b"), ("b", "c"), ("a", "d")]))) == [(4, 1, 2, 2)]


def test_components_of_cycles_equal_brute_force(spark):
    import random

    rng = random.Random(7)
    for n, m in ((12, 18), (15, 40), (10, 6)):
        pairs = {(rng.randrange(n), rng.randrange(n)) for _ in range(m)}
        reach = {a: {a} for a in range(n)}
        for _ in range(n):
            for a, b in pairs:
                for x in range(n):
                    if a in reach[x]:
                        reach[x].add(b)
        want = {a: min(both) for a in range(n) if len(both := {b for b in range(n) if b in reach[a] and a in reach[b]}) > 1}
        got = graph.scc(spark.createDataFrame([*pairs, (None, 1)], "src bigint, dst bigint"))
        assert {r["node"]: r["component"] for r in got.collect()} == want
    assert graph.scc(spark.createDataFrame([], "src bigint, dst bigint")).collect() == []


def test_flood_has_a_row_a_node(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (4, 3), (3, 5), (5, 1)], "src bigint, dst bigint")
    seeds = spark.createDataFrame([(1,), (4,), (4,)], "node bigint")
    assert sorted(map(tuple, graph.flood(e, seeds).collect())) == [(1, 0), (2, 1), (3, 1), (4, 0), (5, 2)]
    assert sorted(map(tuple, graph.flood(e, seeds, 1).collect())) == [(1, 0), (2, 1), (3, 1), (4, 0)]


def test_affected_tests(spark):
    e = spark.createDataFrame([("b.py", "a.py"), ("tests/t.py", "b.py"), ("pkg/test_c.py", "b.py"), ("c.py", "b.py"), ("d.spec.ts", "other.ts")], "src string, dst string")
    changed = spark.createDataFrame([("a.py",)], "file string")
    assert sorted(map(tuple, graph.affected_tests(e, changed).collect())) == [("pkg/test_c.py", 2), ("tests/t.py", 2)]
    assert [r["file"] for r in graph.affected_tests(e, changed, ["c.*"]).collect()] == ["c.py"]
