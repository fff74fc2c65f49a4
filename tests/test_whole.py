"""Queries over whole graphs on tables where a bound would show."""

import re
from itertools import product

import duckdb
import pytest

from codequarry.operators import graph
from codequarry.registry import ORACLES, QUERIES
from codequarry.sources import fixtures as fx

DIR = "/root/testdata/sf0.001"


def test_all_imports_count(spark):
    from codequarry.sources import fixtures as fx

    edges = {(r["src"], r["dst"]) for r in fx.imports(spark, DIR).collect()}
    out = {s: sum(a == s for a, _ in edges) for s, _ in edges}
    assert max(out.values()) > 2
    assert {r["module"]: r["dependencies"] for r in QUERIES["g_deps"](spark, DIR).collect()} == out


def test_tree_and_cycles_with_three_edges_out_equal_brute_force(spark):
    nodes = "abcd"
    pairs = [(a, b) for a, b in product(nodes, nodes) if a != b and (a, b) != ("d", "a")]
    e = spark.createDataFrame(pairs, "src string, dst string")
    walks, level = {("a",)}, {("a",)}
    for _ in range(4):
        level = {(*w, b) for w in level if len(set(w)) == len(w) for a, b in pairs if a == w[-1]}
        walks |= level
    assert {tuple(r["path"]) for r in graph.tree(e, "a", 4).collect()} == walks
    has = set(pairs)
    cycles = {(a, b) for a, b in pairs if a < b and (b, a) in has} | {(a, b, c) for a, b in pairs for c in nodes if a < b and a < c and b != c and (b, c) in has and (c, a) in has}
    assert {tuple(r["cycle"]) for r in graph.two_cycles_and_three(e).collect()} == cycles


def chain_of_calls(spark, path, first, n):
    """Tables in which parts first, first + 1, ... call the next one, and the first one's file is a test."""
    parts = [(first + k, f"p{k}", "STANDARD", 10 if k == 0 else 2, "Brand#1") for k in range(n)]
    spark.createDataFrame(parts, "p_partkey bigint, p_name string, p_type string, p_size int, p_brand string").write.parquet(f"{path}/part.parquet")
    spark.createDataFrame([(1, k, first + k) for k in range(n)], "l_orderkey bigint, l_linenumber int, l_partkey bigint").write.parquet(f"{path}/lineitem.parquet")
    return str(path)


def test_dead_code_follows_calls_for_twenty_hops(spark, tmp_path):
    d = chain_of_calls(spark, tmp_path, 1, 23)
    assert {r["node"] for r in QUERIES["g_reachable_dead"](spark, d).collect()} == {22, 23}


def test_blast_of_functions_goes_five_hops(spark, tmp_path):
    d = chain_of_calls(spark, tmp_path, 243, 8)
    assert sum(r["functions"] for r in QUERIES["g_blast_functions"](spark, d).collect()) == 5


def test_every_symbol_has_a_place(spark):
    n = spark.read.parquet(f"{DIR}/part.parquet").count()
    assert n > 100
    assert sorted(r["place"] for r in QUERIES["rank_source_pref"](spark, DIR).collect()) == list(range(1, n + 1))


def calls_of_one_ref_id(spark, path):
    """Tables of two calls whose ids (caller * 1000003 + callee) are the same, and a third one."""
    parts = [(k, name, "MEDIUM", 5, brand) for k, name, brand in [(5, "run", "Brand#1"), (1000010, "gone", "Brand#2"), (6, "walk", "Brand#3"), (7, "gone", "Brand#1"), (8, "gone", "Brand#2")]]
    spark.createDataFrame(parts, "p_partkey bigint, p_name string, p_type string, p_size int, p_brand string").write.parquet(f"{path}/part.parquet")
    lines = [(1, 1, 5), (1, 2, 1000010), (2, 1, 6), (2, 2, 7), (3, 1, 5), (3, 2, 1000010), (4, 1, 8), (4, 2, 5)]
    spark.createDataFrame(lines, "l_orderkey bigint, l_linenumber int, l_partkey bigint").write.parquet(f"{path}/lineitem.parquet")
    return str(path)


def by_sql(d, name):
    con = duckdb.connect()
    for t in ("part", "lineitem"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet/*.parquet'")
    return con.sql(ORACLES[name])


def test_second_pass_counts_calls_of_one_ref_id_once(spark, tmp_path):
    d = calls_of_one_ref_id(spark, tmp_path)
    got = QUERIES["res_second_pass"](spark, d).collect()
    assert list(map(tuple, got)) == by_sql(d, "res_second_pass").fetchall() == [(3, 3, 0)]


def test_cascade_answers_for_every_target_of_a_ref_id(spark, tmp_path):
    d = calls_of_one_ref_id(spark, tmp_path)
    got = sorted(map(repr, map(tuple, QUERIES["res_cascade"](spark, d).select("ref_id", "resolution", "rule", "def_id", "def_file").collect())))
    want = sorted(map(repr, by_sql(d, "res_cascade").fetchall()))
    assert got == want and len(got) == 5


def test_cascade_resolves_against_every_symbol(spark, tmp_path):
    d = calls_of_one_ref_id(spark, tmp_path)
    got = {tuple(r) for r in QUERIES["res_cascade"](spark, d).select("ref_id", "rule", "def_id").collect()}
    assert (8 * 1000003 + 5, "class_method", 5) in got


@pytest.mark.parametrize("name, table, each", [("agg_cochange_lift", "lineitem", 1), ("snk_edges", "lineitem", 1), ("prj_vectorize", "part", 8), ("rank_semantic", "part", 8)])
def test_more_rows_are_dealt_to_more_tasks(spark, monkeypatch, name, table, each):
    monkeypatch.setattr(fx, "ROWS_A_TASK", 100)
    rows = spark.read.parquet(f"{DIR}/{table}.parquet").count()
    plan = QUERIES[name](spark, DIR)._jdf.queryExecution().executedPlan().toString()
    assert str(1 + rows * each // 100) in re.findall(r"hashpartitioning\([^)]*, (\d+)\)", plan)
