"""Traversals of typed edges: frontier joins without duplicates.

Edges are DataFrames with ``src`` and ``dst``.  Loops run on the driver; each hop is
a join whose size follows the frontier, and lineage is cut by tables in the
shared folder.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import cut


def reverse(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def reach(edges: DataFrame, seeds: DataFrame, max_depth: int | None = None, *, include_seeds: bool = False) -> DataFrame:
    """(seed, node, depth): least number of hops from each seed (column ``node``), up to ``max_depth``.

    All seeds advance together, so N seeds cost one traversal.  A seed is not
    its own successor, even on a cycle.
    """
    e = edges.select("src", "dst").where("src is not null and dst is not null").distinct()
    e = cut(e)
    front = cut(seeds.select(F.col("node").alias("seed"), "node").distinct().withColumn("depth", F.lit(0)))
    seen, depth = front, 0
    while max_depth is None or depth < max_depth:
        depth += 1
        step = front.join(e, F.col("node") == F.col("src")).select("seed", F.col("dst").alias("node")).distinct()
        front = cut(step.join(seen.select("seed", "node"), ["seed", "node"], "left_anti").withColumn("depth", F.lit(depth)))
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
        if depth % 16 == 0:  # so many parts of a union at most
            seen = cut(seen)
    return seen if include_seeds else seen.where("depth > 0")


def flood(edges: DataFrame, seeds: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(node, depth): least number of hops from any of the seeds, which have depth 0; a row a node, whatever the number of seeds."""
    e = cut(edges.select("src", "dst").where("src is not null and dst is not null").distinct())
    front = cut(seeds.select("node").distinct().withColumn("depth", F.lit(0)))
    seen, depth = front, 0
    while max_depth is None or depth < max_depth:
        depth += 1
        step = front.join(e, F.col("node") == F.col("src")).select(F.col("dst").alias("node")).distinct()
        front = cut(step.join(seen.select("node"), "node", "left_anti").withColumn("depth", F.lit(depth)))
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
        if depth % 16 == 0:
            seen = cut(seen)
    return seen


def chain(edges: DataFrame, seeds: DataFrame, max_depth: int) -> DataFrame:
    """(src, dst, depth) of the edges that a traversal from the seeds meets, each at its least depth."""
    nodes = flood(edges, seeds, max_depth - 1)
    return edges.select("src", "dst").distinct().join(nodes, F.col("src") == F.col("node")).select("src", "dst", (F.col("depth") + 1).alias("depth"))


def shortest_paths(edges: DataFrame, source, target, max_depth: int, limit: int = 5) -> DataFrame:
    """(path, hops): the shortest paths from ``source`` to ``target``, in order of their nodes, ``limit`` of them.

    A backward traversal prunes the forward one to nodes that lie on a
    shortest path, so the paths carried are those asked for.
    """
    spark = edges.sparkSession
    e = edges.select("src", "dst").distinct()
    kind = dict(edges.dtypes)["src"]
    start, goal = (spark.createDataFrame([(v,)], f"node {kind}") for v in (source, target))
    to_goal = cut(reach(reverse(e), goal, max_depth, include_seeds=True).select(F.col("node").alias("dst"), F.col("depth").alias("left_")))
    at_start = to_goal.join(start, F.col("dst") == F.col("node"), "left_semi").select("left_").collect()
    empty = spark.createDataFrame([], f"path array<{kind}>, hops int")
    if not at_start or at_start[0][0] == 0:
        return empty
    hops = at_start[0][0]
    paths = start.select(F.array("node").alias("path"), F.col("node").alias("at"))
    for k in range(1, hops + 1):
        nxt = e.join(to_goal.where(F.col("left_") == hops - k), "dst", "left_semi")
        paths = cut(paths.join(nxt, F.col("at") == F.col("src")).select(F.concat("path", F.array("dst")).alias("path"), F.col("dst").alias("at")))
    return paths.select("path", F.lit(hops).alias("hops")).orderBy("path").limit(limit)


def tree(edges: DataFrame, root, max_depth: int) -> DataFrame:
    """(path, node, depth, circular): every walk from ``root`` down to ``max_depth``; a node on its own path is a circular leaf."""
    spark = edges.sparkSession
    e = edges.select("src", "dst").distinct()
    kind = dict(edges.dtypes)["src"]
    level = spark.createDataFrame([(root,)], f"node {kind}").select(F.array("node").alias("path"), "node", F.lit(0).alias("depth"), F.lit(False).alias("circular"))
    out = level
    for k in range(1, max_depth + 1):
        level = level.where("not circular").join(e, F.col("node") == F.col("src"))
        level = cut(level.select(F.concat("path", F.array("dst")).alias("path"), F.col("dst").alias("node"), F.lit(k).alias("depth"), F.array_contains("path", F.col("dst")).alias("circular")))
        if level.isEmpty():
            break
        out = out.unionByName(level)
    return out


def two_cycles_and_three(edges: DataFrame) -> DataFrame:
    """(cycle, length): simple cycles of two and three nodes, rotated to begin with their least node."""
    e = edges.select("src", "dst").where("src <> dst").distinct()
    two = e.alias("a").join(e.alias("b"), (F.col("a.dst") == F.col("b.src")) & (F.col("b.dst") == F.col("a.src"))).where("a.src < a.dst").select(F.array("a.src", "a.dst").alias("cycle"), F.lit(2).alias("length"))
    three = e.alias("a").join(e.alias("b"), F.col("a.dst") == F.col("b.src")).join(e.alias("c"), (F.col("b.dst") == F.col("c.src")) & (F.col("c.dst") == F.col("a.src")))
    three = three.where("a.src < b.src and a.src < c.src and b.src <> c.src").select(F.array("a.src", "b.src", "c.src").alias("cycle"), F.lit(3).alias("length"))
    return two.unionByName(three)


def scc(edges: DataFrame, max_rounds: int = 1000) -> DataFrame:
    """(node, component): strongly connected components of two nodes or more, named by their least node.

    Nodes without a way in or out are trimmed.  Of the rest each takes the least
    node that reaches it as its colour; what reaches the colour's own node
    inside the colour is that node's component.  Components found go, and the
    others are coloured again.
    """
    e = cut(edges.select("src", "dst").where("src is not null and dst is not null and src <> dst").distinct())
    found: DataFrame | None = None
    for _ in range(max_rounds):
        n = e.count()
        while n:  # trim
            e = cut(e.join(e.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(e.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst"))
            m = e.count()
            if m == n:
                break
            n = m
        if not n:
            break
        colour = cut(e.select(F.col("src").alias("node")).distinct().withColumn("colour", F.col("node")))
        while True:
            given = e.join(colour, F.col("src") == F.col("node")).groupBy("dst").agg(F.min("colour").alias("got"))
            new = cut(colour.join(given, F.col("node") == F.col("dst"), "left").select("node", F.least("colour", "got").alias("colour"), (F.col("got") < F.col("colour")).alias("moved")))
            colour = new.select("node", "colour")
            if new.where("moved").isEmpty():
                break
        c = lambda end: colour.select(F.col("node").alias(end), F.col("colour").alias(f"{end}_colour"))
        inner = cut(e.join(c("src"), "src").join(c("dst"), "dst").where("src_colour = dst_colour").select("src", "dst"))
        back = flood(reverse(inner), colour.where("node = colour").select("node"))
        part = cut(colour.join(back.select("node"), "node", "left_semi").select("node", F.col("colour").alias("component")))
        found = part if found is None else found.unionByName(part)
        e = cut(e.join(part.select(F.col("node").alias("src")), "src", "left_anti").join(part.select(F.col("node").alias("dst")), "dst", "left_anti"))
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    if found is None:
        return edges.select(F.col("src").alias("node"), F.col("src").alias("component")).limit(0)
    large = found.groupBy("component").agg(F.count("*").alias("n")).where("n > 1").select("component")
    return found.join(large, "component", "left_semi").select("node", "component")


def pagerank(edges: DataFrame, nodes: DataFrame, *, damping: float = 0.85, max_iter: int = 100, tolerance: float = 1e-6) -> DataFrame:
    """(node, rank, inbound): damped ranks that add up to one; the mass of nodes without edges out is spread evenly.

    Rounds end when all ranks together moved by less than ``tolerance`` times
    the number of nodes.  Ranks follow distinct edges, ``inbound`` counts all of
    them.  A round is one pass over the edges and one small aggregate.
    """
    e = edges.select("src", "dst").distinct()
    out = e.groupBy("src").agg(F.count("*").alias("out"))
    e = cut(e.join(out, "src"))
    v = cut(nodes.select("node").distinct().join(out, F.col("node") == F.col("src"), "left").select("node", F.coalesce("out", F.lit(0)).alias("out")))
    n, open_ = v.agg(F.count("*"), F.count_if(F.col("out") == 0)).collect()[0]
    if not n:
        return v.select("node", F.lit(0.0).alias("rank"), F.lit(0).cast("bigint").alias("inbound"))
    ranks, dangling = v.withColumn("rank", F.lit(1.0 / n)), open_ / n
    for _ in range(max_iter):
        given = e.join(ranks.select("node", "rank"), F.col("src") == F.col("node")).groupBy("dst").agg(F.sum(F.col("rank") / e["out"]).alias("got"))
        base = (1 - damping) / n + damping * dangling / n
        new = cut(ranks.withColumnRenamed("rank", "old").join(given, F.col("node") == F.col("dst"), "left").select("node", "out", "old", (F.lit(base) + damping * F.coalesce("got", F.lit(0.0))).alias("rank")))
        moved, dangling = new.agg(F.sum(F.abs(F.col("rank") - F.col("old"))), F.coalesce(F.sum(F.when(F.col("out") == 0, F.col("rank"))), F.lit(0.0))).collect()[0]
        ranks = new.drop("old")
        if moved < tolerance * n:
            break
    inbound = edges.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("inbound"))
    return ranks.join(inbound, "node", "left").select("node", "rank", F.coalesce("inbound", F.lit(0)).alias("inbound"))


def degrees(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, fan_in, fan_out) over distinct edges, zero where there are none."""
    e = edges.select("src", "dst").distinct()
    ends = e.select(F.explode(F.array(F.struct(F.col("dst").alias("node"), F.lit(1).alias("i"), F.lit(0).alias("o")), F.struct(F.col("src").alias("node"), F.lit(0).alias("i"), F.lit(1).alias("o")))).alias("x"))
    d = ends.groupBy(F.col("x.node").alias("node")).agg(F.sum("x.i").alias("fan_in"), F.sum("x.o").alias("fan_out"))
    return nodes.select("node").join(d, "node", "left").select("node", F.coalesce("fan_in", F.lit(0)).cast("bigint").alias("fan_in"), F.coalesce("fan_out", F.lit(0)).cast("bigint").alias("fan_out"))


def dead(edges: DataFrame, nodes: DataFrame, alive_seeds: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(node, reason) of nodes that no seed reaches."""
    alive = flood(edges, alive_seeds, max_depth).select("node")
    left = nodes.select("node").join(alive, "node", "left_anti")
    d = degrees(edges, nodes)
    reason = F.when((F.col("fan_in") > 0), "unreachable_from_entry").when(F.col("fan_out") == 0, "orphan_no_callers_no_callees").otherwise("no_callers_has_dead_callees")
    return left.join(d, "node").select("node", reason.alias("reason"))


def hierarchy_summary(edges: DataFrame) -> DataFrame:
    """One row over parent → child edges (``src``, ``dst``): classes, roots, leaves, depth of the deepest."""
    e = edges.select("src", "dst").distinct()
    nodes = e.select(F.col("src").alias("node")).union(e.select("dst")).distinct()
    roots = nodes.join(e.select(F.col("dst").alias("node")), "node", "left_anti")
    leaves = nodes.join(e.select(F.col("src").alias("node")), "node", "left_anti")
    # Depth by waves from all roots at once: a node's least depth, the largest of them over the tree.
    wave, depth = roots, 0
    seen = cut(roots)
    while True:
        wave = cut(e.join(wave, F.col("src") == F.col("node")).select(F.col("dst").alias("node")).distinct().join(seen, "node", "left_anti"))
        if wave.isEmpty():
            break
        seen, depth = cut(seen.union(wave)), depth + 1
    return nodes.agg(F.count("*").alias("classes")).join(roots.agg(F.count("*").alias("roots"))).join(leaves.agg(F.count("*").alias("leaves"))).withColumn("max_depth", F.lit(depth))


#: Shell patterns of test files; those without a slash are held against the basename too.
TEST_GLOBS = [
    "tests/*", "*/tests/*", "test_*.py", "*_test.py", "*_test.go", "*/src/test/*", "*/test/*", "*.test.ts", "*.test.tsx", "*.spec.ts", "*.spec.tsx",
    "*.test.js", "*.test.jsx", "*.spec.js", "*.spec.jsx", "__tests__/*", "*/__tests__/*", "*Tests.swift", "*/Tests/*",
]


def shell_match(path: Column, globs: list[str]) -> Column:
    """Whether a path matches one of the shell patterns, in which ``*`` crosses folders."""
    out = F.lit(False)
    for g in globs:
        pattern = "^(?s:" + "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in g) + ")$"
        out = out | path.rlike(pattern) | (F.lit("/" not in g) & F.regexp_extract(path, "([^/]*)$", 1).rlike(pattern))
    return out


def affected_tests(imports: DataFrame, changed: DataFrame, globs: list[str] | None = None) -> DataFrame:
    """(file, depth): tests among the files that depend on the ``changed`` ones (column file), however far.

    imports: src imports dst.  ``globs`` replace the usual patterns.
    """
    found = flood(reverse(imports), changed.select(F.col("file").alias("node"))).where("depth > 0")
    return found.where(shell_match(F.col("node"), globs or TEST_GLOBS)).select(F.col("node").alias("file"), "depth")
