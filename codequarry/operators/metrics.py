"""Single-pass aggregates over symbols, edges, history and health."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import dirname, grade, grade_rank, risk_band, source_lines, stripped

HIGH_COUPLING = 5.0
UNSTABLE = 0.7


def stats(symbols: DataFrame) -> DataFrame:
    """Symbols by language and by kind, and in all, in one pass: (dimension, value, n)."""
    g = symbols.groupingSets([["language"], ["kind"], []], "language", "kind").agg(F.count("*").alias("n"), F.grouping_id("language", "kind").alias("g"))
    return g.select(F.when(F.col("g") == 1, "language").when(F.col("g") == 2, "kind").otherwise("all").alias("dimension"), F.coalesce("language", "kind", F.lit("*")).alias("value"), "n")


def cross_file(calls: DataFrame) -> DataFrame:
    resolved = F.col("callee_file").isNotNull()
    across = resolved & (F.col("caller_file") != F.col("callee_file"))
    return calls.agg(F.count("*").alias("total"), F.count_if(resolved).alias("resolved"), F.count_if(across).alias("cross_file"), F.round(100.0 * F.count_if(across) / F.count("*"), 2).alias("pct"))


def coupling(imports: DataFrame, calls: DataFrame) -> DataFrame:
    """Unordered pairs of files: score = 2 * imports + calls."""
    pair = lambda d, i, c: d.where("a <> b").select(F.least("a", "b").alias("file_a"), F.greatest("a", "b").alias("file_b"), F.lit(i).alias("i"), F.lit(c).alias("c"))
    both = pair(imports, 1, 0).unionByName(pair(calls, 0, 1))
    g = both.groupBy("file_a", "file_b").agg(F.sum("i").alias("imports"), F.sum("c").alias("calls"))
    score = (2.0 * F.col("imports") + F.col("calls")).alias("score")
    return g.select("file_a", "file_b", "imports", "calls", score).withColumn("high", F.col("score") >= HIGH_COUPLING)


def instability(imports: DataFrame) -> DataFrame:
    """Afferent and efferent couplings of every module, and Ce / (Ca + Ce)."""
    e = imports.select("src", "dst").distinct()
    ends = e.select(F.explode(F.array(F.struct(F.col("src").alias("m"), F.lit(0).alias("a"), F.lit(1).alias("e")), F.struct(F.col("dst").alias("m"), F.lit(1).alias("a"), F.lit(0).alias("e")))).alias("x"))
    g = ends.groupBy(F.col("x.m").alias("module")).agg(F.sum("x.a").alias("afferent"), F.sum("x.e").alias("efferent"))
    return g.withColumn("instability", F.round(F.col("efferent") / (F.col("afferent") + F.col("efferent")), 4))


def matrix_summary(pairs: DataFrame, modules: DataFrame) -> DataFrame:
    p = pairs.agg(F.count("*").alias("pairs"), F.count_if("high").alias("high"), F.round(F.avg("score"), 2).alias("avg_score"), F.max("score").alias("max_score"))
    m = modules.agg(F.count("*").alias("modules"), F.count_if(F.col("instability") >= UNSTABLE).alias("unstable"))
    return m.join(p)  # one row each


def matrix(edges: DataFrame, names: list) -> DataFrame:
    """Symmetric weights, one column a named package."""
    both = edges.select("a", "b", "weight").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "weight"))
    return both.groupBy("a").pivot("b", names).agg(F.sum("weight"))


def heatmap_file(symbols: DataFrame) -> DataFrame:
    g = symbols.groupBy("file").agg(F.count("*").alias("functions"), F.sum("complexity").alias("total"), F.round(F.avg("complexity"), 2).alias("average"), F.max("complexity").alias("maximum"))
    return g.orderBy(F.desc("maximum"), F.desc("total"), "file")


def risk_histogram(symbols: DataFrame) -> DataFrame:
    return symbols.groupBy(risk_band(F.col("complexity")).alias("band")).agg(F.count("*").alias("n"))


def hotspots(symbols: DataFrame, n: int = 20) -> DataFrame:
    return symbols.select("id", "name", "file", "complexity").orderBy(F.desc("complexity"), "file", "id").limit(n)


def top_per_file(symbols: DataFrame, n: int = 5) -> DataFrame:
    k = F.row_number().over(W.partitionBy("file").orderBy(F.desc("complexity"), "id"))
    return symbols.withColumn("k", k).where(F.col("k") <= n).select("file", "k", "id", "complexity")


def symbol_in_degree(calls: DataFrame, symbols: DataFrame) -> DataFrame:
    """Distinct files that use a name, and whether several files define it."""
    used = calls.groupBy(F.col("callee_name").alias("name")).agg(F.countDistinct("caller_file").alias("users"))
    made = symbols.groupBy("name").agg(F.countDistinct("file").alias("definers"))
    return made.join(used, "name", "left").select("name", F.coalesce("users", F.lit(0)).alias("users"), (F.col("definers") > 1).alias("ambiguous"))


def sitemap(symbols: DataFrame) -> DataFrame:
    d = dirname(F.col("file")).alias("module")
    return symbols.groupBy(d).agg(F.countDistinct("file").alias("files"), F.count_if(F.col("kind").isin("function", "method")).alias("functions"), F.count_if(F.col("kind") == "class").alias("classes"), F.count_if(F.col("kind") == "import").alias("imports"), F.countDistinct("language").alias("languages"))


def flat(symbols: DataFrame, cap: int) -> DataFrame:
    """The first ``cap`` symbols of each kind with the kind's true count."""
    counts = symbols.groupBy("kind").agg(F.count("*").alias("n"))
    # Ranked alone, so that each task keeps its first ``cap`` before the shuffle.
    first = symbols.select("kind", "file", "line", "id").withColumn("k", F.row_number().over(W.partitionBy("kind").orderBy("file", "line", "id"))).where(F.col("k") <= cap)
    return first.join(counts, "kind").select("kind", "k", "id", "n")


def module_coupling(calls: DataFrame, top: int = 5) -> DataFrame:
    """Outgoing cross-file calls of a file, the number of its targets and the heaviest of them."""
    across = calls.where("caller_file <> callee_file")
    per = across.groupBy("caller_file", "callee_file").agg(F.sum("weight").alias("w"))
    best = F.slice(F.sort_array(F.collect_list(F.struct((-F.col("w")).alias("o"), "callee_file"))), 1, top)
    return per.groupBy(F.col("caller_file").alias("file")).agg(F.sum("w").alias("outgoing"), F.count("*").alias("targets"), F.concat_ws(",", F.transform(best, lambda x: x["callee_file"])).alias("top_targets"))


def package_graph(imports: DataFrame) -> DataFrame:
    return imports.where("src_package <> dst_package").groupBy("src_package", "dst_package").agg(F.sum("weight").alias("weight"), F.count("*").alias("edges"))


def classification_rate(edges: DataFrame, resolution: Column) -> DataFrame:
    return edges.select(resolution.alias("r")).agg(F.count("*").alias("edges"), F.round(100.0 * F.count_if(F.col("r") != "unknown") / F.count("*"), 2).alias("rate"))


def cochange(commit_files: DataFrame, min_shared: int = 3, max_files: int | None = None, targets: DataFrame | None = None) -> DataFrame:
    """Pairs of files changed together: lift = shared * commits / (a * b).

    ``max_files`` leaves out commits of more files, whose pairs are the square
    of their size; ``targets`` (column file) asks for pairs with those files
    only, which makes as many pairs a commit as it has files.
    """
    c = commit_files.select("sha", "file").distinct()
    if max_files is not None:
        c = c.join(c.groupBy("sha").agg(F.count("*").alias("n")).where(F.col("n") <= max_files).select("sha"), "sha", "left_semi")
    total = c.agg(F.countDistinct("sha").alias("commits"))
    per = c.groupBy("file").agg(F.count("*").alias("n"))
    x = c.select("sha", F.col("file").alias("x"))
    if targets is None:
        pairs = x.join(c.select("sha", F.col("file").alias("y")), "sha").where("x < y")
    else:
        asked = x.join(targets.select(F.col("file").alias("x")).distinct().withColumn("asked", F.lit(True)), "x", "left").withColumn("asked", F.coalesce("asked", F.lit(False)))
        one, other = asked.where("asked").select("sha", "x"), asked.select("sha", F.col("x").alias("y"), F.col("asked").alias("both"))
        pairs = one.join(other, "sha").where("x <> y and (not both or x < y)")
    pairs = pairs.groupBy(F.least("x", "y").alias("file_a"), F.greatest("x", "y").alias("file_b")).agg(F.count("*").alias("shared")).where(F.col("shared") >= min_shared)
    j = pairs.join(per.select(F.col("file").alias("file_a"), F.col("n").alias("na")), "file_a").join(per.select(F.col("file").alias("file_b"), F.col("n").alias("nb")), "file_b").join(total)  # one row of totals
    return j.select("file_a", "file_b", "shared", F.round(F.col("shared") * F.col("commits") / (F.col("na") * F.col("nb")), 4).alias("lift"))


def activation(commit_files: DataFrame, now: str) -> DataFrame:
    """Changes of a file in the last 30 and 90 days and in all, and its latest commit."""
    age = F.date_diff(F.to_date(F.lit(now)), F.to_date("ts"))
    latest = F.max(F.struct("ts", "sha"))
    return commit_files.groupBy("file").agg(F.count_if((age >= 0) & (age < 30)).alias("mod_30d"), F.count_if((age >= 0) & (age < 90)).alias("mod_90d"), F.count("*").alias("mod_all"), latest["sha"].alias("last_commit"))


def weighted_health(rows: DataFrame, weights: dict[str, float]) -> DataFrame:
    """Weighted mean of the dimensions that have a score, and the grade."""
    value = sum((F.coalesce(F.col(d), F.lit(0.0)) * w for d, w in weights.items()), F.lit(0.0))
    active = sum((F.when(F.col(d).isNotNull(), F.lit(w)).otherwise(0.0) for d, w in weights.items()), F.lit(0.0))
    total = F.round(value / F.nullif(active, F.lit(0.0)), 4)
    return rows.withColumn("total", total).withColumn("grade", grade(F.col("total")))


def duplicate_blocks(files: DataFrame, size: int = 3, least: int = 10) -> DataFrame:
    """Per file: distinct blocks of ``size`` stripped lines that aren't all blank, and how many occur more than once.

    A file of fewer than ``least`` lines has none.
    """
    v = F.transform(source_lines(F.col("content")), stripped)
    lines = files.select("id", v.alias("v"))
    blocks = F.when((F.size("v") >= least) & (F.size("v") >= size), F.transform(F.sequence(F.lit(0), F.size("v") - size), lambda i: F.concat_ws("\n", F.slice("v", i + 1, size)))).otherwise(F.array().cast("array<string>"))
    blank = "\n" * (size - 1)
    b = lines.select("id", F.explode_outer(blocks).alias("b")).groupBy("id", "b").agg(F.count("*").alias("n"))
    real = F.col("b").isNotNull() & (F.col("b") != blank)
    return b.groupBy("id").agg(F.count_if(real).alias("blocks"), F.count_if(real & (F.col("n") > 1)).alias("repeated"))


def latest(health: DataFrame, keep: int = 1) -> DataFrame:
    k = F.row_number().over(W.partitionBy("file").orderBy(F.desc("ts"), F.desc("id")))
    return health.withColumn("k", k).where(F.col("k") <= keep)


def alerts(health: DataFrame, threshold: str = "D", *more: str) -> DataFrame:
    """Readings that call for an alert: a cold start at or below the threshold, a strict worsening that touches it or drops two grades, or a crossing."""
    w = W.partitionBy("file").orderBy("ts", "id")
    g = health.withColumn("grade", grade(F.col("total"))).withColumn("previous", F.lag("grade").over(w))
    bad = {"A": 0, "B": 1, "C": 2, "D": 3, "F": 4}[threshold]
    now, old = grade_rank(F.col("grade")), grade_rank(F.col("previous"))
    worse = (now > old) & ((now >= bad) | (old >= bad) | (now - old >= 2))
    return g.where(F.when(F.col("previous").isNull(), now >= bad).otherwise(worse)).select("id", "file", "previous", "grade", *more)


def change_counts(changes: DataFrame, priority: list[str]) -> DataFrame:
    """Per group: changes by category, the first category of ``priority`` that is present, and the risk of the confident ones."""
    order = F.array(*map(F.lit, priority))
    g = changes.groupBy("group").agg(F.count("*").alias("changes"), F.countDistinct("category").alias("categories"), F.min(F.array_position(order, F.col("category"))).alias("p"), F.max(F.when(F.col("high_risk"), F.col("confidence"))).alias("c"))
    risk = F.when(F.col("c") >= 0.7, "high").when(F.col("c") >= 0.6, "medium").otherwise("low")
    return g.select("group", "changes", "categories", F.element_at(order, F.col("p").cast("int")).alias("dominant"), risk.alias("risk"))
