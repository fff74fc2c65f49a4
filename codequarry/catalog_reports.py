"""More registered queries: gaps, facets, neighbourhoods, scanners and reports composed of the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .catalog import _BLOCKS, _FILE_IMPORTS, _GRADE, SEED, _file_imports, _ids, _ladder, _nodes, _refs, _seed, query
from .functions import text as tx
from .operators import graph, metrics, quality, resolve, search, sets
from .sources import fixtures as fx
from .sources import parsers, sinks

# -- sources and sinks -------------------------------------------------------


@query("SELECT id, text FROM (SELECT doc_id AS id, text FROM documents) x")
def src_encoding(spark, d):
    """Texts through three encodings and back."""
    t = fx.table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    latin = F.col("text").rlike("^[\\x00-\\x7F]*$")
    raw = F.when(latin & (F.col("id") % 2 == 0), F.encode("text", "UTF-16")).otherwise(F.encode("text", "UTF-8"))
    return t.select("id", sinks.decoded(raw).alias("text"))


@query("SELECT id, kind || ' ' || name || coalesce(' in ' || class, '') || ' (' || file || ':' || line || '-' || end_line || ')' AS row FROM symbols", ("symbols",))
def snk_full(spark, d):
    return fx.symbols(spark, d).select("id", sinks.full_line().alias("row"))


@query("SELECT id, substr(kind, 1, 1) || ' ' || name || '@' || line AS row FROM symbols", ("symbols",))
def snk_compact(spark, d):
    return fx.symbols(spark, d).select("id", sinks.compact_line().alias("row"))


@query("SELECT '{\"type\":\"node\",\"id\":' || id || ',\"label\":\"' || name || '\"}' AS value FROM symbols UNION ALL SELECT '{\"type\":\"edge\",\"src\":' || caller || ',\"dst\":' || callee || '}' FROM calls", ("call_edges",))
def snk_graphology(spark, d):
    return sinks.graph_json(fx.symbols(spark, d).select("id", F.col("name").alias("label")), _ids(spark, d))


# -- aggregates --------------------------------------------------------------


@query("+ u AS (SELECT DISTINCT callee FROM call_edges WHERE contains(caller_file, '/tests/')), s AS (SELECT language, id IN (SELECT callee FROM u) AS hit FROM symbols) SELECT language, count(*) AS total, count(*) FILTER (WHERE NOT hit) AS gaps, round(100.0 * count(*) FILTER (WHERE hit) / count(*), 1) AS pct FROM s GROUP BY 1", ("call_edges",))
def agg_gaps(spark, d):
    e = fx.call_edges(spark, d)
    used = e.where(tx.is_test_path(F.col("caller_file"))).select(F.col("callee").alias("id")).distinct().withColumn("hit", F.lit(True))
    s = fx.symbols(spark, d).join(used, "id", "left").withColumn("hit", F.coalesce("hit", F.lit(False)))
    return s.groupBy("language").agg(F.count("*").alias("total"), F.count_if(~F.col("hit")).alias("gaps"), F.round(100.0 * F.count_if("hit") / F.count("*"), 1).alias("pct"))


@query(f"+ e AS ({_FILE_IMPORTS}), r AS (SELECT src AS seed, src AS node, 0 AS d FROM (SELECT DISTINCT src FROM e) x UNION SELECT r.seed, e.dst, d + 1 FROM r JOIN e ON e.src = r.node WHERE d < 10), m AS (SELECT seed, node, min(d) AS d FROM r GROUP BY 1, 2), x AS (SELECT seed, max(d) AS depth FROM m GROUP BY 1) SELECT CASE WHEN depth <= 2 THEN 'shallow' WHEN depth <= 5 THEN 'medium' ELSE 'deep' END AS bucket, count(*) AS n FROM x GROUP BY 1", ("call_edges",), True)
def agg_depth_hist(spark, d):
    """Depth of a file: the farthest of its least distances, up to ten hops; this doesn't depend on the order of a search."""
    e = _file_imports(spark, d)
    far = graph.reach(e, e.select(F.col("src").alias("node")), 10).groupBy("seed").agg(F.max("depth").alias("depth"))
    return far.groupBy(F.when(F.col("depth") <= 2, "shallow").when(F.col("depth") <= 5, "medium").otherwise("deep").alias("bucket")).agg(F.count("*").alias("n"))


# -- sets and graph ----------------------------------------------------------


@query("SELECT id FROM symbols WHERE kind = 'class' AND NOT contains(file, '/gen/')", ("symbols",))
def set_except(spark, d):
    s = fx.symbols(spark, d)
    return s.where("kind = 'class'").select("id").join(s.where(tx.is_generated_path(F.col("file"))).select("id"), "id", "left_anti")


@query(f"SELECT DISTINCT node FROM (SELECT callee AS node FROM calls WHERE caller = {SEED} UNION ALL SELECT caller FROM calls WHERE callee = {SEED}) x", ("call_edges",))
def set_related(spark, d):
    e, s = _ids(spark, d), _seed(spark, SEED)
    return graph.reach(e, s, 1).select("node").unionByName(graph.reach(graph.reverse(e), s, 1).select("node")).distinct()


@query(f"+ r AS (SELECT CAST({SEED} AS BIGINT) AS node, 0 AS d UNION SELECT c.callee, d + 1 FROM r JOIN calls c ON c.caller = r.node WHERE d < 2) SELECT DISTINCT node FROM r", ("call_edges",), True)
def g_neighbors(spark, d):
    return graph.reach(_ids(spark, d), _seed(spark, SEED), 2, include_seeds=True).select("node").distinct()


@query("+ r AS (SELECT parent AS seed, child AS node, 1 AS d FROM contains UNION ALL SELECT r.seed, c.child, d + 1 FROM r JOIN contains c ON c.parent = r.node) SELECT seed, node, d AS depth FROM r", ("contains",), True)
def g_inherit_tree(spark, d):
    """Descendants of every class."""
    e = fx.contains(spark, d).select(F.col("parent").alias("src"), F.col("child").alias("dst"))
    return graph.reach(e, e.select(F.col("src").alias("node")))


@query(f"+ r AS (SELECT CAST({SEED} AS BIGINT) AS node, 0 AS d UNION SELECT c.caller, d + 1 FROM r JOIN calls c ON c.callee = r.node WHERE d < 5), m AS (SELECT node, min(d) AS depth FROM r GROUP BY 1), q AS (SELECT CAST({SEED} AS BIGINT) AS node, 0 AS d UNION SELECT c.callee, d + 1 FROM q JOIN calls c ON c.caller = q.node WHERE d < 5), n AS (SELECT node, min(d) AS depth FROM q GROUP BY 1) SELECT m.node, 'callers' AS way, CAST(depth AS INTEGER) AS depth FROM m JOIN symbols s ON s.id = m.node WHERE depth > 0 AND NOT contains(s.file, '/tests/') UNION ALL SELECT n.node, 'callees', CAST(depth AS INTEGER) FROM n JOIN symbols s ON s.id = n.node WHERE depth > 0 AND NOT contains(s.file, '/tests/')", ("call_edges",), True)
def g_transitive(spark, d):
    """Callers and callees of a function in production code, five hops."""
    e, s = _ids(spark, d), _seed(spark, SEED)
    found = graph.reach(graph.reverse(e), s, 5).withColumn("way", F.lit("callers")).unionByName(graph.reach(e, s, 5).withColumn("way", F.lit("callees")))
    code = fx.symbols(spark, d).where(~tx.is_test_path(F.col("file"))).select(F.col("id").alias("node"))
    return found.join(code, "node", "left_semi").select("node", "way", "depth")


@query("SELECT src AS module, count(*) AS dependencies, (SELECT count(*) FROM imports j WHERE j.dst = i.src) AS dependents FROM imports i GROUP BY 1", ("imports",))
def g_deps(spark, d):
    e = fx.imports(spark, d)
    out = e.groupBy(F.col("src").alias("module")).agg(F.count("*").alias("dependencies"))
    into = e.groupBy(F.col("dst").alias("module")).agg(F.count("*").alias("dependents"))
    return out.join(into, "module", "left").select("module", "dependencies", F.coalesce("dependents", F.lit(0)).alias("dependents"))


@query(f"+ e AS (SELECT caller AS src, callee AS dst, 'out' AS way FROM calls UNION ALL SELECT callee, caller, 'in' FROM calls), r AS (SELECT CAST({SEED} AS BIGINT) AS node, way, 0 AS d FROM (VALUES ('in'), ('out')) v(way) UNION SELECT e.dst, r.way, d + 1 FROM r JOIN e ON e.src = r.node AND e.way = r.way WHERE d < 5), m AS (SELECT node, way, min(d) AS depth FROM r GROUP BY 1, 2) SELECT s.file, way, count(*) AS functions FROM m JOIN symbols s ON s.id = m.node WHERE depth > 0 GROUP BY 1, 2", ("call_edges",), True)
def g_blast_functions(spark, d):
    e, s = _ids(spark, d), _seed(spark, SEED)
    both = graph.reach(e, s, 5).withColumn("way", F.lit("out")).unionByName(graph.reach(graph.reverse(e), s, 5).withColumn("way", F.lit("in")))
    files = fx.symbols(spark, d).select(F.col("id").alias("node"), "file")
    return both.join(files, "node").groupBy("file", "way").agg(F.count("*").alias("functions"))


@query("SELECT src_package AS src, dst_package AS dst, CAST(sum(weight) AS BIGINT) AS weight FROM imports WHERE src_package <> dst_package GROUP BY 1, 2 ORDER BY 3 DESC, 1, 2 LIMIT 10", ("imports",))
def g_package_diagram(spark, d):
    g = metrics.package_graph(fx.imports(spark, d)).select(F.col("src_package").alias("src"), F.col("dst_package").alias("dst"), "weight")
    return g.orderBy(F.desc("weight"), "src", "dst").limit(10)


# -- resolution --------------------------------------------------------------


_CROSS = "refs AS (SELECT caller * 1000003 + callee AS ref_id, callee_name AS name, caller_file AS file, caller_language AS language, caller + callee % 40 AS line FROM call_edges)"


@query(f"+ {_CROSS}, fn AS (SELECT id, file, line, end_line FROM symbols WHERE kind IN ('function', 'method')), inside AS (SELECT ref_id, arg_min(fn.id, (fn.end_line - fn.line, -fn.line, fn.id)) AS id FROM refs JOIN fn ON fn.file = refs.file AND refs.line BETWEEN fn.line AND fn.end_line GROUP BY 1), before AS (SELECT ref_id, arg_max(fn.id, (fn.line, fn.id)) AS id FROM refs JOIN fn ON fn.file = refs.file AND fn.line <= refs.line GROUP BY 1), c AS (SELECT r.ref_id, s.id AS def_id, s.file AS def_file, s.line AS def_line, CASE WHEN r.file = s.file THEN 1.0 WHEN EXISTS (SELECT 1 FROM call_edges u WHERE u.weight > 1 AND u.caller_file = r.file AND u.callee_file = s.file) THEN 0.9 ELSE 0.5 END AS level FROM refs r JOIN symbols s ON s.name = r.name AND (r.language = s.language OR (r.language IN ('javascript', 'typescript') AND s.language IN ('javascript', 'typescript')))), b AS (SELECT ref_id, max(level) AS level FROM c GROUP BY 1), p AS (SELECT ref_id, any_value(level) AS level, arg_min(def_id, (def_file, def_line, def_id)) AS def_id FROM c JOIN b USING (ref_id, level) GROUP BY 1) SELECT ref_id, coalesce(inside.id, before.id) AS caller_id, p.def_id, CAST(coalesce(p.level, 1.0) * CASE WHEN coalesce(inside.id, before.id) IS NULL THEN 0.5 ELSE 1.0 END AS DOUBLE) AS confidence FROM refs LEFT JOIN inside USING (ref_id) LEFT JOIN before USING (ref_id) LEFT JOIN p USING (ref_id)", ("call_edges",))
def res_cross_file(spark, d):
    """Every call again: its caller from the line, its callee from the name."""
    e = fx.call_edges(spark, d)
    refs = e.select((F.col("caller") * 1000003 + F.col("callee")).alias("ref_id"), F.col("callee_name").alias("name"), F.col("caller_file").alias("file"), F.col("caller_language").alias("language"), (F.col("caller") + F.col("callee") % 40).alias("line"))
    imported = e.where("weight > 1").select(F.col("caller_file").alias("file"), F.col("callee_file").alias("target"))
    return resolve.cross_file(refs, fx.symbols(spark, d), imported)


@query("+ w AS (SELECT id AS wanted_id, CASE id % 3 WHEN 0 THEN 'C' || CAST(id % 97 AS VARCHAR) WHEN 1 THEN 'brand7' ELSE 'nowhere' END AS parent, name FROM symbols WHERE kind = 'method'), c AS (SELECT w.wanted_id, s.id, CASE WHEN coalesce(s.class = w.parent, false) THEN 3 WHEN list_contains(string_split(s.file, '/'), w.parent) THEN 2 ELSE 1 END AS tier FROM w JOIN symbols s ON s.name = w.name AND s.kind IN ('function', 'method', 'class')) SELECT wanted_id, id, CAST(CASE WHEN tier = 2 THEN 0.7 ELSE 1.0 END AS DOUBLE) AS confidence FROM c WHERE (wanted_id, tier) IN (SELECT (wanted_id, max(tier)) FROM c GROUP BY wanted_id)", ("symbols",))
def res_qualified(spark, d):
    """Members of a class by name: those inside it, else those whose path has its name, else all."""
    s, i = fx.symbols(spark, d), F.col("id")
    parent = F.when(i % 3 == 0, F.concat(F.lit("C"), (i % 97).cast("string"))).when(i % 3 == 1, "brand7").otherwise("nowhere")
    return resolve.qualified(s.where("kind = 'method'").select(i.alias("wanted_id"), parent.alias("parent"), "name"), s)


@query("SELECT name, count(*) AS refs, count(DISTINCT file) AS files FROM (SELECT callee_name AS name, caller_file AS file FROM call_edges UNION ALL SELECT name, file FROM symbols WHERE kind = 'import') x GROUP BY 1", ("call_edges",))
def res_references(spark, d):
    r = fx.call_edges(spark, d).select(F.col("callee_name").alias("name"), F.col("caller_file").alias("file")).unionByName(fx.symbols(spark, d).where("kind = 'import'").select("name", "file"))
    return r.groupBy("name").agg(F.count("*").alias("refs"), F.countDistinct("file").alias("files"))


@query("SELECT DISTINCT file, replace(regexp_replace(file, '[.][a-z]+$', ''), '/', '.') AS module FROM symbols", ("symbols",))
def res_module_path(spark, d):
    """Files of dotted module names: a name is turned into candidate paths, and those that exist stay."""
    f = fx.symbols(spark, d).select("file").distinct()
    wanted = f.select(F.replace(F.regexp_replace("file", "[.][a-z]+$", ""), F.lit("/"), F.lit(".")).alias("module")).distinct()
    ext = F.explode(F.array(*[F.lit("." + e) for e in fx.EXTENSIONS.values()]))
    paths = wanted.select("module", F.replace("module", F.lit("."), F.lit("/")).alias("base"), ext.alias("ext"))
    return paths.select("module", F.concat("base", "ext").alias("file")).join(f, "file").select("file", "module")


@query("+ p AS (SELECT caller * 1000003 + callee AS ref_id, callee_name AS name FROM call_edges WHERE caller_language = 'python'), s AS (SELECT name, min(id) AS def_id, count(*) AS n FROM symbols WHERE language = 'python' GROUP BY 1) SELECT count(*) AS total, count(def_id) AS resolved, count(*) - count(def_id) AS unchanged FROM p LEFT JOIN s USING (name)", ("call_edges",))
def res_second_pass(spark, d):
    """Calls by number: two of them may share a ref_id, so none is looked up by it."""
    refs = _refs(spark, d).where("language = 'python'")
    found = resolve.chosen(refs, fx.symbols(spark, d), tx.is_test_path(F.col("def_file")))
    return found.agg(F.count("*").alias("total"), F.count("def_id").alias("resolved"), (F.count("*") - F.count("def_id")).alias("unchanged"))


# -- quality -----------------------------------------------------------------


@query(f"SELECT id, CASE WHEN blocks = 0 THEN 100.0 WHEN r <= 0.05 THEN 100.0 WHEN r >= 0.3 THEN 0.0 ELSE round(100.0 * (0.3 - r) / (0.3 - 0.05), 4) END AS score FROM (SELECT id, blocks, repeated / CAST(nullif(blocks, 0) AS DOUBLE) AS r FROM ({_BLOCKS.removeprefix('+ ').join(['WITH ', ''])}) y) z", ("files",))
def q_duplication(spark, d):
    b = metrics.duplicate_blocks(fx.files(spark, d))
    return b.select("id", F.when(F.col("blocks") == 0, 100.0).otherwise(F.round(quality.duplication_score(F.col("repeated") / F.nullif("blocks", F.lit(0))), 4)).alias("score"))


@query("SELECT file, round(CASE WHEN n <= 5 THEN 100 WHEN n >= 50 THEN 0 ELSE 100.0 * (50 - n) / 45 END, 4) AS score FROM (SELECT file, count(*) AS n FROM commit_files WHERE ts >= TIMESTAMP '2001-05-01' GROUP BY 1) x", ("commit_files",))
def q_hotspot(spark, d):
    c = fx.commit_files(spark, d).where(F.col("ts") >= F.to_timestamp_ntz(F.lit("2001-05-01"))).groupBy("file").agg(F.count("*").alias("n"))
    return c.select("file", F.round(quality.hotspot_score(F.col("n")), 4).alias("score"))


@query(f"+ f AS (SELECT s.id, s.complexity, contains(s.file, '/m0') AS init, coalesce(n, 0) AS down, {_GRADE.replace('total', '(100 - complexity)')} AS grade, coalesce(t, 0) AS tests, id % 6 AS edit, complexity % 15 AS deps FROM symbols s LEFT JOIN (SELECT callee, count(DISTINCT caller_file) AS n, count(*) FILTER (WHERE contains(caller_file, '/tests/')) AS t FROM call_edges GROUP BY 1) u ON u.callee = s.id), p AS (SELECT id, {_ladder('down', [(21, 3), (6, 2), (1, 1)])} + CASE WHEN grade IN ('D', 'F') THEN 2 WHEN grade = 'C' THEN 1 ELSE 0 END + CASE WHEN tests = 0 THEN 2 ELSE 0 END + CASE WHEN init THEN 2 ELSE 0 END + CASE WHEN edit IN (0, 1, 2) THEN 2 WHEN edit = 3 THEN 1 WHEN edit = 4 AND down > 5 THEN 1 ELSE 0 END + CASE WHEN deps > 10 THEN 1 ELSE 0 END AS points FROM f) SELECT id, CASE WHEN points >= 6 THEN 'dangerous' WHEN points >= 3 THEN 'caution' ELSE 'safe' END AS verdict FROM p", ("call_edges",))
def q_safe_edit(spark, d):
    u = fx.call_edges(spark, d).groupBy(F.col("callee").alias("id")).agg(F.countDistinct("caller_file").alias("down"), F.count_if(tx.is_test_path(F.col("caller_file"))).alias("tests"))
    j = fx.symbols(spark, d).join(u, "id", "left").na.fill(0, ["down", "tests"])
    edit = F.element_at(F.array(*map(F.lit, ["rename", "delete", "signature_change", "behavior_change", "refactor", "add_feature"])), (F.col("id") % 6).cast("int") + 1)
    verdict = quality.safe_edit(F.col("down"), tx.grade(100 - F.col("complexity")), F.col("tests"), F.col("file").contains("/m0"), edit, F.col("complexity") % 15)
    return j.select("id", verdict.alias("verdict"))


@query("SELECT callee_file AS file, CASE WHEN count(DISTINCT caller_file) <= 2 THEN 'low' WHEN count(DISTINCT caller_file) <= 8 THEN 'medium' ELSE 'high' END AS risk FROM call_edges WHERE caller_file <> callee_file GROUP BY 1", ("call_edges",))
def q_change_risk(spark, d):
    g = fx.call_edges(spark, d).where("caller_file <> callee_file").groupBy(F.col("callee_file").alias("file")).agg(F.countDistinct("caller_file").alias("n"))
    return g.select("file", quality.change_risk(F.col("n")).alias("risk"))


@query(f"SELECT s.id, CASE WHEN complexity >= 11 OR {_GRADE.replace('total', '(100 - complexity)')} IN ('D', 'F') OR (SELECT count(*) FROM calls WHERE callee = s.id) >= 10 THEN 'review' ELSE 'ok' END AS facet FROM symbols s", ("call_edges",))
def q_facet_risk(spark, d):
    deg = graph.degrees(_ids(spark, d), _nodes(spark, d)).withColumnRenamed("node", "id")
    return fx.symbols(spark, d).join(deg, "id").select("id", quality.facet_risk(F.col("complexity"), tx.grade(100 - F.col("complexity")), F.col("fan_in")).alias("facet"))


@query("SELECT DISTINCT a.file AS file, b.file AS test FROM symbols a JOIN symbols b ON regexp_extract(a.file, '([^/]*)/[^/]*$', 1) = regexp_extract(b.file, '([^/]*)/[^/]*$', 1) AND regexp_extract(a.file, '([^/]*)$', 1) = regexp_extract(b.file, '([^/]*)$', 1) WHERE NOT contains(a.file, '/tests/') AND contains(b.file, '/tests/')", ("symbols",))
def q_test_stem(spark, d):
    f = fx.symbols(spark, d).select("file").distinct()
    f = f.select("file", tx.basename(F.col("file")).alias("stem"), F.regexp_extract("file", "([^/]*)/[^/]*$", 1).alias("folder"), tx.is_test_path(F.col("file")).alias("t"))
    return f.where("not t").join(f.where("t").select(F.col("file").alias("test"), "stem", "folder"), ["stem", "folder"]).select("file", "test")


@query("SELECT id, len(regexp_extract_all(content, '\\b(?:if|elif|for|while|case|catch|except|and|or)\\b|&&|[|][|]|[?]')) + 1 AS complexity FROM files", ("files",))
def q_complexity_count(spark, d):
    return fx.files(spark, d).select("id", quality.decision_count(F.col("content")).cast("bigint").alias("complexity"))


@query("SELECT c.id, x.rule, CAST(x.line_no AS INTEGER) AS line_no FROM (SELECT id, language, id % 22 AS k FROM symbols) c JOIN (VALUES " + ", ".join(f"({k}, '{g}', '{i}', {n})" for k, gs, i, n in fx.FOUND_ANTI_PATTERNS for g in gs.split()) + ") x(k, language, rule, line_no) ON x.k = c.k AND x.language = c.language", ("symbols",))
def q_anti_patterns(spark, d):
    """All rules over small programs, one a symbol; the SQL lists what each holds."""
    return quality.anti_patterns(fx.code(spark, d))


@query("SELECT id, 'f' AS function, 4::INTEGER AS start, 4::INTEGER AS end, 'code after return statement on line 3' AS reason FROM symbols WHERE language = 'python' AND id % 22 = 21", ("symbols",))
def q_unreachable(spark, d):
    return quality.unreachable_code(fx.code(spark, d))


@query("SELECT page_id, regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS host, regexp_extract(url, '^[a-z]+://[^/]+/([a-z]+)/', 1) AS section FROM pages")
def q_routes(spark, d):
    """Routes of the pages: host and first part of the path."""
    return fx.table(spark, d, "pages").select("page_id", F.regexp_extract("url", "^[a-z]+://([^/]+)", 1).alias("host"), F.regexp_extract("url", "^[a-z]+://[^/]+/([a-z]+)/", 1).alias("section"))


@query("SELECT s.file, s.name FROM symbols s WHERE s.kind = 'constant' AND NOT EXISTS (SELECT 1 FROM call_edges u WHERE u.caller_file = s.file AND u.callee_name = s.name) GROUP BY 1, 2", ("call_edges",))
def q_unref_vars(spark, d):
    """Constants whose name their own file never uses."""
    e = fx.call_edges(spark, d)
    return quality.unused_names(fx.symbols(spark, d).where("kind = 'constant'"), e.select(F.col("caller_file").alias("file"), F.col("callee_name").alias("name")))


@query("+ s AS (SELECT file, count(*) AS symbols, max(complexity) AS worst FROM symbols GROUP BY 1), o AS (SELECT caller_file AS file, count(*) AS calls FROM call_edges GROUP BY 1) SELECT s.file, symbols, worst, coalesce(calls, 0) AS calls, CASE WHEN worst <= 5 THEN 'low' WHEN worst <= 10 THEN 'medium' WHEN worst <= 20 THEN 'high' ELSE 'critical' END AS band FROM s LEFT JOIN o USING (file)", ("call_edges",))
def q_project_overview(spark, d):
    s = fx.symbols(spark, d).groupBy("file").agg(F.count("*").alias("symbols"), F.max("complexity").alias("worst"))
    o = fx.call_edges(spark, d).groupBy(F.col("caller_file").alias("file")).agg(F.count("*").alias("calls"))
    return s.join(o, "file", "left").select("file", "symbols", "worst", F.coalesce("calls", F.lit(0)).alias("calls"), tx.risk_band(F.col("worst")).alias("band"))


# -- streams -----------------------------------------------------------------


@query("SELECT file, count(*) AS kept FROM (SELECT file, row_number() OVER (PARTITION BY file ORDER BY ts DESC, id DESC) AS k FROM health) x WHERE k <= 10 GROUP BY 1", ("health",))
def st_history(spark, d):
    """An append-only series pruned to its latest ten readings a file."""
    return metrics.latest(fx.health(spark, d), 10).groupBy("file").agg(F.count("*").alias("kept"))


@query("SELECT event_type, CAST(epoch(date_trunc('hour', ts)) AS BIGINT) + 3600 * k AS start, count(*) AS n FROM events, (VALUES (0), (-1)) v(k) GROUP BY 1, 2")
def st_sliding(spark, d):
    e = fx.table(spark, d, "events").withColumn("at", F.col("ts").cast("timestamp"))
    return e.groupBy(F.window("at", "2 hours", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n")).select("event_type", F.unix_timestamp("w.start").alias("start"), "n")
