"""The registered queries over the code graph, and their SQL.

Each query applies one operator to whole projections of the tables; its SQL
states the same result independently.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .functions import text as tx
from .operators import graph, metrics, quality, resolve, search, sets
from .plans.chain import Engine, predicate
from .plans.selector import Compiler
from .sources import fixtures as fx
from .sources import parsers
from .sources.fixtures import with_sql
from .storage import cut
from .streaming import stateful

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, uses: tuple[str, ...] = (), recursive: bool = False):
    """Register a query under its function's name, with SQL over the projections it uses."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = with_sql(list(uses), sql, recursive) if uses else sql
        return f

    return add


SEED = 243

# -- sources -----------------------------------------------------------------


@query("SELECT id, path, length(content) AS size FROM files WHERE path LIKE 'src1%' AND language IN ('en', 'de') AND length(content) >= 500", ("files",))
def src_list_files(spark, d):
    f = fx.files(spark, d)
    return f.where(F.col("path").startswith("src1") & F.col("language").isin("en", "de") & (F.length("content") >= 500)).select("id", "path", F.length("content").alias("size"))


@query("SELECT id, path, i AS line_no, x AS line FROM (SELECT id, path, unnest(string_split(content, chr(10))) AS x, generate_subscripts(string_split(content, chr(10)), 1) AS i FROM files) t WHERE regexp_matches(x, '(?i)license|copyright')", ("files",))
def src_content_rows(spark, d):
    return search.content(fx.files(spark, d), "license|copyright", case="insensitive").withColumn("line_no", F.col("line_no").cast("bigint"))


@query("SELECT id, path, count(*) AS matches FROM (SELECT id, path, unnest(string_split(content, chr(10))) AS x FROM files) t WHERE regexp_matches(x, '[0-9]{3}') GROUP BY 1, 2", ("files",))
def src_content_per_file(spark, d):
    return search.content(fx.files(spark, d), "[0-9]{3}", mode="per_file")


@query("SELECT id, path FROM files f WHERE NOT EXISTS (SELECT 1 FROM (SELECT id AS i, unnest(string_split(content, chr(10))) AS x FROM files) t WHERE t.i = f.id AND x LIKE '%the%')", ("files",))
def src_content_files_without(spark, d):
    return search.content(fx.files(spark, d), "the", fixed=True, mode="files_without")


@query("SELECT count(*) AS matches, count(DISTINCT id) AS files FROM (SELECT id, unnest(string_split(content, chr(10))) AS x FROM files) t WHERE regexp_matches(x, '\\b(?:the)\\b')", ("files",))
def src_content_total(spark, d):
    return search.content(fx.files(spark, d), "the", word=True, mode="total")


@query("SELECT pattern, count(*) FILTER (WHERE regexp_matches(x, pattern)) AS matches, count(DISTINCT id) FILTER (WHERE regexp_matches(x, pattern)) AS files FROM (SELECT id, unnest(string_split(content, chr(10))) AS x FROM files) t, (VALUES ('[0-9]+'), ('the'), ('@'), ('[A-Z]{4}')) p(pattern) GROUP BY 1", ("files",))
def src_batch(spark, d):
    return search.batch(fx.files(spark, d), ["[0-9]+", "the", "@", "[A-Z]{4}"])


@query("SELECT id, path FROM files a WHERE content NOT IN (SELECT text FROM benchmark)", ("files",))
def src_partition(spark, d):
    f = fx.files(spark, d).withColumn("digest", F.sha2(F.col("content").cast("binary"), 256))
    known = fx.table(spark, d, "benchmark").select(F.sha2(F.col("text").cast("binary"), 256).alias("digest")).distinct()
    return f.join(known, "digest", "left_anti").select("id", "path")


@query("SELECT page_id, unnest(regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1)) AS href FROM pages")
def src_parse_links(spark, d):
    return parsers.links(fx.table(spark, d, "pages"))


@query("SELECT page_id, len(regexp_extract_all(html, '<[a-z][a-z0-9]*')) AS tags, len(regexp_extract_all(html, '<p>')) AS paragraphs FROM pages")
def src_parse_html(spark, d):
    return parsers.html_outline(fx.table(spark, d, "pages"))


@query("SELECT 'm' || p_partkey || '.py' AS file, x.kind, CASE x.kind WHEN 'import' THEN 'os' WHEN 'class' THEN 'C' || p_size ELSE replace(p_name, ' ', '_') END AS name, CASE WHEN x.kind = 'method' THEN 'C' || p_size END AS class, CAST(x.line AS BIGINT) AS line, CAST(x.last AS BIGINT) AS end_line, CAST(x.complexity AS BIGINT) AS complexity, CAST(x.complexity AS BIGINT) AS params, CASE WHEN x.kind = 'method' THEN array_to_string(list_sort(list_distinct(['join', replace(p_name, ' ', '_')])), ',') ELSE '' END AS calls FROM part, (VALUES ('import', 1, 1, 0), ('class', 3, 7, 0), ('method', 4, 7, 3)) x(kind, line, last, complexity)")
def src_parse_python(spark, d):
    """Symbols of generated modules, one a part, through the parser's map over batches."""
    p = fx.table(spark, d, "part")
    name = F.replace("p_name", F.lit(" "), F.lit("_"))
    code = F.concat(F.lit("import os\n\nclass C"), F.col("p_size").cast("string"), F.lit(":\n    def "), name, F.lit("(self, a, b=1):\n        if a and b:\n            return os.path.join(a, b)\n        return "), name, F.lit("(a)\n"))
    rows = parsers.python_symbols(p.select(F.concat(F.lit("m"), F.col("p_partkey").cast("string"), F.lit(".py")).alias("file"), code.alias("content")))
    return rows.withColumn("calls", F.array_join("calls", ","))


@query("SELECT sha, count(*) AS files, min(ts) AS ts FROM commit_files GROUP BY 1", ("commit_files",))
def src_git_log(spark, d):
    return fx.commit_files(spark, d).groupBy("sha").agg(F.count("*").alias("files"), F.min("ts").alias("ts"))


@query("SELECT caller AS src, callee AS dst, caller_file AS file, weight FROM call_edges WHERE caller_file NOT LIKE 'src/gen/%' UNION ALL SELECT caller, callee, caller_file, -weight FROM call_edges WHERE caller_file LIKE 'src/gen/%'", ("call_edges",))
def snk_edges(spark, d):
    e = fx.call_edges(spark, d).select(F.col("caller").alias("src"), F.col("callee").alias("dst"), F.lit("calls").alias("kind"), F.lit(0).alias("line"), F.col("caller_file").alias("file"), "weight")
    fresh = e.where(F.col("file").startswith("src/gen/")).withColumn("weight", -F.col("weight"))
    return sets.replace_edges(e, fresh, fresh.select("file"), fx.tasks(spark, d, "lineitem")).select("src", "dst", "file", "weight")


@query("SELECT id, CAST(json_object('id', id, 'name', name, 'kind', kind) AS VARCHAR) AS row FROM symbols", ("symbols",))
def snk_json(spark, d):
    return fx.symbols(spark, d).select("id", F.to_json(F.struct("id", "name", "kind")).alias("row"))


@query("SELECT id, id || ',' || name || ',' || kind || ',' || line || ',' || end_line AS row FROM symbols", ("symbols",))
def snk_csv(spark, d):
    return fx.symbols(spark, d).select("id", F.to_csv(F.struct("id", "name", "kind", "line", "end_line")).alias("row"))


# -- filters -----------------------------------------------------------------


@query("SELECT id, name FROM symbols WHERE regexp_matches(lower(name), '^blue.*') AND kind = 'method'", ("symbols",))
def flt_expr(spark, d):
    return parsers.filter_results(fx.symbols(spark, d), "name=~blue*,kind=method").select("id", "name")


@query("SELECT id, CASE kind WHEN 'method' THEN 'm' || id WHEN 'function' THEN CASE WHEN id % 2 = 0 THEN 'f' || id ELSE 'g' || id END ELSE 'unknown' END AS declared FROM symbols", ("symbols",))
def flt_name_extract(spark, d):
    s = fx.symbols(spark, d)
    i = F.col("id").cast("string")
    function = F.when(F.col("id") % 2 == 0, F.concat(F.lit("def f"), i, F.lit("(a, b):"))).otherwise(F.concat(F.lit("function g"), i, F.lit("(a) {")))
    method = F.concat(F.lit("public static List<int> m"), i, F.lit("(int a) {"))
    code = F.when(F.col("kind") == "class", F.concat(F.lit("class c"), i, F.lit(" {"))).when(F.col("kind") == "method", method).when(F.col("kind") == "function", function).otherwise("x = 1")
    return s.select("id", tx.name_of(code).alias("declared"))


@query("SELECT id, CAST(complexity % 4 AS INTEGER) AS params FROM symbols", ("symbols",))
def flt_params(spark, d):
    names = F.concat_ws(", ", F.slice(F.array(*[F.lit(x) for x in ("a", "Map<K, List<Pair<V, W>>> b", "c = 1")]), F.lit(1), (F.col("complexity") % 4).cast("int")))
    return fx.symbols(spark, d).select("id", tx.param_count(F.concat(F.lit("void f("), names, F.lit(") {"))).cast("int").alias("params"))


@query("SELECT id FROM symbols WHERE kind = 'method' OR kind = 'class'", ("symbols",))
def flt_modifier(spark, d):
    s = fx.symbols(spark, d)
    code = F.concat(F.when(F.col("kind").isin("method", "class"), "public static").otherwise("publicly"), F.lit(" f() {\n public static }"))
    return s.where(tx.has_modifier(code, "public")).select("id")


@query("SELECT id FROM symbols WHERE (contains(lower(name), 'gear') OR contains(lower(name), 'bolt')) AND contains(lower(language), 'java') AND NOT contains(file, '/tests/')", ("symbols",))
def flt_chain(spark, d):
    return fx.symbols(spark, d).where(predicate({"name": ["Gear", "bolt"], "language": "java", "test": False})).select("id")


@query("SELECT id FROM symbols WHERE NOT contains(lower(name), 'ring')", ("symbols",))
def flt_chain_not(spark, d):
    return fx.symbols(spark, d).where(~predicate({"name": "ring"})).select("id")


@query("+ p AS (SELECT DISTINCT CASE id % 8 WHEN 0 THEN file WHEN 1 THEN 'specs/' || file WHEN 2 THEN 'test_a' || (id % 5) || '.py' WHEN 3 THEN 'lib/test_b' || (id % 5) || '.py' WHEN 4 THEN 'lib/c_test.go' WHEN 5 THEN 'lib/d.spec.jsx' WHEN 6 THEN 'gen/e.ts' ELSE 'a/Vendor/fixtures/f.go' END AS file, id % 8 AS k FROM symbols) SELECT file, CASE k WHEN 0 THEN contains(file, '/tests/') WHEN 1 THEN contains(file, '/tests/') WHEN 2 THEN true WHEN 3 THEN true WHEN 4 THEN true WHEN 7 THEN true ELSE false END AS test, CASE k WHEN 0 THEN contains(file, '/tests/') WHEN 1 THEN true WHEN 2 THEN true WHEN 4 THEN true WHEN 5 THEN true WHEN 7 THEN true ELSE false END AS canonical, CASE k WHEN 0 THEN contains(file, '/gen/') WHEN 1 THEN contains(file, '/gen/') WHEN 7 THEN true ELSE false END AS generated FROM p", ("symbols",))
def flt_test_path(spark, d):
    k, five = F.col("id") % 8, (F.col("id") % 5).cast("string")
    file = F.when(k == 0, F.col("file")).when(k == 1, F.concat(F.lit("specs/"), "file")).when(k == 2, F.concat(F.lit("test_a"), five, F.lit(".py"))).when(k == 3, F.concat(F.lit("lib/test_b"), five, F.lit(".py")))
    file = file.when(k == 4, "lib/c_test.go").when(k == 5, "lib/d.spec.jsx").when(k == 6, "gen/e.ts").otherwise("a/Vendor/fixtures/f.go")
    f = fx.symbols(spark, d).select(file.alias("file")).distinct()
    return f.select("file", tx.is_test_path(F.col("file")).alias("test"), tx.is_test_path_canonical(F.col("file")).alias("canonical"), tx.is_generated_path(F.col("file")).alias("generated"))


@query("SELECT id, file FROM symbols WHERE regexp_full_match(file, 'src/(?:.*/)?brand1[^/]*/[^/]*[.]py')", ("symbols",))
def flt_glob(spark, d):
    return fx.symbols(spark, d).where(F.col("file").rlike(tx.glob_regex("src/**/brand1*/*.py"))).select("id", "file")


@query("SELECT id FROM symbols s WHERE NOT (contains(file, '/tests/') AND EXISTS (SELECT 1 FROM symbols t WHERE lower(t.name) = lower(s.name) AND NOT contains(t.file, '/tests/')))", ("symbols",))
def flt_test_shadow(spark, d):
    s = fx.symbols(spark, d).withColumn("test", tx.is_test_path(F.col("file"))).withColumn("low", F.lower("name"))
    real = s.where("not test").select("low").distinct()
    return s.where("not test").select("id").unionByName(s.where("test").join(real, "low", "left_anti").select("id"))


@query("SELECT id, array_to_string(list_slice(string_split(content, chr(10)), 2, 4), chr(10)) AS part FROM files", ("files",))
def flt_range_read(spark, d):
    return fx.files(spark, d).select("id", F.array_join(F.slice(F.split("content", "\n"), 2, 3), "\n").alias("part"))


@query("SELECT id, name || ' ' || kind || ' ' || file || ' ' || language AS text FROM symbols", ("symbols",))
def prj_symbol_text(spark, d):
    return fx.symbols(spark, d).select("id", tx.symbol_text().alias("text"))


_STRIP = "CASE WHEN w LIKE '%ing' AND length(w) > 5 THEN w[:-4] WHEN w LIKE '%ers' AND length(w) > 5 THEN w[:-4] WHEN w LIKE '%er' AND length(w) > 4 THEN w[:-3] WHEN w LIKE '%ed' AND length(w) > 4 THEN w[:-3] WHEN w LIKE '%es' AND length(w) > 4 THEN w[:-3] WHEN w LIKE '%s' AND length(w) > 3 THEN w[:-2] ELSE w END"
_TOKENS = f"+ tok AS (SELECT id, w FROM (SELECT id, {_STRIP} AS w FROM (SELECT id, unnest(string_split(trim(regexp_replace(name || ' ' || kind || ' ' || file || ' ' || language, '[^A-Za-z0-9]+', ' ', 'g')), ' ')) AS w FROM symbols) a) b WHERE length(w) >= 2)"


@query(_TOKENS + " SELECT id, w AS token, count(*) AS n FROM tok GROUP BY 1, 2", ("symbols",))
def prj_vectorize(spark, d):
    return search.vectors(fx.symbols(spark, d).repartition(fx.tasks(spark, d, "part", 8), "id")).select("id", F.col("w").alias("token"), F.col("c").alias("n"))


# -- joins -------------------------------------------------------------------


@query("SELECT id FROM symbols s WHERE EXISTS (SELECT 1 FROM call_edges e WHERE e.callee_name = s.name AND e.callee_file = s.file)", ("call_edges",))
def join_dual_key(spark, d):
    s = fx.symbols(spark, d)
    e = fx.call_edges(spark, d).select(F.col("callee_name").alias("name"), F.col("callee_file").alias("file")).distinct()
    return s.join(e, ["name", "file"], "left_semi").select("id")


@query("SELECT point_id, span_id FROM (SELECT p.id AS point_id, s.id AS span_id, row_number() OVER (PARTITION BY p.id ORDER BY s.end_line - s.line, s.line DESC, s.id) AS k FROM symbols p JOIN symbols s ON p.file = s.file AND p.line BETWEEN s.line AND s.end_line) x WHERE k = 1", ("symbols",))
def join_point_in_interval(spark, d):
    s = fx.symbols(spark, d)
    r = resolve.enclosing(s.select(F.col("id").alias("point_id"), "file", "line"), s.select(F.col("id").alias("span_id"), "file", "line", "end_line"))
    return r.where("inside").select("point_id", "span_id")


@query("SELECT s.id AS symbol_id, count(DISTINCT h.id) AS hunks FROM symbols s JOIN (SELECT id, file, line + 3 AS a, line + 5 AS b FROM symbols) h ON h.file = s.file AND h.b >= s.line AND h.a <= s.end_line GROUP BY 1", ("symbols",))
def join_interval_overlap(spark, d):
    s = fx.symbols(spark, d)
    bins = lambda a, b: F.explode(F.sequence(F.floor(a / 64), F.floor(b / 64)))
    spans = s.select(F.col("id").alias("symbol_id"), "file", "line", "end_line", bins(F.col("line"), F.col("end_line")).alias("bin"))
    hunks = s.select("id", "file", (F.col("line") + 3).alias("a"), (F.col("line") + 5).alias("b")).withColumn("bin", bins(F.col("a"), F.col("b")))
    return spans.join(hunks, ["file", "bin"]).where("b >= line and a <= end_line").groupBy("symbol_id").agg(F.countDistinct("id").alias("hunks"))


@query("SELECT id, lag(total) OVER (PARTITION BY file ORDER BY ts, id) AS previous FROM health", ("health",))
def join_as_of(spark, d):
    return fx.health(spark, d).select("id", F.lag("total").over(W.partitionBy("file").orderBy("ts", "id")).alias("previous"))


@query("SELECT id FROM files WHERE id NOT IN (SELECT doc_id FROM labels)", ("files",))
def join_anti(spark, d):
    return fx.files(spark, d).join(fx.table(spark, d, "labels").select(F.col("doc_id").alias("id")), "id", "left_anti").select("id")


# -- aggregates --------------------------------------------------------------


@query("SELECT 'language' AS dimension, language AS value, count(*) AS n FROM symbols GROUP BY 2 UNION ALL SELECT 'kind', kind, count(*) FROM symbols GROUP BY 2 UNION ALL SELECT 'all', '*', count(*) FROM symbols", ("symbols",))
def agg_stats(spark, d):
    return metrics.stats(fx.symbols(spark, d))


@query("SELECT count(*) AS total, count(*) AS resolved, count(*) FILTER (WHERE caller_file <> callee_file) AS cross_file, round(100.0 * count(*) FILTER (WHERE caller_file <> callee_file) / count(*), 2) AS pct FROM call_edges", ("call_edges",))
def agg_cross_file(spark, d):
    return metrics.cross_file(fx.call_edges(spark, d))


_FILE_IMPORTS = "SELECT DISTINCT caller_file AS src, callee_file AS dst FROM call_edges WHERE caller_file <> callee_file AND weight > 1"
_COUPLING = f"SELECT least(a, b) AS file_a, greatest(a, b) AS file_b, CAST(sum(i) AS BIGINT) AS imports, CAST(sum(c) AS BIGINT) AS calls, CAST(2.0 * sum(i) + sum(c) AS DOUBLE) AS score, 2.0 * sum(i) + sum(c) >= 5 AS high FROM (SELECT src AS a, dst AS b, 1 AS i, 0 AS c FROM ({_FILE_IMPORTS}) f UNION ALL SELECT caller_file, callee_file, 0, 1 FROM call_edges) x WHERE a <> b GROUP BY 1, 2"


def _file_imports(spark, d):
    """Imports between files: a file imports what it calls more than once."""
    e = fx.call_edges(spark, d).where("caller_file <> callee_file and weight > 1")
    return e.select(F.col("caller_file").alias("src"), F.col("callee_file").alias("dst")).distinct()


def _coupling(spark, d):
    ends = lambda e, a, b: e.select(F.col(a).alias("a"), F.col(b).alias("b"))
    return metrics.coupling(ends(_file_imports(spark, d), "src", "dst"), ends(fx.call_edges(spark, d), "caller_file", "callee_file"))


@query(_COUPLING, ("call_edges",))
def agg_coupling(spark, d):
    return _coupling(spark, d)


@query("SELECT module, CAST(sum(a) AS BIGINT) AS afferent, CAST(sum(e) AS BIGINT) AS efferent, round(sum(e) / CAST(sum(a) + sum(e) AS DOUBLE), 4) AS instability FROM (SELECT src AS module, 0 AS a, 1 AS e FROM imports UNION ALL SELECT dst, 1, 0 FROM imports) x GROUP BY 1", ("imports",))
def agg_instability(spark, d):
    return metrics.instability(fx.imports(spark, d))


@query(f"+ p AS ({_COUPLING}), m AS (SELECT module, sum(e) / CAST(sum(a) + sum(e) AS DOUBLE) AS i FROM (SELECT src AS module, 0 AS a, 1 AS e FROM ({_FILE_IMPORTS}) u UNION ALL SELECT dst, 1, 0 FROM ({_FILE_IMPORTS}) v) x GROUP BY 1) SELECT (SELECT count(*) FROM m) AS modules, (SELECT count(*) FROM m WHERE round(i, 4) >= 0.7) AS unstable, count(*) AS pairs, count(*) FILTER (WHERE high) AS high, round(avg(score), 2) AS avg_score, max(score) AS max_score FROM p", ("call_edges",))
def agg_matrix_summary(spark, d):
    return metrics.matrix_summary(_coupling(spark, d), metrics.instability(_file_imports(spark, d)))


@query("+ e AS (SELECT src_package AS a, dst_package AS b, weight FROM imports UNION ALL SELECT dst_package, src_package, weight FROM imports) SELECT a, " + ", ".join(f"CAST(sum(weight) FILTER (WHERE b = {k}) AS BIGINT) AS \"{k}\"" for k in range(5)) + " FROM e GROUP BY 1", ("imports",))
def agg_matrix_pivot(spark, d):
    return metrics.matrix(fx.imports(spark, d).select(F.col("src_package").alias("a"), F.col("dst_package").alias("b"), "weight"), [0, 1, 2, 3, 4])


@query("SELECT file, count(*) AS functions, CAST(sum(complexity) AS BIGINT) AS total, round(avg(complexity), 2) AS average, max(complexity) AS maximum FROM symbols GROUP BY 1", ("symbols",))
def agg_heatmap_file(spark, d):
    return metrics.heatmap_file(fx.symbols(spark, d))


@query("SELECT CASE WHEN complexity <= 5 THEN 'low' WHEN complexity <= 10 THEN 'medium' WHEN complexity <= 20 THEN 'high' ELSE 'critical' END AS band, count(*) AS n FROM symbols GROUP BY 1", ("symbols",))
def agg_risk_hist(spark, d):
    return metrics.risk_histogram(fx.symbols(spark, d))


@query("SELECT s.id AS node, (SELECT count(*) FROM calls WHERE callee = s.id) AS fan_in, (SELECT count(*) FROM calls WHERE caller = s.id) AS fan_out FROM symbols s", ("call_edges",))
def agg_fan(spark, d):
    return graph.degrees(_ids(spark, d), _nodes(spark, d))


@query("SELECT s.name, coalesce(max(u.users), 0) AS users, count(DISTINCT s.file) > 1 AS ambiguous FROM symbols s LEFT JOIN (SELECT callee_name, count(DISTINCT caller_file) AS users FROM call_edges GROUP BY 1) u ON u.callee_name = s.name GROUP BY 1", ("call_edges",))
def agg_symbol_in_degree(spark, d):
    return metrics.symbol_in_degree(fx.call_edges(spark, d), fx.symbols(spark, d))


@query("SELECT regexp_replace(file, '/?[^/]*$', '') AS module, count(DISTINCT file) AS files, count(*) FILTER (WHERE kind IN ('function', 'method')) AS functions, count(*) FILTER (WHERE kind = 'class') AS classes, count(*) FILTER (WHERE kind = 'import') AS imports, count(DISTINCT language) AS languages FROM symbols GROUP BY 1", ("symbols",))
def agg_sitemap_module(spark, d):
    return metrics.sitemap(fx.symbols(spark, d))


@query("SELECT kind, k, id, n FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY file, line, id) AS k, count(*) OVER (PARTITION BY kind) AS n FROM symbols) x WHERE k <= 25", ("symbols",))
def agg_flat(spark, d):
    return metrics.flat(fx.symbols(spark, d), 25)


@query("+ p AS (SELECT caller_file AS file, callee_file, sum(weight) AS w FROM call_edges WHERE caller_file <> callee_file GROUP BY 1, 2) SELECT file, CAST(sum(w) AS BIGINT) AS outgoing, count(*) AS targets, array_to_string(list_slice(list(callee_file ORDER BY w DESC, callee_file), 1, 5), ',') AS top_targets FROM p GROUP BY 1", ("call_edges",))
def agg_module_coupling(spark, d):
    return metrics.module_coupling(fx.call_edges(spark, d))


@query("SELECT src_package, dst_package, CAST(sum(weight) AS BIGINT) AS weight, count(*) AS edges FROM imports WHERE src_package <> dst_package GROUP BY 1, 2", ("imports",))
def agg_package_graph(spark, d):
    return metrics.package_graph(fx.imports(spark, d))


@query("SELECT file_a, file_b, shared, round(shared * (SELECT count(DISTINCT sha) FROM commit_files) / CAST(na * nb AS DOUBLE), 4) AS lift FROM (SELECT a.file AS file_a, b.file AS file_b, count(*) AS shared FROM commit_files a JOIN commit_files b ON a.sha = b.sha AND a.file < b.file GROUP BY 1, 2 HAVING count(*) >= 3) p JOIN (SELECT file, count(*) AS na FROM commit_files GROUP BY 1) x ON x.file = file_a JOIN (SELECT file, count(*) AS nb FROM commit_files GROUP BY 1) y ON y.file = file_b", ("commit_files",))
def agg_cochange_lift(spark, d):
    return metrics.cochange(fx.commit_files(spark, d))


@query("SELECT file, count(*) FILTER (WHERE date_diff('day', CAST(ts AS DATE), DATE '2001-08-01') BETWEEN 0 AND 29) AS mod_30d, count(*) FILTER (WHERE date_diff('day', CAST(ts AS DATE), DATE '2001-08-01') BETWEEN 0 AND 89) AS mod_90d, count(*) AS mod_all, arg_max(sha, (ts, sha)) AS last_commit FROM commit_files GROUP BY 1", ("commit_files",))
def agg_activation(spark, d):
    return metrics.activation(fx.commit_files(spark, d), "2001-08-01")


_DIMENSIONS = {
    "size": (10, "greatest(0.0, 100.0 - complexity)"), "complexity": (25, "CASE WHEN class IS NOT NULL THEN line % 100 END"), "dependencies": (20, "end_line % 100"), "coverage": (10, "CASE WHEN kind = 'function' THEN id * 7 % 101 END"),
    "duplication": (10, "id * 3 % 101"), "structure": (15, "CASE WHEN language <> 'go' THEN id * 5 % 101 END"), "hotspot": (10, "id * 11 % 101"),
}
_WEIGHTED = "round((" + " + ".join(f"{w}.0 * coalesce({x}, 0)" for w, x in _DIMENSIONS.values()) + ") / (" + " + ".join(f"CASE WHEN {x} IS NULL THEN 0.0 ELSE {w}.0 END" for w, x in _DIMENSIONS.values()) + "), 4)"


@query(f"SELECT id, total, CASE WHEN total >= 90 THEN 'A' WHEN total >= 80 THEN 'B' WHEN total >= 70 THEN 'C' WHEN total >= 50 THEN 'D' ELSE 'F' END AS grade FROM (SELECT id, CAST({_WEIGHTED} AS DOUBLE) AS total FROM symbols) x", ("symbols",))
def agg_weighted_health(spark, d):
    """All seven dimensions, some of them missing."""
    i = F.col("id")
    rows = fx.symbols(spark, d).select(
        "id", F.greatest(F.lit(0.0), 100.0 - F.col("complexity")).alias("size"), F.when(F.col("class").isNotNull(), F.col("line") % 100).cast("double").alias("complexity"), (F.col("end_line") % 100).cast("double").alias("dependencies"),
        F.when(F.col("kind") == "function", i * 7 % 101).cast("double").alias("coverage"), (i * 3 % 101).cast("double").alias("duplication"), F.when(F.col("language") != "go", i * 5 % 101).cast("double").alias("structure"), (i * 11 % 101).cast("double").alias("hotspot"),
    )
    return metrics.weighted_health(rows, quality.HEALTH_WEIGHTS).select("id", "total", "grade")


def _sql(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _without_comments(x: str) -> str:
    for p in tx.NOT_CODE:
        x = f"regexp_replace({x}, {_sql(p)}, '', 'g')"
    return x


_BLOCKS = f"+ l AS (SELECT id, string_split_regex(content, {_sql(tx.LINE_END)}) AS v FROM files), w AS (SELECT id, list_transform(CASE WHEN v[-1] = '' THEN v[:-2] ELSE v END, lambda x: regexp_replace(x, {_sql(f'^{tx.BLANK}+|{tx.BLANK}+$')}, '', 'g')) AS v FROM l), b AS (SELECT id, v[i] || chr(10) || v[i + 1] || chr(10) || v[i + 2] AS b, count(*) AS n FROM (SELECT id, v, unnest(range(1, len(v) - 1)) AS i FROM w WHERE len(v) >= 10) x GROUP BY 1, 2) SELECT f.id, count(b.b) AS blocks, count(b.b) FILTER (WHERE n > 1) AS repeated FROM files f LEFT JOIN b ON b.id = f.id AND b.b <> chr(10) || chr(10) GROUP BY 1"


@query(_BLOCKS, ("files",))
def agg_dup_blocks(spark, d):
    return metrics.duplicate_blocks(fx.files(spark, d))


_GATE = "(x = y OR (x = 'javascript' AND y = 'typescript') OR (x = 'typescript' AND y = 'javascript'))"


@query("+ l AS (SELECT name, list(DISTINCT language) AS langs FROM symbols GROUP BY 1) SELECT count(*) AS total, count(langs) AS resolvable, count(*) FILTER (WHERE NOT " + _GATE.replace("x", "caller_language").replace("y ", "callee_language ").replace("y)", "callee_language)").replace("= y", "= callee_language") + ") AS cross_language, count(*) FILTER (WHERE langs IS NOT NULL AND len(list_filter(langs, lambda z: z = caller_language OR (z = 'javascript' AND caller_language = 'typescript') OR (z = 'typescript' AND caller_language = 'javascript'))) = 0) AS naive_only FROM call_edges e LEFT JOIN l ON l.name = e.callee_name", ("call_edges",))
def agg_audit(spark, d):
    return resolve.audit(fx.call_edges(spark, d), fx.symbols(spark, d))


@query("SELECT count(*) AS edges, round(100.0 * count(*) FILTER (WHERE caller_language = callee_language) / count(*), 2) AS rate FROM call_edges", ("call_edges",))
def agg_classification_rate(spark, d):
    return metrics.classification_rate(fx.call_edges(spark, d), F.when(F.col("caller_language") == F.col("callee_language"), "project").otherwise("unknown"))


@query("SELECT user_id AS \"group\", count(*) AS changes, count(DISTINCT event_type) AS categories, list_extract(['error', 'purchase', 'signup', 'click', 'view'], CAST(min(list_position(['error', 'purchase', 'signup', 'click', 'view'], event_type)) AS INTEGER)) AS dominant, CASE WHEN max(CASE WHEN event_type IN ('error', 'purchase') THEN value / 500 END) >= 0.7 THEN 'high' WHEN max(CASE WHEN event_type IN ('error', 'purchase') THEN value / 500 END) >= 0.6 THEN 'medium' ELSE 'low' END AS risk FROM events GROUP BY 1")
def agg_change_counts(spark, d):
    e = fx.table(spark, d, "events").select(F.col("user_id").alias("group"), F.col("event_type").alias("category"), F.col("event_type").isin("error", "purchase").alias("high_risk"), (F.col("value") / 500).alias("confidence"))
    return metrics.change_counts(e, ["error", "purchase", "signup", "click", "view"])


# -- ranking -----------------------------------------------------------------

_BM = "blue gear"


def _bm25_sql() -> str:
    cols = {"name": 10.0, "kind": 0.5, "file": 0.5, "language": 0.1}
    each = " UNION ALL ".join(f"SELECT id, '{c}' AS col, {w} AS cw, unnest(string_split(trim(lower(regexp_replace({c}, '[^A-Za-z0-9]+', ' ', 'g'))), ' ')) AS w FROM symbols" for c, w in cols.items())
    return f"""+ tok AS (SELECT id, cw, {_STRIP} AS w FROM ({each}) a), t AS (SELECT * FROM tok WHERE length(w) >= 2),
      len AS (SELECT s.id, coalesce(count(t.w), 0) AS length FROM symbols s LEFT JOIN t ON t.id = s.id GROUP BY 1),
      tf AS (SELECT id, w, sum(cw) AS tf FROM t WHERE w IN ('blue', 'gear') GROUP BY 1, 2), df AS (SELECT w, count(*) AS df FROM tf GROUP BY 1),
      st AS (SELECT count(*) AS n, avg(length) AS mean FROM len),
      raw AS (SELECT tf.id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * length / mean))) AS raw FROM tf JOIN df USING (w) JOIN len USING (id) CROSS JOIN st GROUP BY 1),
      b AS (SELECT min(raw) AS low, max(raw) AS high FROM raw)
      SELECT s.id, s.name, s.file, round(CASE WHEN high - low > 0 THEN (raw - low) / (high - low) ELSE 1.0 END * CASE kind WHEN 'type' THEN 0.95 WHEN 'constant' THEN 0.9 WHEN 'import' THEN 0.6 ELSE 1.0 END, 6) AS score FROM raw JOIN symbols s USING (id) CROSS JOIN b"""


@query(_bm25_sql(), ("symbols",))
def rank_bm25(spark, d):
    return search.bm25(fx.symbols(spark, d), _BM)


@query(_bm25_sql() .replace("+ tok AS", "+ bm AS (WITH tok AS", 1) + "), c AS (SELECT s.*, bm.score AS rank, levenshtein(regexp_replace(lower(s.name), '[^a-z0-9]', '', 'g'), 'bluegear') AS edits FROM symbols s LEFT JOIN bm USING (id)), t AS (SELECT *, CASE WHEN name = 'blue gear' THEN 0 WHEN rank IS NOT NULL THEN 1 WHEN contains(lower(name), 'blue gear') THEN 2 WHEN edits <= 2 THEN 3 END AS tier FROM c), u AS (SELECT *, round(greatest(0.0, least(1.0, CASE tier WHEN 0 THEN 0.82 WHEN 1 THEN rank * 0.75 WHEN 2 THEN 0.42 ELSE 0.36 - 0.08 * edits END + CASE kind WHEN 'class' THEN 0.08 WHEN 'function' THEN 0.08 WHEN 'method' THEN 0.08 WHEN 'type' THEN 0.06 WHEN 'constant' THEN 0.04 WHEN 'import' THEN -0.08 ELSE 0.0 END + CASE WHEN lower(name) = 'blue gear' THEN 0.16 WHEN starts_with(lower(name), 'blue gear') THEN 0.12 WHEN contains(lower(name), 'blue gear') THEN 0.07 ELSE 0.0 END)), 3) AS sc, row_number() OVER (PARTITION BY name, file, line ORDER BY tier, id) AS k FROM t WHERE tier IS NOT NULL) SELECT id, name, file, tier, CAST(round(least(1.0, sc + least(0.06, 0.02 * (count(*) OVER (PARTITION BY file) - 1))), 3) AS DOUBLE) AS score, contains(file, '/tests/') AS test FROM u WHERE k = 1", ("symbols",))
def rank_cascade(spark, d):
    return search.cascade(fx.symbols(spark, d), "blue gear")


@query("SELECT id, name, levenshtein(name, 'red bolts') AS distance FROM symbols WHERE levenshtein(name, 'red bolts') <= 2", ("symbols",))
def rank_fuzzy(spark, d):
    return search.fuzzy(fx.symbols(spark, d), "red bolts").withColumn("distance", F.col("distance").cast("bigint"))


@query(_TOKENS + ", c AS (SELECT id, w, count(*) AS c FROM tok GROUP BY 1, 2), n AS (SELECT id, sqrt(sum(c * c)) AS norm FROM c GROUP BY 1) SELECT id, round(sum(c) / (any_value(norm) * sqrt(3.0)), 4) AS score FROM c JOIN n USING (id) WHERE w IN ('blue', 'gear', 'method') GROUP BY 1", ("symbols",))
def rank_semantic(spark, d):
    return search.semantic(fx.symbols(spark, d).repartition(fx.tasks(spark, d, "part", 8), "id"), "blue gear method")


@query("SELECT id, name, regexp_matches(name, '(^| )gi') AS by_word FROM symbols WHERE contains(name, 'gi')", ("symbols",))
def rank_symbol_prefix(spark, d):
    return search.prefix_terms(fx.symbols(spark, d), "gi")


@query("SELECT id, name, file, complexity FROM symbols ORDER BY complexity DESC, file, id LIMIT 20", ("symbols",))
def rank_topk_hotspots(spark, d):
    return metrics.hotspots(fx.symbols(spark, d))


@query("SELECT file, k, id, complexity FROM (SELECT *, row_number() OVER (PARTITION BY file ORDER BY complexity DESC, id) AS k FROM symbols) x WHERE k <= 5", ("symbols",))
def rank_top_per_file(spark, d):
    return metrics.top_per_file(fx.symbols(spark, d))


@query(f"SELECT file_a, file_b, score FROM ({_COUPLING}) p ORDER BY score DESC, file_a, file_b LIMIT 10", ("call_edges",))
def rank_most_coupled(spark, d):
    return _coupling(spark, d).orderBy(F.desc("score"), "file_a", "file_b").limit(10).select("file_a", "file_b", "score")


@query("SELECT id, row_number() OVER (ORDER BY contains(file, '/tests/'), contains(file, '/gen/'), file, line, name, id) AS place FROM symbols", ("symbols",))
def rank_source_pref(spark, d):
    keys = [tx.is_test_path(F.col("file")), tx.is_generated_path(F.col("file")), F.col("file"), F.col("line"), F.col("name"), F.col("id")]
    return search.places(fx.symbols(spark, d), keys).select("id", "place")


def _pagerank_sql(rounds: int) -> str:
    parts = ["+ e AS MATERIALIZED (SELECT caller AS src, callee AS dst FROM calls)", "o AS MATERIALIZED (SELECT src, count(*) AS out FROM e GROUP BY 1)", "v AS MATERIALIZED (SELECT id AS node, coalesce(out, 0) AS out, count(*) OVER () AS n FROM symbols LEFT JOIN o ON o.src = symbols.id)", "r0 AS MATERIALIZED (SELECT node, out, n, 1.0::DOUBLE / n AS rank, 1e9::DOUBLE AS moved FROM v)"]
    for k in range(1, rounds + 1):
        new = f"0.15 / r.n + 0.85 * (SELECT coalesce(sum(rank), 0) FROM r{k - 1} WHERE out = 0) / r.n + 0.85 * coalesce(g.got, 0)"
        parts.append(f"s{k} AS MATERIALIZED (SELECT r.node, r.out, r.n, r.rank AS old, r.moved, CASE WHEN r.moved < 1e-6 * r.n THEN r.rank ELSE {new} END AS rank FROM r{k - 1} r LEFT JOIN (SELECT e.dst, sum(p.rank / p.out) AS got FROM e JOIN r{k - 1} p ON p.node = e.src GROUP BY 1) g ON g.dst = r.node)")
        parts.append(f"r{k} AS MATERIALIZED (SELECT node, out, n, rank, CASE WHEN moved < 1e-6 * n THEN moved ELSE sum(abs(rank - old)) OVER () END AS moved FROM s{k})")
    return ", ".join(parts) + f" SELECT node, round(rank, 9) AS rank, (SELECT count(*) FROM e WHERE dst = node) AS inbound FROM r{rounds}"


@query(_pagerank_sql(40), ("call_edges",))
def rank_pagerank(spark, d):
    """Until the ranks together move by less than a millionth a node; the SQL has as many rounds and repeats the last one."""
    r = graph.pagerank(_ids(spark, d), _nodes(spark, d), max_iter=100)
    return r.select("node", F.round("rank", 9).alias("rank"), "inbound")


@query("SELECT id, row_number() OVER (PARTITION BY class ORDER BY line, id) AS position, count(*) OVER (PARTITION BY class) AS siblings FROM symbols WHERE class IS NOT NULL", ("symbols",))
def win_position(spark, d):
    w = W.partitionBy("class")
    return fx.symbols(spark, d).where("class is not null").select("id", F.row_number().over(w.orderBy("line", "id")).alias("position"), F.count("*").over(w).alias("siblings"))


@query("SELECT file, k, id, total FROM (SELECT *, row_number() OVER (PARTITION BY file ORDER BY ts DESC, id DESC) AS k FROM health) x WHERE k <= 3", ("health",))
def win_latest(spark, d):
    return metrics.latest(fx.health(spark, d), 3).select("file", "k", "id", "total")


_GRADE = "CASE WHEN total >= 90 THEN 'A' WHEN total >= 80 THEN 'B' WHEN total >= 70 THEN 'C' WHEN total >= 50 THEN 'D' ELSE 'F' END"


@query(f"+ g AS (SELECT *, {_GRADE} AS grade FROM health), p AS (SELECT *, lag(grade) OVER (PARTITION BY file ORDER BY ts, id) AS previous FROM g), r AS (SELECT *, strpos('ABCDF', grade) AS a, strpos('ABCDF', previous) AS b FROM p) SELECT id, file, previous, grade FROM r WHERE CASE WHEN previous IS NULL THEN a >= 4 ELSE a > b AND (a >= 4 OR b >= 4 OR a - b >= 2) END", ("health",))
def win_jitter_alert(spark, d):
    return metrics.alerts(fx.health(spark, d))


# -- sets --------------------------------------------------------------------


@query("SELECT DISTINCT name, file, line FROM symbols WHERE kind = 'class' OR complexity > 40", ("symbols",))
def set_union(spark, d):
    s = fx.symbols(spark, d).select("name", "file", "line", "kind", "complexity")
    return sets.union(s.where("kind = 'class'"), s.where("complexity > 40")).select("name", "file", "line")


@query("SELECT id FROM symbols WHERE kind = 'class' AND complexity > 20", ("symbols",))
def set_intersect(spark, d):
    s = fx.symbols(spark, d)
    return s.where("kind = 'class'").select("id").intersect(s.where("complexity > 20").select("id"))


@query("SELECT id, kind, CASE WHEN complexity > 20 THEN 'added' ELSE 'removed' END AS change FROM symbols WHERE (complexity > 20) <> (complexity <= 30)", ("symbols",))
def set_delta(spark, d):
    s = fx.symbols(spark, d)
    return sets.delta(s.where("complexity <= 30").select("id", "kind"), s.where("complexity > 20").select("id", "kind"))


@query("SELECT DISTINCT ON (name) name, id FROM symbols ORDER BY name, file, line, id", ("symbols",))
def set_dedupe(spark, d):
    return sets.first_of(fx.symbols(spark, d), ["name"], ["file", "line", "id"]).select("name", "id")


@query("SELECT path, CASE WHEN b.doc_id IS NULL THEN 'deleted' WHEN a.doc_id IS NULL THEN 'new' WHEN a.n_chars = b.n_chars THEN 'unchanged' ELSE 'updated' END AS status FROM (SELECT * FROM documents WHERE lang <> 'fr') a FULL JOIN (SELECT doc_id, n_chars + CASE WHEN lang = 'es' THEN 1 ELSE 0 END AS n_chars, source, lang FROM documents WHERE lang <> 'de') b ON a.doc_id = b.doc_id, LATERAL (SELECT coalesce(a.source, b.source) || '/' || coalesce(a.lang, b.lang) || '/' || coalesce(a.doc_id, b.doc_id) || '.txt' AS path)")
def set_sync_diff(spark, d):
    f = fx.files(spark, d).select("path", "language", F.length("content").alias("size"), F.md5(F.col("content").cast("binary")).alias("digest"))
    new = f.where("language <> 'de'").withColumn("size", F.col("size") + F.when(F.col("language") == "es", 1).otherwise(0))
    return sets.sync_diff(f.where("language <> 'fr'"), new)


# -- graph -------------------------------------------------------------------


def _ids(spark, d):
    return fx.calls(spark, d).select(F.col("caller").alias("src"), F.col("callee").alias("dst"))


def _nodes(spark, d):
    return fx.symbols(spark, d).select(F.col("id").alias("node"))


def _seed(spark, *ids):
    return spark.createDataFrame([(i,) for i in ids], "node bigint")


def _reach_sql(up: bool, depth: int, where: str = "FROM r WHERE d > 0 AND node <> 243 GROUP BY 1") -> str:
    a, b = ("callee", "caller") if up else ("caller", "callee")
    return f"+ r AS (SELECT CAST({SEED} AS BIGINT) AS node, 0 AS d UNION SELECT c.{b}, d + 1 FROM r JOIN calls c ON c.{a} = r.node WHERE d < {depth}) SELECT node, CAST(min(d) AS INTEGER) AS depth {where}"


@query(_reach_sql(True, 3), ("call_edges",), True)
def g_callers_bfs(spark, d):
    return graph.reach(graph.reverse(_ids(spark, d)), _seed(spark, SEED), 3).select("node", "depth")


@query(_reach_sql(False, 3), ("call_edges",), True)
def g_callees_bfs(spark, d):
    return graph.reach(_ids(spark, d), _seed(spark, SEED), 3).select("node", "depth")


@query(f"+ r AS (SELECT CAST({SEED} AS BIGINT) AS node, 0 AS d UNION SELECT c.callee, d + 1 FROM r JOIN calls c ON c.caller = r.node WHERE d < 1), m AS (SELECT node, min(d) AS d FROM r GROUP BY 1) SELECT c.caller AS src, c.callee AS dst, CAST(m.d + 1 AS INTEGER) AS depth FROM m JOIN calls c ON c.caller = m.node", ("call_edges",), True)
def g_call_chain(spark, d):
    return graph.chain(_ids(spark, d), _seed(spark, SEED), 2)


@query(f"SELECT caller, callee, CASE WHEN caller = {SEED} THEN 'out' ELSE 'in' END AS direction FROM calls WHERE caller = {SEED} OR callee = {SEED}", ("call_edges",))
def g_edges_of(spark, d):
    e = fx.calls(spark, d).where((F.col("caller") == SEED) | (F.col("callee") == SEED))
    return e.select("caller", "callee", F.when(F.col("caller") == SEED, "out").otherwise("in").alias("direction"))


@query("+ r AS (SELECT 'r0' AS node, 0 AS d UNION ALL SELECT child, d + 1 FROM r JOIN contains ON parent = node) SELECT node, d AS depth FROM r WHERE d > 0", ("contains",), True)
def g_subclasses(spark, d):
    e = fx.contains(spark, d).select(F.col("parent").alias("src"), F.col("child").alias("dst"))
    return graph.reach(e, spark.createDataFrame([("r0",)], "node string")).select("node", "depth")


@query("+ r AS (SELECT 'c7' AS node, 0 AS d UNION ALL SELECT parent, d + 1 FROM r JOIN contains ON child = node) SELECT node, d AS depth FROM r WHERE d > 0", ("contains",), True)
def g_superclasses(spark, d):
    e = fx.contains(spark, d).select(F.col("child").alias("src"), F.col("parent").alias("dst"))
    return graph.reach(e, spark.createDataFrame([("c7",)], "node string")).select("node", "depth")


@query("SELECT (SELECT count(*) FROM (SELECT parent FROM contains UNION SELECT child FROM contains)) AS classes, (SELECT count(DISTINCT parent) FROM contains WHERE parent NOT IN (SELECT child FROM contains)) AS roots, (SELECT count(DISTINCT child) FROM contains WHERE child NOT IN (SELECT parent FROM contains)) AS leaves, 2 AS max_depth", ("contains",))
def g_hier_summary(spark, d):
    return graph.hierarchy_summary(fx.contains(spark, d).select(F.col("parent").alias("src"), F.col("child").alias("dst")))


@query("+ r AS (SELECT ['r1'] AS path, 'r1' AS node, 0 AS d UNION ALL SELECT list_append(path, child), child, d + 1 FROM r JOIN contains ON parent = node WHERE d < 3) SELECT array_to_string(path, '/') AS path, node, d AS depth, false AS circular FROM r", ("contains",), True)
def g_hier_tree(spark, d):
    t = graph.tree(fx.contains(spark, d).select(F.col("parent").alias("src"), F.col("child").alias("dst")), "r1", 3)
    return t.withColumn("path", F.array_join("path", "/"))


@query("+ r AS (SELECT [m.src] AS path, m.src AS node, 0 AS d, false AS circular FROM (SELECT 'm3' AS src) m UNION ALL SELECT list_append(path, dst), dst, d + 1, list_contains(path, dst) FROM r JOIN imports i ON i.src = r.node WHERE d < 3 AND NOT circular) SELECT array_to_string(path, '/') AS path, node, d AS depth, circular FROM r", ("imports",), True)
def g_tree(spark, d):
    return graph.tree(fx.imports(spark, d).select("src", "dst"), "m3", 3).withColumn("path", F.array_join("path", "/"))


@query("+ r AS (SELECT [CAST(243 AS BIGINT)] AS path, CAST(243 AS BIGINT) AS node, 0 AS d UNION ALL SELECT list_append(path, c.callee), c.callee, d + 1 FROM r JOIN calls c ON c.caller = r.node WHERE d < 3 AND node <> 100), h AS (SELECT path, d FROM r WHERE node = 100), b AS (SELECT path, d FROM h WHERE d = (SELECT min(d) FROM h) ORDER BY path LIMIT 5) SELECT array_to_string(path, '/') AS path, CAST(d AS INTEGER) AS hops FROM b", ("call_edges",), True)
def g_path(spark, d):
    return graph.shortest_paths(_ids(spark, d), SEED, 100, 3).select(F.array_join(F.transform("path", lambda x: x.cast("string")), "/").alias("path"), "hops")


@query(f"+ e AS ({_FILE_IMPORTS}), r AS (SELECT DISTINCT src AS node, 1 AS d FROM e WHERE contains(dst, '/gen/') UNION SELECT e.src, d + 1 FROM r JOIN e ON e.dst = r.node WHERE d < 10) SELECT node, CAST(min(d) AS INTEGER) AS depth FROM r WHERE node NOT IN (SELECT dst FROM e WHERE contains(dst, '/gen/')) GROUP BY 1", ("call_edges",), True)
def g_blast_file(spark, d):
    """What depends on a generated file, at ten hops at most."""
    e = _file_imports(spark, d)
    changed = e.where(tx.is_generated_path(F.col("dst"))).select(F.col("dst").alias("node"))
    return graph.flood(graph.reverse(e), changed, 10).where("depth > 0")


@query(f"+ e AS ({_FILE_IMPORTS}), r AS (SELECT src AS seed, dst AS node FROM e UNION SELECT r.seed, e.dst FROM r JOIN e ON e.src = r.node) SELECT seed, count(*) AS dependencies FROM r WHERE seed <> node GROUP BY 1", ("call_edges",), True)
def g_blast_forward(spark, d):
    """What each file depends on, counted: a row a file and dependency inside, as the question asks for every file."""
    e = _file_imports(spark, d)
    return graph.reach(e, e.select(F.col("src").alias("node"))).groupBy("seed").agg(F.count("*").alias("dependencies"))


@query("SELECT src || '/' || dst AS cycle, 2 AS length FROM imports a WHERE src < dst AND EXISTS (SELECT 1 FROM imports b WHERE b.src = a.dst AND b.dst = a.src) UNION ALL SELECT a.src || '/' || b.src || '/' || c.src, 3 FROM imports a JOIN imports b ON a.dst = b.src JOIN imports c ON b.dst = c.src AND c.dst = a.src WHERE a.src < b.src AND a.src < c.src AND b.src <> c.src", ("imports",))
def g_cycles(spark, d):
    """Cycles of two and three modules; ``g_cycle_members`` has what lies on a cycle of any length."""
    return graph.two_cycles_and_three(fx.imports(spark, d)).select(F.array_join("cycle", "/").alias("cycle"), "length")


@query(f"+ e AS ({_FILE_IMPORTS}), r AS (SELECT src AS a, dst AS b FROM e UNION SELECT r.a, e.dst FROM r JOIN e ON e.src = r.b), m AS (SELECT x.a AS node, x.b AS other FROM r x JOIN r y ON y.a = x.b AND y.b = x.a WHERE x.a <> x.b) SELECT node, least(node, min(other)) AS component FROM m GROUP BY 1", ("call_edges",), True)
def g_cycle_members(spark, d):
    """Files on cycles of any length, by their strongly connected component."""
    return graph.scc(_file_imports(spark, d))


@query("+ r AS (SELECT id AS node, 0 AS d FROM symbols WHERE contains(file, '/tests/') UNION SELECT c.callee, d + 1 FROM r JOIN calls c ON c.caller = r.node WHERE d < 20), f AS (SELECT s.id, (SELECT count(*) FROM calls WHERE callee = s.id) AS i, (SELECT count(*) FROM calls WHERE caller = s.id) AS o FROM symbols s) SELECT id AS node, CASE WHEN i > 0 THEN 'unreachable_from_entry' WHEN o = 0 THEN 'orphan_no_callers_no_callees' ELSE 'no_callers_has_dead_callees' END AS reason FROM f WHERE id NOT IN (SELECT node FROM r)", ("call_edges",), True)
def g_reachable_dead(spark, d):
    s = fx.symbols(spark, d).withColumnRenamed("id", "node")
    return graph.dead(_ids(spark, d), s.select("node"), s.where(tx.is_test_path(F.col("file"))).select("node"), 20)


@query("+ f AS (SELECT s.id, (SELECT count(*) FROM calls WHERE callee = s.id) AS i, (SELECT count(*) FROM calls WHERE caller = s.id) AS o FROM symbols s) SELECT id AS node, CASE WHEN i = 0 AND o = 0 THEN 'isolate' WHEN i = 0 THEN 'entry_point' WHEN i >= 3 THEN 'hub' ELSE 'plain' END AS role FROM f", ("call_edges",))
def g_entry_points(spark, d):
    g = graph.degrees(_ids(spark, d), _nodes(spark, d))
    role = F.when((F.col("fan_in") == 0) & (F.col("fan_out") == 0), "isolate").when(F.col("fan_in") == 0, "entry_point").when(F.col("fan_in") >= 3, "hub").otherwise("plain")
    return g.select("node", role.alias("role"))


@query("SELECT caller_file AS file, count(DISTINCT callee) AS downstream, (SELECT count(DISTINCT caller) FROM call_edges u WHERE u.callee_file = e.caller_file AND u.caller_file <> e.caller_file) AS upstream FROM call_edges e WHERE caller_file <> callee_file GROUP BY 1", ("call_edges",))
def g_file_impact(spark, d):
    e = fx.call_edges(spark, d).where("caller_file <> callee_file")
    down = e.groupBy(F.col("caller_file").alias("file")).agg(F.countDistinct("callee").alias("downstream"))
    up = e.groupBy(F.col("callee_file").alias("file")).agg(F.countDistinct("caller").alias("upstream"))
    return down.join(up, "file", "left").select("file", "downstream", F.coalesce("upstream", F.lit(0)).alias("upstream"))


@query("SELECT callee AS target, caller AS test, CAST(sum(n) AS BIGINT) AS edges FROM (SELECT callee, caller, 1 AS n FROM call_edges WHERE contains(caller_file, '/tests/') AND NOT contains(callee_file, '/tests/') UNION ALL SELECT b.callee, a.caller, 1 FROM call_edges a JOIN call_edges b ON a.callee = b.caller WHERE contains(a.caller_file, '/tests/') AND NOT contains(a.callee_file, '/tests/') AND NOT contains(b.callee_file, '/tests/')) x GROUP BY 1, 2", ("call_edges",))
def g_test_map(spark, d):
    e = fx.call_edges(spark, d).select("caller", "callee", tx.is_test_path(F.col("caller_file")).alias("t1"), tx.is_test_path(F.col("callee_file")).alias("t2"))
    direct = e.where("t1 and not t2").select("caller", "callee")
    walk = direct.withColumnRenamed("callee", "mid").join(e.where("not t2").select(F.col("caller").alias("mid"), "callee"), "mid").select("caller", "callee")
    return direct.unionByName(walk).groupBy(F.col("callee").alias("target"), F.col("caller").alias("test")).agg(F.count("*").alias("edges"))


@query("SELECT DISTINCT name, 'definition' AS section, name AS other, file FROM symbols WHERE kind IN ('function', 'method', 'class') UNION ALL SELECT DISTINCT callee_name, 'caller', caller_name, caller_file FROM call_edges UNION ALL SELECT DISTINCT caller_name, 'callee', callee_name, caller_file FROM call_edges UNION ALL SELECT DISTINCT callee_name, 'dependent', callee_file, caller_file FROM call_edges WHERE caller_file <> callee_file", ("call_edges",))
def g_xref(spark, d):
    """Cross references of every name."""
    e = fx.call_edges(spark, d)
    return resolve.xref(fx.symbols(spark, d), e, e.select(F.col("callee_name").alias("name")).unionByName(e.select(F.col("caller_name").alias("name"))).unionByName(fx.symbols(spark, d).select("name")))


@query("SELECT callee AS id, count(*) FILTER (WHERE caller_file NOT LIKE 'src/gen/%') AS outside, count(*) AS fan_in, count(*) >= 5 AS high FROM call_edges WHERE callee_file LIKE 'src/gen/%' GROUP BY 1", ("call_edges",))
def g_change_functions(spark, d):
    e = fx.call_edges(spark, d).where(F.col("callee_file").startswith("src/gen/"))
    return e.groupBy(F.col("callee").alias("id")).agg(F.count_if(~F.col("caller_file").startswith("src/gen/")).alias("outside"), F.count("*").alias("fan_in"), (F.count("*") >= 5).alias("high"))


@query(f"+ e AS ({_FILE_IMPORTS}), r AS (SELECT DISTINCT dst AS node FROM e WHERE contains(dst, '/gen/') UNION SELECT e.src FROM r JOIN e ON e.dst = r.node) SELECT node AS test FROM r WHERE contains(node, '/tests/') AND node NOT IN (SELECT dst FROM e WHERE contains(dst, '/gen/'))", ("call_edges",), True)
def g_affected_tests(spark, d):
    """Tests that a change of the generated files can reach."""
    e = _file_imports(spark, d)
    changed = e.where(tx.is_generated_path(F.col("dst"))).select(F.col("dst").alias("file")).distinct()
    return graph.affected_tests(e, changed).select(F.col("file").alias("test"))


@query("SELECT kind, source, target FROM (SELECT 'contains' AS kind, file AS source, CAST(id AS VARCHAR) AS target FROM symbols UNION ALL SELECT 'calls', CAST(caller AS VARCHAR), CAST(callee AS VARCHAR) FROM calls UNION ALL SELECT DISTINCT 'uses', caller_file, callee_file FROM call_edges WHERE caller_file <> callee_file) x", ("call_edges",))
def g_knowledge(spark, d):
    e = fx.call_edges(spark, d)
    part = lambda k, df, a, b: df.select(F.lit(k).alias("kind"), F.col(a).cast("string").alias("source"), F.col(b).cast("string").alias("target"))
    return part("contains", fx.symbols(spark, d), "file", "id").unionByName(part("calls", e, "caller", "callee")).unionByName(part("uses", e.where("caller_file <> callee_file"), "caller_file", "callee_file").distinct())


# -- resolution --------------------------------------------------------------

_REFS = "+ refs AS (SELECT caller AS id, caller * 1000003 + callee AS ref_id, callee_name AS name, caller_file AS file, caller_language AS language FROM call_edges), c AS (SELECT r.*, s.id AS def_id, s.file AS def_file, s.line AS def_line FROM refs r JOIN symbols s ON s.name = r.name WHERE r.language = s.language OR (r.language = 'javascript' AND s.language = 'typescript') OR (r.language = 'typescript' AND s.language = 'javascript'))"


def _refs(spark, d):
    return fx.call_edges(spark, d).select((F.col("caller") * 1000003 + F.col("callee")).alias("ref_id"), F.col("callee_name").alias("name"), F.col("caller_file").alias("file"), F.col("caller_language").alias("language"))


@query("SELECT DISTINCT caller_language, callee_language, caller_language = callee_language OR (caller_language IN ('javascript', 'typescript') AND callee_language IN ('javascript', 'typescript')) AS allowed FROM call_edges", ("call_edges",))
def res_lang_gate(spark, d):
    return fx.call_edges(spark, d).select("caller_language", "callee_language", resolve.compatible(F.col("caller_language"), F.col("callee_language")).alias("allowed")).distinct()


@query(_REFS + " SELECT ref_id, def_id FROM (SELECT ref_id, def_id, row_number() OVER (PARTITION BY ref_id ORDER BY file <> def_file, regexp_replace(file, '/?[^/]*$', '') <> regexp_replace(def_file, '/?[^/]*$', ''), contains(def_file, '/tests/'), def_file, def_line, def_id) AS k FROM c) x WHERE k = 1", ("call_edges",))
def win_choose_candidate(spark, d):
    return resolve.choose(_refs(spark, d), fx.symbols(spark, d), tx.is_test_path(F.col("def_file")))


_CASCADE_REFS = "SELECT caller * 1000003 + callee AS ref_id, callee_name AS name, caller_name, caller_file AS file, caller_language AS language, CASE caller % 7 WHEN 0 THEN 'self' WHEN 1 THEN 'C' || CAST(callee % 97 AS VARCHAR) WHEN 2 THEN 'os.path' WHEN 3 THEN 'dict' WHEN 4 THEN 'pkg' END AS qualifier FROM call_edges"
_CASCADE_IMPORTS = "SELECT caller_file AS file, callee_name AS local_name, 'pkg.mod' AS module, min(callee_file) AS target FROM call_edges WHERE weight > 1 GROUP BY 1, 2 UNION ALL SELECT DISTINCT caller_file, 'pkg', 'pkg', 'src/brand1/m0.py' FROM call_edges WHERE caller_file LIKE '%/m0.py' UNION ALL SELECT DISTINCT caller_file, 'os', 'os', CAST(NULL AS VARCHAR) FROM call_edges WHERE caller_file LIKE '%.py'"
_FITS = "({0} = {1} OR ({0} IN ('javascript', 'typescript') AND {1} IN ('javascript', 'typescript')))"


def _cascade_sql() -> str:
    one = lambda where, keys: f"SELECT {keys}, count(*) AS n, count(DISTINCT class) AS classes, arg_min(id, (file, line, id)) AS id, arg_min(file, (file, line, id)) AS file_, arg_min(language, (file, line, id)) AS lang, min(class) AS class_ FROM s WHERE {where} GROUP BY {keys}"
    bare = "coalesce(r.qualifier, '') = ''"
    own = "coalesce(r.qualifier IN ('self', 'cls'), false)"
    rules = [
        (f"{own} AND enc.classes = 1 AND ownm.id IS NOT NULL", "self", "local", "ownm.id", "ownm.file_"),
        (f"{own} AND coalesce(enc.classes, 0) <> 1 AND inf.classes = 1", "self", "local", "inf.id", "inf.file_"),
        (f"{bare} AND here.id IS NOT NULL", "local", "local", "here.id", "here.file_"),
        ("tg.target IS NOT NULL AND (fl.language IS NULL OR " + _FITS.format("r.language", "fl.language") + ")", "import", "project", "there.id", "tg.target"),
        (f"(NOT {bare} AND split_part(r.qualifier, '.', 1) = 'os' AND r.file LIKE '%.py')", "stdlib", "stdlib", "NULL", "NULL"),
        (f"{bare} AND g.n = 1 AND " + _FITS.format("r.language", "g.lang"), "single_global", "project", "g.id", "g.file_"),
        (f"NOT {bare} AND cm.n = 1 AND " + _FITS.format("r.language", "cm.lang"), "class_method", "project", "cm.id", "cm.file_"),
        (f"NOT {bare} AND NOT {own} AND NOT (r.language = 'python' AND r.qualifier = 'dict') AND um.n = 1 AND " + _FITS.format("r.language", "um.lang"), "unique_method", "project", "um.id", "um.file_"),
        (f"{bare} AND r.name IN ('blue gear', 'blue bolt')", "builtin", "builtin", "NULL", "NULL"),
        ("NOT owned AND r.language = 'python' AND r.name LIKE 'blue g%'", "stdlib_method", "stdlib", "NULL", "NULL"),
        ("NOT owned AND r.language = 'java' AND r.name LIKE 'blue %'", "external_method", "external", "NULL", "NULL"),
        (f"NOT owned AND r.language = 'go' AND NOT {bare} AND r.name LIKE 'blue %'", "builtin_method", "builtin", "NULL", "NULL"),
    ]
    case = lambda k: "CASE " + " ".join(f"WHEN {x[0]} THEN {x[k] if k > 2 else repr(x[k])}" for x in rules)
    return f"""+ s AS (SELECT * FROM symbols), refs AS ({_CASCADE_REFS}), imps AS ({_CASCADE_IMPORTS}), d AS (SELECT * FROM s WHERE kind IN ('function', 'method', 'class')),
      enc AS ({one("class IS NOT NULL", "file, name")}), ownm AS ({one("class IS NOT NULL", "file, class, name")}), here AS ({one("kind IN ('function', 'method', 'class')", "file, name")}), g AS ({one("kind IN ('function', 'method', 'class')", "name")}),
      cm AS ({one("class IS NOT NULL", "class, name")}), um AS ({one("class IS NOT NULL", "name")}), nm AS (SELECT file, local_name, min(target) AS target FROM imps WHERE target IS NOT NULL GROUP BY 1, 2), fl AS (SELECT file, min(language) AS language FROM s GROUP BY 1),
      tg AS (SELECT ref_id, coalesce(CASE WHEN coalesce(r.qualifier, '') <> '' THEN coalesce(a.target, b.target) END, c.target) AS target FROM refs r LEFT JOIN nm a ON a.file = r.file AND a.local_name = r.qualifier LEFT JOIN nm b ON b.file = r.file AND b.local_name = split_part(r.qualifier, '.', 1) LEFT JOIN nm c ON c.file = r.file AND c.local_name = r.name),
      o AS (SELECT ref_id, count(*) > 0 AS owned FROM refs r JOIN (SELECT DISTINCT name, language FROM s) x ON x.name = r.name AND {_FITS.format("r.language", "x.language")} GROUP BY 1),
      j AS (SELECT r.ref_id, {case(2)} ELSE 'unknown' END AS resolution, {case(1)} ELSE 'none' END AS rule, {case(3)} END AS def_id, {case(4)} END AS def_file
      FROM (SELECT refs.*, coalesce(o.owned, false) AS owned FROM refs LEFT JOIN o USING (ref_id)) r JOIN tg ON tg.ref_id = r.ref_id LEFT JOIN enc ON enc.file = r.file AND enc.name = r.caller_name LEFT JOIN ownm ON ownm.file = r.file AND ownm.class = enc.class_ AND ownm.name = r.name
      LEFT JOIN enc inf ON inf.file = r.file AND inf.name = r.name LEFT JOIN here ON here.file = r.file AND here.name = r.name LEFT JOIN fl ON fl.file = tg.target LEFT JOIN here there ON there.file = tg.target AND there.name = r.name
      LEFT JOIN g ON g.name = r.name LEFT JOIN cm ON cm.class = r.qualifier AND cm.name = r.name LEFT JOIN um ON um.name = r.name) SELECT ref_id, resolution, rule, CAST(def_id AS BIGINT) AS def_id, def_file FROM j"""


@query(_cascade_sql(), ("call_edges",))
def res_cascade(spark, d):
    """All calls against all symbols."""
    e, s = cut(fx.call_edges(spark, d)), fx.symbols(spark, d)
    k = F.col("caller") % 7
    qualifier = F.when(k == 0, "self").when(k == 1, F.concat(F.lit("C"), (F.col("callee") % 97).cast("string"))).when(k == 2, "os.path").when(k == 3, "dict").when(k == 4, "pkg")
    refs = e.select((F.col("caller") * 1000003 + F.col("callee")).alias("ref_id"), F.col("callee_name").alias("name"), "caller_name", F.col("caller_file").alias("file"), F.col("caller_language").alias("language"), qualifier.alias("qualifier"))
    named = e.where("weight > 1").groupBy(F.col("caller_file").alias("file"), F.col("callee_name").alias("local_name")).agg(F.lit("pkg.mod").alias("module"), F.min("callee_file").alias("target"))
    files = e.select(F.col("caller_file").alias("file")).distinct()
    package = files.where(F.col("file").endswith("/m0.py")).select("file", F.lit("pkg").alias("local_name"), F.lit("pkg").alias("module"), F.lit("src/brand1/m0.py").alias("target"))
    std = files.where(F.col("file").endswith(".py")).select("file", F.lit("os").alias("local_name"), F.lit("os").alias("module"), F.lit(None).cast("string").alias("target"))
    names = sorted(r[0] for r in fx.symbols(spark, d).where(F.col("name").startswith("blue ")).select("name").distinct().collect())  # a table of names that the resolver is given
    known = {"builtins": ["blue gear", "blue bolt"], "builtin_types": ["dict"], "stdlib_modules": ["os"], "stdlib_methods": {"python": [n for n in names if n.startswith("blue g")]}, "external_methods": {"java": names}, "builtin_methods": {"go": names}}
    return resolve.cascade(refs, s, named.unionByName(package).unionByName(std), known)


@query(_REFS + ", i AS (SELECT DISTINCT caller_file, callee_file FROM call_edges WHERE weight > 1 AND caller_file <> callee_file), k AS (SELECT ref_id, def_id, def_file, def_line, CASE WHEN file = def_file THEN 1.0 WHEN i.caller_file IS NOT NULL THEN 0.9 ELSE 0.5 END AS confidence FROM c LEFT JOIN i ON i.caller_file = c.file AND i.callee_file = c.def_file), b AS (SELECT ref_id, max(confidence) AS confidence FROM k GROUP BY 1) SELECT ref_id, CAST(any_value(confidence) AS DOUBLE) AS confidence, count(*) AS candidates, arg_min(def_id, (def_file, def_line, def_id)) AS def_id FROM k JOIN b USING (ref_id, confidence) GROUP BY 1", ("call_edges",))
def res_callee(spark, d):
    imported = fx.call_edges(spark, d).where("weight > 1").select(F.col("caller_file").alias("file"), F.col("callee_file").alias("target"))
    return resolve.callee_confidence(_refs(spark, d), fx.symbols(spark, d), imported)


@query("SELECT DISTINCT e.callee_name AS wanted_id, s.id, 1.0::DOUBLE AS confidence FROM call_edges e JOIN symbols s ON s.name = e.callee_name AND s.kind IN ('function', 'method', 'class')", ("call_edges",))
def res_definitions(spark, d):
    """Definitions of every name that is called."""
    names = fx.call_edges(spark, d).select(F.col("callee_name").alias("wanted_id")).distinct()
    return resolve.qualified(names.select("wanted_id", F.lit(None).cast("string").alias("parent"), F.col("wanted_id").alias("name")), fx.symbols(spark, d))


# -- quality -----------------------------------------------------------------


@query("SELECT id, CASE WHEN n <= 200 THEN 100.0 WHEN n >= 2000 THEN 0.0 ELSE 100.0 * (2000 - n) / 1800 END AS score FROM (SELECT id, len(string_split(content, chr(10))) AS n FROM files) x", ("files",))
def q_size(spark, d):
    return fx.files(spark, d).select("id", quality.size_score(F.size(F.split("content", "\n"))).cast("double").alias("score"))


@query("SELECT file, round(CASE WHEN n >= 3 THEN CASE WHEN a <= 5 THEN 100 WHEN a <= 10 THEN 100 - 70 * (a - 5) / 5 WHEN a <= 15 THEN 30 - 25 * (a - 10) / 5 ELSE 5 END ELSE CASE WHEN t <= 15 THEN 100 WHEN t <= 40 THEN 100 - 70.0 * (t - 15) / 25 WHEN t <= 100 THEN 30 - 25.0 * (t - 40) / 60 ELSE 5 END END, 4) AS score FROM (SELECT file, count(*) AS n, avg(complexity) AS a, CAST(sum(complexity) AS DOUBLE) AS t FROM symbols GROUP BY 1) x", ("symbols",))
def q_complexity(spark, d):
    g = fx.symbols(spark, d).groupBy("file").agg(F.count("*").alias("n"), F.avg("complexity").alias("a"), F.sum("complexity").alias("t"))
    return g.select("file", F.round(quality.complexity_score(F.col("n"), F.col("a"), F.col("t")), 4).alias("score"))


@query("SELECT module, round(0.6 * CASE WHEN e <= 3 THEN 100 WHEN e >= 100 THEN 0 ELSE 100.0 * (100 - e) / 97 END + 0.4 * CASE WHEN a <= 5 THEN 100 WHEN a >= 50 THEN 0 ELSE 100.0 * (50 - a) / 45 END, 4) AS score FROM (SELECT module, sum(a) AS a, sum(e) AS e FROM (SELECT src AS module, 0 AS a, 1 AS e FROM imports UNION ALL SELECT dst, 1, 0 FROM imports) x GROUP BY 1) y", ("imports",))
def q_deps(spark, d):
    return metrics.instability(fx.imports(spark, d)).select("module", F.round(quality.dependency_score(F.col("efferent"), F.col("afferent")), 4).alias("score"))


@query(f"SELECT grade, count(*) AS n FROM (SELECT {_GRADE} AS grade FROM health) x GROUP BY 1", ("health",))
def q_grade(spark, d):
    return fx.health(spark, d).groupBy(tx.grade(F.col("total")).alias("grade")).agg(F.count("*").alias("n"))


def _ladder(x: str, steps) -> str:
    return "CASE " + " ".join(f"WHEN {x} >= {b} THEN {p}" for b, p in steps) + " ELSE 0 END"


@query("+ f AS (SELECT s.id, coalesce(i.n, 0) AS fi, coalesce(i.f, 0) AS ff, coalesce(o.n, 0) AS fo, coalesce(o.f, 0) AS fx FROM symbols s LEFT JOIN (SELECT callee, count(*) AS n, count(DISTINCT caller_file) AS f FROM call_edges GROUP BY 1) i ON i.callee = s.id LEFT JOIN (SELECT caller, count(*) AS n, count(DISTINCT callee_file) AS f FROM call_edges GROUP BY 1) o ON o.caller = s.id), p AS (SELECT id, " + " + ".join([_ladder("fi", [(10, 35), (5, 20), (3, 10)]), _ladder("ff", [(5, 25), (2, 15)]), _ladder("fo", [(10, 20), (5, 10)]), _ladder("fx", [(3, 15), (1, 5)])]) + " AS points FROM f) SELECT id, points, CASE WHEN points >= 60 THEN 'critical' WHEN points >= 40 THEN 'high' WHEN points >= 20 THEN 'medium' ELSE 'low' END AS level FROM p", ("call_edges",))
def q_impact_risk(spark, d):
    e = fx.call_edges(spark, d)
    i = e.groupBy(F.col("callee").alias("id")).agg(F.count("*").alias("fi"), F.countDistinct("caller_file").alias("ff"))
    o = e.groupBy(F.col("caller").alias("id")).agg(F.count("*").alias("fo"), F.countDistinct("callee_file").alias("fx"))
    j = fx.symbols(spark, d).select("id").join(i, "id", "left").join(o, "id", "left").na.fill(0)
    j = j.withColumn("points", quality.impact_risk(F.col("fi"), F.col("fo"), F.col("ff"), F.col("fx"), F.lit(0)))
    return j.select("id", "points", quality.risk_level(F.col("points")).alias("level"))


@query("+ k AS (SELECT parent, count(*) AS direct, count(DISTINCT right(child, 1)) AS files FROM contains GROUP BY 1), t AS (SELECT parent, direct + coalesce((SELECT sum(k2.direct) FROM contains c JOIN k k2 ON k2.parent = c.child WHERE c.parent = k.parent), 0) AS total, direct, files FROM k) SELECT parent, CAST(least(100, " + _ladder("direct", [(10, 40), (5, 25), (2, 10)]) + " + least(30, 3 * total) + " + _ladder("files", [(5, 20), (2, 10)]) + ") AS BIGINT) AS risk FROM t", ("contains",))
def q_hier_risk(spark, d):
    c = fx.contains(spark, d)
    k = c.groupBy("parent").agg(F.count("*").alias("direct"), F.count_distinct(F.right("child", F.lit(1))).alias("files"))
    below = c.join(k.select(F.col("parent").alias("child"), F.col("direct").alias("n")), "child").groupBy("parent").agg(F.sum("n").alias("more"))
    j = k.join(below, "parent", "left").withColumn("total", F.col("direct") + F.coalesce("more", F.lit(0)))
    return j.select("parent", quality.hierarchy_risk(F.col("direct"), F.col("total"), F.col("files")).cast("bigint").alias("risk"))


@query("+ n AS (SELECT name, count(*) AS defs FROM symbols GROUP BY 1), r AS (SELECT callee_name AS name, count(*) AS refs, count(DISTINCT caller_file) AS down FROM call_edges GROUP BY 1), p AS (SELECT n.name, CAST(defs > 1 AS INTEGER) + " + _ladder("coalesce(refs, 0)", [(21, 3), (6, 2), (1, 1)]) + " + " + _ladder("coalesce(down, 0)", [(11, 3), (4, 2), (1, 1)]) + " AS points FROM n LEFT JOIN r USING (name)) SELECT name, points, CASE WHEN points <= 2 THEN 'low' WHEN points <= 5 THEN 'medium' ELSE 'high' END AS risk FROM p", ("call_edges",))
def q_lineage_risk(spark, d):
    n = fx.symbols(spark, d).groupBy("name").agg(F.count("*").alias("defs"))
    r = fx.call_edges(spark, d).groupBy(F.col("callee_name").alias("name")).agg(F.count("*").alias("refs"), F.countDistinct("caller_file").alias("down"))
    j = n.join(r, "name", "left").na.fill(0).withColumn("points", quality.lineage_points(F.col("defs"), F.col("refs"), F.col("down")))
    return j.select("name", "points", quality.lineage_risk(F.col("points")).alias("risk"))


@query("SELECT name, CASE WHEN n = 0 THEN 'none' WHEN n <= 5 THEN 'low' WHEN n <= 20 THEN 'medium' ELSE 'high' END AS level FROM (SELECT s.name, count(e.callee) AS n FROM (SELECT DISTINCT name FROM symbols) s LEFT JOIN call_edges e ON e.callee_name = s.name GROUP BY 1) x", ("call_edges",))
def q_trace_level(spark, d):
    n = fx.call_edges(spark, d).groupBy(F.col("callee_name").alias("name")).agg(F.count("*").alias("n"))
    return fx.symbols(spark, d).select("name").distinct().join(n, "name", "left").select("name", quality.trace_level(F.coalesce("n", F.lit(0))).alias("level"))


@query("SELECT rule_id, severity, caller_file, callee_file, count(*) AS n FROM (SELECT 'no-gen' AS rule_id, 'error' AS severity, caller_file, callee_file FROM call_edges WHERE caller_file LIKE 'src/brand%' AND callee_file LIKE 'src/gen/%' AND caller_file NOT LIKE '%.py' UNION ALL SELECT 'no-tests', 'warning', caller_file, callee_file FROM call_edges WHERE caller_file LIKE 'src/brand%' AND callee_file LIKE 'src/tests/%') x GROUP BY 1, 2, 3, 4", ("call_edges",))
def q_constraints(spark, d):
    rules = [{"id": "no-gen", "from": "src/brand*/*", "to": "src/gen/**", "exceptions": ["**/*.py"]}, {"id": "no-tests", "severity": "warning", "from": "src/brand*/*", "to": "src/tests/**"}]
    return quality.violations(fx.call_edges(spark, d), rules)


@query("SELECT substr(sha256(regexp_replace(" + _without_comments("content") + ", '[a-zA-Z_][a-zA-Z0-9_]*', '_', 'g')), 1, 32) AS fingerprint, count(*) AS n, min(id) AS first FROM files GROUP BY 1 HAVING count(*) > 1", ("files",))
def q_clones_text(spark, d):
    return quality.clone_groups(fx.files(spark, d))


@query("SELECT sha256(array_to_string(list_transform(regexp_extract_all(html, '</?[a-z][a-z0-9]*'), lambda x: x), ' ')) AS fingerprint, count(*) AS n, min(page_id) AS first FROM pages GROUP BY 1 HAVING count(*) > 1")
def q_clones_struct(spark, d):
    p = fx.table(spark, d, "pages").select(F.col("page_id").alias("id"), F.col("html").alias("content"))
    shape = F.array_join(F.regexp_extract_all("content", F.lit("(</?[a-z][a-z0-9]*)"), 1), " ")
    return quality.clone_groups(p, F.sha2(shape.cast("binary"), 256))


@query("SELECT c.id, x.issue, x.severity, CAST(x.line_no AS INTEGER) AS line_no FROM (SELECT id, language, file AS path, id % 22 AS k FROM symbols) c JOIN (VALUES " + ", ".join(f"({k}, '{g}', '{i}', '{s}', {n})" for k, gs, i, s, n in fx.FOUND_SECURITY for g in gs.split()) + ") x(k, language, issue, severity, line_no) ON x.k = c.k AND x.language = c.language WHERE NOT (x.issue = 'assert_in_prod' AND contains(c.path, '/tests/'))", ("symbols",))
def q_security(spark, d):
    """All rules of all languages over small programs, one a symbol; the SQL lists what each holds."""
    return quality.security(fx.code(spark, d))


@query("+ l AS (SELECT id, unnest(string_split(content, chr(10))) AS x FROM files), g AS (SELECT id, count(*) AS n, max(length(x)) AS longest, count(*) FILTER (WHERE regexp_matches(x, '(TODO|FIXME|HACK|XXX)')) AS notes, max(length(regexp_extract(x, '^( *)', 1)) // 4) AS deep FROM l GROUP BY 1) SELECT id, smell, severity FROM (SELECT id, 'oversized_file' AS smell, CASE WHEN n > 1000 THEN 'critical' ELSE 'warning' END AS severity FROM g WHERE n > 500 UNION ALL SELECT id, 'long_line', 'warning' FROM g WHERE longest > 200 UNION ALL SELECT id, 'technical_debt', 'info' FROM g WHERE notes > 5 UNION ALL SELECT id, 'deep_nesting', CASE WHEN deep > 6 THEN 'critical' ELSE 'warning' END FROM g WHERE deep > 4 UNION ALL SELECT id, 'god_class', CASE WHEN size > 500 THEN 'critical' ELSE 'warning' END FROM (SELECT id, complexity * 20 + 1 AS size FROM symbols WHERE kind = 'class') a WHERE size > 300 UNION ALL SELECT id, 'long_method', CASE WHEN size > 100 THEN 'critical' ELSE 'warning' END FROM (SELECT id, complexity * 20 + 1 AS size FROM symbols WHERE kind IN ('function', 'method')) b WHERE size > 50) x", ("files", "symbols"))
def q_smells(spark, d):
    s = fx.symbols(spark, d).select("id", "kind", "line", (F.col("line") + 20 * F.col("complexity")).alias("end_line"))
    return quality.smells(fx.files(spark, d), s)


@query("+ t AS (SELECT DISTINCT name FROM symbols WHERE contains(file, '/tests/') AND kind = 'function'), s AS (SELECT id, CAST(CASE WHEN kind = 'class' THEN 5 ELSE 0 END + CASE WHEN complexity > 20 THEN 10 WHEN complexity > 10 THEN 7 WHEN complexity > 5 THEN 3 ELSE 0 END + CASE WHEN coalesce(class, '') <> '' THEN 2 ELSE 0 END + CASE WHEN complexity > 1 THEN complexity ELSE 0 END AS BIGINT) AS score FROM symbols WHERE NOT contains(file, '/tests/') AND name NOT IN (SELECT name FROM t)) SELECT id, score, CASE WHEN score >= 10 THEN 'critical' WHEN score >= 7 THEN 'high' WHEN score >= 3 THEN 'medium' ELSE 'low' END AS priority FROM s", ("symbols",))
def q_test_gap(spark, d):
    """Production symbols whose name no test function has."""
    s = fx.symbols(spark, d)
    test = tx.is_test_path(F.col("file"))
    return quality.untested(s.where(~test), s.where(test & (F.col("kind") == "function")).select(F.col("name").alias("target")))


@query("SELECT id, EXISTS (SELECT 1 FROM (SELECT file, line + 7 AS at FROM symbols) x WHERE x.file = s.file AND x.at BETWEEN s.line + 1 AND s.end_line) AS covered FROM symbols s", ("symbols",))
def q_coverage_gap(spark, d):
    s = fx.symbols(spark, d)
    return quality.covered(s, s.select("file", (F.col("line") + 7).alias("line")))


@query("SELECT DISTINCT caller_file AS file, callee_name AS name FROM call_edges e WHERE NOT EXISTS (SELECT 1 FROM symbols s WHERE s.file = e.caller_file AND s.name = e.callee_name)", ("call_edges",))
def q_unused_imports(spark, d):
    return quality.unused_names(fx.call_edges(spark, d).select(F.col("caller_file").alias("file"), F.col("callee_name").alias("name")), fx.symbols(spark, d))


_NODE = "CASE kind WHEN 'type' THEN 'variable' WHEN 'constant' THEN 'expression' ELSE kind END"
_CHANGE = "CASE id % 7 WHEN 0 THEN 'added' WHEN 1 THEN 'removed' WHEN 2 THEN 'renamed' WHEN 3 THEN 'signature_changed' WHEN 4 THEN 'body_changed' WHEN 5 THEN 'changed' ELSE 'moved' END"


def _classified(k: int) -> str:
    public, marked, part = "(n <> '_x')", "(preview = 'export x')", "node IN ('function', 'class', 'method')"
    rules = [
        ("contains(path, '/tests/')", "'test_change'", "0.9"), ("path = 'docs/A.MD'", "'documentation'", "0.9"), ("node = 'import'", "'import_change'", "0.85"), (f"change = 'signature_changed' AND {public}", "'api_change'", "0.85"),
        (f"change = 'signature_changed' AND {marked}", "'api_change'", "0.6"), ("change = 'signature_changed'", "'refactor'", "0.7"), (f"change = 'renamed' AND {public}", "'api_change'", "0.8"), ("change = 'renamed'", "'refactor'", "0.75"),
        (f"change = 'added' AND {part}", "'feature_addition'", "0.8"), ("change = 'added'", "'internal_change'", "0.6"), (f"change = 'removed' AND {part} AND {public}", "'feature_removal'", "0.85"), (f"change = 'removed' AND {part}", "'feature_removal'", "0.7"),
        ("change = 'removed'", "'internal_change'", "0.5"), ("change = 'body_changed'", "'internal_change'", "0.7"), ("change = 'changed'", "'internal_change'", "0.5"),
    ]
    return "CASE " + " ".join(f"WHEN {r[0]} THEN {r[k]}" for r in rules) + (" ELSE 'unknown' END" if k == 1 else " ELSE 0.3 END")


@query(f"+ h AS (SELECT id, CASE WHEN id % 11 = 0 THEN 'docs/A.MD' ELSE file END AS path, {_NODE} AS node, {_CHANGE} AS change, CASE id % 3 WHEN 0 THEN '_x' WHEN 1 THEN '__init__' ELSE name END AS n, CASE WHEN id % 5 = 0 THEN 'export x' ELSE 'x' END AS preview FROM symbols) SELECT id, {_classified(1)} AS category, CAST({_classified(2)} AS DOUBLE) AS confidence FROM h", ("symbols",))
def q_classify(spark, d):
    i = F.col("id")
    node = F.when(F.col("kind") == "type", "variable").when(F.col("kind") == "constant", "expression").otherwise(F.col("kind"))
    change = F.element_at(F.array(*map(F.lit, ["added", "removed", "renamed", "signature_changed", "body_changed", "changed", "moved"])), (i % 7).cast("int") + 1)
    name = F.when(i % 3 == 0, "_x").when(i % 3 == 1, "__init__").otherwise(F.col("name"))
    path = F.when(i % 11 == 0, "docs/A.MD").otherwise(F.col("file"))
    c, p = quality.classify_change(path, node, change, name, F.when(i % 5 == 0, "export x").otherwise("x"))
    return fx.symbols(spark, d).select("id", c.alias("category"), p.alias("confidence"))


@query("+ o AS (SELECT file, id, kind, name, row_number() OVER (PARTITION BY file, kind, name ORDER BY id) AS k FROM symbols WHERE id % 11 <> 0), n AS (SELECT file, id, kind, name, row_number() OVER (PARTITION BY file, kind, name ORDER BY id) AS k FROM (SELECT file, id, kind, CASE WHEN id % 5 = 0 THEN name || '_r' ELSE name END AS name FROM symbols WHERE id % 7 <> 0) x), p AS (SELECT o.file, o.kind, o.id AS a, n.id AS b, o.name AS x, n.name AS y FROM o JOIN n USING (file, kind, name, k)), oo AS (SELECT * FROM o WHERE id NOT IN (SELECT a FROM p)), nn AS (SELECT * FROM n WHERE id NOT IN (SELECT b FROM p)), q AS (SELECT oo.file, oo.kind, oo.id AS a, nn.id AS b, oo.name AS x, nn.name AS y FROM oo JOIN nn ON oo.id = nn.id AND oo.kind IN ('function', 'class', 'method')), m AS (SELECT * FROM p UNION ALL SELECT * FROM q UNION ALL SELECT file, kind, id, NULL, name, NULL FROM oo WHERE id NOT IN (SELECT a FROM q) UNION ALL SELECT file, kind, NULL, id, NULL, name FROM nn WHERE id NOT IN (SELECT b FROM q)) SELECT file, kind, a AS old_pos, b AS new_pos, x AS old_name, y AS new_name, CASE WHEN a IS NULL THEN 'added' WHEN b IS NULL THEN 'removed' WHEN a = b AND b % 2 = 1 AND x = y THEN 'unchanged' WHEN x <> y THEN 'renamed' WHEN a <> b OR b % 3 = 0 THEN 'signature_changed' WHEN b % 4 = 0 THEN 'body_changed' ELSE 'changed' END AS change FROM m", ("symbols",))
def q_ast_diff(spark, d):
    """Two versions of every file: elements go, come, are renamed, and change in their signature, body or otherwise."""
    s, i = fx.symbols(spark, d), F.col("id")
    text = i.cast("string")
    members = F.array(F.concat(F.lit("m"), text))
    old = s.where("id % 11 <> 0").select("file", i.alias("pos"), "kind", "name", F.concat(text, F.lit("s")).alias("signature"), F.lit("b").alias("body"), F.concat(text, F.col("name")).alias("digest"), members.alias("members"))
    name = F.when(i % 5 == 0, F.concat("name", F.lit("_r"))).otherwise(F.col("name"))
    new = s.where("id % 7 <> 0").select("file", i.alias("pos"), "kind", name.alias("name"), F.concat(text, F.when(i % 3 == 0, "t").otherwise("s")).alias("signature"), F.when(i % 4 == 0, "c").otherwise("b").alias("body"), F.concat(text, F.when(i % 2 == 1, name).otherwise("x")).alias("digest"), members.alias("members"))
    return quality.diff(old, new)


@query("SELECT conv_id, turn FROM conversations WHERE contains(lower(text), 'the') AND role = 'user' ORDER BY conv_id DESC, turn DESC LIMIT 100")
def q_journal(spark, d):
    c = fx.table(spark, d, "conversations").where(F.lower("text").contains("the") & (F.col("role") == "user"))
    return c.orderBy(F.desc("conv_id"), F.desc("turn")).limit(100).select("conv_id", "turn")


@query("+ v AS (SELECT vec_id, list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST((SELECT embedding FROM embeddings WHERE vec_id = 0) AS DOUBLE[])) AS s FROM embeddings) SELECT vec_id, round(s, 6) AS score FROM v ORDER BY round(s, 6) DESC, vec_id LIMIT 10".replace("+ v", "WITH v", 1))
def rank_vector_top_k(spark, d):
    v = fx.table(spark, d, "embeddings")
    q = v.where("vec_id = 0").select("embedding").collect()[0][0]
    return search.vector_top_k(v, q, 10)


# -- DSLs --------------------------------------------------------------------


def _selector(spark, d, text: str) -> DataFrame:
    s = fx.symbols(spark, d)
    e = fx.call_edges(spark, d).select(F.lit("calls").alias("kind"), F.col("caller_name").alias("src_name"), F.col("caller_file").alias("src_file"), F.col("callee_name").alias("dst_name"), F.col("callee_file").alias("dst_file"))
    return Compiler(s, e).select(text).select("id", "name", "file")


@query("SELECT id, name, file FROM symbols s WHERE kind IN ('function', 'method') AND language = 'python' AND (name, file) IN (SELECT (caller_name, caller_file) FROM call_edges WHERE callee_name = 'blue gear') UNION SELECT id, name, file FROM symbols WHERE kind = 'class' AND starts_with(file, 'src/gen/')", ("call_edges",))
def dsl_selector_calls(spark, d):
    return _named(spark, d)


def _named(spark, d):
    """Names of the fixtures hold a blank, which ``#`` doesn't read, so they get one without."""
    s = fx.symbols(spark, d).withColumn("name", F.replace("name", F.lit(" "), F.lit("_")))
    under = lambda c: F.replace(c, F.lit(" "), F.lit("_"))
    e = fx.call_edges(spark, d).select(F.lit("calls").alias("kind"), under("caller_name").alias("src_name"), F.col("caller_file").alias("src_file"), under("callee_name").alias("dst_name"), F.col("callee_file").alias("dst_file"))
    found = Compiler(s, e).select(".function[language=python]:calls(#blue_gear), .class:in(src/gen/)")
    return found.select("id", F.replace("name", F.lit("_"), F.lit(" ")).alias("name"), "file")


@query("SELECT id, name, file FROM (SELECT *, row_number() OVER (PARTITION BY class ORDER BY line, file, name) AS k FROM symbols WHERE kind IN ('function', 'method') AND class IS NOT NULL) x WHERE k = 2", ("symbols",))
def dsl_selector_position(spark, d):
    return _selector(spark, d, ".method:nth-child(2)")


@query("SELECT id, name, file FROM symbols WHERE kind IN ('function', 'method', 'class') AND NOT (kind = 'class') AND contains(file, 'brand1')", ("symbols",))
def dsl_selector_not(spark, d):
    return _selector(spark, d, "*[file=brand1]:not(.class)")


@query("SELECT DISTINCT s.id, s.name, s.complexity FROM symbols s JOIN call_edges e ON e.caller = s.id WHERE e.callee_name = 'blue gear' AND s.kind LIKE '%method%' AND s.name <> 'blue gear'", ("call_edges",))
def dsl_chain_callers(spark, d):
    e = Engine(fx.symbols(spark, d), _ids(spark, d))
    return e.run("search('blue gear').callers(depth=1).filter(kind='method').exclude(name='blue gear')").select("id", "name", "complexity")


@query("SELECT s.id, s.name FROM symbols s WHERE s.name = 'red bolt' AND EXISTS (SELECT 1 FROM call_edges e WHERE e.callee = s.id AND contains(e.caller_file, '/tests/')) ORDER BY complexity DESC, file, line, id LIMIT 7", ("call_edges",))
def dsl_chain_has(spark, d):
    e = Engine(fx.symbols(spark, d), _ids(spark, d))
    return e.run("search('red bolt').has(callers=true, test=true).sort(by='complexity', desc=true).take(7)").select("id", "name")


# -- streams -----------------------------------------------------------------


@query(f"+ g AS (SELECT *, {_GRADE} AS grade FROM health), p AS (SELECT *, lag(grade) OVER (PARTITION BY file ORDER BY ts, id) AS previous FROM g), q AS (SELECT *, strpos('ABCDF', grade) AS a, strpos('ABCDF', previous) AS b FROM p), d AS (SELECT file, id, previous, grade, ts FROM q WHERE CASE WHEN previous IS NULL THEN a >= 4 ELSE a > b AND (a >= 4 OR b >= 4 OR a - b >= 2) END), k AS (SELECT file, min(ts) AS ts FROM d GROUP BY 1 UNION ALL SELECT d.file, min(d.ts) FROM k JOIN d ON d.file = k.file AND d.ts >= k.ts + INTERVAL 6 HOUR GROUP BY d.file) SELECT d.file, min_by(d.id, d.id) AS id, min_by(d.previous, d.id) AS previous, min_by(d.grade, d.id) AS grade, epoch(d.ts) AS at FROM d JOIN k USING (file, ts) GROUP BY d.file, d.ts", ("health",), True)
def st_homeostasis(spark, d):
    """Alerts with a cooldown, a greedy scan of each file's readings in order."""
    return stateful.alerts_with_cooldown(fx.health(spark, d), cooldown_s=6 * 3600)


@query("SELECT user_id, count(*) AS events, CAST(floor(min(epoch(ts))) AS BIGINT) AS first FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) IS NULL OR ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) > INTERVAL 2 HOUR THEN 1 ELSE 0 END AS fresh FROM events) a) b GROUP BY user_id, s")
def st_debounce(spark, d):
    return stateful.debounced(fx.table(spark, d, "events"), 7200).select("user_id", "events", "first")


@query("SELECT event_type, CAST(floor(epoch(ts) / 86400) * 86400 AS BIGINT) AS start, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2")
def st_tumbling(spark, d):
    e = fx.table(spark, d, "events").withColumn("at", F.col("ts").cast("timestamp"))
    g = e.groupBy(F.window("at", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))
    return g.select("event_type", F.unix_timestamp("w.start").alias("start"), "n", "total")
