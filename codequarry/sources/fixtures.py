"""The code graph as projections of the star-schema tables.

Each projection has a Spark form and the same in SQL (``SQL``, common table
expressions by name), so that every operator can run on whole tables and be
compared with an independent statement of it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

EXTENSIONS = {"python": "py", "java": "java", "go": "go", "javascript": "js", "typescript": "ts"}

SQL: dict[str, str] = {
    "symbols": """
      SELECT p_partkey AS id, p_name AS name,
        CASE p_type WHEN 'STANDARD' THEN 'function' WHEN 'MEDIUM' THEN 'method' WHEN 'PROMO' THEN 'class' WHEN 'LARGE' THEN 'type' WHEN 'SMALL' THEN 'constant' ELSE 'import' END AS kind,
        CASE WHEN p_size % 10 = 0 THEN 'src/tests/' WHEN p_size % 10 = 1 THEN 'src/gen/' ELSE 'src/' END || lower(replace(p_brand, '#', '')) || '/m' || CAST(p_size % 5 AS VARCHAR) ||
        CASE p_size % 5 WHEN 0 THEN '.py' WHEN 1 THEN '.java' WHEN 2 THEN '.go' WHEN 3 THEN '.js' ELSE '.ts' END AS file,
        CASE p_size % 5 WHEN 0 THEN 'python' WHEN 1 THEN 'java' WHEN 2 THEN 'go' WHEN 3 THEN 'javascript' ELSE 'typescript' END AS language,
        CASE WHEN p_type = 'MEDIUM' THEN 'C' || CAST(p_partkey % 97 AS VARCHAR) END AS class,
        p_partkey AS line, p_partkey + p_size AS end_line, p_size AS complexity FROM part""",
    "call_lines": "SELECT l_orderkey, l_linenumber, min(l_partkey) AS part FROM lineitem GROUP BY 1, 2",
    "calls": """
      SELECT caller, callee, count(*) AS weight FROM (
        SELECT part AS caller, lead(part) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS callee FROM call_lines) x
      WHERE callee IS NOT NULL AND callee <> caller GROUP BY 1, 2""",
    "call_edges": """
      SELECT c.caller, c.callee, c.weight, a.name AS caller_name, a.file AS caller_file, a.language AS caller_language, b.name AS callee_name, b.file AS callee_file, b.language AS callee_language
      FROM calls c JOIN symbols a ON a.id = c.caller JOIN symbols b ON b.id = c.callee""",
    "imports": """
      SELECT 'm' || CAST(cn.n_nationkey AS VARCHAR) AS src, 'm' || CAST(sn.n_nationkey AS VARCHAR) AS dst, cn.n_regionkey AS src_package, sn.n_regionkey AS dst_package, count(*) AS weight
      FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey JOIN customer c ON c.c_custkey = o.o_custkey JOIN supplier s ON s.s_suppkey = l.l_suppkey
      JOIN nation cn ON cn.n_nationkey = c.c_nationkey JOIN nation sn ON sn.n_nationkey = s.s_nationkey
      WHERE cn.n_nationkey <> sn.n_nationkey GROUP BY 1, 2, 3, 4""",
    "contains": """
      SELECT 'r' || CAST(n_regionkey AS VARCHAR) AS parent, 'n' || CAST(n_nationkey AS VARCHAR) AS child FROM nation
      UNION ALL SELECT 'n' || CAST(c_nationkey AS VARCHAR), 'c' || CAST(c_custkey AS VARCHAR) FROM customer
      UNION ALL SELECT 'n' || CAST(s_nationkey AS VARCHAR), 's' || CAST(s_suppkey AS VARCHAR) FROM supplier""",
    "commit_files": "SELECT DISTINCT l.l_orderkey AS sha, 'f' || CAST(l.l_partkey % 100 AS VARCHAR) AS file, o.o_orderdate AS ts FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey",
    "health": "SELECT event_id AS id, 'u' || CAST(user_id AS VARCHAR) AS file, ts, greatest(0.0, 100.0 - value) AS total FROM events",
    "files": "SELECT doc_id AS id, source || '/' || lang || '/' || CAST(doc_id AS VARCHAR) || '.txt' AS path, lang AS language, text AS content FROM documents",
}

#: What a projection reads among the others.
NEEDS = {"calls": ["call_lines"], "call_edges": ["call_lines", "calls", "symbols"]}


def with_sql(names: list[str], body: str, recursive: bool = False) -> str:
    """``body`` behind the projections it names and those they need."""
    order: list[str] = []
    for n in names:
        for m in [*NEEDS.get(n, []), n]:
            if m not in order:
                order.append(m)
    head = ", ".join(f"{n} AS ({SQL[n]})" for n in order)
    return f"WITH {'RECURSIVE ' if recursive else ''}{head}{', ' if body.lstrip()[:2] == '+ ' else ' '}{body.lstrip().removeprefix('+ ')}"


#: Rows of a table that a task gets at most, about, in steps that keep them in memory.
ROWS_A_TASK = 400_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tasks(spark: SparkSession, sf_dir: str, name: str, each: int = 1) -> int:
    """Tasks for a step that makes ``each`` rows of a table's row: as many more as there are more rows, so that a task's share stays.

    The rows are counted in the files' footers.  Spark's own number is fixed, and
    partitions put together by their packed bytes may hold tens of millions of rows.
    """
    rows = table(spark, sf_dir, name).count() * each
    return 1 + max(rows // ROWS_A_TASK, min(rows // 25_000, spark.sparkContext.defaultParallelism))


def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    t, five, ten = F.col("p_type"), F.col("p_size") % 5, F.col("p_size") % 10
    kind = F.when(t == "STANDARD", "function").when(t == "MEDIUM", "method").when(t == "PROMO", "class").when(t == "LARGE", "type").when(t == "SMALL", "constant").otherwise("import")
    names = list(EXTENSIONS)
    language = F.element_at(F.array(*map(F.lit, names)), five.cast("int") + 1)
    ext = F.element_at(F.array(*[F.lit("." + EXTENSIONS[n]) for n in names]), five.cast("int") + 1)
    folder = F.when(ten == 0, "src/tests/").when(ten == 1, "src/gen/").otherwise("src/")
    file = F.concat(folder, F.lower(F.replace("p_brand", F.lit("#"), F.lit(""))), F.lit("/m"), five.cast("string"), ext)
    owner = F.when(t == "MEDIUM", F.concat(F.lit("C"), (F.col("p_partkey") % 97).cast("string")))
    return p.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), kind.alias("kind"), file.alias("file"), language.alias("language"), owner.alias("class"), F.col("p_partkey").alias("line"), (F.col("p_partkey") + F.col("p_size")).alias("end_line"), F.col("p_size").alias("complexity"))


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = tasks(spark, sf_dir, "lineitem")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey").repartition(n, "l_orderkey")
    lines = lines.groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("caller"))
    nxt = F.lead("caller").over(W.partitionBy("l_orderkey").orderBy("l_linenumber"))
    e = lines.select("caller", nxt.alias("callee")).where("callee is not null and callee <> caller")
    return e.repartition(n, "caller", "callee").groupBy("caller", "callee").agg(F.count("*").alias("weight"))


def call_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls with the names, files and languages of both ends."""
    s = symbols(spark, sf_dir)
    side = lambda end: s.select(F.col("id").alias(end), F.col("name").alias(f"{end}_name"), F.col("file").alias(f"{end}_file"), F.col("language").alias(f"{end}_language"))
    return calls(spark, sf_dir).join(side("caller"), "caller").join(side("callee"), "callee")


def imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    end = lambda n: nation.select(F.col("n_nationkey").alias(f"{n}_k"), F.col("n_regionkey").alias(f"{n}_package"))
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    rows = lines.join(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    rows = rows.join(table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("src_k")), F.col("o_custkey") == F.col("c_custkey"))
    rows = rows.join(table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("dst_k")), F.col("l_suppkey") == F.col("s_suppkey"))
    pairs = rows.where("src_k <> dst_k").groupBy("src_k", "dst_k").agg(F.count("*").alias("weight"))
    name = lambda c: F.concat(F.lit("m"), F.col(c).cast("string"))
    return pairs.join(end("src"), "src_k").join(end("dst"), "dst_k").select(name("src_k").alias("src"), name("dst_k").alias("dst"), "src_package", "dst_package", "weight")


def contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    def level(name: str, up: str, up_key: str, down: str, down_key: str) -> DataFrame:
        return table(spark, sf_dir, name).select(F.concat(F.lit(up), F.col(up_key).cast("string")).alias("parent"), F.concat(F.lit(down), F.col(down_key).cast("string")).alias("child"))

    a = level("nation", "r", "n_regionkey", "n", "n_nationkey")
    return a.unionByName(level("customer", "n", "c_nationkey", "c", "c_custkey")).unionByName(level("supplier", "n", "s_nationkey", "s", "s_suppkey"))


def commit_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = tasks(spark, sf_dir, "lineitem")
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("sha"), F.col("o_orderdate").alias("ts")).repartition(n, "sha")
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("sha"), (F.col("l_partkey") % 100).alias("f")).repartition(n, "sha").distinct()
    return rows.join(o, "sha").select("sha", F.concat(F.lit("f"), F.col("f").cast("string")).alias("file"), "ts")


def health(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("file"), "ts", F.greatest(F.lit(0.0), 100.0 - F.col("value")).alias("total"))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat(F.col("source"), F.lit("/"), F.col("lang"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), path.alias("path"), F.col("lang").alias("language"), F.col("text").alias("content"))


#: Small programs, behind a first line "x = 1": one for each remainder of a symbol's id by their number.
PROGRAMS = [
    'password = "hunter22"', "eval(x)", "# eval(x)", 's = "eval(x)"', 'cursor.execute("SELECT 1 WHERE a=%s" % x)', 'f"DELETE FROM users WHERE id={x}"', "except:", "assert x", "hashlib.md5(x)", "requests.get(u, verify=False)",
    "el.innerHTML = x", 'q = fmt.Sprintf("SELECT * FROM t WHERE a=%s", x)', "pickle.loads(x)", '"""\neval(x)\n"""', "def f(a, b=[]):\n    pass", "try:\n    g()\nexcept:\n    pass", "def f():\n    print(1)", "var x = 2",
    "if (a == b) {}", "System.out.println(x)", "e.printStackTrace()", "def f():\n    return 1\n    y = 2",
]
_ALL, _SCRIPTS = "python java go javascript typescript", "javascript typescript"
#: What the scanners find in them, by hand: (program, languages, issue, severity, line) and (program, languages, rule, line).
FOUND_SECURITY = [
    (0, _ALL, "hardcoded_secret", "critical", 2), (1, f"python java {_SCRIPTS}", "eval_usage", "critical", 2), (2, f"java {_SCRIPTS}", "eval_usage", "critical", 2), (3, f"java {_SCRIPTS}", "eval_usage", "critical", 2),
    (4, f"python {_SCRIPTS}", "sql_injection", "critical", 2), (5, f"python {_SCRIPTS}", "sql_injection", "critical", 2), (6, "python", "bare_except", "warning", 2), (7, "python", "assert_in_prod", "info", 2),
    (8, "python", "insecure_hash", "warning", 2), (9, "python", "tls_disabled", "critical", 2), (10, _SCRIPTS, "xss_risk", "critical", 2), (11, "go", "sql_injection", "critical", 2), (12, "python", "pickle_usage", "warning", 2),
    (13, f"java {_SCRIPTS}", "eval_usage", "critical", 3), (15, "python", "bare_except", "warning", 4),
]
FOUND_ANTI_PATTERNS = [(6, "python", "AP002", 2), (14, "python", "AP001", 2), (15, "python", "AP002", 4), (16, "python", "AP003", 3), (17, _SCRIPTS, "AP010", 2), (18, _SCRIPTS, "AP011", 2), (19, "java", "AP020", 2), (20, "java", "AP021", 2)]


def code(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A small program for each symbol: id, path, language, content."""
    text = F.concat(F.lit("x = 1\n"), F.element_at(F.array(*map(F.lit, PROGRAMS)), (F.col("id") % len(PROGRAMS)).cast("int") + 1), F.lit("\n"))
    return symbols(spark, sf_dir).select("id", F.col("file").alias("path"), "language", text.alias("content"))
