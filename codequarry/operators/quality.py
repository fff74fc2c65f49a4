"""Code-quality scores, risk ladders, scanners and gaps."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import fingerprint, glob_regex, risk_band, source_lines, stripped
from .search import lines

#: Weights of the health dimensions.
HEALTH_WEIGHTS = {"size": 10.0, "complexity": 25.0, "dependencies": 20.0, "coverage": 10.0, "duplication": 10.0, "structure": 15.0, "hotspot": 10.0}

_SQL = r"(?:[^{q}\\]|\\.)*?(?:SELECT|INSERT|UPDATE|DELETE|DROP)(?:[^{q}\\]|\\.)*?(?:FROM\s+\w+|INTO\s+\w+|WHERE\s+[\w\.{{}}]+\s*[=<>!]|TABLE\s+\S+|VALUES\s*\(|SET\s+\w+\s*=)"
#: What the security scanner looks for.
SECURITY = {
    "hardcoded_secret": r"(?i)(?:password|passwd|pwd|secret|api_key|apikey|access_token|auth_token|private_key|aws_secret|credentials)\s*[:=]\s*['\"][^'\"]{6,}['\"]",
    "sql_injection": r"(?i)(?:execute|exec|cursor\.execute|\.query)\s*\([^)]*%[sd]|(?:execute|exec|cursor\.execute|\.query)\s*\([^)]*\.format\(|f\"" + _SQL.format(q='"') + "|f'" + _SQL.format(q="'"),
    "eval_usage": r"\beval\s*\(",
    "shell_injection": r"(?:os\.system|subprocess\.(?:call|run|Popen)|exec\s*\()\s*\([^)]*(?:%[sd]|\.format\(|f['\"])",
    "xss_risk": r"(?:innerHTML|\.html\(|dangerouslySetInnerHTML|document\.write)\s*[\(=]",
    "pickle_usage": r"\bpickle\.loads?\s*\(",
    "assert_in_prod": r"\bassert\s+",
    "bare_except": r"except\s*:",
    "insecure_hash": r"\b(?:hashlib\.(?:md5|sha1)|hashlib\.new\s*\(\s*['\"](?:md5|sha1)['\"])\s*\(",
    "tls_disabled": r"(?:verify\s*=\s*False|CERT_NONE|check_hostname\s*=\s*False)",
    "java_sql": r"(?i)(?:Statement|createStatement)\s*\([^)]*\+\s",
    "java_eval": r"(?:ScriptEngine|eval\s*\()",
    "go_sql": r"(?i)fmt\.Sprintf\s*\([^)]*(?:SELECT|INSERT|UPDATE|DELETE)",
}
#: Fixed values: (issue, pattern, severity) by language; other languages are searched for secrets alone.
_SECRET = ("hardcoded_secret", "hardcoded_secret", "critical")
_SCRIPT = [_SECRET, ("eval_usage", "eval_usage", "critical"), ("xss_risk", "xss_risk", "critical"), ("sql_injection", "sql_injection", "critical")]
SECURITY_RULES: dict[str, list[tuple[str, str, str]]] = {
    "python": [
        _SECRET, ("sql_injection", "sql_injection", "critical"), ("eval_usage", "eval_usage", "critical"), ("shell_injection", "shell_injection", "critical"), ("pickle_usage", "pickle_usage", "warning"),
        ("bare_except", "bare_except", "warning"), ("insecure_hash", "insecure_hash", "warning"), ("tls_disabled", "tls_disabled", "critical"), ("assert_in_prod", "assert_in_prod", "info"),
    ],
    "javascript": _SCRIPT,
    "typescript": _SCRIPT,
    "java": [_SECRET, ("sql_injection", "java_sql", "critical"), ("eval_usage", "java_eval", "critical")],
    "go": [_SECRET, ("sql_injection", "go_sql", "critical")],
    "rust": [_SECRET],
}
#: Issues that don't count inside a Python string or comment.
NOT_IN_STRINGS = {"eval_usage", "pickle_usage", "bare_except", "tls_disabled", "assert_in_prod", "insecure_hash"}
#: Words whose count measures decisions.
DECISIONS = r"\b(if|elif|for|while|case|catch|except|and|or)\b|&&|[|][|]|[?]"


def linear(x: Column, best: float, worst: float) -> Column:
    """100 up to ``best``, 0 from ``worst`` on, a straight line between."""
    return F.when(x <= best, 100.0).when(x >= worst, 0.0).otherwise(100.0 * (worst - x) / (worst - best))


def size_score(n_lines: Column) -> Column:
    return linear(n_lines, 200, 2000)


def complexity_score(functions: Column, average: Column, total: Column) -> Column:
    few = F.when(total <= 15, 100.0).when(total <= 40, 100.0 - 70.0 * (total - 15) / 25).when(total <= 100, 30.0 - 25.0 * (total - 40) / 60).otherwise(5.0)
    many = F.when(average <= 5, 100.0).when(average <= 10, 100.0 - 70.0 * (average - 5) / 5).when(average <= 15, 30.0 - 25.0 * (average - 10) / 5).otherwise(5.0)
    return F.when(functions >= 3, many).otherwise(few)


def dependency_score(out: Column, into: Column) -> Column:
    return 0.6 * linear(out, 3, 100) + 0.4 * linear(into, 5, 50)


def duplication_score(ratio: Column) -> Column:
    return linear(ratio, 0.05, 0.30)


def structure_score(depth: Column) -> Column:
    return linear(depth, 10, 30)


def hotspot_score(commits: Column) -> Column:
    return linear(commits, 5, 50)


def ladder(x: Column, steps: list[tuple[float, int]]) -> Column:
    """Points of the first step whose bound ``x`` reaches, else 0."""
    out = F.lit(0)
    for bound, points in reversed(steps):
        out = F.when(x >= bound, points).otherwise(out)
    return out


def impact_risk(fan_in: Column, fan_out: Column, files_in: Column, files_out: Column, depth: Column) -> Column:
    return ladder(fan_in, [(10, 35), (5, 20), (3, 10)]) + ladder(files_in, [(5, 25), (2, 15)]) + ladder(fan_out, [(10, 20), (5, 10)]) + ladder(files_out, [(3, 15), (1, 5)]) + ladder(depth, [(4, 5)])


def risk_level(points: Column) -> Column:
    return F.when(points >= 60, "critical").when(points >= 40, "high").when(points >= 20, "medium").otherwise("low")


def hierarchy_risk(direct: Column, total: Column, n_files: Column) -> Column:
    return F.least(F.lit(100), ladder(direct, [(10, 40), (5, 25), (2, 10)]) + F.least(F.lit(30), 3 * total) + ladder(n_files, [(5, 20), (2, 10)]))


def lineage_points(definitions: Column, references: Column, downstream: Column) -> Column:
    return (definitions > 1).cast("int") + ladder(references, [(21, 3), (6, 2), (1, 1)]) + ladder(downstream, [(11, 3), (4, 2), (1, 1)])


def lineage_risk(points: Column) -> Column:
    return F.when(points <= 2, "low").when(points <= 5, "medium").otherwise("high")


def edit_points(edit: Column, downstream: Column) -> Column:
    """Points of a planned edit by its kind."""
    return F.when(edit.isin("rename", "delete", "signature_change"), 2).when(edit == "behavior_change", 1).when((edit == "refactor") & (downstream > 5), 1).otherwise(0)


def safe_edit(downstream: Column, grade: Column, tests: Column, is_init: Column, edit: Column, deps: Column) -> Column:
    points = ladder(downstream, [(21, 3), (6, 2), (1, 1)]) + F.when(grade.isin("D", "F"), 2).when(grade == "C", 1).otherwise(0) + F.when(tests == 0, 2).otherwise(0) + F.when(is_init, 2).otherwise(0) + edit_points(edit, downstream) + F.when(deps > 10, 1).otherwise(0)
    return F.when(points >= 6, "dangerous").when(points >= 3, "caution").otherwise("safe")


def change_risk(affected: Column) -> Column:
    return F.when(affected <= 2, "low").when(affected <= 8, "medium").otherwise("high")


def facet_risk(complexity: Column, grade: Column, caller_edges: Column) -> Column:
    return F.when((complexity >= 11) | grade.isin("D", "F") | (caller_edges >= 10), "review").otherwise("ok")


def trace_level(uses: Column) -> Column:
    return F.when(uses == 0, "none").when(uses <= 5, "low").when(uses <= 20, "medium").otherwise("high")


def scan(files: DataFrame, rules: dict[str, str]) -> DataFrame:
    """(id, rule, line_no) of each line that a rule matches; all rules in one pass over the lines."""
    if not rules:
        raise ValueError("no rules")
    hits = F.filter(F.array(*[F.when(F.col("line").rlike(p), F.lit(r)) for r, p in rules.items()]), lambda x: x.isNotNull())
    return lines(files).withColumn("hits", hits).where(F.size("hits") > 0).select("id", "line_no", F.explode("hits").alias("rule"))


def docstring_lines(lines_: Column) -> Column:
    """Numbers, from 1, of the lines inside or at the ends of triple-quoted strings."""
    start = F.struct(F.lit("").alias("end"), F.array().cast("array<int>").alias("found"), F.lit(0).alias("n"))
    double, single = F.lit('"' * 3), F.lit("'" * 3)

    def step(acc: Column, line: Column) -> Column:
        n = acc["n"] + 1
        mark = F.when(acc["end"] != "", acc["end"]).when(line.contains(double), double).when(line.contains(single), single).otherwise("")
        opens = (acc["end"] == "") & (mark != "")
        again = F.substring(line, F.call_function("instr", line, mark) + 3, F.length(line)).contains(mark)
        end = F.when(acc["end"] != "", F.when(line.contains(acc["end"]), "").otherwise(acc["end"])).when(opens & ~again, mark).otherwise("")
        return F.struct(end.alias("end"), F.when(mark != "", F.concat(acc["found"], F.array(n))).otherwise(acc["found"]).alias("found"), n.alias("n"))

    return F.aggregate(lines_, start, step)["found"]


def code_lines(files: DataFrame) -> DataFrame:
    """(id, path, language, line_no, line, bare, quoted): lines of files, stripped ones beside them, and whether a Python docstring holds them."""
    v = files.select("id", "path", "language", source_lines(F.col("content")).alias("v"))
    v = v.withColumn("doc", F.when(F.col("language") == "python", docstring_lines(F.col("v"))).otherwise(F.array().cast("array<int>")))
    ll = v.select("id", "path", "language", "doc", F.posexplode("v").alias("n", "line")).withColumn("line_no", F.col("n") + 1)
    return ll.select("id", "path", "language", "line_no", "line", stripped(F.col("line")).alias("bare"), F.array_contains("doc", F.col("line_no")).alias("quoted"))


def security(files: DataFrame) -> DataFrame:
    """(id, issue, severity, line_no) of each line that an issue's pattern of its language matches; files: id, path, language, content.

    In Python, issues that need running code don't count inside strings,
    comments and docstrings: a match must begin where strings before it are
    closed.
    """
    ll = code_lines(files)
    path = F.replace("path", F.lit("\\"), F.lit("/"))
    name = F.regexp_extract(path, "([^/]*)$", 1)
    test = path.contains("/tests/") | path.startswith("tests/") | name.startswith("test_") | name.endswith("_test.py")
    closed = r"""^(?:[^"'#]|"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*')*?"""
    tests = []
    for language, rules in [*SECURITY_RULES.items(), (None, [_SECRET])]:
        mine = F.col("language") == language if language else ~F.coalesce(F.col("language"), F.lit("")).isin(list(SECURITY_RULES))
        for issue, pattern, severity in rules:
            body = SECURITY[pattern]
            if language == "python" and issue in NOT_IN_STRINGS:
                hit = F.col("line").rlike(f"{closed}(?:{body})") & ~F.col("quoted")
            else:
                hit = F.col("line").rlike(body)
            if issue == "assert_in_prod":
                hit = hit & ~test
            tests.append(F.when(mine & hit, F.struct(F.lit(issue).alias("issue"), F.lit(severity).alias("severity"))))
    found = F.filter(F.array(*tests), lambda x: x.isNotNull())
    return ll.select("id", "line_no", F.explode(found).alias("x")).select("id", "x.issue", "x.severity", "line_no")


def mutable_defaults(source: str | None) -> list[int]:
    """Lines of list, dict and set defaults of Python functions; none where the source doesn't parse."""
    import ast

    try:
        tree = ast.parse(source or "")
    except (SyntaxError, ValueError):
        return []
    out = set()
    for node in ast.walk(tree):
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.Lambda)):
            for d in [*node.args.defaults, *node.args.kw_defaults]:
                empty = isinstance(d, ast.Call) and isinstance(d.func, ast.Name) and d.func.id in ("list", "dict", "set") and not d.args and not d.keywords
                if isinstance(d, (ast.List, ast.Dict, ast.Set)) or empty:
                    out.add(d.lineno)
    return sorted(out)


def anti_patterns(files: DataFrame) -> DataFrame:
    """(id, rule, line_no) of anti-patterns of Python, JavaScript, TypeScript and Java; files: id, path, language, content.

    Mutable defaults come from the syntax tree, the others from lines; in Python
    docstrings and comment lines don't count.
    """
    from collections.abc import Iterator

    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, n) for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for n in mutable_defaults(text)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], batch.schema.types[0]), pa.array([r[1] for r in rows], pa.int32())], ["id", "line_no"])

    kind = files.schema["id"].dataType.simpleString()
    may = files.where((F.col("language") == "python") & F.col("content").rlike(r"(?:def|lambda)\b"))
    mutable = may.select("id", "content").mapInArrow(run, f"id {kind}, line_no int").withColumn("AP001", F.lit(True))
    ll = code_lines(files.where(F.col("language").isin("python", "javascript", "typescript", "java")))
    near = F.max(F.col("line").contains("def ")).over(W.partitionBy("id").orderBy("line_no").rowsBetween(-29, 0))
    ll = ll.withColumn("in_def", near).join(mutable, ["id", "line_no"], "left")
    b, python = F.col("bare"), F.col("language") == "python"
    script = F.col("language").isin("javascript", "typescript")
    live = python & ~F.col("quoted") & ~b.startswith("#")
    tests = {
        "AP001": live & F.coalesce("AP001", F.lit(False)),
        "AP002": live & (b == "except:"),
        "AP003": live & b.contains("print(") & F.col("in_def"),
        "AP010": script & b.contains("var ") & ~b.startswith("//"),
        "AP011": script & (b.contains("== ") | b.contains(" !=")) & ~b.contains("===") & ~b.contains("!=="),
        "AP020": (F.col("language") == "java") & b.contains("System.out.println") & ~b.startswith("//"),
        "AP021": (F.col("language") == "java") & b.contains("e.printStackTrace()"),
    }
    found = F.filter(F.array(*[F.when(c, F.lit(r)) for r, c in tests.items()]), lambda x: x.isNotNull())
    return ll.select("id", F.explode(found).alias("rule"), "line_no")


def smells(files: DataFrame, symbols: DataFrame | None = None) -> DataFrame:
    """(id, smell, severity): oversized files, long lines, too many notes, deep nesting by indentation.

    With ``symbols`` (id of the file, kind, line, end_line) also a single class
    of more than 300 lines, and a row for each function of more than 50.
    """
    ll = lines(files)
    indent = F.floor(F.length(F.regexp_extract("line", "^( *)", 1)) / 4)
    g = ll.groupBy("id").agg(F.count("*").alias("n"), F.max(F.length("line")).alias("longest"), F.sum((F.col("line").rlike("(TODO|FIXME|HACK|XXX)")).cast("int")).alias("notes"), F.max(indent).alias("deep"))
    one = lambda cond, name, severity: F.when(cond, F.struct(F.lit(name).alias("smell"), severity.alias("severity")))
    worse = lambda c: F.when(c, "critical").otherwise("warning")
    found = F.array(one(F.col("n") > 500, "oversized_file", worse(F.col("n") > 1000)), one(F.col("longest") > 200, "long_line", F.lit("warning")), one(F.col("notes") > 5, "technical_debt", F.lit("info")), one(F.col("deep") > 4, "deep_nesting", worse(F.col("deep") > 6)))
    out = g.select("id", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("x")).select("id", "x.smell", "x.severity")
    if symbols is None:
        return out
    size = F.col("end_line") - F.col("line") + 1
    classes = symbols.where("kind = 'class'").groupBy("id").agg(F.count("*").alias("n"), F.max(size).alias("size")).where("n = 1 and size > 300")
    functions = symbols.where(F.col("kind").isin("function", "method")).select("id", size.alias("size")).where("size > 50")
    out = out.unionByName(classes.select("id", F.lit("god_class").alias("smell"), worse(F.col("size") > 500).alias("severity")))
    return out.unionByName(functions.select("id", F.lit("long_method").alias("smell"), worse(F.col("size") > 100).alias("severity")))


def clone_groups(files: DataFrame, key: Column | None = None) -> DataFrame:
    """(fingerprint, n, first): texts that are alike but for names, comments and white space."""
    g = files.select("id", (key if key is not None else fingerprint(F.col("content"))).alias("fingerprint"))
    return g.groupBy("fingerprint").agg(F.count("*").alias("n"), F.min("id").alias("first")).where("n > 1")


def untested(symbols: DataFrame, targets: DataFrame) -> DataFrame:
    """(id, score, priority) of symbols that no test target names; classes, risk, membership and complexity make the score."""
    left = symbols.join(targets.select(F.col("target").alias("name")).distinct(), "name", "left_anti")
    risk = risk_band(F.col("complexity"))
    score = F.when(F.col("kind") == "class", 5).otherwise(0) + F.when(risk == "critical", 10).when(risk == "high", 7).when(risk == "medium", 3).otherwise(0) + F.when(F.coalesce("class", F.lit("")) != "", 2).otherwise(0) + F.when(F.col("complexity") > 1, F.col("complexity")).otherwise(0)
    band = F.when(F.col("score") >= 10, "critical").when(F.col("score") >= 7, "high").when(F.col("score") >= 3, "medium").otherwise("low")
    return left.withColumn("score", score.cast("bigint")).select("id", "score", band.alias("priority"))


def covered(symbols: DataFrame, executed: DataFrame) -> DataFrame:
    """(id, covered): whether a line of the body – after the first – was executed; one-line symbols never are.

    Spans and lines meet in bins of 64 lines: an equality join.
    """
    s = symbols.select("id", "file", (F.col("line") + 1).alias("a"), "end_line")
    binned = s.where("a <= end_line").withColumn("bin", F.explode(F.sequence(F.floor(F.col("a") / 64), F.floor(F.col("end_line") / 64))))
    hit = binned.join(executed.select(F.col("file"), F.col("line").alias("at")).distinct().withColumn("bin", F.floor(F.col("at") / 64)), ["file", "bin"]).where("at between a and end_line").select("id").distinct()
    return s.select("id").join(hit.withColumn("covered", F.lit(True)), "id", "left").select("id", F.coalesce("covered", F.lit(False)).alias("covered"))


def violations(edges: DataFrame, rules: list[dict]) -> DataFrame:
    """(rule_id, severity, caller_file, callee_file, n): calls between files that a rule forbids.

    The rules become one column of matches, so the edges are scanned once and nothing is joined.
    """
    if not rules:
        raise ValueError("no rules")
    tests = []
    for r in rules:
        hit = F.col("caller_file").rlike(glob_regex(r["from"])) & F.col("callee_file").rlike(glob_regex(r["to"]))
        for exception in r.get("exceptions", ()):
            hit = hit & ~F.col("caller_file").rlike(glob_regex(exception))
        tests.append(F.when(hit, F.struct(F.lit(r["id"]).alias("rule_id"), F.lit(r.get("severity", "error")).alias("severity"))))
    broken = F.filter(F.array(*tests), lambda x: x.isNotNull())
    e = edges.select("caller_file", "callee_file", F.explode(broken).alias("r"))
    return e.groupBy(F.col("r.rule_id").alias("rule_id"), F.col("r.severity").alias("severity"), "caller_file", "callee_file").agg(F.count("*").alias("n"))


def unused_names(declared: DataFrame, used: DataFrame) -> DataFrame:
    """Names (file, name) that a file declares and doesn't use: unused imports, unreferenced variables."""
    return declared.select("file", "name").distinct().join(used.select("file", "name").distinct(), ["file", "name"], "left_anti")


def decision_count(content: Column) -> Column:
    return F.regexp_count(content, F.lit(DECISIONS)) + 1


#: What marks a path as a test's or a document's when a change is classified, and a text as public.
CHANGE_TESTS = ["test_", "_test.", "/tests/", "\\tests\\", "/test/", "\\test\\", "spec_", "_spec.", "/spec/", "/__tests__/", "conftest"]
CHANGE_DOCS = [".md", ".rst", ".txt", ".adoc"]
PUBLIC_MARKS = ["export", "public", "__all__", "API", "api"]


def classify_change(path: Column, node: Column, change: Column, name: Column, preview: Column) -> tuple[Column, Column]:
    """Category and confidence of a change by the first rule that fits.

    ``node`` is the kind of element, ``change`` how it differs (added, removed,
    renamed, signature_changed, body_changed, changed).
    """
    low = F.lower(path)
    hit = lambda marks, test: F.coalesce(reduce(lambda a, b: a | b, [test(m) for m in marks]), F.lit(False))
    public = F.coalesce((name != "") & (~name.startswith("_") | name.startswith("__")), F.lit(False))
    marked = hit(PUBLIC_MARKS, preview.contains)
    element = node.isin("function", "class", "method")
    rule = lambda category, confidence: F.struct(F.lit(category).alias("category"), (confidence if isinstance(confidence, Column) else F.lit(confidence)).cast("double").alias("confidence"))
    sure = lambda a, b: F.when(public, a).otherwise(b)
    c = (
        F.when(hit(CHANGE_TESTS, low.contains), rule("test_change", 0.9))
        .when(hit(CHANGE_DOCS, low.endswith), rule("documentation", 0.9))
        .when(node == "import", rule("import_change", 0.85))
        .when((change == "signature_changed") & (public | marked), rule("api_change", sure(0.85, 0.6)))
        .when(change == "signature_changed", rule("refactor", 0.7))
        .when((change == "renamed") & public, rule("api_change", 0.8))
        .when(change == "renamed", rule("refactor", 0.75))
        .when((change == "added") & element, rule("feature_addition", 0.8))
        .when(change == "added", rule("internal_change", 0.6))
        .when((change == "removed") & element, rule("feature_removal", sure(0.85, 0.7)))
        .when(change == "removed", rule("internal_change", 0.5))
        .when(change == "body_changed", rule("internal_change", 0.7))
        .when(change == "changed", rule("internal_change", 0.5))
        .otherwise(rule("unknown", 0.3))
    )
    return c["category"], c["confidence"]


def diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(kind, old_pos, new_pos, old_name, new_name, change) of the elements of one file's two versions.

    Elements: file, pos, kind, name, signature, body, digest, members (array of
    names).  Named ones are matched by kind, name and order.  Functions, classes
    and methods left over are matched to one of their kind with common members,
    in the order of the old ones, each to the one with most; what a task sees
    together are the elements of one file and kind that have no partner of their
    name.
    """
    def numbered(d: DataFrame, side: str) -> DataFrame:
        named = F.col("name").isNotNull() & (F.col("name") != "")
        k = F.row_number().over(W.partitionBy("file", "kind", "name").orderBy("pos"))
        d = d.withColumn("k", F.when(named, k).otherwise(-F.col("pos") * 2 - (1 if side == "new" else 0) - 1))
        return d.select("file", "kind", F.coalesce("name", F.lit("")).alias("name"), "k", F.struct("pos", "name", "signature", "body", "digest", "members").alias(side))

    j = numbered(old, "old").join(numbered(new, "new"), ["file", "kind", "name", "k"], "full").select("file", "kind", "old", "new")
    paired = j.where("old is not null and new is not null")
    rest = j.where("old is null or new is null")
    may = rest.where(F.col("kind").isin("function", "class", "method"))
    both = may.groupBy("file", "kind").agg(F.count("old").alias("a"), F.count("new").alias("b")).where("a > 0 and b > 0").select("file", "kind")
    sides = may.join(both, ["file", "kind"], "left_semi")

    def greedy(pdf: pd.DataFrame) -> pd.DataFrame:
        olds = sorted((o for o in pdf["old"] if o is not None), key=lambda o: o["pos"])
        news = sorted((n for n in pdf["new"] if n is not None), key=lambda n: n["pos"])
        taken: set[int] = set()
        out = []
        for o in olds:
            mine = {m for m in (o["members"] if o["members"] is not None else []) if m}
            best, score = None, 0
            for n in news:
                common = len(mine & {m for m in (n["members"] if n["members"] is not None else []) if m})
                if n["pos"] not in taken and common > score:
                    best, score = n, common
            if best is not None:
                taken.add(best["pos"])
                out.append((pdf["file"].iloc[0], pdf["kind"].iloc[0], o["pos"], best["pos"]))
        return pd.DataFrame(out, columns=["file", "kind", "old_pos", "new_pos"])

    pos = old.schema["pos"].dataType.simpleString()
    found = sides.groupBy("file", "kind").applyInPandas(greedy, f"file {old.schema['file'].dataType.simpleString()}, kind string, old_pos {pos}, new_pos {pos}")
    left = rest.where("old is not null").select("file", "kind", "old", F.col("old.pos").alias("old_pos"))
    right = rest.where("new is not null").select("file", "kind", "new", F.col("new.pos").alias("new_pos"))
    met = found.join(left, ["file", "kind", "old_pos"]).join(right, ["file", "kind", "new_pos"]).select("file", "kind", "old", "new")
    gone = left.join(found, ["file", "kind", "old_pos"], "left_anti").select("file", "kind", "old", F.lit(None).cast(j.schema["new"].dataType).alias("new"))
    came = right.join(found, ["file", "kind", "new_pos"], "left_anti").select("file", "kind", F.lit(None).cast(j.schema["old"].dataType).alias("old"), "new")
    every = paired.unionByName(met).unionByName(gone).unionByName(came)
    o, n = F.col("old"), F.col("new")
    renamed = (F.coalesce(o["name"], F.lit("")) != "") & (F.coalesce(n["name"], F.lit("")) != "") & (o["name"] != n["name"])
    change = (
        F.when(o.isNull(), "added").when(n.isNull(), "removed").when(o["digest"].eqNullSafe(n["digest"]), "unchanged").when(renamed, "renamed")
        .when(~o["signature"].eqNullSafe(n["signature"]), "signature_changed").when(~o["body"].eqNullSafe(n["body"]), "body_changed").otherwise("changed")
    )
    return every.select("file", "kind", o["pos"].alias("old_pos"), n["pos"].alias("new_pos"), o["name"].alias("old_name"), n["name"].alias("new_name"), change.alias("change"))


def unreachable(source: str | None) -> list[dict]:
    """Python statements that follow a terminal one in their block, and branches of constant conditions.

    Each is a dict of function, start, end and reason.  A source that doesn't
    parse has none; ``pass`` isn't reported.
    """
    import ast

    try:
        tree = ast.parse(source or "")
    except (SyntaxError, ValueError):
        return []
    out: list[dict] = []

    def ends(node: ast.stmt) -> str | None:
        if isinstance(node, (ast.Return, ast.Raise, ast.Break, ast.Continue)):
            return f"{type(node).__name__.lower()} statement"
        if isinstance(node, ast.Expr) and isinstance(node.value, ast.Call):
            f = node.value.func
            name = f.attr if isinstance(f, ast.Attribute) else getattr(f, "id", "")
            if name in ("exit", "_exit", "abort", "quit"):
                return "exit call"
        return None

    def report(nodes: list[ast.stmt], function: str, reason: str) -> None:
        out.extend({"function": function, "start": n.lineno, "end": n.end_lineno, "reason": reason} for n in nodes if not isinstance(n, ast.Pass))

    def block(nodes: list[ast.stmt], function: str) -> None:
        for k, node in enumerate(nodes):
            inner = node.name if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)) else function
            if isinstance(node, ast.If) and isinstance(node.test, ast.Constant):
                dead = node.orelse if node.test.value else node.body
                report(dead, function, f"condition is always {bool(node.test.value)} on line {node.lineno}")
                block(node.body if node.test.value else node.orelse, function)
            else:
                for field in ("body", "orelse", "finalbody"):
                    if isinstance(getattr(node, field, None), list):
                        block(getattr(node, field), inner)
                for h in [*getattr(node, "handlers", []), *getattr(node, "cases", [])]:
                    block(h.body, inner)
            if reason := ends(node):
                report(nodes[k + 1 :], function, f"code after {reason} on line {node.lineno}")
                return

    block(tree.body, "")
    return out


def unreachable_code(files: DataFrame) -> DataFrame:
    """(id, function, start, end, reason) of Python files: id, language, content."""
    from collections.abc import Iterator

    import pyarrow as pa

    kind = files.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, u) for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for u in unreachable(text)]
            cols = [pa.array([r[0] for r in rows], batch.schema.types[0])]
            cols += [pa.array([r[1][k] for r in rows], t) for k, t in (("function", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("reason", pa.string()))]
            yield pa.RecordBatch.from_arrays(cols, ["id", "function", "start", "end", "reason"])

    return files.where("language = 'python'").select("id", "content").mapInArrow(run, f"id {kind}, function string, start int, end int, reason string")
