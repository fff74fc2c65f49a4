"""The chain DSL: ``search('x').callers(depth=2).filter(kind='function').take(5)`` folded into one lazy plan."""

from __future__ import annotations

import ast
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import grade, is_generated_path, is_test_path
from ..operators import graph, quality, search

MAX_CHARS, MAX_STEPS, MAX_ITEMS, MAX_STRING = 4096, 20, 8, 160
_PREDICATES = {"name", "kind", "file", "path", "language", "test", "generated", "regex", "case"}
_FACETS = {"source", "callers", "callees", "complexity", "health", "risk", "affected_tests"}
_SHOWN = _FACETS | {"max_files", "max_symbols", "include_code", "limit"}
#: Steps and their keyword arguments.
STEPS: dict[str, set[str]] = {
    "search": {"query", "limit"}, "semantic": {"query", "limit"}, "explore": {"query", "max_files", "max_symbols", "include_code"},
    "callers": {"depth", "limit"}, "callees": {"depth", "limit"}, "related": {"depth", "limit"},
    "filter": _PREDICATES, "where": _PREDICATES, "exclude": _PREDICATES, "not": _PREDICATES,
    "has": _PREDICATES | {"callers", "callees", "depth", "limit"}, "take": {"limit"}, "sort": {"by", "desc"},
    "include": _SHOWN, "with": _SHOWN, "uml": {"direction", "limit", "max_edges"}, "answer": {"compact"},
}


class ChainError(ValueError):
    """A chain that can't be read."""


@dataclass(frozen=True)
class Step:
    name: str
    args: tuple = ()
    kwargs: dict = field(default_factory=dict)


def _literal(node: ast.expr):
    if isinstance(node, ast.Name) and node.id in ("true", "false", "null"):
        return {"true": True, "false": False, "null": None}[node.id]
    try:
        value = ast.literal_eval(node)
    except (ValueError, TypeError):
        raise ChainError("only literals are allowed as arguments") from None
    for v in value if isinstance(value, (list, tuple)) else [value]:
        if isinstance(v, str) and len(v) > MAX_STRING:
            raise ChainError(f"a string is longer than {MAX_STRING}")
    if isinstance(value, (list, tuple)) and len(value) > MAX_ITEMS:
        raise ChainError(f"a list has more than {MAX_ITEMS} items")
    return value


def parse(text: str) -> list[Step]:
    """Steps of a chain; a text without ``(`` explores it and what is related."""
    text = text.strip()
    if not text or len(text) > MAX_CHARS:
        raise ChainError("a chain has 1 to 4096 characters")
    if "(" not in text:
        if "|" in text:
            raise ChainError("'|' is not an operator")
        return [Step("explore", (text,)), Step("related")]
    try:
        node = ast.parse(text.replace(".not(", ".not_(").replace(".with(", ".with_("), mode="eval").body
    except SyntaxError as e:
        raise ChainError(f"not a chain: {e.msg}") from None
    steps: list[Step] = []
    while isinstance(node, ast.Call):
        f = node.func
        name = (f.attr if isinstance(f, ast.Attribute) else getattr(f, "id", "")).rstrip("_")
        if name not in STEPS:
            raise ChainError(f"unknown step {name!r}")
        kwargs = {k.arg: _literal(k.value) for k in node.keywords}
        if bad := set(kwargs) - STEPS[name]:
            raise ChainError(f"{name} doesn't take {sorted(map(str, bad))}")
        steps.append(Step(name, tuple(map(_literal, node.args)), kwargs))
        node = f.value if isinstance(f, ast.Attribute) else None
    if node is not None:
        raise ChainError("not a chain of calls")
    if len(steps) > MAX_STEPS:
        raise ChainError(f"more than {MAX_STEPS} steps")
    return steps[::-1]


def predicate(kwargs: dict) -> Column | None:
    """One column of all conditions: substring matches, lists any of; None without a condition."""
    low = (lambda c: c) if kwargs.get("case") else F.lower
    out: Column | None = None

    def both(c: Column) -> None:
        nonlocal out
        out = c if out is None else out & c

    for key, value in kwargs.items():
        if key in ("name", "kind", "file", "path", "language"):
            col = low(F.col("file" if key == "path" else key))
            any_of = F.lit(False)
            for v in value if isinstance(value, (list, tuple)) else [value]:
                any_of = any_of | F.contains(col, F.lit(str(v) if kwargs.get("case") else str(v).lower()))
            both(any_of)
        elif key == "test":
            both(is_test_path(F.col("file")) == bool(value))
        elif key == "generated":
            both(is_generated_path(F.col("file")) == bool(value))
        elif key == "regex":
            flag = "" if kwargs.get("case") else "(?i)"
            any_of = F.lit(False)
            for c in ("name", "kind", "file", "language"):
                any_of = any_of | F.col(c).rlike(flag + value)
            both(any_of)
    return out


class Engine:
    """Runs chains over symbols (id, name, kind, file, language, line, ...) and call edges (src, dst) of their ids.

    ``run`` returns the selection.  What a chain asks for beside it is in
    ``facets``: ``uml`` (the calls inside the selection as diagram lines),
    ``files`` of an exploration, and ``compact``.  Facets of each symbol are
    columns.  ``files`` (file, content) is needed for sources.
    """

    def __init__(self, symbols: DataFrame, calls: DataFrame, files: DataFrame | None = None):
        self.symbols, self.calls, self.files = symbols, calls, files
        self.facets: dict = {}

    def run(self, text: str) -> DataFrame:
        current: DataFrame | None = None
        self.facets = {}
        for step in parse(text):
            n, a, k = step.name, step.args, step.kwargs
            if n in ("search", "semantic") or (n == "explore" and (a or k.get("query") or current is None)):
                current = self._found(n, self._queries(a, k, n), self._number(k, "max_symbols" if n == "explore" else "limit"))
            elif current is None:
                raise ChainError("a chain begins with search, semantic or explore")
            elif n in ("callers", "callees"):
                current = self._limited(self._step(current, n, self._depth(a, k)), self._number(k, "limit"))
            elif n == "related":
                depth, limit = self._depth(a, k), self._number(k, "limit")
                both = [self._limited(self._step(current, way, depth), limit) for way in ("callers", "callees")]
                current = both[0].unionByName(both[1]).dropDuplicates(["id"])
            elif n in ("filter", "where", "exclude", "not"):
                p = predicate(k)
                if p is not None:
                    current = current.where(p if n in ("filter", "where") else ~p)
            elif n == "has":
                current = self._having(current, a, k)
            elif n == "sort":
                current = self._sorted(current, k.get("by", a[0] if a else "name"), bool(k.get("desc")))
            elif n == "take":
                size = k.get("limit", a[0] if a else 10)
                if not isinstance(size, int) or size < 0:
                    raise ChainError("take needs a number of 0 or more")
                current = current.limit(size)
            elif n in ("include", "with"):
                asked = {x for x in a if isinstance(x, str)} | {x for x, on in k.items() if on and x in _FACETS}
                if bad := asked - _FACETS:
                    raise ChainError(f"unknown facets {sorted(bad)}")
                current = self._with(current, asked)
            elif n == "uml":
                self.facets["uml"] = self._uml(current, str(k.get("direction") or "LR"), self._number(k, "max_edges") or self._number(k, "limit"))
            elif n == "answer":
                self.facets["compact"] = bool(k.get("compact", True))
            if n == "explore":
                self.facets["files"] = self._explored(current, self._number(k, "max_files"), bool(k.get("include_code")))
        if current is None:
            raise ChainError("an empty chain")
        return current

    @staticmethod
    def _number(k: dict, name: str) -> int | None:
        v = k.get(name)
        if v is not None and (not isinstance(v, int) or isinstance(v, bool) or v < 0):
            raise ChainError(f"{name} needs a number of 0 or more")
        return v

    def _depth(self, a: tuple, k: dict) -> int:
        v = k.get("depth", a[0] if a else 1)
        if not isinstance(v, int) or v < 1:
            raise ChainError("depth needs a number of 1 or more")
        return min(v, 5)

    @staticmethod
    def _queries(a: tuple, k: dict, n: str) -> list[str]:
        q = [*a, *([k["query"]] if k.get("query") is not None else [])]
        flat = [x for v in q for x in (v if isinstance(v, (list, tuple)) else [v])]
        out = [t.strip() for x in flat for t in (str(x).split(",") if n == "search" else [str(x)]) if t.strip()]
        if not out and n != "explore":
            raise ChainError(f"{n} needs a text")
        return out

    def _found(self, n: str, queries: list[str], limit: int | None) -> DataFrame:
        if not queries:
            return self._limited(self.symbols, limit)
        if n == "search":
            hits = self.symbols.where(F.col("name").isin(queries))
            return self._limited(hits, limit)
        parts = []
        for q in queries:
            if n == "semantic":
                h = search.semantic(self.symbols, q)
                parts.append((h.orderBy(F.desc("score"), "id").limit(limit) if limit is not None else h).select("id"))
            else:
                parts.append(search.cascade(self.symbols, q, limit).select("id"))
        return self.symbols.join(reduce(lambda x, y: x.unionByName(y), parts).distinct(), "id", "left_semi")

    def _having(self, current: DataFrame, a: tuple, k: dict) -> DataFrame:
        ways = [w for w in ("callers", "callees") if k.get(w)]
        if not ways:
            raise ChainError("has needs callers or callees")
        p = predicate(k)
        far = self.symbols.where(p) if p is not None else self.symbols
        for w in ways:
            e = self.calls.select("src", "dst") if w == "callers" else graph.reverse(self.calls)
            # From what the predicate allows towards the selection: a row a node, whatever the depth.
            if self._depth((), k) == 1:
                near = e.join(far.select(F.col("id").alias("src")), "src", "left_semi").select(F.col("dst").alias("id")).distinct()
            else:
                near = graph.reach(e, far.select(F.col("id").alias("node")), self._depth((), k)).where("seed <> node").select(F.col("node").alias("id")).distinct()
            current = current.join(near, "id", "left_semi")
        return current

    def _sorted(self, current: DataFrame, by: str, desc: bool) -> DataFrame:
        by = "file" if by == "path" else by
        if by in ("fan_in", "fan_out"):
            current = self._with(current, {"callers"})
        if by not in current.columns:
            raise ChainError(f"nothing to sort by named {by!r}")
        return current.orderBy(F.desc(by) if desc else F.asc(by), "file", "line", "id")

    def _with(self, current: DataFrame, asked: set[str]) -> DataFrame:
        have = set(current.columns)
        if asked & {"callers", "callees", "risk"} and not {"fan_in", "fan_out"} <= have:
            d = graph.degrees(self.calls, current.select(F.col("id").alias("node")).distinct())
            current = current.join(d.withColumnRenamed("node", "id"), "id")
        if asked & {"health", "risk"} and "grade" not in have:
            g = self.symbols.groupBy("file").agg(F.count("*").alias("n_"), F.avg("complexity").alias("a_"), F.sum("complexity").alias("t_"))
            g = g.select("file", grade(quality.complexity_score(F.col("n_"), F.col("a_"), F.col("t_"))).alias("grade"))
            current = current.join(g, "file", "left")
        if "risk" in asked and "risk" not in have:
            current = current.withColumn("risk", quality.facet_risk(F.col("complexity"), F.col("grade"), F.col("fan_in")))
        if "affected_tests" in asked and "affected_tests" not in have:
            up = graph.reach(graph.reverse(self.calls), current.select(F.col("id").alias("node")), 2)
            tests = self.symbols.where(is_test_path(F.col("file"))).select(F.col("id").alias("node"), F.col("file").alias("test_"))
            t = up.join(tests, "node").groupBy(F.col("seed").alias("id")).agg(F.array_sort(F.collect_set("test_")).alias("affected_tests"))
            current = current.join(t, "id", "left").withColumn("affected_tests", F.coalesce("affected_tests", F.array().cast("array<string>")))
        if "source" in asked and "source" not in have:
            if self.files is None:
                raise ChainError("sources need files")
            body = self.files.select("file", F.split("content", "\n").alias("v_"))
            span = F.slice("v_", F.col("line"), F.greatest(F.lit(1), F.col("end_line") - F.col("line") + 1))
            current = current.join(body, "file", "left").withColumn("source", F.array_join(span, "\n")).drop("v_")
        return current

    def _uml(self, current: DataFrame, direction: str, limit: int | None) -> DataFrame:
        """(src, dst, line): the calls inside the selection as lines of a flow chart."""
        ends = current.select("id", "name").distinct()
        e = self.calls.select("src", "dst").distinct().join(ends.select(F.col("id").alias("src"), F.col("name").alias("src_name")), "src").join(ends.select(F.col("id").alias("dst"), F.col("name").alias("dst_name")), "dst")
        e = e.orderBy("src", "dst").limit(limit) if limit is not None else e
        line = F.concat(F.lit("n"), F.col("src").cast("string"), F.lit("[\""), "src_name", F.lit("\"] --> n"), F.col("dst").cast("string"), F.lit("[\""), "dst_name", F.lit("\"]"))
        return e.select("src", "dst", F.lit(direction).alias("direction"), line.alias("line"))

    def _explored(self, current: DataFrame, most: int | None, code: bool) -> DataFrame:
        """(file, symbols and, if asked for, content) of the selection's files."""
        f = current.groupBy("file").agg(F.count("*").alias("symbols"))
        if most is not None:
            f = f.orderBy(F.desc("symbols"), "file").limit(most)
        return f.join(self.files.select("file", "content"), "file", "left") if code and self.files is not None else f

    def _limited(self, d: DataFrame, n: int | None) -> DataFrame:
        return d.orderBy(is_test_path(F.col("file")), is_generated_path(F.col("file")), "file", "line", "name", "id").limit(n) if n is not None else d

    def _step(self, d: DataFrame, way: str, depth: int) -> DataFrame:
        e = graph.reverse(self.calls) if way == "callers" else self.calls.select("src", "dst")
        found = graph.reach(e, d.select(F.col("id").alias("node")), depth).select(F.col("node").alias("id")).distinct()
        return self.symbols.join(found, "id", "left_semi")
