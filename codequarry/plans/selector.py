"""The selector DSL: CSS-like queries over symbols, compiled to one lazy plan.

    List   := Sel (',' Sel)*
    Sel    := Simple ((WS | '>' | '~') Simple)*
    Simple := ('#'name | '.'kind | '*') ('[' attr '=' value ']')* (':'name ('(' arg ')')?)*
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

KEY = ["name", "file", "line"]
#: Pseudo-classes that follow an edge: kinds, and whether the candidate is the edge's source.
EDGES = {
    "calls": (["calls"], True), "callees": (["calls"], False), "called-by": (["calls"], False),
    "extends": (["extends", "implements"], True), "implements": (["extends", "implements"], True), "subclasses": (["extends", "implements"], True),
    "has": (["contains"], True),
}
_CLASSES = {"class", "struct", "interface", "trait", "enum"}
_FUNCTIONS = {"function", "method", "func", "fn"}


class SelectorError(ValueError):
    """A selector that can't be read; ``at`` is the place."""

    def __init__(self, message: str, at: int):
        super().__init__(f"{message} at {at}")
        self.at = at


@dataclass(frozen=True)
class Simple:
    base: str  # '#', '.' or '*'
    value: str = ""
    attributes: tuple[tuple[str, str], ...] = ()
    pseudo: tuple[tuple[str, object], ...] = ()


@dataclass(frozen=True)
class Selector:
    parts: tuple[Simple, ...]
    combinators: tuple[str, ...] = ()


@dataclass
class _Reader:
    text: str
    at: int = 0
    depth: int = field(default=0)

    def blank(self) -> bool:
        start = self.at
        while self.at < len(self.text) and self.text[self.at].isspace():
            self.at += 1
        return self.at > start

    def peek(self) -> str:
        return self.text[self.at] if self.at < len(self.text) else ""

    def take(self, pattern: str, what: str) -> str:
        m = re.compile(pattern).match(self.text, self.at)
        if not m:
            raise SelectorError(f"expected {what}", self.at)
        self.at = m.end()
        return m[0]

    def selectors(self) -> tuple[Selector, ...]:
        out = [self.selector()]
        while self.peek() == ",":
            self.at += 1
            out.append(self.selector())
        return tuple(out)

    def selector(self) -> Selector:
        self.blank()
        parts, ways = [self.simple()], []
        while True:
            gap = self.blank()
            c = self.peek()
            if c in (">", "~") and c:
                self.at += 1
                self.blank()
                ways.append(c)
            elif gap and c and c not in ",)":
                ways.append(" ")
            else:
                return Selector(tuple(parts), tuple(ways))
            parts.append(self.simple())

    def simple(self) -> Simple:
        c = self.peek()
        if c not in ("#", ".", "*") or not c:
            raise SelectorError("expected '#', '.' or '*'", self.at)
        self.at += 1
        value = "" if c == "*" else self.take(r"[\w$.-]+" if c == "#" else r"[\w-]+", "a name")
        attributes, pseudo = [], []
        while self.peek() == "[":
            self.at += 1
            key = self.take(r"\w+", "an attribute")
            self.take("=", "'='")
            attributes.append((key, self.take(r"[^\]]*", "a value").strip("\"' ")))
            self.take(r"\]", "']'")
        while self.peek() == ":":
            self.at += 1
            name, arg = self.take(r"[\w-]+", "a pseudo-class"), None
            if self.peek() == "(":
                self.at += 1
                self.blank()
                if self.peek() in ("#", ".", "*") and not re.match(r"\.{0,2}/", self.text[self.at :]):
                    arg = self.selectors()
                else:
                    arg = self.take(r"[^)]*", "an argument").strip()
                self.blank()
                self.take(r"\)", "')'")
            pseudo.append((name, arg))
        return Simple(c, value, tuple(attributes), tuple(pseudo))


def parse(text: str) -> tuple[Selector, ...]:
    """Selectors of a list; raises SelectorError on anything left over."""
    r = _Reader(text)
    out = r.selectors()
    r.blank()
    if r.at < len(text):
        raise SelectorError(f"unexpected {r.peek()!r}", r.at)
    return out


class Compiler:
    """Turns selectors into DataFrames over symbols (name, file, line, kind, language, class) and edges (kind, src_name, src_file, dst_name, dst_file)."""

    def __init__(self, symbols: DataFrame, edges: DataFrame):
        self.symbols, self.edges = symbols, edges

    def select(self, text: str) -> DataFrame:
        parts = [self._selector(s) for s in parse(text)]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out.dropDuplicates(KEY)

    def _list(self, selectors: tuple[Selector, ...]) -> DataFrame:
        parts = [self._selector(s) for s in selectors]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def _selector(self, s: Selector) -> DataFrame:
        left = self._simple(s.parts[0])
        for way, part in zip(s.combinators, s.parts[1:], strict=True):
            right = self._simple(part)
            if way == "~":
                right = right.join(left.where("class is not null").select("class").distinct(), "class", "left_semi")
            else:  # child and descendant alike: the right one's class is a name on the left
                right = right.join(left.select(F.col("name").alias("owner_")).distinct(), F.col("class") == F.col("owner_"), "left_semi")
            left = right.select(*self.symbols.columns)
        return left

    def _simple(self, s: Simple) -> DataFrame:
        d = self.symbols
        if s.base == "#":
            d = d.where(F.col("name") == s.value)
        elif s.base == "*":
            d = d.where(F.col("kind").isin("function", "method", "class"))
        elif s.value in _FUNCTIONS:
            d = d.where(F.col("kind").isin("function", "method"))
            d = d.where("class is not null and class <> ''") if s.value == "method" else d
        else:
            d = d.where(F.col("kind") == ("class" if s.value in _CLASSES else s.value))
        for key, value in s.attributes:
            if key == "file":
                d = d.where(F.col("file").contains(value))
            elif key in ("language", "class"):
                d = d.where(F.col(key) == value)
            elif key == "kind":
                d = d.where(F.coalesce("kind", F.lit("function")) == value)
            else:
                d = d.where(F.lit(False))
        for name, arg in s.pseudo:
            d = self._pseudo(d, name, arg)
        return d

    def _pseudo(self, d: DataFrame, name: str, arg) -> DataFrame:
        if name == "not":
            return d.join(self._list(arg).select(*KEY).distinct(), KEY, "left_anti").select(*self.symbols.columns)
        if name == "in":
            return d.where(F.col("file").startswith(arg))
        if name in ("first-child", "only-child", "nth-child"):
            w = W.partitionBy("class")
            d = d.withColumn("k_", F.row_number().over(w.orderBy("line", "file", "name"))).withColumn("n_", F.count("*").over(w))
            want = F.col("n_") == 1 if name == "only-child" else F.col("k_") == (1 if name == "first-child" else int(arg))
            return d.where(want).drop("k_", "n_")
        if name == "imports":
            names = self._list(arg).select("name").distinct() if isinstance(arg, tuple) else self.symbols.sparkSession.createDataFrame([(arg,)], "name string")
            # Substring of the target: the words of the import are the keys, not every pair.
            e = self.edges.where("kind = 'imports'").select("src_file", F.explode(F.split("dst_name", "[^A-Za-z0-9_]+")).alias("name"))
            return d.join(e.join(names, "name", "left_semi").select(F.col("src_file").alias("file")).distinct(), "file", "left_semi").select(*self.symbols.columns)
        if name not in EDGES:
            raise SelectorError(f"unknown pseudo-class {name!r}", 0)
        kinds, is_source = EDGES[name]
        near, far = ("src", "dst") if is_source else ("dst", "src")
        other = self._list(arg).select("name", "file").distinct()
        e = self.edges.where(F.col("kind").isin(kinds))
        return self._linked(d, self._linked(e, other, far), near)

    def _linked(self, left: DataFrame, right: DataFrame, end: str) -> DataFrame:
        """Semi join of edges and symbols on (name, file), or on the name where the edge has no file: two equality joins."""
        if f"{end}_name" in left.columns:  # edges filtered by symbols
            r = right.select(F.col("name").alias(f"{end}_name"), F.col("file").alias(f"{end}_file"))
            exact = left.where(F.col(f"{end}_file").isNotNull()).join(r, [f"{end}_name", f"{end}_file"], "left_semi")
            loose = left.where(F.col(f"{end}_file").isNull()).join(r.select(f"{end}_name").distinct(), f"{end}_name", "left_semi")
            return exact.select(*left.columns).unionByName(loose.select(*left.columns))
        r = right.select(F.col(f"{end}_name").alias("name"), F.col(f"{end}_file").alias("file")).distinct()
        exact = left.join(r.where("file is not null"), ["name", "file"], "left_semi").select(*left.columns)
        loose = left.join(r.where("file is null").select("name").distinct(), "name", "left_semi").select(*left.columns)
        return exact.unionByName(loose).dropDuplicates(KEY)
