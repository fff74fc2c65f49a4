"""The public entry: one project's tables, and the actions over them."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions import text as tx
from .operators import graph, metrics, quality, resolve, search, sets
from .plans.chain import Engine as ChainEngine
from .plans.selector import Compiler
from .sources import sinks
from .streaming.stateful import Subscriptions


@dataclass
class Project:
    """symbols (id, name, kind, file, language, class, line, end_line, complexity), calls (src, dst of ids) and, where known, imports (src, dst of files), files (id, path, content), edges of the selector DSL."""

    symbols: DataFrame
    calls: DataFrame
    imports: DataFrame | None = None
    files: DataFrame | None = None
    edges: DataFrame | None = None

    @cached_property
    def search(self) -> Search:
        return Search(self)

    @cached_property
    def nav(self) -> Nav:
        return Nav(self)

    @cached_property
    def structure(self) -> Structure:
        return Structure(self)

    @cached_property
    def health(self) -> Health:
        return Health(self)

    @cached_property
    def edit(self) -> Edit:
        return Edit(self)

    @cached_property
    def index(self) -> Index:
        return Index(self)

    @cached_property
    def viz(self) -> Viz:
        return Viz(self)

    def call_edges(self) -> DataFrame:
        """Calls with name, file and language of both ends."""
        side = lambda end, key: self.symbols.select(F.col("id").alias(key), F.col("name").alias(f"{end}_name"), F.col("file").alias(f"{end}_file"), F.col("language").alias(f"{end}_language"))
        return self.calls.join(side("caller", "src"), "src").join(side("callee", "dst"), "dst")

    def need(self, name: str) -> DataFrame:
        table = getattr(self, name)
        if table is None:
            raise ValueError(f"this action needs the project's {name}")
        return table

    def ids_of(self, name: str) -> DataFrame:
        return self.symbols.where(F.col("name") == name).select(F.col("id").alias("node"))


class _Facade:
    def __init__(self, project: Project):
        self.p = project


class Search(_Facade):
    def symbol(self, query: str, limit: int = 50) -> DataFrame:
        return search.cascade(self.p.symbols, query).orderBy("test", F.desc("score"), "tier", F.desc("name"), "file", "id").limit(limit)

    def query(self, query: str, limit: int = 50) -> DataFrame:
        return search.bm25(self.p.symbols, query, limit)

    def content(self, pattern: str, **options) -> DataFrame:
        return search.content(self.p.need("files"), pattern, **options)

    grep = content

    def batch(self, patterns: list[str]) -> DataFrame:
        return search.batch(self.p.need("files"), patterns)

    def chain(self, text: str) -> DataFrame:
        return ChainEngine(self.p.symbols, self.p.calls).run(text)

    def select(self, selector: str) -> DataFrame:
        return Compiler(self.p.symbols, self.p.need("edges")).select(selector)

    def subscriptions(self, min_interval_s: float = 0.0) -> Subscriptions:
        return Subscriptions(self.select, min_interval_s)


class Nav(_Facade):
    def _named(self, found: DataFrame) -> DataFrame:
        return found.join(self.p.symbols.withColumnRenamed("id", "node"), "node").orderBy("depth", "file", "line", "node")

    def callers(self, name: str, depth: int = 1) -> DataFrame:
        return self._named(graph.reach(graph.reverse(self.p.calls), self.p.ids_of(name), depth))

    def callees(self, name: str, depth: int = 1) -> DataFrame:
        return self._named(graph.reach(self.p.calls, self.p.ids_of(name), depth))

    def xref(self, *names: str) -> DataFrame:
        """(name, section, other, file): definitions, callers, callees and dependents of names."""
        wanted = self.p.symbols.sparkSession.createDataFrame([(n,) for n in names], "name string")
        return resolve.xref(self.p.symbols, self.p.call_edges(), wanted)

    def caller_tree(self, root: int, depth: int = 3) -> DataFrame:
        return graph.tree(graph.reverse(self.p.calls), root, depth)

    def callee_tree(self, root: int, depth: int = 3) -> DataFrame:
        return graph.tree(self.p.calls, root, depth)

    def call_path(self, source: int, target: int, max_depth: int = 10, limit: int = 5) -> DataFrame:
        return graph.shortest_paths(self.p.calls, source, target, max_depth, limit)

    def resolve(self, refs: DataFrame) -> DataFrame:
        return resolve.choose(refs, self.p.symbols, tx.is_test_path(F.col("def_file")))

    def impact(self, name: str, depth: int = 5) -> DataFrame:
        return self.callers(name, depth).where(~tx.is_test_path(F.col("file")))

    def test_map(self, name: str, depth: int = 2) -> DataFrame:
        return self.callers(name, depth).where(tx.is_test_path(F.col("file")))

    def co_change(self, commit_files: DataFrame, min_shared: int = 3) -> DataFrame:
        return metrics.cochange(commit_files, min_shared)


class Structure(_Facade):
    def outline(self, file: str) -> DataFrame:
        return self.p.symbols.where(F.col("file") == file).orderBy("line", "id")

    def sitemap(self) -> DataFrame:
        return metrics.sitemap(self.p.symbols)

    def read(self, path: str, first: int, last: int) -> DataFrame:
        return search.lines(self.p.need("files").where(F.col("path") == path)).where(F.col("line_no").between(first, last)).orderBy("line_no")


class Health(_Facade):
    def heatmap(self) -> DataFrame:
        return metrics.heatmap_file(self.p.symbols)

    def matrix(self) -> DataFrame:
        pair = lambda e: e.select(F.col("src").alias("a"), F.col("dst").alias("b"))
        f = self.p.symbols.select("id", "file")
        calls = self.p.calls.join(f.select(F.col("id").alias("src"), F.col("file").alias("a")), "src").join(f.select(F.col("id").alias("dst"), F.col("file").alias("b")), "dst").select("a", "b")
        return metrics.coupling(pair(self.p.need("imports")), calls)

    def deps(self) -> DataFrame:
        return metrics.instability(self.p.need("imports"))

    def dead(self, max_depth: int | None = None) -> DataFrame:
        s = self.p.symbols.withColumnRenamed("id", "node")
        return graph.dead(self.p.calls, s.select("node"), s.where(tx.is_test_path(F.col("file"))).select("node"), max_depth)

    def patterns(self) -> DataFrame:
        """(id, rule, line_no): anti-patterns and security issues."""
        f = self.p.need("files")
        return quality.anti_patterns(f).unionByName(quality.security(f).select("id", F.col("issue").alias("rule"), "line_no"))

    def unreachable(self) -> DataFrame:
        return quality.unreachable_code(self.p.need("files"))

    def smells(self) -> DataFrame:
        return quality.smells(self.p.need("files"))

    def cycles(self) -> DataFrame:
        return graph.scc(self.p.need("imports"))

    def affected_tests(self, changed: DataFrame, globs: list[str] | None = None) -> DataFrame:
        return graph.affected_tests(self.p.need("imports"), changed, globs)

    def overview(self) -> DataFrame:
        return metrics.stats(self.p.symbols)

    def constraints(self, rules: list[dict]) -> DataFrame:
        return quality.violations(self.p.call_edges(), rules)

    def similarity(self) -> DataFrame:
        return quality.clone_groups(self.p.need("files"))

    def sync(self, old: DataFrame, new: DataFrame) -> DataFrame:
        return sets.sync_diff(old, new)


class Edit(_Facade):
    def safe(self, edit: str) -> DataFrame:
        """(file, downstream, verdict): how risky an edit of each file is, by its dependents, complexity and tests."""
        e = self.p.call_edges().where("caller_file <> callee_file")
        use = e.groupBy(F.col("callee_file").alias("file")).agg(F.count_distinct("caller_file").alias("downstream"), F.count_if(tx.is_test_path(F.col("caller_file"))).alias("tests"))
        out = e.groupBy(F.col("caller_file").alias("file")).agg(F.count_distinct("callee_file").alias("deps"))
        score = quality.complexity_score(F.count("*"), F.avg("complexity"), F.sum("complexity"))
        s = self.p.symbols.groupBy("file").agg(tx.grade(score).alias("grade")).join(use, "file", "left").join(out, "file", "left").na.fill(0)
        init = tx.basename(F.col("file")) == "__init__.py"
        return s.select("file", "downstream", quality.safe_edit(F.col("downstream"), F.col("grade"), F.col("tests"), init, F.lit(edit), F.col("deps")).alias("verdict"))

    def diff(self, old: DataFrame, new: DataFrame) -> DataFrame:
        """Changes of elements between two versions, with the category of each."""
        d = quality.diff(old, new)
        c, p = quality.classify_change(F.col("file"), F.col("kind"), F.col("change"), F.coalesce("new_name", "old_name"), F.lit(""))
        return d.where("change <> 'unchanged'").withColumn("category", c).withColumn("confidence", p)


class Index(_Facade):
    def sync(self, old: DataFrame, new: DataFrame) -> DataFrame:
        return sets.sync_diff(old, new)

    def replace(self, edges: DataFrame, fresh: DataFrame, files: DataFrame) -> DataFrame:
        return sets.replace_edges(edges, fresh, files)

    def audit(self) -> DataFrame:
        return resolve.audit(self.p.call_edges(), self.p.symbols)


class Viz(_Facade):
    def imports(self, direction: str = "LR", max_edges: int = 200) -> str:
        return sinks.mermaid(self.p.need("imports"), direction, max_edges)

    def calls(self, direction: str = "LR", max_edges: int = 200) -> str:
        e = self.p.call_edges().select(F.col("caller_name").alias("src"), F.col("callee_name").alias("dst"))
        return sinks.mermaid(e, direction, max_edges)

    def graph_json(self) -> DataFrame:
        return sinks.graph_json(self.p.symbols.select("id", F.col("name").alias("label")), self.p.calls)
