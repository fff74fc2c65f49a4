"""Extraction from files: HTML links and outlines, Python symbols, history, coverage and rule files, filter expressions."""

from __future__ import annotations

import ast
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import wildcard_regex

#: Directories that a source walk leaves out.
EXCLUDED = [".git", "node_modules", "__pycache__", ".venv", "dist", "build", "target"]


def walk(spark: SparkSession, root: str, extensions: list[str]) -> DataFrame:
    """(path, size, modified, content, digest) of the source files below ``root``."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    f = f.where(F.lower(F.regexp_extract("path", "[.]([^./]+)$", 1)).isin([e.lower().lstrip(".") for e in extensions]))
    f = f.where(~F.col("path").rlike("/(" + "|".join(map(re.escape, EXCLUDED)) + ")/"))
    return f.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"), F.decode("content", "UTF-8").alias("content"), F.sha2("content", 256).alias("digest"))


def links(pages: DataFrame) -> DataFrame:
    """(page_id, href) of every anchor, in order."""
    return pages.select("page_id", F.explode(F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), 1)).alias("href"))


def html_outline(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", F.regexp_count("html", F.lit("<[a-z][a-z0-9]*")).cast("bigint").alias("tags"), F.regexp_count("html", F.lit("<p>")).cast("bigint").alias("paragraphs"))


def python_rows(file: str, content: str) -> list[dict]:
    """Symbols of one module; a module that can't be parsed is one row of kind ``parse_failed``."""
    try:
        module = ast.parse(content or "")
    except (SyntaxError, ValueError):
        return [{"file": file, "kind": "parse_failed", "name": "", "class": None, "line": 0, "end_line": 0, "complexity": 0, "params": 0, "calls": []}]
    out: list[dict] = []
    branches = (ast.If, ast.For, ast.While, ast.ExceptHandler, ast.BoolOp, ast.IfExp, ast.comprehension)

    def visit(node: ast.AST, owner: str | None) -> None:
        for n in ast.iter_child_nodes(node):
            if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef)):
                inner = list(ast.walk(n))
                called = sorted({getattr(c.func, "id", getattr(c.func, "attr", "")) for c in inner if isinstance(c, ast.Call)} - {""})
                out.append({"file": file, "kind": "method" if owner else "function", "name": n.name, "class": owner, "line": n.lineno, "end_line": n.end_lineno, "complexity": 1 + sum(isinstance(x, branches) for x in inner), "params": len(n.args.args), "calls": called})
                visit(n, None)
            elif isinstance(n, ast.ClassDef):
                out.append({"file": file, "kind": "class", "name": n.name, "class": None, "line": n.lineno, "end_line": n.end_lineno, "complexity": 0, "params": 0, "calls": [b.id for b in n.bases if isinstance(b, ast.Name)]})
                visit(n, n.name)
            elif isinstance(n, (ast.Import, ast.ImportFrom)):
                base = getattr(n, "module", None)
                for a in n.names:
                    out.append({"file": file, "kind": "import", "name": a.asname or a.name, "class": base, "line": n.lineno, "end_line": n.end_lineno, "complexity": 0, "params": 0, "calls": []})
            else:
                visit(n, owner)

    visit(module, None)
    return out


def python_symbols(files: DataFrame) -> DataFrame:
    """Symbols, imports and called names of Python modules (file, content)."""
    schema = "file string, kind string, name string, class string, line bigint, end_line bigint, complexity bigint, params bigint, calls array<string>"
    arrow = pa.schema([("file", pa.string()), ("kind", pa.string()), ("name", pa.string()), ("class", pa.string()), ("line", pa.int64()), ("end_line", pa.int64()), ("complexity", pa.int64()), ("params", pa.int64()), ("calls", pa.list_(pa.string()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [r for f, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for r in python_rows(f, c)]
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return files.select("file", "content").mapInArrow(run, schema)


def filter_results(rows: DataFrame, expression: str) -> DataFrame:
    """Conditions ``key=value`` (equal) and ``key=~pattern`` (wildcards, any case), joined by commas; others are refused."""
    out = rows
    for part in filter(None, map(str.strip, expression.split(","))):
        m = re.fullmatch(r"(\w+)\s*(=~|=)\s*(.*)", part)
        if not m or m[1] not in rows.columns:
            raise ValueError(f"not a condition: {part!r}")
        c = F.col(m[1]).cast("string")
        out = out.where(c.rlike(wildcard_regex(m[3])) if m[2] == "=~" else c == m[3])
    return out


def git_log(text: str) -> list[dict]:
    """Commits of ``git log --name-only --format='commit %H %ct'``: sha, epoch, files."""
    out: list[dict] = []
    for line in text.splitlines():
        if m := re.fullmatch(r"commit ([0-9a-f]{7,40}) (\d+)", line):
            out.append({"sha": m[1], "epoch": int(m[2]), "files": []})
        elif line.strip() and out:
            out[-1]["files"].append(line.strip())
    return out


def coverage_lines(text: str) -> list[tuple[str, int]]:
    """(file, executed line) pairs of a coverage report in JSON."""
    return [(f, n) for f, d in sorted(json.loads(text).get("files", {}).items()) for n in d.get("executed_lines", [])]


def rules(text: str) -> list[dict]:
    """Constraint rules of a YAML file in its plain form: a list of flat mappings under ``constraints``."""
    out: list[dict] = []
    key = None
    for raw in text.splitlines():
        line = raw.split(" #")[0].rstrip()
        if not line.strip() or line.lstrip().startswith("#"):
            continue
        body = line.strip()
        if not raw.startswith((" ", "-")):
            name = body.split(":")[0]
            if name not in ("version", "constraints"):
                raise ValueError(f"unknown key {name!r}")
            continue
        if body.startswith("- ") and ":" in body and not (key == "exceptions" and len(raw) - len(raw.lstrip()) > 4):
            out.append({})
            body, key = body[2:], None
        if body.startswith("- ") and key:
            out[-1].setdefault(key, []).append(body[2:].strip().strip("\"'"))
            continue
        if ":" not in body or not out:
            raise ValueError(f"can't read {raw!r}")
        key, _, value = body.partition(":")
        key, value = key.strip(), value.strip().strip("\"'")
        if value:
            out[-1][key] = value
    for r in out:
        if missing := {"id", "from", "to"} - set(r):
            raise ValueError(f"rule without {sorted(missing)}")
    return out
