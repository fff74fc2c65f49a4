"""Sinks and renderings of results."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def full_line() -> Column:
    """One readable line of a symbol."""
    owner = F.when(F.col("class").isNotNull(), F.concat(F.lit(" in "), "class")).otherwise("")
    return F.concat("kind", F.lit(" "), "name", owner, F.lit(" ("), "file", F.lit(":"), "line", F.lit("-"), "end_line", F.lit(")"))


def compact_line() -> Column:
    return F.concat(F.substring("kind", 1, 1), F.lit(" "), "name", F.lit("@"), "line")


def toon(rows: Iterable[dict], name: str = "rows") -> str:
    """A table in the tabular notation: one header with the union of the keys, one line a row."""
    rows = list(rows)
    keys = list(dict.fromkeys(k for r in rows for k in r))

    def cell(v) -> str:
        if v is None:
            return "null"
        if isinstance(v, bool):
            return str(v).lower()
        s = str(v)
        return '"' + s.replace('"', '\\"').replace("\n", "\\n") + '"' if any(c in s for c in ',"\n:') or s != s.strip() or not s else s

    return "\n".join([f"{name}[{len(rows)}]{{{','.join(keys)}}}:", *("  " + ",".join(cell(r.get(k)) for k in keys) for r in rows)])


def mermaid(edges: DataFrame, direction: str = "LR", max_edges: int = 200) -> str:
    """A flow chart of the first ``max_edges`` edges in order of their ends."""
    rows = edges.select("src", "dst").distinct().orderBy("src", "dst").limit(max_edges).collect()
    names = {n: f"n{i}" for i, n in enumerate(dict.fromkeys(x for r in rows for x in r))}
    return "\n".join([f"flowchart {direction}", *(f'  {names[r.src]}["{r.src}"] --> {names[r.dst]}["{r.dst}"]' for r in rows)])


def graph_json(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes and edges as JSON lines, to be written by ``df.write.text``: nothing is gathered in one row."""
    n = nodes.select(F.to_json(F.struct(F.lit("node").alias("type"), *nodes.columns)).alias("value"))
    return n.unionByName(edges.select(F.to_json(F.struct(F.lit("edge").alias("type"), *edges.columns)).alias("value")))


def decoded(column: Column, encodings: tuple[str, ...] = ("UTF-8", "UTF-16", "ISO-8859-1")) -> Column:
    """Text of bytes by the first encoding that fits: the mark of UTF-16, valid UTF-8, else Latin-1."""
    marked = F.hex(F.substring(column, 1, 2)).isin("FFFE", "FEFF")
    utf8 = F.is_valid_utf8(column.cast("string"))
    return F.when(marked, F.decode(column, encodings[1])).when(utf8, F.decode(column, encodings[0])).otherwise(F.decode(column, encodings[2]))
