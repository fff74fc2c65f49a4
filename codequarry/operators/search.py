"""Ranked symbol search, token similarity and content search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import KIND_WEIGHT, is_test_path, is_test_path_canonical, symbol_text, words
from ..storage import cut

K1, B = 1.2, 0.75
#: Weights of a term's column in the ranking.
COLUMN_WEIGHT = {"name": 10.0, "kind": 0.5, "file": 0.5, "language": 0.1}


def kind_weight(kind: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in KIND_WEIGHT.items() for x in kv]), kind), F.lit(0.85))


def query_words(symbols: DataFrame, query: str) -> list[str]:
    row = symbols.sparkSession.range(1).select(F.array_distinct(words(F.lit(query))).alias("w")).collect()[0]
    return sorted(row["w"])


def bm25(symbols: DataFrame, query: str, limit: int | None = None) -> DataFrame:
    """(id, score, rank): BM25 over weighted columns, min-max normalised, times the kind's weight; production code before tests.

    The collection statistics cover all symbols; only rows that hold a query
    word are scored.
    """
    terms = query_words(symbols, query)
    docs = symbols.select("id", "name", "kind", "file", "line", *[words(F.col(c)).alias(f"w_{c}") for c in COLUMN_WEIGHT])
    docs = docs.withColumn("length", sum((F.size(f"w_{c}") for c in COLUMN_WEIGHT), F.lit(0)))

    def occurrences(column: str, term: str) -> Column:
        return F.size(F.filter(column, lambda x: x == term))

    hits = {t: sum((w * occurrences(f"w_{c}", t) for c, w in COLUMN_WEIGHT.items()), F.lit(0.0)) for t in terms}
    # Stored once: statistics, bounds and result read it, and names are cut into words in one pass.
    docs = cut(docs.select("id", "name", "kind", "file", "line", "length", *[h.alias(f"t{i}") for i, h in enumerate(hits.values())]))
    stats = docs.agg(F.count("*").alias("n"), F.avg("length").alias("mean"), *[F.count_if(F.col(f"t{i}") > 0).alias(f"d{i}") for i in range(len(terms))])
    score = F.lit(0.0)
    for i in range(len(terms)):
        idf = F.log1p((F.col("n") - F.col(f"d{i}") + 0.5) / (F.col(f"d{i}") + 0.5))
        score = score + idf * F.col(f"t{i}") * (K1 + 1) / (F.col(f"t{i}") + K1 * (1 - B + B * F.col("length") / F.col("mean")))
    scored = docs.join(F.broadcast(stats)).withColumn("raw", score).where("raw > 0")  # one row of statistics
    bounds = scored.agg(F.min("raw").alias("low"), F.max("raw").alias("high"))
    span = F.col("high") - F.col("low")
    norm = F.when(span > 0, (F.col("raw") - F.col("low")) / span).otherwise(1.0)
    out = scored.join(F.broadcast(bounds)).withColumn("score", F.round(norm * kind_weight(F.col("kind")), 6))
    tier = F.lit(0) if "test" in query.lower() else is_test_path(F.col("file")).cast("int")
    keys = [tier, F.desc("score"), F.col("file"), F.col("line"), F.col("name"), F.col("id")]
    out = out.orderBy(*keys)
    return (out.limit(limit) if limit else out).select("id", "name", "file", "score")


#: What a symbol's kind adds to its score in the cascade.
KIND_BONUS = {"class": 0.08, "function": 0.08, "method": 0.08, "type": 0.06, "constant": 0.04, "variable": 0.03, "import": -0.08}


def normal_symbol(name: Column) -> Column:
    return F.regexp_replace(F.lower(name), "[^a-z0-9]", "")


def cascade(symbols: DataFrame, query: str, limit: int | None = None) -> DataFrame:
    """(id, name, file, tier, score, test): exact, then ranked by words, then substring, then fuzzy matches; the first tier of a symbol counts.

    Fuzzy ones are two edits away at most, without regard to case and marks.
    Rows of one name, file and line are one result.  Every tier scans all
    symbols; ``limit`` comes last, production code before tests.
    """
    query = query.strip()
    q, name = query.lower(), F.lower("name")
    ranked = bm25(symbols, query).select("id", F.col("score").alias("rank"))
    edits = F.levenshtein(normal_symbol(F.col("name")), normal_symbol(F.lit(query)), 2)
    long_enough = len(query) >= 2
    c = symbols.join(ranked, "id", "left").withColumn("edits", edits)
    fits = (F.col("edits") >= 0) & (F.col("edits") <= 2) & F.lit(len(query) >= 3)
    tier = F.when(F.col("name") == query, 0).when(F.col("rank").isNotNull() & long_enough, 1).when(name.contains(q) & long_enough, 2).when(fits, 3)
    base = F.when(F.col("tier") == 0, 0.82).when(F.col("tier") == 1, F.col("rank") * 0.75).when(F.col("tier") == 2, 0.42).otherwise(0.36 - 0.08 * F.col("edits"))
    initials = F.lower(F.regexp_replace("name", "[^\\p{Lu}]", ""))
    bonus = F.when(name == q, 0.16).when(name.startswith(q), 0.12).when(name.contains(q), 0.07).when(initials.startswith(q), 0.05).otherwise(0.0)
    kind = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in KIND_BONUS.items() for x in kv]), F.col("kind")), F.lit(0.0))
    clip = lambda x: F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)), 3)
    c = c.withColumn("tier", tier).where("tier is not null").withColumn("s", clip(base + kind + bonus))
    first = F.row_number().over(W.partitionBy("name", "file", "line").orderBy("tier", "id"))
    c = c.withColumn("k", first).where("k = 1")
    # A file's hits, joined back: one row a file on the right, so a large file stays splittable.
    near = c.groupBy("file").agg(F.count("*").alias("near"))
    out = c.join(near, "file").select("id", "name", "file", "tier", clip(F.col("s") + F.least(F.lit(0.06), 0.02 * (F.col("near") - 1))).alias("score"), is_test_path_canonical(F.col("file")).alias("test"))
    if limit is None:
        return out
    demoted = F.lit(0) if "test" in q else F.col("test").cast("int")
    return out.orderBy(demoted, F.desc("score"), "tier", F.desc("name"), "id").limit(limit)


def fuzzy(symbols: DataFrame, query: str, most: int = 2) -> DataFrame:
    d = F.levenshtein(F.lower("name"), F.lit(query.lower()), most)
    return symbols.select("id", "name", d.alias("distance")).where("distance >= 0")


def vectors(symbols: DataFrame) -> DataFrame:
    """(id, w, c): how often each token is in a symbol's text; rows of one id count as one symbol."""
    return symbols.select("id", F.explode(words(symbol_text())).alias("w")).groupBy("id", "w").agg(F.count("*").alias("c"))


def semantic(symbols: DataFrame, query: str) -> DataFrame:
    """(id, score): cosine of token counts between a symbol's text and the query, positive ones.

    Norm and product come from one pass over a symbol's tokens.
    """
    counts = symbols.sparkSession.range(1).select(F.explode(words(F.lit(query))).alias("w")).groupBy("w").agg(F.count("*").alias("q"))
    qn = counts.agg(F.sqrt(F.sum(F.col("q") * F.col("q"))).alias("qn"))
    t = vectors(symbols).join(F.broadcast(counts), "w", "left")  # the words of one query
    s = t.groupBy("id").agg(F.sqrt(F.sum(F.col("c") * F.col("c"))).alias("norm"), F.sum(F.col("c") * F.col("q")).alias("dot"))
    return s.where("dot > 0").join(F.broadcast(qn)).select("id", F.round(F.col("dot") / (F.col("norm") * F.col("qn")), 4).alias("score")).where("score > 0")


def prefix_terms(symbols: DataFrame, query: str) -> DataFrame:
    """Symbols with a word that starts with the query, or whose name contains it."""
    q = query.lower()
    hit = F.exists(words(F.col("name")), lambda w: w.startswith(q))
    return symbols.where(hit | F.lower("name").contains(q)).select("id", "name", hit.alias("by_word"))


def vector_top_k(vectors: DataFrame, query: list[float], k: int) -> DataFrame:
    """(vec_id, score): the k nearest by cosine."""
    q = F.array(*[F.lit(float(x)) for x in query])
    dot = F.aggregate(F.zip_with("embedding", q, lambda a, b: a.cast("double") * b), F.lit(0.0), lambda a, x: a + x)
    norm = lambda e: F.sqrt(F.aggregate(e, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return vectors.select("vec_id", F.round(dot / (norm(F.col("embedding")) * norm(q)), 6).alias("score")).orderBy(F.desc("score"), "vec_id").limit(k)


def lines(files: DataFrame) -> DataFrame:
    """(id, path, line_no, line): one row a line, from 1."""
    return files.select("id", "path", F.posexplode(F.split("content", "\n")).alias("n", "line")).select("id", "path", (F.col("n") + 1).alias("line_no"), "line")


def pattern_column(line: Column, pattern: str, *, fixed: bool = False, case: str = "sensitive", word: bool = False) -> Column:
    import re

    body = re.escape(pattern) if fixed else pattern
    if word:
        body = rf"\b(?:{body})\b"
    insensitive = case == "insensitive" or (case == "smart" and pattern == pattern.lower())
    return line.rlike(("(?i)" if insensitive else "") + body)


def content(files: DataFrame, pattern: str, *, mode: str = "rows", invert: bool = False, context: int = 0, max_count: int | None = None, include: Column | None = None, **match) -> DataFrame:
    """Content search.  Modes: rows, per_file, files, files_without, total.

    A file is filtered before its lines are split; ``context`` adds the lines around a match.
    """
    f = files.where(include) if include is not None else files
    ll = lines(f)
    hit = pattern_column(F.col("line"), pattern, **match)
    ll = ll.withColumn("hit", ~hit if invert else hit)
    if mode == "rows":
        if context:
            w = W.partitionBy("id").orderBy("line_no").rowsBetween(-context, context)
            return ll.withColumn("near", F.max("hit").over(w)).where("near").select("id", "path", "line_no", "line", "hit")
        found = ll.where("hit")
        if max_count:
            found = found.withColumn("k", F.row_number().over(W.partitionBy("id").orderBy("line_no"))).where(F.col("k") <= max_count)
        return found.select("id", "path", "line_no", "line")
    if mode == "files_without":
        return ll.groupBy("id", "path").agg(F.max("hit").alias("any")).where("not any").select("id", "path")
    found = ll.where("hit")
    if mode == "per_file":
        return found.groupBy("id", "path").agg(F.count("*").alias("matches"))
    if mode == "files":
        return found.select("id", "path").distinct()
    if mode == "total":
        return found.agg(F.count("*").alias("matches"), F.countDistinct("id").alias("files"))
    raise ValueError(f"unknown mode {mode!r}")


def batch(files: DataFrame, patterns: list[str]) -> DataFrame:
    """(pattern, matches, files) of several patterns in one scan of the lines."""
    if not patterns:
        raise ValueError("no pattern")
    flags = F.array(*[F.struct(F.lit(p).alias("pattern"), F.col("line").rlike(p).alias("hit")) for p in patterns])
    e = lines(files).select("id", F.explode(flags).alias("x"))
    return e.groupBy(F.col("x.pattern").alias("pattern")).agg(F.count_if("x.hit").alias("matches"), F.countDistinct(F.when(F.col("x.hit"), F.col("id"))).alias("files"))


def places(rows: DataFrame, keys: list[Column]) -> DataFrame:
    """``rows`` with each one's ``place`` in the order of ``keys``, from 1.

    Ranges of the keys are sorted apart; a range begins behind the rows of those before it.
    """
    ranges = cut(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("at_", F.monotonically_increasing_id()))
    range_, at = F.shiftright("at_", 33), F.col("at_").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = sorted(map(tuple, ranges.groupBy(range_.alias("range_")).agg(F.count("*").alias("n")).collect()))
    before, starts = 0, []
    for k, n in sizes:
        starts.append((k, before))
        before += n
    starts = ranges.sparkSession.createDataFrame(starts, "range_ bigint, before_ bigint")
    return ranges.withColumn("range_", range_).join(F.broadcast(starts), "range_").withColumn("place", at + F.col("before_") + 1).drop("range_", "before_", "at_")
