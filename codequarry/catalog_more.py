"""Registered queries over JSON, frames, cubes and sketches, the query languages' other steps, and streams with their batch twins."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .catalog import _GRADE, _ids, query
from .plans.chain import Engine
from .plans.selector import Compiler
from .sources import fixtures as fx
from .storage import shared_dir
from .streaming import stateful

# -- functions and aggregates ------------------------------------------------


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, json_extract_string(props, '$.none') AS missing FROM events")
def fn_json(spark, d):
    e = fx.table(spark, d, "events")
    return e.select("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"), F.get_json_object("props", "$.none").alias("missing"))


@query("SELECT id, round(lead(total, 2) OVER w, 4) AS ahead, ntile(4) OVER w AS quarter, round(percent_rank() OVER v, 6) AS share, round(sum(total) OVER (w ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 4) AS three, count(*) OVER (PARTITION BY file ORDER BY id RANGE BETWEEN 500 PRECEDING AND CURRENT ROW) AS near FROM health WINDOW w AS (PARTITION BY file ORDER BY ts, id), v AS (PARTITION BY file ORDER BY total)", ("health",))
def win_frames(spark, d):
    w = W.partitionBy("file").orderBy("ts", "id")
    return fx.health(spark, d).select(
        "id", F.round(F.lead("total", 2).over(w), 4).alias("ahead"), F.ntile(4).over(w).alias("quarter"), F.round(F.percent_rank().over(W.partitionBy("file").orderBy("total")), 6).alias("share"),
        F.round(F.sum("total").over(w.rowsBetween(-2, 0)), 4).alias("three"), F.count("*").over(W.partitionBy("file").orderBy("id").rangeBetween(-500, 0)).alias("near"),
    )


@query("SELECT coalesce(language, '*') AS language, coalesce(kind, '*') AS kind, count(*) AS n, CAST(grouping(language) * 2 + grouping(kind) AS BIGINT) AS level FROM symbols GROUP BY CUBE (language, kind)", ("symbols",))
def agg_cube(spark, d):
    g = fx.symbols(spark, d).cube("language", "kind").agg(F.count("*").alias("n"), F.grouping_id().cast("bigint").alias("level"))
    return g.select(F.coalesce("language", F.lit("*")).alias("language"), F.coalesce("kind", F.lit("*")).alias("kind"), "n", "level")


@query("SELECT coalesce(language, '*') AS language, coalesce(kind, '*') AS kind, CAST(sum(complexity) AS BIGINT) AS total FROM symbols GROUP BY ROLLUP (language, kind)", ("symbols",))
def agg_rollup(spark, d):
    g = fx.symbols(spark, d).rollup("language", "kind").agg(F.sum("complexity").alias("total"))
    return g.select(F.coalesce("language", F.lit("*")).alias("language"), F.coalesce("kind", F.lit("*")).alias("kind"), "total")


@query("SELECT language, true AS close_count, true AS close_median FROM symbols GROUP BY 1", ("symbols",))
def agg_approximate(spark, d):
    """Sketches beside exact values: within their error or not."""
    g = fx.symbols(spark, d).groupBy("language").agg(F.approx_count_distinct("id", 0.02).alias("a"), F.count_distinct("id").alias("b"), F.approx_percentile("complexity", 0.5, 1000).alias("m"), F.count("*").alias("n"), F.collect_list("complexity").alias("v"))
    rank = F.size(F.filter("v", lambda x: x < F.col("m"))), F.size(F.filter("v", lambda x: x <= F.col("m")))
    slack = F.col("n") * 0.01 + 1
    return g.select("language", (F.abs(F.col("a") - F.col("b")) <= 0.1 * F.col("b")).alias("close_count"), ((rank[0] <= 0.5 * F.col("n") + slack) & (rank[1] >= 0.5 * F.col("n") - slack)).alias("close_median"))


# -- selectors ---------------------------------------------------------------


def _compiler(spark, d) -> Compiler:
    """Symbols without a line of their own for each copy, and calls, imports and hierarchy edges."""
    s = fx.symbols(spark, d)
    c = fx.call_edges(spark, d)
    calls = c.select(F.lit("calls").alias("kind"), F.col("caller_name").alias("src_name"), F.col("caller_file").alias("src_file"), F.col("callee_name").alias("dst_name"), F.col("callee_file").alias("dst_file"))
    none = F.lit(None).cast("string")
    classes = s.where("kind = 'class'").select("name", "file", "id")
    extends = classes.where("id % 3 = 0").select(F.lit("extends").alias("kind"), F.col("name").alias("src_name"), F.col("file").alias("src_file"), F.reverse("name").alias("dst_name"), none.alias("dst_file"))
    extends = extends.withColumn("dst_name", F.col("src_name"))
    imports = s.where("kind = 'import'").select(F.lit("imports").alias("kind"), F.col("name").alias("src_name"), F.col("file").alias("src_file"), F.concat(F.lit("pkg."), F.replace("name", F.lit(" "), F.lit("."))).alias("dst_name"), none.alias("dst_file"))
    return Compiler(s, calls.unionByName(extends).unionByName(imports))


@query("SELECT DISTINCT name, file, line FROM symbols s WHERE kind IN ('function', 'method') AND EXISTS (SELECT 1 FROM call_edges e WHERE e.callee_name = s.name AND e.callee_file = s.file AND EXISTS (SELECT 1 FROM symbols t WHERE t.kind = 'class' AND t.name = e.caller_name AND t.file = e.caller_file))", ("call_edges",))
def dsl_selector_called_by(spark, d):
    return _compiler(spark, d).select(".function:called-by(.class)").select("name", "file", "line")


@query("SELECT DISTINCT name, file, line FROM symbols s WHERE kind = 'class' AND EXISTS (SELECT 1 FROM symbols t WHERE t.kind = 'class' AND t.id % 3 = 0 AND t.name = s.name AND t.file = s.file)", ("symbols",))
def dsl_selector_extends(spark, d):
    """Classes with a base class; here each names one of its own name somewhere."""
    return _compiler(spark, d).select(".class:extends(.class)").select("name", "file", "line")


@query("SELECT DISTINCT name, file, line FROM symbols s WHERE kind IN ('function', 'method', 'class') AND file IN (SELECT file FROM symbols WHERE kind = 'import' AND list_contains(string_split(name, ' '), 'gear'))", ("symbols",))
def dsl_selector_imports(spark, d):
    return _compiler(spark, d).select("*:imports(gear)").select("name", "file", "line")


@query("SELECT DISTINCT name, file, line FROM symbols s WHERE kind IN ('function', 'method') AND class IS NOT NULL AND class IN (SELECT class FROM symbols t WHERE t.kind IN ('function', 'method') AND t.class IS NOT NULL AND t.language = 'go')", ("symbols",))
def dsl_selector_siblings(spark, d):
    return _compiler(spark, d).select(".method[language=go] ~ .method").select("name", "file", "line")


# -- chains ------------------------------------------------------------------


def _chain(spark, d, text: str) -> DataFrame:
    return Engine(fx.symbols(spark, d), _ids(spark, d)).run(text)


@query("SELECT DISTINCT s.id, s.name FROM symbols s JOIN call_edges e ON e.callee = s.id WHERE e.caller_name = 'red bolt' AND s.language = 'go'", ("call_edges",))
def dsl_chain_callees(spark, d):
    return _chain(spark, d, "search(query='red bolt').callees(depth=1).where(language='go')").select("id", "name")


@query("SELECT DISTINCT s.id, s.name FROM symbols s WHERE s.id IN (SELECT callee FROM call_edges WHERE caller_name = 'red bolt' UNION ALL SELECT caller FROM call_edges WHERE callee_name = 'red bolt')", ("call_edges",))
def dsl_chain_related(spark, d):
    return _chain(spark, d, "search('red bolt').related(depth=1)").select("id", "name")


@query("SELECT s.id, (SELECT count(*) FROM calls WHERE callee = s.id) AS fan_in, (SELECT count(*) FROM calls WHERE caller = s.id) AS fan_out, CASE WHEN s.complexity >= 11 OR t.grade IN ('D', 'F') OR (SELECT count(*) FROM calls WHERE callee = s.id) >= 10 THEN 'review' ELSE 'ok' END AS risk FROM symbols s JOIN (SELECT file, " + _GRADE + " AS grade FROM (SELECT file, CASE WHEN n >= 3 THEN CASE WHEN a <= 5 THEN 100 WHEN a <= 10 THEN 100 - 70 * (a - 5) / 5 WHEN a <= 15 THEN 30 - 25 * (a - 10) / 5 ELSE 5 END ELSE CASE WHEN u <= 15 THEN 100 WHEN u <= 40 THEN 100 - 70.0 * (u - 15) / 25 WHEN u <= 100 THEN 30 - 25.0 * (u - 40) / 60 ELSE 5 END END AS total FROM (SELECT file, count(*) AS n, avg(complexity) AS a, CAST(sum(complexity) AS DOUBLE) AS u FROM symbols GROUP BY 1) x) y) t ON t.file = s.file WHERE s.name = 'red bolt'", ("call_edges",))
def dsl_chain_facets(spark, d):
    return _chain(spark, d, "search('red bolt').include(risk=true, callers=true)").select("id", "fan_in", "fan_out", "risk")


@query("SELECT a.caller AS src, a.callee AS dst FROM call_edges a WHERE a.caller_name IN ('red bolt', 'blue gear') AND a.callee_name IN ('red bolt', 'blue gear')", ("call_edges",))
def dsl_chain_uml(spark, d):
    e = Engine(fx.symbols(spark, d), _ids(spark, d))
    e.run("search(['red bolt', 'blue gear']).uml(direction='TB')")
    return e.facets["uml"].select("src", "dst")


# -- streams -----------------------------------------------------------------


def _events(spark, d) -> DataFrame:
    """The events as a stream of the table's files."""
    schema = fx.table(spark, d, "events").schema
    return spark.readStream.schema(schema).parquet(f"{d}/events.parquet*").withColumn("at", F.col("ts").cast("timestamp"))


def _settled(stream: DataFrame, mode: str = "append") -> DataFrame:
    """What a stream gives by the time its input is used up; batches go to a table in the shared folder."""
    spark = stream.sparkSession
    place = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    schema = stream.schema

    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("append" if mode == "append" else "overwrite").parquet(f"{place}/rows")

    stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", f"{place}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(schema).parquet(f"{place}/rows")


@query("SELECT DISTINCT event_id, event_type FROM events")
def st_distinct(spark, d):
    """Events that arrive twice are passed on once, while their day's watermark lasts."""
    e = _events(spark, d).select("event_id", "event_type", "at")
    twice = e.unionByName(e).withWatermark("at", "3650 days").dropDuplicatesWithinWatermark(["event_id"])
    return _settled(twice.select("event_id", "event_type"))


@query("SELECT event_type, CAST(floor(epoch(ts) / 86400) * 86400 AS BIGINT) AS start, count(*) AS n FROM events GROUP BY 1, 2")
def st_window_stream(spark, d):
    """Counts a day and type, kept up to date as events come."""
    g = _events(spark, d).withWatermark("at", "1 day").groupBy(F.window("at", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n"))
    return _settled(g.select("event_type", F.unix_timestamp("w.start").alias("start"), "n"), "complete")


@query("SELECT id, path, CASE WHEN n % 2 = 0 THEN 'changed' ELSE 'same' END AS status FROM (SELECT doc_id AS id, source || '/' || lang || '/' || doc_id || '.txt' AS path, doc_id AS n FROM documents) x")
def st_sync(spark, d):
    """Files of a stream against a snapshot: each batch is joined to what is known and told apart."""
    known = fx.files(spark, d).select("id", F.md5(F.when(F.col("id") % 2 == 0, F.lit("old")).otherwise(F.col("content")).cast("binary")).alias("known"))
    schema = fx.table(spark, d, "documents").schema
    docs = spark.readStream.schema(schema).parquet(f"{d}/documents.parquet*")
    path = F.concat(F.col("source"), F.lit("/"), F.col("lang"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    new = docs.select(F.col("doc_id").alias("id"), path.alias("path"), F.md5(F.col("text").cast("binary")).alias("digest"))
    return _settled(new.join(known, "id").select("id", "path", F.when(F.col("digest") == F.col("known"), "same").otherwise("changed").alias("status")))


@query(f"+ g AS (SELECT *, {_GRADE} AS grade FROM health), p AS (SELECT *, lag(grade) OVER (PARTITION BY file ORDER BY ts, id) AS previous FROM g), q AS (SELECT *, strpos('ABCDF', grade) AS a, strpos('ABCDF', previous) AS b FROM p) SELECT file, id, previous, grade FROM q WHERE CASE WHEN previous IS NULL THEN a >= 4 ELSE a > b AND (a >= 4 OR b >= 4 OR a - b >= 2) END", ("health",))
def st_alerts(spark, d):
    """Alerts of a stream of readings, a file's last grade being its state."""
    e = _events(spark, d)
    h = e.select(F.col("event_id").alias("id"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("file"), "ts", F.greatest(F.lit(0.0), 100.0 - F.col("value")).alias("total"))
    return _settled(stateful.alert_stream(h, cooldown_s=0)).select("file", "id", "previous", "grade")
