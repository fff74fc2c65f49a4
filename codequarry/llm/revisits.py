"""WARC: resolution of not-modified revisits.

A ``revisit`` record with the server-not-modified profile has no body: it stands
for the latest earlier full response of the same canonical URL, provided the
validators agree.  The resolved record takes the response's payload and headers,
replaced by those of the revisit that a 304 may carry.

Input columns: record_id, warc_type, target_uri, warc_date (timestamp),
http_status, headers (map of lower-case name to value), payload_digest,
n_bytes.  Results by case: a revisit without an earlier response is
``no_response``; with a URL or a date that is null it is ``no_key``; with an
ETag, Last-Modified or payload digest unlike the response's it is
``validator_mismatch``; else ``resolved``.  Responses of one URL and instant count as
one, the largest record_id.  Revisits at the very instant of a response do not
see it.  Repeated rows are resolved alike; of responses with one record_id the
one with the largest digest, size, status and headers counts.  Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: The header fields that a 304 response may update (RFC 9111, RFC 9110).
PERMITTED = ["cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary", "age", "warning", "set-cookie"]
#: Query parameters that name a campaign and not a resource.
TRACKING = ["utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "gclid", "fbclid"]
#: Width of the time bins, in seconds: a URL and bin hold at most so many instants of WARC dates, which have whole seconds.
BIN = 3600


def canonical_url(url) -> F.Column:
    """Scheme dropped; host lower-cased without ``www.`` and default port; fragment and tracking parameters dropped; no trailing slash.

    Null stays null.
    """
    u = F.regexp_replace(F.trim(url.cast("string")), "#.*$", "")
    u = F.regexp_replace(u, "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(u, "^[^/?]*", 0)), "^www[.]", ""), ":(80|443)$", "")
    rest = F.regexp_replace(u, "^[^/?]*", "")
    path = F.regexp_replace(F.regexp_extract(rest, "^[^?]*", 0), "/+$", "")
    query = F.regexp_replace(rest, "^[^?]*[?]?", "")
    query = F.regexp_replace(F.concat(F.lit("&"), query), "&(" + "|".join(TRACKING) + ")=[^&]*", "")
    query = F.regexp_replace(query, "^&+", "")
    return F.concat(host, path, F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)))


def resolve(records: DataFrame) -> DataFrame:
    """One row per revisit: record_id, canonical_url, warc_date, status, response_id, response_date, http_status, headers, payload_digest, n_bytes.

    An as-of join in two steps: the last earlier response inside the revisit's
    time bin, else the last one of an earlier bin.  Both sides are reduced to
    one row per URL and instant first, so that a URL with a third of all
    records leaves small groups; the records come back by equality joins, which
    Spark splits where they are uneven.
    """
    r = records.select("record_id", "warc_type", canonical_url(F.col("target_uri")).alias("canonical_url"), F.col("warc_date").cast("timestamp").alias("warc_date"), "http_status", "headers", "payload_digest", "n_bytes")
    is_response = (F.col("warc_type") == "response") & (F.col("http_status") == 200)
    keys = r.where(F.col("canonical_url").isNotNull() & F.col("warc_date").isNotNull() & (is_response | (F.col("warc_type") == "revisit")))
    instants = keys.groupBy("canonical_url", "warc_date").agg(F.max(F.when(is_response, F.col("record_id"))).alias("response_id"), F.max((F.col("warc_type") == "revisit").cast("int")).alias("asked"))
    instants = instants.withColumn("bin", F.floor(F.unix_timestamp("warc_date") / BIN))
    full = F.when(F.col("response_id").isNotNull(), F.struct("warc_date", "response_id"))
    bins = instants.groupBy("canonical_url", "bin").agg(F.max(full).alias("last"))
    earlier = W.partitionBy("canonical_url").orderBy("bin").rowsBetween(W.unboundedPreceding, -1)
    bins = bins.select("canonical_url", "bin", F.last("last", ignorenulls=True).over(earlier).alias("carried"))
    inside = W.partitionBy("canonical_url", "bin").orderBy("warc_date").rowsBetween(W.unboundedPreceding, -1)
    seen = instants.withColumn("near", F.last(full, ignorenulls=True).over(inside)).where("asked = 1")
    found = seen.join(bins, ["canonical_url", "bin"]).select("canonical_url", "warc_date", F.coalesce("near", "carried").alias("hit")).where("hit is not null")
    found = found.select("canonical_url", "warc_date", F.col("hit.response_id").alias("response_id"), F.col("hit.warc_date").alias("response_date"))
    revisits = r.where("warc_type = 'revisit'").join(found, ["canonical_url", "warc_date"], "left")
    wanted = r.where(is_response).select(F.col("record_id").alias("response_id"), F.col("headers").alias("full_headers"), F.col("payload_digest").alias("full_digest"), F.col("n_bytes").alias("full_bytes"), F.col("http_status").alias("full_status"))
    # Responses that share a record_id: the one with the largest digest, then size, then headers counts.
    rest = F.struct("full_headers", "full_digest", "full_bytes", "full_status")
    rank = F.struct("full_digest", "full_bytes", "full_status", F.to_json("full_headers"))
    wanted = wanted.groupBy("response_id").agg(F.max_by(rest, rank).alias("r")).select("response_id", "r.*")
    j = revisits.join(wanted, "response_id", "left")

    def differs(name: str) -> F.Column:
        return F.coalesce(F.col("headers")[name] != F.col("full_headers")[name], F.lit(False))

    off = differs("etag") | differs("last-modified") | F.coalesce(F.col("payload_digest") != F.col("full_digest"), F.lit(False))
    status = (
        F.when(F.col("canonical_url").isNull() | F.col("warc_date").isNull(), "no_key")
        .when(F.col("response_id").isNull(), "no_response")
        .when(off, "validator_mismatch")
        .otherwise("resolved")
    )
    j = j.withColumn("status", status)
    ok = F.col("status") == "resolved"
    fresh = F.map_filter(F.coalesce("headers", F.create_map().cast("map<string,string>")), lambda k, v: k.isin(PERMITTED))
    old = F.coalesce("full_headers", F.create_map().cast("map<string,string>"))
    merged = F.map_concat(F.map_filter(old, lambda k, v: ~F.array_contains(F.map_keys(fresh), k)), fresh)
    return j.select(
        "record_id", "canonical_url", "warc_date", "status", "response_id", "response_date",
        F.when(ok, F.col("full_status")).otherwise(F.col("http_status")).alias("http_status"),
        F.when(ok, merged).otherwise(F.col("headers")).alias("headers"),
        F.when(ok, F.col("full_digest")).otherwise(F.col("payload_digest")).alias("payload_digest"),
        F.when(ok, F.col("full_bytes")).alias("n_bytes"),
    )
