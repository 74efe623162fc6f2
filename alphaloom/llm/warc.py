"""WARC not-modified revisits: each revisit is resolved to the latest earlier full response for its canonical URL.

The as-of join deals slim rows (no payloads) by ranges of (URL, time), cut where the rows are, and carries the last
response forward by a window within (URL, range). Only the URL that a range begins in the middle of inherits a response
from earlier ranges; what it inherits is computed from one row per range. So a URL with a third of all captures takes
many tasks, however its times are spread. Validators are then compared, and the headers that a 304 answer may update are
merged.

Defined results: a response without payload is not full; revisits with a null URL or time have `no_original`; at equal
times a response is not earlier than a revisit; among responses of one time the largest record_id counts; without
comparable validators the status is `no_validator`; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SharedTables

#: Headers that a not-modified answer may update (fixed values, of the HTTP standard).
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")
#: Query parameters that do not select content: fixed values.
TRACKING = r"^(utm_[a-z]+|ref|fbclid|gclid)(=|$)"


def canonical_url(url: Column) -> Column:
    """Host in lower case without www or default port, path without its last slash, sorted parameters; no scheme or fragment."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(url), r"#.*$", ""), r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(bare, r"^([^/?]*)", 1)), r":(80|443)$", ""), r"^www[0-9]*\.", "")
    path = F.regexp_replace(F.regexp_extract(bare, r"^[^/?]*([^?]*)", 1), r"/+$", "")
    query = F.regexp_extract(bare, r"^[^?]*\?(.*)$", 1)
    params = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(TRACKING)))
    tail = F.array_join(params, "&")
    return F.concat(host, F.when(path == "", "/").otherwise(path), F.when(tail == "", "").otherwise(F.concat(F.lit("?"), tail)))


def _weak(etag: Column) -> Column:
    return F.regexp_replace(etag, r"^W/", "")


def resolve_revisits(records: DataFrame) -> DataFrame:
    """record_id, canonical_url, original_id, status, headers, payload_sha256: one row per revisit.

    records: record_id, url, ts (long), kind ('response' or 'revisit'), headers (map with lower-case names), payload_sha256
    (null where a response is not full).
    """
    slim = records.select("record_id", "ts", "kind", "headers", "payload_sha256", canonical_url(F.col("url")).alias("canonical_url"))
    usable = F.col("canonical_url").isNotNull() & F.col("ts").isNotNull()
    full = slim.filter((F.col("kind") == "response") & F.col("payload_sha256").isNotNull() & usable)
    revisits = slim.filter(F.col("kind") == "revisit")
    original = F.struct("ts", "record_id", "headers", "payload_sha256")
    rows = full.select("canonical_url", "ts", F.lit(1).alias("side"), "record_id", original.alias("original"), F.lit(None).cast("map<string,string>").alias("own"))
    rows = rows.unionByName(revisits.filter(usable).select("canonical_url", "ts", F.lit(0).alias("side"), "record_id", F.lit(None).cast(rows.schema["original"].dataType).alias("original"), F.col("headers").alias("own")))
    tables = SharedTables(records.sparkSession, "revisits")
    rows = tables.save(rows)
    rows = tables.save(rows.repartitionByRange("canonical_url", "ts", "side", "record_id").withColumn("part", F.spark_partition_id()))
    upto = Window.partitionBy("canonical_url", "part").orderBy("ts", "side", "record_id").rowsBetween(Window.unboundedPreceding, 0)
    near = rows.withColumn("near", F.last("original", ignorenulls=True).over(upto)).filter("side = 0").select("canonical_url", "part", "record_id", "near", "own")
    # One row per (URL, range): the last response of the range, then of the ranges before. At most one URL a range inherits.
    lasts = rows.groupBy("canonical_url", "part").agg(F.max_by("original", F.when(F.col("side") == 1, F.struct("ts", "record_id"))).alias("last"))
    before = Window.partitionBy("canonical_url").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = lasts.select("canonical_url", "part", F.last("last", ignorenulls=True).over(before).alias("carried")).filter("carried IS NOT NULL")
    met = near.join(F.broadcast(carried), ["canonical_url", "part"], "left").withColumn("original", F.coalesce("near", "carried"))
    lost = revisits.filter(~usable).select("canonical_url", "record_id", F.lit(None).cast(rows.schema["original"].dataType).alias("original"), F.col("headers").alias("own"))
    out = met.select("canonical_url", "record_id", "original", "own").unionByName(lost)
    theirs = F.col("original.headers")
    same_tag, same_date = _weak(F.col("own")["etag"]) == _weak(theirs["etag"]), F.col("own")["last-modified"] == theirs["last-modified"]
    agree = F.coalesce(same_tag, same_date)
    status = F.when(F.col("original").isNull(), "no_original").when(agree, "resolved").when(~agree, "validator_mismatch").otherwise("no_validator")
    updates = F.map_filter("own", lambda k, v: k.isin(*PERMITTED) & v.isNotNull())
    kept = F.map_filter(theirs, lambda k, v: ~F.coalesce(F.map_contains_key(updates, k), F.lit(False)))
    merged = F.map_concat(kept, F.coalesce(updates, F.create_map().cast("map<string,string>")))
    lines = F.array_join(F.transform(F.array_sort(F.map_entries(merged)), lambda e: F.concat_ws(": ", e["key"], e["value"])), "\n")
    good = F.col("status") == "resolved"
    return out.withColumn("status", status).select(
        "record_id", "canonical_url", F.col("original.record_id").alias("original_id"), "status", F.when(good, lines).alias("headers"), F.when(good, F.col("original.payload_sha256")).alias("payload_sha256")
    )


def captures_of_pages(pages: DataFrame, lag: int = 1000) -> DataFrame:
    """Pages as captures: each is fetched at time 2 * page_id, and asked for again `lag` pages later with its validator."""
    digest = F.sha2("html", 256)
    tag = F.concat(F.lit('"'), F.substring(digest, 1, 16), F.lit('"'))
    base = pages.select("page_id", "url", digest.alias("sha"), tag.alias("tag"), F.octet_length("html").cast("string").alias("size"))
    first, later = 2 * F.col("page_id"), 2 * (F.col("page_id") + lag) + 1
    response = base.select(
        first.alias("record_id"), "url", first.alias("ts"), F.lit("response").alias("kind"),
        F.create_map(F.lit("content-length"), "size", F.lit("content-type"), F.lit("text/html"), F.lit("date"), first.cast("string"), F.lit("etag"), "tag").alias("headers"), F.col("sha").alias("payload_sha256"),
    )
    revisit = base.select(
        (2 * F.col("page_id") + 1).alias("record_id"), "url", later.alias("ts"), F.lit("revisit").alias("kind"),
        F.create_map(F.lit("content-length"), F.lit("0"), F.lit("date"), later.cast("string"), F.lit("etag"), "tag").alias("headers"), F.lit(None).cast("string").alias("payload_sha256"),
    )
    return response.unionByName(revisit)
