"""Revisit records of web archives, resolved to the response they repeat.

A `304 Not Modified` capture holds no body: it stands for the latest earlier full
response of the same canonical URL.  That is an as-of join.  It is computed in one
sort: captures are range-partitioned by (URL, time), each slice finds the last
response before every capture within itself, and a table with one row per slice and
URL carries the last response over slice borders.  A URL with a third of all
captures thus spreads over a third of the slices.

A revisit is resolved if its validator agrees with the response's: the entity tag by
weak comparison, or without one the modification time.  Of its headers only those a
304 may update replace the stored ones.

Records: record_id, url, fetched (number), status, headers (array of name, value).
A full response has status 200.

Nulls and edges: a capture without URL or time refers to nothing (`no response`); a
revisit without validators is `unverified`; disagreeing ones are `changed`.  Captures
of equal time are ordered by record id.  Repeated responses of one id count once, the
one with the larger headers.  Header names are compared in lower case; a null header
list is empty.  Other columns, whatever their names, are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatloom.session import durable

# Headers that a 304 response may update; fixed by the HTTP caching rules.
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")


def canonical(url: Column) -> Column:
    """Host and path without scheme, default port, fragment, tracking parameters and
    closing slash; the host in lower case."""
    bare = F.regexp_replace(F.regexp_replace(url, "#.*$", ""), "^[hH][tT][tT][pP][sS]?://", "")
    host = F.regexp_replace(F.lower(F.regexp_extract(bare, "^([^/?]*)", 1)), ":(80|443)$", "")
    rest = F.regexp_extract(bare, "^[^/?]*(.*)$", 1)
    rest = F.regexp_replace(rest, "&utm_[a-z]+=[^&]*", "")
    rest = F.regexp_replace(F.regexp_replace(rest, "[?]utm_[a-z]+=[^&]*&?", "?"), "[?]$", "")
    return F.concat(host, F.regexp_replace(rest, "/([?]|$)", "$1"))


def _header(name: str) -> Column:
    return F.get(F.filter("headers", lambda h: F.lower(h["name"]) == name), F.lit(0))["value"]


def _tag(tag: Column) -> Column:
    return F.regexp_replace(tag, "^W/", "")


def resolve(records: DataFrame) -> DataFrame:
    """One row per revisit: record_id, url_key, refers_to, verdict, headers (name: value
    lines of the merged response, null unless resolved)."""
    heads = F.coalesce("headers", F.array().cast("array<struct<name:string,value:string>>"))
    records = records.select("record_id", canonical(F.col("url")).alias("url_key"), "fetched", "status", heads.alias("headers"))
    narrow = records.where("url_key is not null and fetched is not null and status in (200, 304)").select(
        "url_key", "fetched", "record_id", "status")
    slices = int(records.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = durable(narrow.repartitionByRange(slices, "url_key", "fetched", "record_id").withColumn("slice", F.spark_partition_id()))
    full = "case when status = 200 then struct(fetched, record_id) end"
    ends = placed.groupBy("url_key", "slice").agg(F.expr(f"max({full}) as latest"))
    carried = ends.selectExpr(
        "url_key", "slice", "max(latest) over (partition by url_key order by slice rows between unbounded preceding and 1 preceding) as carried")
    within = placed.selectExpr(
        "*", f"max({full}) over (partition by slice, url_key order by fetched, record_id rows between unbounded preceding and 1 preceding) as near")
    found = within.where("status = 304").join(carried, ["url_key", "slice"]).selectExpr(
        "record_id", "fetched", "url_key", "coalesce(near, carried).record_id as refers_to").distinct()

    revisits = records.where("status = 304").select("record_id", "url_key", "fetched", F.col("headers").alias("fresh"),
                                                    _header("etag").alias("tag"), _header("last-modified").alias("changed"))
    responses = records.where("status = 200").groupBy(F.col("record_id").alias("refers_to")).agg(F.max("headers").alias("headers"))
    stored = responses.select("refers_to", "headers", _header("etag").alias("stored_tag"), _header("last-modified").alias("stored_changed"))
    joined = revisits.join(found, ["record_id", "url_key", "fetched"], "left").join(stored, "refers_to", "left")
    by_tag = F.col("tag").isNotNull()
    agrees = F.when(by_tag, _tag(F.col("tag")).eqNullSafe(_tag(F.col("stored_tag")))).otherwise(
        F.col("changed").eqNullSafe(F.col("stored_changed")))
    verdict = (
        F.when(F.col("refers_to").isNull(), "no response").when(~by_tag & F.col("changed").isNull(), "unverified")
        .when(agrees, "resolved").otherwise("changed"))
    allowed = F.filter("fresh", lambda h: F.lower(h["name"]).isin(*PERMITTED))
    kept = F.filter("headers", lambda h: ~F.exists("allowed", lambda f: F.lower(f["name"]) == F.lower(h["name"])))
    lines = F.array_sort(F.transform(F.concat(kept, F.col("allowed")), lambda h: F.concat(F.lower(h["name"]), F.lit(": "), h["value"])))
    return joined.withColumn("verdict", verdict).withColumn("allowed", allowed).select(
        "record_id", "url_key", "refers_to", "verdict", F.when(F.col("verdict") == "resolved", F.array_join(lines, "\n")).alias("headers"))
