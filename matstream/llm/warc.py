"""Operator 9: resolve not-modified revisits (DataFrame functions only).

A record is a full response or a revisit (a 304 answer without a body). A
revisit refers to the latest earlier full response of the same canonical URL. It
is accepted if a validator agrees: the ETag when both have one (weak comparison,
without the W/ mark), else Last-Modified. The resolved record has the response's
payload and its headers, updated by those header fields that a 304 may carry.

The as-of join orders records by (URL, time, revisits last, id) in range partitions, so
a URL with a third of all records is spread over many tasks. Within a partition
the last response is carried forward; the last response of each URL and
partition, one small row each, is carried over to the partitions after it.

Defined cases: records with a null URL or time are unresolved; at equal times a
full response counts as earlier than a revisit, the larger id being later; no
earlier response gives status ``orphan``, none or differing validators
``no_validator`` and ``mismatch``; repeated rows each get their row; a null kind is a response;
extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matstream.llm.common import materialise

#: query parameters that don't select content (fixed values)
TRACKING = ("utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "ref", "fbclid", "gclid")
#: header fields a 304 response may update (fixed values)
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")


def canonical_url(url: Column) -> Column:
    """Scheme, www. or m. host prefix, port 80/443, fragment, tracking parameters and a closing slash go; host lower-cased."""
    u = F.regexp_replace(F.trim(url), r"#.*$", "")
    u = F.regexp_replace(u, r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.lower(F.regexp_extract(u, r"^([^/?]*)", 1))
    host = F.regexp_replace(F.regexp_replace(host, r":(?:80|443)$", ""), r"^(?:www|m)\.", "")
    rest = F.regexp_replace(u, r"^[^/?]*", "")
    path = F.regexp_replace(F.regexp_extract(rest, r"^([^?]*)", 1), r"/+$", "")
    query = F.regexp_extract(rest, r"\?(.*)$", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.split(p, "=")[0].isin(*TRACKING)))
    return F.concat(host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(F.lit("")))


def _header(headers: Column, name: str) -> Column:
    return F.get(F.map_values(F.map_filter(headers, lambda k, _: F.lower(k) == name)), F.lit(0))


def _weak(tag: Column) -> Column:
    return F.regexp_replace(tag, "^W/", "")


def resolve_revisits(records: DataFrame, partitions: int | None = None) -> DataFrame:
    """``records(record_id, url, time, kind, headers, payload)`` -> every record with

    ``canonical, refers_to, status, headers, payload``; kind is ``response`` or ``revisit``, headers a
    map of strings, payload any reference to the body (a digest or key; bodies don't move).
    """
    n = partitions or int(records.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    r = records.select("record_id", "url", "time", "kind", "headers", "payload",
                       canonical_url(F.col("url")).alias("canonical"))
    is_revisit = F.coalesce(F.col("kind") == "revisit", F.lit(False))
    r = r.withColumn("late", is_revisit.cast("int"))
    r = r.repartitionByRange(n, "canonical", "time", "late", "record_id").withColumn("part", F.spark_partition_id())
    r = materialise(r, "warc-range")
    full = F.when(~is_revisit, F.struct("record_id", "headers", "payload", "time"))
    order = Window.partitionBy("part", "canonical").orderBy("time", "late", "record_id").rowsBetween(
        Window.unboundedPreceding, -1)
    near = r.withColumn("prior", F.last(full, ignorenulls=True).over(order))
    # the last response of a URL in each partition, carried to later partitions
    ends = r.where(F.col("canonical").isNotNull() & F.col("time").isNotNull()).groupBy("canonical", "part").agg(
        F.max(F.when(~is_revisit, F.struct("time", "late", "record_id"))).alias("last"))
    before = Window.partitionBy("canonical").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.withColumn("carry", F.last("last", ignorenulls=True).over(before)).where(F.col("carry").isNotNull())
    carried = carried.select("canonical", "part", F.col("carry.record_id").alias("carry_id"), F.col("carry.time").alias("carry_time"))
    known = r.where(~is_revisit).select(
        F.col("canonical").alias("_c"), F.col("record_id").alias("_id"), F.col("time").alias("_t"),
        F.struct("record_id", "headers", "payload", "time").alias("carried")).dropDuplicates(["_c", "_id", "_t"])
    carried = carried.join(known, (F.col("canonical") == F.col("_c")) & F.col("carry_id").eqNullSafe(F.col("_id"))
                           & (F.col("carry_time") == F.col("_t"))).select("canonical", "part", "carried")
    carried = materialise(carried, "warc-carry")
    j = near.join(carried, ["canonical", "part"], "left").withColumn("prior", F.coalesce("prior", "carried"))
    usable = is_revisit & F.col("canonical").isNotNull() & F.col("time").isNotNull()
    prior = F.when(usable, F.col("prior"))
    own_tag, old_tag = _weak(_header(F.col("headers"), "etag")), _weak(_header(prior["headers"], "etag"))
    own_date, old_date = _header(F.col("headers"), "last-modified"), _header(prior["headers"], "last-modified")
    same = F.when(own_tag.isNotNull() & old_tag.isNotNull(), own_tag == old_tag).otherwise(own_date == old_date)
    status = (F.when(~is_revisit, F.lit("full")).when(prior.isNull(), F.lit("orphan"))
              .when(same.isNull(), F.lit("no_validator")).when(same, F.lit("resolved")).otherwise(F.lit("mismatch")))
    j = j.withColumn("_prior", prior).withColumn("status", status)
    done = F.col("status") == "resolved"
    update = F.map_filter("headers", lambda k, _: F.lower(k).isin(*PERMITTED))
    names = F.transform(F.map_keys(update), lambda k: F.lower(k))
    stays = F.map_filter(F.col("_prior.headers"), lambda k, _: ~F.array_contains(names, F.lower(k)))
    return j.select(
        "record_id", "url", "time", "kind", "canonical", "status",
        F.when(done, F.col("_prior.record_id")).alias("refers_to"),
        F.when(done, F.map_concat(stays, update)).otherwise(F.col("headers")).alias("headers"),
        F.when(done, F.col("_prior.payload")).otherwise(F.col("payload")).alias("payload"))
