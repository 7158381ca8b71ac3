"""Revisit records of a web archive, resolved to the latest earlier full response of the same canonical URL.

The as-of join runs over ranges of (URL, date), so that a URL with very many captures spreads over tasks.  Within a
range the latest response is a running value; for URLs that span ranges, each range's last response is carried to
the following ones.  Bodies never travel: a revisit names the response that holds its body.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm.common import checkpoint

#: Headers that a not-modified answer may replace in the stored response; all others stay as stored.
PERMITTED = ["cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary"]


def lower_names(headers: Column) -> Column:
    """Header map with lower-case names; of names that then agree, the last value counts.  Null: empty."""
    named = F.transform(F.map_entries(F.coalesce(headers, F.create_map().cast("map<string,string>"))), lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")))
    last = F.filter(named, lambda e, i: ~F.exists(F.slice(named, i + 2, F.size(named)), lambda x: x["key"] == e["key"]))
    return F.map_from_entries(F.filter(last, lambda e: e["key"].isNotNull()))


def strong(tag: Column) -> Column:
    """An entity tag without the mark of weak validation: revisits compare weakly."""
    return F.regexp_replace(F.trim(tag), "^W/", "")


def resolve(captures: DataFrame) -> DataFrame:
    """One row per revisit: record_id, url_key, date, resolved_id, outcome, headers.

    ``captures``: record_id, url_key (canonical URL), date (any ordered type), kind (``response`` or ``revisit``),
    status, headers (map) and digest (of the body, or null).  A full response is a response with status 200.

    The latest full response strictly before a revisit answers it; of several at one date, the one with the
    largest record_id.  outcome: ``resolved``; ``no_response`` (none before, or a null URL or date);
    ``mismatch`` (both digests known and different, or both entity tags, or, without tags, both last-modified
    dates); ``unvalidated`` (none of these is known on both sides).  resolved_id is set for ``resolved`` only, as
    are merged headers: the response's, with the revisit's permitted ones in their place; otherwise the
    revisit's own.  Repeated revisits are resolved alike; other kinds and further columns are ignored.
    """
    spark = captures.sparkSession
    full = (F.col("kind") == "response") & (F.col("status") == 200)
    slim = captures.where(full | (F.col("kind") == "revisit")).select(
        "record_id", "url_key", "date", full.alias("full"), lower_names(F.col("headers")).alias("headers"), "digest"
    )
    slim = slim.where(~F.col("full") | (F.col("url_key").isNotNull() & F.col("date").isNotNull()))
    # At one date revisits come first, so that only strictly earlier responses stand before them.
    order = ["date", "full", "record_id"]
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = checkpoint(slim.repartitionByRange(n, "url_key", *order).withColumn("range", F.spark_partition_id()))
    answer = F.struct("record_id", "headers", "digest", "date")
    before = Window.partitionBy("range", "url_key").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    filled = ranged.withColumn("prior", F.last(F.when(F.col("full"), answer), ignorenulls=True).over(before))
    # URLs in several ranges are fewer than the ranges; only they need what came before.
    spans = ranged.groupBy("range", "url_key").agg(F.max(F.when(F.col("full"), F.struct(*order))).alias("top"))
    spans = spans.join(spans.groupBy("url_key").agg(F.count("*").alias("ranges")).where("ranges > 1").select("url_key"), "url_key")
    ends = spans.join(
        ranged.where("full").select("range", "url_key", F.struct(*order).alias("top"), answer.alias("end")).dropDuplicates(["range", "url_key", "top"]),
        ["range", "url_key", "top"],
        "left",
    )
    earlier = Window.partitionBy("url_key").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select("range", "url_key", F.last("end", ignorenulls=True).over(earlier).alias("carried"))
    asked = filled.where(~F.col("full")).join(carried, ["range", "url_key"], "left")
    prior = F.when(F.col("url_key").isNotNull() & F.col("date").isNotNull(), F.coalesce("prior", "carried"))
    told = asked.withColumn("prior", prior)

    def both(name: str) -> tuple[Column, Column]:
        a, b = F.col("headers")[name], F.col("prior.headers")[name]
        return (strong(a), strong(b)) if name == "etag" else (F.trim(a), F.trim(b))

    tag, stored_tag = both("etag")
    time, stored_time = both("last-modified")
    has_tag, has_time = tag.isNotNull() & stored_tag.isNotNull(), time.isNotNull() & stored_time.isNotNull()
    has_digest = F.col("digest").isNotNull() & F.col("prior.digest").isNotNull()
    differs = (has_digest & (F.col("digest") != F.col("prior.digest"))) | (has_tag & (tag != stored_tag)) | (~has_tag & has_time & (time != stored_time))
    outcome = (
        F.when(F.col("prior").isNull(), "no_response").when(differs, "mismatch").when(has_digest | has_tag | has_time, "resolved").otherwise("unvalidated")
    )
    permitted = F.map_filter("headers", lambda k, _: k.isin(PERMITTED))
    kept = F.map_filter("prior.headers", lambda k, _: ~F.map_contains_key(permitted, k))
    good = F.col("outcome") == "resolved"
    return told.withColumn("outcome", outcome).select(
        "record_id", "url_key", "date",
        F.when(good, F.col("prior.record_id")).alias("resolved_id"),
        "outcome",
        F.when(good, F.map_concat(kept, permitted)).otherwise(F.col("headers")).alias("headers"),
    )
