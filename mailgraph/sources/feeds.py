"""Feed snapshots: loading, validation and the swap to a new version."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mailgraph.functions import hosts
from mailgraph.operators import enrichment as E

FEED_SCHEMA = ("phish_id STRING, url STRING, phish_detail_url STRING, submission_time STRING, verified STRING, verification_time STRING, "
               "online STRING, target STRING, _corrupt_record STRING")


def read_feed(spark: SparkSession, path: str, schema: str = FEED_SCHEMA) -> DataFrame:
    """Feed rows as text columns (bz2 is read natively); the columns come from the file's header by name."""
    return spark.read.schema(schema).option("header", True).option("mode", "PERMISSIVE").option("enforceSchema", False).csv(path)


def snapshot(rows: DataFrame, order: Column) -> DataFrame:
    """(digest, record_id, verified_at): verified and online rows keyed by canonical link, the last row winning."""
    usable = rows.filter((F.col("verified") == "yes") & (F.col("online") == "yes") & F.col("phish_id").rlike("^[0-9]+$"))
    keyed = usable.select(hosts.url_digest(F.col("url")).alias("digest"), order.alias("_o"), F.col("phish_id").alias("record_id"),
                          F.col("verification_time").alias("verified_at")).filter("digest IS NOT NULL")
    return keyed.groupBy("digest").agg(F.max_by(F.struct("record_id", "verified_at"), "_o").alias("r")).select("digest", "r.*")


def quality(entries: DataFrame, meta: DataFrame, as_of: Column, source: str, most: int | None = None) -> DataFrame:
    """One row that says whether a snapshot may be used, and why not. ``meta`` holds (source, fetched_at, source_modified)."""
    counts = entries.agg(
        F.count(F.lit(1)).alias("entries"), F.count_if(~F.col("digest").rlike("^[0-9a-f]{64}$")).alias("bad_digests"),
        F.count_if(~F.col("record_id").rlike("^[0-9]+$")).alias("bad_ids"))
    of = lambda c: meta.select(c).scalar()
    fetched, modified = of("fetched_at"), of("source_modified")
    sane = (fetched > 0) & (fetched <= F.unix_seconds(as_of) + 300) & (modified.isNull() | (modified > 0))
    return counts.select(
        "entries", "bad_digests", "bad_ids", (of("source") == source).alias("source_ok"), F.coalesce(sane, F.lit(False)).alias("time_ok"),
        ((F.col("entries") >= 1) & (F.lit(True) if most is None else F.col("entries") <= most)).alias("size_ok")).withColumn(
        "usable", F.col("source_ok") & F.col("time_ok") & F.col("size_ok") & (F.col("bad_digests") == 0) & (F.col("bad_ids") == 0))


def publish(entries: DataFrame, path: str, version: str) -> str | None:
    """Write a new version folder unless the snapshot is empty; then the previous one stays."""
    if entries.isEmpty():
        return None
    target = f"{path}/version={version}"
    entries.write.mode("error").parquet(target)
    return target


def read_ranges(spark: SparkSession, path: str, feed: str) -> DataFrame:
    """IPv4 ranges of a text list; comments after ``;`` or ``#`` and unusable lines are left out."""
    lines = spark.read.text(path).select(F.lit(feed).alias("feed"), F.trim(F.regexp_replace("value", "[;#].*$", "")).alias("cidr"))
    return E.cidr_ranges(lines.filter("cidr <> ''"))
