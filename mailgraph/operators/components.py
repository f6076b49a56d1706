"""Connected components and the campaigns they stand for."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailgraph.plans import lineage

MAX_ROUNDS = 50


def _signature(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return row[0], row[1]


def _smallest(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, component) for every node on an edge; the component is its smallest node.

    Alternates "large-star" and "small-star" steps (Kiveris et al., 2014): every step links neighbours to a local
    minimum, so rounds grow with the logarithm of the size. Minima are map-side combined; a hub's edges are split by
    AQE in the join. Only an edge count and checksum reach the driver, and each round is checkpointed.
    """
    current = lineage.cut(
        edges.select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v")).filter("u <> v").distinct())
    before = _signature(current)
    for _ in range(MAX_ROUNDS):
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(_smallest(both), "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = _smallest(large)
        small = (
            large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(least.select("u", F.col("m").alias("v")))
            .filter("u <> v").distinct())
        current = lineage.cut(small)
        after = _signature(current)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    return (
        current.select(F.col("u").alias("node"), F.col("v").alias("component"))
        .unionByName(current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()))


def campaign_members(links: DataFrame, message: DataFrame) -> DataFrame:
    """(campaign root, message) with the message's time, from strong links in any src/dst form."""
    parts = connected_components(links)
    return parts.select(F.col("node").alias("msg_id"), F.col("component").alias("root")).join(
        message.select("msg_id", "created", "is_sample"), "msg_id")


def campaign_summary(members: DataFrame) -> DataFrame:
    """Size, time range and id of each campaign of two or more messages.

    The id is one definition for every size: a digest of the member count, the smallest and largest member and the sum of 48-bit digests of the
    members. It does not depend on order, and is combined on the map side, so no member list is gathered.
    """
    mark = F.conv(F.substring(F.sha2(F.col("msg_id").cast("string"), 256), 1, 12), 16, 10).cast("decimal(20,0)")
    return members.groupBy("root").agg(
        F.count(F.lit(1)).alias("count"), F.min("msg_id").alias("lo"), F.max("msg_id").alias("hi"), F.sum(mark).alias("marks"),
        F.min("created").alias("first_seen"), F.max("created").alias("last_seen"), F.bool_and("is_sample").alias("is_sample"),
    ).filter(F.col("count") >= 2).select(
        "root", "count", F.substring(F.sha2(F.concat_ws("|", *[F.col(c).cast("string") for c in ("count", "lo", "hi", "marks")]), 256), 1, 12).alias("campaign_id"),
        "first_seen", "last_seen", "is_sample")
