"""Indicators of messages: extraction, sharing, history and the evidence graph."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailgraph.functions import hosts
from mailgraph.plans import lineage, skew

# Indicator kinds, those strong enough to group messages, and those whose history is tracked.
KINDS = ("sender_address", "sender_domain", "reported_ip", "url", "attachment_hash", "reply_address", "thread_id")
STRONG = ("reply_address", "attachment_hash", "url", "thread_id")
TRACKED = ("sender_domain", "sender_address", "reported_ip", "url", "attachment_hash", "reply_address")
THREAD_ID = "<[^<> \\t\\r\\n]{1,250}>"
PER_CASE = 50
PAIRS_A_PART = 1 << 20  # pairs of messages by shared value that one task holds, about


def extract(message: DataFrame, hop: DataFrame, url: DataFrame, attachment: DataFrame) -> DataFrame:
    """Distinct (msg_id, kind, value). One row per message carries its address indicators as an array, so the message
    table is scanned once; child tables add theirs."""
    pair = lambda kind, value: F.struct(F.lit(kind).alias("kind"), value.alias("value"))
    ids = lambda column: F.regexp_extract_all(F.coalesce(F.col(column), F.lit("")), F.lit(THREAD_ID), F.lit(0))
    threads = F.transform(F.array_distinct(F.concat(ids("message_id"), ids("in_reply_to"))), lambda v: pair("thread_id", v))
    sender, domain = hosts.address(F.col("sender")), hosts.domain(F.col("sender"))
    known = F.array(
        pair("reply_address", hosts.address(F.col("reply_to"))),
        pair("sender_address", F.when(sender.contains("@"), sender)),
        pair("sender_domain", F.when(domain != "", hosts.registrable(domain))))
    from_message = message.select("msg_id", F.explode(F.concat(known, threads)).alias("i")).select("msg_id", "i.*")
    return (
        from_message
        .unionByName(attachment.select("msg_id", F.lit("attachment_hash").alias("kind"), F.col("sha256").alias("value")))
        .unionByName(url.select("msg_id", F.lit("url").alias("kind"), F.col("url").alias("value")))
        .unionByName(hop.filter(hosts.is_public_ip(F.col("ip")))
                     .select("msg_id", F.lit("reported_ip").alias("kind"), F.col("ip").alias("value")))
        .filter(F.col("value").isNotNull() & (F.col("value") != ""))
        .distinct()
    )


def tracked(indicators: DataFrame, per_case: int = PER_CASE) -> DataFrame:
    """Tracked kinds, the first ``per_case`` of each message in (kind, value) order."""
    kept = indicators.filter(F.col("kind").isin(*TRACKED))
    return skew.top_k(kept, ["msg_id"], [F.col("kind"), F.col("value")], per_case, "rank")


def group_sizes(occurrence: DataFrame) -> DataFrame:
    """Per (kind, value, is_sample): messages, distinct raw hashes and the pairs they imply.

    A pair counts when its raw hashes differ. Sizes come from two map-side combined aggregations; no pair is formed.
    """
    per_hash = occurrence.groupBy("kind", "value", "is_sample", "raw_hash").agg(
        F.count(F.lit(1)).alias("n"), F.min("msg_id").alias("lo"), F.min("created").alias("t0"), F.max("created").alias("t1"))
    return per_hash.groupBy("kind", "value", "is_sample").agg(
        F.sum("n").alias("messages"), F.count(F.lit(1)).alias("hashes"), F.min("lo").alias("hub"),
        F.expr("CAST((sum(n) * sum(n) - sum(n * n)) / 2 AS BIGINT)").alias("pairs"),
        F.min("t0").alias("first_seen"), F.max("t1").alias("last_seen"))


def occurrences(indicators: DataFrame, message: DataFrame) -> DataFrame:
    return indicators.join(message.select("msg_id", "created", "raw_hash", "is_sample", "session_id"), "msg_id")


def shared(occurrence: DataFrame) -> DataFrame:
    """Indicators that link at least two messages with different raw hashes."""
    return group_sizes(occurrence).filter(F.col("hashes") > 1)


def links(occurrence: DataFrame) -> DataFrame:
    """The shared-indicator relation in linear size: each member points at the hub of its indicator.

    Members of one indicator with differing hashes are all pairwise linked (a complete multipartite graph), so
    (hub, member, raw_hash) states every pair without listing it, and has the same connected components.
    """
    keys = ["kind", "value", "is_sample"]
    return (
        occurrence.join(shared(occurrence).select(*keys, "hub"), keys)
        .select("msg_id", "hub", "kind", "value", "raw_hash", "is_sample",
                F.when(F.col("kind").isin(*STRONG), "candidate").otherwise("context_only").alias("strength")))


def neighbours(occurrence: DataFrame, chosen: DataFrame) -> DataFrame:
    """All linked messages of the chosen ones with the shared evidence: chosen rows times group size, never a square.

    Near and far ends are dealt to a grid of parts of about ``PAIRS_A_PART`` pairs, by id: all evidence of a pair meets where it is found, so no pair is
    shuffled, and a value that many messages share is spread over all parts. Near ends are copied to each column of the grid, far ends to each row.
    """
    keys = ["kind", "value", "is_sample"]
    known = lineage.cut(occurrence.select(*keys, "msg_id", "raw_hash"))
    a = lineage.cut(known.join(chosen.select("msg_id"), "msg_id", "left_semi").select(*keys, F.col("msg_id").alias("src"), F.col("raw_hash").alias("ha")))
    size = lambda side, name: side.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))
    sizes = size(known, "n").join(size(a, "m"), keys).agg(F.sum(F.col("n") * F.col("m")), F.sum("n"), F.sum("m")).first()
    pairs, far_rows, near_rows = (x or 1 for x in sizes)
    columns = min(-(-pairs // PAIRS_A_PART), math.ceil(math.sqrt(pairs / PAIRS_A_PART * far_rows / near_rows)))
    rows = -(-pairs // (PAIRS_A_PART * columns))
    spread = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    deal = lambda end, n: F.pmod(F.xxhash64(end), F.lit(n))
    part = (F.col("_row") * columns + F.col("_column")).alias("part")
    near = a.select("*", deal("src", rows).alias("_row"), spread(columns).alias("_column")).select(*a.columns, part)
    b = known.select(*keys, F.col("msg_id").alias("dst"), F.col("raw_hash").alias("hb"), deal("msg_id", columns).alias("_column"), spread(rows).alias("_row")).select(
        *keys, "dst", "hb", part)
    parts = rows * columns
    found = b.repartition(parts, "part").join(near.repartition(parts, "part"), ["part", *keys]).filter(
        (F.col("src") != F.col("dst")) & (F.col("ha") != F.col("hb")))
    return found.groupBy("part", "src", "dst").agg(
        F.array_sort(F.collect_set(F.struct("kind", "value"))).alias("evidence"),
        F.max(F.col("kind").isin(*STRONG)).alias("strong"),
    ).select("src", "dst", "evidence", F.when(F.col("strong"), "candidate").otherwise("context_only").alias("strength"))


def recurrence(occurrence: DataFrame, bucket_seconds: int = 86400) -> DataFrame:
    """Every occurrence of an indicator with the count and time range of its earlier ones."""
    return skew.running_before(
        occurrence, ["kind", "value"], [F.col("created"), F.col("msg_id")],
        skew.time_bucket(F.col("created"), bucket_seconds), "created", "prior")


def history(occurrence: DataFrame) -> DataFrame:
    """For every message and tracked indicator: how many *other* messages carry it, and when they did.

    Self-exclusion needs no self-join: the two earliest and the two latest times of each indicator are enough to leave
    one message out.
    """
    kept = occurrence.filter(F.col("kind").isin(*TRACKED))
    stamp = F.struct(F.col("created").alias("at"), "msg_id")
    keys = ["kind", "value"]
    # Per-key extremes by map-side combined min/max; the second place excludes the first place's message.
    first = kept.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min(stamp).alias("lo1"), F.max(stamp).alias("hi1"))
    with_first = kept.join(first, keys)
    second = with_first.groupBy(*keys).agg(
        F.min(F.when(F.col("msg_id") != F.col("lo1.msg_id"), stamp)).alias("lo2"),
        F.max(F.when(F.col("msg_id") != F.col("hi1.msg_id"), stamp)).alias("hi2"))
    joined = with_first.join(second, keys)
    other = lambda one, two: F.when(
        F.col(f"{one}.msg_id") == F.col("msg_id"), F.col(f"{two}.at")).otherwise(F.col(f"{one}.at"))
    return joined.filter(F.col("n") > 1).select(
        "msg_id", *keys, (F.col("n") - 1).alias("occurrence_count"),
        other("lo1", "lo2").alias("first_seen"), other("hi1", "hi2").alias("last_seen"))


def prior_cases(occurrence: DataFrame, chosen: DataFrame, keep: int | None = None) -> DataFrame:
    """History of chosen messages including the ordered ids of the others (optionally only the latest ``keep``)."""
    keys = ["kind", "value"]
    current = occurrence.filter(F.col("kind").isin(*TRACKED)).join(chosen.select("msg_id"), "msg_id", "left_semi").select(
        *keys, "msg_id")
    others = occurrence.select(*keys, F.col("msg_id").alias("other_id"), F.col("created").alias("at"))
    hits = others.join(current, keys).filter(F.col("other_id") != F.col("msg_id"))
    if keep:
        hits = skew.top_k(hits, ["msg_id", *keys], [F.col("at").desc(), F.col("other_id").desc()], keep, "_rn").drop("_rn")
    return hits.groupBy("msg_id", *keys).agg(
        F.count(F.lit(1)).alias("occurrence_count"), F.min("at").alias("first_seen"), F.max("at").alias("last_seen"),
        F.array_sort(F.collect_list(F.struct("at", "other_id"))).alias("ordered"),
    ).withColumn("case_ids", F.transform("ordered", lambda x: x["other_id"])).drop("ordered")


def node_id(kind: Column, value: Column) -> Column:
    return F.substring(F.sha2(F.concat(kind, F.lit(":"), value), 256), 1, 16)


def graph_nodes(indicators: DataFrame, message: DataFrame) -> DataFrame:
    """Typed nodes: one per message and one per known indicator."""
    cases = message.select(
        F.concat(F.lit("case:"), F.col("msg_id")).alias("node_id"), F.lit("case").alias("type"),
        F.col("msg_id").cast("string").alias("value"))
    typed = indicators.filter(F.col("kind").isin(*KINDS)).select("kind", "value").distinct()
    return cases.unionByName(typed.select(
        node_id(F.col("kind"), F.col("value")).alias("node_id"), F.col("kind").alias("type"), "value"))


def graph_edges(indicators: DataFrame) -> DataFrame:
    return indicators.filter(F.col("kind").isin(*KINDS)).select(
        F.concat(F.lit("case:"), F.col("msg_id")).alias("source"),
        node_id(F.col("kind"), F.col("value")).alias("target"),
        F.when(F.col("kind").isin(*STRONG), "strong").otherwise("context_only").alias("confidence"))


def graph_collisions(nodes: DataFrame) -> DataFrame:
    """Node ids that stand for more than one (type, value): must be empty before the graph is used."""
    return nodes.groupBy("node_id").agg(
        F.min(F.struct("type", "value")).alias("a"), F.max(F.struct("type", "value")).alias("b")).filter("a <> b")


def graph_slice(nodes: DataFrame, edges: DataFrame, type_filter: str = "all", needle: str = "") -> tuple[DataFrame, DataFrame]:
    """Nodes by type and substring, and the edges with both ends among them."""
    kept = nodes
    if type_filter == "indicators":
        kept = kept.filter(F.col("type") != "case")
    elif type_filter != "all":
        kept = kept.filter(F.col("type") == type_filter)
    if needle.strip():
        kept = kept.filter(F.lower("value").contains(needle.strip().lower()))
    ids = kept.select("node_id")
    inner = (edges.join(ids.withColumnRenamed("node_id", "source"), "source", "left_semi")
             .join(ids.withColumnRenamed("node_id", "target"), "target", "left_semi"))
    return kept, inner


def node_neighbours(edges: DataFrame, node: DataFrame) -> DataFrame:
    """Distinct far ends of the edges touching the given nodes."""
    out = edges.join(node.select(F.col("node_id").alias("source")), "source", "left_semi").select(F.col("target").alias("node_id"))
    back = edges.join(node.select(F.col("node_id").alias("target")), "target", "left_semi").select(F.col("source").alias("node_id"))
    return out.unionByName(back).distinct()
