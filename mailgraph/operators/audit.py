"""Hash-chained audit events: building, verifying and folding them."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailgraph.functions.crypto import GENESIS
from mailgraph.plans import skew

CHAIN_SCHEMA = "session_id BIGINT, seq BIGINT, payload STRING, previous STRING, hash STRING"
NOTES_PER_CASE = 50
CASES_PER_SESSION = 30


def chain(events: DataFrame, heads: DataFrame | None = None) -> DataFrame:
    """(session_id, seq, payload, previous, hash): each hash covers the one before it.

    A chain is sequential by definition. Sessions run in parallel; inside one, sorted rows stream through a task that
    remembers only the running head, so a long session needs time but no memory. ``heads`` (session_id, head) continues
    stored chains. Checking a chain (``verify``) is fully parallel.
    """
    start = F.lit(GENESIS)
    rows = events.select("session_id", "seq", "payload")
    if heads is not None:
        rows = rows.join(heads, "session_id", "left")
        start = F.coalesce("head", start)
    rows = rows.select("session_id", "seq", "payload", start.alias("start"))

    def link(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        session, head = None, GENESIS
        for batch in batches:
            before, after = [], []
            for sid, payload, first in zip(batch["session_id"], batch["payload"], batch["start"]):
                if sid != session:
                    session, head = sid, first
                before.append(head)
                head = hashlib.sha256((head + payload).encode()).hexdigest()
                after.append(head)
            yield batch.drop(columns="start").assign(previous=before, hash=after)

    return rows.repartition("session_id").sortWithinPartitions("session_id", "seq").mapInPandas(link, CHAIN_SCHEMA)


def heads(chained: DataFrame) -> DataFrame:
    """Snapshot of every session: (session_id, event_count, head)."""
    return chained.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("event_count"), F.max_by("hash", "seq").alias("head"))


def verify(chained: DataFrame) -> DataFrame:
    """Per session: validity, rows, head and the first position that does not fit."""
    linked = skew.previous(chained, ["session_id"], "seq", skew.id_bucket(F.col("seq")), {"hash": "_before"})
    wrong = (F.col("previous") != F.coalesce("_before", F.lit(GENESIS))) | (
        F.col("hash") != F.sha2(F.concat("previous", "payload"), 256))
    return linked.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("checked"), F.max_by("hash", "seq").alias("head"),
        F.min(F.when(wrong, F.col("seq"))).alias("first_mismatch"),
    ).withColumn("valid", F.col("first_mismatch").isNull())


def verify_checkpoint(chained: DataFrame, checkpoint: DataFrame) -> DataFrame:
    """Does each chain still start with the saved prefix? ``checkpoint`` holds (session_id, event_count, head)."""
    placed = skew.ranked(chained.select("session_id", "seq", "hash"), ["session_id"], [F.col("seq")],
                         skew.id_bucket(F.col("seq")), "rn", "length")
    at = placed.select("session_id", F.col("rn").alias("event_count"), F.col("hash").alias("actual"))
    lengths = chained.groupBy("session_id").agg(F.count(F.lit(1)).alias("length"))
    joined = checkpoint.join(lengths, "session_id", "left").join(at, ["session_id", "event_count"], "left")
    expected = F.when(F.col("event_count") == 0, F.lit(GENESIS)).otherwise(F.col("actual"))
    return joined.select("session_id", "event_count", F.when(
        F.coalesce("length", F.lit(0)) < F.col("event_count"), "shorter").when(expected != F.col("head"), "differs").otherwise("kept").alias("state"))


def custody(events: DataFrame, notes: int = NOTES_PER_CASE) -> DataFrame:
    """Per (session, case): owner, latest review, note count and last notes, and whether the case is live."""
    keys = ["session_id", "case_id"]
    is_ = lambda action: F.col("action") == action
    latest = lambda action: F.max(F.when(is_(action), F.struct("seq", "actor")))
    folded = events.groupBy(*keys).agg(
        latest("assign").alias("assign"), latest("review").alias("review"), F.count_if(is_("note")).alias("notes"),
        F.bool_or(is_("analyze")).alias("analysed"), F.bool_or(is_("delete")).alias("deleted"))
    kept = skew.top_k(events.filter(is_("note")).select(*keys, "seq"), keys, [F.col("seq").desc()], notes, "_rn")
    last = kept.groupBy(*keys).agg(F.array_sort(F.collect_list("seq")).alias("last_notes"))
    return folded.join(last, keys, "left").select(
        *keys, F.col("assign.actor").alias("owner"), F.coalesce("review.actor", F.lit("pending")).alias("reviewer"), "notes",
        F.coalesce("last_notes", F.array().cast("array<bigint>")).alias("last_notes"), (F.col("analysed") & ~F.col("deleted")).alias("live"))


def latest(df: DataFrame, keys: list[str], order: str, *values: str) -> DataFrame:
    """Latest row per key by a combined maximum instead of a window over the whole key."""
    return df.groupBy(*keys).agg(F.max(F.struct(order, *values)).alias("_v")).select(*keys, "_v.*")


def self_approvals(events: DataFrame) -> DataFrame:
    """Reviews by the person who first analysed the same case."""
    keys = ["session_id", "case_id"]
    analyst = events.filter(F.col("action") == "analyze").groupBy(*keys).agg(F.min_by("actor", "seq").alias("analyst"))
    reviews = events.filter(F.col("action") == "review").select(*keys, "seq", "actor")
    return reviews.join(analyst, keys).filter(F.col("actor") == F.col("analyst")).select(*keys, "seq", "actor")


def expected_inventory(events: DataFrame) -> DataFrame:
    """Cases that were analysed and not deleted, with the payload of their latest analysis."""
    keys = ["session_id", "case_id"]
    per = events.filter(F.col("action").isin("analyze", "delete")).groupBy(*keys).agg(
        F.max(F.when(F.col("action") == "analyze", F.struct("seq", "payload"))).alias("a"),
        F.bool_or(F.col("action") == "delete").alias("deleted"))
    return per.filter(F.col("a").isNotNull() & ~F.col("deleted")).select(*keys, F.sha2("a.payload", 256).alias("expected_hash"))


def reconcile(stored: DataFrame, events: DataFrame) -> DataFrame:
    """Full outer comparison of stored cases with the audit log; ``stored`` holds (session_id, case_id, stored_hash)."""
    joined = stored.join(expected_inventory(events), ["session_id", "case_id"], "full_outer")
    return joined.withColumn("state", F.when(F.col("expected_hash").isNull(), "unexpected").when(
        F.col("stored_hash").isNull(), "missing").when(F.col("stored_hash") != F.col("expected_hash"), "altered").otherwise("ok"))


def inventory_difference(stored: DataFrame, events: DataFrame) -> DataFrame:
    """(session_id, case_id, side) present on one side only; empty means the inventories agree."""
    keys = ["session_id", "case_id"]
    have, want = stored.select(*keys), expected_inventory(events).select(*keys)
    return have.exceptAll(want).withColumn("side", F.lit("stored")).unionByName(
        want.exceptAll(have).withColumn("side", F.lit("expected")))


def quota(case: DataFrame, ceiling: int, per_session: int = CASES_PER_SESSION) -> DataFrame:
    """(msg_id, session_rank, stored_bytes, over_session, over_storage): which cases lie past a limit, in time order."""
    order = [F.col("created"), F.col("msg_id")]
    bucket = skew.time_bucket(F.col("created"), 86400)
    ranked = skew.ranked(case, ["session_id"], order, bucket, "session_rank")
    summed = skew.running_sum(ranked, [], order, bucket, F.col("bytes"), "stored_bytes")
    return summed.withColumn("over_session", F.col("session_rank") > per_session).withColumn(
        "over_storage", F.col("stored_bytes") > ceiling)
