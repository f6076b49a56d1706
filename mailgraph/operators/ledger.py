"""Cross-session indicator ledger under keyed hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailgraph.functions import crypto

RETENTION_DAYS = 90


def keyed(occurrence: DataFrame, key: bytes) -> DataFrame:
    """(h, kind, s, at): indicator and session only as keyed hashes. Demo messages never enter the ledger.

    Hashing runs on the distinct indicators, not on each occurrence.
    """
    live = occurrence.filter(~F.col("is_sample"))
    values = live.select("kind", "value").distinct().withColumn("h", crypto.indicator_hash(key, F.col("kind"), F.col("value")))
    sessions = live.select("session_id").distinct().withColumn("s", crypto.session_marker(key, F.col("session_id")))
    return live.join(values, ["kind", "value"]).join(sessions, "session_id").select(
        "h", "kind", "s", F.col("created").alias("at"))


def build(rows: DataFrame) -> DataFrame:
    """(h, kind, first_seen, last_seen, seen_count, distinct_sessions), combined per (h, session) first."""
    per_session = sessions(rows)
    return per_session.groupBy("h", "kind").agg(
        F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), F.sum("seen_count").alias("seen_count"),
        F.count(F.lit(1)).alias("distinct_sessions"))


def sessions(rows: DataFrame) -> DataFrame:
    """The stored form of the ledger: one row per (h, kind, s)."""
    return rows.groupBy("h", "kind", "s").agg(
        F.min("at").alias("first_seen"), F.max("at").alias("last_seen"), F.count(F.lit(1)).alias("seen_count"))


def upsert(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Stored per-session rows with a new batch of ``keyed`` rows folded in."""
    return stored.unionByName(sessions(new)).groupBy("h", "kind", "s").agg(
        F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), F.sum("seen_count").alias("seen_count"))


def fold(stored: DataFrame) -> DataFrame:
    return stored.groupBy("h", "kind").agg(
        F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), F.sum("seen_count").alias("seen_count"),
        F.count(F.lit(1)).alias("distinct_sessions"))


def retained(ledger: DataFrame, as_of: Column, days: float = RETENTION_DAYS) -> DataFrame:
    return ledger.filter(F.unix_seconds("last_seen") >= F.unix_seconds(as_of) - days * 86400)


def lookup(current: DataFrame, stored: DataFrame, key: bytes, as_of: Column, days: float = RETENTION_DAYS) -> DataFrame:
    """Ledger facts for each (msg_id, session_id, kind, value): counts over all sessions and over the others."""
    hits = retained(fold(stored), as_of, days)
    hashed = current.withColumn("h", crypto.indicator_hash(key, F.col("kind"), F.col("value"))).withColumn(
        "s", crypto.session_marker(key, F.col("session_id")))
    own = stored.select("h", "s", F.lit(1).alias("own"))
    return hashed.join(hits.drop("kind"), "h").join(own, ["h", "s"], "left").select(
        "msg_id", "kind", "value", "seen_count", "distinct_sessions",
        (F.col("distinct_sessions") - F.coalesce("own", F.lit(0))).alias("other_sessions"), "first_seen", "last_seen")
