"""Change-feed folds in batch form; ``mailgraph.streaming`` runs the same logic on streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_ATTEMPTS = 5
MAX_BACKOFF_SECONDS = 300


def new_ids(added: DataFrame, labelled: DataFrame, since: int) -> DataFrame:
    """(id, first_seq) of both record types after the watermark, each id once at its first place."""
    fresh = added.unionByName(labelled).filter(F.col("seq") > since)
    return fresh.groupBy("id").agg(F.min("seq").alias("first_seq"))


def first_claims(log: DataFrame, keys: list[str]) -> DataFrame:
    """The row that claims each key; later ones are repeats."""
    return log.groupBy(*keys).agg(F.min("seq").alias("seq"))


def retry_queue(log: DataFrame, keys: list[str], newest: int | None = None) -> DataFrame:
    """Ids still failing: transient failures since the last success or permanent failure, queued or exhausted.

    ``log`` carries ``seq`` and ``outcome`` (transient / cleared). ``newest`` keeps that many latest ids, as a report.
    """
    cleared = log.groupBy(*keys).agg(F.max(F.when(F.col("outcome") == "cleared", F.col("seq"))).alias("_cleared"))
    failing = log.filter(F.col("outcome") == "transient").join(cleared, keys).filter(
        F.col("_cleared").isNull() | (F.col("seq") > F.col("_cleared")))
    queue = failing.groupBy(*keys).agg(F.count(F.lit(1)).alias("attempts"), F.max("seq").alias("last_seq")).withColumn(
        "state", F.when(F.col("attempts") >= MAX_ATTEMPTS, "exhausted").otherwise("queued"))
    return queue.orderBy(F.col("last_seq").desc()).limit(newest) if newest else queue


def backoff_seconds(attempts: Column, base: int = 5, most: int = MAX_BACKOFF_SECONDS) -> Column:
    return F.least(F.lit(most), base * F.pow(F.lit(2), F.least(attempts, F.lit(10)) - 1)).cast("long")


def sliding_sessions(use: DataFrame, key: str, gap: str) -> DataFrame:
    """(key, start, expires, uses): each use extends the session by ``gap``. Sessions merge map-side before the shuffle."""
    window = F.session_window("ts", gap)
    return use.groupBy(key, window.alias("w")).agg(F.count(F.lit(1)).alias("uses")).select(
        key, F.col("w.start").alias("start"), F.col("w.end").alias("expires"), "uses")


def admission(accepted: list[int], now: int, limit: int, width: int) -> tuple[bool, list[int]]:
    """Verdict for one request and the accepted times still inside the window."""
    recent = [x for x in accepted if x > now - width]
    if len(recent) < limit:
        return True, [*recent, now]
    return False, recent


def admit(requests: DataFrame, limit: int = 30, window_seconds: int = 60) -> DataFrame:
    """(peer, at_us, request, accepted): accepted while fewer than ``limit`` accepted ones lie in the last window.

    Each verdict depends on the ones before it, so a peer is walked in order; rows stream through the task, which holds
    at most ``limit`` times. ``trailing_count`` is the parallel, stateless approximation.
    """
    width = window_seconds * 1_000_000
    rows = requests.select("peer", F.unix_micros("at").alias("at_us"), "request")

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, accepted = None, []
        for batch in batches:
            verdicts = []
            for peer, now in zip(batch["peer"], batch["at_us"]):
                if peer != current:
                    current, accepted = peer, []
                ok, accepted = admission(accepted, now, limit, width)
                verdicts.append(ok)
            yield batch.assign(accepted=verdicts)

    ordered = rows.repartition("peer").sortWithinPartitions("peer", "at_us", "request")
    return ordered.mapInPandas(walk, "peer STRING, at_us BIGINT, request BIGINT, accepted BOOLEAN")
