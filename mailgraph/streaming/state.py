"""Custom keyed state: chain append, ledger with expiry, admission control.

Each processor keeps a few values per key. Order-dependent ones sort a key's rows of one micro-batch, which the trigger's
size limit bounds; nothing older is held beyond the state.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from mailgraph.functions.crypto import GENESIS
from mailgraph.operators.audit import CHAIN_SCHEMA
from mailgraph.operators.feedlog import admission


def append_chain(events: DataFrame) -> DataFrame:
    """Chain rows for (session_id, seq, payload) in ``seq`` order; the state is the session's head."""
    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        head = state.get[0] if state.exists else GENESIS
        rows = pd.concat(batches).sort_values("seq")
        before, after = [], []
        for payload in rows["payload"]:
            before.append(head)
            head = hashlib.sha256((head + payload).encode()).hexdigest()
            after.append(head)
        state.update((head,))
        yield rows[["session_id", "seq", "payload"]].assign(previous=before, hash=after)

    return events.groupBy("session_id").applyInPandasWithState(
        step, CHAIN_SCHEMA, "head STRING", "append", GroupStateTimeout.NoTimeout)


def ledger(rows: DataFrame, retention_seconds: int, late: str = "1 hour") -> DataFrame:
    """Running ledger entry per indicator hash; an entry unseen for the retention time leaves the state."""
    out = "h STRING, kind STRING, first_seen TIMESTAMP, last_seen TIMESTAMP, seen_count BIGINT, expired BOOLEAN"

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            first, last, seen = state.get
            state.remove()
            yield pd.DataFrame({"h": [key[0]], "kind": [key[1]], "first_seen": [pd.Timestamp(first, unit="us")],
                                "last_seen": [pd.Timestamp(last, unit="us")], "seen_count": [seen], "expired": [True]})
            return
        first, last, seen = state.get if state.exists else (None, None, 0)
        for batch in batches:
            micros = batch["at"].astype("datetime64[us]").astype("int64")
            low, high = int(micros.min()), int(micros.max())
            first = low if first is None else min(first, low)
            last = high if last is None else max(last, high)
            seen += len(batch)
        state.update((first, last, seen))
        state.setTimeoutTimestamp(max(last // 1000 + retention_seconds * 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"h": [key[0]], "kind": [key[1]], "first_seen": [pd.Timestamp(first, unit="us")],
                            "last_seen": [pd.Timestamp(last, unit="us")], "seen_count": [seen], "expired": [False]})

    return rows.withWatermark("at", late).groupBy("h", "kind").applyInPandasWithState(
        step, out, "first BIGINT, last BIGINT, seen BIGINT", "update", GroupStateTimeout.EventTimeTimeout)


def admit(requests: DataFrame, limit: int = 30, window_seconds: int = 60) -> DataFrame:
    """Accept a request only while fewer than ``limit`` *accepted* ones lie in the last window.

    Rejected requests use no budget. The state is at most ``limit`` timestamps per key.
    """
    out = "peer STRING, at TIMESTAMP, request BIGINT, accepted BOOLEAN"
    width = window_seconds * 1_000_000

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        accepted = list(state.get[0]) if state.exists else []
        rows = pd.concat(batches).sort_values(["at", "request"])
        verdicts = []
        for now in rows["at"].astype("datetime64[us]").astype("int64"):
            ok, accepted = admission(accepted, int(now), limit, width)
            verdicts.append(ok)
        state.update((accepted,))
        yield rows[["peer", "at", "request"]].assign(accepted=verdicts)

    return requests.groupBy("peer").applyInPandasWithState(
        step, out, "accepted ARRAY<BIGINT>", "append", GroupStateTimeout.NoTimeout)
