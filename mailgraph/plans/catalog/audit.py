"""Audit chain, ledger, sessions and the batch twins of the streaming operators."""

from pyspark.sql import functions as F

from mailgraph.functions import crypto
from mailgraph.operators import audit as A
from mailgraph.operators import feedlog as L
from mailgraph.operators import indicators as I
from mailgraph.operators import ledger as G
from mailgraph.plans import lineage, skew
from mailgraph.plans.catalog.correlation import TRACKED, indicators, occurrences
from mailgraph.plans.oracle import register_view
from mailgraph.plans.registry import query

KEY = b"mailgraph-check-key"
CUTOFF = "2024-01-03 00:00:00"

register_view("v_ordered", "SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY seq) AS rn FROM v_audit")
register_view("v_chain", """
    SELECT session_id, seq, payload, rn, repeat('0', 64) AS previous, sha256(repeat('0', 64) || payload) AS hash FROM v_ordered WHERE rn = 1
    UNION ALL SELECT o.session_id, o.seq, o.payload, o.rn, c.hash, sha256(c.hash || o.payload)
    FROM v_chain c JOIN v_ordered o ON o.session_id = c.session_id AND o.rn = c.rn + 1""")
register_view("v_tampered", """
    SELECT session_id, seq, rn, previous, hash, CASE WHEN seq % 997 = 5 THEN payload || '!' ELSE payload END AS payload FROM v_chain""")
register_view("v_checkpoint", """
    SELECT session_id, CASE WHEN session_id % 11 = 0 THEN n + 5 ELSE (n + 1) // 2 END AS event_count,
           CASE WHEN session_id % 7 = 0 THEN sha256('other') ELSE h END AS head
    FROM (SELECT session_id, count(*) AS n, (SELECT c.hash FROM v_chain c WHERE c.session_id = a.session_id AND c.rn = (count(a.seq) + 1) // 2) AS h
          FROM v_chain a GROUP BY session_id)""")
register_view("v_stored", """
    SELECT session_id, case_id, CASE WHEN max(seq) % 13 = 0 THEN sha256('x') ELSE sha256(arg_max(payload, seq)) END AS stored_hash
    FROM v_audit WHERE action = 'analyze' AND seq % 10 <> 0 GROUP BY session_id, case_id
    UNION ALL SELECT DISTINCT session_id, case_id + 1000, sha256('y') FROM v_audit WHERE action = 'analyze' AND seq % 50 = 0""")
register_view("v_expected", """
    SELECT session_id, case_id, sha256(arg_max(payload, seq) FILTER (action = 'analyze')) AS expected_hash FROM v_audit
    WHERE action IN ('analyze', 'delete') GROUP BY session_id, case_id HAVING bool_or(action = 'analyze') AND NOT bool_or(action = 'delete')""")


def stored(t):
    analysed = t.audit.filter("action = 'analyze'")
    kept = analysed.filter(F.col("seq") % 10 != 0).groupBy("session_id", "case_id").agg(F.max(F.struct("seq", "payload")).alias("a")).select(
        "session_id", "case_id", F.when(F.col("a.seq") % 13 == 0, F.sha2(F.lit("x"), 256)).otherwise(F.sha2("a.payload", 256)).alias("stored_hash"))
    extra = analysed.filter(F.col("seq") % 50 == 0).select("session_id", (F.col("case_id") + 1000).alias("case_id")).distinct()
    return kept.unionByName(extra.withColumn("stored_hash", F.sha2(F.lit("y"), 256)))


@query("X05_hash_chain", "SELECT session_id, seq, payload, previous, hash FROM v_chain")
def hash_chain(t):
    return A.chain(t.audit)


@query("W04_verify_chain", """
    SELECT session_id, count(*) AS checked, arg_max(hash, seq) AS head, min(seq) FILTER (wrong) AS first_mismatch, NOT bool_or(wrong) AS valid FROM (
        SELECT *, previous <> coalesce(lag(hash) OVER (PARTITION BY session_id ORDER BY seq), repeat('0', 64)) OR hash <> sha256(previous || payload) AS wrong
        FROM v_tampered) GROUP BY session_id""")
def verify_chain(t):
    tampered = lineage.cut(A.chain(t.audit)).withColumn(
        "payload", F.when(F.col("seq") % 997 == 5, F.concat("payload", F.lit("!"))).otherwise(F.col("payload")))
    return A.verify(tampered)


@query("W05_checkpoint_prefix", """
    SELECT p.session_id, p.event_count, CASE WHEN (SELECT count(*) FROM v_chain c WHERE c.session_id = p.session_id) < p.event_count THEN 'shorter'
        WHEN (SELECT hash FROM v_chain c WHERE c.session_id = p.session_id AND c.rn = p.event_count) <> p.head THEN 'differs' ELSE 'kept' END AS state
    FROM v_checkpoint p""")
def checkpoint_prefix(t):
    chained = lineage.cut(A.chain(t.audit))
    placed = skew.ranked(chained, ["session_id"], [F.col("seq")], skew.id_bucket(F.col("seq")), "rn", "n")
    half = F.floor((F.col("n") + 1) / 2)
    saved = placed.filter(F.col("rn") == half).select(
        "session_id", F.when(F.col("session_id") % 11 == 0, F.col("n") + 5).otherwise(half).alias("event_count"),
        F.when(F.col("session_id") % 7 == 0, F.sha2(F.lit("other"), 256)).otherwise(F.col("hash")).alias("head"))
    return A.verify_checkpoint(chained, saved)


@query("A22_custody", """
    SELECT session_id, case_id, arg_max(actor, seq) FILTER (action = 'assign') AS owner,
           coalesce(arg_max(actor, seq) FILTER (action = 'review'), 'pending') AS reviewer, count(*) FILTER (action = 'note') AS notes,
           bool_or(action = 'analyze') AND NOT bool_or(action = 'delete') AS live,
           coalesce((SELECT string_agg(seq::VARCHAR, ',' ORDER BY seq) FROM (SELECT seq FROM v_audit n WHERE n.session_id = a.session_id
               AND n.case_id = a.case_id AND n.action = 'note' ORDER BY seq DESC LIMIT 50)), '') AS last_notes
    FROM v_audit a GROUP BY session_id, case_id""")
def custody(t):
    return A.custody(t.audit).withColumn("last_notes", F.array_join(F.col("last_notes").cast("array<string>"), ","))


@query("W10_latest_review", """
    SELECT session_id, case_id, seq, actor FROM v_audit WHERE action = 'review'
    QUALIFY row_number() OVER (PARTITION BY session_id, case_id ORDER BY seq DESC) = 1""")
def latest_review(t):
    return A.latest(t.audit.filter("action = 'review'"), ["session_id", "case_id"], "seq", "actor")


@query("J19_self_approvals", """
    SELECT r.session_id, r.case_id, r.seq, r.actor FROM v_audit r JOIN (
        SELECT session_id, case_id, arg_min(actor, seq) AS analyst FROM v_audit WHERE action = 'analyze' GROUP BY ALL) a
    ON a.session_id = r.session_id AND a.case_id = r.case_id AND a.analyst = r.actor WHERE r.action = 'review'""")
def self_approvals(t):
    return A.self_approvals(t.audit)


@query("J20_reconcile", """
    SELECT coalesce(s.session_id, e.session_id) AS session_id, coalesce(s.case_id, e.case_id) AS case_id,
           CASE WHEN expected_hash IS NULL THEN 'unexpected' WHEN stored_hash IS NULL THEN 'missing'
                WHEN stored_hash <> expected_hash THEN 'altered' ELSE 'ok' END AS state
    FROM v_stored s FULL JOIN v_expected e ON s.session_id = e.session_id AND s.case_id = e.case_id""")
def reconcile(t):
    return A.reconcile(stored(t), t.audit).select("session_id", "case_id", "state")


@query("U04_inventory_difference", """
    (SELECT session_id, case_id, 'stored' AS side FROM v_stored EXCEPT SELECT session_id, case_id, 'stored' FROM v_expected)
    UNION ALL (SELECT session_id, case_id, 'expected' FROM v_expected EXCEPT SELECT session_id, case_id, 'expected' FROM v_stored)""")
def inventory_difference(t):
    return A.inventory_difference(stored(t), t.audit)


@query("S06_audit_scan", """SELECT session_id, seq, action, case_id, epoch_us("at") AS at_us FROM v_audit WHERE action IN ('analyze', 'delete')""")
def audit_scan(t):
    return t.audit.filter(F.col("action").isin("analyze", "delete")).orderBy("session_id", F.col("seq").desc()).select(
        "session_id", "seq", "action", "case_id", F.unix_micros("at").alias("at_us"))


@query("A29_quota", """
    SELECT msg_id, session_rank, stored_bytes, session_rank > 30 AS over_session, stored_bytes > 1000000 AS over_storage FROM (
        SELECT msg_id, row_number() OVER (PARTITION BY session_id ORDER BY created, msg_id) AS session_rank,
               (sum(octet_length(encode(body))) OVER (ORDER BY created, msg_id))::BIGINT AS stored_bytes FROM v_message)""")
def quota(t):
    case = t.message.select("msg_id", "session_id", "created", F.octet_length("body").alias("bytes"))
    return A.quota(case, 1_000_000).select("msg_id", "session_rank", "stored_bytes", "over_session", "over_storage")


@query("P07_retention", """
    WITH s AS (SELECT session_id FROM v_audit GROUP BY session_id HAVING max("at") >= TIMESTAMP '2024-01-30 12:00:00')
    SELECT session_id, count(*) AS events, count(DISTINCT case_id) AS cases FROM v_audit WHERE session_id IN (SELECT session_id FROM s) GROUP BY session_id""")
def retention(t):
    cutoff = F.lit("2024-01-30 12:00:00").cast("timestamp")
    alive = t.audit.groupBy("session_id").agg(F.max("at").alias("last")).filter(F.col("last") >= cutoff).select("session_id")
    kept = t.audit.join(alive, "session_id", "left_semi")
    return kept.groupBy("session_id", "case_id").agg(F.count(F.lit(1)).alias("n")).groupBy("session_id").agg(
        F.sum("n").alias("events"), F.count(F.lit(1)).alias("cases"))


IPAD = "".join(f"\\x{b ^ 0x36:02X}" for b in KEY.ljust(64, b"\0"))
OPAD = "".join(f"\\x{b ^ 0x5C:02X}" for b in KEY.ljust(64, b"\0"))
HMAC = f"sha256('{OPAD}'::BLOB || unhex(sha256('{IPAD}'::BLOB || {{0}})))"
register_view("v_ledger_row", f"""
    SELECT {HMAC.format("encode(kind) || '\\x00'::BLOB || encode(value)")} AS h, kind, value, session_id, created, msg_id
    FROM v_occurrence WHERE NOT is_sample AND kind IN {TRACKED}""")
register_view("v_ledger", """
    SELECT h, any_value(kind) AS kind, min(created) AS first_seen, max(created) AS last_seen, count(*) AS seen_count,
           count(DISTINCT session_id) AS distinct_sessions FROM v_ledger_row GROUP BY h""")


def ledger_rows(t):
    return G.keyed(occurrences(t).filter(F.col("kind").isin(*I.TRACKED)), KEY)


@query("F10_keyed_hash", f"SELECT DISTINCT kind, value, {HMAC.format(chr(39).join(['encode(kind) || ', chr(92) + 'x00', '::BLOB || encode(value)']))} AS h FROM v_indicator")
def keyed_hash(t):
    pairs = indicators(t).select("kind", "value").distinct()
    return pairs.withColumn("h", crypto.indicator_hash(KEY, F.col("kind"), F.col("value")))


@query("A08_ledger", """
    SELECT h, kind, epoch_us(first_seen) AS first_us, epoch_us(last_seen) AS last_us, seen_count, distinct_sessions FROM v_ledger""")
def ledger(t):
    return G.build(ledger_rows(t)).select(
        "h", "kind", F.unix_micros("first_seen").alias("first_us"), F.unix_micros("last_seen").alias("last_us"), "seen_count", "distinct_sessions")


@query("A08_ledger_upsert", """
    SELECT h, kind, epoch_us(first_seen) AS first_us, epoch_us(last_seen) AS last_us, seen_count, distinct_sessions FROM v_ledger""")
def ledger_upsert(t):
    """The same ledger, built from the messages before a cut-off and then extended with the later ones."""
    rows = ledger_rows(t)
    cut = F.lit(CUTOFF).cast("timestamp")
    early, late = rows.filter(F.col("at") < cut), rows.filter(F.col("at") >= cut)
    return G.fold(G.upsert(G.sessions(early), late)).select(
        "h", "kind", F.unix_micros("first_seen").alias("first_us"), F.unix_micros("last_seen").alias("last_us"), "seen_count", "distinct_sessions")


@query("P07_ledger_retention", f"""
    SELECT h, seen_count FROM v_ledger WHERE epoch(last_seen) >= epoch(TIMESTAMP '{CUTOFF}') - 43200""")
def ledger_retention(t):
    return G.retained(G.build(ledger_rows(t)), F.lit(CUTOFF).cast("timestamp"), 0.5).select("h", "seen_count")


@query("J09_ledger_lookup", f"""
    SELECT o.msg_id, o.kind, o.value, l.seen_count, l.distinct_sessions,
           l.distinct_sessions - (CASE WHEN EXISTS (SELECT 1 FROM v_ledger_row r WHERE r.kind = o.kind AND r.value = o.value
               AND r.session_id = o.session_id) THEN 1 ELSE 0 END) AS other_sessions
    FROM v_occurrence o JOIN (SELECT DISTINCT h, kind, value FROM v_ledger_row) k ON k.kind = o.kind AND k.value = o.value
    JOIN v_ledger l ON l.h = k.h AND l.last_seen >= TIMESTAMP '2024-01-02 00:00:00' WHERE o.kind IN {TRACKED}""")
def ledger_lookup(t):
    current = occurrences(t).filter(F.col("kind").isin(*I.TRACKED)).select("msg_id", "session_id", "kind", "value")
    return G.lookup(current, G.sessions(ledger_rows(t)), KEY, F.lit("2024-01-04 00:00:00").cast("timestamp"), 2).drop("first_seen", "last_seen")


@query("W07_rolling_rate", """
    SELECT event_id, user_id, n FROM (SELECT event_id, user_id, count(*) OVER (PARTITION BY user_id ORDER BY ts
        RANGE BETWEEN INTERVAL 86400 SECOND PRECEDING AND CURRENT ROW) AS n FROM events) WHERE n >= 5""")
def rolling_rate(t):
    return skew.trailing_count(t.events.select("event_id", "user_id", "ts"), ["user_id"], "ts", 86400, "n").filter("n >= 5").select(
        "event_id", "user_id", "n")


@query("X07_sliding_sessions", """
    WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 8 HOUR THEN 0 ELSE 1 END AS starts FROM events),
    g AS (SELECT *, sum(starts) OVER (PARTITION BY user_id ORDER BY ts) AS no FROM e)
    SELECT user_id, epoch_us(min(ts)) AS start_us, epoch_us(max(ts) + INTERVAL 8 HOUR) AS expires_us, count(*) AS uses FROM g GROUP BY user_id, no""")
def sliding_sessions(t):
    return L.sliding_sessions(t.events, "user_id", "8 hours").select(
        "user_id", F.unix_micros("start").alias("start_us"), F.unix_micros("expires").alias("expires_us"), "uses")


@query("X01_change_feed", """
    SELECT case_id AS id, min(seq) AS first_seq FROM v_audit WHERE action IN ('analyze', 'note') AND seq > 500 GROUP BY case_id""")
def change_feed(t):
    added = t.audit.filter("action = 'analyze'").select(F.col("case_id").alias("id"), "seq")
    labelled = t.audit.filter("action = 'note'").select(F.col("case_id").alias("id"), "seq")
    return L.new_ids(added, labelled, 500)


@query("X02_first_claims", """
    SELECT session_id, case_id AS id, min(seq) AS seq FROM v_audit GROUP BY session_id, case_id""")
def first_claims(t):
    return L.first_claims(t.audit.select("session_id", F.col("case_id").alias("id"), "seq"), ["session_id", "id"])


@query("X03_retry_fold", """
    WITH c AS (SELECT session_id, case_id, max(seq) FILTER (action IN ('review', 'delete')) AS cleared FROM v_audit GROUP BY ALL)
    SELECT a.session_id, a.case_id AS id, count(*) AS attempts, max(seq) AS last_seq, CASE WHEN count(*) >= 5 THEN 'exhausted' ELSE 'queued' END AS state
    FROM v_audit a JOIN c ON c.session_id = a.session_id AND c.case_id = a.case_id
    WHERE action IN ('note', 'assign') AND seq > coalesce(cleared, -1) GROUP BY ALL""")
def retry_fold(t):
    outcome = F.when(F.col("action").isin("note", "assign"), "transient").when(F.col("action").isin("review", "delete"), "cleared")
    log = t.audit.select("session_id", F.col("case_id").alias("id"), "seq", outcome.alias("outcome"))
    return L.retry_queue(log, ["session_id", "id"])


@query("X04_watermark", """
    SELECT seq, max(seq - case_id) OVER (ORDER BY seq) AS watermark FROM v_audit""")
def watermark(t):
    notified = t.audit.select("seq", (F.col("seq") - F.col("case_id")).alias("notified"))
    return skew.running_max(notified, [], [F.col("seq")], skew.id_bucket(F.col("seq"), 1024), F.col("notified"), "watermark").select("seq", "watermark")


@query("F26_backoff", """
    SELECT session_id, case_id AS id, attempts, least(300, 5 * pow(2, least(attempts, 10) - 1))::BIGINT AS delay_seconds FROM (
        SELECT session_id, case_id, count(*) AS attempts FROM v_audit WHERE action = 'note' GROUP BY ALL)""")
def backoff(t):
    tries = t.audit.filter("action = 'note'").groupBy("session_id", F.col("case_id").alias("id")).agg(F.count(F.lit(1)).alias("attempts"))
    return tries.withColumn("delay_seconds", L.backoff_seconds(F.col("attempts")))
