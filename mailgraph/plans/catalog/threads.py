"""Threads and relay paths."""

from pyspark.sql import functions as F

from mailgraph.functions import hosts
from mailgraph.operators import enrichment as E
from mailgraph.operators import threads as TH
from mailgraph.plans import skew
from mailgraph.plans.oracle import register_view
from mailgraph.plans.registry import query

register_view("v_token", """
    SELECT msg_id, created, message_id AS token, 'own' AS role FROM v_message WHERE message_id IS NOT NULL
    UNION ALL SELECT msg_id, created, in_reply_to, 'ref' FROM v_message WHERE in_reply_to IS NOT NULL
    UNION ALL SELECT msg_id, created, sender || '|' || lower(subject), 'ref' FROM v_message WHERE message_id IS NULL AND in_reply_to IS NULL""")
register_view("v_thread_pair", """
    SELECT DISTINCT a.msg_id AS src, b.msg_id AS dst FROM v_token a JOIN v_token b ON a.token = b.token AND a.msg_id < b.msg_id
    WHERE a.role = 'ref' OR b.role = 'ref'""")
register_view("v_relay_step", """
    SELECT *, lag(by_host) OVER (PARTITION BY msg_id ORDER BY hop) AS prior, row_number() OVER (PARTITION BY msg_id ORDER BY hop) - 1 AS step
    FROM v_hop""")
register_view("v_reversal", """
    SELECT msg_id, count(*) AS reversals, max(epoch_us(before) - epoch_us(ts)) AS largest_us FROM (
        SELECT msg_id, ts, lag(ts) OVER (PARTITION BY msg_id ORDER BY hop) AS before FROM v_hop WHERE ts IS NOT NULL)
    WHERE ts < before - INTERVAL 300 SECOND GROUP BY msg_id""")
register_view("v_relay_check", """
    SELECT DISTINCT msg_id, 'Relay naming discontinuity' AS title FROM v_relay_step WHERE prior <> from_host
    UNION ALL SELECT msg_id, 'Repeated relay record' FROM v_hop GROUP BY msg_id HAVING count(*) > count(DISTINCT from_host || by_host || ip)
    UNION ALL SELECT DISTINCT a.msg_id, 'Possible relay loop' FROM v_hop a JOIN v_hop b
        ON a.msg_id = b.msg_id AND a.from_host = b.by_host AND a.by_host = b.from_host AND a.from_host <> a.by_host
    UNION ALL SELECT msg_id, 'Relay timestamp reversal' FROM v_reversal""")


@query("J07_thread_pairs", """
    SELECT src, dst FROM v_thread_pair WHERE src % 100 = 0 UNION SELECT dst, src FROM v_thread_pair WHERE dst % 100 = 0""")
def thread_pairs(t):
    return TH.thread_partners(TH.thread_tokens(t.message), t.message.filter(F.col("msg_id") % 100 == 0))


@query("J07_thread_sizes", """
    SELECT token, count(*) FILTER (role = 'ref') AS holders, count(*) FILTER (role = 'own') AS owners, any_value(p.n) AS pairs
    FROM v_token JOIN (SELECT a.token, count(*) AS n FROM v_token a JOIN v_token b ON a.token = b.token AND a.msg_id < b.msg_id
                       WHERE a.role = 'ref' OR b.role = 'ref' GROUP BY a.token) p USING (token) GROUP BY token""")
def thread_sizes(t):
    return TH.thread_sizes(TH.thread_tokens(t.message))


@query("F20_reference_tokens", """
    SELECT msg_id, count(*) FILTER (role = 'ref' AND token LIKE '<%') AS refs FROM v_token GROUP BY msg_id""")
def reference_tokens(t):
    return TH.thread_tokens(t.message).groupBy("msg_id").agg(
        F.count_if((F.col("role") == "ref") & F.col("token").startswith("<")).alias("refs"))


register_view("v_effective", """
    SELECT msg_id, created, split_part(coalesce(reply_to, sender), '@', 2) AS value FROM v_message""")


@query("U03_reply_domain_changed", """
    WITH mate AS (SELECT src AS me, dst AS other FROM v_thread_pair UNION ALL SELECT dst, src FROM v_thread_pair)
    SELECT c.msg_id, any_value(c.value) AS value FROM v_effective c JOIN mate m ON m.me = c.msg_id
    JOIN v_effective p ON p.msg_id = m.other AND p.created < c.created GROUP BY c.msg_id HAVING NOT bool_or(p.value = c.value)""")
def reply_domain_changed(t):
    values = t.message.select("msg_id", hosts.domain(F.coalesce("reply_to", "sender")).alias("value"))
    return TH.changed_in_thread(TH.thread_tokens(t.message), values)


@query("W02_relay_audit", """
    SELECT msg_id, coalesce(string_agg(step::VARCHAR, ',' ORDER BY step) FILTER (prior <> from_host), '') AS discontinuities,
           count(*) > count(DISTINCT from_host || '>' || by_host || '>' || ip) AS repeated,
           msg_id IN (SELECT msg_id FROM v_relay_check WHERE title = 'Possible relay loop') AS loop FROM v_relay_step GROUP BY msg_id""")
def relay_audit(t):
    return TH.relay_audit(t.hop).select(
        "msg_id", F.array_join(F.col("discontinuities").cast("array<string>"), ",").alias("discontinuities"), "repeated",
        F.coalesce("loop", F.lit(False)).alias("loop"))


@query("W02_relay_checks", "SELECT * FROM v_relay_check")
def relay_checks(t):
    return TH.relay_checks(t.hop)


@query("W03_timestamp_reversal", "SELECT * FROM v_reversal")
def timestamp_reversal(t):
    return TH.timestamp_reversals(t.hop)


@query("W08_first_public", """
    SELECT msg_id, hop, ip FROM v_hop WHERE ip NOT LIKE '10.%' AND ip NOT LIKE '192.168.%'
    QUALIFY row_number() OVER (PARTITION BY msg_id ORDER BY hop) = 1""")
def first_public(t):
    return E.first_public(t.hop)


@query("T03_recent_history", """
    SELECT user_id, event_id, rn FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn
    FROM events) WHERE rn <= 25""")
def recent_history(t):
    return skew.top_k(t.events.select("user_id", "event_id", "ts"), ["user_id"], [F.col("ts").desc(), F.col("event_id").desc()], 25).drop("ts")


@query("T04_bounded_evidence", """
    SELECT msg_id, string_agg(kind || '=' || value, ';' ORDER BY kind, value) AS evidence FROM (
        SELECT *, row_number() OVER (PARTITION BY msg_id ORDER BY kind, value) AS rn FROM v_indicator) WHERE rn <= 4 GROUP BY msg_id""")
def bounded_evidence(t):
    from mailgraph.plans.catalog.correlation import indicators
    first = skew.top_k(indicators(t), ["msg_id"], [F.col("kind"), F.col("value")], 4)
    return first.groupBy("msg_id").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "kind", "value"))), ";").alias("evidence"))
