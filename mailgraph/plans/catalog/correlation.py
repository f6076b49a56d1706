"""Message correlation: indicators, their history and the evidence graph."""

from pyspark.sql import functions as F

from mailgraph.operators import indicators as I
from mailgraph.plans.oracle import register_view
from mailgraph.plans.registry import query

STRONG = "('reply_address', 'attachment_hash', 'url', 'thread_id')"
TRACKED = "('sender_domain', 'sender_address', 'reported_ip', 'url', 'attachment_hash', 'reply_address')"

register_view("v_occurrence", """
    SELECT i.*, m.created, m.raw_hash, m.is_sample, m.session_id FROM v_indicator i JOIN v_message m USING (msg_id)""")
register_view("v_nodes", """
    SELECT 'case:' || msg_id AS node_id, 'case' AS type, msg_id::VARCHAR AS value FROM v_message
    UNION ALL SELECT substr(sha256(kind || ':' || value), 1, 16), kind, value FROM (SELECT DISTINCT kind, value FROM v_indicator)""")
register_view("v_edges", f"""
    SELECT 'case:' || msg_id AS source, substr(sha256(kind || ':' || value), 1, 16) AS target,
           CASE WHEN kind IN {STRONG} THEN 'strong' ELSE 'context_only' END AS confidence FROM v_indicator""")


def indicators(t):
    return I.extract(t.message, t.hop, t.url, t.attachment)


def occurrences(t):
    return I.occurrences(indicators(t), t.message)


@query("P13_indicators", "SELECT msg_id, kind, value FROM v_indicator")
def extract(t):
    return indicators(t)


@query("P11_tracked_indicators", f"""
    SELECT * FROM (SELECT msg_id, kind, value, row_number() OVER (PARTITION BY msg_id ORDER BY kind, value) AS rank
                   FROM v_indicator WHERE kind IN {TRACKED}) WHERE rank <= 50""")
def tracked(t):
    return I.tracked(indicators(t))


@query("J04_shared_indicators", """
    SELECT o.kind, o.value, o.is_sample, count(*) AS messages, count(DISTINCT raw_hash) AS hashes, min(msg_id) AS hub,
           any_value(p.pairs) AS pairs
    FROM v_occurrence o JOIN (
        SELECT a.kind, a.value, a.is_sample, count(*) AS pairs FROM v_occurrence a JOIN v_occurrence b
        ON a.kind = b.kind AND a.value = b.value AND a.is_sample = b.is_sample AND a.msg_id < b.msg_id AND a.raw_hash <> b.raw_hash
        GROUP BY ALL) p ON p.kind = o.kind AND p.value = o.value AND p.is_sample = o.is_sample
    GROUP BY o.kind, o.value, o.is_sample""")
def shared(t):
    return I.shared(occurrences(t)).select("kind", "value", "is_sample", "messages", "hashes", "hub", "pairs")


@query("J04_links", f"""
    SELECT msg_id, min(msg_id) OVER w AS hub, kind, value, raw_hash, is_sample,
           CASE WHEN kind IN {STRONG} THEN 'candidate' ELSE 'context_only' END AS strength
    FROM v_occurrence WINDOW w AS (PARTITION BY kind, value, is_sample)
    QUALIFY min(raw_hash) OVER w <> max(raw_hash) OVER w""")
def links(t):
    return I.links(occurrences(t))


@query("J04_pairs_chosen", f"""
    WITH p AS (SELECT a.msg_id AS src, b.msg_id AS dst, a.kind, a.value FROM v_occurrence a JOIN v_occurrence b
               ON a.kind = b.kind AND a.value = b.value AND a.is_sample = b.is_sample AND a.msg_id <> b.msg_id AND a.raw_hash <> b.raw_hash
               WHERE a.msg_id % 100 = 0)
    SELECT src, dst, string_agg(kind || '=' || value, ';' ORDER BY kind, value) AS evidence,
           CASE WHEN bool_or(kind IN {STRONG}) THEN 'candidate' ELSE 'context_only' END AS strength FROM p GROUP BY src, dst""")
def pairs(t):
    joined = F.array_join(F.transform("evidence", lambda e: F.concat(e["kind"], F.lit("="), e["value"])), ";")
    chosen = t.message.filter(F.col("msg_id") % 100 == 0)
    return I.neighbours(occurrences(t), chosen).withColumn("evidence", joined)


@query("J08_history", f"""
    WITH o AS (SELECT * FROM v_occurrence WHERE kind IN {TRACKED})
    SELECT a.msg_id, a.kind, a.value, count(*) AS occurrence_count, epoch_us(min(b.created)) AS first_us,
           epoch_us(max(b.created)) AS last_us
    FROM o a JOIN o b ON a.kind = b.kind AND a.value = b.value AND a.msg_id <> b.msg_id GROUP BY a.msg_id, a.kind, a.value""")
def history(t):
    return I.history(occurrences(t)).select(
        "msg_id", "kind", "value", "occurrence_count", F.unix_micros("first_seen").alias("first_us"),
        F.unix_micros("last_seen").alias("last_us"))


@query("W06_recurrence", """
    SELECT msg_id, kind, value, count(*) OVER w AS prior_count, epoch_us(min(created) OVER w) AS first_us,
           epoch_us(max(created) OVER w) AS last_us
    FROM v_occurrence WINDOW w AS (PARTITION BY kind, value ORDER BY created, msg_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def recurrence(t):
    return I.recurrence(occurrences(t)).select(
        "msg_id", "kind", "value", "prior_count", F.unix_micros("prior_first").alias("first_us"),
        F.unix_micros("prior_last").alias("last_us"))


@query("A06_graph_nodes", "SELECT * FROM v_nodes")
def graph_nodes(t):
    return I.graph_nodes(indicators(t), t.message)


@query("A06_graph_edges", "SELECT * FROM v_edges")
def graph_edges(t):
    return I.graph_edges(indicators(t))


@query("A06_graph_type_counts", """
    SELECT type, count(*) AS nodes, count(DISTINCT node_id) AS node_ids FROM v_nodes GROUP BY type""")
def graph_type_counts(t):
    nodes = I.graph_nodes(indicators(t), t.message)
    per_id = nodes.groupBy("type", "node_id").agg(F.count(F.lit(1)).alias("n"))
    return per_id.groupBy("type").agg(F.sum("n").alias("nodes"), F.count(F.lit(1)).alias("node_ids"))


@query("P09_graph_slice", """
    WITH n AS (SELECT node_id FROM v_nodes WHERE type <> 'case' OR value LIKE '%1%')
    SELECT e.* FROM v_edges e WHERE source IN (SELECT node_id FROM n) AND target IN (SELECT node_id FROM n)
        AND target IN (SELECT node_id FROM v_nodes WHERE contains(lower(value), 'example'))""")
def graph_slice(t):
    ind = indicators(t)
    nodes, edges = I.graph_nodes(ind, t.message), I.graph_edges(ind)
    cases, _ = I.graph_slice(nodes, edges, "case", "1")
    named, _ = I.graph_slice(nodes, edges, "indicators", "example")
    kept = cases.unionByName(named).select("node_id")
    return (edges.join(kept.withColumnRenamed("node_id", "source"), "source", "left_semi")
            .join(kept.withColumnRenamed("node_id", "target"), "target", "left_semi")
            .select("source", "target", "confidence"))


@query("J21_neighbours", """
    WITH n AS (SELECT node_id FROM v_nodes WHERE type = 'reply_address')
    SELECT DISTINCT source AS node_id FROM v_edges WHERE target IN (SELECT node_id FROM n)""")
def neighbours(t):
    ind = indicators(t)
    nodes, _ = I.graph_slice(I.graph_nodes(ind, t.message), I.graph_edges(ind), "reply_address")
    return I.node_neighbours(I.graph_edges(ind), nodes)
