"""Queries that run the streaming operators over the tables with ``availableNow`` and read what they wrote."""

import uuid

from pyspark.sql import functions as F

from mailgraph.operators import feedlog as L
from mailgraph.plans import lineage
from mailgraph.plans.registry import query
from mailgraph.sources import mail
from mailgraph.streaming import feed, state


def scratch(t) -> str:
    return f"{lineage.ensure_checkpoint_dir(t.spark)}/stream-{uuid.uuid4().hex}"


def event_stream(t):
    """The events file as a stream, with the case id as the message id."""
    static = t.read("events")
    stream = t.spark.readStream.schema(static.schema).parquet(f"{t.folder}/events.parquet*")
    return stream.withColumn("at", F.col("ts").cast("timestamp"))


def finished(t, stream, mode: str = "append"):
    folder = scratch(t)
    stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").outputMode(
        mode).trigger(availableNow=True).start().awaitTermination()
    return t.spark.read.parquet(f"{folder}/out")


@query("X02_stream_claims", "SELECT DISTINCT user_id::VARCHAR || '/' || json_extract_string(props, '$.k') AS id FROM events")
def stream_claims(t):
    ids = F.concat_ws("/", F.col("user_id").cast("string"), F.get_json_object("props", "$.k"))
    return finished(t, feed.once_per_id(event_stream(t).select("at", ids.alias("id")), "40 days").select("id"))


@query("X05_stream_chain", "SELECT session_id, seq, payload, previous, hash FROM v_chain")
def stream_chain(t):
    action = F.when(F.col("event_type") == "signup", "analyze").when(F.col("event_type") == "view", "note").when(
        F.col("event_type") == "click", "assign").when(F.col("event_type") == "purchase", "review").otherwise("delete")
    events = event_stream(t).select(
        F.col("user_id").alias("session_id"), F.col("event_id").alias("seq"),
        F.concat_ws("|", F.col("event_id").cast("string"), action, F.get_json_object("props", "$.k")).alias("payload"))
    return finished(t, state.append_chain(events))


@query("X06_stream_ledger", """
    SELECT 'u' || user_id AS h, event_type AS kind, epoch_us(min(ts)) AS first_us, epoch_us(max(ts)) AS last_us, count(*) AS seen_count FROM events GROUP BY ALL""")
def stream_ledger(t):
    rows = event_stream(t).select(F.concat(F.lit("u"), "user_id").alias("h"), F.col("event_type").alias("kind"), "at")
    folder = scratch(t)

    def keep(batch, batch_id):
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch={batch_id}")

    state.ledger(rows, 90 * 86400).writeStream.foreachBatch(keep).option("checkpointLocation", f"{folder}/state").outputMode(
        "update").trigger(availableNow=True).start().awaitTermination()
    # the last batch that touched an entry holds its state: one that expired and came back counts anew
    latest = t.spark.read.parquet(f"{folder}/out").groupBy("h", "kind").agg(
        F.max_by(F.struct("first_seen", "last_seen", "seen_count", "expired"), F.struct("batch", ~F.col("expired"))).alias("e")).filter("NOT e.expired")
    return latest.select("h", "kind", F.unix_micros("e.first_seen").alias("first_us"), F.unix_micros("e.last_seen").alias("last_us"), "e.seen_count")


@query("X08_stream_routes", """
    SELECT CASE WHEN value >= 60 OR event_type = 'error' THEN 'hold' ELSE 'deliver' END AS route, count(*) AS messages FROM events GROUP BY 1""")
def stream_routes(t):
    folder = scratch(t)
    events = event_stream(t).select(F.col("event_id").alias("msg_id"), "value", "event_type")
    feed.route(events, F.col("value"), F.when(F.col("event_type") == "error", "urgent").otherwise("routine"), f"{folder}/out",
               f"{folder}/state").awaitTermination()
    return t.spark.read.parquet(f"{folder}/out").groupBy("route").agg(F.count(F.lit(1)).alias("messages"))


ADMIT = 3
WIDTH = 86400


ADMITTED = f"""
    WITH o AS (SELECT user_id, event_id, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
    w AS (SELECT user_id, event_id, us, rn, [us] AS acc, true AS accepted FROM o WHERE rn = 1
          UNION ALL SELECT o.user_id, o.event_id, o.us, o.rn,
              CASE WHEN len(list_filter(w.acc, lambda x: x > o.us - {WIDTH}000000)) < {ADMIT}
                   THEN list_append(list_filter(w.acc, lambda x: x > o.us - {WIDTH}000000), o.us) ELSE list_filter(w.acc, lambda x: x > o.us - {WIDTH}000000) END,
              len(list_filter(w.acc, lambda x: x > o.us - {WIDTH}000000)) < {ADMIT}
          FROM w JOIN o ON o.user_id = w.user_id AND o.rn = w.rn + 1)
    SELECT user_id::VARCHAR AS peer, event_id AS request, accepted FROM w"""


@query("X09_admission", ADMITTED)
def admission(t):
    requests = t.events.select(F.col("user_id").cast("string").alias("peer"), F.col("ts").alias("at"), F.col("event_id").alias("request"))
    return L.admit(requests, ADMIT, WIDTH).select("peer", "request", "accepted")


@query("X09_stream_admission", ADMITTED)
def stream_admission(t):
    requests = event_stream(t).select(F.col("user_id").cast("string").alias("peer"), "at", F.col("event_id").alias("request"))
    return finished(t, state.admit(requests, ADMIT, WIDTH)).select("peer", "request", "accepted")


@query("S01_mail_ingest", """
    SELECT 'm' || msg_id AS path, CASE WHEN lang = 'es' THEN 'missing From' END AS reject, CASE WHEN lang <> 'es' THEN 'Notice ' || msg_id END AS subject,
           CASE WHEN lang <> 'es' THEN sender END AS sender, CASE WHEN lang <> 'es' THEN 4 END AS headers, CASE WHEN lang <> 'es' THEN sha256(body) END AS body_digest
    FROM v_message""")
def mail_ingest(t):
    lines = F.concat_ws("\n", F.when(F.col("lang") != "es", F.concat(F.lit("From: "), "sender")), F.concat(F.lit("Subject: Notice "), "msg_id"),
                        F.lit("Content-Type: text/plain; charset=utf-8"), F.lit("Content-Transfer-Encoding: 8bit"), F.lit(""), F.col("body"))
    raw = t.message.select(F.concat(F.lit("m"), "msg_id").alias("path"), F.encode(lines, "UTF-8").alias("content"), F.lit(False).alias("too_large"))
    return mail.parse(raw).select("path", "reject", "subject", "sender", F.when(F.col("headers").isNotNull(), F.size("headers")).alias("headers"),
                                  F.sha2("body", 256).alias("body_digest"))
