import json
import os
from datetime import datetime, timedelta, timezone

from pyspark.sql import functions as F

from mailgraph.operators import feedlog as L
from mailgraph.sources import feeds, mail, sinks
from mailgraph.streaming import feed, state

START = datetime(2024, 1, 1, tzinfo=timezone.utc)


def write_batches(folder, rows, parts=3):
    folder.mkdir()
    for p in range(parts):
        chunk = rows[p * len(rows) // parts:(p + 1) * len(rows) // parts]
        file = folder / f"{p}.json"
        file.write_text("\n".join(json.dumps(r) for r in chunk))
        os.utime(file, (1_700_000_000 + p, 1_700_000_000 + p))  # the file source takes the oldest first


def test_changes_are_taken_once(spark, tmp_path):
    rows = [{"seq": i, "at": (START + timedelta(seconds=i)).isoformat(), "kind": ["added", "labelled", "other"][i % 3], "id": f"m{i % 7}", "payload": ""} for i in range(40)]
    write_batches(tmp_path / "in", rows)
    changes = feed.once_per_id(feed.read_changes(spark, str(tmp_path / "in"), 1))
    feed.write_once(changes, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    got = [r.id for r in spark.read.parquet(str(tmp_path / "out")).collect()]
    assert sorted(got) == [f"m{i}" for i in range(7)]


def test_retry_queue(spark, tmp_path):
    rows = [{"seq": i, "id": key, "outcome": outcome} for i, (key, outcome) in enumerate(
        [("a", "transient")] * 5 + [("b", "transient"), ("b", "cleared"), ("b", "transient"), ("c", "transient"), ("c", "cleared")])]
    write_batches(tmp_path / "in", rows)
    stream = spark.readStream.schema("seq BIGINT, id STRING, outcome STRING").option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    feed.retry_log(stream, str(tmp_path / "log"), str(tmp_path / "state")).awaitTermination()
    got = {r.id: (r.attempts, r.state) for r in feed.retry_queue(spark, str(tmp_path / "log")).collect()}
    assert got == {"a": (5, "exhausted"), "b": (1, "queued")}
    delays = [r[0] for r in spark.range(1, 13).select(L.backoff_seconds(F.col("id"))).collect()]
    assert delays[:3] == [5, 10, 20] and max(delays) == 300


def test_chain_across_batches_equals_batch_chain(spark, tmp_path):
    from mailgraph.operators import audit as A
    rows = [{"session_id": i % 2, "seq": i, "payload": f"p{i}"} for i in range(30)]
    write_batches(tmp_path / "in", rows)
    schema = "session_id BIGINT, seq BIGINT, payload STRING"
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    state.append_chain(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option(
        "checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).select("session_id", "seq", "payload", "previous", "hash")
    want = A.chain(spark.createDataFrame([(r["session_id"], r["seq"], r["payload"]) for r in rows], schema))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_rejected_requests_use_no_budget(spark):
    rows = [("p", START + timedelta(seconds=s), i) for i, s in enumerate([0, 10, 20, 30, 61, 62, 71, 72])]
    out = L.admit(spark.createDataFrame(rows, "peer string, at timestamp, request long"), 2, 60).orderBy("request").collect()
    assert [r.accepted for r in out] == [True, True, False, False, True, False, True, False]


def test_routes(spark, tmp_path):
    rows = [{"msg_id": i, "value": v} for i, v in enumerate([10, 70, None, 60])]
    write_batches(tmp_path / "in", rows)
    stream = spark.readStream.schema("msg_id BIGINT, value DOUBLE").json(str(tmp_path / "in"))
    feed.route(stream, F.col("value"), F.lit("routine"), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    got = {r.msg_id: r.route for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {0: "deliver", 1: "hold", 2: "hold", 3: "hold"}


MAIL = """From: Ann <ann@corp.test>
To: bob@corp.test
Subject: Hi
Content-Type: multipart/mixed; boundary=b

--b
Content-Type: text/html

<p>See <a href="https://a.test/x">https://b.test</a> and https://c.test/y.</p><script>var z</script>
--b
Content-Type: application/octet-stream
Content-Disposition: attachment; filename="x.exe"

MZdata
--b--
"""


def test_mail_ingest(spark, tmp_path):
    (tmp_path / "1.eml").write_text(MAIL)
    (tmp_path / "2.eml").write_text("Subject: no sender\n\nbody")
    (tmp_path / "3.eml").write_bytes(b"From: a@b.test\n\n" + b"x" * (1024 * 1024))
    out = mail.tables(mail.parse(mail.read_raw(spark, str(tmp_path), most_bytes=1024 * 1024)).cache())
    assert {(r.reject, r.files) for r in out["rejects"].collect()} == {("missing From", 1), ("size", 1)}
    row = out["messages"].first()
    assert row.subject == "Hi" and "var z" not in row.body
    assert [(r.url, r.shown) for r in out["links"].orderBy("pos").collect()] == [("https://a.test/x", "https://b.test"), ("https://b.test", ""), ("https://c.test/y", "")]
    assert out["parts"].first().name == "x.exe" and out["headers"].count() == 4


def test_feed_snapshot(spark, tmp_path):
    import bz2
    text = ("phish_id,url,phish_detail_url,submission_time,verified,verification_time,online,target\n"
            "1,http://A.test,d,s,yes,t1,yes,x\n2,http://a.test/,d,s,yes,t2,yes,x\n3,http://b.test/,d,s,no,t,yes,x\nx4,http://c.test/,d,s,yes,t,yes,x\n")
    (tmp_path / "f.csv.bz2").write_bytes(bz2.compress(text.encode()))
    rows = feeds.read_feed(spark, str(tmp_path / "f.csv.bz2"))
    entries = feeds.snapshot(rows, F.col("phish_id"))
    assert [(r.record_id, r.verified_at) for r in entries.collect()] == [("2", "t2")]
    assert feeds.publish(entries.limit(0), str(tmp_path / "v"), "1") is None
    assert feeds.publish(entries, str(tmp_path / "v"), "2")
    meta = spark.createDataFrame([("feed", 100, None)], "source string, fetched_at long, source_modified long")
    as_of = F.timestamp_seconds(F.lit(200))
    assert feeds.quality(entries, meta, as_of, "feed").first().usable
    assert not feeds.quality(entries, meta, as_of, "other").first().usable
    (tmp_path / "ips.txt").write_text("; comment\n1.2.3.0/24 ; SBL1\n# x\nnot-an-ip\n9.9.9.9\n")
    assert {r.cidr for r in feeds.read_ranges(spark, str(tmp_path / "ips.txt"), "f").collect()} == {"1.2.3.0/24", "9.9.9.9"}


def test_csv_cells_are_neutralised(spark):
    df = spark.createDataFrame([("=1+1",), (" @x",), ("-2",), ("ok",), (None,)], "v string")
    assert [r[0] for r in df.select(sinks.safe_cell(F.col("v"))).collect()] == ["'=1+1", "' @x", "'-2", "ok", ""]


def test_large_mail_is_read_whole_by_default(spark, tmp_path):
    (tmp_path / "1.eml").write_bytes(b"From: a@b.test\nSubject: big\n\n" + b"word " * (2 * 1024 * 1024 // 5))
    out = mail.tables(mail.parse(mail.read_raw(spark, str(tmp_path))).cache())
    assert out["rejects"].count() == 0 and out["messages"].selectExpr("length(body)").first()[0] > 2_000_000
