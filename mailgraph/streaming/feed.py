"""Change feed: ingest, de-duplication, retry table and routed micro-batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from mailgraph.operators import decisions as D
from mailgraph.operators import feedlog as L
from mailgraph.sources import sinks

RECORD_SCHEMA = "seq BIGINT, at TIMESTAMP, kind STRING, id STRING, payload STRING"


def read_changes(spark: SparkSession, folder: str, files_per_trigger: int = 100) -> DataFrame:
    """New message ids from both record types of a folder of JSON records. The checkpoint keeps the position, so a
    restart continues where it stopped."""
    stream = (
        spark.readStream.schema(RECORD_SCHEMA).option("maxFilesPerTrigger", files_per_trigger)
        .option("mode", "PERMISSIVE").json(folder))
    return stream.filter(F.col("kind").isin("added", "labelled"))


def once_per_id(changes: DataFrame, horizon: str = "1 hour") -> DataFrame:
    """Each id once within the horizon; state older than the watermark is dropped."""
    return changes.withWatermark("at", horizon).dropDuplicatesWithinWatermark(["id"])


def write_once(changes: DataFrame, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    writer = changes.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def retry_log(attempts: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append attempt outcomes by micro-batch. A replayed batch rewrites its own folder, so outcomes are not doubled."""
    def append(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
    return attempts.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def retry_queue(spark: SparkSession, path: str, newest: int | None = 100) -> DataFrame:
    """Ids still failing, folded from the log: the newest ones, as the report shows."""
    return L.retry_queue(spark.read.parquet(path), ["id"], newest)


def route(messages: DataFrame, score: Column, priority: Column, out: str, checkpoint: str) -> StreamingQuery:
    """Score each micro-batch and file it under hold or deliver. A row whose analysis gives no result is held; a failing
    batch is retried by the engine and overwrites its own folder."""
    def process(batch: DataFrame, batch_id: int) -> None:
        judged = batch.withColumn("score", F.coalesce(score, F.lit(100))).withColumn("priority", F.coalesce(priority, F.lit("urgent")))
        routed = D.delivery(judged)
        routed.write.mode("overwrite").partitionBy("route").parquet(f"{out}/batch={batch_id}")
    return messages.writeStream.foreachBatch(process).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def events_out(cases: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Metadata event lines of a stream of cases."""
    return (sinks.events(cases).writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def sliding_sessions(use: DataFrame, key: str, gap: str, late: str = "1 hour") -> DataFrame:
    """Sessions that each use extends; emitted when the watermark passes their expiry."""
    return L.sliding_sessions(use.withWatermark("ts", late), key, gap)


def ledger_updates(rows: DataFrame, late: str = "1 day") -> DataFrame:
    """Running (h, kind) counts of a stream of keyed indicator rows, for update mode."""
    return rows.withWatermark("at", late).groupBy("h", "kind").agg(
        F.min("at").alias("first_seen"), F.max("at").alias("last_seen"), F.count(F.lit(1)).alias("seen_count"))
