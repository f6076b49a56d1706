"""Exact duplicate removal with a heavy-hitter split (DataFrame functions only).

Rows are reduced to a SHA-256 digest of their text. ``approx_top_k`` keeps a Misra-Gries style summary with a fixed number of
counters and names the digests that may be frequent; their exact counts and winners are verified in a map-side combined
aggregation and broadcast (at most ``winners`` rows, whatever the corpus size), so no copy of a frequent text is shuffled.
Every other digest covers at most about ``1 / winners`` of the rows and goes through an ordinary shuffle.

Null texts count as empty texts and are equal to each other. The largest id stays; a null id loses to any other, and of rows that
repeat both id and text exactly one stays. Empty tables give empty results. Other columns are never looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mailgraph.llm.registry import documents, query
from mailgraph.plans import lineage

WINNERS = 8192
COUNTERS = 32768


def _digest(text: str) -> Column:
    return F.unhex(F.sha2(F.coalesce(F.col(text).cast("string"), F.lit("")), 256))


def frequent_digests(rows: DataFrame, winners: int = WINNERS, counters: int = COUNTERS) -> DataFrame:
    """(_digest, _n, _keep) of the verified frequent digests: at most ``winners`` rows.

    The summary's estimate only proposes; ``_n`` and ``_keep`` (the largest id and row tag) are exact.
    """
    summary = rows.agg(
        F.expr(f"approx_top_k(hex(_digest), {winners}, {counters})").alias("_top"), F.count(F.lit(1)).alias("_total"))
    proposed = (
        summary.select(F.explode("_top").alias("_t"), "_total")
        .filter((F.col("_t.count") > 1) & (F.col("_t.count") * winners >= F.col("_total")))
        .select(F.unhex("_t.item").alias("_digest")))
    return (
        rows.join(F.broadcast(proposed), "_digest", "left_semi")
        .groupBy("_digest").agg(F.count(F.lit(1)).alias("_n"), F.max(F.struct("_id", "_row")).alias("_keep")))


def decisions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256."""
    rows = lineage.cut(docs.select(
        F.col(id_col).alias("_id"), _digest(text_col).alias("_digest"), F.monotonically_increasing_id().alias("_row")))
    heavy = lineage.cut(frequent_digests(rows))
    joined = rows.join(F.broadcast(heavy.select("_digest", "_n", "_keep")), "_digest", "left")
    same = Window.partitionBy("_digest")
    rest = (
        joined.filter(F.col("_n").isNull()).drop("_n", "_keep")
        .withColumn("_n", F.count(F.lit(1)).over(same)).withColumn("_keep", F.max(F.struct("_id", "_row")).over(same)))
    both = joined.filter(F.col("_n").isNotNull()).select("_id", "_digest", "_row", "_n", "_keep").unionByName(
        rest.select("_id", "_digest", "_row", "_n", "_keep"))
    return both.select(
        F.col("_id").alias("doc_id"), F.col("_keep._id").alias("keep_id"), F.col("_n").cast("long").alias("group_size"),
        (F.col("_row") == F.col("_keep._row")).alias("kept"), F.lower(F.hex("_digest")).alias("text_sha256"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, with one row for each distinct text.

    Copies of frequent texts that cannot win are dropped before the shuffle; a final row number settles the rest and the ties.
    """
    columns = docs.columns
    tagged = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("_doc"), F.col(id_col).alias("_id"), _digest(text_col).alias("_digest"))
    narrow = lineage.cut(tagged.select("_id", "_digest", F.lit(0).alias("_row")))
    heavy = lineage.cut(frequent_digests(narrow))
    left = tagged.join(F.broadcast(heavy.select("_digest", F.col("_keep._id").alias("_best"))), "_digest", "left").filter(
        F.col("_best").isNull() | (F.col("_id") == F.col("_best")))
    order = Window.partitionBy("_digest").orderBy(F.col("_id").desc_nulls_last())
    return left.withColumn("_rank", F.row_number().over(order)).filter("_rank = 1").select("_doc.*")


@query("op1_exact_dedup", """
    SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
           doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
    FROM documents WINDOW same AS (PARTITION BY sha256(coalesce(text, '')))""")
def op1_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return decisions(documents(spark, folder))
