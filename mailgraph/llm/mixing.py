"""Mixing sources to target token weights by Efraimidis-Spirakis sampling.

Each source gets a target: the corpus size shared by weight, no source above ``most`` times its own size, the excess reshared among
the others until none is above (a water level over one row per source). A source whose target exceeds its size first takes complete
epochs. The rest of the budget is drawn without replacement: a document's key is ``-ln(u) / quality`` with ``u`` from a hash of its
id, documents are taken in key order, and the prefix sum of sizes stops at the budget. A document is taken when at least half of it
fits, so a source misses its target by at most half a document.

Keys are cut into fixed slices, so a source with a third of all rows is sorted by many tasks; only slice sums are ordered along a source. The slices
are equal parts of a mixture of the key's distributions at ten qualities: whatever the qualities in a source, no slice is expected to hold more
than ten times its even share.

Null texts have size 0 and are never taken. A null source is a source of its own, after all others. Rows with equal ids share a number ``u`` and, with
equal keys, are ordered by size; the draw depends on ids and texts alone, so reruns agree. Null ids share a ``u`` as well. Very long texts are counted whole;
one longer than what is left of a budget is taken if at least half of it fits. Columns are named by the caller; others never matter. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mailgraph.llm.registry import documents, query
from mailgraph.plans import lineage

WORD = r"[^\x20\x09-\x0D]+"
#: characters that ordinary prose rarely holds
NOISE = r"[#*$%&|<>{}=~^_@0-9!]"
WEIGHTS = (1, 2, 3)
MOST = 3.0
SLICES = 16_384
#: a text's quality is no less
LEAST_QUALITY = 0.1
SALT = "mix"


def quality(text: Column) -> Column:
    """Sampling weight of a document, 0.1 to 1: less for texts full of symbols and digits."""
    noise = F.regexp_count(text, F.lit(NOISE)) / F.greatest(F.length(text), F.lit(1))
    return F.greatest(F.lit(LEAST_QUALITY), F.lit(1.0) - F.lit(5.0) * noise)


def slice_of(key: Column, count: int = SLICES) -> Column:
    """Which of ``count`` slices a sample key falls into: rising with the key. At quality q keys are exponential with rate q."""
    rates = [LEAST_QUALITY + (1 - LEAST_QUALITY) * i / 9 for i in range(10)]
    later = F.lit(0.0)
    for rate in rates:
        later = later + F.exp(-key * F.lit(rate))
    return F.floor((F.lit(1.0) - later / F.lit(float(len(rates)))) * F.lit(count)).cast("int")


def uniform(id_col: Column, salt: str = SALT) -> Column:
    """A number strictly between 0 and 1 from the id: 52 bits of its SHA-256."""
    digits = F.substring(F.sha2(F.concat(F.lit(salt), F.coalesce(id_col.cast("string"), F.lit(""))), 256), 1, 13)
    return (F.conv(digits, 16, 10).cast("double") + F.lit(0.5)) / F.lit(2.0 ** 52)


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, most: float = MOST) -> DataFrame:
    """(source, source_size, target) from one row (source, source_size) per source."""
    everything = Window.partitionBy()
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    before = Window.orderBy("_ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    return (
        sizes.withColumn("_w", weight)
        .withColumn("_ratio", F.lit(most) * F.col("source_size") / F.col("_w"))
        .withColumn("_left", F.sum("source_size").over(everything) - F.lit(most) * F.coalesce(F.sum("source_size").over(before), F.lit(0)))
        .withColumn("_share", F.sum("_w").over(everything) - F.coalesce(F.sum("_w").over(before), F.lit(0.0)))
        .withColumn("_level", F.col("_left") / F.col("_share"))
        # the first source, by ratio, that is below its bound gives the level of all that are
        .withColumn("_open", F.max(F.when(F.col("_ratio") > F.col("_level"), F.col("_level"))).over(everything))
        .select("source", "source_size", F.least(F.lit(most) * F.col("source_size"), F.coalesce(F.col("_open") * F.col("_w"), F.lit(most) * F.col("source_size"))).alias("target")))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, epochs (times it is taken), taken, sample_key."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = lineage.cut(docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"),
        (-F.ln(uniform(F.col(id_col))) / quality(text)).alias("sample_key")))
    plan = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size"))).select(
        F.col("source").alias("_source"), "source_size", "target",
        F.coalesce(F.floor(F.col("target") / F.nullif(F.col("source_size"), F.lit(0))), F.lit(0)).cast("long").alias("_full"))
    sliced = rows.withColumn("_slice", slice_of(F.col("sample_key")))
    sums = sliced.groupBy("source", "_slice").agg(F.sum("size").alias("_sum"))
    earlier = Window.partitionBy("source").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(F.col("source").alias("_s"), F.col("_slice").alias("_c"), F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("source", "_slice").orderBy("sample_key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    drawn = (
        sliced.withColumn("_within", F.sum("size").over(inside))
        .join(offsets, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_slice") == F.col("_c")))
        .join(plan, F.col("source").eqNullSafe(F.col("_source"))))
    reached = F.col("_before") + F.col("_within") - F.col("size") / F.lit(2.0)
    chosen = (F.col("size") > 0) & (reached <= F.col("target") - F.col("_full") * F.col("source_size"))
    return drawn.withColumn("epochs", F.when(F.col("size") > 0, F.col("_full") + chosen.cast("long")).otherwise(F.lit(0).cast("long"))).select(
        "doc_id", "source", "size", "source_size", "target", "epochs", (F.col("size") * F.col("epochs")).alias("taken"), "sample_key")


def mixed_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mixed corpus: the rows of ``docs``, each as often as the mix takes it.

    Rows are matched by id; of rows that repeat an id, each is taken as often as the largest of them.
    """
    times = mix(docs, id_col, text_col, source_col).groupBy(F.col("doc_id").alias("_id")).agg(F.max("epochs").cast("int").alias("_times")).filter("_times > 0")
    doc = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc")
    return (
        docs.select(doc, F.col(id_col).alias("_key")).join(times, F.col("_key").eqNullSafe(F.col("_id")))
        .select("_doc", F.explode(F.array_repeat(F.lit(0), F.col("_times"))).alias("_copy")).select("_doc.*"))


CHECK = r"""
    WITH rows AS (
      SELECT doc_id, source, coalesce(text, '') AS t,
             length(regexp_replace(regexp_replace(coalesce(text, ''), '[^\x20\x09-\x0D]+', 'x', 'g'), '[\x20\x09-\x0D]', '', 'g')) AS size
      FROM documents),
    keyed AS (
      SELECT doc_id, source, size,
             -ln((CAST('0x' || substr(sha256('mix' || CAST(doc_id AS VARCHAR)), 1, 13) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE)
             / greatest(0.1::DOUBLE, 1.0::DOUBLE - 5.0::DOUBLE * (length(regexp_replace(t, '[^#*$%&|<>{}=~^_@0-9!]', '', 'g')) / greatest(length(t), 1)::DOUBLE)) AS k
      FROM rows),
    weighed AS (
      SELECT source, source_size, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::DOUBLE AS w
      FROM (SELECT source, sum(size)::BIGINT AS source_size FROM rows GROUP BY source)),
    levels AS (
      SELECT *, 3.0::DOUBLE * source_size / w AS ratio FROM weighed),
    filled AS (
      SELECT *, (sum(source_size) OVER () - 3.0::DOUBLE * coalesce(sum(source_size) OVER b, 0))
                / (sum(w) OVER () - coalesce(sum(w) OVER b, 0)) AS level
      FROM levels WINDOW b AS (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    plan AS (
      SELECT source, source_size,
             least(3.0::DOUBLE * source_size, coalesce(max(CASE WHEN ratio > level THEN level END) OVER () * w, 3.0::DOUBLE * source_size)) AS target
      FROM filled),
    drawn AS (
      SELECT k.doc_id, k.size, p.source_size, p.target, coalesce(floor(p.target / nullif(p.source_size, 0)), 0)::BIGINT AS epochs,
             sum(k.size) OVER (PARTITION BY k.source ORDER BY k.k, k.doc_id, k.size ROWS UNBOUNDED PRECEDING) AS reached
      FROM keyed k JOIN plan p ON k.source IS NOT DISTINCT FROM p.source)
    SELECT doc_id, size, source_size, target,
           (size * (epochs + CASE WHEN size > 0 AND reached - size / 2.0::DOUBLE <= target - epochs * source_size THEN 1 ELSE 0 END))::BIGINT AS taken
    FROM drawn"""


@query("op6_mixing", CHECK)
def op6_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mix(documents(spark, folder)).select("doc_id", "size", "source_size", "target", "taken")
