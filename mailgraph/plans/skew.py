"""Exact window results without putting one key's rows into one task.

A plain ``Window.partitionBy(key)`` sends every row of a key to one task. Each helper here takes a ``bucket`` column
that is monotone in the ordering (a time slice, an id range, a hash prefix). Rows are shuffled on ``(key, bucket)``;
only one summary row per ``(key, bucket)`` is ordered along the whole key, and its running result is joined back.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

def time_bucket(ts: Column, seconds: int) -> Column:
    return F.floor(F.unix_seconds(ts) / F.lit(seconds))


def id_bucket(seq: Column, width: int = 1 << 16) -> Column:
    return F.floor(seq / F.lit(width))


def hash_bucket(hex_digest: Column, digits: int = 3) -> Column:
    """Leading hex digits: monotone in the digest's string order and evenly filled."""
    return F.substring(hex_digest, 1, digits)


def _on(keys: Sequence[str]) -> list[str]:
    return [*keys, "_bucket"]


def ranked(df: DataFrame, keys: Sequence[str], order: Sequence[Column], bucket: Column, name: str = "rn",
           total: str | None = None) -> DataFrame:
    """``row_number()`` per key (and the key's row count as ``total``), with work split by bucket."""
    df = df.withColumn("_bucket", bucket)
    sizes = df.groupBy(*_on(keys)).agg(F.count(F.lit(1)).alias("_n"))
    along = Window.partitionBy(*keys).orderBy("_bucket")
    offsets = sizes.select(
        *_on(keys),
        (F.sum("_n").over(along) - F.col("_n")).alias("_offset"),
        F.sum("_n").over(Window.partitionBy(*keys)).alias("_total"),
    )
    local = F.row_number().over(Window.partitionBy(*_on(keys)).orderBy(*order))
    out = null_safe_join(df, offsets, _on(keys)).withColumn(name, (local + F.col("_offset")).cast("long"))
    if total:
        out = out.withColumn(total, F.col("_total"))
    return out.drop("_bucket", "_offset", "_total")


def running_before(df: DataFrame, keys: Sequence[str], order: Sequence[Column], bucket: Column, value: str,
                   prefix: str = "prior") -> DataFrame:
    """Count, min and max of ``value`` over all earlier rows of the key."""
    df = df.withColumn("_bucket", bucket)
    summary = df.groupBy(*_on(keys)).agg(
        F.count(F.lit(1)).alias("_n"), F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = summary.select(
        *_on(keys),
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n0"),
        F.min("_lo").over(before).alias("_lo0"),
        F.max("_hi").over(before).alias("_hi0"),
    )
    local = Window.partitionBy(*_on(keys)).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        null_safe_join(df, carried, _on(keys))
        .withColumn(f"{prefix}_count", (F.count(F.lit(1)).over(local) + F.col("_n0")).cast("long"))
        .withColumn(f"{prefix}_first", F.least(F.min(value).over(local), F.col("_lo0")))
        .withColumn(f"{prefix}_last", F.greatest(F.max(value).over(local), F.col("_hi0")))
        .drop("_bucket", "_n0", "_lo0", "_hi0")
    )


def running_sum(df: DataFrame, keys: Sequence[str], order: Sequence[Column], bucket: Column, value: Column,
                name: str) -> DataFrame:
    """Running total including the current row."""
    df = df.withColumn("_bucket", bucket).withColumn("_value", value)
    summary = df.groupBy(*_on(keys)).agg(F.sum("_value").alias("_s"))
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = summary.select(*_on(keys), F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_s0"))
    local = Window.partitionBy(*_on(keys)).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return (
        null_safe_join(df, carried, _on(keys))
        .withColumn(name, F.sum("_value").over(local) + F.col("_s0"))
        .drop("_bucket", "_value", "_s0")
    )


def running_max(df: DataFrame, keys: Sequence[str], order: Sequence[Column], bucket: Column, value: Column,
                name: str) -> DataFrame:
    """Running maximum including the current row."""
    df = df.withColumn("_bucket", bucket).withColumn("_value", value)
    summary = df.groupBy(*_on(keys)).agg(F.max("_value").alias("_m"))
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = summary.select(*_on(keys), F.max("_m").over(before).alias("_m0"))
    local = Window.partitionBy(*_on(keys)).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return (
        null_safe_join(df, carried, _on(keys))
        .withColumn(name, F.greatest(F.max("_value").over(local), F.col("_m0")))
        .drop("_bucket", "_value", "_m0")
    )


def previous(df: DataFrame, keys: Sequence[str], order_by: str, bucket: Column, values: dict[str, str]) -> DataFrame:
    """``lag(column)`` per key. ``values`` maps a column to the name of its lagged copy; order keys are unique."""
    df = df.withColumn("_bucket", bucket)
    tail = F.struct(*[F.col(c) for c in values])
    summary = df.groupBy(*_on(keys)).agg(F.max_by(tail, F.col(order_by)).alias("_tail"))
    carried = summary.select(*_on(keys), F.lag("_tail").over(Window.partitionBy(*keys).orderBy("_bucket")).alias("_tail0"))
    local = Window.partitionBy(*_on(keys)).orderBy(order_by)
    joined = null_safe_join(df, carried, _on(keys)).withColumn("_head", F.row_number().over(local) == 1)
    for column, name in values.items():
        joined = joined.withColumn(
            name, F.when(F.col("_head"), F.col("_tail0").getField(column)).otherwise(F.lag(column).over(local)))
    return joined.drop("_bucket", "_tail0", "_head")


def trailing_count(df: DataFrame, keys: Sequence[str], ts: str, seconds: int, name: str) -> DataFrame:
    """Rows of the key inside ``[ts - seconds, ts]``.

    Slices are as wide as the window, so a row needs its own slice and the one before; each row is also sent one slice
    ahead as context. No task holds more than two slices of a key.
    """
    micros = F.unix_micros(F.col(ts))
    width = seconds * 1_000_000
    slice_no = F.floor(micros / F.lit(width))
    spread = (
        df.withColumn("_us", micros)
        .withColumn("_copy", F.explode(F.array(F.lit(0), F.lit(1))))
        .withColumn("_slice", slice_no + F.col("_copy"))
    )
    frame = Window.partitionBy(*keys, "_slice").orderBy("_us").rangeBetween(-width, 0)
    counted = spread.withColumn(name, F.count(F.lit(1)).over(frame))
    return counted.filter(F.col("_copy") == 0).drop("_us", "_copy", "_slice")


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, name: str = "rn") -> DataFrame:
    """First ``k`` rows per key. Spark limits each map task to ``k`` rows per key before the shuffle."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(name, F.row_number().over(window)).filter(F.col(name) <= k)


def null_safe_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "left") -> DataFrame:
    """Join on equal keys where NULL equals NULL, keeping one copy of the keys."""
    renamed = right.select(*[F.col(c).alias(f"_r_{c}") for c in on],
                           *[F.col(c) for c in right.columns if c not in on])
    condition = None
    for c in on:
        clause = F.col(c).eqNullSafe(F.col(f"_r_{c}"))
        condition = clause if condition is None else condition & clause
    return left.join(renamed, condition, how).drop(*[f"_r_{c}" for c in on])
