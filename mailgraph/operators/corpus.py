"""Labelled-corpus preparation: de-duplication, label conflicts, stratified splits, leakage checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailgraph.functions import text as T
from mailgraph.plans import skew

SPLITS = ("train", "validation", "test")


def labelled(documents: DataFrame, labels: DataFrame, label: str = "quality") -> DataFrame:
    """Documents with a usable binary label."""
    usable = labels.filter(F.col(label).isin(0, 1)).select("doc_id", F.col(label).alias("label"))
    return documents.join(usable, "doc_id").select(F.col("doc_id").alias("msg_id"), "text", "source", "lang", "label")


def pooled(*sources: DataFrame) -> DataFrame:
    """One corpus from several files with the same columns; rows without a binary label are left out."""
    out = sources[0]
    for other in sources[1:]:
        out = out.unionByName(other)
    return out.filter(F.col("label").isin(0, 1))


def with_key(corpus: DataFrame, *columns: str) -> DataFrame:
    """Adds ``key``, the digest of the normalised text: everything later shuffles 64 characters instead of the text."""
    return corpus.withColumn("key", F.sha2(T.dedup_key(*[F.col(c) for c in columns or ("text",)]), 256))


def families(keyed: DataFrame) -> DataFrame:
    """One row per normalised text: first id, copies, label range. Map-side combined, so a hot text costs one row per task."""
    return keyed.groupBy("key").agg(
        F.min("msg_id").alias("first_id"), F.count(F.lit(1)).alias("copies"),
        F.min("label").alias("label_min"), F.max("label").alias("label_max"))


def label_conflicts(keyed: DataFrame) -> DataFrame:
    return families(keyed).filter(F.col("label_min") != F.col("label_max")).select("key", "first_id", "copies")


def without_conflicts(keyed: DataFrame) -> DataFrame:
    return keyed.join(label_conflicts(keyed).select("key"), "key", "left_anti")


def deduplicated(keyed: DataFrame) -> DataFrame:
    """First row (lowest id) of every text whose copies agree on the label."""
    keep = families(keyed).filter(F.col("label_min") == F.col("label_max"))
    return keyed.join(keep.select(F.col("first_id").alias("msg_id")), "msg_id", "left_semi")


def seeded_order(seed: int, identity: Column) -> Column:
    return F.sha2(F.concat(F.lit(f"{seed}:"), identity.cast("string")), 256)


def stratified_split(corpus: DataFrame, seed: int = 42, label: str = "label", identity: str = "msg_id") -> DataFrame:
    """Exact 80/10/10 per label in a seeded order.

    The rank inside a label is taken over hash-prefix buckets: two labels would otherwise mean two tasks.
    """
    ordered = corpus.withColumn("_order", seeded_order(seed, F.col(identity)))
    ranked = skew.ranked(ordered, [label], [F.col("_order")], skew.hash_bucket(F.col("_order")), "_rn", "_n")
    split = (
        F.when(F.col("_rn") * 10 <= F.col("_n") * 8, "train")
        .when(F.col("_rn") * 10 <= F.col("_n") * 9, "validation").otherwise("test"))
    return ranked.withColumn("split", split).drop("_order", "_rn", "_n")


def split_overlap(split: DataFrame, key: str = "key") -> DataFrame:
    """Keys shared by each pair of splits; one aggregation instead of three intersections."""
    bit = F.when(F.col("split") == "train", 1).when(F.col("split") == "validation", 2).otherwise(4)
    seen = split.groupBy(key).agg(F.bit_or(bit).alias("mask"))
    both = lambda mask: F.count_if(F.col("mask").bitwiseAND(mask) == mask)
    counts = seen.agg(both(3).alias("train_validation"), both(5).alias("train_test"), both(6).alias("validation_test"))
    return counts.select(F.expr(
        "stack(3, 'train-validation', train_validation, 'train-test', train_test, 'validation-test', validation_test)"
        " AS (pair, shared_keys)"))


def require_disjoint(split: DataFrame, key: str = "key") -> None:
    worst = split_overlap(split, key).agg(F.max("shared_keys")).first()[0]
    if worst:
        raise ValueError(f"splits share {worst} normalised texts")


def leakage(split: DataFrame, include_validation: bool = False) -> tuple[DataFrame, DataFrame]:
    """Test rows whose masked template occurs in training (leaked) and the others (novel)."""
    pool = ("train", "validation") if include_validation else ("train",)
    known = split.filter(F.col("split").isin(*pool)).select("template").distinct()
    test = split.filter(F.col("split") == "test")
    return test.join(known, "template", "left_semi"), test.join(known, "template", "left_anti")


def leakage_report(split: DataFrame) -> DataFrame:
    """Counts and shares of leaked and novel test rows for both sibling pools, from one aggregation per template."""
    is_ = lambda name: F.col("split") == name
    per = split.groupBy("template").agg(
        F.count_if(is_("train")).alias("train"), F.count_if(is_("validation")).alias("validation"),
        F.count_if(is_("test")).alias("test"))
    totals = per.agg(
        F.sum("test").alias("test_rows"),
        F.sum(F.when(F.col("train") > 0, F.col("test")).otherwise(0)).alias("leaked_train"),
        F.sum(F.when(F.col("train") + F.col("validation") > 0, F.col("test")).otherwise(0)).alias("leaked_both"))
    rows = totals.select("test_rows", F.expr("stack(2, 'train', leaked_train, 'train+validation', leaked_both) AS (pool, leaked)"))
    return rows.select(
        "pool", "test_rows", "leaked", (F.col("test_rows") - F.col("leaked")).alias("novel"),
        F.round(100.0 * F.col("leaked") / F.nullif(F.col("test_rows"), F.lit(0)), 6).alias("leaked_pct"))


def with_template(corpus: DataFrame, column: str = "text") -> DataFrame:
    return corpus.withColumn("template", T.template_signature(F.col(column)))


def template_families(corpus: DataFrame, column: str = "text", minimum: int = 2) -> DataFrame:
    return (
        with_template(corpus, column).groupBy("template")
        .agg(F.count(F.lit(1)).alias("rows"), F.min("msg_id").alias("first_id"), F.max("msg_id").alias("last_id"))
        .filter(F.col("rows") >= minimum))


def seeded_sample(df: DataFrame, group: str, n: int, seed: int = 42, identity: str = "msg_id") -> DataFrame:
    """``n`` rows per group in a seeded order, with how many were available and used."""
    order = seeded_order(seed, F.col(identity))
    picked = skew.top_k(df.withColumn("_order", order), [group], [F.col("_order")], n, "sample_rank").drop("_order")
    sizes = df.groupBy(group).agg(F.count(F.lit(1)).alias("available"))
    return picked.join(sizes, group).withColumn("used", F.least(F.col("available"), F.lit(n)))
