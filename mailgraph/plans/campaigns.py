"""Candidate campaigns: all correlation evidence, joined into connected components."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailgraph.operators import components, similarity
from mailgraph.operators import indicators as I
from mailgraph.plans import lineage


def similarity_links(message: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(members, near-duplicate pairs, hybrid pairs) between representatives of equal texts."""
    texts = similarity.texts(message)
    reps = similarity.representatives(texts)
    near = similarity.jaccard_pairs(reps)
    # only the strong tier groups messages
    hybrid = similarity.hybrid_pairs(texts, reps, near, similarity.COSINE_STRONG, similarity.SIMHASH_STRONG)
    return lineage.cut(similarity.members_of(texts, reps)), near, hybrid  # members are read several times below, texts only once


def strong_links(message: DataFrame, occurrence: DataFrame) -> DataFrame:
    """(src, dst) links strong enough to group messages, in linear size."""
    members, near, hybrid = similarity_links(message)
    pairs = near.select("src", "dst").unionByName(hybrid.filter("tier = 'strong'").select("src", "dst"))
    strong = lineage.cut(occurrence.filter(F.col("kind").isin(*I.STRONG)))
    shared = I.links(strong).select(
        F.col("hub").alias("src"), F.col("msg_id").alias("dst"))
    return similarity.family_links(members, pairs).unionByName(shared)


def campaigns(message: DataFrame, occurrence: DataFrame) -> DataFrame:
    return components.campaign_summary(components.campaign_members(strong_links(message, occurrence), message))
