"""Quality rules as weak supervision (DataFrame functions only).

Eight rules each vote good, bad or abstain on a document. Expectation-maximisation estimates, without labels, how each rule votes on
good and on bad documents; a document's posterior probability of being good replaces an all-must-pass filter. The rules' votes are
counted by pattern, at most ``3 ** 8`` rows whatever the corpus size, and only those counts reach the driver; the posterior is then a
sum of literals per vote inside the projection.

Everything about one text is computed from that text's arrays in one row: there is no shuffle of words. Three-word windows are compared by
a 64-bit hash. Null texts have no words. Texts without words fail the base rules. Repeated rows and ids get equal results; empty tables
give empty results.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mailgraph.llm.registry import documents, query
from mailgraph.plans import lineage

WORD = r"[^\x20\x09-\x0D]+"
SYMBOL = r"[#*$%&|<>]"
ROUNDS = 60
SMOOTHING = 1.0
PRIOR = 0.85
#: what one bad vote leaves of the prior when the estimation starts
START = 0.3
#: words of letters with at most one closing mark
PLAIN = r"(?<![^\x20\x09-\x0D])\p{L}++[.,;:?]?(?![^\x20\x09-\x0D])"

#: rule: the measure, the bound on the good side (None: the rule never votes good), the bound on the bad side; else it abstains
RULES: dict[str, tuple[str, float | None, float]] = {
    "symbols": ("n_symbols / n_words", None, 0.15),
    "odd_words": ("1 - n_plain / n_words", 0.10, 0.40),
    "dup_lines": ("n_dup_lines / n_lines", None, 0.50),
    "repeats": ("n_repeat_words / n_words", 0.10, 0.35),
    "capitals": ("n_capitals / word_chars", None, 0.45),
    "exclaims": ("n_exclaims / n_words", None, 0.25),
    "long_words": ("abs(word_chars / n_words - 5.5)", 2.5, 5.0),
    "variety": ("1 - n_distinct / n_words", 0.65, 0.85),
}


def _windows(words: Column) -> Column:
    """A hash of each three-word window, in order."""
    n = F.size(words)
    triples = F.arrays_zip(words.alias("a"), F.slice(words, F.lit(2), n).alias("b"), F.slice(words, F.lit(3), n).alias("c"))
    return F.transform(F.slice(triples, F.lit(1), F.greatest(n - 2, F.lit(0))), lambda t: F.xxhash64(t["a"], t["b"], t["c"]))


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the measures the base rules and the votes are made of, one row per input row.

    Repeated windows: hashes are sorted, and only texts where one appears twice sort windows with their places. A place counts when a
    neighbour in that order has its hash; in order of place, it covers ``min(3, distance to the next)`` words.
    """
    text = F.col("_text")
    base = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"))
    worded = base.select("doc_id", "_text", F.regexp_extract_all(text, F.lit(WORD), F.lit(0)).alias("_words"))
    n = F.size("_words")
    hashed = worded.select(
        "doc_id", n.cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        F.size(F.array_distinct("_words")).cast("long").alias("n_distinct"),
        F.regexp_count(text, F.lit(SYMBOL)).cast("long").alias("n_symbols"),
        F.regexp_count(text, F.lit(r"\p{Lu}")).cast("long").alias("n_capitals"),
        F.regexp_count(text, F.lit("!")).cast("long").alias("n_exclaims"),
        F.regexp_count(text, F.lit(PLAIN)).cast("long").alias("n_plain"),
        F.filter(F.split(text, "\n", -1), lambda line: line.rlike(WORD)).alias("_lines"),
        F.when(n >= 4, _windows(F.col("_words"))).alias("_hashes"))
    ordered = hashed.select("*", F.array_sort("_hashes").alias("_sorted"))
    twice = F.size("_sorted") > F.size(F.array_distinct("_sorted"))
    # (hash, place) in order, only where some hash appears twice
    placed = ordered.select("*", F.when(twice, F.array_sort(F.arrays_zip(
        F.col("_hashes").alias("h"), F.sequence(F.lit(0), F.size("_hashes") - 1).alias("i")))).alias("_placed"))
    size = F.size("_placed")
    repeated = F.filter(
        F.transform(F.col("_placed"), lambda x, i: F.when(
            ((i > 0) & (F.get(F.col("_placed"), i - 1)["h"] == x["h"])) | ((i < size - 1) & (F.get(F.col("_placed"), i + 1)["h"] == x["h"])), x["i"])),
        lambda p: p.isNotNull())
    covered = placed.select("*", F.array_sort(repeated).alias("_places"))
    places = F.col("_places")
    gaps = F.aggregate(
        F.zip_with(places, F.slice(places, F.lit(2), F.greatest(F.size(places), F.lit(0))), lambda a, b: F.least(F.coalesce(b - a, F.lit(3)), F.lit(3))),
        F.lit(0).cast("long"), lambda total, step: total + step)
    return covered.select(
        "doc_id", "n_words", "word_chars", "n_distinct", "n_symbols", "n_capitals", "n_exclaims", "n_plain",
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.col("_placed").isNotNull(), gaps).otherwise(F.lit(0).cast("long")).alias("n_repeat_words"))


def votes(measured: DataFrame) -> DataFrame:
    """Adds one column per rule: 1 good, -1 bad, 0 abstains (also where the measure has no value)."""
    columns = []
    for name, (measure, good, bad) in RULES.items():
        value = F.expr(re.sub(r"/ (\w+)", r"/ nullif(\1, 0)", measure))
        vote = F.when(value >= bad, -1)
        columns.append((vote if good is None else vote.when(value <= good, 1)).otherwise(0).alias(f"vote_{name}"))
    return measured.select("*", *columns)


def estimate(patterns: list[tuple[tuple[int, ...], int]], rounds: int = ROUNDS) -> tuple[float, list[dict[int, float]]]:
    """Expectation-maximisation over vote patterns: (log odds of good, per rule the log likelihood ratio of each vote).

    Starts from the prior, cut by every bad vote, so "good" keeps its meaning; counts are smoothed by one.
    """
    rules = len(RULES)
    posterior = [PRIOR * START ** sum(v < 0 for v in pattern) for pattern, _ in patterns]
    ratio = [dict.fromkeys((-1, 0, 1), 0.0) for _ in range(rules)]
    odds = math.log(PRIOR / (1 - PRIOR))
    for _ in range(rounds):
        total = [SMOOTHING, SMOOTHING]
        seen = [[{v: SMOOTHING for v in (-1, 0, 1)} for _ in range(rules)] for _ in range(2)]
        for (pattern, count), p in zip(patterns, posterior, strict=True):
            for y, share in ((1, p * count), (0, (1 - p) * count)):
                total[y] += share
                for j, v in enumerate(pattern):
                    seen[y][j][v] += share
        odds = math.log(total[1] / total[0])
        for j in range(rules):
            sums = [sum(seen[y][j].values()) for y in range(2)]
            ratio[j] = {v: math.log(seen[1][j][v] / sums[1]) - math.log(seen[0][j][v] / sums[0]) for v in (-1, 0, 1)}
        posterior = [1 / (1 + math.exp(-max(-500.0, min(500.0, odds + sum(ratio[j][v] for j, v in enumerate(pattern)))))) for pattern, _ in patterns]
    return odds, ratio


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """One row per document: measures, votes, base_failed, quality (posterior) and kept."""
    voted = lineage.cut(votes(measures(docs, id_col, text_col)))
    names = [f"vote_{name}" for name in RULES]
    counted = voted.groupBy(*names).agg(F.count(F.lit(1)).alias("_n")).collect()  # at most 3 ** len(RULES) rows
    odds, ratio = estimate(sorted((tuple(row[n] for n in names), row["_n"]) for row in counted)) if counted else (0.0, [dict.fromkeys((-1, 0, 1), 0.0)] * len(RULES))
    logit = F.lit(odds)
    for name, weights in zip(names, ratio, strict=True):
        logit = logit + F.when(F.col(name) > 0, weights[1]).when(F.col(name) < 0, weights[-1]).otherwise(weights[0])
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return voted.select("*", failed.alias("base_failed"), (1 / (1 + F.exp(-logit))).alias("quality")).withColumn(
        "kept", ~F.col("base_failed") & (F.col("quality") >= threshold))


@query("op7_quality")
def op7_quality(spark: SparkSession, folder: str) -> DataFrame:
    return judge(documents(spark, folder)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality")
