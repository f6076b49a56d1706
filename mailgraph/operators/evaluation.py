"""Classifier evaluation: rule reports, confusion tables, calibration, robustness, latency."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mailgraph.plans import skew



def case_rules() -> dict[str, Column]:
    return {
        "score_ge_25": F.col("score") >= 25,
        "score_ge_45": F.col("score") >= 45,
        "hold": (F.col("score") >= 60) | (F.col("priority") == "urgent"),
        "model_phishing": F.col("label") == "phishing",
    }


def apply_rules(case: DataFrame, rules: Mapping[str, Column], *keep: str) -> DataFrame:
    """Long (rule, flagged) rows: every predicate over every case in one pass."""
    pairs = F.array(*[F.struct(F.lit(n).alias("rule"), F.coalesce(c, F.lit(False)).alias("flagged")) for n, c in rules.items()])
    return case.select(*keep, F.explode(pairs).alias("r")).select(*keep, "r.*")


def ratio(top: Column, bottom: Column) -> Column:
    """Share with the reports' convention that an empty base gives 0."""
    return F.when(bottom == 0, F.lit(0.0)).otherwise(top / bottom)


def rule_metrics(flagged: DataFrame, positive: str = "positive") -> DataFrame:
    """Confusion counts, precision, recall, F1 and false-positive rate per rule."""
    yes, hit = F.col(positive), F.col("flagged")
    counts = flagged.groupBy("rule").agg(
        F.count_if(yes & hit).alias("tp"), F.count_if(yes & ~hit).alias("fn"),
        F.count_if(~yes & hit).alias("fp"), F.count_if(~yes & ~hit).alias("tn"))
    precision, recall = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return counts.withColumn("precision", precision).withColumn("recall", recall).withColumn(
        "f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))).withColumn(
        "false_positive_rate", ratio(F.col("fp"), F.col("fp") + F.col("tn")))


def flagged_by_corpus(flagged: DataFrame, corpus: str) -> DataFrame:
    return flagged.groupBy("rule", corpus).agg(F.count_if("flagged").alias("flagged"), F.count(F.lit(1)).alias("evaluated"))


def confusion(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("actual", "predicted").agg(F.count(F.lit(1)).alias("n"))


def per_class(pairs: DataFrame) -> DataFrame:
    """Recall, precision and support per class, and the overall accuracy, from the confusion counts."""
    def side(cls: str, support: Column, guessed: Column, hits: Column) -> Column:
        return F.struct(F.col(cls).alias("cls"), support.alias("support"), guessed.alias("guessed"), hits.alias("hits"))

    none, n = F.lit(0).cast("long"), F.col("n")
    hit = F.when(F.col("actual") == F.col("predicted"), n).otherwise(none)
    sides = confusion(pairs).select(F.explode(F.array(side("actual", n, none, hit), side("predicted", none, n, none))).alias("s"))
    marginals = sides.groupBy("s.cls").agg(F.sum("s.support").alias("support"), F.sum("s.guessed").alias("guessed"), F.sum("s.hits").alias("hits"))
    every = Window.partitionBy()  # one row per class
    return marginals.select(
        "cls", "support", ratio(F.col("hits"), F.col("support")).alias("recall"), ratio(F.col("hits"), F.col("guessed")).alias("precision"),
        (F.sum("hits").over(every) / F.sum("support").over(every)).alias("accuracy"))


def clipped(p: Column, epsilon: float = 1e-12) -> Column:
    return F.least(F.greatest(p, F.lit(epsilon)), F.lit(1 - epsilon))


def log_loss(p: Column, y: Column) -> Column:
    return -(y * F.log(clipped(p)) + (1 - y) * F.log(1 - clipped(p)))


def brier_and_nll(prediction: DataFrame) -> DataFrame:
    p, y = F.col("p"), F.col("label")
    return prediction.agg(F.avg(F.pow(p - y, F.lit(2))).alias("brier"), F.avg(log_loss(p, y)).alias("nll"), F.count(F.lit(1)).alias("n"))


def reliability(prediction: DataFrame, bins: int = 10) -> DataFrame:
    """Mean prediction and observed share per bin; p = 1 falls in the last bin, empty bins stay with NULL means."""
    binned = prediction.groupBy(F.least(F.floor(F.col("p") * bins), F.lit(bins - 1)).cast("int").alias("bin")).agg(
        F.count(F.lit(1)).alias("count"), F.avg("p").alias("mean_predicted"), F.avg("label").alias("positive_fraction"))
    every = prediction.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(F.broadcast(binned), "bin", "left").withColumn("count", F.coalesce("count", F.lit(0)))  # at most ``bins`` rows


def temperature_grid(prediction: DataFrame, low: float = 0.5, high: float = 5.0, step: float = 0.02) -> DataFrame:
    """Mean log loss per temperature: every prediction meets the short grid inside its task, sums combine map-side."""
    steps = round((high - low) / step)
    grid = F.array(*[F.lit(round(low + i * step, 2)) for i in range(steps + 1)])
    p = clipped(F.col("p"))
    logits = prediction.select("label", F.log(p / (1 - p)).alias("z")).groupBy("label", "z").agg(F.count(F.lit(1)).alias("n"))
    tried = logits.select("label", "z", "n", F.explode(grid).alias("temperature"))
    loss = log_loss(1 / (1 + F.exp(-F.col("z") / F.col("temperature"))), F.col("label"))
    return tried.groupBy("temperature").agg((F.sum(loss * F.col("n")) / F.sum("n")).alias("nll"))


def fit_temperature(prediction: DataFrame, **grid: float) -> DataFrame:
    """The first temperature with the least log loss, and whether scaling by it is worth keeping."""
    best = temperature_grid(prediction, **grid).agg(F.min(F.struct("nll", "temperature")).alias("b"))
    temperature = best.select("b.temperature").scalar()
    p = clipped(F.col("p"))
    scaled = prediction.select("label", "p", (1 / (1 + F.exp(-F.log(p / (1 - p)) / temperature))).alias("q"))
    squared = lambda c: F.avg(F.pow(F.col(c) - F.col("label"), F.lit(2)))
    out = scaled.agg(squared("p").alias("raw_brier"), squared("q").alias("scaled_brier"))
    return out.select(temperature.alias("temperature"), best.select("b.nll").scalar().alias("nll"), "raw_brier", "scaled_brier").withColumn(
        "accepted", (F.col("raw_brier") - F.col("scaled_brier") >= 0.001) & F.col("temperature").between(0.05, 20.0))


def auc(prediction: DataFrame, buckets: int = 4096) -> DataFrame:
    """ROC area by average ranks, and metrics at 0.5. Equal scores are merged, then ranked over score buckets."""
    scores = prediction.groupBy("p").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("pos"))
    summed = skew.running_sum(scores, [], [F.col("p")], F.floor(F.col("p") * buckets), F.col("n"), "upto")
    mean_rank = F.col("upto") - F.col("n") + (F.col("n") + 1) / 2
    area = summed.agg(F.sum(mean_rank * F.col("pos")).alias("ranks"), F.sum("pos").alias("pos"), F.sum("n").alias("n"))
    negatives = F.col("n") - F.col("pos")
    area = area.select(((F.col("ranks") - F.col("pos") * (F.col("pos") + 1) / 2) / (F.col("pos") * negatives)).alias("auc"))
    at_half = apply_rules(prediction.withColumn("positive", F.col("label") == 1), {"p_ge_half": F.col("p") >= 0.5}, "positive")
    metrics = rule_metrics(at_half).withColumn("accuracy", (F.col("tp") + F.col("tn")) / (F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn")))
    return metrics.select(area.scalar().alias("auc"), "accuracy", "precision", "recall", "f1")


def subset_comparison(scored: DataFrame) -> DataFrame:
    """Accuracy of two subsets (``leaked`` true / false) with the normal-approximation interval of their difference."""
    per = scored.agg(
        F.count_if("leaked").alias("n_a"), F.count_if(~F.col("leaked")).alias("n_b"),
        F.count_if(F.col("leaked") & F.col("correct")).alias("c_a"), F.count_if(~F.col("leaked") & F.col("correct")).alias("c_b"))
    a, b = F.col("c_a") / F.nullif("n_a", F.lit(0)), F.col("c_b") / F.nullif("n_b", F.lit(0))
    margin = 1.96 * F.sqrt(a * (1 - a) / F.col("n_a") + b * (1 - b) / F.col("n_b")) * 100
    difference = (a - b) * 100
    return per.select("n_a", "n_b", a.alias("accuracy_a"), b.alias("accuracy_b"), difference.alias("difference"),
                      (difference - margin).alias("low"), (difference + margin).alias("high"))


def latency(timing: DataFrame, group: str, value: str = "value", bucket_width: float = 1.0) -> DataFrame:
    """Distribution of a measure per group: min, mean, deviation, median and index-based 90/95/99 percentiles.

    Equal values are counted, then ranked over value buckets; a percentile is the value whose rank range covers its
    index, so no group is gathered and sorted in one task.
    """
    counted = timing.groupBy(group, value).agg(F.count(F.lit(1)).alias("n"))
    ranked = skew.running_sum(counted, [group], [F.col(value)], F.floor(F.col(value) / bucket_width), F.col("n"), "upto")
    basic = timing.groupBy(group).agg(
        F.count(F.lit(1)).alias("n_total"), F.min(value).alias("min"), F.max(value).alias("max"), F.avg(value).alias("mean"),
        F.stddev_samp(value).alias("stdev"))
    joined = ranked.join(basic.select(group, "n_total"), group)
    at = lambda index: F.max(F.when((F.col("upto") > index) & (F.col("upto") - F.col("n") <= index), F.col(value)))
    n = F.col("n_total")
    points = joined.groupBy(group).agg(
        ((at(F.floor((n - 1) / 2)) + at(F.floor(n / 2))) / 2).alias("median"),
        *[at(F.floor(n * q / 100)).alias(f"p{q}") for q in (90, 95, 99)])
    return basic.join(points, group)


# ---- attribution confidence --------------------------------------------------------------------------------------

# Weights of the positive factors and of the penalties.
FACTORS = {
    "receiver_attested": 35, "spf_aligned": 10, "dkim_aligned": 10, "dmarc_pass": 10, "domain_registration": 10,
    "no_header_conflicts": 10, "ip_reputation_available": 10, "geolocation_available": 5, "arc_chain_valid": 10,
}
PENALTIES = {"tor_exit_match": 25, "hosting_or_proxy_ip": 15, "newly_registered_domain": 10, "arc_chain_failed": 15}
CONFLICT_STEP, CONFLICT_MOST = 10, 30
UNDETERMINED_CAP = 20


def attribution_factors() -> dict[str, tuple[int, Column]]:
    """Signed weight and condition of every factor over the columns of an origin-evidence row."""
    known_age = F.coalesce(F.col("registration_available"), F.lit(False)) & F.col("domain_age_days").isNotNull()
    conditions = {
        "receiver_attested": F.col("origin_confidence") == "authenticated_observation",
        "spf_aligned": F.col("spf_aligned"), "dkim_aligned": F.col("dkim_aligned"), "dmarc_pass": F.col("dmarc") == "pass",
        "domain_registration": known_age & (F.col("domain_age_days") >= 30),
        "no_header_conflicts": F.col("checks_done") & (F.col("hops") > 0) & (F.col("conflicts") == 0),
        "ip_reputation_available": F.col("ip_available"), "geolocation_available": F.col("geo_available"),
        "arc_chain_valid": F.col("arc") == "pass",
        "tor_exit_match": F.col("tor_match"), "hosting_or_proxy_ip": F.col("anonymised"),
        "newly_registered_domain": known_age & (F.col("domain_age_days") < 30), "arc_chain_failed": F.col("arc") == "fail",
    }
    weights = {**FACTORS, **{name: -weight for name, weight in PENALTIES.items()}}
    return {name: (weights[name], F.coalesce(condition, F.lit(False))) for name, condition in conditions.items()}


def attribution(evidence: DataFrame) -> DataFrame:
    """Confidence score, band and the explanation rows (factor, weight, applied) of each message."""
    factors = attribution_factors()
    total = reduce(lambda a, b: a + b, [F.when(condition, weight).otherwise(0) for weight, condition in factors.values()])
    penalty = F.least(F.lit(CONFLICT_MOST), F.coalesce("conflicts", F.lit(0)) * CONFLICT_STEP)
    raw = F.greatest(F.lit(0), total - penalty)
    undetermined = F.coalesce(F.col("origin_confidence") == "undetermined", F.lit(True))
    score = F.least(F.lit(100), F.when(undetermined, F.least(raw, F.lit(UNDETERMINED_CAP))).otherwise(raw)).cast("int")
    explained = F.array(
        *[F.struct(F.lit(name).alias("factor"), F.lit(weight).alias("weight"), condition.alias("applied"))
          for name, (weight, condition) in factors.items()],
        F.struct(F.lit("header_conflicts").alias("factor"), (-penalty).cast("int").alias("weight"), (penalty > 0).alias("applied")))
    out = evidence.withColumn("attribution_score", score).withColumn("factors", explained)
    return out.withColumn("band", F.when(score < 35, "low").when(score < 70, "moderate").otherwise("high"))


def ordering_check(scored: DataFrame, ordering: DataFrame) -> DataFrame:
    """Does each stronger scenario outscore its weaker one? ``ordering`` holds (stronger, weaker)."""
    side = lambda name: scored.select(F.col("scenario").alias(name), F.col("attribution_score").alias(f"{name}_score"))
    return ordering.join(side("stronger"), "stronger").join(side("weaker"), "weaker").withColumn(
        "holds", F.col("stronger_score") > F.col("weaker_score"))


# ---- text windows and perturbations ------------------------------------------------------------------------------

# Window geometry, filler text and substitutions of the robustness tests.
WINDOW_TOKENS, WINDOW_OVERLAP = 254, 32
FILLER = ("Thank you for your continued business with our team. We appreciate your patience while we process this routine matter. "
          "Please let us know if you have any questions about our regular update.")
SYNONYMS = (
    ("verify", "confirm"), ("urgent", "time-sensitive"), ("immediately", "without delay"), ("password", "passcode"),
    ("click here", "follow this link"), ("account", "profile"), ("suspended", "restricted"),
    ("update your information", "refresh your details"), ("confirm your identity", "validate who you are"), ("act now", "respond promptly"),
)


def token_windows(df: DataFrame, tokens: Column, *keep: str, content: int = WINDOW_TOKENS, overlap: int = WINDOW_OVERLAP,
                  most: int | None = None) -> DataFrame:
    """(window, tokens, covered, complete): overlapping windows over all tokens, or over the first ``most`` windows."""
    step = max(1, content - overlap)
    n = F.size("_tokens")
    count = F.when(n <= content, 1).otherwise(F.ceil((n - content) / step) + 1).cast("int")
    used = F.least(count, F.lit(most)) if most else count
    base = df.select(*keep, tokens.alias("_tokens")).withColumn("_used", used).withColumn("complete", used == count)
    covered = F.least(n, (F.col("_used") - 1) * step + content)
    return base.withColumn("covered", covered).withColumn("window", F.explode(F.sequence(F.lit(0), F.col("_used") - 1))).select(
        *keep, "window", F.slice("_tokens", F.col("window") * step + 1, F.lit(content)).alias("tokens"), "covered", "complete",
        F.col("_used").alias("windows"))


def worst_window(windows: DataFrame, score: Column, *keys: str) -> DataFrame:
    """Per message: the first window with the highest score. Only (score, window) is shuffled."""
    return windows.select(*keys, "window", "windows", "covered", "complete", score.alias("_s")).groupBy(
        *keys, "windows", "covered", "complete").agg(F.max(F.struct("_s", (-F.col("window")).alias("_w"))).alias("_m")).select(
        *keys, "windows", "covered", "complete", F.col("_m._s").alias("score"), (-F.col("_m._w")).alias("triggering_window"))


def filler(words: int) -> str:
    base = FILLER.split()
    return " ".join(base[i % len(base)] for i in range(words))


def perturbations(text: Column, extra_words: int = 400) -> dict[str, Column]:
    substituted = text
    for word, replacement in SYNONYMS:
        substituted = F.regexp_replace(substituted, f"(?i)\\b{word}\\b", replacement)
    return {
        "none": text,
        "pad": F.concat(text, F.lit("\n" + filler(extra_words))),
        "truncation_shift": F.concat(F.lit(filler(extra_words) + "\n"), text),
        "keyword_substitution": substituted,
    }


def robustness(df: DataFrame, text: str, scorer, threshold: float, sample: int, identity: str = "msg_id", group: str = "grp",
               seed: int = 42, extra_words: int = 400) -> DataFrame:
    """Share of detected texts still detected after each attack, with the true totals.

    ``scorer`` maps a text column to a score column. The sample is seeded; totals count every row. Every text is scored once, into a table without the
    texts; those that can be in the sample, by the last place of it in each group, are scored a second time.
    """
    from mailgraph.operators import corpus
    from mailgraph.plans import lineage, skew
    order = corpus.seeded_order(seed, F.col(identity))
    scored = lineage.cut(df.select(F.col(group).alias("_grp"), order.alias("_order"), scorer(F.col(text)).alias("_base")))
    total = lambda c: scored.agg(c.alias("n")).scalar()
    first = skew.top_k(scored.filter(F.col("_base") >= threshold), ["_grp"], [F.col("_order")], sample)
    last = first.groupBy("_grp").agg(F.max("_order").alias("_last"))
    within = (F.col(group) == F.col("_grp")) & (order.isNull() | (order <= F.col("_last")))
    # written first, as a filter by score would be pushed below the join and score every text again
    near = lineage.cut(df.join(F.broadcast(last), within, "left_semi")).withColumn("_base", scorer(F.col(text)))
    picked = corpus.seeded_sample(near.filter(F.col("_base") >= threshold), group, sample, seed, identity)
    attacks = F.array(*[F.struct(F.lit(n).alias("attack"), c.alias("attacked")) for n, c in perturbations(F.col(text), extra_words).items()])
    attacked = picked.select(identity, "_base", F.explode(attacks).alias("a")).select("_base", "a.attack", scorer(F.col("a.attacked")).alias("_after"))
    return attacked.groupBy("attack").agg(
        F.count(F.lit(1)).alias("tested"), F.count_if(F.col("_after") >= threshold).alias("retained"),
        F.avg(F.col("_base") - F.col("_after")).alias("mean_drop"),
    ).withColumn("scanned", total(F.count(F.lit(1)))).withColumn("detected", total(F.count_if(F.col("_base") >= threshold))).withColumn(
        "evaded", F.col("tested") - F.col("retained"))
