"""Findings of messages, their stable ids and the capped, explainable score."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mailgraph.functions import hosts
from mailgraph.functions.rules import GROUP_CAPS

HIGH, REVIEW = 60, 25
HIGH_MODEL = 90


def alignment(auth: DataFrame) -> DataFrame:
    """Adds ``spf_aligned``, ``dkim_aligned`` (NULL = unknown) and ``dmarc``: an aligned pass wins, an incomplete check
    keeps the verdict unknown, only complete checks without a pass fail."""
    def aligned(status: str, same: str, unknown: tuple[str, ...]) -> Column:
        passed = (F.col(status) == "pass") & F.col(same)
        return F.when(passed, True).when(F.col(status).isin(*unknown), F.lit(None).cast("boolean")).otherwise(False)
    out = auth.withColumn("spf_aligned", aligned("spf", "spf_domain_aligned", ("unknown", "temperror"))).withColumn(
        "dkim_aligned", aligned("dkim", "dkim_domain_aligned", ("unknown",)))
    incomplete = F.col("spf").isin("unknown", "temperror") | (F.col("dkim") == "unknown")
    passed = F.coalesce(F.col("spf_aligned"), F.lit(False)) | F.coalesce(F.col("dkim_aligned"), F.lit(False))
    return out.withColumn("dmarc", F.when(passed, "pass").when(incomplete, "unknown").otherwise("fail"))


def authenticated() -> Column:
    return (F.col("dmarc") == "pass") | ((F.col("dkim") == "pass") & (F.col("spf") == "pass"))


def high_model() -> Column:
    return (F.col("status") == "ready") & F.col("probability").between(HIGH_MODEL, 100) & ~authenticated()


def scan_urls(url: DataFrame) -> DataFrame:
    """Adds reasons and the structure score of each link."""
    reasons = url.withColumn("reasons", hosts.url_reasons(F.col("url"), F.col("shown")))
    return reasons.withColumn("score", hosts.url_score(F.col("url"), F.col("reasons")))


def top_urls(candidates: DataFrame, limit: int = 50) -> DataFrame:
    """Distinct links per message, first seen by (priority, pos), the first ``limit``: a bounded list per message."""
    first = candidates.groupBy("msg_id", "url").agg(F.min(F.struct("priority", "pos")).alias("seen"))
    order = Window.partitionBy("msg_id").orderBy("seen", "url")
    return first.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit).select(
        "msg_id", "url", F.col("seen.priority").alias("priority"), "rank")


def _finding(grp: str, title: str, detail: Column, points: int) -> Column:
    return F.struct(F.lit(grp).alias("grp"), F.lit(title).alias("title"), detail.alias("detail"), F.lit(points).alias("points"))


def structural(message: DataFrame, auth: DataFrame, model: DataFrame, url: DataFrame, attachment: DataFrame) -> DataFrame:
    """(msg_id, grp, title, detail, points) from headers, authentication, links, attachments and the model.

    ``auth`` carries ``dmarc``; ``url`` carries reasons, score and feed status.
    """
    sender, reply = hosts.domain(F.col("sender")), hosts.domain(F.col("reply_to"))
    case = message.join(auth, "msg_id").join(model, "msg_id")
    status = lambda name: F.concat(F.lit(f"{name} "), F.col(name))
    per_message = F.array_compact(F.array(
        F.when((sender != "") & (reply != "") & (hosts.registrable(sender) != hosts.registrable(reply)), _finding(
            "identity", "Reply-To domain differs", F.concat(sender, F.lit(" versus "), reply), 20)),
        F.when(sender.contains("xn--"), _finding("identity", "Internationalized sender domain", sender, 10)),
        F.when(F.col("dkim") == "fail", _finding("authentication", "DKIM signature failed", status("dkim"), 15)),
        F.when(F.col("spf") == "fail", _finding("authentication", "SPF evaluation failed", status("spf"), 15)),
        F.when(F.col("dmarc") == "fail", _finding("authentication", "DMARC alignment failed", status("dmarc"), 20)),
        F.when(high_model(), _finding(
            "language", "High model phishing probability", F.lit("Independent model evidence"), 30)),
    ))
    out = case.select("msg_id", F.explode(per_message).alias("f")).select("msg_id", "f.*")
    links = F.array_compact(F.array(
        F.when(F.col("score") >= 40, _finding("links", "Suspicious URL structure", F.array_join("reasons", "; "), 10)),
        F.when(F.col("feed_status") == "listed", _finding("reputation", "Feed URL match", F.col("record_id"), 60)),
        F.when(F.col("feed_status") == "listed_stale", _finding("reputation", "Historical feed match", F.col("record_id"), 25)),
    ))
    out = out.unionByName(url.select("msg_id", F.explode(links).alias("f")).select("msg_id", "f.*"))
    risky = attachment.filter("warning").select("msg_id").distinct()
    return out.unionByName(risky.select("msg_id", _finding(
        "attachments", "Active-content attachment extension", F.lit("Inventoried, not executed"), 15).alias("f")).select("msg_id", "f.*"))


def lookalike_findings(url: DataFrame, lookalike: DataFrame) -> DataFrame:
    """One identity finding for each host of a message that imitates a brand; ``lookalike`` holds (host, brand, why)."""
    return url.select("msg_id", "host").distinct().join(lookalike, "host").select("msg_id", _finding(
        "identity", "Look-alike domain", F.concat("host", F.lit(" resembles "), "brand", F.lit(": "), "why"), 15).alias("f")).select("msg_id", "f.*")


def with_ids(findings: DataFrame, category: str = "grp") -> DataFrame:
    """Stable 16-digit id: digest of category, title, detail and the number of equal findings before it in the message."""
    basis = F.concat_ws("|", F.coalesce(category, F.lit("")), F.coalesce("title", F.lit("")), F.coalesce("detail", F.lit("")))
    keyed = findings.withColumn("_basis", basis)
    occurrence = F.row_number().over(Window.partitionBy("msg_id", "_basis").orderBy("points")) - 1
    return keyed.withColumn("occurrence", occurrence).withColumn(
        "finding_id", F.substring(F.sha2(F.concat_ws("|", "_basis", "occurrence"), 256), 1, 16)).drop("_basis")


def group_scores(message: DataFrame, findings: DataFrame, caps: Mapping[str, int] = GROUP_CAPS) -> DataFrame:
    """(msg_id, grp, points) capped per group, with a zero row for every group a message has no finding in."""
    cap = F.create_map(*[F.lit(x) for pair in caps.items() for x in pair])
    every = message.select("msg_id", F.explode(F.array(*[F.lit(g) for g in caps])).alias("grp"))
    summed = findings.groupBy("msg_id", "grp").agg(F.sum("points").alias("sum"))
    return every.join(summed, ["msg_id", "grp"], "left").select(
        "msg_id", "grp", F.least(F.coalesce("sum", F.lit(0)), cap[F.col("grp")]).cast("int").alias("points"))


def scores(message: DataFrame, findings: DataFrame, caps: Mapping[str, int] = GROUP_CAPS) -> DataFrame:
    """(msg_id, score, risk, group_points): one aggregation over (message, group) and one over the message."""
    cap = F.create_map(*[F.lit(x) for pair in caps.items() for x in pair])
    groups = findings.groupBy("msg_id", "grp").agg(F.sum("points").alias("sum"))
    total = groups.groupBy("msg_id").agg(F.sum(F.least(F.col("sum"), cap[F.col("grp")])).alias("total"))
    score = F.least(F.lit(100), F.coalesce("total", F.lit(0))).cast("int")
    return message.select("msg_id").join(total, "msg_id", "left").select("msg_id", score.alias("score")).withColumn(
        "risk", F.when(F.col("score") >= HIGH, "High").when(F.col("score") >= REVIEW, "Review").otherwise("Low"))
