"""Decision tables over findings, scores, authentication and model output."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailgraph.operators.scoring import authenticated, high_model

# Titles and wording the decision tables look for.
DECEPTIVE = "Displayed URL differs from destination"
FEED_TITLES = ("Feed URL match", "Historical feed match")
PHISHING_TITLES = (*FEED_TITLES, "Credential pressure", "QR code in attachment decodes to a link", "Suspicious URL structure")
NEED_SUPPORT = ("Suspicious URL structure", "QR code in attachment decodes to a link")
SUPPORT = ("Credential pressure", "Look-alike domain", "Account-expiry pressure")
FRAUD_TITLES = ("Payment diversion", "Verification avoidance")
IMPERSONATION_TITLES = ("Homoglyph display name", "Look-alike domain", "Display-name brand spoofing",
                        "Protected identity address mismatch", "Protected-domain resemblance")
MISMATCH_TITLES = ("Reply-To domain differs", "Return-Path domain differs")
URGENCY = (r"(?i)expired|expires? today|today|immediately|within \d+ ?(?:hours?|hrs)|24 hours|1 day|suspend|deactivat|is full"
           r"|not delivered|were held|are held")
FILE_SHARE = (r"(?i)\b(?:shared (?:document|file|folder)|document (?:has been )?shared|view (?:the )?(?:document|file)"
              r"|secure document|onedrive|sharepoint|google docs?)\b")
MAILBOX_LURE = (r"(?i)\b(?:mailbox|quota|storage|voicemail|voice mail|e-?fax|delivery failure|undelivered|failed delivery"
                r"|messages? held|incoming messages?)\b")
PAYMENT_NOTICE = r"(?i)\b(?:invoice|payment notification|remittance|statement|purchase order|po attached|billing notice)\b"
FRAUD_WORDS = ("gift card", "advance fee", "lottery", "inheritance", "blackmail", "extortion", "bitcoin ransom")


def case_facts(message: DataFrame, score: DataFrame, findings: DataFrame, auth: DataFrame, model: DataFrame,
               url: DataFrame) -> DataFrame:
    """One row per message: score, titles, authentication, model and link facts. Every table is keyed by ``msg_id``, so
    the shuffles share one partitioning; the arrays are bounded by a message's own findings."""
    per = findings.groupBy("msg_id").agg(
        F.array_sort(F.collect_set("title")).alias("titles"),
        F.array_sort(F.collect_set(F.when(F.col("points") > 0, F.col("title")))).alias("scored_titles"))
    links = url.groupBy("msg_id").agg(
        F.count(F.lit(1)).alias("links"), F.bool_or(F.array_contains("reasons", DECEPTIVE)).alias("deceptive_link"),
        F.count_if(F.col("score") >= 40).alias("risky_links"))
    none = F.array().cast("array<string>")
    return (
        message.join(score, "msg_id").join(auth, "msg_id").join(model, "msg_id")
        .join(per, "msg_id", "left").join(links, "msg_id", "left")
        .withColumn("titles", F.coalesce("titles", none)).withColumn("scored_titles", F.coalesce("scored_titles", none))
        .withColumn("links", F.coalesce("links", F.lit(0))).withColumn("risky_links", F.coalesce("risky_links", F.lit(0)))
        .withColumn("deceptive_link", F.coalesce("deceptive_link", F.lit(False)))
        .withColumn("authenticated", authenticated()).withColumn("strong_model", high_model()))


def has(*titles: str) -> Column:
    return F.arrays_overlap("titles", F.array(*[F.lit(t) for t in titles]))


def listed(*pairs: tuple[Column, str]) -> Column:
    return F.array_compact(F.array(*[F.when(condition, F.lit(text)) for condition, text in pairs]))


def model_verdict(case: DataFrame) -> DataFrame:
    """Banded, authentication-aware reading of the model probability."""
    p, ok = F.col("probability"), F.col("authenticated")
    usable = (F.col("status") == "ready") & p.isNotNull()
    band = (
        F.when(~usable, "unavailable").when(p < 60, "legitimate")
        .when(p < 90, F.when(ok, "legitimate").otherwise("uncertain"))
        .otherwise(F.when(ok, "caution").otherwise("phishing")))
    return case.withColumn("band", band).withColumn("weak_signal_note", usable & (p >= 60) & ok)


def triage(case: DataFrame) -> DataFrame:
    """Review priority with its reasons."""
    corroborated = F.col("strong_model") & (F.col("deceptive_link") | has("Credential pressure", "Payment diversion"))
    urgent = listed(
        (has("Feed URL match"), "feed match"),
        (has("Payment diversion") & has("Verification avoidance"), "payment change with verification avoidance"),
        (corroborated, "supported model signal"),
        (F.col("score") >= 60, "score threshold"))
    signals = (F.size("titles") > 0) | F.col("strong_model")
    return (
        case.withColumn("_urgent", urgent).withColumn("model_corroborated", corroborated)
        .withColumn("priority", F.when(F.size("_urgent") > 0, "urgent").when(signals, "review")
                    .when(F.col("status") != "ready", "incomplete").otherwise("routine"))
        .withColumn("reasons", F.when(F.size("_urgent") > 0, F.col("_urgent"))
                    .when(signals, F.array(F.lit("signals need assessment")))
                    .when(F.col("status") != "ready", F.array(F.lit("model unavailable")))
                    .otherwise(F.array(F.lit("no configured signals"))))
        .drop("_urgent"))


def escalate(triaged: DataFrame, checks: DataFrame) -> DataFrame:
    """Routine or incomplete messages with any supplementary check move up to review."""
    counted = checks.groupBy("msg_id").agg(F.count(F.lit(1)).alias("checks"))
    joined = triaged.join(counted, "msg_id", "left").withColumn("checks", F.coalesce("checks", F.lit(0)))
    return joined.withColumn("priority", F.when(
        (F.col("checks") > 0) & F.col("priority").isin("routine", "incomplete"), "review").otherwise(F.col("priority")))


def classify(case: DataFrame) -> DataFrame:
    """Five classes by precedence: phishing, fraud_related, impersonated, suspicious, legitimate (else undetermined)."""
    text = F.lower(F.concat_ws(" ", "subject", "body"))
    ok = F.col("dmarc") == "pass"
    lure = (F.col("links") > 0) & ~ok
    quiet = ok & ~has("Look-alike domain", *FEED_TITLES)
    supported = has(*SUPPORT)

    def counted(title: str) -> Column:
        if title == "Credential pressure":
            return has(title) & ~quiet
        if title in NEED_SUPPORT:
            return has(title) & supported
        return has(title)

    phishing = listed(
        *[(counted(t), t) for t in PHISHING_TITLES],
        (has("Account-expiry pressure") & lure & text.rlike(URGENCY), "Account-expiry lure with link, sender not authenticated"),
        (lure & text.rlike(FILE_SHARE), "Shared-document lure with link, sender not authenticated"),
        (lure & text.rlike(MAILBOX_LURE), "Mailbox/voicemail/delivery lure with link, sender not authenticated"))
    scheme = F.lit(False)
    for word in FRAUD_WORDS:
        scheme = scheme | text.contains(word)
    fraud = listed(
        *[(has(t), t) for t in FRAUD_TITLES],
        (lure & text.rlike(PAYMENT_NOTICE), "Invoice/payment-notification lure with link, sender not authenticated"),
        (scheme, "Fraud-scheme wording"))
    any_lure = text.rlike(FILE_SHARE) | text.rlike(MAILBOX_LURE) | text.rlike(PAYMENT_NOTICE)
    impersonated = listed(
        *[(has(t), t) for t in IMPERSONATION_TITLES],
        ((F.col("dmarc") == "fail") & has(*MISMATCH_TITLES, "Display-name brand spoofing"), "DMARC failure with identity mismatch"),
        (lure & has(*MISMATCH_TITLES) & any_lure, "Identity mismatch combined with a lure"))
    out = case.withColumn("_phishing", F.array_sort(phishing)).withColumn("_fraud", F.array_sort(fraud)).withColumn(
        "_impersonated", F.array_sort(impersonated))
    active = listed((F.size("_phishing") > 0, "phishing"), (F.size("_fraud") > 0, "fraud_related"),
                    (F.size("_impersonated") > 0, "impersonated"))
    scored = F.size("scored_titles") > 0
    benign = (F.col("status") == "ready") & F.lower("label").isin("benign", "legitimate")
    primary = (
        F.when(F.size(active) > 0, active[0]).when((F.col("score") >= 25) | scored, "suspicious")
        .when(benign, "legitimate").otherwise("undetermined"))
    evidence = (
        F.when(F.size("_phishing") > 0, F.col("_phishing")).when(F.size("_fraud") > 0, F.col("_fraud"))
        .when(F.size("_impersonated") > 0, F.col("_impersonated")).otherwise(F.col("scored_titles")))
    return (
        out.withColumn("primary", primary).withColumn("secondary", F.when(F.size(active) > 0, F.slice(active, 2, 3)).otherwise(active))
        .withColumn("evidence", evidence)
        .withColumn("confidence", F.when(F.size(active) > 0, F.when(
            (F.size("evidence") >= 2) | (F.col("score") >= 60), "high").otherwise("medium"))
            .when(F.col("primary") == "legitimate", "medium").otherwise("low"))
        .withColumn("basis", F.when(
            (F.col("primary") == "suspicious") & (F.col("scored_titles") == F.array(F.lit("High model phishing probability"))),
            "model_only").otherwise("rules_and_model"))
        .drop("_phishing", "_fraud", "_impersonated"))


def conflicts(case: DataFrame, url: DataFrame) -> DataFrame:
    """(msg_id, conflict): evidence that points both ways, including one row per deceptive link."""
    payment = has("Payment diversion") & has("Verification avoidance")
    benign = (F.col("status") == "ready") & F.lower("label").isin("benign", "legitimate")
    found = listed((payment & (F.col("dmarc") == "pass"), "authenticated-payment"), (payment & benign, "model-payment"))
    links = url.filter(F.array_contains("reasons", DECEPTIVE)).select("msg_id", F.concat(F.lit("link-identity-"), "url").alias("conflict"))
    return case.select("msg_id", F.explode(found).alias("conflict")).unionByName(links)


def categories(case: DataFrame, checks: DataFrame) -> DataFrame:
    """Multi-label categories with a fallback, and flags about the origin."""
    per = checks.groupBy("msg_id").agg(
        F.count(F.lit(1)).alias("checks"), F.bool_or(F.col("kind") == "language").alias("language_check"),
        F.bool_or(F.col("kind") == "identity").alias("identity_check"))
    off = lambda name: F.coalesce(F.col(name), F.lit(False))
    out = case.join(per, "msg_id", "left").withColumn("checks", F.coalesce("checks", F.lit(0)))
    model_phishing = F.lower("label") == "phishing"
    fraud = has("Payment diversion") | off("language_check")
    labels = listed((fraud, "fraud-related"), (off("identity_check"), "impersonated"), (model_phishing | has(*FEED_TITLES), "phishing"))
    evidence = (F.col("checks") > 0) | (F.size("titles") > 0) | (F.col("score") >= 25)
    benign = (F.col("status") == "ready") & F.lower("label").isin("benign", "legitimate")
    fallback = F.when(evidence, "suspicious").when(benign, "legitimate").otherwise("undetermined")
    return out.withColumn("categories", F.when(F.size(labels) > 0, labels).otherwise(F.array(fallback))).withColumn(
        "origin_flags", listed(
            (F.col("dmarc") == "fail", "possible spoofed domain"),
            ((F.col("dmarc") == "pass") & (fraud | model_phishing), "authenticated suspicious content")))


def delivery(case: DataFrame, hold_score: int = 60) -> DataFrame:
    """Route of each message, ``hold`` or ``deliver``, with the reasons to hold."""
    reasons = listed((F.col("priority") == "urgent", "urgent review priority"), (F.col("score") >= hold_score, "score threshold"))
    return case.withColumn("hold_reasons", reasons).withColumn("route", F.when(F.size("hold_reasons") > 0, "hold").otherwise("deliver"))


MODES = ("off", "dry-run", "label", "quarantine")


def mailbox_plan(case: DataFrame, minimum: int = 60) -> DataFrame:
    """(msg_id, mode, label, remove_from_inbox): the action per mode; no row where a mode does nothing."""
    high = (F.col("priority") == "urgent") | (F.col("score") >= minimum)
    acting = case.select("msg_id", "priority", "score", F.explode(F.array(*[F.lit(m) for m in MODES if m != "off"])).alias("mode"))
    return acting.select(
        "msg_id", "mode", F.when(high, "High-risk").when(F.col("priority") == "review", "Review").alias("label"),
        (high & (F.col("mode") == "quarantine")).alias("remove_from_inbox")).filter(F.col("label").isNotNull())


# Analyst steps as (priority, step), in the order they are listed.
STEPS = (
    ("now", "do not act"), ("now", "verify payment out of band"), ("next", "confirm sender identity"), ("next", "block links"),
    ("next", "quarantine attachments"), ("next", "review raw source"), ("next", "review by language reader"),
    ("next", "open image in isolation"), ("next", "review thread history"), ("record", "preserve evidence"),
    ("record", "report financial fraud"), ("record", "report incident"), ("record", "no specific action"),
)


def playbook(case: DataFrame, facts: dict[str, Column]) -> DataFrame:
    """(msg_id, step_no, priority, step). ``facts`` supplies the conditions not derivable from the case columns."""
    off = F.lit(False)
    urgent = F.col("priority") == "urgent"
    money = has("Payment diversion", "Payment UPI ID changed mid-thread") | facts.get("payment_tokens", off)
    conditions = [
        urgent, money,
        (F.col("dmarc") == "fail") | has(*MISMATCH_TITLES, "Display-name address differs"),
        F.col("risky_links") > 0, facts.get("risky_attachment", off), facts.get("manipulation", off),
        facts.get("unsupported_language", off), has("Image-only message"), facts.get("thread_checks", off),
        F.col("priority").isin("urgent", "review"), urgent | money, urgent | money,
    ]
    steps = F.array_compact(F.array(*[
        F.when(condition, F.struct(F.lit(i + 1).alias("step_no"), F.lit(p).alias("step_priority"), F.lit(s).alias("step")))
        for i, (condition, (p, s)) in enumerate(zip(conditions, STEPS))]))
    last = F.array(F.struct(F.lit(len(STEPS)).alias("step_no"), F.lit(STEPS[-1][0]).alias("step_priority"), F.lit(STEPS[-1][1]).alias("step")))
    listed_steps = F.when(F.size(steps) > 0, steps).otherwise(last)
    return case.select("msg_id", F.explode(listed_steps).alias("s")).select("msg_id", "s.*")
