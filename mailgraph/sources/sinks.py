"""Outgoing shapes: redacted view, event and CEF lines, sectioned CSV, nested JSON, indicator export, routed delivery."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailgraph.operators.decisions import MISMATCH_TITLES, has

MASK = "[REDACTED]"


def redacted(case: DataFrame) -> DataFrame:
    """Ids, hash, score and statuses stay; free text is masked and child lists are emptied."""
    empty = F.array().cast("array<string>")
    masked = {c: F.lit(MASK) for c in ("subject", "sender", "body")}
    return case.select(
        "msg_id", "created", "is_sample", "raw_hash", "score", "risk", *[v.alias(c) for c, v in masked.items()],
        "spf", "dkim", "dmarc", "arc", "label", "titles", *[empty.alias(c) for c in ("indicators", "urls", "attachments", "hops")])


def events(case: DataFrame, prefix: str = "mailgraph-event-v1:") -> DataFrame:
    """Metadata-only event rows. ``event_id`` depends on the message alone, so a repeated delivery can be recognised."""
    return case.select(
        F.sha2(F.concat(F.lit(prefix), F.col("msg_id")), 256).alias("event_id"), F.col("msg_id").alias("case_id"),
        F.col("raw_hash").alias("email_sha256"), "created", "score", "risk", "is_sample", "priority", "spf", "dkim", "dmarc",
        F.col("titles").alias("findings"))


def _escaped(value: Column) -> Column:
    out = value.cast("string")
    for raw, safe in (("\\", "\\\\"), ("=", "\\="), ("\r", "\\r"), ("\n", "\\n")):
        out = F.replace(out, F.lit(raw), F.lit(safe))
    return out


def cef(event: DataFrame, vendor: str = "mailgraph", product: str = "Message Evidence") -> DataFrame:
    severity = F.when(F.col("priority") == "urgent", 8).when(F.col("score") >= 25, 5).otherwise(2)
    fields = (("externalId", F.col("event_id")), ("cs1Label", F.lit("CaseId")), ("cs1", F.col("case_id")),
              ("cs2Label", F.lit("EmailSHA256")), ("cs2", F.col("email_sha256")), ("cn1Label", F.lit("EvidenceScore")),
              ("cn1", F.col("score")), ("cs3Label", F.lit("ReviewPriority")), ("cs3", F.col("priority")))
    tail = F.concat_ws(" ", *[F.concat(F.lit(f"{name}="), _escaped(value)) for name, value in fields])
    head = F.concat(F.lit(f"CEF:0|{vendor}|{product}|1|email-analysis|Email analysis|"), severity.cast("string"), F.lit("|"))
    return event.select("case_id", F.concat(head, tail).alias("line"))


def safe_cell(value: Column) -> Column:
    """A leading formula character would run in a spreadsheet; a quote in front keeps the cell text."""
    text = F.coalesce(value.cast("string"), F.lit(""))
    return F.when(text.rlike("^[ \\t\\r\\n]*[=+@-]|^[ \\n]*[\\t\\r]"), F.concat(F.lit("'"), text)).otherwise(text)


def sections(indicator: DataFrame, finding: DataFrame, url: DataFrame, auth: DataFrame, attachment: DataFrame) -> DataFrame:
    """(msg_id, section, type, value, detail) rows of the CSV export."""
    def part(df: DataFrame, section: str, kind: Column, value: Column, detail: Column) -> DataFrame:
        return df.select("msg_id", F.lit(section).alias("section"), safe_cell(kind).alias("type"), safe_cell(value).alias("value"),
                         safe_cell(detail).alias("detail"))
    statuses = auth.select("msg_id", F.explode(F.create_map(*[
        x for name in ("spf", "dkim", "dmarc", "arc") for x in (F.lit(name), F.col(name))])).alias("type", "value"))
    return (
        part(indicator, "indicators", F.col("kind"), F.col("value"), F.lit(""))
        .unionByName(part(finding, "findings", F.col("grp"), F.col("title"), F.concat(
            F.col("detail"), F.lit(" (points: "), F.col("points"), F.lit(")"))))
        .unionByName(part(url, "urls", F.upper(F.regexp_extract("url", "^([a-zA-Z]+):", 1)), F.col("url"), F.concat(
            F.lit("score "), F.col("score"), F.lit(": "), F.array_join("reasons", "; "))))
        .unionByName(part(statuses, "authentication", F.col("type"), F.col("value"), F.lit("")))
        .unionByName(part(attachment, "attachments", F.regexp_extract("name", "(\\.[a-z]+)$", 1), F.col("name"), F.concat(
            F.lit("sha256 "), F.col("sha256"), F.when(F.col("warning"), ", active-content extension").otherwise("")))))


def nested(message: DataFrame, score: DataFrame, finding: DataFrame, url: DataFrame, indicator: DataFrame) -> DataFrame:
    """One document per message; child arrays are bounded by the message itself."""
    def children(df: DataFrame, name: str, *columns: str) -> DataFrame:
        return df.groupBy("msg_id").agg(F.array_sort(F.collect_list(F.struct(*columns))).alias(name))
    out = message.select("msg_id", "sender", "subject", "raw_hash").join(score.select("msg_id", "score", "risk"), "msg_id")
    for child in (children(finding, "findings", "grp", "title", "detail", "points"), children(url, "urls", "url", "score"),
                  children(indicator, "indicators", "kind", "value")):
        out = out.join(child, "msg_id", "left")
    return out


def threat_indicators(case: DataFrame, url: DataFrame, indicator: DataFrame, attachment: DataFrame, exit_nodes: DataFrame) -> DataFrame:
    """Adverse items of urgent and review messages with deterministic ids, one per (message, kind, value)."""
    elevated = case.filter(F.col("priority").isin("urgent", "review")).select(
        "msg_id", "priority", "score", (has(*MISMATCH_TITLES) | (F.col("priority") == "urgent")).alias("reply_counts"))
    item = lambda df, kind, value: df.select("msg_id", F.lit(kind).alias("kind"), F.col(value).alias("value"))
    replies = indicator.filter(F.col("kind") == "reply_address").join(elevated.filter("reply_counts").select("msg_id"), "msg_id", "left_semi")
    relay = indicator.filter(F.col("kind") == "reported_ip").join(
        exit_nodes.select(F.col("ip").alias("value")).distinct(), "value", "left_semi").filter(F.col("value").rlike("^[0-9.]{7,15}$"))
    items = (
        item(url.filter(F.col("score") >= 40), "url", "url").unionByName(item(replies, "email", "value"))
        .unionByName(item(attachment.filter("warning"), "file", "sha256")).unionByName(item(relay, "ip", "value")).distinct())
    quoted = F.concat(F.lit("'"), F.replace(F.replace("value", F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'")), F.lit("'"))
    field = (F.when(F.col("kind") == "url", "url:value").when(F.col("kind") == "email", "email-addr:value")
             .when(F.col("kind") == "file", "file:hashes.'SHA-256'").otherwise("ipv4-addr:value"))
    return items.join(elevated.drop("reply_counts"), "msg_id").select(
        "msg_id", "kind", "value",
        F.concat(F.lit("indicator--"), F.substring(F.sha2(F.concat_ws("|", "kind", "value"), 256), 1, 32)).alias("indicator_id"),
        F.concat(F.lit("["), field, F.lit(" = "), quoted, F.lit("]")).alias("pattern"),
        F.when(F.col("priority") == "urgent", "malicious-activity").otherwise("anomalous-activity").alias("indicator_type"),
        F.greatest(F.lit(1), F.least(F.lit(100), F.col("score"))).alias("confidence"))


def write_routed(routed: DataFrame, path: str) -> None:
    """One folder per route, appended."""
    routed.write.mode("append").partitionBy("route").parquet(path)


def write_events(event: DataFrame, path: str) -> None:
    event.write.mode("append").json(path)


def write_lines(lines: DataFrame, path: str) -> None:
    lines.select("line").write.mode("append").text(path)


def write_sections(rows: DataFrame, path: str) -> None:
    rows.select("section", "type", "value", "detail").write.mode("append").option("header", True).csv(path)

