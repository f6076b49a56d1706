"""Content jobs over whole texts: personal data, language coverage, instruction injection, attachment signatures."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailgraph.functions import language, pii, rules
from mailgraph.functions import text as T
from mailgraph.operators.decisions import listed

PII_KINDS = ("aadhaar", "pan", "upi", "phone", "email")


def pii_census(df: DataFrame, text: str, *keys: str) -> DataFrame:
    """Identifier counts per key; values never leave the row."""
    found = pii.counts(F.col(text), emails=True)
    rows = df.select(*keys, *[c.cast("long").alias(k) for k, c in found.items()])
    return rows.groupBy(*keys).agg(*[F.sum(k).alias(k) for k in PII_KINDS], F.count(F.lit(1)).alias("texts"))


def masked(df: DataFrame, *columns: str, emails: bool = True) -> DataFrame:
    """Free-text columns with identifiers masked; ids and digests are not in ``columns`` and stay."""
    return df.withColumns({c: pii.mask(F.col(c), emails) for c in columns})


def coverage_census(df: DataFrame, text: str, *keys: str, vocabulary: Sequence[str] = language.ROMANISED_WORDS) -> DataFrame:
    verdict = language.coverage(F.col(text), vocabulary)
    return df.select(*keys, verdict.alias("v")).groupBy(*keys, "v.language", "v.script", "v.model_coverage").agg(F.count(F.lit(1)).alias("texts"))


def language_checks(df: DataFrame, text: str, key: str = "msg_id") -> DataFrame:
    """(msg_id, title): authority or secrecy combined with a money request."""
    t = F.col(text)
    authority = t.rlike(r"(?i)\b(?:i am|i'm|this is) (?:your |the )?(?:ceo|cfo|director|principal|chairman|president)\b")
    request = t.rlike(r"(?is)\b(?:buy|purchase|send|transfer|pay|wire)\b.{0,60}\b(?:gift cards?|money|funds|payment|invoice)\b")
    secrecy = t.rlike(r"(?i)\b(?:do not call|don.t call|keep (?:this |it )?(?:confidential|secret)|unavailable (?:by|on) phone)\b")
    found = listed((authority & request, "Executive-authority payment request"), (request & secrecy, "Payment request with verification avoidance"))
    return df.select(key, F.explode(found).alias("title"))


def instruction_findings(message: DataFrame, text: str, page: DataFrame, key: str = "msg_id",
                         patterns: Sequence[rules.Rule] = rules.INSTRUCTIONS) -> DataFrame:
    """(msg_id, type, description, excerpt) of text that addresses an automated reader.

    Visible text is scanned raw and after folding look-alikes (only what folding reveals); hidden text and comments of
    the HTML (``page``: msg_id, hidden, comment arrays) report their first match each, raw before folded. All sources go through one scan.
    """
    # an outer explode: for the other one Spark filters by the array's size first, which cuts every page up once more for each mention
    part = lambda source: page.select(key, F.lit(source).alias("_source"), F.explode_outer(source).alias("_t")).filter(F.trim("_t") != "")
    texts = message.select(key, F.lit("visible").alias("_source"), F.col(text).alias("_t")).unionByName(part("hidden")).unionByName(part("comment"))
    marks = rules.Marks(*patterns)
    seen_as = texts.withColumn("_f", F.when(~T.is_ascii(F.col("_t")), T.skeleton(F.col("_t")))).withColumn("_f", F.when(F.col("_f") != F.col("_t"), F.col("_f")))
    marked = seen_as.select("*", marks.of(F.col("_t")).alias("_m"), marks.of(F.col("_f")).alias("_fm"))
    shown = rules.view(F.col("_t"), F.col("_m"))
    views = F.when(F.col("_f").isNotNull(), F.array(shown, rules.view(F.col("_f"), F.col("_fm")))).otherwise(F.array(shown))
    scanned = marked.select(
        key, "_source", F.when(T.is_ascii(F.col("_t")), 0).otherwise(F.regexp_count("_t", F.lit(rules.INVISIBLE))).alias("_invisible"), F.transform(views, lambda seen: rules.hits_in(seen, patterns, marks)).alias("_found"))
    none = F.array().cast(f"array<{rules.HIT}>")
    found = scanned.select(key, "_source", "_invisible", F.coalesce(F.get("_found", F.lit(0)), none).alias("_raw"), F.coalesce(F.get("_found", F.lit(1)), none).alias("_folded"))
    finding = lambda kind, title, excerpt: F.struct(
        F.lit(kind).alias("type"), title.cast("string").alias("description"), excerpt.cast("string").alias("excerpt"))
    of = lambda kind, hits: F.transform(hits, lambda h: finding(kind, h["title"], h["excerpt"]))
    null = F.lit(None)
    revealed = F.filter("_folded", lambda h: ~F.exists("_raw", lambda r: r["title"] == h["title"]))
    cluster = F.when(F.col("_invisible") >= rules.INVISIBLE_THRESHOLD, F.array(finding("zero_width_characters", F.col("_invisible"), null))).otherwise(of("", none))
    first = F.slice(F.concat("_raw", "_folded"), 1, 1)
    hidden = F.when(F.size(first) > 0, of("hidden_instruction", first)).otherwise(F.array(finding("hidden_content_present", F.lit("hidden content"), null)))
    every = (
        F.when(F.col("_source") == "visible", F.concat(of("instruction_pattern", F.col("_raw")), of("homoglyph_instruction_pattern", revealed), cluster))
        .when(F.col("_source") == "hidden", hidden).otherwise(of("hidden_comment_raw_html_only", first)))
    return found.select(key, F.explode(every).alias("f")).select(key, "f.*")


def scored_instructions(findings: DataFrame, key: str = "msg_id") -> DataFrame:
    """(msg_id, grp, title, detail, points) of instruction findings; each type has its own points, types without points give none."""
    points = F.create_map(*[F.lit(x) for pair in rules.INSTRUCTION_POINTS.items() for x in pair])[F.col("type")]
    return findings.withColumn("points", points).filter("points > 0").select(
        key, F.lit("manipulation").alias("grp"), F.col("description").alias("title"), F.coalesce("excerpt", F.lit("")).alias("detail"), "points")


def instruction_status(findings: DataFrame, message: DataFrame, key: str = "msg_id") -> DataFrame:
    per = findings.groupBy(key).agg(F.bool_or(F.col("type") != "hidden_content_present").alias("real"), F.count(F.lit(1)).alias("n"))
    return message.select(key).join(per, key, "left").select(
        key, F.when(F.col("real"), "flagged").when(F.col("n") > 0, "informational").otherwise("clear").alias("status"), F.coalesce("n", F.lit(0)).alias("indicators"))


@dataclass(frozen=True)
class Signature:
    rule_id: str
    title: str
    magic: str = ""  # hex
    name: str = ""
    every: tuple[str, ...] = ()
    some: tuple[str, ...] = ()


# Static attachment signatures over the name and the content.
SIGNATURES = (
    Signature("ATT-HTML-SMUGGLING", "HTML smuggling pattern", name=r"(?i)\.(html?|xhtml|svg)$",
              every=(r"atob\(|new\s+Blob\(|Uint8Array", r"\.download\s*=|msSaveOrOpenBlob|createObjectURL|saveAs\(")),
    Signature("ATT-OLE-AUTOEXEC", "Legacy Office macro auto-execution", magic="D0CF11E0",
              every=(r"(?i)_VBA_PROJECT|VBA/|Attribut", r"(?i)Auto_?Open|Document_Open|Workbook_Open|Auto_?Exec")),
    Signature("ATT-OLE-SHELL", "Legacy Office document referencing a shell or downloader", magic="D0CF11E0",
              some=(r"(?i)WScript\.Shell|Shell\s*\(|powershell|CreateObject|URLDownloadToFile",)),
    Signature("ATT-RTF-OBJECT", "RTF with embedded object", magic="7B5C727466", some=(r"\\objdata|\\objupdate|\\objautlink",)),
    Signature("ATT-LNK-SHORTCUT", "Windows shortcut (.lnk) content", magic="4C00000001140200"),
    Signature("ATT-PDF-EMBEDDED-FILE", "PDF with embedded file", magic="25504446", some=(r"/EmbeddedFile\b",)),
    Signature("ATT-SCRIPT-DROPPER", "Encoded or obfuscated script command",
              some=(r"(?is)powershell(\.exe)?\s+.{0,40}-(enc|encodedcommand)\b", r"(?i)FromBase64String\(|Invoke-Expression|\bIEX\s*\(|cmd(\.exe)?\s*/c\s")),
    Signature("ATT-DOUBLE-EXTENSION", "Double file extension",
              name=r"(?i)\.(pdf|docx?|xlsx?|pptx?|jpe?g|png|gif|txt|csv)\s*\.(exe|scr|js|vbs|bat|cmd|lnk|com|jar|ps1|hta)$"),
    Signature("ATT-RTL-OVERRIDE", "Right-to-left override in filename", name="‮"),
    Signature("ATT-DISK-IMAGE", "Disk-image attachment", name=r"(?i)\.(iso|img|vhd|vhdx)$"),
    Signature("EXE-CONTENT", "Executable attachment content", some=(r"^(MZ|\x7fELF)",)),
    Signature("PDF-ACTION", "PDF active-action marker", magic="25504446", some=(r"/(JavaScript|JS|Launch|OpenAction)\b",)),
)


def attachment_findings(attachment: DataFrame, *keep: str, name: str = "name", content: str = "content",
                        signatures: Sequence[Signature] = SIGNATURES) -> DataFrame:
    """Signature hits of a binary column; bytes are read as Latin-1 so each byte is one character."""
    body = F.decode(F.col(content), "ISO-8859-1")

    def matches(s: Signature) -> Column:
        test = F.lit(True)
        if s.magic:
            test = test & F.hex(F.substring(F.col(content), 1, len(s.magic) // 2)).startswith(s.magic)
        if s.name:
            test = test & F.col(name).rlike(s.name)
        for pattern in s.every:
            test = test & body.rlike(pattern)
        if s.some:
            any_ = F.lit(False)
            for pattern in s.some:
                any_ = any_ | body.rlike(pattern)
            test = test & any_
        return test

    hits = F.array_compact(F.array(*[F.when(matches(s), F.struct(F.lit(s.rule_id).alias("rule_id"), F.lit(s.title).alias("title"))) for s in signatures]))
    return attachment.select(*keep, F.explode(hits).alias("h")).select(*keep, "h.*")


def evasion(df: DataFrame, text: str, scorer, delta: float = 40.0, *keep: str) -> DataFrame:
    """Score of the normalised text minus the raw one, for texts that contain look-alikes; flagged at ``delta``."""
    suspect = df.filter(T.has_suspect(F.col(text)))
    both = suspect.select(*keep, scorer(F.col(text)).alias("raw_score"), scorer(T.skeleton(F.col(text))).alias("normalised_score"))
    return both.withColumn("delta", F.round(F.col("normalised_score") - F.col("raw_score"), 1)).withColumn("flagged", F.col("delta") >= delta)


def normal_forms(df: DataFrame, text: str, *keep: str) -> DataFrame:
    """(keep..., normal): texts with look-alikes or invisible characters as a reader sees them: folded, then in Unicode form NFKC. Only these texts
    pass through Python."""
    return df.filter(T.has_suspect(F.col(text))).select(*keep, T.nfkc(T.skeleton(F.col(text))).alias("normal"))


def payment_profile(df: DataFrame, text: str, *keep: str) -> DataFrame:
    return df.select(*keep, *[c.alias(k) for k, c in pii.payment_tokens(F.col(text)).items()])
