"""Personal data: patterns propose spans, checksums confirm them, context words adjust a score (DataFrame functions only).

Places come from the pieces between matches: ``split`` and ``regexp_extract_all`` with one pattern walk the text alike, so a match starts
where the lengths of all earlier pieces and matches end. Offsets count code points; ends are exclusive. Prefix sums are taken in two
levels (blocks, then inside a block), so texts with very many matches stay cheap.

Patterns carry guards that change no match but keep the scan linear: an e-mail starts where no earlier start could be, and runs are
possessive where giving characters back cannot help.

Base kinds (email, ip, card, phone) always stay once their own test passes. The method's own kinds (iban, confirmed by mod 97; ssn, which needs
a context word) are added when their score reaches the threshold. Context words within ``NEAR`` characters raise a span's score, words that
name other numbers lower it.

Null texts count as empty and have no spans. Repeated rows get equal results; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mailgraph.llm.registry import documents, query

NEAR = 40
BLOCK = 256
THRESHOLD = 0.5

#: fixed values: kind, cheap test that a text can hold it, pattern
PATTERNS = {
    "email": ("@", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"),
    "ip": (".", r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"),
    "card": ("", r"[0-9]++(?:[\x20-][0-9]++)*+"),
    "phone": ("+", r"\+[0-9][\x20().0-9-]+[0-9]"),
    "iban": ("", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])"),
    "ssn": ("-", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
}
BASE = ("email", "ip", "card", "phone")
#: fixed values: base score, words nearby that raise it, words nearby that lower it
CONTEXT = {
    "email": (0.7, r"(?i)\b(?:mail|e-mail|email|contact|write|reach)\b", r"(?i)\b(?:example|sample)\b"),
    "ip": (0.5, r"(?i)\b(?:ip|host|server|address|login)\b", r"(?i)\b(?:version|release|section)\b"),
    "card": (0.7, r"(?i)\b(?:card|visa|credit|debit|payment|cvv)\b", r"(?i)\b(?:isbn|order|serial|tracking)\b"),
    "phone": (0.5, r"(?i)\b(?:phone|tel|call|mobile|fax)\b", r"(?i)\b(?:score|total|version)\b"),
    "iban": (0.8, r"(?i)\b(?:iban|bank|account|transfer|konto)\b", r"(?i)\b(?:serial|license|key)\b"),
    "ssn": (0.3, r"(?i)\b(?:ssn|social|security|tax)\b", r"(?i)\b(?:part|model|serial)\b"),
}
RAISE, LOWER = 0.25, 0.25


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    marks = F.split(F.reverse(number), "")
    doubled = F.transform(marks, lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(
        F.floor(d.cast("int") * 2 / 10).cast("int") + (d.cast("int") * 2) % 10))
    return F.aggregate(doubled, F.lit(0), lambda total, d: total + F.coalesce(d, F.lit(0))) % 10 == 0


def mod97(value: Column) -> Column:
    """Whether an account number (letters and digits, no blanks) leaves 1 modulo 97 after its first four marks move to the end."""
    marks = F.split(F.concat(F.substring(value, 5, 64), F.substring(value, 1, 4)), "")
    code = lambda c: F.when(c.between("0", "9"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    return F.aggregate(marks, F.lit(0), lambda rest, c: F.when(c == "", rest).otherwise(
        (rest * F.when(code(c) > 9, 100).otherwise(10) + code(c)) % 97)) == 1


def confirmed(kind: str, found: Column) -> Column:
    """The kind's own test on a matched string."""
    if kind == "ip":
        plain = lambda part: F.ltrim(part, F.lit("0"))
        return F.forall(F.split(found, r"\."), lambda part: F.when(F.length(plain(part)) > 3, False).otherwise(
            F.coalesce(F.nullif(plain(part), F.lit("")).cast("int"), F.lit(0)) <= 255))
    if kind == "card":
        return F.length(digits(found)).between(12, 19) & luhn(digits(found))
    if kind == "phone":
        return F.length(digits(found)).between(9, 15)
    if kind == "iban":
        plain = F.regexp_replace(found, "\x20", "")
        return F.length(plain).between(15, 34) & mod97(plain)
    return F.lit(True)


def _add(total: Column, step: Column) -> Column:
    return total + step["gap"] + step["own"]


def _block_sums(steps: Column) -> Column:
    blocks = F.sequence(F.lit(0), F.floor((F.greatest(F.size(steps), F.lit(1)) - 1) / BLOCK).cast("int"))
    return F.transform(blocks, lambda b: F.aggregate(F.slice(steps, b * BLOCK + 1, F.lit(BLOCK)), F.lit(0), _add))


def _kind_spans(kind: str, rank: int, found: Column, pieces: Column, steps: Column, sums: Column) -> Column:
    """The spans of one kind from its matches, the pieces between them, their lengths and the sums of those per block."""
    own, raising, lowering = CONTEXT[kind]

    def start(i: Column) -> Column:
        block = F.floor(i / BLOCK).cast("int")
        return (F.aggregate(F.slice(sums, F.lit(1), block), F.lit(0), lambda total, x: total + x)
                + F.aggregate(F.slice(steps, block * BLOCK + 1, i - block * BLOCK), F.lit(0), _add) + F.get(steps, i)["gap"])

    def span(match: Column, i: Column) -> Column:
        near = F.concat_ws(" ", F.substring(F.get(pieces, i), -NEAR, NEAR), F.substring(F.get(pieces, i + 1), 1, NEAR))
        score = F.lit(own) + F.when(near.rlike(raising), RAISE).otherwise(0.0) - F.when(near.rlike(lowering), LOWER).otherwise(0.0)
        return F.when(confirmed(kind, match), F.struct(
            start(i).cast("long").alias("start"), F.lit(rank).alias("rank"), (start(i) + F.length(match)).cast("long").alias("ends"),
            F.lit(kind).alias("kind"), F.lit(kind in BASE).alias("base"), score.alias("score")))

    return F.filter(F.transform(found, span), lambda s: s.isNotNull() & (s["base"] | (s["score"] >= THRESHOLD)))


def spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ``spans``: array<struct<start, rank, ends, kind, base, score>> in order, one row per input row."""
    text, none = F.col("_text"), F.array().cast("array<string>")
    base = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"))
    possible = {k: F.contains(text, F.lit(mark)) if mark else text.rlike("[0-9]") for k, (mark, _) in PATTERNS.items()}
    found = base.select("doc_id", "_text", *[
        F.when(possible[k], F.regexp_extract_all(text, F.lit(p), F.lit(0))).otherwise(none).alias(f"_f_{k}") for k, (_, p) in PATTERNS.items()])
    cut = found.select("doc_id", *[f"_f_{k}" for k in PATTERNS], *[  # texts without a match are never split
        F.when(F.size(f"_f_{k}") > 0, F.split(text, p, -1)).otherwise(none).alias(f"_p_{k}") for k, (_, p) in PATTERNS.items()])
    stepped = cut.select("*", *[
        F.zip_with(F.slice(F.col(f"_p_{k}"), F.lit(1), F.size(f"_f_{k}")), F.col(f"_f_{k}"), lambda p, m: F.struct(
            F.length(p).alias("gap"), F.length(m).alias("own"))).alias(f"_s_{k}") for k in PATTERNS])
    summed = stepped.select("*", *[_block_sums(F.col(f"_s_{k}")).alias(f"_b_{k}") for k in PATTERNS])
    every = [_kind_spans(k, rank, *[F.col(f"_{x}_{k}") for x in "fpsb"]) for rank, k in enumerate(PATTERNS)]
    return summed.select("doc_id", F.array_sort(F.concat(*every)).alias("spans"))


def _of(column: str, kind: str) -> Column:
    return F.filter(column, lambda s: s["kind"] == kind)


def _joined(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["ends"].cast("string"))), ",")


@query("op2_pii")
def op2_pii(spark: SparkSession, folder: str) -> DataFrame:
    found = spans(documents(spark, folder))
    return found.select(
        "doc_id", *[F.size(_of("spans", k)).cast("long").alias(f"n_{k}") for k in BASE],
        F.sha2(_joined(F.filter("spans", lambda s: s["base"])), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))
