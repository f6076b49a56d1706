"""Text keys and tokens as column expressions."""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# ASCII whitespace, spelled out: ``\s`` covers different characters in different regex engines.
WS = "[ \\t\\r\\n\\f\\x0B]+"

# Characters a normalised text drops, and look-alikes it folds to Latin.
ZERO_WIDTH = "\u200b\u200c\u200d\u2060\ufeff\u00ad"
CONFUSABLES = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "ѕ": "s", "і": "i", "ј": "j",
    "һ": "h", "ԁ": "d", "ԛ": "q", "ո": "n", "к": "k", "м": "m", "т": "t", "н": "h", "в": "b",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T",
    "Х": "X", "Ѕ": "S", "І": "I", "Ј": "J",
    "ο": "o", "α": "a", "ε": "e", "ρ": "p", "ν": "v", "τ": "t", "η": "n", "κ": "k", "ι": "i", "υ": "u",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O",
    "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
}


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), WS, " "))


def message_text(subject: Column, body: Column) -> Column:
    return F.concat(F.coalesce(subject, F.lit("")), F.lit("\n"), F.coalesce(body, F.lit("")))


def dedup_key(*parts: Column) -> Column:
    """Case- and whitespace-insensitive identity of a text; missing parts count as empty."""
    return squeeze(F.concat_ws("\n", *[F.coalesce(p, F.lit("")) for p in parts]))


def template_signature(text: Column) -> Column:
    """Digest of the text with links, addresses and numbers masked."""
    masked = F.lower(F.coalesce(text, F.lit("")))
    for pattern, token in (
        ("https?://[^ \\t\\r\\n]+|www\\.[^ \\t\\r\\n]+", " <url> "),
        ("[a-z0-9_.+-]+@[a-z0-9_-]+\\.[a-z0-9_.-]+", " <email> "),
        ("[0-9]+", " <num> "),
    ):
        masked = F.regexp_replace(masked, pattern, token)
    return F.sha2(F.trim(F.regexp_replace(masked, WS, " ")), 256)


def words(text: Column) -> Column:
    """Lower-case ASCII words of two letters or more, links and digits removed; ``text`` is already lower-case."""
    masked = F.regexp_replace(text, "https?://[^ \\t\\r\\n]+", " ")
    return F.regexp_extract_all(F.regexp_replace(masked, "[0-9]+", " "), F.lit("[a-z]{2,}"), F.lit(0))


def shingles(text: Column, size: int = 5) -> Column:
    """Distinct character windows. One regex pass; ``substring`` by position would rescan the text for each window."""
    windows = F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{size}}}))"), F.lit(1))
    short = F.when(F.length(text) > 0, F.array(text)).otherwise(F.array().cast("array<string>"))
    return F.when(F.length(text) < size, short).otherwise(F.array_distinct(windows))


def subject_key(subject: Column) -> Column:
    return F.trim(F.lower(F.regexp_replace(F.trim(F.coalesce(subject, F.lit(""))), "(?i)^[ \\t]*(re|fwd?)[ \\t]*:[ \\t]*", "")))


def is_ascii(text: Column) -> Column:
    return F.octet_length(text) == F.char_length(text)


def has_suspect(text: Column) -> Column:
    """Whether folding would change the text: folding costs far less than a character class of so many single characters."""
    return ~is_ascii(text) & (skeleton(text) != text)


def skeleton(text: Column) -> Column:
    """Zero-width characters removed, look-alikes folded. Without Unicode compatibility folding (see ``nfkc``)."""
    source = "".join(CONFUSABLES) + ZERO_WIDTH
    return F.translate(text, source, "".join(CONFUSABLES.values()))


def normalised(values: pa.Array, rows: int = 64) -> pa.Array:
    """The texts in form NFKC; no more than ``rows`` of them are Python objects at a time."""
    parts = [pa.array([None if x is None else unicodedata.normalize("NFKC", x) for x in values.slice(at, rows).to_pylist()], pa.string())
             for at in range(0, len(values), rows)]
    return pa.concat_arrays(parts) if parts else pa.array([], pa.string())


def nfkc(text: Column) -> Column:
    """Unicode NFKC in Arrow batches; Spark SQL has no built-in for it."""
    @F.arrow_udf("string")
    def fold(values: pa.Array) -> pa.Array:
        return normalised(values)

    return fold(text)


def homoglyph_words(text: Column, limit: int | None = None) -> Column:
    """Words that mix Latin letters with look-alike characters (the first ``limit`` if given)."""
    mixed = F.filter(
        F.split(text, WS),
        lambda w: w.rlike("[A-Za-z]") & (skeleton(w) != w) & w.rlike("[^\\x00-\\x7F]"),
    )
    return mixed if limit is None else F.slice(mixed, 1, limit)


def reference_tokens(header: Column) -> Column:
    """Distinct message-id shaped tokens of a References / In-Reply-To value."""
    return F.array_distinct(F.regexp_extract_all(F.coalesce(header, F.lit("")), F.lit("<[^ \\t\\r\\n<>]+@[^ \\t\\r\\n<>]+>"), F.lit(0)))


def link_candidates(html: Column) -> Column:
    """Anchors as (href, shown text)."""
    anchor = "(?is)<a[^>]*href=[\"']([^\"']*)[\"'][^>]*>(.*?)</a>"
    return F.arrays_zip(
        F.regexp_extract_all(html, F.lit(anchor), F.lit(1)).alias("href"),
        F.regexp_extract_all(html, F.lit(anchor), F.lit(2)).alias("shown"),
    )


def body_links(text: Column) -> Column:
    found = F.regexp_extract_all(text, F.lit("(?i)https?://[^ \\t\\r\\n<>\"']+"), F.lit(0))
    return F.transform(found, lambda u: F.regexp_replace(u, "[.,;)]+$", ""))
