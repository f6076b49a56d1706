"""Script shares and romanised-word scores as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Script names as shown, and the thresholds of the coverage label.
SCRIPTS = {
    "Devanagari": "IsDevanagari", "Bengali": "IsBengali", "Gurmukhi": "IsGurmukhi", "Gujarati": "IsGujarati",
    "Odia": "IsOriya", "Tamil": "IsTamil", "Telugu": "IsTelugu", "Kannada": "IsKannada", "Malayalam": "IsMalayalam",
    "Arabic/Urdu": "IsArabic", "Cyrillic": "IsCyrillic", "Korean": "IsHangul", "Thai": "IsThai", "Hebrew": "IsHebrew",
    "Greek": "IsGreek",
}
CJK = "Chinese/Japanese"
MIXED_SHARE = 0.05
DOMINANT_SHARE = 0.30
ROMANISED_HITS = 3
ROMANISED_SHARE = 0.12
ROMANISED_WORDS = (
    "hai hain ka ki ke ko aap aapka aapki aapke apna apne karo karen karein kijiye kariye nahi nahin jaldi turant abhi "
    "band hoga jayega jayegi jaega khata khaata paise paisa bhejo bhejen batana batayein mat kripya dhanyavad shukriya "
    "warna varna ghante liye isliye kya yeh woh sabhi rupaye kripaya dijiye lijiye milega milegi"
).split()


def script_counts(text: Column) -> dict[str, Column]:
    found = {name: F.regexp_count(text, F.lit(f"\\p{{{prop}}}")) for name, prop in SCRIPTS.items()}
    found[CJK] = F.regexp_count(text, F.lit("[\\p{IsHan}\\p{IsHiragana}\\p{IsKatakana}]"))
    return found


def romanised(text: Column, vocabulary: Sequence[str] = ROMANISED_WORDS) -> tuple[Column, Column]:
    """Distinct vocabulary hits and the share of words that are hits."""
    tokens = F.regexp_extract_all(F.lower(text), F.lit("[a-z]+"), F.lit(0))
    hits = F.filter(tokens, lambda w: w.isin(*vocabulary))
    share = F.when(F.size(tokens) == 0, 0.0).otherwise(F.size(hits) / F.size(tokens))
    return F.size(F.array_distinct(hits)), share


def coverage(text: Column, vocabulary: Sequence[str] = ROMANISED_WORDS) -> Column:
    """(language, script, covered) of a whole text, from letter shares per script."""
    letters = F.regexp_count(text, F.lit("\\p{L}"))
    latin = F.regexp_count(text, F.lit("\\p{IsLatin}"))
    scripts = F.array_sort(
        F.array(*[F.struct((-n).alias("neg"), F.lit(name).alias("name")) for name, n in script_counts(text).items()]))
    top = scripts[0]
    other_share = (letters - latin) / letters
    hits, share = romanised(text, vocabulary)

    def verdict(language: Column | str, script: Column | str, covered: str) -> Column:
        as_column = lambda v: v if isinstance(v, Column) else F.lit(v)
        return F.struct(as_column(language).alias("language"), as_column(script).alias("script"),
                        F.lit(covered).alias("model_coverage"))

    dominant = F.when(top["name"] == "Devanagari", F.lit("hindi-devanagari")).otherwise(F.concat(F.lit("other:"), top["name"]))
    return (
        F.when(letters == 0, verdict("unknown", "none", "unknown"))
        .when((other_share >= DOMINANT_SHARE) & (-top["neg"] > latin), verdict(dominant, top["name"], "unsupported"))
        .when(other_share >= MIXED_SHARE, verdict("code-mixed", F.concat(F.lit("Latin + "), top["name"]), "unsupported"))
        .when((hits >= ROMANISED_HITS) & (share >= ROMANISED_SHARE), verdict("hinglish", "Latin (romanized Hindi)", "unsupported"))
        .otherwise(verdict("english", "Latin", "supported"))
    )
