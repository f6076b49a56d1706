"""Personal identifiers: census counts and masking as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The Verhoeff check-digit tables (dihedral group multiplication and position permutation).
VERHOEFF_D = (
    (0, 1, 2, 3, 4, 5, 6, 7, 8, 9), (1, 2, 3, 4, 0, 6, 7, 8, 9, 5), (2, 3, 4, 0, 1, 7, 8, 9, 5, 6),
    (3, 4, 0, 1, 2, 8, 9, 5, 6, 7), (4, 0, 1, 2, 3, 9, 5, 6, 7, 8), (5, 9, 8, 7, 6, 0, 4, 3, 2, 1),
    (6, 5, 9, 8, 7, 1, 0, 4, 3, 2), (7, 6, 5, 9, 8, 2, 1, 0, 4, 3), (8, 7, 6, 5, 9, 3, 2, 1, 0, 4),
    (9, 8, 7, 6, 5, 4, 3, 2, 1, 0),
)
VERHOEFF_P = (
    (0, 1, 2, 3, 4, 5, 6, 7, 8, 9), (1, 5, 7, 6, 2, 8, 3, 0, 9, 4), (5, 8, 0, 3, 7, 9, 6, 1, 4, 2),
    (8, 9, 1, 6, 0, 4, 3, 5, 2, 7), (9, 4, 5, 3, 1, 2, 6, 8, 7, 0), (4, 2, 8, 6, 5, 7, 3, 9, 0, 1),
    (2, 7, 9, 3, 8, 0, 6, 4, 1, 5), (7, 0, 4, 6, 9, 1, 3, 2, 5, 8),
)

# Identifier shapes and the masks that replace them, as they stand. (?U) gives word borders, blanks and digits their Unicode meaning.
ID12 = r"(?U)\b[2-9]\d{3}[\s-]?\d{4}[\s-]?\d{4}\b"
PAN = r"(?U)\b[A-Za-z]{5}[0-9]{4}[A-Za-z]\b"
UPI_HANDLES = ("oksbi|okhdfcbank|okaxis|okicici|ybl|paytm|apl|axl|ibl|upi|sbi|hdfcbank|icici|axisbank|barodampay|"
               "pnb|kotak|federal|idfcfirst|fbl")
UPI = rf"(?i)(?U)\b[a-z0-9.\-_]{{2,256}}@(?:{UPI_HANDLES})(?![\w.\-])"
PHONE = r"(?U)(?<![\d\w])(?:\+?91[\s-]?|0)?[6-9]\d{4}[\s-]?\d{5}(?!\d)"
EMAIL = r"(?U)\b([A-Za-z0-9._%+\-])[A-Za-z0-9._%+\-]*@([A-Za-z0-9.\-]+\.[A-Za-z]{2,})\b"
IFSC = r"(?U)\b[A-Za-z]{4}0[A-Za-z0-9]{6}\b"
MASKS = {"aadhaar": "[AADHAAR REDACTED]", "pan": "[PAN REDACTED]", "upi": "[UPI REDACTED]", "phone": "[PHONE REDACTED]"}

# Account numbers next to the word.
ACCOUNT_BEFORE = "(?i)(?:account|a/?c|acct)\\.?\\s*(?:no\\.?|number|#)?\\.?\\s*:?\\s*([0-9]{9,18})(?![0-9])"
ACCOUNT_AFTER = "(?i)([0-9]{9,18})(?![0-9])\\s*(?:account|a/?c|acct)"


def verhoeff_valid(digits: Column) -> Column:
    """Check digit test of a 12-digit string by folding over its digits with table lookups."""
    d = F.array(*[F.array(*[F.lit(v) for v in row]) for row in VERHOEFF_D])
    p = F.array(*[F.array(*[F.lit(v) for v in row]) for row in VERHOEFF_P])
    reverse = F.reverse(digits)
    check = F.aggregate(
        F.sequence(F.lit(0), F.lit(11)), F.lit(0),
        lambda c, i: d[c][p[i % 8][F.substring(reverse, i + 1, F.lit(1)).cast("int")]],
    )
    return digits.rlike("^[0-9]{12}$") & (check == 0)


def _valid_ids(text: Column) -> Column:
    found = F.regexp_extract_all(text, F.lit(ID12), F.lit(0))
    return F.filter(found, lambda m: verhoeff_valid(F.regexp_replace(m, "[^0-9]", "")))


def counts(text: Column, emails: bool = False) -> dict[str, Column]:
    """Numbers of identifiers by kind; texts without an @ or a digit are not searched for what needs one."""
    text = F.coalesce(text, F.lit(""))
    at, digit = F.contains(text, F.lit("@")), text.rlike(r"(?U)\d")
    counted = lambda possible, pattern: F.when(possible, F.regexp_count(text, F.lit(pattern))).otherwise(0)
    out = {"aadhaar": F.when(digit, F.size(_valid_ids(text))).otherwise(0), "pan": counted(digit, PAN), "upi": counted(at, UPI), "phone": counted(digit, PHONE)}
    if emails:
        out["email"] = counted(at, EMAIL)
    return out


def _mask_valid_ids(text: Column) -> Column:
    """12-digit numbers masked match by match, each where it stands: the same digits inside a longer number stay."""
    pieces, found = F.split(text, ID12, -1), F.regexp_extract_all(text, F.lit(ID12), F.lit(0))
    shown = F.transform(found, lambda m: F.when(verhoeff_valid(F.regexp_replace(m, "[^0-9]", "")), MASKS["aadhaar"]).otherwise(m))
    joined = F.array_join(F.zip_with(pieces, shown, lambda p, m: F.concat(p, F.coalesce(m, F.lit("")))), "")
    return F.when(F.size(found) > 0, joined).otherwise(text)


def mask(text: Column, emails: bool = False) -> Column:
    """Identifiers replaced in a fixed order; 12-digit numbers only where the check digit holds. NULL stays NULL."""
    out = _mask_valid_ids(text)
    for pattern, kind in ((PAN, "pan"), (UPI, "upi"), (PHONE, "phone")):
        out = F.regexp_replace(out, pattern, MASKS[kind])
    return F.regexp_replace(out, EMAIL, "$1***@$2") if emails else out


def payment_tokens(text: Column) -> dict[str, Column]:
    """Distinct payment identifiers named in a message."""
    lower = F.transform(F.regexp_extract_all(text, F.lit(UPI), F.lit(0)), F.lower)
    accounts = F.concat(F.regexp_extract_all(text, F.lit(ACCOUNT_BEFORE), F.lit(1)),
                        F.regexp_extract_all(text, F.lit(ACCOUNT_AFTER), F.lit(1)))
    codes = F.transform(F.regexp_extract_all(text, F.lit(IFSC), F.lit(0)), F.upper)
    return {name: F.array_sort(F.array_distinct(values))
            for name, values in (("upi", lower), ("account", accounts), ("ifsc", codes))}
