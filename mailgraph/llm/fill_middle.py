"""Fill-in-the-middle rearrangement of texts.

A text is a run of units: a word with the white space before it, or white space at the end. One ``regex`` full match of ``(unit)*`` keeps the end of
every repetition, so ``match.ends(1)`` gives the number of units and, by indexing, both cut offsets (code points); no unit is looked at in Python. The
Arrow-fed function returns those three numbers alone. Hashes, forms, cutting, joining and the way back are column expressions.

Every document is handled by itself, without a shuffle, and the choice depends on seed and id alone, so reruns and lost executors change nothing. Null
texts are empty and stay plain, as do texts that hold one of the markers. A null id counts as the empty string; rows that repeat an id get the same
draws. Long texts are cut whole. Empty tables give empty results. Other columns are never looked at, whatever their names.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from mailgraph.llm.registry import documents, query

#: fixed values: one unit, and the markers before prefix, suffix and middle
UNIT = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
ANY_MARKER = "<[PSM]>"
SEED = 42
#: of 100 texts so many are rearranged, and of 100 of those so many put the suffix first
RATE, SUFFIX_FIRST = 50, 80


@F.pandas_udf(StructType([StructField("n", LongType()), StructField("first", IntegerType()), StructField("second", IntegerType())]))
def _cuts(text: pd.Series, one: pd.Series, two: pd.Series) -> pd.DataFrame:
    """Number of units, and the code points before the two drawn borders."""
    import regex

    whole = regex.compile(f"({UNIT})*")
    rows = []
    for t, a, b in zip(text, one, two, strict=True):
        ends = whole.fullmatch(t).ends(1)
        n = len(ends)
        low, high = sorted((a % (n + 1), b % (n + 1)))
        rows.append((n, ends[low - 1] if low else 0, ends[high - 1] if high else 0))
    return pd.DataFrame(rows, columns=["n", "first", "second"])


def _draw(digest: str, k: int) -> Column:
    return F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long")


def rearrange(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED, rate: int = RATE, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """One row per row of ``docs``: doc_id, n (units), form (plain, psm or spm), prefix, middle, suffix (null if plain) and output."""
    rows = docs.select(
        F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
        F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256).alias("digest"))
    cut = rows.select("*", _cuts("text", _draw("digest", 0), _draw("digest", 1)).alias("at"))
    plain = (F.col("text") == "") | F.col("text").rlike(ANY_MARKER) | (_draw("digest", 2) % 100 >= rate)
    form = F.when(plain, "plain").when(_draw("digest", 3) % 100 < suffix_first, "spm").otherwise("psm")
    first, second, moved = F.col("at.first"), F.col("at.second"), F.col("form") != "plain"
    parts = cut.withColumn("form", form).select(
        "doc_id", F.col("at.n").alias("n"), "form", "text",
        F.when(moved, F.substring("text", F.lit(1), first)).alias("prefix"), F.when(moved, F.substring("text", first + 1, second - first)).alias("middle"),
        F.when(moved, F.substring("text", second + 1, F.length("text"))).alias("suffix"))
    output = (
        F.when(F.col("form") == "plain", F.col("text"))
        .when(F.col("form") == "psm", F.concat(F.lit(PREFIX), "prefix", F.lit(SUFFIX), "suffix", F.lit(MIDDLE), "middle"))
        .otherwise(F.concat(F.lit(SUFFIX), "suffix", F.lit(PREFIX), "prefix", F.lit(MIDDLE), "middle")))
    return parts.select("doc_id", "n", "form", "prefix", "middle", "suffix", output.alias("output"))


def restored(output: Column, form: Column) -> Column:
    """The text that ``output`` was made from. Rearranged texts hold no marker of their own, so the pieces between markers are the parts."""
    piece = F.split(output, ANY_MARKER, -1)
    return (
        F.when(form == "plain", output)
        .when(form == "psm", F.concat(F.get(piece, 1), F.get(piece, 3), F.get(piece, 2)))
        .otherwise(F.concat(F.get(piece, 2), F.get(piece, 3), F.get(piece, 1))))


@query("op13_fill_middle", r"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || doc_id) AS h FROM documents),
    u AS (SELECT doc_id, t, regexp_extract_all(t, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS units, ('0x' || h[1:8])::BIGINT AS h1,
                 ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM d),
    f AS (SELECT *, len(units) AS n, least(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS a, greatest(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS b,
                 CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 50 THEN 'plain'
                      WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM u),
    p AS (SELECT *, array_to_string(units[1:a], '') AS pre, array_to_string(units[a + 1:b], '') AS mid, array_to_string(units[b + 1:], '') AS suf FROM f)
    SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
           sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
                  ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(t) AS restored_sha256 FROM p""")
def op13_fill_middle(spark: SparkSession, folder: str) -> DataFrame:
    made = rearrange(documents(spark, folder))
    return made.select(
        "doc_id", "n", "form", F.length("prefix").cast("long").alias("prefix_chars"), F.length("middle").cast("long").alias("middle_chars"),
        F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))
