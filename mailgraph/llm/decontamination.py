"""Benchmark decontamination as a prefix-filtered set join (DataFrame functions only).

An item is cut into windows of ``window`` consecutive words (one shorter window if it has fewer). A window is a set of shingles of ``shingle`` words; a
document that holds the window holds all of them, so the shortest necessary prefix of the window's shingles, ordered by rarity, is its rarest one. The
stages:

1. documents are normalised and written once: words joined by one blank, with a row tag, since ids may repeat;
2. every shingle of every document meets the shingles of all items; occurrences are counted with map-side combination, which is the rarity order;
3. every window is put under its rarest shingle (windows with a shingle that never occurs end here) and documents meet those alone. The shingle's
   place fixes where the window would lie: it must begin inside the text and end before it does (length and positional bounds). What is left is
   compared word for word over the window's span, inside the same map stage, so neither texts nor candidates cross the network; only true
   occurrences are shuffled, by row tag.

The item side of both joins is broadcast in slices of at most about ``SLICE_BYTES``, a number of passes that grows with the benchmark; no other table is
broadcast. Shingles of one frequent word order are spread over the tasks that read the documents, never gathered.

Null and wordless texts have no words and hold no window; null and wordless items have no window. Item rows that repeat an id are one item with the
windows of all rows; a null item id counts as the empty string. Rows of documents that repeat an id are judged by themselves; null ids stay. Very
long texts are read whole. Empty tables give empty results (without items every document is clean). Other columns are never looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mailgraph.llm.registry import documents, query
from mailgraph.plans import lineage

WINDOW = 10
SHINGLE = 4
SLICE_BYTES = 32 << 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: fixed value: characters between words, once A-Z are lower-cased
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def normal(text: Column) -> Column:
    """Words in lower case (A-Z only) with one blank between them."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    plain = F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.trim(F.regexp_replace(plain, BETWEEN, " "))


def _words(name: str) -> Column:
    return F.when(F.col(name) == "", F.array().cast("array<string>")).otherwise(F.split(name, " "))


def _keys(words: Column, width: int) -> Column:
    """One hash for every ``width`` consecutive words."""
    return F.transform(F.sequence(F.lit(0), F.size(words) - width), lambda i: F.xxhash64(F.slice(words, i + 1, width)))


def _shingles(texts: DataFrame, width: int) -> DataFrame:
    """_tag, _words, _n, _at, _key: every shingle of every text."""
    rows = texts.select("_tag", "_n", F.split("_norm", " ").alias("_words")).filter(F.col("_n") >= width)
    return rows.select("_tag", "_n", "_words", F.posexplode(_keys(F.col("_words"), width)).alias("_at", "_key"))


def _slices(rows: DataFrame, size: Column, by: list[str]) -> list[DataFrame]:
    """``rows`` in parts of about ``SLICE_BYTES``, each small enough to be broadcast."""
    total = rows.agg(F.sum(size.cast("long"))).first()[0] or 0
    count = -(-total // SLICE_BYTES)
    return [rows.filter(F.pmod(F.xxhash64(*by), F.lit(count)) == i) for i in range(count)]


def _union(frames: list[DataFrame]) -> DataFrame | None:
    out = None
    for frame in frames:
        out = frame if out is None else out.unionByName(frame)
    return out


def windows(items: DataFrame, id_col: str, text_col: str, window: int, shingle: int) -> DataFrame:
    """_item, _window (words joined by a blank), _size (its words), _width, _offset, _key: every shingle of every window of every item."""
    rows = items.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("_item"), normal(F.col(text_col)).alias("_norm")).filter("_norm <> ''")
    rows = rows.select("_item", F.split("_norm", " ").alias("_words"))
    cut = rows.select("_item", F.explode(F.transform(
        F.sequence(F.lit(0), F.greatest(F.size("_words") - window, F.lit(0))), lambda i: F.slice("_words", i + 1, F.lit(window)))).alias("_part"))
    parts = cut.select("_item", "_part", F.array_join("_part", " ").alias("_window"), F.size("_part").alias("_size")).dropDuplicates(["_item", "_window"])
    sized = parts.withColumn("_width", F.least(F.col("_size"), F.lit(shingle)))
    each = sized.select("_item", "_window", "_part", "_size", "_width", F.explode(F.sequence(F.lit(0), F.col("_size") - F.col("_width"))).alias("_offset"))
    return each.select("_item", "_window", "_size", "_width", "_offset", F.xxhash64(F.slice("_part", F.col("_offset") + 1, F.col("_width"))).alias("_key"))


def occurrences(texts: DataFrame, every: DataFrame) -> DataFrame | None:
    """_tag, _start, _size, _item: the places where a window's words stand in a text. ``texts`` has _tag, _n and _norm."""
    widths = sorted(r[0] for r in every.select("_width").distinct().collect())  # at most ``shingle`` values
    known = every.select("_width", "_key").distinct()
    counts = _union([
        _shingles(texts, width).join(F.broadcast(part.select("_key")), "_key").groupBy("_key").count().select(F.lit(width).alias("_width"), "_key", "count")
        for width in widths for part in _slices(known.filter(F.col("_width") == width), F.lit(16), ["_key"])])
    if counts is None:
        return None
    ranked = every.join(lineage.cut(counts), ["_width", "_key"], "left").withColumn("_rarity", F.struct(F.coalesce("count", F.lit(0)).alias("n"), "_key", "_offset"))
    prefix = lineage.cut(
        ranked.groupBy("_item", "_window", "_size", "_width").agg(F.min("_rarity").alias("_rarest")).filter("_rarest.n > 0")
        .select("_item", "_window", "_size", "_width", F.col("_rarest._offset").alias("_offset"), F.col("_rarest._key").alias("_key")))
    size = F.octet_length("_window") + F.octet_length("_item") + 64
    found = []
    for width in widths:
        for part in _slices(prefix.filter(F.col("_width") == width), size, ["_window", "_item"]):
            start = F.col("_at") - F.col("_offset")
            met = _shingles(texts, width).join(F.broadcast(part), "_key").filter((start >= 0) & (start + F.col("_size") <= F.col("_n")))
            same = F.array_join(F.slice("_words", start + 1, F.col("_size")), " ") == F.col("_window")
            found.append(met.filter(same).select("_tag", start.alias("_start"), "_size", "_item"))
    return _union(found)


def _covered(spans: Column) -> Column:
    """Number of words inside sorted spans."""
    state = F.struct(F.lit(0).alias("reach"), F.lit(0).alias("total"))
    return F.aggregate(spans, state, lambda s, x: F.struct(
        F.greatest(s["reach"], x["ends"]).alias("reach"),
        (s["total"] + F.greatest(x["ends"] - F.greatest(x["start"], s["reach"]), F.lit(0))).alias("total")), lambda s: s["total"])


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
                  window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_hit, spans (word ranges inside the text, sorted, as found) and items (sorted ids whose windows occur)."""
    normed = docs.select(F.col(id_col).alias("_id"), F.monotonically_increasing_id().alias("_tag"), normal(F.col(text_col)).alias("_norm"))
    texts = lineage.cut(normed.withColumn("_n", F.size(_words("_norm"))))
    every = lineage.cut(windows(items, item_col, item_text_col, window, shingle))
    found = occurrences(texts, every)
    spans, names = F.array().cast("array<struct<start:int,ends:int>>"), F.array().cast("array<string>")
    base = texts.select("_tag", F.col("_id").alias("doc_id"), F.col("_n").cast("long").alias("n_words"))
    if found is None:
        return base.select("doc_id", "n_words", F.lit(0).cast("long").alias("n_hit"), spans.alias("spans"), names.alias("items"))
    each = found.groupBy("_tag").agg(
        F.array_sort(F.collect_set(F.struct(F.col("_start").alias("start"), (F.col("_start") + F.col("_size")).alias("ends")))).alias("_spans"),
        F.array_sort(F.collect_set("_item")).alias("_items"))
    return base.join(each, "_tag", "left").select(
        "doc_id", "n_words", F.coalesce(_covered(F.col("_spans")), F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("_spans", spans).alias("spans"), F.coalesce("_items", names).alias("items"))


@query("op12_decontamination", r"""
    WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                 '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
    i AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                 '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
    iw AS (SELECT DISTINCT item_id, least(len(ws), 10) AS size, array_to_string(ws[k + 1:k + 10], ' ') AS piece
           FROM (SELECT item_id, ws, unnest(range(greatest(len(ws) - 9, 1))) AS k FROM i WHERE len(ws) > 0)),
    sizes AS (SELECT DISTINCT size FROM iw),
    dw AS (SELECT doc_id, size, k, array_to_string(ws[k + 1:k + size], ' ') AS piece
           FROM (SELECT doc_id, ws, size, unnest(range(len(ws) - size + 1)) AS k FROM d, sizes WHERE len(ws) >= size)),
    hits AS (SELECT doc_id, size, k, item_id FROM dw JOIN iw USING (size, piece)),
    covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + size)) AS p FROM hits) GROUP BY doc_id),
    named AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits) GROUP BY doc_id)
    SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
           sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
    FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)""")
def op12_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    found = contamination(documents(spark, folder), spark.read.parquet(f"{folder.rstrip('/')}/benchmark.parquet"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"))
