"""Near duplicates by MinHash bands, odd sketches and exact verification.

A text's set is its distinct shingles of ``shingle`` words (64-bit hashes), lower-cased A to Z. Texts with equal sets form a class and only the smallest id goes on, so copies cost
nothing. Each class has ``BANDS * ROWS`` MinHash values: rows of a band are hashed to one key, and classes that share a key are candidates;
two texts at the threshold miss every band with probability below 1e-6. The same values, folded as (place, value) into a parity bitmap, make
the odd sketch: the number of bits two sketches differ in estimates how many of their values differ, and pairs that differ by far more
than the threshold allows (``SIGMAS`` deviations) are dropped before any text moves. The rest are confirmed on the full sets.

No bucket is expanded into all its pairs. First each class meets one or two pivots of every bucket it is in; confirmed links give components. Then only buckets
that still hold several components are looked at, and in them only members outside the bucket's largest component meet the others: pairs
inside one component can add no link between components. Large buckets are compared sketch against sketch, in blocks of bounded size, and only
pairs that pass come out. Every pair of a bucket is thus linked, in one component already, or tested: no cap on partners is set.

Null texts and texts without words have an empty set and are linked with nothing. Fewer words than a shingle make one of all of them. Every row is a
document of its own: rows that repeat an id with the same set share a class, with different sets they have a class each. Rows with a null id take part;
a component is named by its smallest id that is not null, and is null if it has none. Very long texts are parsed in slices of a batch, whole.
Empty tables give empty results. Other columns are never looked at, whatever their names. Ids are longs (others are cast).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mailgraph.llm import words
from mailgraph.llm.registry import documents, query
from mailgraph.operators.components import connected_components
from mailgraph.plans import lineage

SHINGLE = 4
PERCENT = 80
BANDS = 36
ROWS = 5
SKETCH_BITS = 512
SIGMAS = 6.0
#: buckets up to this size pair up in a join; larger ones are compared block by block
SMALL_BUCKET = 32
BLOCK = 2048
_SEEDS = np.random.default_rng(5).integers(0, 1 << 32, (2, BANDS * ROWS), dtype=np.uint64)
_FACTORS = (_SEEDS[0] | np.uint64(1)).astype(np.uint32)
_TERMS = _SEEDS[1].astype(np.uint32)
_PLACES = words.mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64))


def shingles(texts: pa.Array, width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(distinct shingle hashes of all texts, sorted inside each; where each text's begin and the total at the end)."""
    found = words.split(texts, lower=True)
    first = found.first()
    counts = np.diff(first)
    hashes = words.windows(found.hash, width)
    row = found.doc[:len(hashes)]
    keep = found.doc[width - 1:] == row if len(hashes) else np.zeros(0, bool)
    hashes, row = hashes[keep], row[keep]
    short = np.flatnonzero((counts > 0) & (counts < width))
    if len(short):
        whole = [_whole(found.hash[first[i]:first[i + 1]]) for i in short]
        hashes, row = np.concatenate([hashes, np.array(whole, dtype=np.uint64)]), np.concatenate([row, short])
    order = np.lexsort((hashes, row))
    hashes, row = hashes[order], row[order]
    fresh = np.ones(len(hashes), dtype=bool)
    fresh[1:] = (hashes[1:] != hashes[:-1]) | (row[1:] != row[:-1])
    hashes, row = hashes[fresh], row[fresh]
    return hashes, np.searchsorted(row, np.arange(found.texts + 1))


def _whole(hashes: np.ndarray) -> np.uint64:
    """One hash of a text with fewer words than a shingle; its length keeps it apart from shingles."""
    return words.mix(words.windows(hashes, len(hashes)) + np.uint64(len(hashes)))[0]


def signatures(hashes: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """MinHash values, one row per non-empty set."""
    small = (hashes >> np.uint64(32)).astype(np.uint32)
    filled = begins[:-1][np.diff(begins) > 0]
    out = np.empty((len(filled), BANDS * ROWS), dtype=np.uint32)
    for k in range(BANDS * ROWS):
        out[:, k] = np.minimum.reduceat(small * _FACTORS[k] + _TERMS[k], filled) if len(filled) else 0
    return out


def bands(values: np.ndarray) -> np.ndarray:
    """One 64-bit key per band; keys of different bands differ."""
    total = np.zeros((len(values), BANDS), dtype=np.uint64) + _PLACES[:BANDS]
    for r in range(ROWS):
        total = total * np.uint64(0xD6E8FEB86659FD93) + values[:, r::ROWS].astype(np.uint64)
    return words.mix(total).view(np.int64)


def sketches(values: np.ndarray) -> np.ndarray:
    """Odd sketches as 64-bit words: each (place, value) flips one bit."""
    bits = (words.mix(values.astype(np.uint64) ^ _PLACES) % np.uint64(SKETCH_BITS)).astype(np.int64)
    flips = np.zeros((len(values), SKETCH_BITS), dtype=np.uint8)
    rows = np.arange(len(values))
    for k in range(values.shape[1]):
        flips[rows, bits[:, k]] ^= 1
    return np.packbits(flips, axis=1, bitorder="little").view(np.int64).reshape(len(values), SKETCH_BITS // 64)


def most_different_bits(percent: int = PERCENT, sigmas: float = SIGMAS) -> int:
    """Bits two sketches differ in, at most, when the sets are at the threshold, ``sigmas`` deviations out.

    ``d`` differing values put ``2 d`` marks into the bitmap; ``m`` marks leave ``n (1 - exp(-2 m / n)) / 2`` odd bits on average.
    """
    k, miss = BANDS * ROWS, 1 - percent / 100
    differing = min(k, k * miss + sigmas * (k * miss * (1 - miss)) ** 0.5)
    return int(np.ceil(SKETCH_BITS * (1 - np.exp(-4 * differing / SKETCH_BITS)) / 2 + sigmas / 2 * (SKETCH_BITS / 16) ** 0.5))


PREPARED = "doc_id long, tag long, n_shingles long, set_key binary, bands array<long>, sketch array<long>"


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, tag, text): the tag tells texts under one id apart."""
    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("tag"), text.alias("text"))


def prepare(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """doc_id, tag, n_shingles, a 128-bit key of the set, band keys and odd sketch (null for empty sets)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in words.parts(batch, "text"):
                hashes, begins = shingles(part.column("text"), shingle)
                sizes = np.diff(begins)
                filled = np.flatnonzero(sizes > 0)
                values = signatures(hashes, begins)
                sums = np.concatenate([[0], np.cumsum(hashes, dtype=np.uint64)]).astype(np.uint64)
                others = np.concatenate([[0], np.cumsum(words.mix(hashes ^ np.uint64(0xA5A5A5A5)), dtype=np.uint64)]).astype(np.uint64)
                key = np.stack([sums[begins[1:]] - sums[begins[:-1]], others[begins[1:]] - others[begins[:-1]]], axis=1)
                keys, cells, odd = [None] * len(sizes), [None] * len(sizes), [None] * len(sizes)
                for n, (i, b, s) in enumerate(zip(filled, bands(values), sketches(values), strict=True)):
                    keys[i], cells[i], odd[i] = key[i].tobytes(), b, s
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("tag"), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(cells, pa.list_(pa.int64())),
                     pa.array(odd, pa.list_(pa.int64()))], names=["doc_id", "tag", "n_shingles", "set_key", "bands", "sketch"])

    return _texts(docs, id_col, text_col).mapInArrow(run, PREPARED)


def classes_of(prepared: DataFrame) -> DataFrame:
    """(set_key, least, node): each class, its smallest id and its number.

    The number is that id. Only where an id stands for several sets, or all ids of the class are null, is it a hash of the set.
    """
    full = prepared.filter("set_key IS NOT NULL").select("set_key", "doc_id", F.xxhash64("set_key").alias("_h"))
    several = full.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("_h").alias("_lo"), F.max("_h").alias("_hi")).filter("_lo <> _hi").select(
        F.col("doc_id").alias("least"), F.lit(True).alias("_several"))
    return full.groupBy("set_key").agg(F.min("doc_id").alias("least")).join(several, "least", "left").select(
        "set_key", "least", F.when(F.col("_several") | F.col("least").isNull(), F.xxhash64("set_key")).otherwise(F.col("least")).alias("node"))


def _close(left: str, right: str, limit: int) -> Column:
    total = F.lit(0)
    for i in range(SKETCH_BITS // 64):
        total = total + F.bit_count(F.get(left, i).bitwiseXOR(F.get(right, i)))
    return total <= limit


def _confirm(pairs: DataFrame, texts: DataFrame, percent: int, shingle: int) -> DataFrame:
    """The pairs whose full sets reach the threshold. Texts travel once per pair; the first one's is parsed once per run of pairs."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in words.parts(batch, "text_b"):
                left, first = shingles(part.column("text_a").dictionary_encode().dictionary, shingle)
                codes = part.column("text_a").dictionary_encode().indices.to_numpy()
                right, second = shingles(part.column("text_b"), shingle)
                keep = np.zeros(part.num_rows, dtype=bool)
                for row in range(part.num_rows):
                    a = left[first[codes[row]]:first[codes[row] + 1]]
                    b = right[second[row]:second[row + 1]]
                    at = np.searchsorted(a, b)
                    at[at == len(a)] = 0
                    both = int((a[at] == b).sum()) if len(a) else 0
                    keep[row] = 100 * both >= percent * (len(a) + len(b) - both) and both > 0
                yield part.select(["src", "dst"]).filter(pa.array(keep))

    a = texts.select(F.col("doc_id").alias("src"), F.col("text").alias("text_a"))
    b = texts.select(F.col("doc_id").alias("dst"), F.col("text").alias("text_b"))
    return pairs.join(b, "dst").join(a, "src").select("src", "dst", "text_a", "text_b").mapInArrow(run, "src long, dst long")


def links(prepared: DataFrame, classes: DataFrame, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, shingle: int = SHINGLE) -> DataFrame:
    """(src, dst): links between classes (by their numbers) that join all near duplicates into their components. Inside, ``doc_id`` is a class's number."""
    limit = most_different_bits(percent)
    # one row stands for a class: text, sketch and bands are those of that row
    stands = prepared.select("set_key", "tag", "bands", "sketch", F.col("doc_id").alias("least"))
    named = classes.select("node", F.col("set_key").alias("_key"), F.col("least").alias("_least"))
    members = lineage.cut(stands.join(named, (F.col("set_key") == F.col("_key")) & F.col("least").eqNullSafe(F.col("_least"))).select(
        F.col("node").alias("doc_id"), "least", "tag", "bands", "sketch").dropDuplicates(["doc_id"]))
    cells = members.select("doc_id", F.explode("bands").alias("cell"))
    # in large buckets pivots differ from bucket to bucket, so a member meets many of its group; in small ones the smallest id repeats fewer pairs
    lot = F.xxhash64("cell", "doc_id")
    shared = cells.groupBy("cell").agg(
        F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("least"), F.min_by("doc_id", lot).alias("one"), F.max_by("doc_id", lot).alias("two"),
    ).filter("n > 1").select("cell", "n", F.when(F.col("n") <= SMALL_BUCKET, F.array("least")).otherwise(F.array("one", "two")).alias("pivots"))
    buckets = lineage.cut(cells.join(shared, "cell"))
    touched = buckets.select("doc_id").distinct()
    wanted = members.join(touched, "doc_id", "left_semi").select("doc_id", F.col("least").alias("_least"), F.col("tag").alias("_tag"))
    rows = _texts(docs, id_col, text_col).withColumnRenamed("doc_id", "least")
    texts = lineage.cut(rows.join(wanted, F.col("least").eqNullSafe(F.col("_least")) & (F.col("tag") == F.col("_tag"))).select(
        "doc_id", "text").dropDuplicates(["doc_id"]))
    sketch = members.join(touched, "doc_id", "left_semi").select("doc_id", "sketch")

    def near(pairs: DataFrame) -> DataFrame:
        a, b = (sketch.select(F.col("doc_id").alias(side), F.col("sketch").alias(f"s_{side}")) for side in ("src", "dst"))
        return pairs.join(a, "src").join(b, "dst").filter(_close("s_src", "s_dst", limit)).select("src", "dst")

    stars = buckets.select("doc_id", F.explode("pivots").alias("pivot")).filter("doc_id <> pivot").select(
        F.least("pivot", "doc_id").alias("src"), F.greatest("pivot", "doc_id").alias("dst")).distinct()
    tried = lineage.cut(near(stars))
    found = lineage.cut(_confirm(tried, texts, percent, shingle))
    parts = connected_components(found).select(F.col("node").alias("doc_id"), "component")
    placed = buckets.join(parts, "doc_id", "left").select("cell", "n", "doc_id", F.coalesce("component", "doc_id").alias("part"))
    shares = placed.groupBy("cell", "part").agg(F.count(F.lit(1)).alias("m"))
    mixed = shares.groupBy("cell").agg(F.count(F.lit(1)).alias("parts"), F.max_by("part", F.struct("m", "part")).alias("main")).filter("parts > 1")
    open_cells = lineage.cut(placed.join(mixed.select("cell", "main"), "cell"))
    rest = open_cells.filter("part <> main")
    small = F.col("n") <= SMALL_BUCKET
    side = lambda df, name: df.select("cell", F.col("doc_id").alias(name), F.col("part").alias(f"p_{name}"), F.col("main").alias(f"m_{name}"))
    # of two members outside the main component, the smaller id asks
    few = side(rest.filter(small), "x").join(side(open_cells.filter(small), "y"), "cell").filter(
        "p_x <> p_y AND (p_y = m_y OR x < y)").select(F.least("x", "y").alias("src"), F.greatest("x", "y").alias("dst")).distinct()
    in_large = open_cells.filter(~small).select("doc_id").distinct()
    known = lineage.cut(sketch.join(_sets(texts.join(in_large, "doc_id", "left_semi"), shingle), "doc_id"))
    many = _block_pairs(rest.filter(~small), open_cells.filter(~small), known, limit, percent)
    again = near(few).unionByName(many).distinct().join(tried, ["src", "dst"], "left_anti")
    return found.unionByName(_confirm(lineage.cut(again), texts, percent, shingle))


def _sets(texts: DataFrame, shingle: int) -> DataFrame:
    """(doc_id, size, marks): each text's set size and the set as sorted 32-bit halves of its hashes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in words.parts(batch, "text"):
                hashes, begins = shingles(part.column("text"), shingle)
                halves = (hashes >> np.uint64(32)).astype("<u4")
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(np.diff(begins), pa.int64()), pa.array([halves[a:b].tobytes() for a, b in zip(begins[:-1], begins[1:], strict=True)], pa.binary())],
                    names=["doc_id", "size", "marks"])

    return texts.mapInArrow(run, "doc_id long, size long, marks binary")


def _common(xs: list[np.ndarray], ys: list[np.ndarray]) -> Iterator[np.ndarray]:
    """For each x, how many of its marks each y holds; one posting list of the ys serves all xs."""
    marks = np.concatenate(ys) if ys else np.zeros(0, np.uint32)
    owner = np.repeat(np.arange(len(ys)), [len(y) for y in ys])
    order = np.argsort(marks, kind="stable")
    marks, owner = marks[order], owner[order]
    for x in xs:
        low, high = np.searchsorted(marks, x, "left"), np.searchsorted(marks, x, "right")
        n = high - low
        ends = np.cumsum(n)
        places = np.repeat(low - (ends - n), n) + np.arange(int(ends[-1]) if len(ends) else 0)
        yield np.bincount(owner[places], minlength=len(ys))


def _block_pairs(askers: DataFrame, others: DataFrame, members: DataFrame, limit: int, percent: int) -> DataFrame:
    """Pairs of different components in large buckets that pass sketch and set. Both sides are cut into blocks of about ``BLOCK`` members; a task
    compares one block with another. Sets are compared by 32-bit marks with one mark of slack for collisions: only a superset of the links comes out."""
    names = ("cell", "bx", "by", "doc_id", "part", "sketch", "size", "marks")
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    salted = lambda df: df.withColumn("_b", F.pmod(F.xxhash64("doc_id"), blocks).cast("int")).join(members, "doc_id")
    each = F.explode(F.sequence(F.lit(0), blocks - 1))
    left = salted(askers).select("cell", F.col("_b").alias("bx"), each.alias("by"), *names[3:]).toDF(*names)
    right = salted(others).select("cell", each.alias("bx"), F.col("_b").alias("by"), *names[3:]).toDF(*names)

    def run(_, xs: pd.DataFrame, ys: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(xs) and len(ys):
            y_bits = np.stack(ys["sketch"].to_numpy()).view(np.uint64)
            y_ids, y_parts, y_sizes = ys["doc_id"].to_numpy(), ys["part"].to_numpy(), ys["size"].to_numpy()
            sets = [[np.frombuffer(m, dtype="<u4") for m in side["marks"]] for side in (xs, ys)]
            x_bits = np.stack(xs["sketch"].to_numpy()).view(np.uint64)
            for x, part, size, bits, both in zip(xs["doc_id"].to_numpy(), xs["part"].to_numpy(), xs["size"].to_numpy(), x_bits, _common(*sets), strict=True):
                close = (y_parts != part) & (np.bitwise_count(y_bits ^ bits).sum(axis=1) <= limit)
                hit = y_ids[close & (100 * (both + 1) >= percent * (size + y_sizes - both - 1))]
                out.append(np.stack([np.minimum(hit, x), np.maximum(hit, x)], axis=1))
        pairs = np.unique(np.concatenate(out), axis=0) if out else np.zeros((0, 2), np.int64)
        return pd.DataFrame({"src": pairs[:, 0], "dst": pairs[:, 1]})

    return left.groupBy("cell", "bx", "by").cogroup(right.groupBy("cell", "bx", "by")).applyInPandas(run, "src long, dst long")


def _placed(docs: DataFrame, id_col: str, text_col: str, percent: int, shingle: int) -> DataFrame:
    """One row per row of ``docs``: doc_id, tag, n_shingles, component_id and kept."""
    prepared = lineage.cut(prepare(docs, id_col, text_col, shingle))
    classes = lineage.cut(classes_of(prepared))
    parts = connected_components(links(prepared, classes, docs, id_col, text_col, percent, shingle)).join(classes.select("node", "least"), "node")
    ids = parts.groupBy("component").agg(F.min("least").alias("_part"))
    linked = parts.join(ids, "component").select(F.col("node").alias("_node"), "_part")
    # a class's rows may be many: the map side has at most one row per class, and AQE splits a hot one
    placed = classes.join(linked, F.col("node") == F.col("_node"), "left").select("set_key", F.coalesce("_part", "least").alias("_part"))
    member = prepared.select("doc_id", "tag", "n_shingles", "set_key")
    return member.join(placed, "set_key", "left").select(
        "doc_id", "tag", "n_shingles", F.coalesce("_part", "doc_id").alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, shingle: int = SHINGLE) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id (smallest id reachable) and kept."""
    return _placed(docs, id_col, text_col, percent, shingle).drop("tag")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, shingle: int = SHINGLE) -> DataFrame:
    """The rows of ``docs``, all columns, that carry the smallest id of their component; rows with a null id stay.

    Rows are matched by id and text, so of rows that repeat an id only the text that has an earlier near copy goes.
    """
    gone = _placed(docs, id_col, text_col, percent, shingle).filter("NOT kept").select(F.col("doc_id").alias("_gone"), F.col("tag").alias("_tag")).distinct()
    doc = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc")
    own = docs.select(doc, F.col(f"`{id_col}`").cast("long").alias("_id"), F.xxhash64(F.col(f"`{text_col}`").cast("string")).alias("_text"))
    return own.join(gone, (F.col("_id") == F.col("_gone")) & (F.col("_text") == F.col("_tag")), "left_anti").select("_doc.*")


@query("op5_near_dedup")
def op5_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return components(documents(spark, folder))
