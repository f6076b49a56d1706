"""Removal of repeated passages: prefix-partitioned sparse suffix trees.

A passage is a window of ``WINDOW`` consecutive words of one text; a word goes when a window over it also starts in a text with a smaller id.

Suffixes are sampled: every window holds an anchor, the place of its smallest ``PREFIX``-word hash (a minimizer), and equal windows hold the same
anchor at the same place. So only suffixes that start at anchors are kept, about two in forty, and a suffix belongs to the group of its first
``PREFIX`` words. Groups whose prefix occurs in one text only are dropped at once. Each remaining suffix travels once, with the words left of its
anchor, and groups are dealt to memory-sized partitions by their prefix. There, the trie of the suffixes is built level by level, and the
trie of the reversed words left of the anchors likewise: nodes are numbered, a node's leaves are the suffixes with equal numbers. A window that starts
``o`` words before its anchor is a leaf pair's common node at depth ``o`` to the left and ``WINDOW - o`` to the right; of the texts below such a pair
of deep nodes, all but the smallest id lose the window.

A group too large for memory (a passage in a large share of all texts) gets longer prefixes: its suffixes are extended to whole windows, so every
subtree is one deep node and an aggregation with a map-side minimum replaces its tree. No group is ever gathered whole.

Copies of a whole text are settled by digest before any suffix is made: all but the smallest id lose every word, if they have a window at all.
Windows are judged on the input. Null texts have no words; texts with fewer words than a window keep all. Rows that repeat an id are one document:
none removes words of another, and what is found in one is removed from all of them. Null ids lose no words and remove none. Empty tables give empty results.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailgraph.llm import words
from mailgraph.llm.registry import documents, query
from mailgraph.plans import lineage

WINDOW = 50
PREFIX = 8
#: suffixes of one partition, about
PARTITION = 20_000
#: suffixes of one group that are built into a tree: as many as fill a partition; larger groups are split by longer prefixes
GROUP = PARTITION
#: a range that stands for the whole text
COPY = (1 << 31) - 1


def _anchors(found: words.Words, window: int, prefix: int) -> tuple[np.ndarray, np.ndarray]:
    """(first word of each window inside one text, first word of its anchor), as places in ``found``."""
    n = len(found.hash) - window + 1
    if n <= 0:
        none = np.zeros(0, np.int64)
        return none, none
    grams = words.windows(found.hash, prefix)
    span = window - prefix + 1
    best = np.arange(len(grams))
    reach = 1
    while reach < span:  # places of the smallest hash in runs of growing length; the leftmost of equals wins
        step = min(reach, span - reach)
        left, right = best[:len(best) - step], best[step:]
        best = np.where(grams[left] <= grams[right], left, right)
        reach += step
    starts = np.flatnonzero(found.doc[:n] == found.doc[window - 1:])
    return starts, best[starts]


def anchors(docs: DataFrame, window: int, prefix: int) -> DataFrame:
    """(doc_id, gram, at, low, high): every anchor's prefix hash, its word number, and the first and last start of the windows it stands for."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in words.parts(batch, "text"):
                found = words.split(part.column("text"))
                starts, places = _anchors(found, window, prefix)
                fresh = np.ones(len(places), dtype=bool)
                fresh[1:] = places[1:] != places[:-1]
                at = np.flatnonzero(fresh)
                last = np.append(at[1:], len(places)) - 1 if len(at) else at
                grams = words.windows(found.hash, prefix)[places[at]].view(np.int64) if len(at) else np.zeros(0, np.int64)
                doc = found.doc[starts[at]]
                base = found.first()[doc]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").take(pa.array(doc)), pa.array(grams), pa.array((places[at] - base).astype(np.int32)),
                     pa.array((starts[at] - base).astype(np.int32)), pa.array((starts[last] - base).astype(np.int32))],
                    names=["doc_id", "gram", "at", "low", "high"])

    return docs.mapInArrow(run, "doc_id long, gram long, at int, low int, high int")


def suffixes(marked: DataFrame, window: int) -> DataFrame:
    """(gram, doc_id, at, low, high, large, passage) from (doc_id, text, marks): each marked anchor with the text from ``low`` to the end of its last window."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in words.parts(batch, "text"):
                found = words.split(part.column("text"))
                marks = part.column("marks")
                values = marks.flatten()
                row = np.repeat(np.arange(part.num_rows), np.diff(marks.offsets.to_numpy()))
                low, high = (values.field(k).to_numpy() for k in ("low", "high"))
                base = found.first()[row]
                begins, ends = found.start[base + low], found.end[base + high + window - 1]
                raw = found.data.tobytes()
                passages = pa.array([raw[b:e] for b, e in zip(begins, ends, strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [values.field("gram"), part.column("doc_id").take(pa.array(row)), values.field("at"), values.field("low"), values.field("high"),
                     values.field("large"), passages], names=["gram", "doc_id", "at", "low", "high", "large", "passage"])

    return marked.mapInArrow(run, "gram long, doc_id long, at int, low int, high int, large boolean, passage binary")


def _codes(passages: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(word numbers of all passages, where each passage begins); equal words get equal numbers, compared by their bytes' hash."""
    found = words.split(passages.cast(pa.string()))
    return np.unique(found.hash, return_inverse=True)[1].astype(np.int64), found.first()


def _deeper(nodes: np.ndarray, step: np.ndarray) -> np.ndarray:
    """Numbers of the trie nodes one level down, from the node and the next word of each suffix (-1: it has ended)."""
    return np.unique(nodes * (int(step.max(initial=0)) + 2) + step + 1, return_inverse=True)[1].astype(np.int64)


def repeats(grams: np.ndarray, ids: np.ndarray, at: np.ndarray, low: np.ndarray, high: np.ndarray, passages: pa.Array, window: int) -> np.ndarray:
    """Windows that also start in a text with a smaller id, as (suffix number, start) pairs."""
    codes, first = _codes(passages)
    length = np.diff(first)
    left = at - low  # words before the anchor
    rows = np.arange(len(ids))
    roots = np.unique(grams, return_inverse=True)[1].astype(np.int64)

    def word(offset: np.ndarray | int) -> np.ndarray:
        place = left + offset
        inside = (place >= 0) & (place < length)
        out = np.full(len(rows), -1, dtype=np.int64)
        out[inside] = codes[first[:-1][inside] + place[inside]]
        return out

    forward = [roots]
    for depth in range(window):
        forward.append(_deeper(forward[-1], word(depth)))
    found, backward = [], roots
    for o in range(int(left.max(initial=-1)) + 1):
        if o:
            backward = _deeper(backward, word(-o))
        start = at - o
        here = np.flatnonzero((start >= low) & (start <= high))
        if not len(here):
            continue
        right = forward[window - o][here]
        node = backward[here] * (int(right.max()) + 1) + right
        order = np.lexsort((ids[here], node))
        ordered = node[order]
        head = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
        least = np.repeat(ids[here][order][head], np.diff(np.append(head, len(order))))
        losing = here[order][ids[here][order] > least]
        found.append(np.stack([losing, start[losing]], axis=1))
    return np.concatenate(found) if found else np.zeros((0, 2), np.int64)


def _ranges(rows: np.ndarray, starts: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Consecutive starts of one suffix as ranges of covered words: (row, first word, word after the last)."""
    order = np.lexsort((starts, rows))
    rows, starts = rows[order], starts[order]
    new = np.ones(len(rows), dtype=bool)
    new[1:] = (rows[1:] != rows[:-1]) | (starts[1:] != starts[:-1] + 1)
    head = np.flatnonzero(new)
    last = np.append(head[1:], len(rows)) - 1 if len(head) else head
    return rows[head], starts[head], starts[last] + window


RANGES = "doc_id long, low int, high int"


def _trees(found: DataFrame, partitions: int, window: int) -> DataFrame:
    """Covered ranges from the groups small enough for memory: whole groups meet in one partition, their trees are built batch by batch."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def build(rows: pa.Table) -> pa.RecordBatch:
            rows = rows.combine_chunks()
            col = {k: rows.column(k).to_numpy() for k in ("gram", "doc_id", "at", "low", "high")}
            passages = pa.concat_arrays(rows.column("passage").chunks) if rows.num_rows else pa.array([], pa.binary())
            hits = repeats(col["gram"], col["doc_id"], col["at"], col["low"], col["high"], passages, window)
            row, low, high = _ranges(hits[:, 0], hits[:, 1], window)
            return pa.RecordBatch.from_arrays([pa.array(col["doc_id"][row]), pa.array(low.astype(np.int32)), pa.array(high.astype(np.int32))], names=["doc_id", "low", "high"])

        held, count = [], 0
        for batch in batches:  # sorted by gram: a tree is built when its last group is complete
            held.append(pa.Table.from_batches([batch]))
            count += batch.num_rows
            if count >= PARTITION:
                rows = pa.concat_tables(held)
                grams = rows.column("gram").to_numpy()
                cut = int(np.searchsorted(grams, grams[-1], "left"))
                if cut:
                    yield build(rows.slice(0, cut))
                held, count = [rows.slice(cut)], rows.num_rows - cut
        if count:
            yield build(pa.concat_tables(held))

    return found.repartition(partitions, "gram").sortWithinPartitions("gram").mapInArrow(run, RANGES)


def _whole_windows(found: DataFrame, window: int) -> DataFrame:
    """Covered ranges from groups split by prefixes of a whole window: a digest per window, its smallest id, and the windows of other ids."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, ids, starts = [], [], []
            for passage, doc, low, high in zip(*(batch.column(k).to_pylist() for k in ("passage", "doc_id", "low", "high")), strict=True):
                own = passage.replace(b"\t", b" ").replace(b"\n", b" ").replace(b"\v", b" ").replace(b"\f", b" ").replace(b"\r", b" ").split(b" ")
                own = [w for w in own if w]
                for start in range(low, high + 1):
                    digests.append(hashlib.blake2b(b" ".join(own[start - low:start - low + window]), digest_size=16).digest())
                    ids.append(doc)
                    starts.append(start)
            yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array(ids, pa.int64()), pa.array(starts, pa.int32())], names=["digest", "doc_id", "start"])

    # equal passages first: all but the smallest id lose them whole, and only that one's windows go on
    passages = found.withColumn("whole", F.unhex(F.sha2("passage", 256)))
    owner = passages.groupBy("whole").agg(F.min("doc_id").alias("owner"))
    owned = lineage.cut(passages.join(owner, "whole"))
    later = owned.filter("doc_id > owner").select("doc_id", "low", (F.col("high") + window).alias("high"))
    each = lineage.cut(owned.filter("doc_id = owner").drop("whole", "owner").mapInArrow(run, "digest binary, doc_id long, start int"))
    least = each.groupBy("digest").agg(F.min("doc_id").alias("least"))
    single = each.join(least, "digest").filter("doc_id > least").select("doc_id", F.col("start").alias("low"), (F.col("start") + window).alias("high"))
    return later.unionByName(single)


def _apply(texts: DataFrame, window: int) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the words that stay, joined by blanks) from (doc_id, text, ranges)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in words.parts(batch, "text"):
                found = words.split(part.column("text"))
                first = found.first()
                raw, ranges = found.data.tobytes(), part.column("ranges").to_pylist()
                removed, kept = [], []
                for row in range(part.num_rows):
                    low, n = int(first[row]), int(first[row + 1] - first[row])
                    gone = np.zeros(n + 1, dtype=np.int64)
                    for span in ranges[row] or ():
                        if n >= window:
                            gone[min(span["low"], n)] += 1
                            gone[min(span["high"], n)] -= 1
                    stay = low + np.flatnonzero(np.cumsum(gone[:-1]) == 0)
                    removed.append(n - len(stay))
                    kept.append(b" ".join([raw[b:e] for b, e in zip(found.start[stay].tolist(), found.end[stay].tolist(), strict=True)]))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(np.diff(first), pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())],
                    names=["doc_id", "n_words", "n_removed", "kept"])

    return texts.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept string")


def covered(docs: DataFrame, window: int = WINDOW, prefix: int = PREFIX, group: int = GROUP) -> tuple[DataFrame, DataFrame]:
    """((doc_id, low, high) of repeated passages, (doc_id) of later copies of whole texts), from (doc_id, text) rows."""
    digest = lineage.cut(docs.filter("doc_id IS NOT NULL").select("doc_id", F.unhex(F.sha2("text", 256)).alias("digest")))
    least = digest.groupBy("digest").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).filter("least < most")
    copies = lineage.cut(digest.join(least, "digest").filter("doc_id > least").select("doc_id").distinct())
    every = lineage.cut(anchors(docs.filter("doc_id IS NOT NULL"), window, prefix).join(copies, "doc_id", "left_anti"))
    shared = every.groupBy("gram").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"), F.count(F.lit(1)).alias("n")).filter("least < most")
    mark = F.struct("gram", "at", "low", "high", (F.col("n") > group).alias("large"))
    marks = every.join(shared.select("gram", "n"), "gram").groupBy("doc_id").agg(F.collect_list(mark).alias("marks"))
    found = lineage.cut(suffixes(docs.join(marks, "doc_id").select("doc_id", "text", "marks"), window))
    small = found.filter("NOT large")
    partitions = max(1, -(-small.count() // PARTITION))
    return _trees(small, partitions, window).unionByName(_whole_windows(found.filter("large"), window)), copies


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, group: int = GROUP) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_removed and ``kept``, the words that stay joined by blanks."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    spans, copies = covered(texts, window, group=group)
    gone = spans.select("doc_id", F.struct("low", "high").alias("span")).unionByName(
        copies.select("doc_id", F.struct(F.lit(0).alias("low"), F.lit(COPY).alias("high")).alias("span")))
    ranges = gone.groupBy("doc_id").agg(F.collect_list("span").alias("ranges"))
    return _apply(texts.join(ranges, "doc_id", "left").select("doc_id", "text", "ranges"), window)


@query("op3_substring_dedup")
def op3_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return remove_repeats(documents(spark, folder)).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
