"""Ranked lexical search: the best documents of every item, by a hybrid of term-at-a-time and document-at-a-time evaluation.

Items are the queries and are collected in slices of about ``SLICE_BYTES`` of text (a hash of the item id names the slice), one pass over the documents
for each slice; documents never leave their task. A pass reads them twice:

1. statistics: documents with a term, all terms, and the document frequency of the slice's terms, added up over tasks;
2. search: every Arrow batch becomes an inverted index of the slice's terms. For each item the shortest lists are merged term at a time into summed
   accumulators. These, sorted by document and with their greatest sum as bound, act as one more iterator beside the long lists, which are taken in the
   order of their bounds: once the bounds that are left cannot reach the tenth best score so far, no new document can enter, and the rest of the lists
   is only looked up (skipped through) for the documents still in the race, ``STEP`` documents at a time. Scores so far, carried from batch to batch,
   raise the bar.

Each task gives at most ``k`` rows an item; those are ranked in two levels, so that no item's rows of all tasks meet in one. Bounds are exact integers
and only skip documents that lie strictly below the bar, so the result is that of scoring everything. Terms are compared by 64-bit hashes.

Null texts have no terms. Item rows that repeat an id are one item with the terms of all; a null item id is an item of its own. Rows of documents that
repeat an id are ranked by themselves; null ids come last among equal scores. Long texts are read whole. Empty tables give empty results. Other columns
are never looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

from mailgraph.llm import words
from mailgraph.llm.registry import documents, query

K = 10
SLICE_BYTES = 4 << 20
#: lists are merged into accumulators while their sizes add up to less than this share of the batch's documents
SHORT_SHARE = 0.5
STEP = 2048
SALTS = 64
#: term bytes after lower-casing A-Z: digits, letters and everything beyond ASCII; all others become blanks
_TERM = np.full(256, 0x20, dtype=np.uint8)
_TERM[0x30:0x3A] = np.arange(0x30, 0x3A)
_TERM[0x41:0x5B] = np.arange(0x61, 0x7B)
_TERM[0x61:0x7B] = np.arange(0x61, 0x7B)
_TERM[0x80:] = np.arange(0x80, 0x100)


def terms(texts: pa.Array) -> words.Words:
    offsets, data = words.flat(texts)
    low, high = int(offsets[0]), int(offsets[-1])
    plain = pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(np.ascontiguousarray(offsets - low)), pa.py_buffer(_TERM[data[low:high]]))
    return words.split(plain)


@dataclass
class Items:
    """The items of one slice: distinct term hashes, and each item's terms as places among them."""
    ids: pa.Array
    hashes: np.ndarray
    terms: list[np.ndarray]

    @classmethod
    def of(cls, rows: pa.Table) -> Items:
        rows = rows.combine_chunks()
        found = terms(rows.column("text").combine_chunks() if rows.num_rows else pa.array([], pa.string()))
        hashes, back = np.unique(found.hash, return_inverse=True)
        places: dict[object, set[int]] = {}
        for row, (item, a, b) in enumerate(zip(rows.column("item").to_pylist(), found.first()[:-1], found.first()[1:], strict=True)):
            places.setdefault(item, set()).update(back[a:b].tolist())
        kept = {item: own for item, own in places.items() if own}
        return cls(pa.array(list(kept), rows.schema.field("item").type), hashes, [np.array(sorted(own), dtype=np.int64) for own in kept.values()])


def postings(texts: pa.Array, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(terms of each text, then term, text and frequency of every posting, sorted by term and text)."""
    found = terms(texts)
    at = np.searchsorted(hashes, found.hash)
    at[at == len(hashes)] = 0
    hit = hashes[at] == found.hash if len(hashes) else np.zeros(len(at), bool)
    key, frequency = np.unique(at[hit] * len(texts) + found.doc[hit], return_counts=True)
    return np.bincount(found.doc, minlength=len(texts)), key // max(len(texts), 1), key % max(len(texts), 1), frequency


@dataclass
class Index:
    """Inverted lists of one batch with each posting's share of the score."""
    rows: int
    begins: np.ndarray
    docs: np.ndarray
    values: np.ndarray
    bounds: np.ndarray

    @classmethod
    def of(cls, batch: pa.RecordBatch, hashes: np.ndarray, weights: np.ndarray, count: int, length: int) -> Index:
        sizes, lists, first = [], [], 0
        for part in words.parts(batch, "text"):
            n, term, doc, frequency = postings(part.column(part.schema.names.index("text")), hashes)
            sizes.append(n)
            lists.append((term, doc + first, frequency))
            first += part.num_rows
        n = np.concatenate(sizes)
        term, doc, frequency = (np.concatenate(x) for x in zip(*lists, strict=True))
        order = np.argsort(term, kind="stable")
        term, doc, frequency = term[order], doc[order], frequency[order]
        stretch = 100 - 90 + (90 * n * count) // max(length, 1)
        values = weights[term] * ((1_000_000_000 * frequency) // (1000 * frequency + 8 * stretch[doc]))
        begins = np.searchsorted(term, np.arange(len(hashes) + 1))
        bounds = np.zeros(len(hashes), dtype=np.int64)
        some = np.flatnonzero(np.diff(begins))
        if len(some):
            bounds[some] = np.maximum.reduceat(values, begins[some])
        return cls(batch.num_rows, begins, doc, values, bounds)

    def list_of(self, term: int) -> tuple[np.ndarray, np.ndarray]:
        a, b = self.begins[term], self.begins[term + 1]
        return self.docs[a:b], self.values[a:b]


def accumulated(index: Index, short: np.ndarray) -> np.ndarray:
    """Term at a time: each document's sum over the short lists."""
    sums = np.zeros(index.rows, dtype=np.int64)
    for term in short:
        docs, values = index.list_of(term)
        sums[docs] += values  # a list holds a document once
    return sums


def best(index: Index, own: np.ndarray, k: int, bar: int) -> tuple[np.ndarray, np.ndarray]:
    """(documents, scores) of all that reach ``bar`` and, if there are more than ``k``, the k-th best found so far."""
    sizes = index.begins[own + 1] - index.begins[own]
    own, sizes = own[(sizes > 0) & (index.bounds[own] > 0)], sizes[(sizes > 0) & (index.bounds[own] > 0)]
    order = np.argsort(sizes, kind="stable")
    few = int(np.searchsorted(np.cumsum(sizes[order]), index.rows * SHORT_SHARE, "right"))
    sums = accumulated(index, own[order[:few]])
    seen = np.flatnonzero(sums)
    if len(seen) >= k:
        bar = max(bar, int(np.partition(sums[seen], len(seen) - k)[len(seen) - k]))
    long = own[order[few:]]
    long = long[np.argsort(-index.bounds[long], kind="stable")]
    left = np.append(np.cumsum(index.bounds[long][::-1])[::-1], 0)  # what the lists from here on can add
    entering = int(np.argmax(left < bar))  # documents in none of the lists before this one cannot reach the bar
    race = seen[sums[seen] + left[0] >= bar]
    if entering:
        race = np.unique(np.concatenate([race, *[index.list_of(t)[0] for t in long[:entering]]]))
    docs, scores = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for at in range(0, len(race), STEP):
        now = race[at:at + STEP]
        score = sums[now]
        for j, term in enumerate(long):
            alive = score + left[j] >= bar
            if not alive.all():
                now, score = now[alive], score[alive]
            if not len(now):
                break
            listed, values = index.list_of(term)
            place = np.searchsorted(listed, now)  # skips to each document of the race
            place[place == len(listed)] = 0
            score = score + np.where(listed[place] == now, values[place], 0)
        alive = score >= bar
        docs.append(now[alive])
        scores.append(score[alive])
        if alive.any():
            every = np.concatenate(scores)
            if len(every) >= k:
                bar = max(bar, int(np.partition(every, len(every) - k)[len(every) - k]))
    found, value = np.concatenate(docs), np.concatenate(scores)
    return found[value >= bar], value[value >= bar]


@dataclass
class Ranks:
    """The best rows of one item so far."""
    ids: pa.Array
    scores: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))

    def bar(self, k: int) -> int:
        return int(self.scores[-1]) if len(self.scores) == k else 1

    def add(self, ids: pa.Array, scores: np.ndarray, k: int) -> None:
        every = pa.table({"id": pa.concat_arrays([self.ids, ids]), "score": np.concatenate([self.scores, scores])})
        first = pc.sort_indices(every, sort_keys=[("score", "descending"), ("id", "ascending")], null_placement="at_end")[:k]
        every = every.take(first)
        self.ids, self.scores = every.column("id").combine_chunks(), every.column("score").to_numpy()


def _statistics(hashes: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequency, count, length = np.zeros(len(hashes), np.int64), 0, 0
        for batch in batches:
            for part in words.parts(batch, "text"):
                n, term, _, _ = postings(part.column(0), hashes)
                frequency += np.bincount(term, minlength=len(hashes))
                count, length = count + int((n > 0).sum()), length + int(n.sum())
        used = np.flatnonzero(frequency)
        yield pa.RecordBatch.from_pydict({"term": pa.array([-1, -2, *used], pa.int64()), "n": pa.array([count, length, *frequency[used]], pa.int64())})

    return run


def _searching(items: Items, weights: np.ndarray, count: int, length: int, k: int, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = [Ranks(pa.array([], schema.field("doc_id").type)) for _ in items.terms]
        for batch in batches:
            if not batch.num_rows:
                continue
            index = Index.of(batch, items.hashes, weights, count, length)
            ids = batch.column(batch.schema.names.index("doc_id")).cast(schema.field("doc_id").type)
            for own, rank in zip(items.terms, ranks, strict=True):
                docs, scores = best(index, own, k, rank.bar(k))
                if len(docs):
                    rank.add(ids.take(pa.array(docs)), scores, k)
        where = np.repeat(np.arange(len(ranks)), [len(r.scores) for r in ranks])
        if len(where):
            yield pa.RecordBatch.from_arrays([
                items.ids.take(pa.array(where)), pa.concat_arrays([r.ids for r in ranks]), pa.array(np.concatenate([r.scores for r in ranks]))], schema=schema)

    return run


def _weights(frequency: np.ndarray, count: int) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * count + 2) / (2 * int(df) + 1))) for df in frequency], dtype=np.int64)


def _slice(texts: DataFrame, items: Items, item_type: DataType, k: int) -> DataFrame | None:
    """item_id, doc_id, score: at most ``k`` rows an item and task."""
    if not items.terms:
        return None
    seen = texts.select("text").mapInArrow(_statistics(items.hashes), "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    rows = {r["term"]: r["n"] for r in seen.collect()}  # at most one row per term of the slice
    count, length = rows.pop(-1, 0), rows.pop(-2, 0)
    frequency = np.zeros(len(items.hashes), np.int64)
    for term, n in rows.items():
        frequency[term] = n
    doc_type = texts.schema["doc_id"].dataType
    schema = pa.schema([("item_id", items.ids.type), ("doc_id", to_arrow_type(doc_type)), ("score", pa.int64())])
    return texts.mapInArrow(
        _searching(items, _weights(frequency, count), count, length, k, schema),
        f"item_id {item_type.simpleString()}, doc_id {doc_type.simpleString()}, score long")


def search(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
           k: int = K) -> DataFrame:
    """item_id, rank, doc_id, score: the ``k`` best documents of every item with a score above 0."""
    texts = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    wanted = items.select(F.col(item_col).alias("item"), F.coalesce(F.col(item_text_col).cast("string"), F.lit("")).alias("text"))
    size = wanted.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    slices = max(1, -(-size // SLICE_BYTES))
    item_type = wanted.schema["item"].dataType
    found = None
    for i in range(slices):
        part = _slice(texts, Items.of(wanted.filter(F.pmod(F.xxhash64("item"), F.lit(slices)) == i).toArrow()), item_type, k)
        if part is not None:
            found = part if found is None else found.unionByName(part)
    if found is None:
        found = texts.filter(F.lit(False)).select(F.lit(None).cast(item_type).alias("item_id"), "doc_id", F.lit(0).cast("long").alias("score"))
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    salted = found.withColumn("_salt", F.pmod(F.spark_partition_id(), F.lit(SALTS)))
    first = salted.withColumn("_rank", F.row_number().over(Window.partitionBy("item_id", "_salt").orderBy(*order))).filter(F.col("_rank") <= k)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy(*order))).filter(F.col("rank") <= k)
    return ranked.select("item_id", "rank", "doc_id", "score")


@query("op11_ranked_search", r"""
    WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                      '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM documents),
    i AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                      '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
    total AS (SELECT count(*) AS c, sum(len(ws))::BIGINT AS l FROM d WHERE len(ws) > 0),
    tf AS (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, len(ws) AS n, unnest(ws) AS term FROM d) WHERE term IN (SELECT term FROM i) GROUP BY doc_id, n, term),
    w AS (SELECT term, floor(1000 * ln((2 * c + 2) / (2 * df + 1)))::BIGINT AS w FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), total),
    scored AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * c) // l))))::BIGINT AS score
               FROM i JOIN w USING (term) JOIN tf USING (term), total GROUP BY item_id, doc_id),
    ranked AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM scored WHERE score > 0)
    SELECT item_id, rank::INT AS rank, doc_id, score FROM ranked WHERE rank <= 10""")
def op11_ranked_search(spark: SparkSession, folder: str) -> DataFrame:
    return search(documents(spark, folder), spark.read.parquet(f"{folder.rstrip('/')}/benchmark.parquet"))
