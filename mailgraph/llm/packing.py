"""Packing documents into training sequences: hierarchical packing over several context sizes.

Documents are tokenized once, in the pass that reads them. A document longer than the longest window gives whole windows and one rest; every rest
is routed to the tier of the smallest context size that holds it. Lengths alone are then packed, in groups of a bounded number of pieces
that hash evenly: each tier, from the longest down, opens a window of its size for every piece of its own and fills the gap with the largest
pieces that fit from the shorter tiers. A full window becomes a sequence of that size; a short one with a gap moves up as a whole into sequences of the
longest size, so only those can hold padding. Sequences are dealt to step groups in order of their real tokens, back and
forth, so groups carry nearly equal work.

Null texts count as empty: they give the end id alone. Pieces keep their document's order by ``start``. Rows that repeat an id are packed separately;
empty tables give empty results. Other columns are never looked at.
"""

from __future__ import annotations

import bisect
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailgraph.llm import words
from mailgraph.llm.registry import documents, query
from mailgraph.plans import lineage

TIERS = (256, 512, 1024, 2048)
END = 1
VOCABULARY = "word_bpe_49k.json"
#: pieces packed by one task at a time, about
GROUP = 20_000
STEP = 64
#: distinct words a worker remembers
REMEMBERED = 800_000
#: fixed values: how the vocabulary's pre-tokenizer cuts plain ASCII words, once lower-cased
ASCII_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+")
PLAIN = re.compile(r"[!-;=-~]+")


class Encoder:
    """Ids of texts, word by word: white space always parts tokens, so a word's ids do not depend on its neighbours.

    Words of printable ASCII without ``<`` (no special tokens) need no normalising but lower case and go to the model piece by piece; others are
    encoded by the whole tokenizer. Both are remembered by the word's hash.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.pieces: dict[str, list[int]] = {}
        self.forget()

    def forget(self) -> None:
        self.keys = np.zeros(0, dtype=np.uint64)   # sorted hashes of known words
        self.slots = np.zeros(0, dtype=np.int64)   # their places in begins
        self.begins = np.zeros(1, dtype=np.int64)  # where each word's ids begin
        self.ids = np.zeros(0, dtype=np.uint16)
        self.pieces.clear()

    def _piece(self, piece: str) -> list[int]:
        found = self.pieces.get(piece)
        if found is None:
            if len(self.pieces) >= REMEMBERED // 4:
                self.pieces.clear()
            found = self.pieces[piece] = [t.id for t in self.model.tokenize(piece)]
        return found

    def _encode(self, texts: list[str]) -> list[list[int]]:
        out: list[list[int] | None] = [None] * len(texts)
        other = []
        for i, text in enumerate(texts):
            if PLAIN.fullmatch(text):
                ids: list[int] = []
                for piece in ASCII_PIECES.findall(text.lower()):
                    ids += self._piece(piece)
                out[i] = ids
            else:
                other.append(i)
        for i, found in zip(other, self.tokenizer.encode_batch_fast([texts[i] for i in other], add_special_tokens=False), strict=True):
            out[i] = found.ids
        return out

    def _learn(self, found: words.Words, hashes: np.ndarray, where: np.ndarray) -> None:
        lists = self._encode([found.text(i) for i in where])
        lengths = np.fromiter((len(x) for x in lists), dtype=np.int64, count=len(lists))
        known = len(self.begins) - 1
        self.begins = np.concatenate([self.begins, self.begins[-1] + np.cumsum(lengths)])
        self.ids = np.concatenate([self.ids, np.fromiter((i for x in lists for i in x), dtype=np.uint16, count=int(lengths.sum()))])
        keys, slots = np.concatenate([self.keys, hashes]), np.concatenate([self.slots, known + np.arange(len(hashes))])
        order = np.argsort(keys, kind="stable")
        self.keys, self.slots = keys[order], slots[order]

    def spell(self, found: words.Words, distinct: np.ndarray, where: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the distinct words one after another, how many each has); ``where`` is a place of each in ``found``."""
        if not len(distinct):
            return np.zeros(0, np.uint16), np.zeros(0, np.int64)
        at = np.searchsorted(self.keys, distinct)
        new = np.ones(len(distinct), dtype=bool)
        inside = at < len(self.keys)
        new[inside] = self.keys[at[inside]] != distinct[inside]
        if len(self.keys) + int(new.sum()) > REMEMBERED:
            self.forget()
            new[:] = True
        if new.any():
            self._learn(found, distinct[new], where[new])
        slots = self.slots[np.searchsorted(self.keys, distinct)]
        return gather(self.ids, self.begins[slots], self.begins[slots + 1] - self.begins[slots])

    def encode_found(self, found: words.Words, unique: tuple[np.ndarray, ...] | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words, where each word's ids begin and the total); ``unique`` is what np.unique gives for the hashes, if known."""
        distinct, where, back = unique or np.unique(found.hash, return_index=True, return_inverse=True)
        flat, lengths = self.spell(found, distinct, where)
        ids, own = gather(flat, (np.cumsum(lengths) - lengths)[back], lengths[back])
        return ids, np.concatenate([[0], np.cumsum(own)]).astype(np.int64)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, where each text's ids begin and the total at the end)."""
        found = words.split(texts)
        ids, ends = self.encode_found(found)
        return ids, ends[found.first()]


def gather(values: np.ndarray, begins: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs of ``values`` that start at ``begins``, one after another, and their lengths."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return values[np.repeat(begins - (ends - lengths), lengths) + np.arange(total)], lengths


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def forget_words() -> None:
    """For a worker that goes on to stages that encode nothing."""
    for coder in _ENCODERS.values():
        coder.forget()


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


PIECE = "doc_id {kind}, _row long, start long, length long, ids_crc32 long, doc_tokens long"


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", longest: int = TIERS[-1], path: str | None = None) -> DataFrame:
    """One row per piece: whole windows of a long document and its rest, with the checksum of the piece's ids."""
    kind = docs.select(F.col(id_col)).schema[0].dataType.simpleString()
    schema = PIECE.format(kind=kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path or vocabulary_path())
        for batch in batches:
            for part in words.parts(batch, "text"):
                ids, begins = coder.encode(part.column("text"))
                rows, starts, lengths, sums, totals = [], [], [], [], []
                for row in range(part.num_rows):
                    own = np.append(ids[begins[row]:begins[row + 1]], END).astype("<u4")
                    for start in range(0, len(own), longest):
                        piece = own[start:start + longest]
                        rows.append(row)
                        starts.append(start)
                        lengths.append(len(piece))
                        sums.append(zlib.crc32(piece.tobytes()))
                        totals.append(len(own))
                taken = pa.array(rows, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").take(taken), part.column("_row").take(taken), pa.array(starts, pa.int64()), pa.array(lengths, pa.int64()),
                     pa.array(sums, pa.int64()), pa.array(totals, pa.int64())],
                    names=["doc_id", "_row", "start", "length", "ids_crc32", "doc_tokens"])
        coder.forget()  # a worker that goes on to other stages keeps no words

    return docs.select(
        F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.monotonically_increasing_id().alias("_row")).mapInArrow(run, schema)


class _Pool:
    """Piece numbers by length; gives the longest piece that still fits."""

    def __init__(self) -> None:
        self.by_length: dict[int, list] = {}
        self.lengths: list[int] = []

    def add(self, length: int, item) -> None:
        if length not in self.by_length:
            self.by_length[length] = []
            bisect.insort(self.lengths, length)
        self.by_length[length].append(item)

    def take(self, room: int):
        at = bisect.bisect_right(self.lengths, room) - 1
        if at < 0:
            return 0, None
        length = self.lengths[at]
        items = self.by_length[length]
        item = items.pop()
        if not items:
            del self.by_length[length], self.lengths[at]
        return length, item

    def drain(self, above: int) -> Iterator[tuple[int, object]]:
        """Takes pieces longer than ``above``, longest first."""
        while self.lengths and self.lengths[-1] > above:
            yield self.take(self.lengths[-1])


def arrange(lengths: list[int], tiers: tuple[int, ...] = TIERS) -> list[list[int]]:
    """Sequences as lists of piece numbers; every length is from 1 to the longest tier."""
    pool, sequences = _Pool(), []
    for number, length in enumerate(lengths):
        pool.add(length, [number])
    below = (0, *tiers)

    def fill(window: list[int], room: int) -> int:
        while room:
            length, item = pool.take(room)
            if item is None:
                break
            window += item
            room -= length
        return room

    waiting = []
    for place in reversed(range(len(tiers))):  # long windows first: their gaps take the best of the shorter tiers
        for length, window in pool.drain(below[place]):
            room = fill(window, tiers[place] - length)
            if room and tiers[place] < tiers[-1]:
                waiting.append((tiers[place] - room, window))
            else:
                sequences.append(window)
    for length, window in waiting:  # short windows with gaps move up as a whole
        pool.add(length, window)
    for length, window in pool.drain(0):
        fill(window, tiers[-1] - length)
        sequences.append(window)
    return sequences


def pack(found: DataFrame, tiers: tuple[int, ...] = TIERS, group: int = GROUP, step: int = STEP) -> DataFrame:
    """Adds sequence_id, offset, tier (the sequence's size) and step_group to pieces."""
    found = lineage.cut(found)
    groups = max(1, -(-found.count() // group))
    kind = found.schema["doc_id"].dataType.simpleString()

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["_row", "start"], kind="stable").reset_index(drop=True)
        lengths = rows["length"].tolist()
        sequences = arrange(lengths, tiers)
        tokens = [sum(lengths[i] for i in s) for s in sequences]
        order = sorted(range(len(sequences)), key=lambda i: -tokens[i])
        steps = max(1, -(-len(sequences) // step))
        dealt = [0] * len(sequences)
        for place, i in enumerate(order):
            turn, seat = divmod(place, steps)
            dealt[i] = seat if turn % 2 == 0 else steps - 1 - seat
        number, offset = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
        for n, s in enumerate(sequences):
            at = 0
            for i in s:
                number[i], offset[i] = n, at
                at += lengths[i]
        base = int(rows["_group"].iloc[0]) << 32
        sizes = np.array([next(t for t in tiers if t >= k) if k in tiers else tiers[-1] for k in tokens], dtype=np.int64)
        return pd.DataFrame({
            "doc_id": rows["doc_id"], "start": rows["start"], "length": rows["length"], "ids_crc32": rows["ids_crc32"], "doc_tokens": rows["doc_tokens"],
            "sequence_id": base + number, "offset": offset, "tier": sizes[number], "step_group": base + np.array(dealt, dtype=np.int64)[number]})

    return found.withColumn("_group", F.pmod(F.xxhash64("_row", "start"), F.lit(groups)).cast("int")).groupBy("_group").applyInPandas(
        run, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier long, step_group long")


@query("op8_packing")
def op8_packing(spark: SparkSession, folder: str) -> DataFrame:
    return pack(pieces(documents(spark, folder)))
