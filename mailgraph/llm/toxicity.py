"""Toxicity by compression distance: zstandard dictionaries of toxic and of ordinary text.

Two dictionaries are made from a bounded sample of labelled rows. The toxic one is trained on the beginnings of words that mark toxic
texts (found in many of them and far oftener than in ordinary ones), the ordinary one on the words of ordinary texts; each is followed by its most
telling pieces, and ordinary windows that still look toxic are added to the ordinary one in a few rounds. A window is one run of letters, lower-cased, with the blank before it. Each of its bytes is widened to four fixed random bytes,
since a zstandard sequence costs about as much as five literals and would hide the matches of short words. The advantage of a window
is its length under the ordinary dictionary minus its length under the toxic one; a text's distance is the sum of its two largest
positive advantages over distinct windows, and the cut between the classes is calibrated on the sample.

Scores are a logistic function of distance minus cut. Texts without letters (null, empty) have distance 0. Without labelled rows
of both kinds, or without telling pieces, every score is 0. Windows are remembered per task in a bounded table; nothing is
shuffled but the sample. Repeated rows get equal results; labels, ids, languages and sources are never inputs of a score.
"""

from __future__ import annotations

import math
import re
import sys
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailgraph.llm.registry import documents, query

#: labelled rows of each class the dictionaries and the cut are fitted on, at most
SAMPLE = 2000
TOXIC_BYTES = 2048
ORDINARY_BYTES = 16384
MINING_ROUNDS = 4
MINED_BYTES = 8192
#: advantage from which an ordinary window is hard
HARD = 4
LETTERS = re.compile(r"[^\W\d_]+")
REMEMBERED = 400_000
WIDTH = 4
#: a clean text called toxic counts as so many missed toxic ones
CLEAN_WEIGHT = 4
STEEPNESS = 0.5
_WIDE = np.random.default_rng(7).integers(0, 256, (256, WIDTH), dtype=np.uint8)


@dataclass(frozen=True)
class Model:
    toxic: bytes
    ordinary: bytes
    cut: float


def windows(text: str | None) -> set[str]:
    if not text:
        return set()
    if len(text) < 1 << 20:
        return set(LETTERS.findall(text.lower()))
    return {m[0] for m in LETTERS.finditer(text.lower())}


def _pieces(word: str) -> set[str]:
    """The word with the blank before it and its beginnings of 3 to 10 letters."""
    whole = " " + word
    return {whole[:k] for k in range(4, 12)} | {whole}


def _compressor(content: bytes) -> zstandard.ZstdCompressor:
    wide = _WIDE[np.frombuffer(content, dtype=np.uint8)].tobytes()
    parameters = zstandard.ZstdCompressionParameters(
        format=zstandard.FORMAT_ZSTD1_MAGICLESS, write_content_size=False, write_checksum=False, write_dict_id=False,
        window_log=19, hash_log=16, chain_log=17, search_log=4, min_match=4, strategy=zstandard.STRATEGY_BTLAZY2)
    return zstandard.ZstdCompressor(
        compression_params=parameters, dict_data=zstandard.ZstdCompressionDict(wide, dict_type=zstandard.DICT_TYPE_RAWCONTENT))


class Scorer:
    def __init__(self, model: Model):
        self.model = model
        self.toxic, self.ordinary = _compressor(model.toxic), _compressor(model.ordinary)
        self.known: dict[str, int] = {}

    def advantage(self, window: str) -> int:
        found = self.known.get(window)
        if found is None:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            wide = _WIDE[np.frombuffer((" " + window).encode(), dtype=np.uint8)].tobytes()
            found = self.known[window] = len(self.ordinary.compress(wide)) - len(self.toxic.compress(wide))
        return found

    def distance(self, found: set[str]) -> float:
        first = second = 0
        for window in found:
            a = self.advantage(window)
            if a > second:
                first, second = max(first, a), min(first, a)
        return float(first + second)

    def score(self, text: str | None) -> float:
        gap = STEEPNESS * (self.distance(windows(text)) - self.model.cut)
        return 1 / (1 + math.exp(-max(-50.0, min(50.0, gap))))


def _dictionary(size: int, samples: list[bytes], telling: list[bytes]) -> bytes:
    """A trained dictionary (none where there are too few samples to train on) and the telling pieces, best last."""
    try:
        trained = zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        trained = b""
    return trained + b"".join(telling)[-size:]


def fit(sample: list[tuple[int, frozenset[str]]]) -> Model | None:
    """Dictionaries and cut from (toxic, distinct windows) of labelled texts; None where no piece tells the classes apart.

    Copies count once. A piece marks toxic texts when at least 2 % of them, and three, hold it, and that is far more than expected.
    """
    sample = sorted(set(sample), key=lambda row: (row[0], sorted(row[1])[:8], len(row[1])))
    held: tuple[Counter, Counter] = (Counter(), Counter())
    sizes = [sum(row[0] == y for row in sample) for y in (0, 1)]
    for y, found in sample:
        pieces: set[str] = set()
        for word in found:
            pieces |= _pieces(word)
        held[y].update(pieces)
    if not all(sizes):
        return None
    excess = {}
    for piece, count in held[1].items():
        expected = sizes[1] * (held[0][piece] + 0.5) / (sizes[0] + 0.5)
        if count >= max(3, 0.02 * sizes[1]) and count > 4 * expected and (count - expected) / math.sqrt(expected + 1) >= 2.0:
            excess[piece] = (count - expected) / math.sqrt(expected + 1)
    if not excess:
        return None
    marks = sorted(excess, key=lambda p: (excess[p], p))
    common = sorted(held[0], key=lambda p: (held[0][p], p))
    shuffle = np.random.default_rng(11).permutation
    toxic = [e for p in marks for e in [p.encode()] * min(held[1][p], 30)]
    ordinary = [e for p in common if len(p) >= 4 for e in [p.encode()] * min(held[0][p], 20)]
    ordinary = [ordinary[i] for i in shuffle(len(ordinary))[:400_000]]
    model = Model(
        _dictionary(TOXIC_BYTES, [toxic[i] for i in shuffle(len(toxic))], [p.encode() for p in marks]),
        _dictionary(ORDINARY_BYTES, ordinary, [p.encode() for p in common[-8000:]]), 0.0)
    ordinary_words = Counter(w for y, found in sample if not y for w in found)
    for _ in range(MINING_ROUNDS):  # ordinary windows that look toxic join the ordinary dictionary
        scorer = Scorer(model)
        hard = sorted((n * scorer.advantage(w), w) for w, n in ordinary_words.items() if scorer.advantage(w) >= HARD)
        model = Model(model.toxic, model.ordinary + "".join(" " + w for _, w in hard).encode()[-MINED_BYTES:], 0.0)
    scorer = Scorer(model)
    distances = [(scorer.distance(set(found)), y) for y, found in sample]
    values = sorted({d for d, _ in distances})
    cuts = [values[0] - 1.0, *[(a + b) / 2 for a, b in zip(values, values[1:], strict=False)], values[-1] + 1.0]
    wrong = [sum((d >= cut) != bool(y) if y else CLEAN_WEIGHT * (d >= cut) for d, y in distances) for cut in cuts]
    best = [cut for cut, n in zip(cuts, wrong, strict=True) if n == min(wrong)]
    return Model(model.toxic, model.ordinary, best[len(best) // 2])


def training_rows(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(toxic, words) of at most ``sample`` labelled rows of each class, those with the smallest hash of the id.

    Rows with crc32(id) mod 5 = 0 are held out.
    """
    known = labels.select(F.col("doc_id").alias("_id"), F.col("toxic").cast("int").alias("toxic")).filter(
        F.col("toxic").isin(0, 1) & F.col("_id").isNotNull() & (F.crc32(F.col("_id").cast("string").cast("binary")) % 5 != 0))
    chosen = None
    for y in (0, 1):
        part = known.filter(F.col("toxic") == y).orderBy(F.xxhash64("_id"), "_id").limit(sample)
        chosen = part if chosen is None else chosen.unionByName(part)
    schema = "toxic int, words array<string>"

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [sorted(windows(t)) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(words, pa.list_(pa.string()))], names=["toxic", "words"])

    # at most 2 * sample ids
    return docs.select(F.col("doc_id").alias("_id"), "text").join(F.broadcast(chosen), "_id").select("toxic", "text").mapInArrow(split, schema)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model | None:
    rows, texts = training_rows(docs, labels, sample).collect(), []  # at most 2 * sample rows
    while rows:  # words of different texts share their strings
        row = rows.pop()
        texts.append((row["toxic"], frozenset(map(sys.intern, row["words"]))))
    return fit(texts)


_SCORERS: dict[Model, Scorer] = {}


def _scorer(model: Model) -> Scorer:
    """One scorer per worker and model, so windows are remembered across the batches of a task."""
    if model not in _SCORERS:
        _SCORERS.clear()
        _SCORERS[model] = Scorer(model)
    return _SCORERS[model]


def _forget() -> None:
    """Empties the table of windows at the end of a task: a worker that goes on to other stages keeps none of it."""
    for scorer in _SCORERS.values():
        scorer.known.clear()


def _scores(model: Model | None, texts: pa.Array) -> list[float]:
    if model is None:
        return [0.0] * len(texts)
    scorer = _scorer(model)
    return [scorer.score(t.as_py()) for t in texts]


def score(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score and predicted, one row per input row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(_scores(model, batch.column("text")), pa.float64())], names=["doc_id", "score"])
        _forget()

    kind = docs.select(F.col(id_col)).schema[0].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, score double").select(
        "doc_id", (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that are not predicted toxic."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([s < 0.5 for s in _scores(model, batch.column(batch.schema.names.index(text_col)))], pa.bool_()))
        _forget()

    return docs.mapInArrow(run, docs.schema)


@query("op10_toxicity")
def op10_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder)
    return score(docs, train(docs, spark.read.parquet(f"{folder.rstrip('/')}/labels.parquet")))
