"""Language-model scores: a causal self-attention model over subword ids, trained in numpy.

Texts are dealt to blocks of about ``BLOCK_BYTES`` by a hash of the id. Word counts: each block gives its distinct words with their training counts, cut
by hash into buckets; a bucket adds up its words over all blocks and answers every block with the totals, in the block's order. So each
distinct word of a block crosses the network once each way, however often it occurs, and no vocabulary is ever gathered or broadcast.

Texts are encoded once, in the pass that counts their words; training and scoring read the stored ids.

The model: every subword (public vocabulary) and the end are predicted from the embeddings of the ids before them in a window of ``PLACES``, in two softmax steps:
the id's class (word ends apart from other pieces; cut by training counts so that both steps stay short), then the id among the class's members. Every block
trains on its texts from common weights; weights are averaged over blocks, each row by how often the blocks met it, ``TRAINING_ROUNDS`` times, and each training
text falls into exactly one of the rounds. A text is scored in overlapping windows that score each id once. A word's probability is that of its first id, times a
mixture for the rest: the word's share by training counts among the words that begin so, and, with the weight that Witten and Bell give to
unseen words (distinct over distinct and all), the product of the following ids' probabilities. What crosses the network grows with the input; the driver gets
counts and weights, at most a few rows per vocabulary id.

Null texts are empty: one end token. Held-out texts (crc32 of the id mod 7 = 2) are never learned from; a null id counts as an empty one. Rows that repeat
an id are scored and learned from separately. Without training texts N and V are 0 and the model is the untrained one. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailgraph.llm import attention, packing, words
from mailgraph.llm.registry import documents, query
from mailgraph.plans import lineage

BLOCK_BYTES = 8 << 20
#: blocks whose words one bucket adds up, about
BLOCKS_A_BUCKET = 8
VOCABULARY = 49_408
END = packing.END
#: training texts are dealt to so many rounds by hash of the id
TRAINING_ROUNDS = 2
#: windows scored at a time
CHUNK = 256


def blocks(docs: DataFrame, id_col: str, text_col: str, count: int) -> DataFrame:
    """(block, doc_id, text, train)."""
    key = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    return docs.select(
        F.pmod(F.xxhash64(key), F.lit(count)).cast("int").alias("block"), F.col(id_col).alias("doc_id"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), (F.crc32(key.cast("binary")) % 7 != 2).alias("train"))


def _slices(table: pa.Table) -> list[pa.RecordBatch]:
    return [part for batch in table.to_batches() for part in words.parts(batch, "text")]


@dataclass
class Part:
    """One slice of a block: its words, lower-cased, and what np.unique gives for their hashes."""
    batch: pa.RecordBatch
    found: words.Words
    unique: tuple[np.ndarray, np.ndarray, np.ndarray]


def _parts(table: pa.Table) -> list[Part]:
    out = []
    for batch in _slices(table):
        found = words.split(batch.column("text"), lower=True)
        out.append(Part(batch, found, np.unique(found.hash, return_index=True, return_inverse=True)))
    return out


def _distinct(parts: list[Part]) -> np.ndarray:
    """Sorted hashes of the block's distinct words."""
    return np.unique(np.concatenate([p.unique[0] for p in parts])) if parts else np.zeros(0, np.uint64)


def _buckets(hashes: np.ndarray, count: int) -> np.ndarray:
    """The bucket of each word: a slice of the hash range, so sorted words stay in bucket order."""
    return ((hashes >> np.uint64(32)) * np.uint64(count) >> np.uint64(32)).astype(np.int64)


COUNTED = "block int, bucket int, hashes binary, counts binary, ids array<int>, id_counts array<long>, first_counts array<long>, texts long"
#: the texts of a block: id and round (below 0: held out) of each, its number of words; the place of each word in the block's hashes; how many ids the words of
#: these hashes have, and which
ENCODED = "doc_id array<{kind}>, turn binary, n_words binary, word binary, sizes binary, ids_of binary"


def _packed(values: list[np.ndarray], kind: type) -> bytes:
    return pa.compress(np.concatenate([np.zeros(0, kind), *values]).astype(kind).tobytes(), codec="zstd", asbytes=True)


def _unpacked(data: bytes, kind: type, n: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(data, decompressed_size=n * np.dtype(kind).itemsize, codec="zstd", asbytes=True), dtype=kind)


def count_words(texts: DataFrame, buckets: int, rounds: int = TRAINING_ROUNDS) -> DataFrame:
    """Per block and bucket the distinct words with training counts; per block one more row with the counts of
    subwords, of words by first subword, the number of training texts, and the encoded texts."""
    kind = texts.schema["doc_id"].dataType.simpleString()
    turn = F.pmod(F.xxhash64(F.lit("train"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(rounds)).cast("int")

    def run(table: pa.Table) -> pa.Table:
        block = table.column("block")[0].as_py()
        parts = _parts(table)
        hashes = _distinct(parts)
        edges = np.searchsorted(_buckets(hashes, buckets), np.arange(buckets + 1))
        counts = np.zeros(len(hashes), dtype=np.int64)
        coder = packing.encoder(packing.vocabulary_path())
        subwords, firsts = np.zeros(VOCABULARY), np.zeros(VOCABULARY)
        learned = 0
        n_words, word = [], []
        sizes, spelled = np.zeros(len(hashes), np.int64), []
        for part in parts:
            distinct, where, back = part.unique
            train = np.array(part.batch.column("train"), dtype=bool)
            learned += int(train.sum())
            own = np.bincount(back, weights=train[part.found.doc], minlength=len(distinct))
            at = np.searchsorted(hashes, distinct)
            counts[at] += own.astype(np.int64)
            ids, lengths = coder.spell(part.found, distinct, where)
            begins = np.cumsum(lengths) - lengths
            some = lengths > 0
            new = (sizes[at] == 0) & some
            sizes[at[new]] = lengths[new]
            spelled.append((at[new], packing.gather(ids, begins[new], lengths[new])[0]))
            subwords += np.bincount(ids, weights=np.repeat(own, lengths), minlength=VOCABULARY)
            firsts += np.bincount(ids[begins[some]], weights=own[some], minlength=VOCABULARY)
            n_words.append(np.diff(part.found.first()))
            word.append(at[back].astype(np.int32))
        subwords, firsts = subwords.astype(np.int64), firsts.astype(np.int64)
        for counts_of in (subwords, firsts):
            counts_of[END] += learned
        used = np.flatnonzero(subwords)
        ids_of, first = np.zeros(int(sizes.sum()), np.uint16), np.cumsum(sizes) - sizes
        for at, ids in spelled:
            own = sizes[at]
            ids_of[np.repeat(first[at] - np.cumsum(own) + own, own) + np.arange(len(ids))] = ids
        spans = [(p, a, b) for p, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)) if b > a]
        none = [None] * len(spans)
        turns = np.where(np.array(table.column("train"), dtype=bool), np.array(table.column("turn"), dtype=np.int8), np.int8(-1))
        doc_id = table.column("doc_id").combine_chunks()
        return pa.table({
            "block": pa.array([block] * (len(spans) + 1), pa.int32()), "bucket": pa.array([p for p, _, _ in spans] + [-1], pa.int32()),
            "hashes": pa.array([hashes[a:b].tobytes() for _, a, b in spans] + [None], pa.binary()),
            "counts": pa.array([_packed([counts[a:b]], np.int64) for _, a, b in spans] + [None], pa.binary()),
            "ids": pa.array([*none, used.astype(np.int32)], pa.list_(pa.int32())), "id_counts": pa.array([*none, subwords[used]], pa.list_(pa.int64())),
            "first_counts": pa.array([*none, firsts[used]], pa.list_(pa.int64())),
            "texts": pa.array([*none, learned], pa.int64()),
            "doc_id": pa.ListArray.from_arrays(pa.array([0] * (len(spans) + 1) + [len(doc_id)], pa.int32()), doc_id),
            **{name: pa.array([*none, _packed(values, of)], pa.binary()) for name, values, of in (
                ("turn", [turns], np.int8), ("n_words", n_words, np.int32), ("word", word, np.int32))},
            "sizes": pa.array([*none, len(hashes).to_bytes(8, "little") + _packed([sizes], np.int32)], pa.binary()), "ids_of": pa.array([*none, _packed([ids_of], np.uint16)], pa.binary())})

    return texts.withColumn("turn", turn).groupBy("block").applyInArrow(run, f"{COUNTED}, {ENCODED.format(kind=kind)}")


@dataclass
class Encoded:
    """The texts of a block as one stream of ids, the end id before and after each: where each text begins, its number of ids after the first, its round and its
    number of words; each word's place in the block's hashes, number of ids and where they begin."""
    stream: np.ndarray
    starts: np.ndarray
    lengths: np.ndarray
    turn: np.ndarray
    n_words: np.ndarray
    word: np.ndarray
    pieces: np.ndarray
    place: np.ndarray

    @classmethod
    def read(cls, batch: pa.RecordBatch | pa.Table, row: int) -> Encoded:
        stored = lambda name: batch.column(name)[row].as_py()
        texts = len(batch.column("doc_id")[row])
        turn, n_words = _unpacked(stored("turn"), np.int8, texts), _unpacked(stored("n_words"), np.int32, texts)
        word, sizes = _unpacked(stored("word"), np.int32, int(n_words.sum())), stored("sizes")
        sizes = _unpacked(sizes[8:], np.int32, int.from_bytes(sizes[:8], "little"))
        ids_of = _unpacked(stored("ids_of"), np.uint16, int(sizes.sum()))
        pieces = sizes[word].astype(np.int64)
        encoded, _ = packing.gather(ids_of, (np.cumsum(sizes, dtype=np.int64) - sizes)[word], pieces)
        doc = np.repeat(np.arange(texts), n_words)
        lengths = np.bincount(doc, weights=pieces, minlength=texts).astype(np.int64)
        starts = np.cumsum(lengths + 1) - lengths - 1
        stream = np.full(len(encoded) + texts + 1, END, dtype=np.uint16)
        inside = np.ones(len(stream), dtype=bool)
        inside[[0, *(starts + lengths + 1)]] = False
        stream[inside] = encoded
        return cls(stream, starts, lengths + 1, turn, n_words, word, pieces, np.cumsum(pieces) - pieces + doc + 1)


def add_up(counted: DataFrame) -> DataFrame:
    """(bucket, block, totals, n, distinct, tokens): for each block the training totals of its ``n`` words of the bucket; distinct and tokens once per bucket."""
    def run(table: pa.Table) -> pa.Table:
        hashes = [np.frombuffer(h, dtype=np.uint64) for h in table.column("hashes").to_pylist()]
        counts = [_unpacked(c, np.int64, len(h)) for c, h in zip(table.column("counts").to_pylist(), hashes, strict=True)]
        every, back = np.unique(np.concatenate(hashes), return_inverse=True)
        totals = np.bincount(back, weights=np.concatenate(counts), minlength=len(every)).astype(np.int64)
        edges = np.cumsum([0, *[len(h) for h in hashes]])
        first = [0] * (table.num_rows - 1)
        return pa.table({
            "bucket": table.column("bucket"), "block": table.column("block"),
            "totals": pa.array([_packed([totals[back[a:b]]], np.int64) for a, b in zip(edges[:-1], edges[1:], strict=True)], pa.binary()),
            "n": pa.array(np.diff(edges), pa.int64()),
            "distinct": pa.array([int((totals > 0).sum()), *first], pa.int64()), "tokens": pa.array([int(totals.sum()), *first], pa.int64())})

    return counted.filter("bucket >= 0").groupBy("bucket").applyInArrow(run, "bucket int, block int, totals binary, n long, distinct long, tokens long")


class Classes:
    """Classes of subword ids: share of the training tokens of each, its members with their shares in it, and each id's share of the words' first subwords.

    Ids are ordered by count inside their kind (word end or not) and cut where equal parts of the sum of the counts' roots end, which keeps the mean size of a
    token's class small; ids never seen in training are the last class of their kind.
    """

    def __init__(self, counts: np.ndarray, firsts: np.ndarray, ends: np.ndarray):
        half = attention.COARSE // 2
        of = np.zeros(VOCABULARY, np.int64)
        for kind in (0, 1):
            own = np.flatnonzero((ends == kind) & (counts > 0))
            own = own[np.argsort(-counts[own], kind="stable")]
            root = np.sqrt(counts[own])
            of[ends == kind] = kind * half + half - 1
            of[own] = kind * half + np.minimum(((np.cumsum(root) - root) * (half - 1) / max(root.sum(), 1)).astype(np.int64), half - 2)
        order = np.lexsort((-counts, of))
        row = np.empty(VOCABULARY, np.int64)
        row[order] = np.arange(VOCABULARY)
        sizes = np.bincount(of, minlength=attention.COARSE)
        mass = np.bincount(of, weights=counts + 0.5, minlength=attention.COARSE)
        self.members = attention.Members(of, row, np.concatenate([[0], np.cumsum(sizes)]), np.log((counts[order] + 0.5) / mass[of[order]]).astype(np.float32))
        totals = np.where(sizes > 0, np.bincount(of, weights=counts, minlength=attention.COARSE) + 1.0, 1e-6)
        self.shares = totals / totals.sum()
        self.first = (firsts + 1.0) / (firsts + 1.0).sum()


def _word_ends() -> np.ndarray:
    from tokenizers import Tokenizer
    ends = np.zeros(VOCABULARY, np.int64)
    for piece, i in Tokenizer.from_file(packing.vocabulary_path()).get_vocab(with_added_tokens=True).items():
        ends[i] = piece.endswith("</w>")
    return ends


def _places(starts: np.ndarray, lengths: np.ndarray, text: np.ndarray, first: np.ndarray, context: np.ndarray, last: int) -> tuple[np.ndarray, np.ndarray]:
    """(places of the windows' inputs in the stream, which of them are scored here)."""
    place = np.arange(attention.PLACES)
    inside = (place >= context[:, None]) & (first[:, None] + place < lengths[text][:, None])
    return np.minimum((starts[text] + first)[:, None] + place, last - 1), inside


#: a piece of the weights that is averaged as a whole: where it begins in the packed weights, how often it was met, what training added to it
LEARNED = "at long, n double, " + ", ".join(f"w{i} float" for i in range(attention.WIDTH + 1))
_INNER = attention.SIZE - int(np.prod(attention.SHAPES["inner"]))
_SMALL = int(np.prod(attention.SHAPES["embed"]))


def _learned(block: Encoded, turn: int, classes: Classes, weights: np.ndarray) -> pa.RecordBatch | None:
    """What a block's training texts of one round add to the weights: rows of the ids met, rows of the members of their classes, and all other weights."""
    own = np.flatnonzero(block.turn == turn)
    if not len(own):
        return None
    members, width = classes.members, attention.WIDTH
    lengths, starts = block.lengths[own], block.starts[own]
    at, inside = _places(starts, lengths, *attention.windows(lengths), len(block.stream) - 1)
    inputs, targets = block.stream[at], block.stream[at + 1]
    met = np.bincount(inputs.ravel(), minlength=VOCABULARY)
    used = np.flatnonzero(met)
    number = np.zeros(VOCABULARY, np.uint16)
    number[used] = np.arange(len(used))
    begin = attention.unpack(weights)
    begin["embed"] = begin["embed"][used]
    trained = attention.train(begin, members, number[inputs], targets, inside)
    gain = {name: trained[name] - begin[name] for name in trained}
    hit = np.bincount(members.of[targets[inside]], minlength=attention.COARSE)
    rows = np.flatnonzero(np.repeat(hit, np.diff(members.first)))
    small = np.concatenate([gain[name].ravel() for name in attention.SHAPES if name not in ("embed", "inner")]).reshape(-1, width)
    padded = lambda m: np.concatenate([m, np.zeros((len(m), 1), np.float32)], axis=1)
    values = np.concatenate([padded(gain["embed"]), padded(small), gain["inner"][rows]])
    where = np.concatenate([used * width, _SMALL + np.arange(len(small)) * width, _INNER + rows * (width + 1)])
    n = np.concatenate([met[used], np.full(len(small), hit.sum()), np.repeat(hit, np.diff(members.first))[rows]]).astype(np.float64)
    return pa.RecordBatch.from_arrays([pa.array(where, pa.int64()), pa.array(n), *[pa.array(np.ascontiguousarray(v), pa.float32()) for v in values.T]],
                                      names=["at", "n", *[f"w{i}" for i in range(width + 1)]])


def _trainer(classes: Classes, weights: np.ndarray, turn: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packing.forget_words()
        for batch in batches:
            for row in range(batch.num_rows):
                found = _learned(Encoded.read(batch, row), turn, classes, weights)
                if found is not None:
                    yield found

    return run


def fit(texts: DataFrame, classes: Classes, rounds: int = TRAINING_ROUNDS, counted: DataFrame | None = None) -> np.ndarray:
    """Weights: every block trains on its texts, what the blocks add is averaged; each round takes another part of the texts, together all.

    ``counted`` is what ``count_words`` gives for the texts, if known.
    """
    counted = count_words(texts, 1, rounds) if counted is None else counted
    weights = attention.pack(attention.start(classes.shares))
    stored = counted.filter("bucket < 0").select("doc_id", "turn", "n_words", "word", "sizes", "ids_of")
    columns = [f"w{i}" for i in range(attention.WIDTH + 1)]
    for turn in range(rounds):
        learned = stored.mapInArrow(_trainer(classes, weights, turn), LEARNED)
        total = learned.groupBy("at").agg(*[(F.sum(F.col(c) * F.col("n")) / F.sum("n")).alias(c) for c in columns]).toArrow()  # a few rows per vocabulary id
        at = np.asarray(total.column("at"), dtype=np.int64)
        for i, name in enumerate(columns):
            own = at >= _INNER if i == attention.WIDTH else slice(None)
            weights[at[own] + i] += np.asarray(total.column(name), dtype=np.float32)[own]
    return weights


def _ids_scores(block: Encoded, scorer: attention.Scorer) -> np.ndarray:
    """Natural logarithm of the probability of each id of the stream (0 for the first, which nothing predicts)."""
    out = np.zeros(len(block.stream))
    text, first, context = attention.windows(block.lengths)
    for low in range(0, len(text), CHUNK):
        at, inside = _places(block.starts, block.lengths, text[low:low + CHUNK], first[low:low + CHUNK], context[low:low + CHUNK], len(block.stream) - 1)
        out[at[inside] + 1] = scorer.ids_log_probability(block.stream[at], block.stream[at + 1], inside)
    return out


def _word_scores(block: Encoded, ids: np.ndarray, unigram: np.ndarray, end: float, classes: Classes, unseen: float) -> np.ndarray:
    """Natural logarithm of each text's probability; ``unigram`` has each word's, ``end`` is the end's, ``unseen`` the weight of spelling a word."""
    with np.errstate(divide="ignore"):
        counted, spelled = np.log(1 - unseen), np.log(unseen)
    texts = len(block.lengths)
    share = np.log(classes.first)
    total = np.concatenate([[0.0], np.cumsum(ids)])
    some = block.pieces > 0
    place = block.place[some]
    rest = total[place + block.pieces[some]] - total[place + 1]
    each = unigram.copy()  # a word that the vocabulary drops has no ids
    each[some] = ids[place] + np.logaddexp(counted + np.minimum(unigram[some] - share[block.stream[place]], 0), spelled + rest)
    last = ids[block.starts + block.lengths] + np.logaddexp(counted + min(end - share[END], 0), spelled)
    return np.bincount(np.repeat(np.arange(texts), block.n_words), weights=each, minlength=texts) + last


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score (log10 probabilities)."""
    size = docs.agg(F.sum(F.octet_length(F.col(text_col).cast("string")))).first()[0] or 0
    count = max(1, -(-size // BLOCK_BYTES))
    buckets = max(1, -(-count // BLOCKS_A_BUCKET))
    texts = blocks(docs, id_col, text_col, count)
    counted = lineage.cut(count_words(texts, buckets))
    totals = lineage.cut(add_up(counted.select("block", "bucket", "hashes", "counts")))
    seen = totals.agg(F.sum("distinct"), F.sum("tokens")).first()
    learned = counted.agg(F.sum("texts")).first()[0] or 0
    distinct, tokens = (seen[0] or 0) + (learned > 0), (seen[1] or 0) + learned
    subwords, firsts = np.zeros(VOCABULARY), np.zeros(VOCABULARY)
    each = counted.filter("bucket < 0").select(F.explode(F.arrays_zip("ids", "id_counts", "first_counts")).alias("x"))
    for row in each.groupBy("x.ids").agg(F.sum("x.id_counts").alias("n"), F.sum("x.first_counts").alias("f")).collect():
        subwords[row["ids"]], firsts[row["ids"]] = row["n"], row["f"]  # at most one row per vocabulary id
    classes = Classes(subwords, firsts, _word_ends())
    weights = fit(texts, classes, counted=counted)
    kind = docs.select(F.col(id_col)).schema[0].dataType.simpleString()

    def run(own: pa.Table, answers: pa.Table) -> pa.Table:
        order = np.argsort(np.array(answers.column("bucket"), dtype=np.int64)) if answers.num_rows else []
        totals, n = answers.column("totals").to_pylist(), answers.column("n").to_pylist()
        got = np.concatenate([_unpacked(totals[i], np.int64, n[i]) for i in order]) if len(order) else np.zeros(0, np.int64)
        block = Encoded.read(own, 0)
        texts, unit = len(block.lengths), np.log(float(tokens + distinct + 1))
        doc = np.repeat(np.arange(texts), block.n_words)
        c = got[block.word]
        unigram, end = np.log(c + 1.0) - unit, np.log(learned + 1.0) - unit
        ids = _ids_scores(block, attention.Scorer(attention.unpack(weights), classes.members))
        model = _word_scores(block, ids, unigram, end, classes, distinct / max(tokens + distinct, 1) if tokens else 1.0)
        doc_id = own.column("doc_id").combine_chunks().flatten()
        return pa.table({
            "doc_id": doc_id, "train": pa.array(block.turn >= 0), "n_tokens": pa.array(block.n_words + 1, pa.int64()),
            "n_known": pa.array(np.bincount(doc, weights=c > 0, minlength=texts).astype(np.int64) + (learned > 0), pa.int64()),
            "base_score": pa.array((np.bincount(doc, weights=unigram, minlength=texts) + end) / np.log(10.0)), "score": pa.array(model / np.log(10.0))})

    stored = counted.filter("bucket < 0").select("block", "doc_id", "turn", "n_words", "word", "sizes", "ids_of")
    scored = stored.groupBy("block").cogroup(totals.select(F.col("block").alias("_block"), "bucket", "totals", "n").groupBy("_block")).applyInArrow(
        run, f"doc_id {kind}, train boolean, n_tokens long, n_known long, base_score double, score double")
    return scored.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score")


@query("op9_lm_scores")
def op9_lm_scores(spark: SparkSession, folder: str) -> DataFrame:
    return score(documents(spark, folder))
