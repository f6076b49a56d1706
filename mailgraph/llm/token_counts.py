"""Token counts by trie-shared dynamic programming.

A pre-token is a word with the blank before it, as UTF-8. Its tokens are the segmentation into vocabulary pieces with the best unigram score; pieces
come from a public byte vocabulary, and a piece of rank r scores ``-log(r + 2)`` (a Zipf law over the ranks). Every byte is a piece, so a
segmentation always exists; of equal scores the one with fewer tokens counts.

The distinct pre-tokens of a part of a batch form a trie, walked depth first (that is, in sorted order). The forward score at a node depends only
on the path to it, so it is computed once for all pre-tokens that share the prefix; a node where a pre-token ends gives its count, which every
occurrence then takes. Nothing is shuffled; memory is one path and the part's distinct words.

Null and empty texts have no words and no tokens. Repeated rows get equal results; empty tables give empty results. Other columns are never looked at.
"""

from __future__ import annotations

import base64
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailgraph.llm import words
from mailgraph.llm.registry import documents, query

VOCABULARY = "byte_bpe_50k.tiktoken"
PART = 8 * words.CHUNK


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def scores(path: str) -> dict[bytes, float]:
    """Unigram score of each piece of a rank file."""
    with open(path, "rb") as lines:
        return {base64.b64decode(piece): -math.log(int(rank) + 2) for piece, rank in map(bytes.split, lines)}


class Counter:
    """Counts tokens of sorted distinct pre-tokens along the path of their trie."""

    def __init__(self, pieces: dict[bytes, float]):
        self.pieces = pieces
        self.lengths = sorted({len(p) for p in pieces})

    def counts(self, ordered: list[bytes]) -> list[int]:
        pieces, lengths = self.pieces, self.lengths
        score, tokens = [0.0], [0]  # at each node of the current path
        before, out = b"", []
        for word in ordered:
            shared, most = 0, min(len(before), len(word))
            while shared < most and before[shared] == word[shared]:
                shared += 1
            del score[shared + 1:], tokens[shared + 1:]
            for end in range(shared + 1, len(word) + 1):
                best, fewest = -math.inf, 0
                for length in lengths:
                    if length > end:
                        break
                    own = pieces.get(word[end - length:end])
                    if own is not None:
                        total, n = score[end - length] + own, tokens[end - length] + 1
                        if total > best or total == best and n < fewest:
                            best, fewest = total, n
                score.append(best)
                tokens.append(fewest)
            out.append(tokens[len(word)])
            before = word
        return out


_COUNTERS: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    if path not in _COUNTERS:
        _COUNTERS[path] = Counter(scores(path))
    return _COUNTERS[path]


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_tokens."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(path or vocabulary_path())
        for batch in batches:
            for part in words.parts(batch, "text", PART):
                found = words.split(part.column("text"))
                _, where, back = np.unique(found.hash, return_index=True, return_inverse=True)
                raw = found.data.tobytes()
                distinct = [b" " + raw[a:b] for a, b in zip(found.start[where].tolist(), found.end[where].tolist(), strict=True)]
                order = sorted(range(len(distinct)), key=distinct.__getitem__)
                counts = np.zeros(len(distinct), dtype=np.int64)
                counts[order] = own.counts([distinct[i] for i in order])
                ends = np.concatenate([[0], np.cumsum(counts[back])]).astype(np.int64)
                first = found.first()
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(np.diff(first), pa.int64()), pa.array(np.diff(ends[first]), pa.int64())],
                    names=["doc_id", "n_words", "n_tokens"])

    kind = docs.select(F.col(id_col)).schema[0].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        run, f"doc_id {kind}, n_words long, n_tokens long")


@query("op4_token_counts")
def op4_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return count_tokens(documents(spark, folder))
