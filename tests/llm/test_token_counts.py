import math
import random

from mailgraph.llm import registry, token_counts
from tests.llm import brute

SMALL = "/root/testdata/sf0.001"


def plain(word: bytes, pieces: dict[bytes, float]) -> int:
    best = [(0.0, 0)]
    for end in range(1, len(word) + 1):
        best.append(max((best[start][0] + pieces[word[start:end]], best[start][1] - 1) for start in range(end) if word[start:end] in pieces))
    return -best[-1][1]


def test_shared_prefixes_change_no_count():
    pieces = token_counts.scores(token_counts.vocabulary_path())
    rng = random.Random(8)
    some = sorted({bytes(rng.choice(b"abe \xc3\xa9") for _ in range(rng.randrange(1, 12))) for _ in range(400)} | {b" the", b" then", b" thenx"})
    assert token_counts.Counter(pieces).counts(some) == [plain(w, pieces) for w in some]
    assert math.isclose(pieces[b"!"], -math.log(2))


def test_token_counts(spark, odd, none):
    pieces = token_counts.scores(token_counts.vocabulary_path())
    known: dict[str, int] = {}

    def tokens(text):
        total = 0
        for w in brute.words(text):
            if w not in known:
                known[w] = plain(b" " + w.encode(), pieces)
            total += known[w]
        return len(brute.words(text)), total

    docs = {r.doc_id: r.text for r in registry.documents(spark, SMALL).collect()}
    for r in registry.queries()["op4_token_counts"](spark, SMALL).collect():
        assert (r.n_words, r.n_tokens) == tokens(docs[r.doc_id])
    got = sorted((r.n_words, r.n_tokens) for r in token_counts.count_tokens(odd).collect())
    assert got == sorted(tokens(r.text) for r in odd.collect()) and token_counts.count_tokens(none).count() == 0
