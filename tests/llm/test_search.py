import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from mailgraph.llm import ranked_search, registry
from tests.llm import brute

SMALL = "/root/testdata/sf0.001"
ITEMS = "item_id string, text string, score long, rank int"


def found(frame):
    return sorted((tuple(r) for r in frame.collect()), key=str)


@pytest.fixture(scope="module")
def items(spark, odd):
    texts = {r.doc_id: r.text for r in odd.collect()}
    rows = [("a", "one two WORDS é"), ("a", "same p1"), (None, texts[6]), ("none", None), ("empty", " .,"), ("long", texts[5]), ("b", "x line one changed " + texts[8]), ("no", "zzzz")]
    return spark.createDataFrame([(i, t, 7, 7) for i, t in rows], ITEMS)


def test_search_equals_scoring_everything(spark, odd, items):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    want = brute.ranked(rows, [(r.item_id, r.text) for r in items.collect()])
    assert {i for i, *_ in want} == {"a", None, "long", "b"}
    assert found(ranked_search.search(odd, items)) == sorted(want, key=str)


def test_search_in_slices_and_with_string_ids(spark, odd, items, monkeypatch):
    monkeypatch.setattr(ranked_search, "SLICE_BYTES", 60_000)
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    want = brute.ranked(rows, [(r.item_id, r.text) for r in items.collect()], k=3)
    assert found(ranked_search.search(odd, items, k=3)) == sorted(want, key=str)
    named = odd.selectExpr("concat('n', lpad(cast(doc_id AS string), 3, '0')) AS doc_id", "text")
    named = ranked_search.search(named, items, k=3)
    assert dict(named.dtypes)["doc_id"] == "string"
    assert found(named) == sorted(((i, r, d if d is None else f"n{d:03}", s) for i, r, d, s in want), key=str)


def test_search_takes_empty_tables(spark, none, odd, items):
    assert ranked_search.search(none, items).count() == 0
    assert ranked_search.search(odd, items.limit(0)).count() == 0
    assert ranked_search.search(odd, items.limit(0)).columns == ["item_id", "rank", "doc_id", "score"]


def test_search_over_the_whole_small_tables(spark):
    rows = [(r.doc_id, r.text) for r in registry.documents(spark, SMALL).collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    assert found(registry.queries()["op11_ranked_search"](spark, SMALL)) == sorted(brute.ranked(rows, items), key=str)


def test_copies_tie_by_id(spark):
    docs = spark.range(5000).selectExpr("4999 - id AS doc_id", "CASE WHEN id % 3 = 0 THEN 'hot words here' ELSE concat('w', id, ' hot words there') END AS text").repartition(7)
    items = spark.createDataFrame([(1, "here hot")], "item_id long, text string")
    assert [r.doc_id for r in ranked_search.search(docs, items).orderBy("rank").collect()] == [1 + 3 * j for j in range(10)]


def test_skipping_loses_nothing():
    """Random indexes: what ``best`` returns holds the true best documents, and it looks at fewer than all of them."""
    rng = random.Random(4)
    skipped = 0
    for _ in range(60):
        rows = [" ".join(f"t{int(rng.paretovariate(0.7)) % 50}" for _ in range(rng.randrange(40))) for _ in range(300)]
        hashes = np.unique(ranked_search.terms(pa.array([f"t{j}" for j in range(50)])).hash)
        batch = pa.RecordBatch.from_pydict({"text": pa.array(rows)})
        weights = np.array([rng.randrange(3000) for _ in hashes], dtype=np.int64)
        index = ranked_search.Index.of(batch, hashes, weights, 300, 6000)
        own = np.array(sorted(rng.sample(range(50), 12)))
        whole = np.zeros(300, np.int64)
        for term in own:
            docs, values = index.list_of(term)
            whole[docs] += values
        docs, scores = ranked_search.best(index, own, 10, 1)
        assert (whole[docs] == scores).all()
        assert Counter(sorted(scores.tolist())[-10:]) == Counter(sorted(whole[whole > 0].tolist())[-10:])
        skipped += (whole > 0).sum() - len(docs)
    assert skipped > 0
