import random

from pyspark.sql import functions as F

from mailgraph.llm import decontamination, registry
from tests.llm import brute

SMALL = "/root/testdata/sf0.001"
ITEMS = "item_id string, text string, _tag long, contaminated string"


def compare(docs, items, window=10, **options):
    got = sorted(((r.doc_id, r.n_words, r.n_hit, list(r["items"])) for r in decontamination.contamination(docs, items, window=window, **options).collect()), key=str)
    want = brute.leaks([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()], window)
    assert got == sorted(want, key=str)
    return {i: (hit, names) for i, _, hit, names in got}


def test_odd_rows(spark, odd, none):
    texts = {r.doc_id: r.text for r in odd.collect()}
    rows = [("passage", "Before, " + texts[6].upper() + " after"), ("short", "Two WORDS."), ("short", "one"), ("none", None), ("blank", " .,;"), (None, texts[8]), (None, texts[8]),
            ("long", texts[5][-400:]), ("é", "É ü ß"), ("é2", "ü — ß"), ("x", "x " * 10)]
    items = spark.createDataFrame([(i, t, 0, "clash") for i, t in rows], ITEMS)
    got = compare(odd, items)
    assert got[6] == (62, ["passage", "short"]) and got[4] == (2, ["short"]) and got[16] == (200, ["x"]) and got[13] == (3, ["é2"]) and got[8][0] == 120
    assert decontamination.contamination(none, items).count() == 0
    clean = decontamination.contamination(odd, items.limit(0)).collect()
    assert len(clean) == odd.count() and all(r.n_hit == 0 and r["items"] == [] for r in clean)


def test_random_texts_with_few_words(spark):
    rng = random.Random(8)
    text = lambda n: " ".join(rng.choice("abc") for _ in range(rng.randrange(n)))
    docs = spark.createDataFrame([(i % 50, text(60)) for i in range(80)], "doc_id long, text string")
    items = spark.createDataFrame([(str(i % 9), text(14)) for i in range(14)], "item_id string, text string")
    for window, shingle in ((6, 3), (5, 1), (4, 8)):
        compare(docs, items, window, shingle=shingle)


def test_item_side_in_slices(spark, odd, monkeypatch):
    monkeypatch.setattr(decontamination, "SLICE_BYTES", 700)
    texts = {r.doc_id: r.text for r in odd.collect()}
    compare(odd, spark.createDataFrame([("p", texts[6]), ("b", texts[9]), ("l", texts[5][:900])], "item_id string, text string"))


def test_one_frequent_passage(spark):
    """A passage in a third of all rows: every copy is found, and only true places are handed on."""
    passage = " ".join(f"q{i}" for i in range(14))
    docs = spark.range(6000).select("id", F.when(F.col("id") % 3 == 0, F.concat_ws(" ", F.lit("a"), F.col("id").cast("string"), F.lit(passage))).otherwise("q1 q2 q3 other").alias("t"))
    items = spark.createDataFrame([(7, passage)], "name long, body string")
    got = decontamination.contamination(docs, items, "id", "t", "name", "body")
    assert got.filter("n_hit = 14 AND doc_id % 3 = 0").count() == 2000 and got.filter("n_hit > 0").count() == 2000
    assert got.filter("doc_id = 3").first().spans == [(2 + k, 12 + k) for k in range(5)]


def test_over_the_whole_small_tables(spark):
    rows = [(r.doc_id, r.text) for r in registry.documents(spark, SMALL).collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    want = [(i, n, hit, len(names), brute.sha(",".join(names)), hit > 0) for i, n, hit, names in brute.leaks(rows, items)]
    got = registry.queries()["op12_decontamination"](spark, SMALL).collect()
    assert sorted(tuple(r) for r in got) == sorted(want) and any(r.contaminated for r in got)
