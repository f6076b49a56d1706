from collections import Counter

from pyspark.sql import functions as F

from mailgraph.llm import fill_middle, registry
from tests.llm import brute

SMALL = "/root/testdata/sf0.001"
HARD = [None, "", " ", "\n\n", "a", " a", "a ", "a\tb\x0bc\x0cd\re\n", "<P>", "x <S> y", "a<M>b", "< P > <p>", "<P <S <M", "ends <", "    é", "𝄞 𝄞 x", "\x00 \x01", "w " * 3000]


def test_rearranged_and_restored(spark, odd, none):
    rows = [*((i, t) for i in range(12) for t in HARD), (None, "no id here"), (None, "no id here")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").unionByName(odd.select("doc_id", "text"))
    rows += [(r.doc_id, r.text) for r in odd.collect()]
    made = fill_middle.rearrange(docs).withColumn("back", fill_middle.restored(F.col("output"), F.col("form"))).collect()
    got = Counter((r.doc_id, r.n, r.form, None if r.prefix is None else len(r.prefix), None if r.middle is None else len(r.middle), r.output) for r in made)
    assert got == Counter((i, *brute.middle(i, t)) for i, t in rows)
    assert Counter((r.doc_id, r.back) for r in made) == Counter((i, t or "") for i, t in rows)
    assert {r.form for r in made} == {"plain", "psm", "spm"}
    assert all(r.prefix + r.middle + r.suffix == r.back for r in made if r.form != "plain")
    assert fill_middle.rearrange(none).count() == 0
    wide = fill_middle.rearrange(odd)
    assert wide.columns == ["doc_id", "n", "form", "prefix", "middle", "suffix", "output"] and wide.count() == odd.count()


def test_rates_and_seeds(spark):
    docs = spark.range(2000).selectExpr("id AS doc_id", "'one two three four' AS text")
    assert fill_middle.rearrange(docs, rate=0).filter("form <> 'plain'").count() == 0
    assert fill_middle.rearrange(docs, rate=100, suffix_first=100).filter("form <> 'spm'").count() == 0
    half = fill_middle.rearrange(docs, seed=7).groupBy("form").count().collect()
    assert 850 < sum(r["count"] for r in half if r.form != "plain") < 1150


def test_over_the_whole_small_table(spark):
    want = Counter()
    for r in registry.documents(spark, SMALL).collect():
        n, form, prefix, middle, output = brute.middle(r.doc_id, r.text)
        want[(r.doc_id, n, form, prefix, middle, brute.sha(output), brute.sha(r.text or ""))] += 1
    assert Counter(tuple(r) for r in registry.queries()["op13_fill_middle"](spark, SMALL).collect()) == want
