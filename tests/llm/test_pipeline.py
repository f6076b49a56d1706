from collections import Counter

import corpus_pipeline
from mailgraph.llm import mixing, toxicity
from tests.llm import brute

SMALL = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = corpus_pipeline.documents(spark, SMALL)
    columns, state = docs.columns, docs
    for name, stage in corpus_pipeline.STAGES:
        before = [(r.doc_id, r.text) for r in state.collect()]
        after = stage(spark, state, SMALL).cache()
        rows = after.collect()
        if name != "packing":
            assert after.columns == columns
        if name == "toxicity":
            model = toxicity.train(state, spark.read.parquet(f"{SMALL}/labels.parquet"))
            bad = {r.doc_id for r in toxicity.score(state, model).filter("predicted = 1").collect()}
            assert {r.doc_id for r in rows} == {i for i, _ in before} - bad
        elif name == "exact dedup":
            best = {}
            for i, t in before:
                best[t] = max(i, best.get(t, i))
            assert {r.doc_id for r in rows} == set(best.values()) and len(rows) == len(best)
        elif name == "near dedup":
            want = brute.near_components(before, 5)
            assert {r.doc_id for r in rows} == {i for i, (_, _, kept) in want.items() if kept}
        elif name == "mixing":
            times = {r.doc_id: r.epochs for r in mixing.mix(state).collect()}
            assert Counter(r.doc_id for r in rows) == Counter({i: n for i, n in times.items() if n})
        else:
            assert Counter(r.doc_id for r in rows if r.start == 0) == Counter(i for i, _ in before)
        state = after


def test_run_gives_every_row(spark):
    got = corpus_pipeline.run(spark, SMALL)
    assert got.count() > 0 and {"doc_id", "sequence_id"} <= set(got.columns)
