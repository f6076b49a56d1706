import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from mailgraph.llm import attention, exact_dedup, lm, mixing, near_dedup, packing, pii, quality, registry, substring_dedup, toxicity, words
from tests.llm import brute

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return registry.documents(spark, SMALL).cache()


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text for r in docs.collect()}


def named(odd):
    return [(r.doc_id, r.text) for r in odd.collect()]


def test_word_hashes_match_across_chunks_and_rows():
    column = pa.array(["a bb  ccc", None, "", "\tbb\n", "x" * 3_000_000 + " bb", "é a"])
    found = words.split(column)
    assert [found.text(i) if i != 4 else "long" for i in range(len(found.hash))] == ["a", "bb", "ccc", "bb", "long", "bb", "é", "a"]
    assert found.hash[1] == found.hash[3] == found.hash[5] and found.hash[0] == found.hash[7] != found.hash[6]
    assert found.first().tolist() == [0, 3, 3, 3, 4, 6, 8]
    assert words.split(pa.array(["AbÉ"]), lower=True).hash[0] == words.split(pa.array(["abÉ"])).hash[0]


def test_exact_dedup(spark, odd, none):
    got = exact_dedup.decisions(odd).collect()
    assert len(got) == odd.count() and exact_dedup.decisions(none).count() == 0
    groups = defaultdict(list)
    for i, t in named(odd):
        groups[brute.sha(t or "")].append(i)
    for r in got:
        own = groups[r.text_sha256]
        assert r.group_size == len(own) and r.keep_id == max((i for i in own if i is not None), default=None)
    assert Counter(r.text_sha256 for r in got if r.kept) == Counter(dict.fromkeys(groups, 1))
    kept = exact_dedup.keep_one(odd)
    assert kept.columns == odd.columns and Counter(brute.sha(r.text or "") for r in kept.collect()) == Counter(dict.fromkeys(groups, 1))


def test_exact_dedup_splits_frequent_texts(spark):
    rows = spark.range(4000).selectExpr("id AS doc_id", "CASE WHEN id % 3 = 0 THEN 'hot' WHEN id % 3 = 1 THEN concat('pair', id DIV 6) ELSE concat('one', id) END AS text")
    narrow = rows.select(F.col("doc_id").alias("_id"), F.unhex(F.sha2("text", 256)).alias("_digest"), F.monotonically_increasing_id().alias("_row")).cache()
    heavy = exact_dedup.frequent_digests(narrow, winners=16, counters=64).collect()
    assert [(h._n, h._keep._id) for h in heavy] == [(1334, 3999)]
    got = exact_dedup.decisions(rows).groupBy("text_sha256").agg(F.max("group_size").alias("n"), F.count_if("kept").alias("k"))
    assert got.filter("k <> 1").count() == 0 and got.filter("n = 1334").count() == 1


HARD = ["a@b.c_x@y.z mail", "a@b.c.d, x%y@h-i.jk", "1.2.3.4.5.6.7.8 999.1.1.1 0001.2.3.004", "4111 1111 1111 1111 and 4111-1111-1111-1112",
        "+1 (555) 123-4567 x +49.30.1234567", "1 2 3 4 5 6 7 8 9 0 1 2 3", "é 4111111111111111 ü a@b.co", "@ + . -", "a@b", "+1234", "9" * 5000, "1 " * 5000,
        "+1 2 3 4 5 6 7 8 9", "0.0.0.0a@b.c4111111111111111"]


def test_pii_equals_plain_patterns(spark, docs, texts, odd, none):
    rng = random.Random(5)
    pieces = ["a@b.c", ".", "@", " ", "-", "+", "1.2.3.4", "4111111111111111", "+1 555 123 4567", "é", "x", "7", "\n"]
    noise = ["".join(rng.choice(pieces) for _ in range(rng.randrange(30))) for _ in range(400)]
    rows = [(i, t) for i, t in enumerate([*HARD, *noise, None, "", "a@b.c " * 700])]
    found = pii.spans(spark.createDataFrame(rows, "doc_id long, text string"))
    for r in found.collect():
        base = [s for s in r.spans if s.base]
        count = Counter(s.kind for s in base)
        got = (*[count[k] for k in pii.BASE], brute.sha(",".join(f"{s.kind}:{s.start}:{s.ends}" for s in base)))
        assert got == brute.pii(rows[r.doc_id][1]), rows[r.doc_id][1]
    for r in registry.queries()["op2_pii"](spark, SMALL).collect():
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) == brute.pii(texts[r.doc_id])
    assert pii.spans(odd).count() == odd.count() and pii.spans(none).count() == 0


def test_pii_adds_confirmed_spans(spark):
    rows = [(1, "account GB82 WEST 1234 5698 7654 32 end"), (2, "account GB82 WEST 1234 5698 7654 33 end"), (3, "ssn 123-45-6789"), (4, "part 123-45-6789")]
    got = {r.doc_id: [(s.kind, s.start, s.ends) for s in r.spans] for r in pii.spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1] == [("iban", 8, 35)] and got[2] == [] and got[3] == [("ssn", 4, 15)] and got[4] == []


def test_substring_dedup(spark, odd, none, docs, texts):
    rows = [(i, t) for i, t in named(odd) if i is not None]
    want = brute.without_repeats(dict(rows).items())
    for group in (substring_dedup.GROUP, 1):  # in trees, and by prefixes as long as a window
        got = substring_dedup.remove_repeats(odd, group=group).collect()
        assert len(got) == odd.count()
        for r in got:
            if r.doc_id is None:
                assert r.n_removed == 0
            else:
                assert (r.n_words, r.n_removed, r.kept) == want[r.doc_id], r.doc_id
    assert want[7][1] == 60 and substring_dedup.remove_repeats(none).count() == 0
    whole = brute.without_repeats(texts.items())
    for r in registry.queries()["op3_substring_dedup"](spark, SMALL).collect():
        n, gone, kept = whole[r.doc_id]
        assert (r.n_words, r.n_removed, r.kept_sha256) == (n, gone, brute.sha(kept))


def test_repeats_in_generated_texts():
    rng = random.Random(11)
    alphabet = [f"w{i}" for i in range(4)]
    rows = [(i, " ".join(rng.choice(alphabet) for _ in range(rng.randrange(60)))) for i in range(40)]
    window, prefix = 12, 3
    want = brute.without_repeats(rows, window)
    found = words.split(pa.array([t for _, t in rows]))
    starts, places = substring_dedup._anchors(found, window, prefix)
    grams = words.windows(found.hash, prefix)[places].view(np.int64)
    base = found.first()[found.doc[starts]]
    passages = pa.array([found.data[found.start[s]:found.end[s + window - 1]].tobytes() for s in starts], pa.binary())
    hits = substring_dedup.repeats(grams, found.doc[starts], places - base, starts - base, starts - base, passages, window)
    gone = defaultdict(set)
    for row, start in hits:
        gone[int(found.doc[starts[row]])] |= set(range(start, start + window))
    assert {i: len(gone[i]) for i, _ in rows} == {i: want[i][1] for i, _ in rows}


def test_near_dedup(spark, odd, none, docs, texts):
    rows = [(i, t) for i, t in named(odd) if i is not None]
    want = brute.near_components(dict(rows).items())
    for r in near_dedup.components(odd.filter("doc_id IS NOT NULL")).collect():
        assert (r.n_shingles, r.component_id, r.kept) == want[r.doc_id]
    assert want[10][1] == 8 and near_dedup.components(none).count() == 0 and near_dedup.components(odd).count() == odd.count()
    whole = brute.near_components(texts.items())
    for r in registry.queries()["op5_near_dedup"](spark, SMALL).collect():
        assert (r.n_shingles, r.component_id, r.kept) == whole[r.doc_id]
    assert near_dedup.keep_first(odd).columns == odd.columns


def test_near_dedup_of_one_large_group(spark, monkeypatch):
    """A group larger than a small bucket and than a block, with members that meet no pivot: nothing is lost."""
    rng = random.Random(2)
    base = [f"b{rng.randrange(10 ** 6)}" for _ in range(150)]
    rows = []
    for i in range(120):
        own = list(base)
        for _ in range(rng.randrange(14)):
            own[rng.randrange(len(own))] = f"c{rng.randrange(10 ** 6)}"
        rows.append((i, " ".join(own)))
    monkeypatch.setattr(near_dedup, "SMALL_BUCKET", 4)
    monkeypatch.setattr(near_dedup, "BLOCK", 16)
    want = brute.near_components(rows)
    got = near_dedup.components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == want and len({v[1] for v in want.values()}) > 1


def test_near_dedup_of_repeated_ids(spark):
    base = [f"b{k}" for k in range(60)]
    other = [f"c{k}" for k in range(60)]
    near = [" ".join([*w[:59], "changed"]) for w in (base, other)]
    rows = [(5, " ".join(base)), (5, " ".join(other)), (7, near[0]), (8, near[1]), (5, "alone"), (3, None), (None, " ".join(other).upper()), (None, "no id"), (5, "alone"),
            (2, near[0])]
    want = Counter([(5, 57, 2), (5, 57, 5), (7, 57, 2), (8, 57, 5), (5, 1, 5), (5, 1, 5), (3, 0, 3), (None, 57, 5), (None, 1, None), (2, 57, 2)])
    for order in (rows, rows[::-1], rows[3:] + rows[:3]):
        docs = spark.createDataFrame([(*r, "x", 1) for r in order], "doc_id long, text string, tag string, least int").repartition(3)
        assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in near_dedup.components(docs).collect()) == want
        kept = near_dedup.keep_first(docs)
        assert kept.columns == docs.columns and Counter((r.doc_id, r.text) for r in kept.collect()) == Counter(
            [r for r in rows if r not in (rows[0], rows[2], rows[3])])


def test_odd_sketches_estimate_similarity():
    rng = np.random.default_rng(1)
    sets = []
    for share in (0.5, 0.8, 0.9, 1.0):
        both, rest = int(1000 * share), 1000 - int(1000 * share)
        common = rng.integers(0, 1 << 63, both, dtype=np.uint64)
        sets.append(np.concatenate([common, rng.integers(0, 1 << 63, rest // 2, dtype=np.uint64)]))
        sets.append(np.concatenate([common, rng.integers(0, 1 << 63, rest - rest // 2, dtype=np.uint64)]))
    begins = np.cumsum([0, *map(len, sets)])
    odd = near_dedup.sketches(near_dedup.signatures(np.concatenate(sets), begins)).view(np.uint64)
    apart = [int(np.bitwise_count(odd[i] ^ odd[i + 1]).sum()) for i in range(0, 8, 2)]
    assert apart[0] > apart[1] > apart[2] > apart[3] == 0 and apart[1] <= near_dedup.most_different_bits()


def test_mixing(spark, odd, none, docs):
    got = mixing.mix(docs).collect()
    again = {r.doc_id: r.taken for r in mixing.mix(docs.repartition(7)).collect()}
    assert {r.doc_id: r.taken for r in got} == again
    taken, targets, largest = Counter(), {}, Counter()
    for r in got:
        taken[r.source] += r.taken
        targets[r.source] = r.target
        largest[r.source] = max(largest[r.source], r.size)
        assert r.taken <= 3 * r.size and r.target <= 3 * r.source_size
    assert math.isclose(sum(targets.values()), sum(r.size for r in got))
    assert all(abs(taken[s] - t) <= largest[s] for s, t in targets.items())
    assert mixing.mix(odd).count() == odd.count() and mixing.mix(none).count() == 0
    rows = mixing.mixed_rows(docs)
    assert rows.columns == docs.columns and rows.count() == sum(r.epochs for r in got)


def test_targets_share_the_excess(spark):
    sizes = spark.createDataFrame([("a", 1000), ("b", 10), ("c", 990), (None, 0)], "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(sizes).collect()}
    level = (2000 - 30) / (1 + 3)  # b is held at 3 * 10; the null source weighs 1 and is held at 0
    assert got["b"] == 30 and got[None] == 0 and math.isclose(got["a"], level) and math.isclose(got["c"], 3 * level)


@pytest.mark.parametrize("noise", [0, 1, 6, 50])
def test_mixing_slices_are_even_at_every_quality(spark, noise):
    docs = spark.range(200_000).select(F.col("id").alias("doc_id"), F.lit("word " * 20 + "# " * noise).alias("text"), F.lit("s").alias("source"))
    keys = mixing.mix(docs).select("sample_key", mixing.slice_of(F.col("sample_key"), 1000).alias("cell"))
    assert keys.groupBy("cell").count().agg(F.max("count")).first()[0] < 10 * 200 * 1.3
    ordered = keys.groupBy("cell").agg(F.min("sample_key").alias("lo"), F.max("sample_key").alias("hi")).orderBy("cell").collect()
    assert all(a.hi <= b.lo for a, b in zip(ordered, ordered[1:]))


def test_mixed_rows_of_odd_tables(spark, odd, none):
    times = Counter()
    for r in mixing.mix(odd).collect():
        times[r.doc_id] = max(times[r.doc_id], r.epochs)
    got = mixing.mixed_rows(odd)
    assert got.columns == odd.columns and mixing.mixed_rows(none).count() == 0
    assert Counter(r.doc_id for r in got.collect()) == Counter({i: n * sum(r.doc_id == i for r in odd.collect()) for i, n in times.items() if n})


def test_quality(spark, odd, none, texts):
    for r in registry.queries()["op7_quality"](spark, SMALL).collect():
        want = brute.quality(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0]) and not (r.kept and r.base_failed)
    got = {r.doc_id: r for r in quality.judge(odd).collect()}
    for i, t in named(odd):
        assert (got[i].n_words, got[i].word_chars, got[i].n_symbols, got[i].n_dup_lines, got[i].n_repeat_words) == brute.quality(t)
    assert quality.judge(none).count() == 0


def test_quality_estimation_finds_the_good_class():
    rng = random.Random(4)
    n = len(quality.RULES)
    counts = Counter()
    for _ in range(3000):
        good = rng.random() < 0.8
        counts[tuple((1 if good else -1) if rng.random() < 0.6 else (0 if rng.random() < 0.7 else (-1 if good else 1)) for _ in range(n))] += 1
    odds, ratio = quality.estimate(sorted(counts.items()))
    assert 0.7 < 1 / (1 + math.exp(-odds)) < 0.9 and all(r[1] > 0 > r[-1] for r in ratio)


def test_quality_agrees_with_labels(spark):
    folder = "/root/testdata/sf0.01"
    got = registry.queries()["op7_quality"](spark, folder).filter("NOT base_failed").join(
        spark.read.parquet(f"{folder}/labels.parquet").selectExpr("doc_id", "quality AS label"), "doc_id")
    assert got.filter("kept = (label = 1)").count() >= 0.95 * got.count()


def test_packing(spark, odd, none, docs, texts):
    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_file(packing.vocabulary_path())
    for source, rows in ((docs, texts.items()), (odd, named(odd))):
        got = packing.pack(packing.pieces(source)).collect()
        want = Counter()
        for i, t in rows:
            ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, packing.END]
            for a in range(0, len(ids), 2048):
                want[(i, a, len(ids[a:a + 2048]), zlib.crc32(np.array(ids[a:a + 2048], dtype="<u4").tobytes()), len(ids))] += 1
        assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in got) == want
        sequences = defaultdict(list)
        for r in got:
            sequences[r.sequence_id].append((r.offset, r.length))
        for spans in sequences.values():
            at = 0
            for offset, length in sorted(spans):
                assert offset == at
                at += length
            assert at <= 2048
    assert packing.pack(packing.pieces(none)).count() == 0


def test_arrange_leaves_little_padding():
    rng = random.Random(9)
    lengths = [min(2048, 1 + int(rng.expovariate(1 / 500))) for _ in range(5000)]
    sequences = packing.arrange(lengths)
    assert sorted(i for s in sequences for i in s) == list(range(len(lengths)))
    totals = [sum(lengths[i] for i in s) for s in sequences]
    assert max(totals) <= 2048 and sum(2048 - t for t in totals if t & (t - 1)) < 0.01 * sum(totals)
    assert packing.arrange([]) == [] and packing.arrange([256]) == [[0]]


def test_attention_gradients_and_scorer():
    rng = np.random.default_rng(0)
    w = attention.start(np.full(attention.COARSE, 1 / attention.COARSE))
    inputs, targets = rng.integers(0, attention.FINE, (3, attention.PLACES)), rng.integers(0, attention.COARSE, (3, attention.PLACES))
    weight = np.ones(inputs.shape, np.float32)
    weight[0, 10:] = 0
    loss = lambda: -float((attention.Scorer(w).log_probability(inputs, targets) * weight).sum() / weight.sum())
    g = attention.gradients(w, inputs, targets, weight)
    for name, at in (("embed", (inputs[1, 3], 2)), ("place", (4, 1)), ("value", (3, 5)), ("mix", (2, 2)), ("out", (1, 7)), ("bias", (5,))):
        keep = w[name][at]
        w[name][at] = keep + 1e-2
        high = loss()
        w[name][at] = keep - 1e-2
        low = loss()
        w[name][at] = keep
        assert abs((high - low) / 2e-2 - g[name][at]) < 2e-3, name
    later = inputs.copy()
    later[:, 12:] = 0  # causal: places before 12 don't see it
    assert np.allclose(attention.Scorer(w).log_probability(inputs, targets)[:, :12], attention.Scorer(w).log_probability(later, targets)[:, :12], atol=1e-5)


def test_windows_score_each_token_once():
    lengths = np.array([1, 5, attention.PLACES, attention.PLACES + 1, 100, 217])
    text, first, context = attention.windows(lengths)
    seen = Counter()
    for t, f, c in zip(text, first, context, strict=True):
        for place in range(c, attention.PLACES):
            if f + place < lengths[t]:
                seen[(t, f + place)] += 1
    assert seen == Counter({(t, p): 1 for t, n in enumerate(lengths) for p in range(n)})


def test_lm_scores(spark, odd, none, texts):
    tokens = {i: [*brute.words(t, True), None] for i, t in texts.items()}
    counts = Counter(w for i, ws in tokens.items() if zlib.crc32(str(i).encode()) % 7 != 2 for w in ws)
    total, distinct = sum(counts.values()), len(counts)
    got = registry.queries()["op9_lm_scores"](spark, SMALL).collect()
    for r in got:
        own = tokens[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (
            zlib.crc32(str(r.doc_id).encode()) % 7 == 2, len(own), sum(counts[w] > 0 for w in own), total)
        assert math.isclose(r.base_score, sum(math.log10((counts[w] + 1) / (total + distinct + 1)) for w in own), rel_tol=1e-9)
        assert math.isfinite(r.score) and r.score < 0
    assert lm.score(odd).count() == odd.count() and lm.score(none).count() == 0


def test_every_training_text_reaches_the_weights(spark):
    classes = lm.Classes(np.ones(lm.VOCABULARY), np.ones(lm.VOCABULARY), lm._word_ends())
    begin = attention.pack(attention.start(classes.shares))
    key = F.pmod(F.xxhash64(F.lit("train"), F.col("doc_id").cast("string")), F.lit(16))
    ids = [r.doc_id for r in spark.range(200).withColumnRenamed("id", "doc_id").filter((key > 1) & (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 != 2))
           .withColumn("part", key).dropDuplicates(["part"]).collect()]
    assert len(ids) == 14
    for i in ids[:4]:
        one = spark.createDataFrame([(i, "some words to learn from, once")], "doc_id long, text string")
        assert not np.array_equal(lm.fit(lm.blocks(one, "doc_id", "text", 1), classes), begin)


def test_every_subword_has_a_probability_of_its_own():
    rng = np.random.default_rng(3)
    counts = np.where(np.arange(lm.VOCABULARY) < 3000, rng.integers(0, 50, lm.VOCABULARY), 0)
    classes = lm.Classes(counts, counts, lm._word_ends())
    w = attention.start(classes.shares)
    w["inner"] = rng.standard_normal(w["inner"].shape).astype(np.float32)
    scorer, inputs = attention.Scorer(w, classes.members), rng.integers(0, 3000, (1, attention.PLACES))
    y = scorer.hidden(inputs)[0, 7]
    scored = np.zeros(inputs.shape, dtype=bool)
    scored[0, 7] = True
    z = y @ w["out"] + w["bias"]
    p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
    total = 0.0
    for c in range(attention.COARSE):
        own = np.flatnonzero(classes.members.of == c)
        rows = classes.members.row[own]
        inner = w["inner"][rows] @ np.append(y, 1) + classes.members.prior[rows]
        each = np.exp(inner - inner.max()) / np.exp(inner - inner.max()).sum() * p[c]
        total += each.sum()
        for i in own[:2]:
            got = scorer.ids_log_probability(inputs, np.full(inputs.shape, i), scored)
            assert math.isclose(got[0], math.log(each[own == i][0]), abs_tol=1e-3)
    assert math.isclose(total, 1, abs_tol=1e-3)


def test_training_tells_ids_of_one_class_apart():
    counts = np.zeros(lm.VOCABULARY)
    counts[100:140] = 10
    classes = lm.Classes(counts, counts, np.zeros(lm.VOCABULARY, np.int64))
    same = np.flatnonzero(classes.members.of == classes.members.of[100])
    a, b = same[:2]
    rng = np.random.default_rng(5)
    inputs = rng.integers(100, 140, (4096, attention.PLACES))
    inputs[:, ::2] = np.where(rng.random((4096, attention.PLACES // 2)) < 0.5, 120, 130)
    targets = np.roll(inputs, -1, axis=1)
    targets[:, ::2] = np.where(inputs[:, ::2] == 120, a, b)
    w = attention.train(attention.start(classes.shares), classes.members, inputs, targets, np.ones(inputs.shape, dtype=bool))
    places = np.zeros(inputs[:64].shape, dtype=bool)
    places[:, ::2] = True
    scorer = attention.Scorer(w, classes.members)
    right = scorer.ids_log_probability(inputs[:64], targets[:64], places)
    wrong = scorer.ids_log_probability(inputs[:64], np.where(targets[:64] == a, b, a), places)
    assert right.mean() > wrong.mean() + 1


def test_attention_beats_the_unigram_on_held_out_texts(spark):
    got = registry.queries()["op9_lm_scores"](spark, "/root/testdata/sf0.01").filter("held_out")
    base, model = got.agg(F.sum("base_score"), F.sum("score")).first()
    assert model > base


def test_toxicity(spark, odd, none):
    folder = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    docs = registry.documents(spark, folder)
    model = toxicity.train(docs, labels)
    got = toxicity.score(docs, model).join(labels.filter("toxic IS NOT NULL"), "doc_id").filter("held_out").collect()
    right = sum(r.predicted == r.toxic for r in got)
    assert right >= 0.93 * len(got) and sum(r.predicted for r in got if not r.toxic) <= 0.02 * len(got)
    scored = toxicity.score(odd, model).collect()
    assert len(scored) == odd.count() and all(0 <= r.score <= 1 for r in scored) and toxicity.score(none, model).count() == 0
    assert toxicity.drop_toxic(odd, model).columns == odd.columns
    assert toxicity.train(docs, labels.filter("toxic = 0")) is None and toxicity.score(odd, None).filter("score <> 0").count() == 0
