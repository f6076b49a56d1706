"""Corpus preparation queries."""

from pyspark.sql import functions as F

from mailgraph.functions import text as T
from mailgraph.operators import corpus as C
from mailgraph.plans.oracle import register_view
from mailgraph.plans.registry import query

KEY = r"sha256(trim(regexp_replace(lower(coalesce(text, '')), '[ \t\r\n\f\v]+', ' ', 'g')))"
MASKED = (
    r"sha256(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(coalesce(text, '')), "
    r"'https?://[^ \t\r\n]+|www\.[^ \t\r\n]+', ' <url> ', 'g'), '[a-z0-9_.+-]+@[a-z0-9_-]+\.[a-z0-9_.-]+', ' <email> ', 'g'), "
    r"'[0-9]+', ' <num> ', 'g'), '[ \t\r\n\f\v]+', ' ', 'g')))"
)

register_view("v_keyed", f"SELECT *, {KEY} AS key FROM v_corpus")
register_view("v_split", """
    SELECT *, CASE WHEN rn * 10 <= n * 8 THEN 'train' WHEN rn * 10 <= n * 9 THEN 'validation' ELSE 'test' END AS split FROM (
        SELECT *, row_number() OVER (PARTITION BY label ORDER BY sha256('42:' || msg_id)) AS rn,
               count(*) OVER (PARTITION BY label) AS n
        FROM v_keyed)""")
register_view("v_template_split", f"SELECT *, {MASKED} AS template FROM v_split")


@query("S02_labelled_corpus", """
    SELECT source, label, count(*) AS docs, sum(length(text))::BIGINT AS chars FROM (
        SELECT d.source, d.text, l.quality AS label FROM documents d JOIN labels l USING (doc_id) WHERE l.quality IN (0, 1))
    GROUP BY source, label""")
def labelled_corpus(t):
    return C.labelled(t.documents, t.labels).groupBy("source", "label").agg(
        F.count(F.lit(1)).alias("docs"), F.sum(F.length("text")).alias("chars"))


@query("F01_dedup_key", f"SELECT msg_id, {KEY} AS key FROM v_corpus")
def dedup_key(t):
    return C.with_key(t.corpus).select("msg_id", "key")


@query("A01_exact_dedup", """
    SELECT msg_id, key, copies FROM (
        SELECT msg_id, key, count(*) OVER (PARTITION BY key) AS copies, row_number() OVER (PARTITION BY key ORDER BY msg_id) AS rn
        FROM v_keyed) WHERE rn = 1""")
def exact_dedup(t):
    return C.families(C.with_key(t.corpus)).select(F.col("first_id").alias("msg_id"), "key", "copies")


@query("A01_dedup_removed_by_source", """
    SELECT source, count(*) AS rows_before, count(*) FILTER (kept) AS rows_after FROM (
        SELECT k.source, k.msg_id = min(k.msg_id) OVER (PARTITION BY key)
               AND min(label) OVER (PARTITION BY key) = max(label) OVER (PARTITION BY key) AS kept FROM v_keyed k)
    GROUP BY source""")
def dedup_removed(t):
    keyed = C.with_key(t.corpus).select("msg_id", "source", "label", "key")
    kept = C.deduplicated(keyed).select("msg_id", F.lit(True).alias("kept"))
    return keyed.join(kept, "msg_id", "left").groupBy("source").agg(
        F.count(F.lit(1)).alias("rows_before"), F.count("kept").alias("rows_after"))


@query("A02_label_conflicts", """
    SELECT key, min(msg_id) AS first_id, count(*) AS copies FROM v_keyed GROUP BY key HAVING count(DISTINCT label) > 1""")
def label_conflicts(t):
    return C.label_conflicts(C.with_key(t.corpus))


@query("J18_without_conflicts", """
    SELECT msg_id, key, label FROM v_keyed WHERE key NOT IN (
        SELECT key FROM v_keyed GROUP BY key HAVING count(DISTINCT label) > 1)""")
def without_conflicts(t):
    return C.without_conflicts(C.with_key(t.corpus).select("msg_id", "label", "key")).select("msg_id", "key", "label")


@query("A03_stratified_split", "SELECT msg_id, label, split FROM v_split")
def stratified_split(t):
    return C.stratified_split(t.corpus.select("msg_id", "label")).select("msg_id", "label", "split")


@query("J17_split_overlap", """
    WITH s AS (SELECT DISTINCT key, split FROM v_split),
         p AS (SELECT * FROM (VALUES ('train', 'validation'), ('train', 'test'), ('validation', 'test')) p(l, r))
    SELECT l || '-' || r AS pair, (SELECT count(*) FROM s a JOIN s b USING (key) WHERE a.split = l AND b.split = r) AS shared_keys FROM p""")
def split_overlap(t):
    return C.split_overlap(C.stratified_split(C.with_key(t.corpus).select("msg_id", "label", "key")))


@query("U02_intersect_keys", """
    SELECT key FROM v_split WHERE split = 'train' INTERSECT SELECT key FROM v_split WHERE split = 'test'""")
def intersect_keys(t):
    split = C.stratified_split(C.with_key(t.corpus).select("msg_id", "label", "key"))
    part = lambda name: split.filter(F.col("split") == name).select("key")
    return part("train").intersect(part("test"))


@query("U01_union_splits", """
    SELECT split, label, count(*) AS rows FROM (
        SELECT * FROM v_split WHERE split = 'train' UNION ALL SELECT * FROM v_split WHERE split <> 'train') GROUP BY split, label""")
def union_splits(t):
    split = C.stratified_split(t.corpus.select("msg_id", "label"))
    parts = [split.filter(F.col("split") == name) for name in C.SPLITS]
    return C.pooled(*parts).groupBy("split", "label").agg(F.count(F.lit(1)).alias("rows"))


@query("F02_template_signature", f"SELECT msg_id, {MASKED} AS template FROM v_corpus")
def template_signature(t):
    return C.with_template(t.corpus).select("msg_id", "template")


@query("A26_template_families", f"""
    SELECT template, count(*) AS rows, min(msg_id) AS first_id, max(msg_id) AS last_id
    FROM (SELECT msg_id, {MASKED} AS template FROM v_corpus) GROUP BY template HAVING count(*) >= 2""")
def template_families(t):
    return C.template_families(t.corpus)


@query("J16_leaked_rows", """
    SELECT msg_id, template IN (SELECT template FROM v_template_split WHERE split = 'train') AS leaked
    FROM v_template_split WHERE split = 'test'""")
def leaked_rows(t):
    split = C.with_template(C.stratified_split(t.corpus)).select("msg_id", "split", "template")
    leaked, novel = C.leakage(split)
    return leaked.select("msg_id", F.lit(True).alias("leaked")).unionByName(novel.select("msg_id", F.lit(False).alias("leaked")))


@query("J16_leakage_report", """
    WITH test AS (SELECT template FROM v_template_split WHERE split = 'test'),
         r AS (SELECT p.pool, count(*) AS test_rows, count(*) FILTER (template IN (
                   SELECT template FROM v_template_split s WHERE s.split = 'train'
                       OR (p.pool = 'train+validation' AND s.split = 'validation'))) AS leaked
               FROM test, (VALUES ('train'), ('train+validation')) p(pool) GROUP BY p.pool)
    SELECT pool, test_rows, leaked, test_rows - leaked AS novel, round(100.0::DOUBLE * leaked / test_rows, 6) AS leaked_pct FROM r""")
def leakage_report(t):
    return C.leakage_report(C.with_template(C.stratified_split(t.corpus)).select("split", "template"))


@query("W11_seeded_sample", """
    SELECT msg_id, source, sample_rank, available, least(available, 25) AS used FROM (
        SELECT msg_id, source, row_number() OVER (PARTITION BY source ORDER BY sha256('42:' || msg_id)) AS sample_rank,
               count(*) OVER (PARTITION BY source) AS available FROM v_corpus) WHERE sample_rank <= 25""")
def seeded_sample(t):
    return C.seeded_sample(t.corpus.select("msg_id", "source"), "source", 25)


@query("F03_similarity_text", r"""
    SELECT msg_id, sha256(trim(regexp_replace(lower(subject || chr(10) || body), '[ \t\r\n\f\v]+', ' ', 'g'))) AS digest,
           length(trim(regexp_replace(lower(subject || chr(10) || body), '[ \t\r\n\f\v]+', ' ', 'g'))) AS chars FROM v_message""")
def similarity_text(t):
    text = T.squeeze(T.message_text(F.col("subject"), F.col("body")))
    return t.message.select("msg_id", F.sha2(text, 256).alias("digest"), F.length(text).alias("chars"))
