"""Evaluation, calibration, robustness and attribution."""

from pyspark.sql import functions as F

from mailgraph.functions import hosts
from mailgraph.functions import rules
from mailgraph.operators import corpus as C
from mailgraph.operators import enrichment as E
from mailgraph.operators import evaluation as V
from mailgraph.operators import threads as TH
from mailgraph.plans.catalog.enrichment import context, exit_nodes, geo
from mailgraph.plans.evidence import Evidence
from mailgraph.plans.oracle import register_view
from mailgraph.plans.registry import query


def rounded(df, *columns, places=6):
    return df.withColumns({c: F.round(c, places) for c in columns})


register_view("v_flagged", """
    SELECT unnest(['score_ge_25', 'score_ge_45', 'hold', 'model_phishing']) AS rule, source, quality,
           unnest([score >= 25, score >= 45, score >= 60 OR priority = 'urgent', label = 'phishing']) AS flagged FROM v_triage""")


@query("A13_rule_metrics", """
    WITH c AS (SELECT rule, count(*) FILTER (q AND flagged) AS tp, count(*) FILTER (q AND NOT flagged) AS fn, count(*) FILTER (NOT q AND flagged) AS fp,
                      count(*) FILTER (NOT q AND NOT flagged) AS tn FROM (SELECT rule, flagged, quality = 0 AS q FROM v_flagged WHERE quality IS NOT NULL) GROUP BY rule)
    SELECT rule, tp, fn, fp, tn, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall,
           round(coalesce(2.0::DOUBLE * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1, round(coalesce(fp / nullif(fp + tn, 0), 0), 6) AS false_positive_rate FROM c""")
def rule_metrics(t):
    case = Evidence(t).case.filter("quality IS NOT NULL").withColumn("positive", F.col("quality") == 0)
    return rounded(V.rule_metrics(V.apply_rules(case, V.case_rules(), "positive")), "precision", "recall", "f1", "false_positive_rate")


@query("A13_flagged_by_corpus", "SELECT rule, source, count(*) FILTER (flagged) AS flagged, count(*) AS evaluated FROM v_flagged GROUP BY rule, source")
def flagged_by_corpus(t):
    return V.flagged_by_corpus(V.apply_rules(Evidence(t).case, V.case_rules(), "source"), "source")


def class_pairs(t):
    from mailgraph.operators import decisions as D
    predicted = D.classify(Evidence(t).case).select("msg_id", F.col("primary").alias("predicted"))
    i = F.col("msg_id")
    actual = F.when(i % 5 == 0, "phishing").when(i % 5 == 1, "fraud_related").when(i % 5 == 2, "suspicious").when(i % 5 == 3, "impersonated").otherwise("legitimate")
    return predicted.withColumn("actual", actual)


register_view("v_class_pair", """
    SELECT primary_class AS predicted, ['phishing', 'fraud_related', 'suspicious', 'impersonated', 'legitimate'][msg_id % 5 + 1] AS actual FROM v_class""")


@query("A14_confusion", "SELECT actual, predicted, count(*) AS n FROM v_class_pair GROUP BY ALL")
def confusion(t):
    return V.confusion(class_pairs(t))


@query("A14_per_class", """
    WITH k AS (SELECT actual AS cls FROM v_class_pair UNION SELECT predicted FROM v_class_pair)
    SELECT cls, count(*) FILTER (actual = cls) AS support,
           round(coalesce(count(*) FILTER (actual = cls AND predicted = cls) / nullif(count(*) FILTER (actual = cls), 0), 0), 6) AS recall,
           round(coalesce(count(*) FILTER (actual = cls AND predicted = cls) / nullif(count(*) FILTER (predicted = cls), 0), 0), 6) AS precision,
           round(count(*) FILTER (actual = predicted) / count(*), 6) AS accuracy FROM k, v_class_pair GROUP BY cls""")
def per_class(t):
    return rounded(V.per_class(class_pairs(t)), "recall", "precision", "accuracy")


@query("A15_brier_nll", """
    SELECT round(avg((p - label) * (p - label)), 6) AS brier, round(avg(-(label * ln(greatest(least(p, 1 - 1e-12), 1e-12))
           + (1 - label) * ln(1 - greatest(least(p, 1 - 1e-12), 1e-12)))), 6) AS nll, count(*) AS n FROM v_prediction""")
def brier_nll(t):
    return rounded(V.brier_and_nll(t.prediction), "brier", "nll")


@query("A16_reliability", """
    SELECT b.bin, count(p) AS count, round(avg(p), 6) AS mean_predicted, round(avg(label), 6) AS positive_fraction
    FROM (SELECT unnest(range(0, 10))::INTEGER AS bin) b LEFT JOIN v_prediction v ON least(floor(p * 10), 9) = b.bin GROUP BY b.bin""")
def reliability(t):
    return rounded(V.reliability(t.prediction), "mean_predicted", "positive_fraction")


register_view("v_grid", """
    SELECT temperature, avg(-(label * ln(greatest(least(q, 1 - 1e-12), 1e-12)) + (1 - label) * ln(1 - greatest(least(q, 1 - 1e-12), 1e-12)))) AS nll FROM (
        SELECT label, temperature, 1 / (1 + exp(-ln(p / (1 - p)) / temperature)) AS q FROM v_prediction,
            (SELECT round(0.5 + i * 0.02, 2)::DOUBLE AS temperature FROM (SELECT unnest(range(0, 226)) AS i))) GROUP BY temperature""")


@query("A17_temperature_grid", "SELECT temperature, round(nll, 6) AS nll FROM v_grid")
def temperature_grid(t):
    return rounded(V.temperature_grid(t.prediction), "nll")


@query("A17_fitted_temperature", """
    WITH b AS (SELECT temperature, nll FROM v_grid ORDER BY nll, temperature LIMIT 1)
    SELECT temperature, round(nll, 6) AS nll, round(raw, 6) AS raw_brier, round(scaled, 6) AS scaled_brier, raw - scaled >= 0.001 AND temperature BETWEEN 0.05 AND 20 AS accepted
    FROM (SELECT any_value(temperature) AS temperature, any_value(nll) AS nll, avg((p - label) * (p - label)) AS raw,
                 avg(pow(1 / (1 + exp(-ln(p / (1 - p)) / temperature)) - label, 2)) AS scaled FROM v_prediction, b)""")
def fitted_temperature(t):
    return rounded(V.fit_temperature(t.prediction), "nll", "raw_brier", "scaled_brier")


@query("M04_calibration_report", """
    SELECT b.bin, count(p) AS count, round(avg(p), 6) AS mean_predicted, round(avg(label), 6) AS positive_fraction
    FROM (SELECT unnest(range(0, 10))::INTEGER AS bin) b LEFT JOIN (
        SELECT label, 1 / (1 + exp(-ln(p / (1 - p)) / (SELECT temperature FROM v_grid ORDER BY nll, temperature LIMIT 1))) AS p FROM v_prediction) v
    ON least(floor(p * 10), 9) = b.bin GROUP BY b.bin""")
def calibration_report(t):
    best = V.fit_temperature(t.prediction).select("temperature")
    scaled = t.prediction.select("label", (1 / (1 + F.exp(-F.log(F.col("p") / (1 - F.col("p"))) / best.scalar()))).alias("p"))
    return rounded(V.reliability(scaled), "mean_predicted", "positive_fraction")


@query("A19_auc", """
    WITH r AS (SELECT label, p, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2 AS rk FROM v_prediction),
         c AS (SELECT count(*) FILTER (label = 1 AND p >= 0.5) AS tp, count(*) FILTER (label = 0 AND p >= 0.5) AS fp,
                      count(*) FILTER (label = 1 AND p < 0.5) AS fn, count(*) AS n, count(*) FILTER (label = 0 AND p < 0.5) AS tn FROM v_prediction)
    SELECT round((SELECT (sum(rk) FILTER (label = 1) - count(*) FILTER (label = 1) * (count(*) FILTER (label = 1) + 1) / 2)
                         / (count(*) FILTER (label = 1) * count(*) FILTER (label = 0)) FROM r), 6) AS auc,
           round((tp + tn) / n, 6) AS accuracy, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1 FROM c""")
def auc(t):
    return rounded(V.auc(t.prediction), "auc", "accuracy", "precision", "recall", "f1")


@query("A18_subset_accuracy", """
    WITH s AS (SELECT t.msg_id, template IN (SELECT template FROM v_template_split WHERE split = 'train') AS leaked,
                      CASE WHEN m.probability >= 50 THEN 1 ELSE 0 END = t.label AS correct FROM v_template_split t JOIN v_model m USING (msg_id) WHERE split = 'test'),
         c AS (SELECT count(*) FILTER (leaked) AS n_a, count(*) FILTER (NOT leaked) AS n_b, count(*) FILTER (leaked AND correct) / count(*) FILTER (leaked) AS a,
                      count(*) FILTER (NOT leaked AND correct) / count(*) FILTER (NOT leaked) AS b FROM s)
    SELECT n_a, n_b, round(a, 6) AS accuracy_a, round(b, 6) AS accuracy_b, round((a - b) * 100, 6) AS difference,
           round((a - b) * 100 - 196 * sqrt(a * (1 - a) / n_a + b * (1 - b) / n_b), 6) AS low, round((a - b) * 100 + 196 * sqrt(a * (1 - a) / n_a + b * (1 - b) / n_b), 6) AS high FROM c""")
def subset_accuracy(t):
    split = C.with_template(C.stratified_split(t.corpus)).select("msg_id", "label", "split", "template")
    leaked, novel = C.leakage(split)
    both = leaked.select("msg_id", "label", F.lit(True).alias("leaked")).unionByName(novel.select("msg_id", "label", F.lit(False).alias("leaked")))
    scored = both.join(t.model.select("msg_id", "probability"), "msg_id").withColumn("correct", (F.col("probability") >= 50).cast("int") == F.col("label"))
    return rounded(V.subset_comparison(scored), "accuracy_a", "accuracy_b", "difference", "low", "high")


@query("A20_latency", """
    SELECT event_type, count(*) AS n_total, min(value) AS min, max(value) AS max, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS stdev,
           round(median(value), 6) AS median, list_sort(list(value))[floor(count(*) * 0.90)::INTEGER + 1] AS p90,
           list_sort(list(value))[floor(count(*) * 0.95)::INTEGER + 1] AS p95, list_sort(list(value))[floor(count(*) * 0.99)::INTEGER + 1] AS p99
    FROM events GROUP BY event_type""")
def latency(t):
    return rounded(V.latency(t.events.select("event_type", "value"), "event_type"), "mean", "stdev", "median")


register_view("v_attribution_input", """
    SELECT m.msg_id, o.confidence AS origin_confidence, a.spf_aligned, a.dkim_aligned, a.dmarc, a.arc,
           m.message_id IS NOT NULL AS registration_available, (m.msg_id % 60)::INTEGER AS domain_age_days,
           (SELECT count(*) FROM v_relay_check c WHERE c.msg_id = m.msg_id) AS conflicts,
           EXISTS (SELECT 1 FROM v_hop h JOIN v_geo g ON g.ip = h.ip AND g.status = 'available' WHERE h.msg_id = m.msg_id
                   AND NOT (h.ip LIKE '10.%' OR h.ip LIKE '192.168.%')) AS geo_available,
           EXISTS (SELECT 1 FROM v_hop h JOIN v_exit_node x ON x.ip = h.ip WHERE h.msg_id = m.msg_id) AS tor_match,
           coalesce((SELECT bool_or(regexp_matches(lower(usage), 'hosting|data center|transit|vpn|proxy') OR abuse > 50) FROM v_hop h JOIN v_geo g ON g.ip = h.ip WHERE h.msg_id = m.msg_id), false) AS anonymised
    FROM v_message m JOIN v_origin o USING (msg_id) JOIN v_dmarc a USING (msg_id)""")


def attribution_input(t):
    e = Evidence(t)
    ips = E.enrich_ips(t.hop, geo(t)).groupBy("msg_id").agg(
        F.bool_or(F.col("status") == "available").alias("geo_available"), F.max("hop").alias("hops"),
        F.bool_or(F.coalesce(E.anonymised(F.col("usage"), F.lit(False), F.col("abuse")), F.lit(False))).alias("anonymised"))
    tor = E.members(t.hop.select("msg_id", "ip"), exit_nodes(t)).select("msg_id", F.lit(True).alias("tor_match")).distinct()
    conflicts = TH.relay_checks(t.hop).groupBy("msg_id").agg(F.count(F.lit(1)).alias("conflicts"))
    base = t.message.select("msg_id", F.col("message_id").isNotNull().alias("registration_available"), (F.col("msg_id") % 60).cast("int").alias("domain_age_days"))
    return (
        base.join(E.origin(t.hop, geo(t), context(t)).select("msg_id", F.col("confidence").alias("origin_confidence")), "msg_id")
        .join(e.auth, "msg_id").join(ips, "msg_id").join(tor, "msg_id", "left").join(conflicts, "msg_id", "left")
        .withColumn("conflicts", F.coalesce("conflicts", F.lit(0))).withColumn("tor_match", F.coalesce("tor_match", F.lit(False)))
        .withColumn("checks_done", F.lit(True)).withColumn("ip_available", F.col("geo_available")))


ATTRIBUTION = """
    WITH s AS (SELECT *, CASE WHEN origin_confidence = 'authenticated_observation' THEN 35 ELSE 0 END + CASE WHEN spf_aligned THEN 10 ELSE 0 END
            + CASE WHEN dkim_aligned THEN 10 ELSE 0 END + CASE WHEN dmarc = 'pass' THEN 10 ELSE 0 END
            + CASE WHEN registration_available AND domain_age_days >= 30 THEN 10 ELSE 0 END + CASE WHEN conflicts = 0 THEN 10 ELSE 0 END
            + CASE WHEN geo_available THEN 15 ELSE 0 END + CASE arc WHEN 'pass' THEN 10 WHEN 'fail' THEN -15 ELSE 0 END
            - CASE WHEN tor_match THEN 25 ELSE 0 END - CASE WHEN anonymised THEN 15 ELSE 0 END
            - CASE WHEN registration_available AND domain_age_days < 30 THEN 10 ELSE 0 END - least(30, conflicts * 10) AS raw FROM v_attribution_input),
    f AS (SELECT msg_id, least(100, CASE WHEN origin_confidence = 'undetermined' THEN least(20, greatest(0, raw)) ELSE greatest(0, raw) END)::INTEGER AS attribution_score FROM s)
    SELECT msg_id, attribution_score, CASE WHEN attribution_score < 35 THEN 'low' WHEN attribution_score < 70 THEN 'moderate' ELSE 'high' END AS band FROM f"""
register_view("v_attribution", "SELECT * FROM (" + ATTRIBUTION + ")")


@query("A24_attribution", ATTRIBUTION)
def attribution(t):
    return V.attribution(attribution_input(t)).select("msg_id", "attribution_score", "band")


@query("A25_ordering", """
    WITH s AS (SELECT origin_confidence AS scenario, round(avg(attribution_score), 6) AS attribution_score FROM (
        SELECT i.origin_confidence, a.attribution_score FROM v_attribution_input i JOIN v_attribution a USING (msg_id)) GROUP BY 1)
    SELECT a.scenario AS stronger, b.scenario AS weaker, a.attribution_score > b.attribution_score AS holds
    FROM s a, s b WHERE (a.scenario, b.scenario) IN (('authenticated_observation', 'conditional'), ('conditional', 'undetermined'), ('low', 'undetermined'))""")
def ordering(t):
    scored = V.attribution(attribution_input(t)).groupBy(F.col("origin_confidence").alias("scenario")).agg(F.round(F.avg("attribution_score"), 6).alias("attribution_score"))
    pairs = t.spark.createDataFrame([("authenticated_observation", "conditional"), ("conditional", "undetermined"), ("low", "undetermined")], "stronger string, weaker string")
    return V.ordering_check(scored, pairs).select("stronger", "weaker", "holds")


@query("W09_token_windows", """
    WITH w AS (SELECT msg_id, list_filter(string_split_regex(body, '[ \t\r\n]+'), lambda x: x <> '') AS tok FROM v_message),
    n AS (SELECT *, len(tok) AS n, CASE WHEN len(tok) <= 254 THEN 1 ELSE ceil((len(tok) - 254) / 222)::INTEGER + 1 END AS k FROM w)
    SELECT msg_id, i AS window, len(tok[i * 222 + 1 : i * 222 + 254])::INTEGER AS size, least(n, (k - 1) * 222 + 254)::INTEGER AS covered
    FROM n, (SELECT unnest(range(0, 200))::INTEGER AS i) WHERE i < k""")
def token_windows(t):
    tokens = F.filter(F.split("body", "[ \\t\\r\\n]+"), lambda x: x != "")
    return V.token_windows(t.message, tokens, "msg_id").select("msg_id", "window", F.size("tokens").alias("size"), "covered")


@query("W09_worst_window", """
    WITH w AS (SELECT msg_id, list_filter(string_split_regex(body, '[ \t\r\n]+'), lambda x: x <> '') AS tok FROM v_message),
    n AS (SELECT *, CASE WHEN len(tok) <= 254 THEN 1 ELSE ceil((len(tok) - 254) / 222)::INTEGER + 1 END AS k FROM w),
    s AS (SELECT msg_id, k, i, len(list_filter(tok[i * 222 + 1 : i * 222 + 254], lambda x: length(x) > 8))::INTEGER AS score
          FROM n, (SELECT unnest(range(0, 200))::INTEGER AS i) WHERE i < k)
    SELECT msg_id, any_value(k) AS windows, max(score) AS score, arg_min(i, -score * 1000 + i) AS triggering_window FROM s GROUP BY msg_id""")
def worst_window(t):
    tokens = F.filter(F.split("body", "[ \\t\\r\\n]+"), lambda x: x != "")
    windows = V.token_windows(t.message, tokens, "msg_id")
    return V.worst_window(windows, F.size(F.filter("tokens", lambda x: F.length(x) > 8)), "msg_id").select("msg_id", "windows", "score", "triggering_window")


@query("F27_perturbations", """
    SELECT msg_id, length(body) + length($$FILL$$) + 1 AS padded, body || chr(10) || $$FILL$$ = body || chr(10) || $$FILL$$ AS same,
           sha256($$FILL$$ || chr(10) || body) AS shifted FROM v_message""".replace("FILL", V.filler(40)))
def perturbations(t):
    p = V.perturbations(F.col("body"), 40)
    return t.message.select("msg_id", F.length(p["pad"]).cast("long").alias("padded"), (p["none"] == F.col("body")).alias("same"), F.sha2(p["truncation_shift"], 256).alias("shifted"))


def rule_score(text):
    return 10.0 * F.size(rules.hits(text, rules.DOCUMENT_RULES)) + F.when(text.rlike("(?i)\\baccount\\b"), 10.0).otherwise(0.0)


def _sql_rule_score(text):
    parts = [f"CASE WHEN regexp_matches({text}, '{r.patterns[0]}') THEN 10 ELSE 0 END" for r in rules.DOCUMENT_RULES]
    return "(" + " + ".join(parts) + f" + CASE WHEN regexp_matches({text}, '(?i)(^|[^A-Za-z0-9_])account([^A-Za-z0-9_]|$)') THEN 10 ELSE 0 END)::DOUBLE"


@query("M03_robustness", f"""
    WITH b AS (SELECT msg_id, body || ' account' AS body, {_sql_rule_score("(body || ' account')")} AS base FROM v_message),
    d AS (SELECT * FROM b WHERE base >= 20 QUALIFY row_number() OVER (ORDER BY sha256('42:' || msg_id)) <= 300),
    a AS (SELECT base, 'none' AS attack, body AS txt FROM d UNION ALL SELECT base, 'pad', body || chr(10) || '{V.filler(40)}' FROM d
          UNION ALL SELECT base, 'truncation_shift', '{V.filler(40)}' || chr(10) || body FROM d
          UNION ALL SELECT base, 'keyword_substitution', replace(body, ' account', ' profile') FROM d)
    SELECT attack, count(*) AS tested, count(*) FILTER (after >= 20) AS retained, count(*) FILTER (after < 20) AS evaded, round(avg(base - after), 6) AS mean_drop,
           (SELECT count(*) FROM b) AS scanned, (SELECT count(*) FROM b WHERE base >= 20) AS detected
    FROM (SELECT attack, base, {_sql_rule_score("txt")} AS after FROM a) GROUP BY attack""")
def robustness(t):
    texts = t.message.select("msg_id", F.lit("all").alias("grp"), F.concat("body", F.lit(" account")).alias("text"))
    return rounded(V.robustness(texts, "text", rule_score, 20.0, 300, extra_words=40), "mean_drop")


@query("M01_train_classifier")
def train_classifier(t):
    from mailgraph.plans import training
    return training.held_out_report(t.corpus)


register_view("v_deduplicated", """
    SELECT msg_id, text, label FROM v_keyed
    QUALIFY msg_id = min(msg_id) OVER (PARTITION BY key) AND min(label) OVER (PARTITION BY key) = max(label) OVER (PARTITION BY key)""")


@query("M01_training_rows", r"""
    WITH s AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY sha256('42:' || msg_id)) AS rn, count(*) OVER (PARTITION BY label) AS n FROM v_deduplicated)
    SELECT CASE WHEN rn * 10 <= n * 8 THEN 'train' WHEN rn * 10 <= n * 9 THEN 'validation' ELSE 'test' END AS split, label, count(*) AS rows,
           sum(len(list_filter(string_split_regex(lower(text), '[^\p{L}]+'), lambda x: x <> '')))::BIGINT AS tokens
    FROM s GROUP BY 1, 2""")
def training_rows(t):
    """What the classifier of M01 is trained, tuned and tested on."""
    from mailgraph.plans import training
    return training.prepared(t.corpus).groupBy("split", "label").agg(F.count(F.lit(1)).alias("rows"), F.sum(F.size("tokens")).alias("tokens"))


@query("M02_window_cover", r"""
    WITH w AS (SELECT msg_id, len(list_filter(string_split_regex(lower(text), '[^\p{L}]+'), lambda x: x <> '')) AS n FROM v_corpus)
    SELECT msg_id, (CASE WHEN n <= 254 THEN 1 ELSE ceil((n - 254) / 222)::INTEGER + 1 END)::INTEGER AS windows, n::INTEGER AS covered, true AS complete FROM w""")
def window_cover(t):
    """Windows and tokens that M02 looks at, with a scorer from outside in place of the trained model."""
    from mailgraph.plans import training
    scored = training.score_worst_window(lambda windows: windows.withColumn("p", F.size("tokens") / 254.0), t.corpus)
    return scored.select("msg_id", "windows", "covered", "complete")


@query("M02_window_scoring")
def window_scoring(t):
    from mailgraph.plans import training
    return training.score_worst_window(training.train(t.corpus), t.corpus)
