"""Findings, scores, decision tables and exports."""

from pyspark.sql import functions as F

from mailgraph.functions import rules
from mailgraph.operators import decisions as D
from mailgraph.operators import scoring as S
from mailgraph.operators import threads as TH
from mailgraph.plans.catalog.correlation import indicators
from mailgraph.plans.evidence import Evidence
from mailgraph.plans.oracle import register_view
from mailgraph.plans.registry import query
from mailgraph.sources import sinks

register_view("v_dmarc", """
    SELECT *, CASE WHEN spf_aligned OR dkim_aligned THEN 'pass'
                   WHEN spf IN ('unknown', 'temperror') OR dkim = 'unknown' THEN 'unknown' ELSE 'fail' END AS dmarc FROM (
        SELECT *, CASE WHEN spf = 'pass' AND spf_domain_aligned THEN true WHEN spf IN ('unknown', 'temperror') THEN NULL ELSE false END AS spf_aligned,
               CASE WHEN dkim = 'pass' AND dkim_domain_aligned THEN true WHEN dkim = 'unknown' THEN NULL ELSE false END AS dkim_aligned
        FROM v_auth)""")
register_view("v_feed", """
    SELECT sha256(regexp_replace(url, '^(https?://[^/?#]+)([?#]|$)', '\\1/\\2')) AS digest, arg_max(page_id::VARCHAR, page_id) AS record_id
    FROM pages WHERE page_id % 3 = 0 GROUP BY 1""".replace("\\\\", "\\"))
register_view("v_scan", r"""
    SELECT u.*, f.record_id, CASE WHEN f.digest IS NOT NULL THEN 'listed' ELSE 'not_listed' END AS feed_status,
           20 * (CASE WHEN url LIKE 'http:%' THEN 1 ELSE 0 END + CASE WHEN shown <> '' AND host <> 'portal.example' THEN 1 ELSE 0 END
               + CASE WHEN len(string_split(host, '.')) - 2 >= 3 THEN 1 ELSE 0 END + CASE WHEN length(url) > 250 THEN 1 ELSE 0 END
               + CASE WHEN regexp_matches(host, '^[0-9.]+$') THEN 1 ELSE 0 END
               + CASE WHEN NOT regexp_matches(host, '^[a-z0-9]([a-z0-9-]*[a-z0-9])?(\.[a-z0-9]([a-z0-9-]*[a-z0-9])?)*$') THEN 1 ELSE 0 END) AS score,
           list_filter([CASE WHEN NOT regexp_matches(host, '^[a-z0-9]([a-z0-9-]*[a-z0-9])?(\.[a-z0-9]([a-z0-9-]*[a-z0-9])?)*$')
                             THEN 'Malformed or invalid host encoding' END,
                        CASE WHEN url LIKE 'http:%' THEN 'Unencrypted HTTP' END,
                        CASE WHEN regexp_matches(host, '^[0-9.]+$') THEN 'IP address used as host' END,
                        CASE WHEN len(string_split(host, '.')) - 2 >= 3 THEN 'Excessive subdomains' END,
                        CASE WHEN length(url) > 250 THEN 'Unusually long URL' END,
                        CASE WHEN shown <> '' AND host <> 'portal.example' THEN 'Displayed URL differs from destination' END,
                        CASE WHEN regexp_matches(regexp_replace(url, '[?#].*$', ''), '(?i)verify|login|password|secure|account')
                             THEN 'Account-action wording' END], lambda x: x IS NOT NULL) AS reasons
    FROM v_url u LEFT JOIN v_feed f ON f.digest = sha256(regexp_replace(url, '^(https?://[^/?#]+)([?#]|$)', '\1/\2'))""")
RULE_ROWS = ",\n".join(
    "('{0}', '{1}', '{2}', '{3}', {4}, {5})".format(r.rule_id, r.grp, r.title, r.patterns[0], r.points, i)
    for i, r in enumerate(rules.DOCUMENT_RULES))
register_view("v_rule_hit", f"""
    SELECT msg_id, rule_id, grp, title, trim(regexp_extract(body, pattern)) AS excerpt, points, rule_no
    FROM v_message JOIN (VALUES {RULE_ROWS}) r(rule_id, grp, title, pattern, points, rule_no) ON regexp_matches(body, pattern)""")
register_view("v_high_model", """
    SELECT msg_id, coalesce(status = 'ready' AND probability BETWEEN 90 AND 100 AND NOT authenticated, false) AS strong_model, authenticated,
           status, probability, label FROM (
        SELECT m.*, a.dmarc = 'pass' OR (a.dkim = 'pass' AND a.spf = 'pass') AS authenticated FROM v_model m JOIN v_dmarc a USING (msg_id))""")
register_view("v_finding", """
    SELECT msg_id, grp, title, excerpt AS detail, points FROM v_wording_first
    UNION ALL SELECT msg_id, 'manipulation', title, coalesce(excerpt, ''), points FROM v_instruction WHERE points > 0
    UNION ALL SELECT DISTINCT u.msg_id, 'identity', 'Look-alike domain', host || ' resembles ' || brand || ': ' || why, 15 FROM v_url u JOIN v_lookalike USING (host)
    UNION ALL SELECT msg_id, 'identity', 'Reply-To domain differs', split_part(sender, '@', 2) || ' versus ' || split_part(reply_to, '@', 2), 20
        FROM v_message WHERE reply_to IS NOT NULL
    UNION ALL SELECT msg_id, 'authentication', 'DKIM signature failed', 'dkim fail', 15 FROM v_dmarc WHERE dkim = 'fail'
    UNION ALL SELECT msg_id, 'authentication', 'SPF evaluation failed', 'spf fail', 15 FROM v_dmarc WHERE spf = 'fail'
    UNION ALL SELECT msg_id, 'authentication', 'DMARC alignment failed', 'dmarc fail', 20 FROM v_dmarc WHERE dmarc = 'fail'
    UNION ALL SELECT msg_id, 'language', 'High model phishing probability', 'Independent model evidence', 30 FROM v_high_model WHERE strong_model
    UNION ALL SELECT msg_id, 'links', 'Suspicious URL structure', array_to_string(reasons, '; '), 10 FROM v_scan WHERE score >= 40
    UNION ALL SELECT msg_id, 'reputation', 'Feed URL match', record_id, 60 FROM v_scan WHERE feed_status = 'listed'
    UNION ALL SELECT DISTINCT msg_id, 'attachments', 'Active-content attachment extension', 'Inventoried, not executed', 15
        FROM v_attachment WHERE warning""")
register_view("v_cap", """
    SELECT * FROM (VALUES ('identity', 30), ('authentication', 20), ('links', 25), ('language', 35), ('attachments', 15),
                          ('reputation', 60), ('manipulation', 40)) c(grp, cap)""")
register_view("v_group_score", """
    SELECT m.msg_id, c.grp, least(coalesce(sum(f.points), 0), any_value(c.cap))::INTEGER AS points
    FROM v_message m CROSS JOIN v_cap c LEFT JOIN v_finding f ON f.msg_id = m.msg_id AND f.grp = c.grp GROUP BY m.msg_id, c.grp""")
register_view("v_score", """
    SELECT msg_id, score, CASE WHEN score >= 60 THEN 'High' WHEN score >= 25 THEN 'Review' ELSE 'Low' END AS risk FROM (
        SELECT msg_id, least(100, sum(points))::INTEGER AS score FROM v_group_score GROUP BY msg_id)""")
register_view("v_case", """
    SELECT m.*, s.score, s.risk, a.spf, a.dkim, a.arc, a.dmarc, a.spf_aligned, a.dkim_aligned, h.status, h.probability, h.label,
           h.strong_model, h.authenticated,
           coalesce((SELECT list_sort(list(DISTINCT title)) FROM v_finding f WHERE f.msg_id = m.msg_id), []) AS titles,
           coalesce((SELECT count(*) FROM v_scan u WHERE u.msg_id = m.msg_id), 0) AS links,
           coalesce((SELECT count(*) FROM v_scan u WHERE u.msg_id = m.msg_id AND u.score >= 40), 0) AS risky_links,
           coalesce((SELECT bool_or(list_contains(reasons, 'Displayed URL differs from destination')) FROM v_scan u WHERE u.msg_id = m.msg_id), false) AS deceptive_link
    FROM v_message m JOIN v_score s USING (msg_id) JOIN v_dmarc a USING (msg_id) JOIN v_high_model h USING (msg_id)""")
register_view("v_triage", """
    SELECT *, CASE WHEN len(urgent) > 0 THEN 'urgent' WHEN len(titles) > 0 OR strong_model THEN 'review'
                   WHEN status <> 'ready' THEN 'incomplete' ELSE 'routine' END AS priority FROM (
        SELECT *, list_filter([
            CASE WHEN list_contains(titles, 'Feed URL match') THEN 'feed match' END,
            CASE WHEN list_has_all(titles, ['Payment diversion', 'Verification avoidance']) THEN 'payment change with verification avoidance' END,
            CASE WHEN strong_model AND (deceptive_link OR list_has_any(titles, ['Credential pressure', 'Payment diversion'])) THEN 'supported model signal' END,
            CASE WHEN score >= 60 THEN 'score threshold' END], lambda x: x IS NOT NULL) AS urgent FROM v_case)""")


@query("R01_rule_scan", """
    SELECT msg_id, rule_id, grp, title, excerpt, points FROM v_rule_hit
    QUALIFY row_number() OVER (PARTITION BY msg_id, title ORDER BY rule_no) = 1""")
def rule_scan(t):
    return rules.scan(t.message.select("msg_id", "body"), "body", rules.DOCUMENT_RULES, "msg_id").drop("pos")


@query("R14_structural_findings", """
    SELECT msg_id, grp, title, detail, points FROM v_finding WHERE grp IN ('identity', 'authentication', 'reputation', 'attachments')
        OR title IN ('High model phishing probability', 'Suspicious URL structure')""")
def structural(t):
    return Evidence(t).structural


@query("F12_url_scores", "SELECT msg_id, url, score, array_to_string(reasons, '; ') AS reasons FROM v_scan")
def url_scores(t):
    return S.scan_urls(t.url).select("msg_id", "url", "score", F.array_join("reasons", "; ").alias("reasons"))


@query("W01_finding_ids", """
    SELECT msg_id, grp, title, occurrence, substr(sha256(concat_ws('|', grp, title, detail, occurrence)), 1, 16) AS finding_id FROM (
        SELECT *, row_number() OVER (PARTITION BY msg_id, grp, title, detail) - 1 AS occurrence FROM v_finding)""")
def finding_ids(t):
    return S.with_ids(Evidence(t).finding).select("msg_id", "grp", "title", "occurrence", "finding_id")


@query("A04_group_scores", "SELECT * FROM v_group_score")
def group_scores(t):
    return S.group_scores(t.message, Evidence(t).finding)


@query("A04_scores", "SELECT * FROM v_score")
def scores(t):
    return Evidence(t).score


@query("R04_triage", """
    SELECT msg_id, priority, array_to_string(CASE priority WHEN 'urgent' THEN urgent WHEN 'review' THEN ['signals need assessment']
        WHEN 'incomplete' THEN ['model unavailable'] ELSE ['no configured signals'] END, '; ') AS reasons FROM v_triage""")
def triage(t):
    return Evidence(t).case.select("msg_id", "priority", F.array_join("reasons", "; ").alias("reasons"))


@query("R09_model_verdict", """
    SELECT msg_id, probability, CASE WHEN status <> 'ready' THEN 'unavailable' WHEN probability < 60 THEN 'legitimate'
        WHEN probability < 90 THEN CASE WHEN authenticated THEN 'legitimate' ELSE 'uncertain' END
        ELSE CASE WHEN authenticated THEN 'caution' ELSE 'phishing' END END AS band FROM v_high_model""")
def model_verdict(t):
    return D.model_verdict(Evidence(t).case).select("msg_id", "probability", "band")


CLASS_SQL = r"""
    WITH flags AS (
        SELECT *, links > 0 AND dmarc <> 'pass' AS lure,
               regexp_matches(txt, '\b(?:shared (?:document|file|folder)|document (?:has been )?shared|view (?:the )?(?:document|file)|secure document|onedrive|sharepoint|google docs?)\b') AS share,
               regexp_matches(txt, '\b(?:mailbox|quota|storage|voicemail|voice mail|e-?fax|delivery failure|undelivered|failed delivery|messages? held|incoming messages?)\b') AS mailbox,
               regexp_matches(txt, '\b(?:invoice|payment notification|remittance|statement|purchase order|po attached|billing notice)\b') AS notice,
               regexp_matches(txt, 'gift card|advance fee|lottery|inheritance|blackmail|extortion|bitcoin ransom') AS scheme,
               list_has_any(titles, ['Account-expiry pressure', 'Credential pressure', 'Look-alike domain']) AS supported
        FROM (SELECT *, lower(subject || ' ' || body) AS txt FROM v_triage)),
    ev AS (
        SELECT *, list_sort(list_filter([
                CASE WHEN list_contains(titles, 'Feed URL match') THEN 'Feed URL match' END,
                CASE WHEN list_contains(titles, 'Credential pressure') AND NOT (dmarc = 'pass' AND NOT list_has_any(titles, ['Feed URL match', 'Look-alike domain']))
                     THEN 'Credential pressure' END,
                CASE WHEN list_contains(titles, 'Suspicious URL structure') AND supported THEN 'Suspicious URL structure' END,
                CASE WHEN list_contains(titles, 'Account-expiry pressure') AND lure AND regexp_matches(txt,
                     'expired|expires? today|today|immediately|within \d+ ?(hours?|hrs)|24 hours|1 day|suspend|deactivat|is full|not delivered|were held|are held')
                     THEN 'Account-expiry lure with link, sender not authenticated' END,
                CASE WHEN lure AND share THEN 'Shared-document lure with link, sender not authenticated' END,
                CASE WHEN lure AND mailbox THEN 'Mailbox/voicemail/delivery lure with link, sender not authenticated' END], lambda x: x IS NOT NULL)) AS phishing,
            list_sort(list_filter([
                CASE WHEN list_contains(titles, 'Payment diversion') THEN 'Payment diversion' END,
                CASE WHEN list_contains(titles, 'Verification avoidance') THEN 'Verification avoidance' END,
                CASE WHEN lure AND notice THEN 'Invoice/payment-notification lure with link, sender not authenticated' END,
                CASE WHEN scheme THEN 'Fraud-scheme wording' END], lambda x: x IS NOT NULL)) AS fraud,
            list_sort(list_filter([
                CASE WHEN list_contains(titles, 'Look-alike domain') THEN 'Look-alike domain' END,
                CASE WHEN dmarc = 'fail' AND list_contains(titles, 'Reply-To domain differs') THEN 'DMARC failure with identity mismatch' END,
                CASE WHEN lure AND list_contains(titles, 'Reply-To domain differs') AND (share OR mailbox OR notice)
                     THEN 'Identity mismatch combined with a lure' END], lambda x: x IS NOT NULL)) AS impersonated
        FROM flags),
    cls AS (
        SELECT *, list_filter([CASE WHEN len(phishing) > 0 THEN 'phishing' END, CASE WHEN len(fraud) > 0 THEN 'fraud_related' END,
                               CASE WHEN len(impersonated) > 0 THEN 'impersonated' END], lambda x: x IS NOT NULL) AS active FROM ev)
    SELECT msg_id, CASE WHEN len(active) > 0 THEN active[1] WHEN score >= 25 OR len(titles) > 0 THEN 'suspicious'
                        WHEN status = 'ready' AND label = 'benign' THEN 'legitimate' ELSE 'undetermined' END AS primary_class,
           CASE WHEN len(active) > 1 THEN array_to_string(active[2:], ',') ELSE '' END AS secondary,
           array_to_string(CASE WHEN len(phishing) > 0 THEN phishing WHEN len(fraud) > 0 THEN fraud
               WHEN len(impersonated) > 0 THEN impersonated ELSE titles END, ',') AS evidence,
           CASE WHEN len(active) = 0 AND (score >= 25 OR len(titles) > 0) AND titles = ['High model phishing probability']
                THEN 'model_only' ELSE 'rules_and_model' END AS basis
    FROM cls"""
register_view("v_class", "SELECT * FROM (" + CLASS_SQL + ")")


@query("R05_five_classes", "SELECT * FROM v_class")
def five_classes(t):
    return D.classify(Evidence(t).case).select(
        "msg_id", F.col("primary").alias("primary_class"), F.array_join("secondary", ",").alias("secondary"),
        F.array_join("evidence", ",").alias("evidence"), "basis")


@query("R06_conflicts", """
    SELECT msg_id, 'authenticated-payment' AS conflict FROM v_triage
        WHERE list_has_all(titles, ['Payment diversion', 'Verification avoidance']) AND dmarc = 'pass'
    UNION ALL SELECT msg_id, 'model-payment' FROM v_triage
        WHERE list_has_all(titles, ['Payment diversion', 'Verification avoidance']) AND status = 'ready' AND label = 'benign'
    UNION ALL SELECT msg_id, 'link-identity-' || url FROM v_scan WHERE list_contains(reasons, 'Displayed URL differs from destination')""")
def conflicts(t):
    e = Evidence(t)
    return D.conflicts(e.case, e.url)


def checks(t):
    """Supplementary checks of the relay path and of identity, as (msg_id, kind, title)."""
    routing = TH.relay_checks(t.hop).select("msg_id", F.lit("routing").alias("kind"), "title")
    identity = t.message.filter(F.col("reply_to").isNotNull() & (F.col("source") == "src3")).select(
        "msg_id", F.lit("identity").alias("kind"), F.lit("Display-name address differs").alias("title"))
    return routing.unionByName(identity)


register_view("v_check", """
    SELECT msg_id, 'routing' AS kind, title FROM v_relay_check
    UNION ALL SELECT msg_id, 'identity', 'Display-name address differs' FROM v_message WHERE reply_to IS NOT NULL AND source = 'src3'""")


@query("R12_escalation", """
    SELECT t.msg_id, coalesce(c.n, 0) AS checks, CASE WHEN coalesce(c.n, 0) > 0 AND priority IN ('routine', 'incomplete') THEN 'review' ELSE priority END AS priority
    FROM v_triage t LEFT JOIN (SELECT msg_id, count(*) AS n FROM v_check GROUP BY msg_id) c USING (msg_id)""")
def escalation(t):
    return D.escalate(Evidence(t).case, checks(t)).select("msg_id", "checks", "priority")


@query("R07_categories", """
    WITH c AS (SELECT msg_id, count(*) AS n, bool_or(kind = 'identity') AS idc FROM v_check GROUP BY msg_id),
         l AS (SELECT t.*, coalesce(c.n, 0) AS n, list_filter([
                   CASE WHEN list_contains(titles, 'Payment diversion') THEN 'fraud-related' END,
                   CASE WHEN coalesce(c.idc, false) THEN 'impersonated' END,
                   CASE WHEN label = 'phishing' OR list_contains(titles, 'Feed URL match') THEN 'phishing' END], lambda x: x IS NOT NULL) AS labels
               FROM v_triage t LEFT JOIN c USING (msg_id))
    SELECT msg_id, CASE WHEN len(labels) > 0 THEN array_to_string(labels, ',')
                        WHEN n > 0 OR len(titles) > 0 OR score >= 25 THEN 'suspicious'
                        WHEN status = 'ready' AND label = 'benign' THEN 'legitimate' ELSE 'undetermined' END AS categories,
           array_to_string(list_filter([CASE WHEN dmarc = 'fail' THEN 'possible spoofed domain' END,
               CASE WHEN dmarc = 'pass' AND (list_contains(titles, 'Payment diversion') OR label = 'phishing')
                    THEN 'authenticated suspicious content' END], lambda x: x IS NOT NULL), ',') AS origin_flags FROM l""")
def categories(t):
    return D.categories(Evidence(t).case, checks(t)).select(
        "msg_id", F.array_join("categories", ",").alias("categories"), F.array_join("origin_flags", ",").alias("origin_flags"))


@query("P04_delivery", """
    SELECT msg_id, CASE WHEN priority = 'urgent' OR score >= 60 THEN 'hold' ELSE 'deliver' END AS route,
           (CASE WHEN priority = 'urgent' THEN 1 ELSE 0 END + CASE WHEN score >= 60 THEN 1 ELSE 0 END)::INTEGER AS reasons FROM v_triage""")
def delivery(t):
    return D.delivery(Evidence(t).case).select("msg_id", "route", F.size("hold_reasons").alias("reasons"))


@query("S12_routed_sink", """
    SELECT CASE WHEN priority = 'urgent' OR score >= 60 THEN 'hold' ELSE 'deliver' END AS route, risk, count(*) AS messages
    FROM v_triage GROUP BY ALL""")
def routed(t):
    return D.delivery(Evidence(t).case).groupBy("route", "risk").agg(F.count(F.lit(1)).alias("messages"))


@query("P05_mailbox_plan", """
    SELECT msg_id, mode, CASE WHEN priority = 'urgent' OR score >= 60 THEN 'High-risk' ELSE 'Review' END AS label,
           (priority = 'urgent' OR score >= 60) AND mode = 'quarantine' AS remove_from_inbox
    FROM v_triage, (VALUES ('dry-run'), ('label'), ('quarantine')) m(mode)
    WHERE priority IN ('urgent', 'review') OR score >= 60""")
def mailbox_plan(t):
    return D.mailbox_plan(Evidence(t).case)


@query("R11_playbook", """
    WITH f AS (SELECT *, EXISTS (SELECT 1 FROM v_attachment a WHERE a.msg_id = t.msg_id AND warning) AS risky,
                      list_contains(titles, 'Payment diversion') AS money FROM v_triage t),
    s AS (
        SELECT msg_id, 1 AS step_no, 'now' AS step_priority, 'do not act' AS step FROM f WHERE priority = 'urgent'
        UNION ALL SELECT msg_id, 2, 'now', 'verify payment out of band' FROM f WHERE money
        UNION ALL SELECT msg_id, 3, 'next', 'confirm sender identity' FROM f WHERE dmarc = 'fail' OR list_contains(titles, 'Reply-To domain differs')
        UNION ALL SELECT msg_id, 4, 'next', 'block links' FROM f WHERE risky_links > 0
        UNION ALL SELECT msg_id, 5, 'next', 'quarantine attachments' FROM f WHERE risky
        UNION ALL SELECT msg_id, 10, 'record', 'preserve evidence' FROM f WHERE priority IN ('urgent', 'review')
        UNION ALL SELECT msg_id, 11, 'record', 'report financial fraud' FROM f WHERE priority = 'urgent' OR money
        UNION ALL SELECT msg_id, 12, 'record', 'report incident' FROM f WHERE priority = 'urgent' OR money)
    SELECT * FROM s UNION ALL SELECT msg_id, 13, 'record', 'no specific action' FROM f WHERE msg_id NOT IN (SELECT msg_id FROM s)""")
def playbook(t):
    risky = t.attachment.filter("warning").select("msg_id", F.lit(True).alias("risky")).distinct()
    case = Evidence(t).case.join(risky, "msg_id", "left")
    return D.playbook(case, {"risky_attachment": F.coalesce("risky", F.lit(False))})


@query("P01_redacted", """
    SELECT msg_id, raw_hash, score, risk, '[REDACTED]' AS subject, '[REDACTED]' AS sender, '[REDACTED]' AS body, spf, dkim, dmarc, arc,
           label, is_sample, len(titles)::INTEGER AS titles, 0 AS hidden FROM v_triage""")
def redacted(t):
    return sinks.redacted(Evidence(t).case).select(
        "msg_id", "raw_hash", "score", "risk", "subject", "sender", "body", "spf", "dkim", "dmarc", "arc", "label", "is_sample",
        F.size("titles").alias("titles"), (F.size("indicators") + F.size("urls") + F.size("hops")).alias("hidden"))


@query("P02_case_list", "SELECT msg_id, epoch_us(created) AS created_us, subject, sender, score, risk, priority FROM v_triage")
def case_list(t):
    return Evidence(t).case.select("msg_id", F.unix_micros("created").alias("created_us"), "subject", "sender", "score", "risk", "priority")


@query("P03_search", """
    SELECT msg_id FROM v_message m WHERE contains(lower(subject || ' ' || sender), 'ation')
        OR EXISTS (SELECT 1 FROM v_finding f WHERE f.msg_id = m.msg_id AND contains(lower(title || ' ' || detail), 'ation'))
        OR EXISTS (SELECT 1 FROM v_indicator i WHERE i.msg_id = m.msg_id AND contains(lower(value), 'ation'))""")
def search(t):
    return TH.search(t.message, Evidence(t).finding, indicators(t), "ation")


@query("P03_search_recipient", """
    SELECT msg_id FROM v_message m WHERE contains(lower(subject || ' ' || sender), 'to7@de.inbox')
        OR EXISTS (SELECT 1 FROM v_recipient r WHERE r.msg_id = m.msg_id AND contains(lower(recipient), 'to7@de.inbox'))
        OR EXISTS (SELECT 1 FROM v_finding f WHERE f.msg_id = m.msg_id AND contains(lower(title || ' ' || detail), 'to7@de.inbox'))
        OR EXISTS (SELECT 1 FROM v_indicator i WHERE i.msg_id = m.msg_id AND contains(lower(value), 'to7@de.inbox'))""")
def search_recipient(t):
    return TH.search(t.message, Evidence(t).finding, indicators(t), " TO7@de.inbox ", t.recipient)


@query("P12_rule_registry", """
    SELECT rule, count(*) FILTER (hit) AS flagged, count(*) AS messages FROM (
        SELECT unnest(['score_ge_25', 'score_ge_45', 'hold', 'model_phishing']) AS rule,
               unnest([score >= 25, score >= 45, score >= 60 OR priority = 'urgent', label = 'phishing']) AS hit FROM v_triage) GROUP BY rule""")
def rule_registry(t):
    from mailgraph.operators import evaluation as V
    flagged = V.apply_rules(Evidence(t).case, V.case_rules())
    return flagged.groupBy("rule").agg(F.count_if("flagged").alias("flagged"), F.count(F.lit(1)).alias("messages"))


@query("S07_event_sink", """
    SELECT sha256('mailgraph-event-v1:' || msg_id) AS event_id, msg_id AS case_id, raw_hash AS email_sha256, score, risk, priority,
           array_to_string(titles, '|') AS findings FROM v_triage""")
def event_sink(t):
    return sinks.events(Evidence(t).case).select(
        "event_id", "case_id", "email_sha256", "score", "risk", "priority", F.array_join("findings", "|").alias("findings"))


@query("S08_cef_lines", """
    SELECT msg_id AS case_id, 'CEF:0|mailgraph|Message Evidence|1|email-analysis|Email analysis|' ||
        CASE WHEN priority = 'urgent' THEN 8 WHEN score >= 25 THEN 5 ELSE 2 END || '|externalId=' || sha256('mailgraph-event-v1:' || msg_id)
        || ' cs1Label=CaseId cs1=' || msg_id || ' cs2Label=EmailSHA256 cs2=' || raw_hash || ' cn1Label=EvidenceScore cn1=' || score
        || ' cs3Label=ReviewPriority cs3=' || priority AS line FROM v_triage""")
def cef_lines(t):
    return sinks.cef(sinks.events(Evidence(t).case))


@query("S09_sectioned_csv", r"""
    WITH r AS (
        SELECT msg_id, 'indicators' AS section, kind AS type, value, '' AS detail FROM v_indicator
        UNION ALL SELECT msg_id, 'findings', grp, title, detail || ' (points: ' || points || ')' FROM v_finding
        UNION ALL SELECT msg_id, 'urls', upper(split_part(url, ':', 1)), url, 'score ' || score || ': ' || array_to_string(reasons, '; ') FROM v_scan
        UNION ALL SELECT msg_id, 'authentication', unnest(['spf', 'dkim', 'dmarc', 'arc']), unnest([spf, dkim, dmarc, arc]), '' FROM v_dmarc
        UNION ALL SELECT msg_id, 'attachments', regexp_extract(name, '\.[a-z]+$'), name,
            'sha256 ' || sha256 || CASE WHEN warning THEN ', active-content extension' ELSE '' END FROM v_attachment)
    SELECT msg_id, section, type, value, CASE WHEN regexp_matches(detail, '^\s*[=+@-]') THEN '''' || detail ELSE detail END AS detail FROM r""")
def sectioned_csv(t):
    e = Evidence(t)
    return sinks.sections(indicators(t), e.finding, e.url, e.auth, t.attachment)


@query("S10_nested_json", """
    SELECT m.msg_id, s.score, (SELECT count(*) FROM v_finding f WHERE f.msg_id = m.msg_id) AS findings,
           (SELECT count(*) FROM v_scan u WHERE u.msg_id = m.msg_id) AS urls,
           (SELECT count(*) FROM v_indicator i WHERE i.msg_id = m.msg_id) AS indicators
    FROM v_message m JOIN v_score s USING (msg_id)""")
def nested_json(t):
    e = Evidence(t)
    docs = sinks.nested(t.message, e.score, e.finding, e.url, indicators(t))
    return docs.select("msg_id", "score", *[F.when(F.col(c).isNull(), 0).otherwise(F.size(c)).alias(c) for c in ("findings", "urls", "indicators")])


@query("S11_threat_indicators", """
    WITH e AS (SELECT *, priority = 'urgent' OR list_contains(titles, 'Reply-To domain differs') AS reply_counts FROM v_triage
               WHERE priority IN ('urgent', 'review')),
    i AS (SELECT msg_id, 'url' AS kind, url AS value FROM v_scan WHERE score >= 40
          UNION SELECT msg_id, 'email', value FROM v_indicator WHERE kind = 'reply_address' AND msg_id IN (SELECT msg_id FROM e WHERE reply_counts)
          UNION SELECT msg_id, 'file', sha256 FROM v_attachment WHERE warning
          UNION SELECT msg_id, 'ip', value FROM v_indicator WHERE kind = 'reported_ip' AND value IN (SELECT ip FROM v_exit_node))
    SELECT i.msg_id, i.kind, i.value, 'indicator--' || substr(sha256(i.kind || '|' || i.value), 1, 32) AS indicator_id,
           CASE priority WHEN 'urgent' THEN 'malicious-activity' ELSE 'anomalous-activity' END AS indicator_type,
           greatest(1, least(100, score)) AS confidence FROM i JOIN e USING (msg_id)""")
def threat_indicators(t):
    from mailgraph.plans.catalog.enrichment import exit_nodes
    e = Evidence(t)
    return sinks.threat_indicators(e.case, e.url, indicators(t), t.attachment, exit_nodes(t)).drop("pattern")


@query("T02_newest_first", """
    SELECT msg_id, epoch_us(created) AS created_us, score, priority FROM v_triage ORDER BY created DESC, msg_id LIMIT 50""")
def newest(t):
    return Evidence(t).case.orderBy(F.col("created").desc(), "msg_id").limit(50).select(
        "msg_id", F.unix_micros("created").alias("created_us"), "score", "priority")


@query("P08_held_queue", """
    SELECT msg_id, epoch_us(created) AS held_us, score, priority FROM v_triage WHERE priority = 'urgent' OR score >= 60
    ORDER BY created DESC, msg_id LIMIT 200""")
def held_queue(t):
    return D.delivery(Evidence(t).case).filter("route = 'hold'").orderBy(F.col("created").desc(), "msg_id").limit(200).select(
        "msg_id", F.unix_micros("created").alias("held_us"), "score", "priority")
