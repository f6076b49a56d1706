"""DuckDB twins of the derived views, and the assembly of a check query from them."""

from __future__ import annotations

import re

VIEWS = {
    "v_message": r"""
        SELECT d.doc_id AS msg_id, e.ts AS created, e.user_id % 20 AS session_id,
               'u' || e.user_id || '@' || d.source || '.example' AS sender,
               CASE WHEN d.doc_id % 7 = 0 THEN 'r' || (e.user_id % 5) || '@desk.example' END AS reply_to,
               trim(regexp_extract(d.text, '^[^.\n]*')) AS subject, d.text AS body, sha256(d.text) AS raw_hash,
               d.doc_id % 10 = 9 AS is_sample,
               CASE WHEN d.doc_id % 5 <> 2 THEN '<m' || d.doc_id || '@x.example>' END AS message_id,
               CASE WHEN d.doc_id % 5 <> 2 AND d.doc_id % 3 <> 0 THEN '<m' || (d.doc_id - 1) || '@x.example>' END AS in_reply_to,
               d.lang, d.source, l.quality, l.toxic
        FROM documents d JOIN events e ON e.event_id = d.doc_id LEFT JOIN labels l ON l.doc_id = d.doc_id""",
    "v_recipient": r"""
        SELECT doc_id AS msg_id, 'to' || n || '@' || lang || '.Inbox.example' AS recipient FROM (
            SELECT d.doc_id, d.lang, unnest(CASE WHEN doc_id % 3 = 0 THEN [e.user_id % 50, e.user_id % 50 + 50] ELSE [e.user_id % 50] END) AS n
            FROM documents d JOIN events e ON e.event_id = d.doc_id)""",
    "v_hop": r"""
        SELECT msg_id, hop, 'mx' || ((msg_id + hop) % 6) || '.example' AS from_host,
               'mx' || ((msg_id + hop + 1 + CASE WHEN msg_id % 13 = 0 THEN hop ELSE 0 END) % 6) || '.example' AS by_host,
               CASE WHEN msg_id % 9 = 0 THEN '10.0.' || hop || '.' || (msg_id % 50)
                    WHEN msg_id % 13 = 0 THEN '192.168.1.' || (msg_id % 30)
                    ELSE (40 + msg_id % 30) || '.' || (hop * 10) || '.' || (msg_id % 12) || '.' || (1 + msg_id % 40) END AS ip,
               CASE WHEN (msg_id + hop) % 17 <> 0 THEN created + to_seconds(hop * 60 -
                    CASE WHEN hop = 3 AND msg_id % 11 = 0 THEN 600 ELSE 0 END) END AS ts
        FROM v_message, (SELECT unnest([1, 2, 3]) AS hop)""",
    "v_attachment": r"""
        SELECT doc_id AS msg_id, name, sha256(source || '/' || name) AS sha256,
               regexp_matches(name, '\.(exe|html)$') AS warning
        FROM (SELECT doc_id, source, 'file' || (doc_id % 9) ||
                     CASE doc_id % 4 WHEN 0 THEN '.pdf' WHEN 1 THEN '.exe' WHEN 2 THEN '.html' ELSE '.docx' END AS name
              FROM documents WHERE length(text) > 2000)""",
    "v_url": r"""
        SELECT page_id * 4 AS msg_id, page_id, url, lower(regexp_extract(url, '^https?://([^/?#:]+)', 1)) AS host,
               CASE WHEN page_id % 5 = 0 THEN 'https://portal.example/start' ELSE '' END AS shown
        FROM pages""",
    "v_auth": r"""
        SELECT doc_id AS msg_id,
               CASE doc_id % 7 WHEN 0 THEN 'fail' WHEN 1 THEN 'none' WHEN 2 THEN 'temperror' ELSE 'pass' END AS spf,
               CASE doc_id % 5 WHEN 0 THEN 'fail' WHEN 1 THEN 'unknown' ELSE 'pass' END AS dkim,
               CASE doc_id % 11 WHEN 0 THEN 'fail' WHEN 1 THEN 'pass' ELSE 'none' END AS arc,
               doc_id % 3 <> 1 AS spf_domain_aligned, doc_id % 4 <> 1 AS dkim_domain_aligned
        FROM documents""",
    "v_model": r"""
        SELECT doc_id AS msg_id, CASE WHEN doc_id % 19 = 0 THEN 'unavailable' ELSE 'ready' END AS status,
               (t / 10.0)::DOUBLE AS probability, CASE WHEN t >= 500 THEN 'phishing' ELSE 'benign' END AS label
        FROM (SELECT doc_id, ('0x' || substr(sha256(doc_id::VARCHAR), 1, 4))::INTEGER % 1001 AS t FROM documents)""",
    "v_audit": r"""
        SELECT *, seq || '|' || action || '|' || case_id AS payload FROM (
            SELECT event_id AS seq, user_id AS session_id, ts AS at,
                   CASE event_type WHEN 'signup' THEN 'analyze' WHEN 'view' THEN 'note' WHEN 'click' THEN 'assign'
                        WHEN 'purchase' THEN 'review' WHEN 'error' THEN 'delete' END AS action,
                   json_extract_string(props, '$.k')::INTEGER AS case_id, 'a' || (event_id % 4) AS actor
            FROM events)""",
    "v_prediction": r"""
        SELECT doc_id AS msg_id, quality AS label,
               0.6::DOUBLE * (('0x' || substr(sha256(doc_id::VARCHAR), 1, 8))::BIGINT / 4294967296.0::DOUBLE)
               + 0.4::DOUBLE * quality AS p
        FROM labels""",
    "v_corpus": r"""
        SELECT doc_id AS msg_id, text, source, lang, quality AS label FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL""",
    "v_indicator": r"""
        SELECT DISTINCT msg_id, kind, value FROM (
            SELECT msg_id, 'reply_address' AS kind, lower(reply_to) AS value FROM v_message
            UNION ALL SELECT msg_id, 'sender_address', lower(sender) FROM v_message
            UNION ALL SELECT msg_id, 'sender_domain', regexp_extract(lower(sender), '([^.@]+\.[^.@]+)$', 1) FROM v_message
            UNION ALL SELECT msg_id, 'thread_id', message_id FROM v_message
            UNION ALL SELECT msg_id, 'thread_id', in_reply_to FROM v_message
            UNION ALL SELECT msg_id, 'attachment_hash', sha256 FROM v_attachment
            UNION ALL SELECT u.msg_id, 'url', u.url FROM v_url u
            UNION ALL SELECT msg_id, 'reported_ip', ip FROM v_hop WHERE ip NOT LIKE '10.%' AND ip NOT LIKE '192.168.%'
        ) WHERE value IS NOT NULL""",
}

# Views other modules add (findings, scores, decisions).
EXTRA: dict[str, str] = {}


def register_view(name: str, sql: str) -> None:
    EXTRA[name] = sql


def _needed(sql: str, known: dict[str, str], seen: list[str], inside: str = "") -> list[str]:
    for name in dict.fromkeys(re.findall(r"\bv_[a-z0-9_]+\b", sql)):
        if name in known and name not in seen and name != inside:
            _needed(known[name], known, seen, name)
            if name not in seen:
                seen.append(name)
    return seen


def assemble(sql: str) -> str:
    """Prefix a check query with the views it names. The query may bring its own ``WITH`` list."""
    known = {**VIEWS, **EXTRA}
    body = sql.strip()
    views = [f"{name} AS ({known[name].strip()})" for name in _needed(body, known, [])]
    match = re.match(r"WITH\s+(RECURSIVE\s+)?", body, re.I)
    if match:
        own = body[match.end():]
        return "WITH RECURSIVE " + ",\n".join([*views, own])
    return ("WITH RECURSIVE " + ",\n".join(views) + "\n" + body) if views else body
