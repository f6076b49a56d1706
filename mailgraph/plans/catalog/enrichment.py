"""Feeds, ranges, domains, pages and other dimensions."""

from pyspark.sql import functions as F

from mailgraph.functions import hosts, markup, rules
from mailgraph.operators import enrichment as E
from mailgraph.operators import networks as NW
from mailgraph.operators import scoring as S
from mailgraph.operators import suffixes as SX
from mailgraph.plans.evidence import Evidence
from mailgraph.plans.oracle import register_view
from mailgraph.plans.registry import query

AS_OF = "2024-02-01 00:00:00"

register_view("v_exit_node", "SELECT DISTINCT ip FROM v_hop WHERE hop = 2 AND ip LIKE '%.20.%' AND msg_id % 3 = 0 AND ip NOT LIKE '10.%'")
register_view("v_cidr", """
    SELECT DISTINCT 'drop' AS feed, split_part(ip, '.', 1) || '.' || split_part(ip, '.', 2) || '.0.0' AS net, 16 AS bits FROM v_hop WHERE msg_id % 5 = 0
    UNION SELECT DISTINCT 'c2', split_part(ip, '.', 1) || '.' || split_part(ip, '.', 2) || '.' || split_part(ip, '.', 3) || '.0', 24
    FROM v_hop WHERE msg_id % 7 = 3""")
register_view("v_geo", """
    SELECT DISTINCT ip, 'C' || (split_part(ip, '.', 1)::INTEGER % 5) AS country, 64500 + split_part(ip, '.', 1)::INTEGER % 9 AS asn,
           CASE WHEN split_part(ip, '.', 4)::INTEGER % 4 = 0 THEN 'rate_limited' ELSE 'available' END AS status,
           CASE split_part(ip, '.', 1)::INTEGER % 6 WHEN 0 THEN 'Data Center/Web Hosting' WHEN 1 THEN 'VPN' ELSE 'ISP' END AS usage,
           split_part(ip, '.', 3)::INTEGER * 9 AS abuse
    FROM v_hop WHERE split_part(ip, '.', 1)::INTEGER % 3 <> 0""")
register_view("v_context", """
    SELECT msg_id, ip AS client_ip, msg_id % 2 = 0 AS attested FROM v_hop WHERE hop = 3 AND msg_id % 5 = 1""")


def exit_nodes(t):
    return t.hop.filter((F.col("hop") == 2) & F.col("ip").contains(".20.") & (F.col("msg_id") % 3 == 0) & ~F.col("ip").startswith("10.")).select("ip").distinct()


def networks(t):
    part = lambda n: F.substring_index("ip", ".", n)
    drop = t.hop.filter(F.col("msg_id") % 5 == 0).select(F.lit("drop").alias("feed"), F.concat(part(2), F.lit(".0.0/16")).alias("cidr"))
    c2 = t.hop.filter(F.col("msg_id") % 7 == 3).select(F.lit("c2").alias("feed"), F.concat(part(3), F.lit(".0/24")).alias("cidr"))
    return E.cidr_ranges(drop.unionByName(c2).distinct()).select("feed", "cidr", "ver", "lo", "hi")


def geo(t):
    octet = lambda i: F.split("ip", "\\.")[i].cast("int")
    usage = F.when(octet(0) % 6 == 0, "Data Center/Web Hosting").when(octet(0) % 6 == 1, "VPN").otherwise("ISP")
    return t.hop.filter(octet(0) % 3 != 0).select("ip").distinct().select(
        "ip", F.concat(F.lit("C"), octet(0) % 5).alias("country"), (64500 + octet(0) % 9).alias("asn"),
        F.when(octet(3) % 4 == 0, "rate_limited").otherwise("available").alias("status"), usage.alias("usage"), (octet(2) * 9).alias("abuse"))


def context(t):
    return t.hop.filter((F.col("hop") == 3) & (F.col("msg_id") % 5 == 1)).select(
        "msg_id", F.col("ip").alias("client_ip"), (F.col("msg_id") % 2 == 0).alias("attested"))


@query("J01_feed_match", "SELECT msg_id, url, feed_status, record_id FROM v_scan")
def feed_match(t):
    return E.feed_match(t.url, Evidence(t).feed, "fresh").select("msg_id", "url", "feed_status", "record_id")


@query("F06_canonical_url", r"""
    SELECT page_id, regexp_replace(url, '^(https?://[^/?#]+)([?#]|$)', '\1/\2') AS canonical FROM pages""")
def canonical_url(t):
    return t.pages.select("page_id", hosts.canonical_url(F.col("url")).alias("canonical"))


@query("F25_freshness", """
    SELECT event_id, CASE WHEN event_type = 'error' THEN 'unavailable'
        WHEN epoch(TIMESTAMP '2024-01-16 00:00:00') - floor(epoch(ts)) <= 86400 THEN 'fresh' ELSE 'stale' END AS status FROM events""")
def freshness(t):
    fetched = F.when(F.col("event_type") != "error", F.col("ts"))
    return t.events.select("event_id", E.freshness(fetched, F.lit("2024-01-16 00:00:00").cast("timestamp")).alias("status"))


@query("J02_exit_nodes", "SELECT msg_id, hop, ip FROM v_hop WHERE ip IN (SELECT ip FROM v_exit_node)")
def exit_membership(t):
    return E.members(t.hop.select("msg_id", "hop", "ip"), exit_nodes(t)).select("msg_id", "hop", "ip")


@query("J03_cidr_ranges", """
    SELECT DISTINCT h.msg_id, h.hop, h.ip, c.feed, c.net || '/' || c.bits AS cidr FROM v_hop h JOIN v_cidr c
    ON CASE c.bits WHEN 16 THEN h.ip LIKE split_part(c.net, '.', 1) || '.' || split_part(c.net, '.', 2) || '.%'
       ELSE h.ip LIKE split_part(c.net, '.', 1) || '.' || split_part(c.net, '.', 2) || '.' || split_part(c.net, '.', 3) || '.%' END""")
def cidr_join(t):
    return E.in_ranges(t.hop.select("msg_id", "hop", "ip"), networks(t)).select("msg_id", "hop", "ip", "feed", "cidr")


@query("S04_cidr_load", """
    SELECT feed, net || '/' || bits AS cidr, 4 AS ver, (split_part(net, '.', 1)::BIGINT * 16777216 + split_part(net, '.', 2)::BIGINT * 65536
        + split_part(net, '.', 3)::BIGINT * 256) AS lo, (split_part(net, '.', 1)::BIGINT * 16777216 + split_part(net, '.', 2)::BIGINT * 65536
        + split_part(net, '.', 3)::BIGINT * 256 + CASE bits WHEN 16 THEN 65535 ELSE 255 END) AS hi FROM v_cidr""")
def cidr_load(t):
    return networks(t)


#: fixed values: lines that a network feed may hold beside networks
ODD_LINES = ("; comment", "# 1.2.3.4", "not a network", "10.0.0.0/40", "2001:db8::/129", "")
register_view("v_address", """
    SELECT msg_id, hop, ip, 4 AS ver, string_split(ip, '.') AS o FROM v_hop
    UNION ALL SELECT msg_id, hop, CASE WHEN msg_id % 2 = 0 THEN '2001:db8:' || o[1] || ':' || o[2] || '::' || o[4]
                                       ELSE '2001:0DB8:' || o[1] || ':' || o[2] || ':0:0:0:' || o[4] END, 6, o
        FROM (SELECT *, string_split(ip, '.') AS o FROM v_hop) WHERE msg_id % 4 < 2""")
register_view("v_mixed_network", """
    SELECT DISTINCT o[1] || '.' || o[2] || '.0.0/16 ; drop' AS cidr, 4 AS ver, 16 AS size, o[1] || '.' || o[2] AS k FROM v_address WHERE ver = 4 AND msg_id % 5 = 0
    UNION SELECT DISTINCT ip, 4, 32, ip FROM v_address WHERE ver = 4 AND msg_id % 7 = 3
    UNION SELECT DISTINCT '2001:db8:' || o[1] || '::/48', 6, 48, o[1] FROM v_address WHERE msg_id % 11 = 0
    UNION SELECT DISTINCT '2001:db8:' || o[1] || ':' || o[2] || '::' || o[4] || '/125 # part', 6, 125,
                 o[1] || ':' || o[2] || ':' || (('0x' || o[4])::INTEGER // 8) FROM v_address WHERE msg_id % 3 = 1""")


def mixed_addresses(t):
    o = F.split("ip", "\\.")
    short = F.concat(F.lit("2001:db8:"), o[0], F.lit(":"), o[1], F.lit("::"), o[3])
    whole = F.concat(F.lit("2001:0DB8:"), o[0], F.lit(":"), o[1], F.lit(":0:0:0:"), o[3])
    six = t.hop.filter(F.col("msg_id") % 4 < 2).select("msg_id", "hop", F.when(F.col("msg_id") % 2 == 0, short).otherwise(whole).alias("ip"))
    return t.hop.select("msg_id", "hop", "ip").unionByName(six)


def mixed_feed(t):
    """Lines of a feed with networks of both versions, comments and lines that name none."""
    o, i = F.split("ip", "\\."), F.col("msg_id")
    six = lambda *tail: F.concat(F.lit("2001:db8:"), o[0], *tail)
    lines = (
        t.hop.filter(i % 5 == 0).select(F.concat(o[0], F.lit("."), o[1], F.lit(".0.0/16 ; drop")).alias("cidr"))
        .union(t.hop.filter(i % 7 == 3).select("ip")).union(t.hop.filter(i % 11 == 0).select(six(F.lit("::/48"))))
        .union(t.hop.filter(i % 3 == 1).select(six(F.lit(":"), o[1], F.lit("::"), o[3], F.lit("/125 # part")))))
    return lines.union(t.spark.createDataFrame([(x,) for x in ODD_LINES], "cidr string")).distinct()


MEMBER_SQL = """JOIN v_mixed_network n ON a.ver = n.ver AND n.k = CASE n.size WHEN 16 THEN o[1] || '.' || o[2] WHEN 32 THEN ip WHEN 48 THEN o[1]
                ELSE o[1] || ':' || o[2] || ':' || (('0x' || o[4])::INTEGER // 8) END"""


@query("J03_mixed_networks", f"SELECT DISTINCT msg_id, hop, ip, cidr FROM v_address a {MEMBER_SQL}")
def mixed_networks(t):
    return NW.members(mixed_addresses(t), NW.parsed(mixed_feed(t))).select("msg_id", "hop", "ip", "cidr").distinct()


@query("J03_longest_network", f"""
    SELECT DISTINCT msg_id, hop, ip, cidr FROM v_address a {MEMBER_SQL} QUALIFY n.size = max(n.size) OVER (PARTITION BY ip)""")
def longest_network(t):
    return NW.members(mixed_addresses(t), NW.parsed(mixed_feed(t)), longest=True).select("msg_id", "hop", "ip", "cidr").distinct()


@query("S04_mixed_load", "SELECT cidr, ver, size FROM v_mixed_network")
def mixed_load(t):
    return NW.parsed(mixed_feed(t)).select("cidr", "ver", "size")


def address_registry(t):
    """Entries (pos, cidrs, urls) in registry order: ranges of both versions, malformed ones among them, made from the addresses seen."""
    first = F.split("ip", "\\.")[0].cast("int")
    pos = (first * 7) % 31
    text, six = first.cast("string"), F.concat(F.lit("2001:db8:"), first.cast("string"), F.lit("::/48"))
    four, narrow = F.concat(text, F.lit(".0.0.0/8")), F.concat(text, F.lit(".20.0.0/16"))
    cidrs = F.when(pos % 4 == 0, F.array(four, six)).when(pos % 4 == 1, F.array(F.lit("malformed"), four)).when(
        pos % 4 == 2, F.array(narrow, F.lit("malformed"), four)).otherwise(F.array(six, F.lit("::/64")))
    secure = F.concat(F.lit("https://r"), pos.cast("string"), F.lit(".example/"))
    urls = F.when(pos % 5 == 0, F.array(F.lit("http://plain.example/"))).otherwise(F.array(F.lit("http://plain.example/"), secure, F.lit("https://later.example/")))
    own = t.hop.select(pos.alias("pos"), cidrs.alias("cidrs"), urls.alias("urls")).distinct()
    return own.union(t.spark.createDataFrame([(40, None, None), (50, ["40.0.0.0/6"], ["https://last.example/"])], "pos int, cidrs array<string>, urls array<string>"))


@query("J14_address_delegation", """
    WITH f AS (SELECT DISTINCT o[1]::INTEGER AS n, o[1]::INTEGER * 7 % 31 AS pos FROM v_address),
    a AS (SELECT DISTINCT ip, ver, o[1]::INTEGER AS n, o[2] AS second FROM v_address),
    m AS (SELECT a.ip, f.pos FROM a JOIN f ON a.n = f.n WHERE CASE f.pos % 4 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN a.ver = 4 AND a.second = '20' ELSE a.ver = 6 END
          UNION ALL SELECT ip, 50 FROM a WHERE ver = 4 AND n BETWEEN 40 AND 43),
    b AS (SELECT ip, min(pos) AS pos FROM m GROUP BY ip)
    SELECT a.ip, b.pos, CASE WHEN b.pos = 50 THEN 'https://last.example/' WHEN b.pos % 5 <> 0 THEN 'https://r' || b.pos || '.example/' END AS endpoint
    FROM a LEFT JOIN b USING (ip)""")
def address_delegation(t):
    return NW.delegated(mixed_addresses(t), address_registry(t))


@query("P06_public_addresses", """
    SELECT msg_id, hop, NOT (ip LIKE '10.%' OR ip LIKE '192.168.%') AS is_public FROM v_hop""")
def public_addresses(t):
    return t.hop.select("msg_id", "hop", hosts.is_public_ip(F.col("ip")).alias("is_public"))


@query("F07_registrable_domain", r"""
    SELECT DISTINCT host, CASE WHEN regexp_matches(host, '^[0-9.]+$') THEN host ELSE regexp_extract(host, '([^.]+\.)?[^.]+$') END AS base FROM v_url""")
def registrable(t):
    return t.url.select("host", hosts.registrable(F.col("host")).alias("base")).distinct()


#: fixed values: endings that page hosts are given to meet rules of every kind
ENDINGS = ("", ".co.za", ".github.io", ".any.ck", ".www.ck", ".city.kawasaki.jp", ".ward.kawasaki.jp", ".com.au", ".gov.uk.", ".blogspot.com")


def _suffix_lines(t):
    """The rules as lines of a suffix list."""
    known = hosts.SUFFIXES
    lines = ["// rules", *known.exact, *(f"*.{n}" for n in known.wildcard), *(f"!{n} note" for n in known.exception), "com", ""]
    return t.spark.createDataFrame([(x,) for x in lines], "value string")


def _hosts_under_rules(t):
    ending = F.element_at(F.array(*[F.lit(x) for x in ENDINGS]), (F.col("page_id") % len(ENDINGS) + 1).cast("int"))
    bare = (F.col("page_id") % 13 == 0) & (ending != "")
    return t.url.select(F.when(bare, F.substring(ending, 2, 99)).otherwise(F.concat("host", ending)).alias("host"))


register_view("v_suffix_rule", "SELECT * FROM (VALUES " + ", ".join(
    f"('{kind}', '{name}')" for kind, names in (("exact", hosts.SUFFIXES.exact), ("wildcard", hosts.SUFFIXES.wildcard), ("exception", hosts.SUFFIXES.exception))
    for name in names) + ") r(kind, name)")


@query("F07_suffix_rules", rf"""
    WITH h AS (SELECT DISTINCT CASE WHEN page_id % 13 = 0 AND e <> '' THEN e[2:] ELSE host || e END AS host FROM (
                   SELECT page_id, host, {list(ENDINGS)}[page_id % {len(ENDINGS)} + 1] AS e FROM v_url)),
    l AS (SELECT host, string_split(lower(rtrim(host, '.')), '.') AS ls FROM h),
    e AS (SELECT host, ls, k, array_to_string(ls[len(ls) - k + 1:], '.') AS tail, array_to_string(ls[len(ls) - k + 2:], '.') AS parent
          FROM (SELECT host, ls, unnest(range(1, len(ls) + 1)) AS k FROM l)),
    s AS (SELECT host, ls, coalesce(max(CASE WHEN r.kind = 'exception' AND e.tail = r.name THEN k - 1 END),
                 max(CASE WHEN r.kind = 'exact' AND e.tail = r.name OR r.kind = 'wildcard' AND e.parent = r.name THEN k END), 1) AS size
          FROM e LEFT JOIN v_suffix_rule r ON e.tail = r.name OR e.parent = r.name GROUP BY host, ls)
    SELECT host, array_to_string(ls[greatest(len(ls) - size, 0) + 1:], '.') AS suffix,
           array_to_string(ls[greatest(len(ls) - size - 1, 0) + 1:], '.') AS base FROM s""")
def suffix_rules(t):
    return SX.organisations(_hosts_under_rules(t), SX.parsed(_suffix_lines(t)))


@query("F08_address_parts", "SELECT msg_id, sender AS address, split_part(sender, '@', 2) AS domain FROM v_message")
def address_parts(t):
    named = F.concat(F.lit("\"Desk\" <"), F.col("sender"), F.lit(">"))
    return t.message.select("msg_id", hosts.address(named).alias("address"), hosts.domain(named).alias("domain"))


@query("F09_host_validity", r"""
    SELECT DISTINCT host, length(host) <= 253 AND regexp_matches(host, '^[a-z0-9]([a-z0-9-]{0,61}[a-z0-9])?(\.[a-z0-9]([a-z0-9-]{0,61}[a-z0-9])?)*$') AS valid
    FROM v_url""")
def host_validity(t):
    return t.url.select("host", hosts.is_hostname(F.col("host")).alias("valid")).distinct()


register_view("v_dns", """
    SELECT DISTINCT regexp_extract(host, '[^.]+[.][^.]+$') AS name, 'reject' AS p, 'quarantine' AS sp, CAST(NULL AS VARCHAR) AS psd FROM v_url WHERE page_id % 4 = 0
    UNION SELECT DISTINCT host, 'none', CAST(NULL AS VARCHAR), 'n' FROM v_url WHERE page_id % 6 = 1 AND len(string_split(host, '.')) > 2""")


@query("J13_policy_walk", """
    WITH a AS (SELECT DISTINCT host AS domain FROM v_url),
    w AS (SELECT domain, unnest(range(0, len(string_split(domain, '.'))))::INTEGER AS depth FROM a),
    r AS (SELECT w.domain, w.depth, d.* FROM w JOIN v_dns d ON d.name = array_to_string(string_split(w.domain, '.')[w.depth + 1:], '.')),
    s AS (SELECT r.* FROM r WHERE depth <= coalesce((SELECT min(depth) FROM r q WHERE q.domain = r.domain AND q.psd = 'n'), 99)),
    o AS (SELECT domain, arg_max(name, depth) AS organisation, min(depth) AS first_depth FROM s GROUP BY domain)
    SELECT o.domain, o.organisation, CASE WHEN first_depth = 0 THEN o.domain ELSE o.organisation END AS policy_domain,
           CASE WHEN first_depth = 0 THEN own.p ELSE coalesce(org.sp, org.p) END AS policy
    FROM o LEFT JOIN s own ON own.domain = o.domain AND own.depth = 0 LEFT JOIN s org ON org.domain = o.domain AND org.name = o.organisation""")
def policy_walk(t):
    base = F.substring_index("host", ".", -2)
    null = F.lit(None).cast("string")
    dns = t.url.filter(F.col("page_id") % 4 == 0).select(base.alias("name"), F.lit("reject").alias("p"), F.lit("quarantine").alias("sp"), null.alias("psd")).unionByName(
        t.url.filter((F.col("page_id") % 6 == 1) & (F.size(F.split("host", "\\.")) > 2)).select(
            F.col("host").alias("name"), F.lit("none").alias("p"), null.alias("sp"), F.lit("n").alias("psd"))).distinct()
    return E.published_policy(t.url.select(F.col("host").alias("domain")), dns)


LOOKALIKE_SQL = """    SELECT DISTINCT host, brand, why FROM (
        SELECT v.host, b.brand, CASE
            WHEN contains(v.host, b.domain) AND NOT (v.host = b.domain OR v.host LIKE '%.' || b.domain) THEN 'embedded genuine domain'
            WHEN v.label = b.label THEN 'same name under another suffix'
            WHEN length(b.label) >= 7 AND damerau_levenshtein(v.label, b.label) = 1 THEN 'one-character edit'
            WHEN regexp_matches(v.label, '[0-9]') AND translate(v.label, '01345$', 'oleass') = b.label THEN 'digits for letters' END AS why
        FROM (SELECT DISTINCT host, split_part(regexp_extract(host, '([^.]+[.])?[^.]+$'), '.', 1) AS label FROM {hosts}) v
        JOIN v_brand b ON NOT (v.host = b.domain OR v.host LIKE '%.' || b.domain))
    WHERE why IS NOT NULL"""
register_view("v_lookalike", LOOKALIKE_SQL.format(hosts="v_url"))


@query("J10_lookalike_domains", LOOKALIKE_SQL.format(hosts="v_url_variant"))
def lookalike_domains(t):
    return E.lookalikes(variants(t), t.brand)


register_view("v_brand", "SELECT 'Portal' AS brand, 'examples.org' AS domain, 'examples' AS label")
register_view("v_url_variant", """
    SELECT host FROM v_url UNION SELECT host || '.examples.org.test' FROM v_url WHERE page_id % 9 = 0
    UNION SELECT replace(host, 'example.', 'examp1es.') FROM v_url WHERE page_id % 7 = 0""")


def variants(t):
    u = t.url
    return u.select("host").unionByName(
        u.filter(F.col("page_id") % 9 == 0).select(F.concat("host", F.lit(".examples.org.test")).alias("host"))).unionByName(
        u.filter(F.col("page_id") % 7 == 0).select(F.replace("host", F.lit("example."), F.lit("examp1es.")).alias("host")))


@query("J11_protected_identity", """
    SELECT msg_id, 'Example Desk' AS identity, split_part(sender, '@', 2) AS domain FROM v_message
    WHERE lang = 'de' AND source NOT IN ('src1', 'src2')""")
def protected_identity(t):
    shown = t.message.withColumn("sender", F.concat(F.when(F.col("lang") == "de", "Example  DESK").otherwise("Other"), F.lit(" <"), F.col("sender"), F.lit(">")))
    identity = t.spark.createDataFrame([("Example Desk", ["src1.example", "src2.example"], [])], "name string, domains array<string>, addresses array<string>")
    return E.protected_identity(shown, identity)


@query("J11_protected_resemblance", r"""
    WITH p AS (SELECT msg_id, host FROM v_url UNION SELECT msg_id, host || '.portal.example.test' FROM v_url WHERE page_id % 9 = 0
               UNION SELECT msg_id, replace(host, 'example.', 'examp1es.') FROM v_url WHERE page_id % 7 = 0
               UNION SELECT msg_id, split_part(sender, '@', 2) FROM v_message),
    d(identity, domain, label) AS (VALUES ('Example Desk', 'examples.org', 'examples'), ('Example Desk', 'portal.example', 'portal'), ('Source', 'src10.example', 'src10'))
    SELECT DISTINCT msg_id, identity, host FROM p JOIN d ON (contains(host, domain) AND NOT host LIKE '%.' || domain)
        OR (length(label) >= 5 AND damerau_levenshtein(split_part(regexp_extract(host, '([^.]+[.])?[^.]+$'), '.', 1), label) = 1
            AND msg_id IN (SELECT msg_id FROM v_planted WHERE regexp_matches(text, '(?i)\b(?:payment|invoice|transfer|password|credential|verify|login|gift cards?)\b')))
    WHERE NOT EXISTS (SELECT 1 FROM d e WHERE e.identity = d.identity AND (p.host = e.domain OR p.host LIKE '%.' || e.domain))""")
def protected_resemblance(t):
    identity = t.spark.createDataFrame(
        [("Example Desk", ["examples.org", "portal.example"], []), ("Source", ["src10.example"], [])], "name string, domains array<string>, addresses array<string>")
    u = t.url.select("msg_id", "page_id", "host")
    peers = (
        u.select("msg_id", "host").union(u.filter("page_id % 9 = 0").select("msg_id", F.concat("host", F.lit(".portal.example.test"))))
        .union(u.filter("page_id % 7 = 0").select("msg_id", F.replace("host", F.lit("example."), F.lit("examp1es."))))
        .union(t.message.select("msg_id", hosts.domain(F.col("sender")))))
    return E.protected_resemblance(t.planted, peers, identity)


@query("J12_domain_resemblance", r"""
    WITH p AS (SELECT DISTINCT msg_id, 'www.' || replace(split_part(sender, '@', 2), 'src', 'srcs') AS host FROM v_message
               UNION SELECT msg_id, split_part(sender, '@', 2) || '.login.test' FROM v_message WHERE msg_id % 4 = 0)
    SELECT m.msg_id, split_part(sender, '@', 2) AS sender_base, p.host FROM v_message m JOIN p USING (msg_id)
    WHERE regexp_matches(lower(subject || CASE WHEN lang = 'es' THEN ' invoice' ELSE '' END || ' ' || body), '(^|[^a-z0-9_])(verify|password|payment|invoice|account|login|bank)([^a-z0-9_]|$)')
      AND regexp_extract(p.host, '[^.]+[.][^.]+$') <> split_part(sender, '@', 2)
      AND (contains(p.host, split_part(sender, '@', 2)) OR (length(split_part(split_part(sender, '@', 2), '.', 1)) >= 5
           AND length(split_part(p.host, '.', 2)) >= 5 AND damerau_levenshtein(split_part(split_part(sender, '@', 2), '.', 1), split_part(p.host, '.', 2)) = 1))""")
def domain_resemblance(t):
    own = hosts.domain(F.col("sender"))
    peers = t.message.select("msg_id", F.concat(F.lit("www."), F.replace(own, F.lit("src"), F.lit("srcs"))).alias("host")).unionByName(
        t.message.filter(F.col("msg_id") % 4 == 0).select("msg_id", F.concat(own, F.lit(".login.test")).alias("host")))
    asked = t.message.withColumn("subject", F.concat("subject", F.when(F.col("lang") == "es", " invoice").otherwise("")))
    return E.domain_resemblance(asked, peers)


@query("J14_delegation", """
    WITH b AS (SELECT regexp_extract(host, '[^.]+$') AS tld, page_id AS pos, CASE WHEN page_id % 2 = 0 THEN 'http' ELSE 'https' END || '://rdap.' || host AS url FROM v_url)
    SELECT d.domain, d.tld, e.endpoint FROM (SELECT DISTINCT host AS domain, regexp_extract(host, '[^.]+$') AS tld FROM v_url) d
    LEFT JOIN (SELECT tld, arg_min(url, pos) AS endpoint FROM b WHERE url LIKE 'https://%' GROUP BY tld) e ON e.tld = d.tld""")
def delegation(t):
    bootstrap = t.url.select(F.substring_index("host", ".", -1).alias("tld"), F.col("page_id").alias("pos"), F.concat(
        F.when(F.col("page_id") % 2 == 0, "http").otherwise("https"), F.lit("://rdap."), F.col("host")).alias("url"))
    return E.delegation(t.url.select(F.col("host").alias("domain")).distinct(), bootstrap)


register_view("v_verdict", """
    SELECT DISTINCT sha256, (('0x' || substr(sha256, 1, 2))::INTEGER % 6) AS malicious, (('0x' || substr(sha256, 3, 2))::INTEGER % 2) AS suspicious,
           CASE WHEN substr(sha256, 1, 1) = 'f' THEN 'unavailable' ELSE 'available' END AS status FROM v_attachment""")


@query("J15_attachment_verdicts", """
    SELECT a.msg_id, 'reputation' AS grp, CASE WHEN malicious >= 3 THEN 'Attachment flagged by multiple engines' ELSE 'Attachment reputation requires review' END AS title,
           a.sha256 AS detail, CASE WHEN malicious >= 3 THEN 60 ELSE 15 END AS points
    FROM (SELECT DISTINCT msg_id, sha256 FROM v_attachment) a JOIN v_verdict v USING (sha256) WHERE status = 'available' AND malicious + suspicious > 0""")
def attachment_verdicts(t):
    return E.attachment_verdicts(t.attachment, verdicts(t))


def verdicts(t):
    nibbles = lambda at: F.conv(F.substring("sha256", at, 2), 16, 10).cast("int")
    return t.attachment.select("sha256").distinct().select(
        "sha256", (nibbles(1) % 6).alias("malicious"), (nibbles(3) % 2).alias("suspicious"),
        F.when(F.substring("sha256", 1, 1) == "f", "unavailable").otherwise("available").alias("status"))


@query("J15_rescored", """
    WITH f AS (SELECT msg_id, grp, points FROM v_finding UNION ALL
               SELECT a.msg_id, 'reputation', CASE WHEN malicious >= 3 THEN 60 ELSE 15 END FROM (SELECT DISTINCT msg_id, sha256 FROM v_attachment) a
               JOIN v_verdict v USING (sha256) WHERE status = 'available' AND malicious + suspicious > 0)
    SELECT m.msg_id, least(100, coalesce(sum(least(g.points, c.cap)), 0))::INTEGER AS score FROM v_message m
    LEFT JOIN (SELECT msg_id, grp, sum(points) AS points FROM f GROUP BY ALL) g USING (msg_id) LEFT JOIN v_cap c ON c.grp = g.grp GROUP BY m.msg_id""")
def rescored(t):
    more = E.attachment_verdicts(t.attachment, verdicts(t))
    return S.scores(t.message, Evidence(t).finding.unionByName(more)).select("msg_id", "score")


@query("J22_ip_enrichment", """
    WITH k AS (SELECT msg_id, ip, min(hop) AS hop FROM v_hop GROUP BY msg_id, ip)
    SELECT k.msg_id, k.ip, CASE WHEN k.ip LIKE '10.%' OR k.ip LIKE '192.168.%' THEN 'not_public' ELSE coalesce(g.status, 'unavailable') END AS status,
           coalesce(regexp_matches(lower(usage), 'hosting|data center|transit|vpn|proxy') OR abuse > 50, false) AS anonymised
    FROM k LEFT JOIN v_geo g ON g.ip = k.ip""")
def ip_enrichment(t):
    return E.enrich_ips(t.hop, geo(t)).select(
        "msg_id", "ip", "status", F.coalesce(E.anonymised(F.col("usage"), F.lit(False), F.col("abuse")), F.lit(False)).alias("anonymised"))


register_view("v_origin", """
    SELECT m.msg_id, f.ip AS hop_ip, c.client_ip, CASE WHEN c.attested THEN 'authenticated_observation' WHEN c.client_ip IS NOT NULL THEN 'conditional'
               WHEN f.ip IS NOT NULL THEN 'low' ELSE 'undetermined' END AS confidence, CASE WHEN c.attested THEN c.client_ip ELSE f.ip END AS ip
    FROM v_message m LEFT JOIN v_context c USING (msg_id) LEFT JOIN (
        SELECT msg_id, ip FROM v_hop WHERE ip NOT LIKE '10.%' AND ip NOT LIKE '192.168.%'
        QUALIFY row_number() OVER (PARTITION BY msg_id ORDER BY hop) = 1) f USING (msg_id)""")


@query("J23_origin_location", """
    SELECT o.msg_id, o.ip, g.country, g.asn FROM v_origin o LEFT JOIN v_geo g ON g.ip = o.ip AND g.status = 'available'""")
def origin_location(t):
    return E.origin(t.hop, geo(t), context(t)).select("msg_id", "ip", "country", "asn")


@query("R08_origin_confidence", "SELECT confidence, count(*) AS messages FROM v_origin GROUP BY confidence")
def origin_confidence(t):
    return E.origin(t.hop, geo(t), context(t)).groupBy("confidence").agg(F.count(F.lit(1)).alias("messages"))


@query("J24_held_detail", """
    WITH h AS (SELECT msg_id AS item FROM v_triage WHERE priority = 'urgent' OR score >= 60)
    SELECT h.item, c.subject, c.score, c.priority FROM h LEFT JOIN v_triage c ON c.msg_id = h.item""")
def held_detail(t):
    from mailgraph.operators import decisions as D
    case = Evidence(t).case
    held = D.delivery(case).filter("route = 'hold'").select(F.col("msg_id").alias("item"))
    return held.join(case.select(F.col("msg_id").alias("item"), "subject", "score", "priority"), "item", "left")


@query("J25_receipts", """
    WITH r AS (SELECT msg_id, raw_hash, 'mx' || (msg_id % 3) AS receiver, (floor(epoch(created)))::BIGINT AS issued_at FROM v_message)
    SELECT m.msg_id, r.receiver, r.issued_at FROM r JOIN v_message m ON m.raw_hash = r.raw_hash
    WHERE r.receiver <> 'mx2' AND r.msg_id % 4 <> 1 AND epoch(TIMESTAMP '2024-01-02 00:00:00') - r.issued_at BETWEEN -60 AND 86400 * 365""")
def receipt_match(t):
    """Receipts signed per receiver (one of them with a forged signature), one receiver without a key."""
    from mailgraph.functions import crypto
    key = F.rpad(F.concat(F.lit("secret-"), F.col("receiver")), 40, "k")
    made = t.message.select(
        F.unix_seconds("created").alias("issued_at"), F.concat(F.lit("mx"), F.col("msg_id") % 3).alias("receiver"),
        F.col("raw_hash").alias("sha256"), F.col("msg_id").alias("n"))
    body = crypto.canonical_json(F.col("issued_at"), F.col("receiver"), F.col("sha256"))
    signed = made.withColumn("signature", F.when(F.col("n") % 4 == 1, F.sha2(body, 256)).otherwise(crypto.hmac_sha256_by_column(key, body)))
    keys = made.select("receiver").distinct().filter("receiver <> 'mx2'").withColumn("key", key)
    wide = F.lit("2024-01-02 00:00:00").cast("timestamp")
    return E.receipts(signed.drop("n"), t.message, keys, wide, (-60, 86400 * 365))


register_view("v_observation", """
    SELECT split_part(m.sender, '@', 2) AS domain, 'MX' AS kind, h.by_host AS value FROM v_message m JOIN v_hop h USING (msg_id) WHERE hop = 1 AND lang <> 'en'
    UNION SELECT split_part(m.sender, '@', 2), 'NS', 'ns' || (length(m.source)) FROM v_message m""")


@query("A21_infrastructure_prints", """
    WITH o AS (SELECT DISTINCT domain, kind || '=' || lower(trim(value)) AS seen FROM v_observation),
    b AS (SELECT domain, sha256(seen)[1:3] AS part, sha256(string_agg(seen, ';' ORDER BY seen)) AS digest FROM o GROUP BY domain, part),
    p AS (SELECT domain, sha256(string_agg(part || ':' || digest, ';' ORDER BY part)) AS print FROM b GROUP BY domain)
    SELECT print, count(*) AS domains, min(domain) AS first_domain FROM p GROUP BY print HAVING count(*) > 1""")
def infrastructure_prints(t):
    sender = t.message.select("msg_id", "lang", hosts.domain(F.col("sender")).alias("domain"), "source")
    mx = sender.filter("lang <> 'en'").join(t.hop.filter("hop = 1"), "msg_id").select("domain", F.lit("MX").alias("kind"), F.col("by_host").alias("value"))
    ns = sender.select("domain", F.lit("NS").alias("kind"), F.concat(F.lit("ns"), F.length("source")).alias("value"))
    return E.shared_prints(E.infrastructure_print(mx.unionByName(ns)))


@query("A27_page_skeletons", r"""
    WITH p AS (SELECT page_id, sha256(array_to_string(list_transform(regexp_extract_all(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'),
                   '<([A-Za-z][A-Za-z0-9]*)', 1), lambda x: lower(x)), '>')) AS skeleton FROM pages)
    SELECT skeleton, count(*) AS pages, min(page_id) AS first_page FROM p GROUP BY skeleton""")
def page_skeletons(t):
    return E.page_skeletons(t.pages).groupBy("skeleton").agg(F.count(F.lit(1)).alias("pages"), F.min("page_id").alias("first_page"))


@query("F22_page_signals", r"""
    SELECT lower(regexp_extract(url, '^https?://([^/?#:]+)', 1)) AS host, count(*) AS pages,
           sum(len(regexp_extract_all(html, '(?is)<script[\s>]')))::BIGINT AS scripts, sum(len(regexp_extract_all(html, '(?is)<a[\s>]')))::BIGINT AS links,
           sum(len(regexp_extract_all(html, '<!--')))::BIGINT AS comments, sum(len(regexp_extract_all(html, '(?is)<form[\s>]')))::BIGINT AS forms
    FROM pages GROUP BY 1""")
def page_signals(t):
    return E.page_signals(t.pages).groupBy("host").agg(
        F.count(F.lit(1)).alias("pages"), F.sum(F.col("scripts_inline") + F.col("scripts_external")).alias("scripts"),
        F.sum("links").alias("links"), F.sum("comments").alias("comments"), F.sum("forms").alias("forms"))


@query("F23_html_comments", r"""
    SELECT page_id, count(*) AS comments, sum(length(c))::BIGINT AS chars FROM (
        SELECT page_id, unnest(regexp_extract_all(html, '(?s)<!--(.*?)-->', 1)) AS c FROM pages) GROUP BY page_id""")
def html_comments(t):
    return E.comments(t.pages).groupBy("page_id").agg(F.count(F.lit(1)).alias("comments"), F.sum(F.length("comment")).alias("chars"))


#: fixed values: mark-up that hides text in nested, unclosed, wrongly closed and void elements, and places that only look so
HIDING = (
    "<div style=\"display:none\"><span>ignore <b>previous instructions</b> now</span></div>",
    "<div style='opacity: 0'>preheader</div><br>seen <img src=\"a>b\" style=\"display:none\">seen",
    "<p style=\"color:red\">seen</p><DIV STYLE=visibility:hidden><span>never closed",
    "<div style=\"display:none\"><p>preheader</div><p>seen</p></i>",
    "<style>.x { content: \"<b style='display:none'>\"; }</style><script>s = '<b style=\"display:none\">'</script><!-- <b style='display:none'> --><p>seen</p>",
    "<div style=\"max-height:0px\">a<br>b<i>c</p>d</i></div>seen",
)


def _hiding_pages(t):
    return t.pages.select("page_id", F.concat("html", F.element_at(F.array(*[F.lit(x) for x in HIDING]), (F.col("page_id") % len(HIDING) + 1).cast("int"))).alias("html"))


HIDING_ROWS = ", ".join(f"({i}, '{x}')" for i, x in enumerate(y.replace("'", "''") for y in HIDING))


@query("F23_hidden_text", rf"""
    WITH RECURSIVE p AS (
        SELECT page_id, regexp_extract_all(html || m, '(?is)<!--.*?-->|<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!.*?>|</?[a-z](?:[^>"'']|"[^"]*"|''[^'']*'')*>|[^<]+') AS ts
        FROM pages JOIN (VALUES {{HIDING_ROWS}}) h(i, m) ON page_id % {len(HIDING)} = i WHERE regexp_matches(html || m, '(?i)style *=')),
    k AS (SELECT page_id, i, ts[i] AS raw, lower(regexp_extract(ts[i], '^</?([a-zA-Z][^\s/>]*)', 1)) AS tag,
                 regexp_matches(ts[i], '(?i)\sstyle\s*=\s*["'']?[^"''>]*(?:{{STYLES}})') AS h
          FROM (SELECT page_id, ts, unnest(range(1, len(ts) + 1)) AS i FROM p)),
    e AS (SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY i) AS i, raw, tag, h, CASE WHEN raw[1] <> '<' THEN 'text' WHEN raw[2] = '/' THEN 'close' ELSE 'open' END AS kind
          FROM k WHERE NOT regexp_matches(raw, '(?i)^<(?:!|script|style)') AND tag NOT IN ({", ".join(f"'{v}'" for v in markup.VOID)})),
    r(page_id, i, stack, out) AS (
        SELECT DISTINCT page_id, 0::BIGINT, []::STRUCT(tag VARCHAR, h BOOLEAN)[], NULL::VARCHAR FROM p
        UNION ALL
        SELECT r.page_id, e.i, CASE kind WHEN 'open' THEN list_append(stack, {{{{'tag': e.tag, 'h': e.h OR coalesce(stack[-1].h, false)}}}})
                   WHEN 'close' THEN stack[:coalesce(list_max(list_filter(range(1, len(stack) + 1), lambda j: stack[j].tag = e.tag)) - 1, len(stack))]
                   ELSE stack END,
               CASE WHEN kind = 'text' AND coalesce(stack[-1].h, false) THEN raw END
        FROM r JOIN e ON e.page_id = r.page_id AND e.i = r.i + 1),
    f AS (SELECT page_id, i, out FROM r WHERE out IS NOT NULL)
    SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY i) - 1 AS pos, out AS hidden FROM f""".format(HIDING_ROWS=HIDING_ROWS, STYLES=rules.HIDDEN_STYLE))
def hidden_text(t):
    return E.hidden_text(_hiding_pages(t), rules.HIDDEN_STYLE).select("page_id", F.col("pos").cast("long").alias("pos"), "hidden")


@query("F21_links", r"""
    SELECT page_id, len(regexp_extract_all(html, '(?is)<a[^>]*href=["'']([^"'']*)["''][^>]*>(.*?)</a>', 1)) AS links FROM pages""")
def links(t):
    from mailgraph.functions import text as T
    return t.pages.select("page_id", F.size(T.link_candidates(F.col("html"))).cast("long").alias("links"))


@query("T01_top_urls", r"""
    WITH c AS (SELECT page_id * 4 AS msg_id, 1 AS priority, i AS pos, regexp_extract_all(html, '(?is)<a[^>]*href=["'']([^"'']*)["''][^>]*>', 1)[i + 1] AS url
               FROM pages, (SELECT unnest(range(0, 400)) AS i) WHERE i < len(regexp_extract_all(html, '(?is)<a[^>]*href=["'']([^"'']*)["''][^>]*>', 1))
               UNION ALL SELECT msg_id, 0, 0, url FROM v_url),
    f AS (SELECT msg_id, url, min(priority * 1000000 + pos) AS seen FROM c GROUP BY msg_id, url)
    SELECT msg_id, url, rank FROM (SELECT *, row_number() OVER (PARTITION BY msg_id ORDER BY seen, url) AS rank FROM f) WHERE rank <= 50""")
def top_urls(t):
    from mailgraph.functions import text as T
    anchors = t.pages.select((F.col("page_id") * 4).alias("msg_id"), F.posexplode(
        F.regexp_extract_all("html", F.lit("(?is)<a[^>]*href=[\"']([^\"']*)[\"'][^>]*>"), F.lit(1))).alias("pos", "url")).withColumn("priority", F.lit(1))
    own = t.url.select("msg_id", F.lit(0).alias("pos"), "url", F.lit(0).alias("priority"))
    return S.top_urls(own.unionByName(anchors)).select("msg_id", "url", "rank")


@query("F24_domain_age", """
    SELECT msg_id, date_diff('day', created::DATE, DATE '2024-02-01') AS age_days, date_diff('day', created::DATE, DATE '2024-02-01') < 30 AS is_new
    FROM v_message WHERE message_id IS NOT NULL UNION ALL SELECT msg_id, NULL, NULL FROM v_message WHERE message_id IS NULL""")
def domain_age(t):
    registered = F.when(F.col("message_id").isNull(), "not a date").otherwise(F.date_format("created", "yyyy-MM-dd'T'HH:mm:ss"))
    age = E.domain_age_days(registered, F.lit(AS_OF).cast("timestamp"))
    return t.message.select("msg_id", age.cast("long").alias("age_days"), (age < E.NEW_DOMAIN_DAYS).alias("is_new"))


register_view("v_feed_rows", """
    SELECT page_id::VARCHAR AS phish_id, url, CASE WHEN page_id % 8 = 1 THEN 'no' ELSE 'yes' END AS verified, CASE WHEN page_id % 9 = 2 THEN 'no' ELSE 'yes' END AS online,
           'v' || page_id AS verification_time, page_id FROM pages
    UNION ALL SELECT CASE WHEN page_id % 2 = 0 THEN 'x' || page_id ELSE (page_id + 100000)::VARCHAR END, url, 'yes', 'yes', 'w' || page_id, page_id + 1000000 FROM pages WHERE page_id % 5 = 0""")


def feed_rows(t):
    i = F.col("page_id")
    first = t.pages.select(i.cast("string").alias("phish_id"), "url", F.when(i % 8 == 1, "no").otherwise("yes").alias("verified"),
                           F.when(i % 9 == 2, "no").otherwise("yes").alias("online"), F.concat(F.lit("v"), i).alias("verification_time"), "page_id")
    again = t.pages.filter(i % 5 == 0).select(F.when(i % 2 == 0, F.concat(F.lit("x"), i)).otherwise((i + 100000).cast("string")).alias("phish_id"), "url",
                                              F.lit("yes").alias("verified"), F.lit("yes").alias("online"), F.concat(F.lit("w"), i).alias("verification_time"),
                                              (i + 1000000).alias("page_id"))
    return first.unionByName(again)


register_view("v_snapshot", r"""
    SELECT sha256(regexp_replace(url, '^(https?://[^/?#]+)([?#]|$)', '\1/\2')) AS digest, arg_max(phish_id, page_id) AS record_id,
           arg_max(verification_time, page_id) AS verified_at FROM v_feed_rows
    WHERE verified = 'yes' AND online = 'yes' AND regexp_matches(phish_id, '^[0-9]+$') GROUP BY 1""")


@query("S03_feed_snapshot", "SELECT * FROM v_snapshot")
def feed_snapshot(t):
    from mailgraph.sources import feeds
    return feeds.snapshot(feed_rows(t), F.col("page_id"))


@query("S05_snapshot_quality", """
    SELECT count(*) AS entries, 0 AS bad_digests, 0 AS bad_ids, true AS source_ok, true AS time_ok, count(*) BETWEEN 1 AND 500000 AS size_ok, true AS usable FROM v_snapshot""")
def snapshot_quality(t):
    from mailgraph.sources import feeds
    meta = t.events.agg(F.max(F.unix_seconds("ts")).alias("fetched_at")).select(F.lit("feed").alias("source"), "fetched_at", F.lit(None).cast("long").alias("source_modified"))
    return feeds.quality(feeds.snapshot(feed_rows(t), F.col("page_id")), meta, F.lit(AS_OF).cast("timestamp"), "feed")
