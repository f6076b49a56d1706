"""Joins of observed links, hosts and addresses with feeds and other dimensions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailgraph.functions import crypto, hosts, markup
from mailgraph.functions import text as T
from mailgraph.operators.decisions import listed
from mailgraph.plans import skew

DAY = 86400
BUCKET_BITS = 16
NEW_DOMAIN_DAYS = 30


def freshness(fetched: Column, as_of: Column, modified: Column | None = None, limit: int = DAY) -> Column:
    """``fresh`` up to a day after the earlier of fetch and source time, then ``stale``; ``unavailable`` without a fetch."""
    seen = F.least(fetched, F.coalesce(modified, fetched)) if modified is not None else fetched
    age = F.greatest(F.unix_seconds(as_of) - F.unix_seconds(seen), F.lit(0))
    return F.when(fetched.isNull(), "unavailable").when(age <= limit, "fresh").otherwise("stale")


def feed_match(url: DataFrame, feed: DataFrame, feed_state: str | Column) -> DataFrame:
    """Left join on the digest of the canonical link; listed / listed_stale / not_listed / the feed's own state."""
    state = F.lit(feed_state) if isinstance(feed_state, str) else feed_state
    joined = url.withColumn("digest", hosts.url_digest(F.col("url"))).join(feed, "digest", "left")
    hit = F.col("record_id").isNotNull()
    return joined.withColumn("feed_status", F.when(hit, F.when(state == "fresh", "listed").otherwise("listed_stale"))
                             .otherwise(F.when(state == "fresh", "not_listed").otherwise(state)))


def members(observed: DataFrame, listing: DataFrame, on: str = "ip") -> DataFrame:
    """Observed rows whose value is in the listing."""
    return observed.join(listing.select(on).distinct(), on, "left_semi")


def cidr_ranges(cidr: DataFrame, column: str = "cidr") -> DataFrame:
    """IPv4 networks as numeric [lo, hi]; host bits are allowed, a bare address is a /32, anything else is dropped."""
    base, bits = F.regexp_extract(column, "^([0-9.]+)", 1), F.regexp_extract(column, "/([0-9]{1,2})$", 1)
    length = F.when(~F.col(column).contains("/"), 32).otherwise(bits.cast("int"))
    size = F.pow(F.lit(2.0), 32 - length).cast("long")
    number = hosts.ipv4_number(base)
    lo = number - F.pmod(number, size)
    return cidr.filter(F.col(column).rlike("^[0-9.]+(/[0-9]{1,2})?$")).filter(number.isNotNull() & length.between(0, 32)).withColumn(
        "ver", F.lit(4)).withColumn("lo", lo).withColumn("hi", lo + size - 1)


def in_ranges(observed: DataFrame, ranges: DataFrame, ip: str = "ip", bits: int = BUCKET_BITS) -> DataFrame:
    """Addresses inside any range, as an equi-join on the leading bits plus a bounds check.

    A range wider than one bucket is listed under each bucket it covers (at most 2^bits for a /0). Distinct addresses are
    joined first, so a hot address is looked up once.
    """
    width = 1 << (32 - bits)
    distinct = observed.select(ip).distinct().withColumn("_n", hosts.ipv4_number(F.col(ip))).filter("_n IS NOT NULL")
    keyed = distinct.withColumn("_bucket", F.floor(F.col("_n") / width))
    spread = ranges.withColumn("_bucket", F.explode(F.sequence(F.floor(F.col("lo") / width), F.floor(F.col("hi") / width))))
    hits = keyed.join(spread, "_bucket").filter(F.col("_n").between(F.col("lo"), F.col("hi")))
    extra = [c for c in ranges.columns if c not in ("lo", "hi", "ver")]
    return observed.join(hits.select(ip, *extra).distinct(), ip)


def first_public(hop: DataFrame) -> DataFrame:
    """Earliest publicly routable hop per message, as one map-side combined minimum."""
    public = hop.filter(hosts.is_public_ip(F.col("ip")))
    return public.groupBy("msg_id").agg(F.min(F.struct("hop", "ip")).alias("o")).select("msg_id", "o.hop", "o.ip")


def enrich_ips(hop: DataFrame, dimension: DataFrame, per_message: int | None = None) -> DataFrame:
    """(msg_id, ip, status, ...): the distinct addresses of each message (the first ``per_message`` if given) with their dimension row."""
    first = hop.groupBy("msg_id", "ip").agg(F.min("hop").alias("hop"))
    kept = first if per_message is None else skew.top_k(first, ["msg_id"], [F.col("hop"), F.col("ip")], per_message).drop("rn")
    out = kept.join(dimension, "ip", "left")
    status = F.when(~hosts.is_public_ip(F.col("ip")), "not_public").otherwise(F.coalesce("status", F.lit("unavailable")))
    return out.withColumn("status", status)


def anonymised(usage: Column, is_exit: Column, abuse: Column) -> Column:
    return is_exit | F.lower(usage).rlike("hosting|data center|transit|vpn|proxy") | F.coalesce(abuse > 50, F.lit(False))


def origin(hop: DataFrame, geo: DataFrame, context: DataFrame) -> DataFrame:
    """Where a message entered, how much that is worth, and the location of the chosen address.

    ``context`` holds (msg_id, client_ip, attested); an attested context outranks a supplied one, which outranks the
    earliest public hop.
    """
    first = first_public(hop).select("msg_id", F.col("ip").alias("hop_ip"), "hop")
    every = hop.select("msg_id").distinct().join(first, "msg_id", "left").join(context, "msg_id", "left")
    attested = F.coalesce("attested", F.lit(False)) & F.col("client_ip").isNotNull()
    graded = every.withColumn("confidence", F.when(attested, "authenticated_observation").when(F.col("client_ip").isNotNull(), "conditional")
                              .when(F.col("hop_ip").isNotNull(), "low").otherwise("undetermined"))
    located = graded.withColumn("ip", F.when(attested, F.col("client_ip")).otherwise(F.col("hop_ip")))
    available = geo.filter(F.col("status") == "available").select("ip", "country", "asn")
    return located.join(available, "ip", "left")


# ---- domains ----------------------------------------------------------------------------------------------------

def ancestors(host: Column, most: int = 7) -> Column:
    """The host and up to ``most`` parent names, nearest first."""
    labels = F.split(host, "\\.")
    n = F.size(labels)
    starts = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | (i >= F.greatest(n - most, F.lit(1))))
    return F.transform(starts, lambda i: F.array_join(F.slice(labels, i + 1, n), "."))


def published_policy(domain: DataFrame, dns: DataFrame, column: str = "domain") -> DataFrame:
    """Nearest published policy of each distinct domain and its organisation.

    The walk goes up the name and stops at the first record that declares its place (psd y or n); the organisation is
    that record's own name (n), the name one label below it (y), or the highest record found.
    """
    names = domain.select(column).distinct().select(column, F.posexplode(ancestors(F.col(column))).alias("depth", "name"))
    found = names.join(dns, "name")
    stop = found.filter(F.col("psd").isin("y", "n")).groupBy(column).agg(F.min("depth").alias("stop"))
    walked = found.join(stop, column, "left").filter(F.col("stop").isNull() | (F.col("depth") <= F.col("stop")))
    record = F.struct("depth", "name", "p", "sp", "psd")
    per = walked.groupBy(column).agg(F.min(record).alias("near"), F.max(record).alias("far"))
    deep = F.size(F.split("far.name", "\\."))
    below = F.substring_index(F.col(column), ".", -1)
    for k in range(2, 10):
        below = F.when(deep + 1 == k, F.substring_index(F.col(column), ".", -k)).otherwise(below)
    organisation = F.when((F.col("far.psd") == "y") & (F.col("far.name") != F.col(column)), below).otherwise(F.col("far.name"))
    with_org = per.withColumn("organisation", organisation)
    exact = walked.select(column, F.col("name").alias("organisation"), F.struct("p", "sp").alias("org_tags"))
    joined = with_org.join(exact, [column, "organisation"], "left")
    own = F.col("near.depth") == 0
    tags_p = F.when(own, F.col("near.p")).otherwise(F.coalesce("org_tags.p", F.when(F.col("far.psd") == "y", F.col("far.p"))))
    tags_sp = F.when(own, F.lit(None).cast("string")).otherwise(F.coalesce("org_tags.sp", F.when(F.col("far.psd") == "y", F.col("far.sp"))))
    return joined.select(column, "organisation", F.when(own, F.col("near.name")).otherwise(F.col("organisation")).alias("policy_domain"),
                         F.coalesce(tags_sp, tags_p).alias("policy"))


#: fixed values: lure words, and digits that stand for letters
LURE = "login|secure|verify|verif|support|account|bank|pay|update|kyc|billing|alert|refund|helpdesk|service|online|customer|care"
LEET = ("01345$", "oleass")
#: characters of a name that a candidate must share at one place
GRAM = 4


def _grams(text: Column, width: int) -> Column:
    """All substrings of ``width`` characters, and the text itself when it is shorter."""
    return F.when(F.length(text) < width, F.array(text)).otherwise(
        F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(text) - width + 1), lambda i: F.substring(text, i, F.lit(width)))))


def _without_one(text: Column) -> Column:
    """The text and all forms of it with one character left out: two texts one edit apart share a form."""
    shorter = F.transform(F.sequence(F.lit(1), F.length(text)), lambda i: F.concat(
        F.substring(text, F.lit(1), i - 1), F.substring(text, i + 1, F.length(text))))
    return F.array_distinct(F.concat(F.array(text), F.when(F.length(text) > 0, shorter).otherwise(F.array().cast("array<string>"))))


def _brand_keys(brand: DataFrame) -> DataFrame:
    """(test, key, name): what a host must hold to be compared with a brand, for each kind of imitation."""
    main = F.slice("domains", 1, 2)
    labels = F.transform(main, hosts.first_label)
    start = lambda x: F.substring(x, 1, GRAM)
    long_tokens = F.filter("tokens", lambda x: F.length(x) >= 5)
    tagged = lambda test, keys: F.transform(keys, lambda k: F.struct(F.lit(test).alias("test"), k.alias("key")))
    keys = F.concat(
        tagged("part", F.transform(main, start)), tagged("label", labels),
        tagged("edit", F.flatten(F.transform(F.filter(labels, lambda x: F.length(x) >= 7), _without_one))),
        tagged("token", F.col("tokens")), tagged("inside", F.transform(long_tokens, start)))
    return brand.select("name", F.explode(F.array_distinct(keys)).alias("k")).select("name", "k.*")


def lookalikes(host: DataFrame, brand: DataFrame) -> DataFrame:
    """(host, brand, why) for hosts that imitate a brand without belonging to it.

    ``brand`` (name, domains, tokens) is a table of any size. Candidates come from equi-joins on keys that every kind of imitation must share
    (the first characters of a domain or token at some place, equal labels, forms with one character left out, equal tokens); the kinds are then
    tested exactly on each candidate.
    """
    base = host.select("host").distinct().filter(hosts.is_hostname(F.col("host"))).select(
        "host", hosts.first_label(F.col("host")).alias("label"))
    base = base.withColumn("skeleton", F.lower(T.skeleton(F.col("label"))))
    h, label, skel = F.col("host"), F.col("label"), F.col("skeleton")
    leet = F.translate(label, *LEET)
    sub_labels = F.split(F.regexp_replace(F.substring(h, F.lit(1), F.length(h) - F.length(hosts.registrable(h))), "\\.$", ""), "\\.")
    tagged = lambda test, keys: F.transform(keys, lambda k: F.struct(F.lit(test).alias("test"), k.alias("key")))
    held = F.concat(
        tagged("part", F.flatten(F.array(*[_grams(h, n) for n in range(1, GRAM + 1)]))), tagged("label", F.array(label, skel, leet)),
        tagged("edit", _without_one(label)), tagged("token", F.split(skel, "-")),
        tagged("inside", F.flatten(F.transform(F.concat(F.array(skel), sub_labels), lambda x: _grams(x, GRAM)))))
    keyed = base.select("host", F.explode(F.array_distinct(held)).alias("k")).select("host", "k.*")
    pairs = keyed.join(_brand_keys(brand), ["test", "key"]).select("host", "name").distinct().join(brand, "name").join(base, "host")
    main = F.slice("domains", 1, 2)
    genuine = F.exists("domains", lambda d: hosts.within(h, d))
    labels = F.transform(main, hosts.first_label)
    in_lure = lambda text, token: (F.length(token) >= 5) & text.contains(token) & F.replace(text, token, F.lit(" ")).rlike(LURE)
    why = (
        F.when(F.exists(main, lambda d: h.contains(d) & ~hosts.within(h, d)), "embedded genuine domain")
        .when(F.array_contains(labels, label), "same name under another suffix")
        .when(F.array_contains(labels, skel), "homoglyphs spell the name")
        .when(F.exists(labels, lambda x: (F.length(x) >= 7) & hosts.one_edit(label, x)), "one-character edit")
        .when(label.rlike("[0-9]") & F.array_contains(labels, leet), "digits for letters")
        .when(F.exists("tokens", lambda x: F.array_contains(F.split(skel, "-"), x) | in_lure(skel, x)), "name inside unrelated domain")
        .when(F.exists("tokens", lambda x: F.exists(sub_labels, lambda s: in_lure(s, x))), "name with lure words in a subdomain"))
    return pairs.filter(~genuine).select("host", F.col("name").alias("brand"), why.alias("why")).filter(F.col("why").isNotNull())


def protected_identity(message: DataFrame, identity: DataFrame) -> DataFrame:
    """Messages whose display name equals a protected name while the sender is outside its domains and addresses."""
    name = lambda c: F.trim(F.regexp_replace(F.lower(c), T.WS, " "))
    shown = message.select("msg_id", name(hosts.display_name(F.col("sender"))).alias("key"), hosts.address(F.col("sender")).alias("address"),
                           hosts.domain(F.col("sender")).alias("domain"))
    known = identity.withColumn("key", name(F.col("name")))
    allowed = F.when(F.size("addresses") > 0, F.array_contains("addresses", F.col("address"))).otherwise(
        F.exists("domains", lambda d: hosts.within(F.col("domain"), d)))
    return shown.join(known, "key").filter(~allowed).select("msg_id", F.col("name").alias("identity"), "domain")


#: fixed values: wording that asks for an action
ACTION = "(?i)\\b(?:payment|invoice|transfer|password|credential|verify|login|gift cards?)\\b"


def domain_imitations(host: DataFrame, identity: DataFrame) -> DataFrame:
    """(host, identity, domain, deceptive): distinct hosts that hold the name of a protected domain without belonging to the identity (deceptive) or whose
    label is one edit away from its label. Candidates share the first characters of the domain at some place, or a form with one character left out."""
    target = identity.select(F.col("name").alias("identity"), F.col("domains").alias("allowed"), F.explode("domains").alias("domain"))
    label = hosts.first_label(F.col("domain"))
    tagged = lambda test, keys: F.transform(keys, lambda k: F.struct(F.lit(test).alias("test"), k.alias("key")))
    asked = target.select("identity", "allowed", "domain", label.alias("target"), F.explode(F.concat(
        tagged("part", F.array(F.substring("domain", 1, GRAM))),
        tagged("edit", F.when(F.length(label) >= 5, _without_one(label)).otherwise(F.array().cast("array<string>"))))).alias("k"))
    base = host.select("host").distinct().filter("host <> ''").withColumn("label", hosts.first_label(F.col("host")))
    held = base.select("host", "label", F.explode(F.array_distinct(F.concat(
        tagged("part", F.flatten(F.array(*[_grams(F.col("host"), n) for n in range(1, GRAM + 1)]))), tagged("edit", _without_one(F.col("label")))))).alias("k"))
    pairs = held.select("host", "label", "k.*").join(asked.select("identity", "allowed", "domain", "target", "k.*"), ["test", "key"])
    deceptive = F.col("host").contains(F.col("domain")) & ~F.col("host").endswith(F.concat(F.lit("."), F.col("domain")))
    similar = (F.length("target") >= 5) & hosts.one_edit(F.col("label"), F.col("target"))
    outside = ~F.exists("allowed", lambda d: hosts.within(F.col("host"), d))
    return pairs.filter(outside & (deceptive | similar)).select("host", "identity", "domain", deceptive.alias("deceptive")).distinct()


def protected_resemblance(message: DataFrame, peer: DataFrame, identity: DataFrame) -> DataFrame:
    """(msg_id, identity, host): hosts of a message (``peer``: msg_id, host; sender and links) that imitate a protected domain. Holding its name is enough;
    a name one edit away counts only beside wording that asks for an action (``message``: msg_id, text)."""
    found = peer.distinct().join(domain_imitations(peer, identity), "host")
    named = found.filter("deceptive").select("msg_id", "identity", "host")
    asking = message.filter(F.col("text").rlike(ACTION)).select("msg_id")
    close = found.filter("NOT deceptive").join(asking, "msg_id", "left_semi").select("msg_id", "identity", "host")
    return named.unionByName(close).distinct()


SENSITIVE = "(?i)(^|[^a-z0-9_])(verify|password|payment|invoice|account|login|bank)([^a-z0-9_]|$)"


def domain_resemblance(message: DataFrame, peer: DataFrame) -> DataFrame:
    """(msg_id, sender_base, peer): a link or reply host that resembles the sender's domain in a sensitive message.

    The cheap text filter runs before the join; ``peer`` holds (msg_id, host).
    """
    base = hosts.registrable(hosts.domain(F.col("sender")))
    sensitive = message.filter(F.concat_ws(" ", "subject", "body").rlike(SENSITIVE)).select("msg_id", base.alias("sender_base"))
    joined = sensitive.join(peer.distinct(), "msg_id").withColumn("peer_base", hosts.registrable(F.col("host")))
    left, right = hosts.first_label(F.col("sender_base")), hosts.first_label(F.col("peer_base"))
    similar = F.col("host").contains(F.col("sender_base")) | ((F.length(left) >= 5) & (F.length(right) >= 5) & hosts.one_edit(left, right))
    return joined.filter((F.col("peer_base") != F.col("sender_base")) & similar).select("msg_id", "sender_base", "host")


def delegation(domain: DataFrame, bootstrap: DataFrame) -> DataFrame:
    """First https endpoint of each top-level domain in registry order; ``bootstrap`` holds (pos, tld, url)."""
    secure = bootstrap.filter(F.col("url").startswith("https://")).groupBy("tld").agg(F.min_by("url", "pos").alias("endpoint"))
    return domain.withColumn("tld", F.substring_index("domain", ".", -1)).join(secure, "tld", "left")


#: leading hex digits of an observation's digest that name its part
PART_DIGITS = 3


def infrastructure_print(observation: DataFrame) -> DataFrame:
    """(domain, print): digest of the distinct (kind, value) observations of a domain, in two levels.

    Observations fall into 4,096 parts by their own digest; a part is the digest of its sorted observations, the print that of the sorted parts. So no
    row holds all observations of a domain, and equal sets give equal prints in whatever order and tasks they were seen.
    """
    clean = observation.select("domain", F.concat_ws("=", "kind", F.lower(F.trim("value"))).alias("seen")).filter(F.trim("value") != "").distinct()
    digest = F.sha2("seen", 256)
    parts = clean.groupBy("domain", F.substring(digest, 1, PART_DIGITS).alias("part")).agg(
        F.sha2(F.array_join(F.array_sort(F.collect_list("seen")), ";"), 256).alias("digest"))
    joined = F.array_join(F.array_sort(F.collect_list(F.concat("part", F.lit(":"), "digest"))), ";")
    return parts.groupBy("domain").agg(F.sha2(joined, 256).alias("print"))


def shared_prints(prints: DataFrame) -> DataFrame:
    return prints.groupBy("print").agg(F.count(F.lit(1)).alias("domains"), F.min("domain").alias("first_domain")).filter("domains > 1")


def attachment_verdicts(attachment: DataFrame, verdict: DataFrame) -> DataFrame:
    """Findings from prior engine verdicts on attachments: three or more malicious count in full, fewer lightly."""
    known = attachment.select("msg_id", "sha256").distinct()
    usable = verdict.filter((F.col("status") == "available") & (F.col("malicious") >= 0) & (F.col("suspicious") >= 0)
                            & (F.col("malicious") + F.col("suspicious") > 0))
    many = F.col("malicious") >= 3
    return known.join(usable, "sha256").select(
        "msg_id", F.lit("reputation").alias("grp"),
        F.when(many, "Attachment flagged by multiple engines").otherwise("Attachment reputation requires review").alias("title"),
        F.col("sha256").alias("detail"), F.when(many, 60).otherwise(15).alias("points"))


def receipts(receipt: DataFrame, message: DataFrame, key: DataFrame, as_of: Column,
             window: tuple[int, int] = (-60, 300)) -> DataFrame:
    """Receipts that match a stored message, are signed with the receiver's key and were issued within the window (seconds)."""
    age = F.unix_seconds(as_of) - F.col("issued_at")
    unsigned = crypto.canonical_json(F.col("issued_at"), F.col("receiver"), F.col("sha256"))
    signed = receipt.join(key, "receiver").filter(F.length("key") >= 32)
    expected = crypto.hmac_sha256_by_column(F.col("key"), unsigned)
    valid = signed.filter((expected == F.col("signature")) & age.between(*window))
    return valid.join(message.select("msg_id", F.col("raw_hash").alias("sha256")), "sha256").select("msg_id", "receiver", "issued_at")


def domain_age_days(registered: Column, as_of: Column) -> Column:
    return F.datediff(as_of, F.try_to_timestamp(registered))


# ---- pages ------------------------------------------------------------------------------------------------------

def page_signals(page: DataFrame) -> DataFrame:
    """Counts of page elements and the findings they give."""
    count = lambda pattern: F.regexp_count("html", F.lit(f"(?is){pattern}")).cast("long")
    host = hosts.url_host(F.col("url"))
    out = page.select(
        "page_id", "url", host.alias("host"),
        F.trim(F.regexp_extract("html", "(?is)<title[^>]*>(.*?)</title>", 1)).alias("title"),
        count("<form[\\s>]").alias("forms"), count("<input[^>]*type=[\"']?password").alias("password_fields"),
        count("<iframe[\\s>]").alias("iframes"), count("<script[^>]*src=").alias("scripts_external"),
        (count("<script[\\s>]") - count("<script[^>]*src=")).alias("scripts_inline"), count("<a[\\s>]").alias("links"),
        count("<meta[^>]*http-equiv=[\"']?refresh").alias("meta_refresh"), count("<!--").alias("comments"))
    return out.withColumn("findings", listed(
        (F.col("password_fields") > 0, "Credential form"),
        ((F.col("password_fields") > 0) & F.col("url").startswith("http:"), "Password form over plain HTTP"),
        (F.col("meta_refresh") > 0, "Meta refresh redirect"), (F.col("iframes") > 0, "Embedded frames"),
        (hosts.is_ipv4(host) | host.contains(":"), "Page served from a bare IP address")))


def page_skeletons(page: DataFrame) -> DataFrame:
    """(page_id, skeleton): digest of the page's tag names in order."""
    body = F.regexp_replace("html", "(?s)<!--.*?-->", "")
    tags = F.transform(F.regexp_extract_all(body, F.lit("<([A-Za-z][A-Za-z0-9]*)"), F.lit(1)), F.lower)
    return page.select("page_id", F.sha2(F.array_join(tags, ">"), 256).alias("skeleton"), F.size(tags).alias("tags"))


def comments(page: DataFrame) -> DataFrame:
    return page.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit("(?s)<!--(.*?)-->"), F.lit(1))).alias("pos", "comment"))


def hidden_text(page: DataFrame, style: str) -> DataFrame:
    """(page_id, pos, hidden): the pieces of text, in order, inside elements that an inline style hides, at any depth."""
    return page.select("page_id", F.posexplode(markup.hidden_fragments(F.col("html"), style)).alias("pos", "hidden"))
