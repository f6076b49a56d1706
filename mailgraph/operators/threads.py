"""Conversation threads, relay paths and content search."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mailgraph.functions import text as T
from mailgraph.functions import hosts

REVERSAL_SECONDS = 300


def thread_tokens(message: DataFrame) -> DataFrame:
    """(msg_id, at, token, role): what ties a message to its thread.

    A message owns its Message-ID and holds the ids it refers to. Two messages share a thread when they meet on a token
    that at least one of them holds. Messages without any thread header meet on sender and subject instead.
    """
    own = F.regexp_extract(F.trim(F.coalesce("message_id", F.lit(""))), "^<[^ \\t\\r\\n<>]+@[^ \\t\\r\\n<>]+>$", 0)
    refs = T.reference_tokens(F.col("in_reply_to"))
    pair = lambda role, token: F.struct(F.lit(role).alias("role"), token.alias("token"))
    headers = F.concat(
        F.when(own != "", F.array(pair("own", own))).otherwise(F.array().cast("array<struct<role:string,token:string>>")),
        F.transform(refs, lambda r: pair("ref", r)))
    fallback = F.array(pair("ref", F.concat(hosts.address(F.col("sender")), F.lit("|"), T.subject_key(F.col("subject")))))
    tokens = F.when(F.size(headers) > 0, headers).otherwise(fallback)
    return message.select("msg_id", F.struct(F.col("created").alias("created"), "msg_id").alias("at"),
                          F.explode(tokens).alias("t")).select("msg_id", "at", "t.token", "t.role")


def thread_sizes(tokens: DataFrame) -> DataFrame:
    """Per token: holders, owners and the message pairs they imply (holders among themselves, holders with owners)."""
    per = tokens.groupBy("token").agg(
        F.count_if(F.col("role") == "ref").alias("holders"), F.count_if(F.col("role") == "own").alias("owners"))
    pairs = F.expr("CAST(holders * (holders - 1) / 2 + holders * owners AS BIGINT)")
    return per.withColumn("pairs", pairs).filter(F.col("pairs") > 0)


def thread_partners(tokens: DataFrame, chosen: DataFrame) -> DataFrame:
    """(src, dst): all messages that share a thread with the chosen ones; chosen rows times thread size, never a square."""
    side = lambda df, name: df.select("token", F.col("msg_id").alias(name), F.col("role").alias(f"{name}_role"))
    asked = tokens.join(chosen.select("msg_id"), "msg_id", "left_semi")
    met = side(asked, "a").join(side(tokens, "b"), "token").filter(
        (F.col("a") != F.col("b")) & ((F.col("a_role") == "ref") | (F.col("b_role") == "ref")))
    return met.select(F.col("a").alias("src"), F.col("b").alias("dst")).distinct()


def changed_in_thread(tokens: DataFrame, values: DataFrame, *kinds: str) -> DataFrame:
    """(msg_id, *kinds, value) not seen earlier in the message's threads although another value was.

    ``values`` holds (msg_id, *kinds, value); values of different kinds never answer each other. For each token only the first time of every value and of any value is needed, so
    the work is linear in the rows however long a thread is.
    """
    held = tokens.join(values, "msg_id")
    when = lambda role: F.min(F.when(F.col("role") == role, F.col("at")))
    per_value = held.groupBy("token", *kinds, "value").agg(when("ref").alias("ref_first"), when("own").alias("own_first"))
    per_token = per_value.groupBy("token", *kinds).agg(F.min("ref_first").alias("ref_any"), F.min("own_first").alias("own_any"))
    # An owner meets holders only; a holder meets both.
    earlier = lambda ref, own: (
        F.coalesce(F.col(ref) < F.col("at"), F.lit(False))
        | ((F.col("role") == "ref") & F.coalesce(F.col(own) < F.col("at"), F.lit(False))))
    seen = held.join(per_value, ["token", *kinds, "value"]).join(per_token, ["token", *kinds]).groupBy("msg_id", *kinds, "value").agg(
        F.bool_or(earlier("ref_first", "own_first")).alias("seen"))
    any_before = tokens.join(per_token, "token").groupBy("msg_id", *kinds).agg(F.bool_or(earlier("ref_any", "own_any")).alias("prior"))
    keys = ["msg_id", *kinds]
    return seen.filter(~F.col("seen")).join(any_before.filter("prior").select(*keys), keys, "left_semi").select(*keys, "value")


# ---- relay paths: a message's hops are few, so plain windows per message are safe -------------------------------

def _path() -> Window:
    return Window.partitionBy("msg_id").orderBy("hop")


def relay_audit(hop: DataFrame) -> DataFrame:
    """Per message: transitions where a relay's name differs from the one before, repeated records, loops."""
    stepped = hop.withColumn("_prior", F.lag("by_host").over(_path())).withColumn(
        "_break", F.when(F.col("_prior") != F.col("from_host"), F.row_number().over(_path()) - 1))
    moves = F.collect_set(F.when(F.col("from_host") != F.col("by_host"), F.concat_ws(">", "from_host", "by_host")))
    back = F.collect_set(F.when(F.col("from_host") != F.col("by_host"), F.concat_ws(">", "by_host", "from_host")))
    return stepped.groupBy("msg_id").agg(
        F.array_sort(F.collect_list("_break")).alias("discontinuities"),
        (F.count(F.lit(1)) > F.count_distinct(F.concat_ws(">", "from_host", "by_host", "ip"))).alias("repeated"),
        F.arrays_overlap(moves, back).alias("loop"))


def timestamp_reversals(hop: DataFrame, seconds: int = REVERSAL_SECONDS) -> DataFrame:
    """Messages whose known relay times step back by more than ``seconds``; unknown times are passed over."""
    known = hop.filter(F.col("ts").isNotNull()).withColumn("_before", F.lag("ts").over(_path()))
    gap = F.unix_micros("_before") - F.unix_micros("ts")
    return known.filter(gap > seconds * 1_000_000).groupBy("msg_id").agg(
        F.count(F.lit(1)).alias("reversals"), F.max(gap).alias("largest_us"))


def relay_checks(hop: DataFrame) -> DataFrame:
    """(msg_id, title) supplementary checks of the relay path."""
    audit = relay_audit(hop)
    found = F.array_compact(F.array(
        F.when(F.size("discontinuities") > 0, "Relay naming discontinuity"), F.when(F.col("repeated"), "Repeated relay record"),
        F.when(F.coalesce("loop", F.lit(False)), "Possible relay loop")))
    reversal = timestamp_reversals(hop).select("msg_id", F.lit("Relay timestamp reversal").alias("title"))
    return audit.select("msg_id", F.explode(found).alias("title")).unionByName(reversal)


def parse_received(header: DataFrame, value: str = "value") -> DataFrame:
    """Relay names and sender addresses of Received headers. Words inside comments (nested two deep) name no relay, but
    addresses in the comments of the ``from`` clause count."""
    raw = F.col(value)
    plain, marked = raw, raw
    for _ in range(2):
        plain = F.regexp_replace(plain, "\\([^()]*\\)", " ")
        # Hide the clause word inside the innermost comments, then open those comments so the next level is innermost.
        marked = F.regexp_replace(marked, "(?i)(\\([^()]*)\\bby\\b(?=[^()]*\\))", "$1--")
        marked = F.regexp_replace(marked, "\\(([^()]*)\\)", "{$1}")
    from_host = F.regexp_extract(plain, "(?i)^\\s*from\\s+([A-Za-z0-9_.:-]+)", 1)
    by_host = F.regexp_extract(plain, "(?i)\\bby\\s+([A-Za-z0-9_.:-]+)", 1)
    segment = F.when(from_host == "", "").otherwise(
        F.regexp_replace(F.regexp_extract(marked, "(?is)^(.*?)(?:\\bby\\s|$)", 1), "(?i)IPv6:", ""))
    tokens = F.array_distinct(F.regexp_extract_all(segment, F.lit("[0-9a-fA-F:.]+"), F.lit(0)))
    addresses = F.filter(tokens, lambda x: hosts.is_ipv4(x) | x.rlike("^[0-9a-fA-F]{0,4}(:[0-9a-fA-F]{0,4}){2,7}$"))
    named = lambda c: F.nullif(F.regexp_replace(F.lower(c), "\\.$", ""), F.lit(""))
    return header.withColumn("from_host", named(from_host)).withColumn("by_host", named(by_host)).withColumn("sender_ips", addresses)


def header_consistency(header: DataFrame, message: DataFrame) -> DataFrame:
    """(msg_id, title): repeated singleton headers, malformed Message-ID, display name naming another address."""
    single = ("message-id", "date", "subject", "reply-to", "return-path")
    repeated = (
        header.filter(F.lower("name").isin(*single)).groupBy("msg_id", F.lower("name").alias("name"))
        .agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        .select("msg_id", F.concat(F.lit("Duplicate "), F.col("name")).alias("title")))
    malformed = (
        header.filter(F.lower("name") == "message-id").groupBy("msg_id").agg(F.min_by("value", "pos").alias("value"))
        .filter(~F.trim("value").rlike("^<[^<>\\s@]+@[^<>\\s@]+>$")).select("msg_id", F.lit("Malformed Message-ID").alias("title")))
    claimed = F.regexp_extract(hosts.display_name(F.col("sender")), "[A-Za-z0-9_.+-]+@[A-Za-z0-9.-]+", 0)
    differs = message.filter((claimed != "") & (F.lower(claimed) != hosts.address(F.col("sender")))).select(
        "msg_id", F.lit("Display-name address differs").alias("title"))
    return repeated.unionByName(malformed).unionByName(differs)


def search(message: DataFrame, finding: DataFrame, indicator: DataFrame, needle: str, recipient: DataFrame | None = None) -> DataFrame:
    """Messages whose subject, sender, recipients (``recipient``: msg_id, recipient), findings or indicator values contain the text, ignoring case.

    Each table is filtered where it is stored; only matching ids are shuffled. Blank text finds every message.
    """
    wanted = needle.strip().lower()
    if not wanted:
        return message.select("msg_id")
    hit = lambda *c: F.lower(F.concat_ws(" ", *c)).contains(wanted)
    return (
        message.filter(hit("subject", "sender")).select("msg_id")
        .unionByName((message.limit(0) if recipient is None else recipient.filter(hit("recipient"))).select("msg_id"))
        .unionByName(finding.filter(hit("title", "detail")).select("msg_id"))
        .unionByName(indicator.filter(hit("value")).select("msg_id")).distinct())
