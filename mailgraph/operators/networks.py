"""Addresses and networks of both IP versions: membership by prefix equality, and delegation by the first range in registry order.

An address is written as its bits, 32 or 128 characters of 0 and 1; a network is the first ``size`` of them. An address lies in a network of its own
version exactly if its first ``size`` bits are the network's, so membership is an equi-join on (version, size, prefix): each distinct address gives one key for
every prefix size that occurs in the table, at most 33 of version 4 and 129 of version 6. No range is spread over buckets and no key is shared by
all addresses unless a network really holds them all. Bits are worked out once and written, not again for every filter that asks for them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailgraph.functions import hosts
from mailgraph.functions.rules import bound
from mailgraph.plans import lineage

_HEXTET = "^[0-9a-f]{1,4}$"


def _dotted_bits(value: Column) -> Column:
    return F.array_join(F.transform(F.split(value, "\\."), lambda o: F.lpad(F.conv(o, 10, 2), 8, "0")), "")


def _hextets(part: Column) -> Column:
    """The groups of one side of ``::``; a dotted tail counts as two."""
    def split(tail: Column) -> Column:
        pair = bound(_dotted_bits(tail), lambda b: F.concat_ws(":", *[F.lower(F.conv(F.substring(b, at, 16), 2, 16)) for at in (1, 17)]))
        plain = F.concat(F.substring(part, F.lit(1), F.length(part) - F.length(tail)), F.when(hosts.is_ipv4(tail), pair).otherwise("x"))
        return F.split(F.when(tail == "", part).otherwise(plain), ":")
    return F.when(part == "", F.array().cast("array<string>")).otherwise(bound(F.regexp_extract(part, "([^:]*\\.[^:]*)$", 1), split))


def _six_bits(value: Column) -> Column:
    none = F.array().cast("array<string>")

    def sides(halves: Column) -> Column:
        short = F.size(halves) == 2
        both = F.struct(_hextets(halves[0]).alias("left"), F.when(short, _hextets(F.get(halves, F.lit(1)))).otherwise(none).alias("right"))

        def filled(side: Column) -> Column:
            missing = 8 - F.size(side["left"]) - F.size(side["right"])
            zeros = F.when(short & (missing > 0), F.array_repeat(F.lit("0"), missing)).otherwise(none)
            return bound(F.concat(side["left"], zeros, side["right"]), joined)

        def joined(groups: Column) -> Column:
            good = (F.size(groups) == 8) & F.forall(groups, lambda g: g.rlike(_HEXTET))
            return F.when(good, F.array_join(F.transform(groups, lambda g: F.lpad(F.conv(g, 16, 2), 16, "0")), ""))

        tight = short & bound(both, lambda side: F.size(side["left"]) + F.size(side["right"]) > 7)  # "::" stands for one group at least
        early = short & F.contains(halves[0], F.lit("."))
        return F.when((F.size(halves) <= 2) & ~tight & ~early, bound(both, filled))

    return bound(F.split(value, "::", -1), sides)


def bits(address: Column) -> Column:
    """The bits of an IPv4 or IPv6 address as text, NULL for anything else. An address that maps IPv4 into IPv6 is one of version 6."""
    value = F.lower(F.trim(address))
    return F.when(hosts.is_ipv4(value), _dotted_bits(value)).when(value.rlike("^[0-9a-f:.]*:[0-9a-f:.]*$"), _six_bits(value))


def version(address_bits: Column) -> Column:
    return F.when(F.length(address_bits) == 32, 4).when(F.length(address_bits) == 128, 6)


def parsed(lines: DataFrame, column: str = "cidr") -> DataFrame:
    """``lines`` that name a network, with ver, size and prefix. Text after ``;`` or ``#`` is a comment, host bits are allowed, a bare address is a
    network of its own; other lines are dropped."""
    value = F.trim(F.regexp_replace(column, "[;#].*$", ""))
    found = lineage.cut(lines.withColumn("_bits", bits(F.substring_index(value, "/", 1)))).withColumn("ver", version(F.col("_bits")))
    length = F.when(~value.contains("/"), F.length("_bits")).otherwise(F.regexp_extract(value, "^[^/]*/([0-9]{1,3})$", 1).try_cast("int"))
    sized = found.withColumn("size", length).filter(F.col("ver").isNotNull() & F.col("size").between(0, F.length("_bits")))
    return sized.withColumn("prefix", F.substring(F.col("_bits"), F.lit(1), F.col("size"))).drop("_bits")


def members(observed: DataFrame, networks: DataFrame, ip: str = "ip", longest: bool = False) -> DataFrame:
    """Rows of ``observed`` with every network (``longest``: the most specific one) that holds their address; ``networks`` as ``parsed`` gives it.

    Distinct addresses are joined, so a frequent one is looked up once. The table of sizes has at most 162 rows and is broadcast.
    """
    sizes = networks.select("ver", "size").distinct()
    address = lineage.cut(observed.select(ip).distinct().withColumn("_bits", bits(F.col(ip)))).withColumn("ver", version(F.col("_bits")))
    keys = address.join(F.broadcast(sizes), "ver").select(ip, "ver", "size", F.substring(F.col("_bits"), F.lit(1), F.col("size")).alias("prefix"))
    hits = keys.join(networks, ["ver", "size", "prefix"])
    extra = [c for c in networks.columns if c not in ("ver", "size", "prefix")]
    if longest:
        best = hits.groupBy(ip).agg(F.max("size").alias("size"))
        hits = hits.join(best, [ip, "size"])
    return observed.join(hits.select(ip, *extra).distinct(), ip)


def delegated(observed: DataFrame, registry: DataFrame, ip: str = "ip") -> DataFrame:
    """(ip, pos, endpoint) for each distinct address: the first entry of the registry with a range that holds it, and that entry's first https address.

    ``registry`` holds (pos, cidrs, urls); rows that repeat a ``pos`` are one entry. An entry without lists is passed over, and ranges after a malformed one of the same entry do not count. An
    address that no entry holds has NULLs, and so has the endpoint of an entry without an https address.
    """
    ranges = registry.filter(F.col("cidrs").isNotNull() & F.col("urls").isNotNull()).select("pos", F.posexplode("cidrs").alias("_at", "cidr"))
    good = parsed(ranges)
    bad = ranges.join(good.select("pos", "_at"), ["pos", "_at"], "left_anti").groupBy("pos").agg(F.min("_at").alias("_bad"))
    usable = good.join(bad, "pos", "left").filter(F.col("_bad").isNull() | (F.col("_at") < F.col("_bad"))).select("pos", "ver", "size", "prefix")
    distinct = observed.select(ip).distinct().filter(F.col(ip).isNotNull())
    first = members(distinct, usable, ip).groupBy(ip).agg(F.min("pos").alias("pos"))
    own = F.get(F.filter("urls", lambda u: u.startswith("https://")), F.lit(0))
    secure = registry.groupBy("pos").agg(F.min(own).alias("endpoint"))
    return distinct.join(first, ip, "left").join(secure, "pos", "left").select(ip, "pos", "endpoint")
