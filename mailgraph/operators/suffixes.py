"""Organisation domains of hosts by a table of public-suffix rules.

A rule is a name, ``*.`` and a name, or ``!`` and a name (an exception). The longest rule that fits a host tells its public suffix; an exception
outranks every other rule and stands for its name without the first label; a host that no rule fits has its last label as suffix. The organisation
domain is the suffix and one more label.

Hosts are exploded into their endings and meet the rules in one equi-join, so the rule table may have any size. Rules of one label say what
the default says and are left out: no join key is shared by a large part of all hosts.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from mailgraph.functions import hosts


@F.pandas_udf(StringType())
def _ascii(names: pd.Series) -> pd.Series:
    def one(name: str) -> str | None:
        try:
            return name.encode("idna").decode("ascii")
        except UnicodeError:
            return None
    return names.map(one)


def _in_ascii(df: DataFrame, column: str) -> DataFrame:
    """Names with other letters get their ASCII form (NULL if they have none); only those pass through Python."""
    other = F.col(column).rlike("[^\\x00-\\x7F]")
    return df.filter(~other).unionByName(df.filter(other).withColumn(column, _ascii(column)))


def parsed(lines: DataFrame, column: str = "value") -> DataFrame:
    """(kind, name, labels) of the rules in a text table: one rule a line, up to the first white space; ``//`` starts a comment line."""
    rule = F.lower(F.regexp_extract(F.trim(F.col(column)), "^(\\S+)", 1))
    kept = lines.select(rule.alias("rule")).filter((F.col("rule") != "") & ~F.col("rule").startswith("//"))
    kind = F.when(F.col("rule").startswith("!"), "exception").when(F.col("rule").startswith("*."), "wildcard").otherwise("exact")
    name = F.regexp_replace("rule", "^(!|\\*\\.)", "")
    named = _in_ascii(kept.select(kind.alias("kind"), name.alias("name")), "name").filter(F.col("name").isNotNull())
    return named.withColumn("labels", F.size(F.split("name", "\\."))).distinct()


def plain_host(host: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(host)), "\\.+$", "")


def _ending(labels: Column, start: Column) -> Column:
    return F.array_join(F.slice(labels, start + 1, F.size(labels)), ".")


def organisations(host: DataFrame, rules: DataFrame, column: str = "host") -> DataFrame:
    """(host, suffix, base), one row for each distinct host. Addresses and names that are suffixes themselves are their own base.

    NULL hosts are left out; the name of a host is compared in lower case, without a dot at the end and in ASCII form. Names with characters that no
    host has get neither suffix nor base.
    """
    every = host.select(F.col(column).alias("host")).filter("host IS NOT NULL").distinct()
    named = _in_ascii(every.withColumn("name", plain_host(F.col("host"))), "name")
    address = hosts.is_ipv4(F.col("name")) | F.col("name").contains(":")
    valid = F.coalesce(F.col("name").rlike("^[a-z0-9_-]+(\\.[a-z0-9_-]+)*$"), F.lit(False))
    cut = named.filter(valid & ~address).withColumn("labels", F.split("name", "\\."))
    ends = cut.select("host", "labels", F.posexplode(F.transform("labels", lambda _, i: _ending(F.col("labels"), i))).alias("at", "name"))
    n = F.size("labels")
    kind = lambda name, size, rank: F.struct(
        F.lit(name).alias("kind"), F.col("name"), size.cast("int").alias("size"), F.lit(rank).alias("rank"))
    left = n - F.col("at")
    asked = ends.select("host", n.alias("n"), F.inline(F.array(kind("exact", left, 0), kind("exception", left - 1, 1), kind("wildcard", left + 1, 0))))
    asked = asked.filter(F.col("size") <= F.col("n"))  # a wildcard asks for one label more
    told = rules.filter((F.col("kind") != "exact") | (F.col("labels") > 1)).select("kind", "name")
    met = asked.join(told, ["kind", "name"]).groupBy("host").agg(F.max(F.struct("rank", "size")).alias("found"))
    sized = cut.join(met, "host", "left").withColumn("size", F.coalesce("found.size", F.lit(1)))
    whole = F.array_join("labels", ".")
    last = lambda k: F.array_join(F.slice("labels", n - k + 1, k), ".")
    ruled = sized.select(
        "host", F.when(F.col("size") >= n, whole).otherwise(last(F.col("size"))).alias("suffix"),
        F.when(F.col("size") >= n, whole).otherwise(last(F.col("size") + 1)).alias("base"))
    none = F.lit(None).cast("string")
    rest = named.filter(~valid | address | F.col("name").isNull())
    return ruled.unionByName(rest.select("host", none.alias("suffix"), F.when(address, F.col("name")).alias("base")))


def with_organisation(df: DataFrame, rules: DataFrame, column: str = "host", name: str = "base") -> DataFrame:
    """``df`` with the organisation domain of ``column``; a row whose host is NULL keeps NULL."""
    found = organisations(df, rules, column).select(F.col("host").alias("_host"), F.col("base").alias(name))
    return df.join(found, F.col(column) == F.col("_host"), "left").drop("_host")


#: the most rules that ``collected`` takes into expressions
MOST = 50_000


def collected(rules: DataFrame, most: int = MOST) -> hosts.Suffixes:
    """A rule table of bounded size as a value for ``hosts.registrable``; larger tables go through ``organisations``."""
    rows = rules.filter((F.col("kind") != "exact") | (F.col("labels") > 1)).select("kind", "name").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rules: use organisations()")
    of = lambda kind: tuple(sorted(r["name"] for r in rows if r["kind"] == kind))
    return hosts.Suffixes(of("exact"), of("wildcard"), of("exception"))
