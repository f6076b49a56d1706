"""The per-message evidence plan: links, findings, score and case facts over one set of tables."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailgraph.functions import hosts, rules
from mailgraph.operators import content as K
from mailgraph.operators import decisions as D
from mailgraph.operators import enrichment as E
from mailgraph.operators import scoring as S
from mailgraph.plans import lineage


class Evidence:
    """Lazy frames over one set of tables. Findings are written once when first asked for: score and case facts both read them, and the texts are
    scanned a single time."""

    def __init__(self, tables):
        self.t = tables

    @cached_property
    def auth(self) -> DataFrame:
        return S.alignment(self.t.auth)

    @cached_property
    def feed(self) -> DataFrame:
        """Feed snapshot taken from every third page."""
        listed = self.t.pages.filter(F.col("page_id") % 3 == 0).select(
            hosts.url_digest(F.col("url")).alias("digest"), F.col("page_id").cast("string").alias("record_id"), "page_id")
        return listed.groupBy("digest").agg(F.max_by("record_id", "page_id").alias("record_id"))

    @cached_property
    def url(self) -> DataFrame:
        return E.feed_match(S.scan_urls(self.t.url), self.feed, "fresh")

    @cached_property
    def finding(self) -> DataFrame:
        text = self.t.planted.select("msg_id", "text")
        scanned = rules.findings(text, rules.wording(F.col("text")), "msg_id").select("msg_id", "grp", "title", F.col("excerpt").alias("detail"), "points")
        instructions = K.scored_instructions(K.instruction_findings(text, "text", self.t.page_parts))
        return lineage.cut(scanned.unionByName(instructions).unionByName(self.structural))

    @cached_property
    def structural(self) -> DataFrame:
        found = S.structural(self.t.message, self.auth, self.t.model, self.url, self.t.attachment)
        return found.unionByName(S.lookalike_findings(self.t.url, E.lookalikes(self.t.url, self.t.brand)))

    @cached_property
    def score(self) -> DataFrame:
        return S.scores(self.t.message, self.finding)

    @cached_property
    def case(self) -> DataFrame:
        facts = D.case_facts(self.t.message, self.score, self.finding, self.auth, self.t.model, self.url)
        return D.triage(facts)
