"""Registered queries, one module per part of the inventory; importing a module registers its queries."""

from mailgraph.plans.catalog import (  # noqa: F401
    audit,
    content,
    corpus,
    correlation,
    enrichment,
    evaluation,
    scoring,
    similarity,
    streams,
    threads,
)
