"""Session settings the jobs are tuned for.

A cluster passes its own values through ``spark-submit``; anything already set there wins.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Small shuffles still use every core; large ones are sized by the advisory partition size.
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64k",
    # Session windows merge inside each map task before the shuffle, so a hot key shuffles sessions, not events.
    "spark.sql.sessionWindow.merge.sessions.in.local.partition": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build(app: str = "mailgraph", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
