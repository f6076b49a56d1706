"""Time the headline queries at one scale and print one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from mailgraph.plans import registry  # noqa: E402
from mailgraph.session import build  # noqa: E402

HEADLINE = (
    "A01_dedup_removed_by_source", "J16_leakage_report", "P13_indicators", "J04_links", "J08_history", "W06_recurrence", "J05_near_duplicates", "A05_campaigns",
    "A06_graph_edges", "J03_cidr_ranges", "U03_reply_domain_changed", "W04_verify_chain", "A08_ledger",
    "R01_rule_scan", "A04_scores", "R05_five_classes", "R02_instruction_findings", "A23_email_census", "A24_attribution", "A19_auc",
    "A20_latency", "W07_rolling_rate", "X07_sliding_sessions",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = build("bench", f"local[{cores}]", **{
        "spark.sql.shuffle.partitions": cores, "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "12g",
        "spark.driver.host": "127.0.0.1"})
    spark.sparkContext.setLogLevel("ERROR")
    queries, seconds = registry.queries(), {}
    spark.read.parquet(f"{folder}/documents.parquet").count()  # start the JVM and the executor before timing
    for name in os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(","):
        start = time.perf_counter()
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    documents = spark.read.parquet(f"{folder}/documents.parquet").count()
    print(json.dumps({
        "metric": "headline queries, total wall time", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": Path(folder).name.removeprefix("sf"), "cores": int(cores), "messages": documents,
        "messages_per_second_scored": round(documents / seconds["R05_five_classes"], 1) if "R05_five_classes" in seconds else None}))
    spark.stop()


if __name__ == "__main__":
    main()
