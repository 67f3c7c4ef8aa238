"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

A query runs twice, and the better time counts, as long as the whole run is below $BENCH_BUDGET
seconds; after that it runs once. The first run of a plan pays for compiling its generated code.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

from changetide.operators import catalog, changes, ingest
from changetide.session import get_session
from workload import registry
from workload.samples import messages, table

HEADLINE = (
    "parse_event_fields",
    "mask_fields",
    "column_changes",
    "changes_keyset",
    "values_at_bulk",
    "current_state",
    "event_stats",
    "insert_ignore",
    "merge_columns",
    "checkpoints_max",
    "quota_two_stage",
    "quota_release_schedule",
    "dlq_replay_status",
    "percentile_linear",
    "price_percentiles",
    "sli_rolling",
    "failure_runs",
    "stream_events",
)


def ingest_graph(spark, sf_dir):
    """Parse, filter, mask, identify and derive changes: the whole path of one event."""
    rows = ingest.with_row_identity(ingest.prepare_events(messages(spark, sf_dir)))
    return changes.column_changes(rows, catalog.discover_columns(rows))


def timed(run, spark, sf_dir) -> float:
    start = time.perf_counter()
    run(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = get_session(
        "bench",
        f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    entries = registry()
    runs = {name: entries[name][0] for name in HEADLINE}
    runs["ingest_graph"] = ingest_graph
    budget = float(os.environ.get("BENCH_BUDGET", "240"))
    begun = time.perf_counter()
    seconds = {}
    for name, run in runs.items():
        best = timed(run, spark, sf_dir)
        if time.perf_counter() - begun + best < budget:
            best = min(best, timed(run, spark, sf_dir))
        seconds[name] = round(best, 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    count = table(spark, sf_dir, "events").count()
    scale = re.search(r"sf([0-9.]+)", sf_dir)
    print(
        json.dumps(
            {
                "metric": "total_query_time",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": float(scale.group(1)) if scale else None,
                "events": count,
                "parse_events_per_second": round(count / seconds["parse_event_fields"]),
                "ingest_events_per_second": round(count / seconds["ingest_graph"]),
                "stream_events_per_second": round(count / seconds["stream_events"]),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
