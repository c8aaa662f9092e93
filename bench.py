"""Runs the headline queries and prints one JSON line."""

import json
import os
import time

from tracemill import catalog, session

QUERIES = ["event_self_time", "command_hotspots", "scope_hotspots", "profile_compare", "dead_options", "clobbers", "dominating_write", "cache_soft_hard", "duplicate_links", "shadowed_routes", "diff_requirements", "explain_arg_sets", "interval_containment", "simple_paths", "replayed_reads", "replayed_clobbers", "ingested_recordings", "rule_clobbers", "rule_cyclic_links", "replay_function", "chain_closure"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = session.build(f"local[{os.environ.get('BENCH_CPUS', '8')}]", "bench", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    known, took = catalog.queries(), {}
    spark.read.parquet(f"{sf_dir}/events.parquet").count()
    for name in QUERIES:
        began = time.time()
        known[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf_dir.rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
