"""Time the headline queries and print one JSON line.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py [query ...]

Every query runs twice into a sink that keeps nothing; the first (cold) and the second
(warm) time are both recorded and the reported value is the sum of the warm ones.
"""

from __future__ import annotations

import atexit
import json
import os
import shutil
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = (
    "dashboard", "incident_search", "latest_analysis", "trailing_rates", "normalise_host_alerts", "flow_features",
    "suppress_repeats", "related_incidents", "correlation_group_rollup", "group_indicators", "extract_domains",
    "enrich_indicators", "cached_lookup", "propose_actions", "execution_outcomes", "resolved_times", "normalise_responses",
    "incident_reports", "markdown_documents", "chunk_documents", "knowledge_search", "leakage", "stratified_split",
    "roc_auc", "isolation_forest", "stream_severity_windows",
)


def main() -> None:
    from duskwatch.plans import registry
    from duskwatch.session import build_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    stages = tempfile.mkdtemp(prefix="duskwatch-bench-")  # one machine here; on a cluster this is a shared folder
    atexit.register(shutil.rmtree, stages, ignore_errors=True)
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
        spark__sql__shuffle__partitions=cpus,
        spark__driver__memory="16g",
        spark__checkpoint__dir=stages,
    )
    spark.sparkContext.setLogLevel("ERROR")
    cold: dict[str, float] = {}
    warm: dict[str, float] = {}
    for name in sys.argv[1:] or HEADLINE:
        for times in (cold, warm):
            start = time.perf_counter()
            registry.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times[name] = round(time.perf_counter() - start, 3)
        print(f"{name}: cold {cold[name]}s, warm {warm[name]}s", file=sys.stderr, flush=True)
    result = {
        "metric": "warm seconds over the headline queries",
        "value": round(sum(warm.values()), 3),
        "unit": "sec",
        "queries": warm,
        "cold": cold,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
        "cpus": int(cpus),
    }
    print(json.dumps(result))
    spark.stop()


if __name__ == "__main__":
    main()
