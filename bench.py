"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

The derived incident tables (users, logs, edges, truth) are written and timed as
``ingest``; every query is run in full into a no-op sink; the better of two runs
counts. Replay queries build their step table anew on each run.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from piitrace.operators import extract  # noqa: E402
from piitrace.plans import policy  # noqa: E402
from piitrace.plans.replay import Replay  # noqa: E402
from piitrace.registry import base  # noqa: E402
from piitrace.sources.incident import Incident  # noqa: E402


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", os.cpu_count() or 8))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("piitrace-bench")
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "12g"))
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="piitrace-bench-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")

    def ingest():
        tables = Incident.load(spark, folder)
        return tables, (tables.users, tables.logs, tables.edges, tables.truth)

    times = {}
    for _ in range(2):
        start = time.time()
        tables, _parts = ingest()
        spent = time.time() - start
        times["ingest"] = min(spent, times.get("ingest", spent))

    # The sample files have one row group each, which is one task. Texts are spread
    # over the cores here, inside the timed run; on a cluster a table has many splits
    # and needs no such step.
    spread = lambda df: df.repartition(cpus)
    documents = lambda: spread(base.table(spark, folder, "documents"))
    logs = lambda: spread(tables.logs)
    cases = {
        "extract_logs": lambda: extract.extract_pii(logs(), profile="demo"),
        "extract_documents": lambda: extract.extract_pii(
            documents(), "text", ("doc_id",), None, "demo"),
        "mask_documents": lambda: extract.mask_text(documents(), "text").select(
            "doc_id", "masked"),
        "pii_rates": lambda: extract.pii_rates(documents()),
        "extractor_quality": lambda: extract.extractor_quality(
            extract.all_matches(logs()), tables.log_pii),
        "replay_steps": lambda: Replay.of(tables).step_results,
        "score_episodes": lambda: Replay.of(tables).episode_scores,
        "score_grader": lambda: Replay.of(tables).graded,
        "reachable": lambda: policy.reachable(tables.logs, tables.edges),
        "driver_rules": lambda: policy.apply_driver_rules(
            tables.actions, tables.scenarios, tables.logs, tables.edges, tables.honeypots),
    }
    for name, build in cases.items():
        best = None
        for _ in range(2):
            start = time.time()
            build().write.format("noop").mode("overwrite").save()
            spent = time.time() - start
            best = spent if best is None else min(best, spent)
        times[name] = best
    rows = {"log_lines": tables.logs.count(), "documents": documents().count(),
            "actions": tables.actions.count()}
    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": {k: round(v, 3) for k, v in times.items()},
        "sf": os.path.basename(folder.rstrip("/")), "cpus": cpus, "rows": rows,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
