"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from runlens import catalog
from runlens.session import session

HEADLINE = ("scoreboard", "baseline_comparison", "fisher_exact", "wall_vs_work", "ledger_outcomes", "ledger_rule_breaks", "agent_time",
            "usage_totals", "author_surface", "trace_episodes", "spike_facts", "load_shape_law", "busy_spikes", "host_load_summary",
            "footprints", "lifecycle_replay", "validations", "cell_scores", "fleet_status", "sweep_alerts")


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = session("bench", f"local[{cpus}]", **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g",
                                                  "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    queries = catalog.load().QUERIES
    queries["scoreboard"](spark, sf).write.format("noop").mode("overwrite").save()  # start the session's workers
    times: dict[str, float] = {}
    for name in HEADLINE:
        t0 = time.perf_counter()
        queries[name](spark, sf).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(sf.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    sys.exit(main())
