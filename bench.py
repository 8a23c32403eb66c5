"""Time the headline queries and print one JSON line.

Input: $BENCH_SF_DIR (default /root/testdata/sf0.1) on local[$BENCH_CPUS]. Each query runs once
to warm up and then three times; the median counts. Every query computes its whole result,
which is then thrown away. ``import_jsonl`` is timed once: it validates and stores JSON lines.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from checks import catalog  # noqa: E402
from checks.fixtures import tel  # noqa: E402
from checks.session import local_session  # noqa: E402
from linkscope.plans import importing  # noqa: E402
from linkscope.session import shared_folder  # noqa: E402
from linkscope.sinks import files  # noqa: E402
from linkscope.sources import batches  # noqa: E402
from linkscope.sources.tables import Lake  # noqa: E402

HEADLINE = (
    "fleet_summary",
    "fleet_summary_window",
    "targets",
    "agents",
    "sites",
    "incidents",
    "paths",
    "path_changes",
    "target_detail",
    "detail_timeline",
    "detail_tests",
    "detail_events",
    "detail_paths",
    "detail_incidents",
    "recent_event_feed",
    "trace_events",
    "internet_quality",
    "join_tag_inventory",
    "cfg_probe_plan",
    "cfg_violations",
)
RUNS = 3


def _once(query, spark, sf_dir: str) -> float:
    started = time.perf_counter()
    query(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - started


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS"))
    queries = catalog.queries()
    seconds: dict[str, float] = {}
    for name in HEADLINE:
        times = [_once(queries[name], spark, sf_dir) for _ in range(RUNS + 1)]
        seconds[name] = round(statistics.median(times[1:]), 4)

    events = tel(spark, sf_dir)
    folder = shared_folder(spark, "bench")
    files.write_jsonl(events, f"{folder}/batches", by_site=True)
    lake = Lake(f"{folder}/lake")
    started = time.perf_counter()
    result = importing.import_source(spark, lake, batches.local_source(f"{folder}/batches"))
    seconds["import_jsonl"] = round(time.perf_counter() - started, 4)
    assert result.failed == 0, result

    print(
        json.dumps(
            {
                "metric": "sum of median query seconds",
                "value": round(sum(seconds.values()), 4),
                "unit": "sec",
                "queries": seconds,
                "events": events.count(),
                "sf": Path(sf_dir).name.removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
