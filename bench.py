"""Times the headline queries; prints one JSON line.

BENCH_SF_DIR, BENCH_CPUS and BENCH_RUNS override data, cores and repetitions.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from lapsewise.plans import catalog
from lapsewise.session import local_session

HEADLINE = (
    "survival_curve_all",
    "survival_rate",
    "member_outcomes",
    "cohort_lifecycle",
    "cohort_members",
    "cohort_fills",
    "entity_status",
    "lost_month",
    "lost_window_fills",
    "lost_destination",
    "exclude_code_users",
    "own_mail_cleanup",
    "lost_outlet_class",
    "qc_entity_counts",
    "qc_lost_month_dest",
)


def seconds(spark, name: str, sf_dir: str) -> float:
    started = time.perf_counter()
    catalog.REGISTRY[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - started


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = local_session(cpus)
    seconds(spark, HEADLINE[0], sf_dir)
    times = {
        name: round(statistics.median(seconds(spark, name, sf_dir) for _ in range(runs)), 3)
        for name in HEADLINE
    }
    print(
        json.dumps(
            {
                "metric": "headline queries, total of medians",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
