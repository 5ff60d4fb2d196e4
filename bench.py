"""Headline queries at BENCH_SF_DIR on local[BENCH_CPUS]; prints one JSON line.

Every query runs once to warm up and then BENCH_RUNS times; the median is reported.  Results
are written to the ``noop`` sink, so the whole plan runs and nothing is brought to the driver.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

from resurvey.operators import resample
from resurvey.plans import catalog_regen as regen
from resurvey.plans.catalog import QUERIES
from resurvey.plans.views import Views
from resurvey.session import local_session

HEADLINE = [
    "specific_agreement",
    "code_agreement",
    "detection_summary",
    "detection_report",
    "composition",
    "top_list_by_cover",
    "subunit_summary",
    "asof_prior",
    "complete_grid",
    "difference_cdf",
    "pair_by_link",
    "regen_index",
    "psa_interval",
    "signed_rank",
]


def full_interval(v: Views):
    """G2 with the full 1000 replicates."""
    return regen.intervals(v, 1000)


def full_cluster(v: Views):
    """G3 with the full 2000 replicates."""
    return resample.cluster_bootstrap(regen.cluster_rows(v), ["area"], "plot", "box_count", 8, 2000, regen.SEED)


def full_index(v: Views):
    """G4 with the full 1000 replicates."""
    return resample.regen_index_interval(
        regen.index_corners(v), regen.small_trees(v), regen.STRATA, "event", 1000, regen.SEED
    )


FULL = {"mean_median_1000": full_interval, "cluster_2000": full_cluster, "index_interval_1000": full_index}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    only = sys.argv[1:]
    spark = local_session(cpus, int(cpus) if cpus.isdigit() else 8)
    jobs = {name: (lambda n=name: QUERIES[n](spark, sf_dir)) for name in HEADLINE}
    jobs.update({name: (lambda f=fn: f(Views(spark, sf_dir))) for name, fn in FULL.items()})
    times = {}
    for name, build in jobs.items():
        if only and name not in only:
            continue
        laps = []
        for lap in range(runs + 1):
            start = time.perf_counter()
            build().write.format("noop").mode("overwrite").save()
            if lap:
                laps.append(time.perf_counter() - start)
        times[name] = round(statistics.median(laps), 3)
        print(name, times[name], file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "headline queries, median of warm runs, total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": Path(sf_dir).name.removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
