"""Bench: the registered queries on $BENCH_SF_DIR with local[$BENCH_CPUS].

Prints ONE JSON line: {"metric", "value" (total seconds), "unit", "queries", "sf"}.
Each query is timed from building its plan (which includes the distributed
quantile rounds some reports need) to the end of a full execution into the
``noop`` sink, so nothing is collected to the driver. ``prepare`` is the
one-time build of the enriched videos and the channel table that all reports
share, written as Parquet and read back (the reference also loads its data once per
session); ``features`` writes the model features and ``fit_*`` are the three forest
fits, so the model queries time what they add to a fitted forest.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from media_analytics.plans import catalog  # noqa: E402
from media_analytics.session import local_session  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
_cpus = os.environ.get("BENCH_CPUS", "8").strip()
CPUS = _cpus if _cpus.isdigit() else str(os.cpu_count() or 8)
def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    catalog.SPREAD = int(CPUS)  # the test tables are single small files
    spark = local_session(CPUS, shuffle_partitions=int(CPUS) * 2, app="media_analytics_bench")
    times: dict[str, float] = {}
    t0 = time.perf_counter()
    ctx = catalog.context(spark, SF_DIR)
    ctx.videos.count()
    ctx.channels.count()
    times["prepare"] = time.perf_counter() - t0
    t = time.perf_counter()
    ctx.features.count()
    times["features"] = round(time.perf_counter() - t, 3)
    for kind in ("category", "virality", "views"):
        t = time.perf_counter()
        run(ctx.model(kind).predictions)
        times[f"fit_{kind}"] = round(time.perf_counter() - t, 3)
    qs = catalog.queries()
    for name, fn in qs.items():
        t = time.perf_counter()
        run(fn(spark, SF_DIR))
        times[name] = round(time.perf_counter() - t, 3)
    times["prepare"] = round(times["prepare"], 3)
    m = re.search(r"sf([0-9.]+)", SF_DIR)
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": float(m.group(1)) if m else SF_DIR,
                      "cpus": int(CPUS)}))
    spark.stop()


if __name__ == "__main__":
    main()
