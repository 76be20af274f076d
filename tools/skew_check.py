"""Skew check: one channel owns a third of the videos (derived from the sf
tables by Spark). Runs the channel join + rollup + KPIs with the salted join
and with a plain join, compares the results, and reports from Spark's event
log how many records the largest join task read versus the median task.

usage: python tools/skew_check.py [sf_dir]
"""

from __future__ import annotations

import glob
import json
import os
import statistics
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from media_analytics.operators import enrich, kpi, rollup  # noqa: E402
from media_analytics.sources.testviews import AS_OF, test_channel_table, test_video_table  # noqa: E402


def session(log_dir: str) -> SparkSession:
    return (SparkSession.builder.master("local[8]").appName("skew_check")
            .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
            .config("spark.sql.shuffle.partitions", "32")
            .config("spark.sql.autoBroadcastJoinThreshold", "-1")       # force shuffle joins
            .config("spark.sql.adaptive.skewJoin.enabled", "false")     # show the salting, not AQE
            .config("spark.sql.adaptive.coalescePartitions.enabled", "false")
            .config("spark.sql.session.timeZone", "UTC")
            .config("spark.eventLog.enabled", "true").config("spark.eventLog.dir", log_dir)
            .config("spark.eventLog.compress", "false").config("spark.eventLog.rolling.enabled", "false")
            .config("spark.driver.memory", "8g").getOrCreate())


def task_records(log_dir: str) -> dict[int, list[int]]:
    """Shuffle records read per task, by stage, from the event log."""
    out: dict[int, list[int]] = {}
    for path in glob.glob(f"{log_dir}/**/*", recursive=True):
        if os.path.isdir(path):
            continue
        with open(path) as f:
            for line in f:
                ev = json.loads(line)
                if ev.get("Event") != "SparkListenerTaskEnd":
                    continue
                m = ev.get("Task Metrics") or {}
                r = (m.get("Shuffle Read Metrics") or {}).get("Total Records Read", 0)
                out.setdefault(ev["Stage ID"], []).append(r)
    return out


def main():
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    results = {}
    for mode in ("salted", "plain"):
        log_dir = tempfile.mkdtemp(prefix=f"skew-{mode}-", dir="/tmp")
        spark = session(log_dir)
        spark.sparkContext.setLogLevel("ERROR")
        v = test_video_table(spark, sf_dir).withColumn(
            "channel_id", F.when(F.col("video_id") % 3 == 0, F.lit(1))            # a third: one channel
            .when(F.col("video_id") % 3 == 1, F.lit(None))                          # a third: none
            .when(F.col("video_id") % 111 == 2, F.lit(2))                           # 0.9%: another channel
            .otherwise(F.col("channel_id")))
        c = test_channel_table(spark, sf_dir, AS_OF)
        t = time.time()
        typed = enrich.attach_channel(v, c, split_hot_channels=(mode == "salted"))
        videos = enrich.enrich_videos(typed, AS_OF, thresholds=(1.0, 2.0))
        ch = rollup.rollup_channels(videos, c, AS_OF)
        k = kpi.strategic_kpis(videos).first()
        top = ch.orderBy(F.col("videos").desc()).first()
        n = typed.count()
        results[mode] = (n, top.channel_id, top.videos, tuple(round(x, 9) for x in k))
        spark.stop()
        recs = task_records(log_dir)
        worst = max(((max(r), statistics.median(r), s) for s, r in recs.items() if len(r) > 1 and max(r) > 0),
                    key=lambda x: x[0] / max(x[1], 1))
        print(f"{mode}: rows={n} hottest channel={top.channel_id} with {top.videos} videos; "
              f"most skewed shuffle stage {worst[2]}: max task {worst[0]} records vs median {worst[1]:.0f} "
              f"({time.time() - t:.1f}s)")
    assert results["salted"] == results["plain"], results
    print("same results:", results["salted"][:3])


if __name__ == "__main__":
    main()
