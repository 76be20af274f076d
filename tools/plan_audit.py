"""Summarise the physical plan of every registered query, on top of the shared
tables (written to parquet once): shuffles, broadcasts,
nested-loop joins, windows without partitioning, Python evaluation.

usage: python tools/plan_audit.py [sf_dir]
"""

from __future__ import annotations

import contextlib
import io
import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from media_analytics.plans import catalog  # noqa: E402
from media_analytics.session import local_session  # noqa: E402

MARKS = {
    "shuffle": r"Exchange hashpartitioning|Exchange rangepartitioning|Exchange RoundRobin|Exchange SinglePartition",
    "single": r"Exchange SinglePartition",
    "bcast": r"BroadcastExchange",
    "bnlj": r"BroadcastNestedLoopJoin",
    "cartesian": r"CartesianProduct",
    "smj": r"SortMergeJoin",
    "window": r"\bWindow \[",
    "python": r"BatchEvalPython|ArrowEvalPython|FlatMapGroupsInPandas|MapInPandas",
}


def plan_text(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode="simple")
    return buf.getvalue()


def formatted(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode="formatted")
    return buf.getvalue()


def main():
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = local_session(8)
    # The shared tables are Parquet, so each plan shows what runs: table scans, and
    # what the report itself adds on top of them.
    for name, fn in catalog.queries().items():
        if name in catalog.ROWS_ONLY:  # fitted models
            continue
        txt = plan_text(fn(spark, sf_dir))
        counts = {k: len(re.findall(v, txt)) for k, v in MARKS.items()}
        flags = " ".join(f"{k}={v}" for k, v in counts.items() if v)
        print(f"{name:28s} {flags}")
        if name in ("filtered_videos", "last_90_days", "filtered_by_channel"):
            for found in re.findall(r"(?:PartitionFilters|PushedFilters): \[[^\]]*\]", formatted(fn(spark, sf_dir))):
                print(f"    {found}")


if __name__ == "__main__":
    main()
