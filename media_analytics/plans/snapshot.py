"""The batch snapshot job: landed pages -> typed, enriched videos and the
channel table, optionally written out (S1-S5, J1, C1-C24, A1, A2, S6)."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import enrich, filters, rollup
from ..session import cut_lineage
from ..sources import files, pages
from .refresh import newest


@dataclass
class Snapshot:
    videos: DataFrame
    channels: DataFrame
    profile: DataFrame


def build_snapshot(spark: SparkSession, channel_pages: str, video_pages: str, as_of: datetime,
                   playlist_pages: str | None = None, batch_semantics: bool = True,
                   multi_line: bool = False) -> Snapshot:
    """Read the pages, attach channel attributes (left join), enrich and roll up.

    ``batch_semantics`` selects the batch script's rules (thirds of the month,
    ``>= q25`` is Medium, signed ages, durations rounded to 2 decimals); else
    the dashboard's. A folder may hold several fetches: a channel or video counts
    once, by the row with the most views. The parsed pages and the enriched videos are
    written once (checkpoints), because several passes read them.
    """
    channels_raw = pages.read_channel_pages(spark, channel_pages, multi_line,
                                            missing_subscribers_zero=not batch_semantics)
    videos_raw = pages.read_video_pages(spark, video_pages, multi_line,
                                        round_digits=2 if batch_semantics else None)
    if playlist_pages is not None:
        videos_raw = pages.listed_videos(videos_raw, pages.read_playlist_pages(spark, playlist_pages, multi_line))
    # one row per channel whatever the number of fetches in the folder: the one with the most views
    others = [c for c in channels_raw.columns if c not in ("channel_id", "total_views")]
    channels_raw = (channels_raw.groupBy("channel_id").agg(F.max(F.struct("total_views", *others)).alias("r"))
                    .select("channel_id", "r.*").select(*channels_raw.columns))
    unnamed = videos_raw.where("video_id IS NULL")  # cannot be told apart
    videos_raw = cut_lineage(newest(videos_raw.where("video_id IS NOT NULL"), "video_id", ["views", "likes", "comments"])
                             .unionByName(unnamed))
    filters.require_rows(channels_raw, "channels")
    filters.require_rows(videos_raw, "videos")
    typed = enrich.attach_channel(videos_raw, channels_raw, how="left")
    thresholds = enrich.category_thresholds(videos_raw)  # without the join
    if batch_semantics:
        videos = enrich.enrich_videos(typed, as_of, period_mode="month_third", low_inclusive=False,
                                      absolute_age=False, thresholds=thresholds)
    else:
        videos = enrich.enrich_videos(typed, as_of, thresholds=thresholds)
    videos = cut_lineage(videos)
    channels = rollup.rollup_channels(videos, channels_raw, as_of)
    return Snapshot(videos, channels, filters.snapshot_profile(videos, channels))


def write_snapshot(snap: Snapshot, videos_path: str, channels_path: str, fmt: str = "csv") -> None:
    files.write_videos(snap.videos, videos_path, fmt)
    files.write_channels(snap.channels, channels_path, fmt)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> Snapshot:
    """Command line for the batch job (``python -m media_analytics.plans.snapshot``;
    the session comes from the environment): read landed pages, build the
    snapshot, write both tables, print the profile."""
    import argparse

    p = argparse.ArgumentParser(prog="python -m media_analytics.plans.snapshot",
                                description="Build the video and channel tables from landed API pages.")
    p.add_argument("--channel-pages", required=True)
    p.add_argument("--video-pages", required=True)
    p.add_argument("--playlist-pages")
    p.add_argument("--as-of", required=True, help="reference time for ages, e.g. 2024-01-01T00:00:00")
    p.add_argument("--out-videos", required=True)
    p.add_argument("--out-channels", required=True)
    p.add_argument("--format", default="csv", choices=["csv", "parquet"])
    p.add_argument("--dashboard-semantics", action="store_true",
                   help="day parts, <= q25 is Low, absolute ages (default: the batch rules)")
    p.add_argument("--multi-line", action="store_true", help="one pretty-printed page per file")
    a = p.parse_args(argv)
    spark = spark or SparkSession.builder.appName("media_analytics_snapshot").getOrCreate()
    snap = build_snapshot(spark, a.channel_pages, a.video_pages, datetime.fromisoformat(a.as_of),
                          playlist_pages=a.playlist_pages, batch_semantics=not a.dashboard_semantics,
                          multi_line=a.multi_line)
    write_snapshot(snap, a.out_videos, a.out_channels, a.format)
    row = snap.profile.first()
    print(f"channels={row.channels} videos={row.videos} total_views={row.total_views} "
          f"total_likes={row.total_likes} dates={row.first_date}..{row.last_date}")
    return snap


if __name__ == "__main__":
    main()
