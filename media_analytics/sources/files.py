"""Table sinks (S4, S5) and the CSV table source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .csv_records import read_csv
from .pages import count, utc_timestamp


def write_table(df: DataFrame, path: str, fmt: str = "csv", mode: str = "overwrite",
                partition_by: list[str] | None = None) -> None:
    """Write a table: CSV with a header row (no index column) or parquet.

    Parquet can be partitioned (e.g. by ``publish_year``) so later date filters
    prune whole folders. Tasks write their own files; nothing passes the driver."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        # quotes are doubled, the form that other CSV readers and writers use
        w.option("header", True).option("escape", '"').csv(path)
    elif fmt == "parquet":
        w.parquet(path)
    else:
        raise ValueError(f"unsupported format {fmt!r}")


def write_videos(videos: DataFrame, path: str, fmt: str = "csv", **kw) -> None:
    """The enriched video table."""
    write_table(videos, path, fmt, **kw)


def write_channels(channels: DataFrame, path: str, fmt: str = "csv", **kw) -> None:
    """The channel table."""
    write_table(channels, path, fmt, **kw)


# Types of the known columns of both tables; matched by header name, so the
# batch script's column order and this library's both read back.
COLUMN_TYPES = {
    "duration_minutes": "double", "publish_hour": "int", "publish_month_num": "int", "publish_year": "int",
    "video_age_days": "bigint", "engagement_rate": "double", "like_rate": "double", "comment_rate": "double",
    "likes_per_comment": "double", "views_per_day": "double", "title_length": "int",
    "videos": "bigint", "total_views": "bigint", "total_likes": "bigint", "total_comments": "bigint",
    "avg_likes": "double", "avg_views": "double", "avg_duration": "double", "avg_engagement_rate": "double",
    "avg_views_per_video": "double", "likes_per_1000_views": "double", "views_per_subscriber": "double",
    "engagement_score": "double", "channel_age_days": "bigint", "videos_per_month": "double",
}
ZERO_COUNTERS = ("views", "likes", "comments")
NULL_COUNTERS = ("ch_subscribers", "subscribers")
TIMES = ("publish_date", "channel_created")


def read_table_csv(spark: SparkSession, path: str) -> DataFrame:
    """A table written as CSV with a header. Columns are matched by name:
    counters typed tolerantly (C1: bad text -> 0 for video counters, NULL for
    subscribers), times parsed to UTC (C2), known measures cast with
    ``try_cast``; other columns stay text. Quotes inside a field are doubled and a
    field may hold line breaks; large files are read in many tasks all the same
    (``csv_records``)."""
    df = read_csv(spark, path)
    out = []
    for c in df.columns:
        if c in ZERO_COUNTERS:
            out.append(count(c).alias(c))
        elif c in NULL_COUNTERS:
            out.append(count(c, zero_if_missing=False).alias(c))
        elif c in TIMES:
            out.append(utc_timestamp(c).alias(c))
        elif c in COLUMN_TYPES:
            out.append(F.col(c).try_cast(COLUMN_TYPES[c]).alias(c))
        else:
            out.append(F.col(c))
    return df.select(*out)


def read_tables_csv(spark: SparkSession, videos_path: str, channels_path: str) -> tuple[DataFrame, DataFrame]:
    """Both tables of a snapshot."""
    return read_table_csv(spark, videos_path), read_table_csv(spark, channels_path)
