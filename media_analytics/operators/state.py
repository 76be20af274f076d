"""Partial sums of the videos that reports are answered from and that merge.

``channel_days`` has one row per channel and calendar day, ``day_hours`` one per day and hour.
Both hold counts, sums and counts of the values that are not null, so states of disjoint
videos add up, and means, totals and calendars come from them without a video being
read. They are written by ``publish_year``: a refresh computes only the years it changed, a
date filter prunes folders.

Reports of ``channel_days`` take dates and channels as filters. A category filter needs the
videos (the category's thresholds move with every refresh). As the dashboard fills missing
numbers with zero, means over days divide by rows; the rollup's by values.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.constants import WEEKDAYS
from .common import dimension, keep_labels
from .filters import FilterSpec, _day
from .rollup import channel_metrics

COUNTERS = ("views", "likes", "comments")
MEASURES = ("duration_minutes", "engagement_rate")


def _sums() -> list:
    out = [F.count(F.lit(1)).alias("rows"), F.count("video_id").alias("videos")]
    for c in (*COUNTERS, *MEASURES):
        total = F.sum(c).cast("bigint") if c in COUNTERS else F.sum(c)
        out += [total.alias(f"{c}_sum"), F.count(c).alias(f"{c}_n")]
    return out


def channel_days(videos: DataFrame) -> DataFrame:
    """(publish_year, channel_id, channel_name, day, sums); missing keys are groups of their own."""
    return videos.groupBy("publish_year", "channel_id", "channel_name", F.to_date("publish_date").alias("day")).agg(*_sums())


def day_hours(videos: DataFrame) -> DataFrame:
    """(publish_year, day, publish_hour, rows, views_sum) of the videos with a channel."""
    return (videos.where(F.col("channel_name").isNotNull() & F.col("publish_date").isNotNull())
            .groupBy("publish_year", F.to_date("publish_date").alias("day"), "publish_hour")
            .agg(F.count(F.lit(1)).alias("rows"), F.sum("views").cast("bigint").alias("views_sum")))


def filter_days(state: DataFrame, spec: FilterSpec = FilterSpec()) -> DataFrame:
    """F1-F2 on a state: rows with a date (and a channel, if the state has channels)."""
    if spec.categories is not None:
        raise ValueError("a category filter needs the videos")
    out = state.where(F.col("day").isNotNull())
    if "channel_name" in state.columns:
        out = out.where(F.col("channel_name").isNotNull())
        if spec.channels is not None:
            out = out.where(F.col("channel_name").isin(list(spec.channels)))
    elif spec.channels is not None:
        raise ValueError("this state has no channels")
    end = spec.end if spec.end is not None else spec.start  # one date means that day
    if spec.start is not None:
        out = out.where((F.col("day") >= F.lit(_day(spec.start))) & (F.col("publish_year") >= _day(spec.start).year))
    if end is not None:
        out = out.where((F.col("day") <= F.lit(_day(end))) & (F.col("publish_year") <= _day(end).year))
    return out


def _mean(total: str, n: str):
    return F.try_divide(F.sum(total).cast("double"), F.sum(n).cast("double"))


def _filled_mean(column: str):
    """Mean with missing values as zero."""
    return F.try_divide(F.coalesce(F.sum(f"{column}_sum"), F.lit(0)).cast("double"), F.sum("rows").cast("double"))


def rollup_from_days(days: DataFrame, channels: DataFrame, as_of: datetime) -> DataFrame:
    """A1 + A2 (``rollup.rollup_channels``) from the state."""
    agg = (days.where(F.col("channel_id").isNotNull() & F.col("channel_name").isNotNull())
           .groupBy("channel_id", "channel_name")
           .agg(F.sum("videos").alias("videos"), F.sum("views_sum").alias("total_views"),
                F.sum("likes_sum").alias("total_likes"), F.sum("comments_sum").alias("total_comments"),
                _mean("likes_sum", "likes_n").alias("avg_likes"), _mean("views_sum", "views_n").alias("avg_views"),
                _mean("duration_minutes_sum", "duration_minutes_n").alias("avg_duration"),
                _mean("engagement_rate_sum", "engagement_rate_n").alias("avg_engagement_rate")))
    attrs = channels.select("channel_id", F.col("ch_subscribers").alias("subscribers"), "channel_created")
    return channel_metrics(agg.join(attrs, "channel_id", "left"), as_of)


def trend_from_days(days: DataFrame) -> DataFrame:
    """G1."""
    return days.groupBy(F.col("day").alias("publish_date")).agg(_filled_mean("engagement_rate").alias("engagement_rate"))


def months_from_days(days: DataFrame) -> DataFrame:
    """G3."""
    return (days.groupBy(F.trunc("day", "MM").alias("month"))
            .agg(F.coalesce(F.sum("views_sum"), F.lit(0)).alias("views"), F.sum("videos").alias("videos")))


def weekdays_from_days(days: DataFrame) -> DataFrame:
    """G6."""
    agg = (days.groupBy(F.date_format("day", "EEEE").alias("publish_day"))
           .agg(_filled_mean("engagement_rate").alias("engagement_rate")))
    dim = dimension(days.sparkSession, "publish_day", WEEKDAYS, "day_order")
    return keep_labels(dim, agg, "publish_day").select("publish_day", "day_order", "engagement_rate")


def calendar_from_days(days: DataFrame) -> DataFrame:
    """H4."""
    return days.groupBy(F.col("day").alias("publish_date")).agg(F.sum("videos").alias("videos"))


def heatmap_from_hours(hours: DataFrame) -> DataFrame:
    """H1."""
    return (hours.withColumn("publish_day", F.date_format("day", "EEEE")).groupBy("publish_hour")
            .pivot("publish_day", WEEKDAYS).agg(_filled_mean("views")))
