"""Video enrichment: channel attributes (J1/J2/J4), time parts, rates, category.

All derived columns are built in one projection; Catalyst collapses it into
the scan's whole-stage-codegen span. The only data-dependent scalars are the
category thresholds (table-wide q25 / q75), which arrive as literals.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import age_days, posting_period, safe_div
from .joins import salted_join
from .quantiles import quantiles

VIDEO_COLUMNS = [
    "video_id", "title", "channel_id", "publish_date", "duration_minutes", "views", "likes",
    "comments", "channel_name", "ch_subscribers", "channel_created", "publish_hour",
    "publish_day", "publish_month", "publish_month_num", "publish_year", "posting_period",
    "video_age_days", "engagement_rate", "like_rate", "comment_rate", "likes_per_comment",
    "views_per_day", "title_length", "performance_category",
]


def attach_channel(videos: DataFrame, channels: DataFrame, how: str = "left",
                   split_hot_channels: bool = True, key_source: DataFrame | None = None) -> DataFrame:
    """Add channel_name, ch_subscribers, channel_created by channel_id.

    No broadcast hint: the channel table grows with the data. Channels owning
    more than 1% of the videos are spread over several tasks by a salted join
    (``joins.salted_join``); AQE may still broadcast a measured-small side.
    ``key_source`` is a narrow table to count channel_id on (one row per video).
    """
    if how not in ("left", "inner"):
        raise ValueError("how must be 'left' or 'inner'")
    attrs = channels.select("channel_id", "channel_name", "ch_subscribers", "channel_created")
    if split_hot_channels:
        return salted_join(videos, attrs, "channel_id", how, key_source=key_source)
    return videos.join(attrs, "channel_id", how)


def with_time_and_rates(df: DataFrame, as_of: datetime, period_mode: str = "daypart",
                        absolute_age: bool = True) -> DataFrame:
    """Time parts, age, rates, velocity, title length (no category yet)."""
    ts = F.col("publish_date")
    age = age_days("publish_date", as_of, absolute=absolute_age)
    views, likes, comments = F.col("views"), F.col("likes"), F.col("comments")
    keep = [c for c in df.columns]
    return df.select(
        *keep,
        F.hour(ts).alias("publish_hour"),
        F.date_format(ts, "EEEE").alias("publish_day"),
        F.date_format(ts, "yyyy-MM").alias("publish_month"),
        F.month(ts).alias("publish_month_num"),
        F.year(ts).alias("publish_year"),
        posting_period(ts, period_mode).alias("posting_period"),
        age.alias("video_age_days"),
        (safe_div(likes + comments, views) * 100).alias("engagement_rate"),
        (safe_div(likes, views) * 100).alias("like_rate"),
        (safe_div(comments, views) * 100).alias("comment_rate"),
        safe_div(likes, comments).alias("likes_per_comment"),
        safe_div(views, age + 1).alias("views_per_day"),
        F.length("title").alias("title_length"),
    )


def category_thresholds(df: DataFrame, column: str = "views", approx: bool = False) -> tuple[float, float]:
    """(q25, q75) of ``column`` over the whole table (distributed exact quantiles)."""
    q25, q75 = quantiles(df, column, [0.25, 0.75], approx=approx)
    return q25, q75


def category_expr(views: Column, q25: float | None, q75: float | None,
                  low_inclusive: bool = True) -> Column:
    """High / Medium / Low from the thresholds; High is tested first.

    ``low_inclusive`` (dashboard): ``<= q25`` is Low. Otherwise (batch):
    ``>= q25`` is Medium, so a value exactly at q25 is Medium.
    """
    if q25 is None or q75 is None:
        return F.lit(None).cast("string")
    hi, lo = F.lit(float(q75)), F.lit(float(q25))
    if low_inclusive:
        return F.when(views >= hi, "High").when(views <= lo, "Low").otherwise("Medium")
    return F.when(views >= hi, "High").when(views >= lo, "Medium").otherwise("Low")


def categorize(df: DataFrame, low_inclusive: bool = True, approx: bool = False,
               thresholds: tuple[float, float] | None = None, column: str = "views") -> DataFrame:
    """Add performance_category from table-wide q25 / q75 of views."""
    q25, q75 = thresholds if thresholds is not None else category_thresholds(df, column, approx)
    return df.withColumn("performance_category",
                         category_expr(F.col(column), q25, q75, low_inclusive))


def enrich_videos(df: DataFrame, as_of: datetime, period_mode: str = "daypart",
                  low_inclusive: bool = True, absolute_age: bool = True,
                  thresholds: tuple[float, float] | None = None,
                  approx: bool = False) -> DataFrame:
    """The full enrichment of typed videos that carry channel attributes.

    Dashboard semantics by default; ``period_mode='month_third'``,
    ``low_inclusive=False``, ``absolute_age=False`` give the batch script's.
    ``as_of`` replaces "now" so ages repeat. The input is scanned once more for
    the thresholds unless they are given; persist it first when it is costly.
    """
    base = with_time_and_rates(df, as_of, period_mode, absolute_age)
    out = categorize(base, low_inclusive=low_inclusive, approx=approx, thresholds=thresholds)
    return out.select(*[c for c in VIDEO_COLUMNS if c in out.columns],
                      *[c for c in out.columns if c not in VIDEO_COLUMNS])
