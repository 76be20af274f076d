"""Channel rollup (A1, J3), derived channel metrics (A2), channel profile (A3)."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import age_days, ratio_or_null, safe_div

CHANNEL_COLUMNS = [
    "channel_id", "channel_name", "videos", "total_views", "total_likes", "total_comments",
    "avg_likes", "avg_views", "avg_duration", "avg_engagement_rate", "subscribers",
    "channel_created", "avg_views_per_video", "likes_per_1000_views", "views_per_subscriber",
    "engagement_score", "channel_age_days", "videos_per_month",
]


def mean_of_int(c: str):
    """Exact mean of an integer column: exact long sum / count (order independent)."""
    return F.try_divide(F.sum(c).cast("double"), F.count(c).cast("double"))


def rollup_channels(videos: DataFrame, channels: DataFrame | None = None,
                    as_of: datetime | None = None) -> DataFrame:
    """A1 + A2: one row per (channel_id, channel_name) of the videos.

    Null keys are dropped (as a pandas group-by does). Aggregates are partial
    (map-side combine), so a channel holding a third of all videos costs no
    more than any other. Subscribers and created date come from ``channels``
    when given (J3), else from the video rows (``max``: one value per key).
    """
    v = videos.where(F.col("channel_id").isNotNull() & F.col("channel_name").isNotNull())
    aggs = [
        F.count("video_id").alias("videos"),
        F.sum("views").cast("bigint").alias("total_views"),
        F.sum("likes").cast("bigint").alias("total_likes"),
        F.sum("comments").cast("bigint").alias("total_comments"),
        mean_of_int("likes").alias("avg_likes"),
        mean_of_int("views").alias("avg_views"),
        F.avg("duration_minutes").alias("avg_duration"),
        F.avg("engagement_rate").alias("avg_engagement_rate"),
    ]
    if channels is None:
        aggs += [F.max("ch_subscribers").alias("subscribers"),
                 F.max("channel_created").alias("channel_created")]
    agg = v.groupBy("channel_id", "channel_name").agg(*aggs)
    if channels is not None:
        attrs = channels.select("channel_id", F.col("ch_subscribers").alias("subscribers"),
                                "channel_created")
        agg = agg.join(attrs, "channel_id", "left")
    return channel_metrics(agg, as_of)


def channel_metrics(rollup: DataFrame, as_of: datetime | None) -> DataFrame:
    """A2: per-video averages, likes per 1000 views, views per subscriber,
    engagement score, channel age and videos per month; zero-safe."""
    tv, subs, vids = F.col("total_views"), F.col("subscribers"), F.col("videos")
    vps = safe_div(tv, subs)
    like_share = ratio_or_null("total_likes", "total_views")
    if as_of is None:
        raise ValueError("as_of is required (ages are measured against it)")
    age = age_days("channel_created", as_of, absolute=False)
    out = rollup.select(
        *[c for c in rollup.columns],
        safe_div(tv, vids).alias("avg_views_per_video"),
        F.coalesce(like_share * 1000, F.lit(0.0)).alias("likes_per_1000_views"),
        vps.alias("views_per_subscriber"),
        F.coalesce(like_share + vps, F.lit(0.0)).alias("engagement_score"),
        age.alias("channel_age_days"),
    )
    out = out.withColumn("videos_per_month",
                         F.coalesce(F.try_divide(vids.cast("double"), F.col("channel_age_days").cast("double")) * 30,
                                    F.lit(0.0)))
    return out.select(*CHANNEL_COLUMNS)


def channel_profile(c: DataFrame) -> DataFrame:
    """A3: profile from declared totals (videos, total_views, total_likes,
    total_comments, subscribers, channel_age_days): ratio-of-totals engagement
    and the log1p engagement score."""
    tv, vids = F.col("total_views"), F.col("videos")
    eng = safe_div(F.col("total_likes") + F.col("total_comments"), tv) * 100
    return c.select(
        "channel_id", "channel_name", "videos", "total_views", "total_likes", "total_comments",
        "subscribers", "channel_age_days",
        safe_div(tv, vids).alias("avg_views"),
        safe_div("total_likes", vids).alias("avg_likes"),
        eng.alias("avg_engagement_rate"),
        safe_div(tv, vids).alias("avg_views_per_video"),
        (safe_div("total_likes", tv) * 1000).alias("likes_per_1000_views"),
        safe_div(tv, "subscribers").alias("views_per_subscriber"),
        (eng * F.log1p(F.col("subscribers").cast("double"))).alias("engagement_score"),
        safe_div(vids, F.col("channel_age_days") / 30.0).alias("videos_per_month"),
    )
