"""Content strategy reports: H1-H4."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.constants import TITLE_EDGES, TITLE_LABELS, WEEKDAYS
from .performance import bucket_means
from .rollup import mean_of_int


def publish_heatmap(fv: DataFrame) -> DataFrame:
    """H1: mean views per publish hour (rows present) x weekday (Monday..Sunday).

    The pivot values are given explicitly, so no extra job discovers them and
    every weekday is a column even without videos."""
    return (fv.where(F.col("publish_hour").isNotNull())
            .groupBy("publish_hour").pivot("publish_day", WEEKDAYS)
            .agg(F.avg("views")))


def period_performance(fv: DataFrame) -> DataFrame:
    """H2: mean views and engagement per posting period."""
    return (fv.where(F.col("posting_period").isNotNull()).groupBy("posting_period")
            .agg(mean_of_int("views").alias("views"), F.avg("engagement_rate").alias("engagement_rate")))


def views_by_title_length(fv: DataFrame) -> DataFrame:
    """H3: mean views per title-length bucket (0,40], (40,60], (60,80], (80,200]."""
    return bucket_means(fv, "title_length", TITLE_EDGES, TITLE_LABELS, "title_bucket")


def publishing_calendar(fv: DataFrame) -> DataFrame:
    """H4: videos per calendar date."""
    return (fv.where(F.col("publish_date").isNotNull())
            .groupBy(F.to_date("publish_date").alias("publish_date"))
            .agg(F.count("video_id").alias("videos")))
