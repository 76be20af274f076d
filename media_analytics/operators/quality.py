"""Data check (X1): the README's manual checklist as one aggregate pass."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.constants import CATEGORIES


def data_check(v: DataFrame) -> DataFrame:
    """Counts of problems: null dates, negative counters, subscribers <= 0,
    duration <= 0 (or missing), categories other than High/Medium/Low,
    untrimmed text, null ids, duplicate video ids (P21: duplicates are reported, not removed).

    Distinct ids use Spark's two-phase distinct aggregation (partial per task)."""
    c = F.col
    return v.agg(
        F.count(F.lit(1)).alias("videos"),
        F.count_if(c("publish_date").isNull()).alias("null_publish_dates"),
        F.count_if(c("views") < 0).alias("negative_views"),
        F.count_if(c("likes") < 0).alias("negative_likes"),
        F.count_if(c("comments") < 0).alias("negative_comments"),
        F.count_if(F.coalesce(c("ch_subscribers"), F.lit(0)) <= 0).alias("subscribers_not_positive"),
        F.count_if(F.coalesce(c("duration_minutes"), F.lit(0.0)) <= 0).alias("duration_not_positive"),
        F.count_if(~F.coalesce(c("performance_category").isin(*CATEGORIES), F.lit(False))).alias("bad_category"),
        F.count_if(c("title") != F.trim(c("title"))).alias("untrimmed_titles"),
        F.count_if(c("channel_name") != F.trim(c("channel_name"))).alias("untrimmed_channel_names"),
        F.count_if(c("video_id").isNull()).alias("null_ids"),
        (F.count("video_id") - F.count_distinct("video_id")).alias("duplicate_ids"),
    )
