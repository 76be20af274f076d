"""Video performance reports: V1-V4, W3, T1-T3, C17-C19, C23."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.constants import CATEGORIES, DURATION_EDGES, DURATION_LABELS
from ..functions.scalar import cut, percent_text, short_number
from .common import dimension, keep_labels, literal_rows
from .quantiles import approx_quantiles, multi_exact_quantiles
from .rollup import mean_of_int

CAT = "performance_category"


def category_mix(fv: DataFrame) -> DataFrame:
    """V1: videos and percent per category; a missing category shows 0."""
    counts = fv.where(F.col(CAT).isNotNull()).groupBy(CAT).agg(F.count(F.lit(1)).alias("videos"))
    total = fv.agg(F.count(F.lit(1)).alias("total"))
    dim = dimension(fv.sparkSession, CAT, CATEGORIES, "category_order")
    out = keep_labels(dim, counts, CAT).crossJoin(F.broadcast(total))
    n = F.coalesce(F.col("videos"), F.lit(0)).cast("bigint")
    return out.select(CAT, "category_order", n.alias("videos"),
                      F.coalesce(F.try_divide(n.cast("double"), F.col("total").cast("double")) * 100,
                                 F.lit(0.0)).alias("pct"))


def bucket_means(fv: DataFrame, column: str, edges: list, labels: list, bucket_col: str,
                 metric: str = "views") -> DataFrame:
    """Mean ``metric`` per right-closed bucket of ``column``; empty buckets NULL."""
    agg = (fv.select(cut(column, edges, labels).alias(bucket_col), metric)
           .where(F.col(bucket_col).isNotNull())
           .groupBy(bucket_col).agg(mean_of_int(metric).alias(metric)))
    dim = dimension(fv.sparkSession, bucket_col, labels, "bucket_order")
    return keep_labels(dim, agg, bucket_col).select(bucket_col, "bucket_order", metric)


def views_by_duration(fv: DataFrame) -> DataFrame:
    """V2: mean views per duration bucket (0,5], (5,10], ... (20,100]."""
    return bucket_means(fv, "duration_minutes", DURATION_EDGES, DURATION_LABELS, "duration_bucket")


def views_distribution(fv: DataFrame, approx: bool = False) -> DataFrame:
    """V3: box statistics of views per category: n, min, q1, median, q3, max,
    mean, sample std. Quartiles are linear (exact, distributed; see quantiles)."""
    spark = fv.sparkSession
    stats = (fv.where(F.col(CAT).isNotNull()).groupBy(CAT)
             .agg(F.count("views").alias("videos"), F.min("views").alias("min"),
                  F.max("views").alias("max"), mean_of_int("views").alias("mean"),
                  F.stddev_samp("views").alias("std")))
    # one column per category (views where the row is in it), so the three
    # quantile searches share their passes over the table
    probs = [0.25, 0.5, 0.75]
    per_cat = fv.select(*[F.when(F.col(CAT) == cat, F.col("views")).alias(f"_v{i}")
                          for i, cat in enumerate(CATEGORIES)])
    if approx:
        got = {f"_v{i}": approx_quantiles(per_cat, f"_v{i}", probs) for i in range(len(CATEGORIES))}
    else:
        got = multi_exact_quantiles(per_cat, {f"_v{i}": probs for i in range(len(CATEGORIES))})
    qs = [[None if x is None else float(x) for x in got[f"_v{i}"]] for i in range(len(CATEGORIES))]
    qdf = literal_rows(spark, [(CAT, list(CATEGORIES))] +
                       [(name, [F.lit(q[k]).cast("double") if q[k] is None else q[k] for q in qs])
                        for k, name in enumerate(["q1", "median", "q3"])])
    dim = dimension(spark, CAT, CATEGORIES, "category_order")
    out = keep_labels(dim, stats, CAT).join(F.broadcast(qdf), CAT, "left")
    return out.select(CAT, "category_order",
                      F.coalesce(F.col("videos"), F.lit(0)).cast("bigint").alias("videos"),
                      F.col("min").cast("double").alias("min"), "q1", "median", "q3",
                      F.col("max").cast("double").alias("max"), "mean", "std")


def radar(fv: DataFrame) -> DataFrame:
    """V4 + W3: five category means min-max scaled to 0..100 across categories
    (zero range -> 0). The window spans the category aggregate (<= 3 rows)."""
    metrics = ["views", "likes", "comments", "engagement_rate", "views_per_day"]
    agg = fv.where(F.col(CAT).isNotNull()).groupBy(CAT).agg(
        mean_of_int("views").alias("views"), mean_of_int("likes").alias("likes"),
        mean_of_int("comments").alias("comments"),
        F.avg("engagement_rate").alias("engagement_rate"),
        F.avg("views_per_day").alias("views_per_day"))
    w = Window.partitionBy()
    out = [CAT]
    for m in metrics:
        lo, hi = F.min(m).over(w), F.max(m).over(w)
        out.append(F.when(hi - lo != 0, (F.col(m) - lo) / (hi - lo) * 100).otherwise(F.lit(0.0)).alias(m))
    return agg.select(*out)


def top_channels(fc: DataFrame, n: int = 10) -> DataFrame:
    """Top ``n`` channels by total views (ties: lower channel_id first)."""
    return (fc.orderBy(F.col("total_views").desc(), F.col("channel_id").asc()).limit(n)
            .select("channel_id", "channel_name", "total_views"))


def top_videos(fv: DataFrame, n: int = 20, as_text: bool = False) -> DataFrame:
    """Top ``n`` videos by views (ties: lower video_id first). With
    ``as_text`` the counts become short text and the rate ``x.xx%`` - formatted
    after the limit, on ``n`` rows only."""
    top = (fv.orderBy(F.col("views").desc(), F.col("video_id").asc()).limit(n)
           .select("video_id", "title", "channel_name", "views", "likes", "comments",
                   "engagement_rate", CAT))
    if not as_text:
        return top
    return top.select("video_id", "title", "channel_name",
                      short_number("views").alias("views"), short_number("likes").alias("likes"),
                      short_number("comments").alias("comments"),
                      percent_text("engagement_rate").alias("engagement_rate"), CAT)


def frequency_vs_performance(fc: DataFrame, n: int = 10) -> DataFrame:
    """Top ``n`` channels by mean views, with videos per month."""
    return (fc.orderBy(F.col("avg_views").desc(), F.col("channel_id").asc()).limit(n)
            .select("channel_id", "channel_name", "videos_per_month", "avg_views"))
