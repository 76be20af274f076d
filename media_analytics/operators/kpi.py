"""Executive summary (A4, A5) and strategic KPIs.

K1, K2, K4, K5 share one aggregate pass over the videos; K3 needs a per-channel
level first. Every result is one row; nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.constants import KPI_THRESHOLDS
from ..functions.scalar import percent_text, ratio_or_null, short_number
from .rollup import mean_of_int


def executive_summary(fv: DataFrame, fc: DataFrame, v: DataFrame) -> DataFrame:
    """A4 + A5: totals of the filtered videos / channels and deltas against the
    unfiltered baseline (engagement in points, views/day in percent)."""
    f = fv.agg(F.coalesce(F.sum("views"), F.lit(0)).cast("bigint").alias("total_views"),
               F.count(F.lit(1)).alias("total_videos"),
               F.avg("engagement_rate").alias("avg_engagement"),
               F.avg("views_per_day").alias("views_per_day"))
    c = fc.agg(F.count(F.lit(1)).alias("channels"),
               F.coalesce(F.sum("subscribers"), F.lit(0)).cast("bigint").alias("total_subscribers"))
    b = v.agg(F.avg("engagement_rate").alias("baseline_engagement"),
              F.avg("views_per_day").alias("baseline_views_per_day"))
    row = f.crossJoin(c).crossJoin(b)  # three one-row frames
    tv, n = F.col("total_views").cast("double"), F.col("total_videos").cast("double")
    bvpd = F.col("baseline_views_per_day")
    return row.select(
        "total_views", "total_videos",
        F.coalesce(F.try_divide(tv, n), F.lit(0.0)).alias("avg_views_per_video"),
        "avg_engagement", "channels", "total_subscribers",
        F.coalesce(F.try_divide(F.col("total_subscribers").cast("double"),
                                F.col("channels").cast("double")), F.lit(0.0)).alias("avg_subscribers"),
        "views_per_day", "baseline_engagement", "baseline_views_per_day",
        (F.col("avg_engagement") - F.col("baseline_engagement")).alias("delta_engagement"),
        F.when((bvpd != 0) & bvpd.isNotNull(),
               (F.col("views_per_day") / bvpd - 1) * 100).otherwise(F.lit(0.0)).alias("delta_views_per_day_pct"),
    )


def summary_text(summary: DataFrame) -> DataFrame:
    """A4 as shown: value and note of the five header metrics."""
    shown = [("Total Views", short_number("total_views"),
              F.concat(short_number("avg_views_per_video"), F.lit(" avg/video"))),
             ("Total Videos", F.format_number("total_videos", 0), F.concat(F.col("channels").cast("string"), F.lit(" channels"))),
             ("Avg Engagement", percent_text("avg_engagement"), percent_text("delta_engagement", signed=True)),
             ("Total Subscribers", short_number("total_subscribers"),
              F.concat(short_number("avg_subscribers"), F.lit(" avg"))),
             ("Views / Day", short_number("views_per_day"), percent_text("delta_views_per_day_pct", 1, signed=True))]
    rows = F.array(*[F.struct(F.lit(name).alias("metric"), value.alias("value"), note.alias("note"))
                     for name, value, note in shown])
    return summary.select(F.inline(rows))


def strategic_kpis(fv: DataFrame) -> DataFrame:
    """K1-K5 as one row (NaN / inf scrubbed to 0, C20)."""
    views = F.col("views").cast("double")
    den = F.col("duration_minutes") * F.col("ch_subscribers").cast("double")
    # K1: inf (x/0, x != 0) counts as 0; 0/0 is skipped
    eff_term = F.when(den == 0, F.when(views != 0, F.lit(0.0))).otherwise(views / den)
    one = fv.agg(
        F.avg(eff_term).alias("eff_mean"),
        F.avg("like_rate").alias("lr_mean"),
        F.avg("comment_rate").alias("cr_mean"),
        F.avg(ratio_or_null("views", "ch_subscribers")).alias("vir_mean"),
        F.max("like_rate").alias("lr_max"),
        F.max("comment_rate").alias("cr_max"),
        F.max("views_per_day").alias("vpd_max"),
        F.avg("views_per_day").alias("vpd_mean"),
    )
    # K3: coefficient of variation per channel name (sample std / mean)
    per_channel = (fv.where(F.col("channel_name").isNotNull())
                   .groupBy("channel_name")
                   .agg(F.stddev_samp("views").alias("sd"), mean_of_int("views").alias("mu"))
                   .select(F.try_divide(F.col("sd"), F.when(F.col("mu") != 0, F.col("mu"))).alias("cv")))
    consistency = per_channel.agg(F.avg("cv").alias("cv_mean"))
    lr_max, cr_max, vpd_max = F.col("lr_max"), F.col("cr_max"), F.col("vpd_max")
    all_max = (lr_max != 0) & (cr_max != 0) & (vpd_max != 0)
    quality = F.when(all_max, 40 * F.col("lr_mean") / lr_max + 30 * F.col("cr_mean") / cr_max
                     + 30 * F.col("vpd_mean") / vpd_max).otherwise(F.lit(0.0))
    return one.crossJoin(consistency).select(
        F.coalesce(F.col("eff_mean") * 1000, F.lit(0.0)).alias("video_efficiency"),
        F.coalesce(F.col("lr_mean") * 0.5 + F.col("cr_mean") * 100 * 0.5, F.lit(0.0)).alias("interaction_score"),
        F.coalesce(100 - F.col("cv_mean"), F.lit(0.0)).alias("consistency"),
        F.coalesce(F.col("vir_mean") * 100, F.lit(0.0)).alias("virality_index"),
        F.coalesce(quality, F.lit(0.0)).alias("quality_score"),
    )


def kpi_ratings(kpis: DataFrame) -> DataFrame:
    """Each KPI against its published "good" threshold, one row per KPI."""
    names = list(KPI_THRESHOLDS)
    pairs = ", ".join(f"'{k}', CAST(`{k}` AS DOUBLE), CAST({KPI_THRESHOLDS[k]} AS DOUBLE)" for k in names)
    long = kpis.select(F.expr(f"stack({len(names)}, {pairs}) AS (kpi, value, threshold)"))
    return long.select("kpi", "value", "threshold",
                       (F.col("value") >= F.col("threshold")).alias("meets_threshold"))
