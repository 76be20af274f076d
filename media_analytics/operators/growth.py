"""Growth and engagement reports: G1-G7, W1, W2, J6, F8, X3, X6, X7.

Reports per day, month or week list the periods that have videos; with ``every_day`` /
``every_month`` (always for the weeks, which are compared with each other) they list every
period from the first to the last: counts and totals of an empty one are 0, means NULL."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.constants import CATEGORIES, WEEKDAYS
from ..functions.scalar import ntz_literal
from .common import dimension, keep_labels


def fill_periods(agg: DataFrame, period: str, step: str, zero: tuple[str, ...] = ()) -> DataFrame:
    """``agg`` (one row per date ``period``) with a row for every ``step`` ("1 day", "7 days",
    "1 month") from the first to the last; the ``zero`` columns of added rows are 0, others
    NULL. The periods are generated from the two ends, so they number the calendar, not the data."""
    ends = agg.agg(F.min(period).alias("a"), F.max(period).alias("b"))
    spine = ends.where("a IS NOT NULL").select(F.explode(F.sequence("a", "b", F.expr(f"INTERVAL {step}"))).alias(period))
    return spine.join(agg, period, "left").fillna(0, subset=list(zero)).select(*agg.columns)


def engagement_trend(fv: DataFrame, every_day: bool = False) -> DataFrame:
    """G1: mean engagement rate per publish date."""
    daily = (fv.where(F.col("publish_date").isNotNull())
             .groupBy(F.to_date("publish_date").alias("publish_date"))
             .agg(F.avg("engagement_rate").alias("engagement_rate")))
    return fill_periods(daily, "publish_date", "1 day") if every_day else daily


def views_by_category(fv: DataFrame) -> DataFrame:
    """G2 + W1: total views per performance category and share of all views (%).

    The window runs over the aggregate (at most three rows), never raw rows."""
    agg = (fv.where(F.col("performance_category").isNotNull())
           .groupBy("performance_category")
           .agg(F.sum("views").cast("bigint").alias("views")))
    total = F.sum("views").over(Window.partitionBy())
    return agg.select("performance_category", "views",
                      F.coalesce(F.try_divide(F.col("views").cast("double"), total.cast("double")) * 100,
                                 F.lit(0.0)).alias("share_pct"))


def monthly_growth(fv: DataFrame, every_month: bool = False) -> DataFrame:
    """Views and videos per calendar month (a DATE, first of month)."""
    monthly = (fv.where(F.col("publish_date").isNotNull())
               .groupBy(F.trunc(F.to_date("publish_date"), "MM").alias("month"))
               .agg(F.sum("views").cast("bigint").alias("views"),
                    F.count("video_id").alias("videos")))
    return fill_periods(monthly, "month", "1 month", ("views", "videos")) if every_month else monthly


def histogram(df: DataFrame, column: str, bins: int = 30) -> DataFrame:
    """``bins`` equal-width bins from min to max, last bin closed; all bins
    listed (zero counts kept). The grid and the counts hold ``bins`` rows."""
    x = F.col(column).cast("double")
    vals = df.select(x.alias("x")).where(F.col("x").isNotNull() & ~F.isnan("x"))
    stats = vals.agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.count(F.lit(1)).alias("n"))
    stats = stats.select("lo", "n", ((F.col("hi") - F.col("lo")) / bins).alias("w"))
    b = F.when(F.col("w") == 0, F.lit(0)).otherwise(
        F.least(F.floor((F.col("x") - F.col("lo")) / F.col("w")), F.lit(bins - 1))).cast("int")
    counts = (vals.crossJoin(F.broadcast(stats)).select(b.alias("bin"))
              .groupBy("bin").agg(F.count(F.lit(1)).alias("videos")))
    grid = stats.where(F.col("n") > 0).select(
        F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"), "lo", "w")
    return (grid.join(F.broadcast(counts), "bin", "left")
            .select("bin",
                    (F.col("lo") + F.col("bin") * F.col("w")).alias("bin_start"),
                    (F.col("lo") + (F.col("bin") + 1) * F.col("w")).alias("bin_end"),
                    F.coalesce(F.col("videos"), F.lit(0)).cast("bigint").alias("videos")))


def engagement_histogram(fv: DataFrame, bins: int = 30) -> DataFrame:
    return histogram(fv, "engagement_rate", bins)


def engagement_by_weekday(fv: DataFrame) -> DataFrame:
    """G6 + J6: mean engagement Monday..Sunday; a day without videos is NULL."""
    agg = (fv.where(F.col("publish_day").isNotNull()).groupBy("publish_day")
           .agg(F.avg("engagement_rate").alias("engagement_rate")))
    dim = dimension(fv.sparkSession, "publish_day", WEEKDAYS, "day_order")
    return keep_labels(dim, agg, "publish_day").select("publish_day", "day_order", "engagement_rate")


def driver_points(fv: DataFrame, sample_fraction: float | None = None, seed: int = 42) -> DataFrame:
    """G7 + W2: per-video points (views, engagement, likes, category, title,
    channel) with a marker size sqrt(views / category max) * 20 + 4.

    The category maximum is a group-by (partial aggregation, three rows) joined
    back by broadcast - not a window, which would put each category, possibly
    a third of all rows, into one task. ``sample_fraction`` is for drawing only.
    """
    cat = "performance_category"
    v = fv.where(F.col(cat).isin(CATEGORIES))
    if sample_fraction is not None:
        v = v.sample(fraction=sample_fraction, seed=seed)
    mx = fv.where(F.col(cat).isin(CATEGORIES)).groupBy(cat).agg(F.max("views").alias("vmax"))
    vmax = F.when(F.col("vmax") == 0, F.lit(1)).otherwise(F.col("vmax")).cast("double")
    return (v.join(F.broadcast(mx), cat)  # bounded: one row per category
            .select("video_id", "title", "channel_name", cat, "views", "likes", "engagement_rate",
                    "duration_minutes",
                    (F.sqrt(F.col("views").cast("double") / vmax) * 20 + 4).alias("marker_size")))


def driver_sample(fv: DataFrame, per_category: int) -> DataFrame:
    """G7 for drawing: of each category the ``per_category`` videos with the least md5 of
    their id (equal ids: fewest views first), the same ones however the table is partitioned.
    Spark keeps that many rows per task and category before the shuffle."""
    points = driver_points(fv)
    order = Window.partitionBy("performance_category").orderBy(F.md5(F.col("video_id").cast("string")).asc_nulls_last(),
                                                               *[F.col(c) for c in points.columns if c != "video_id"])
    return (points.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= per_category).drop("_rank"))


def duration_trend(fv: DataFrame, points: int = 100) -> DataFrame:
    """G5 + F8: least-squares line of engagement on duration over finite rows
    (needs more than one), evaluated at ``points`` evenly spaced durations."""
    x, y = F.col("duration_minutes").cast("double"), F.col("engagement_rate").cast("double")
    finite = x.isNotNull() & ~F.isnan(x) & y.isNotNull() & ~F.isnan(y)
    s = fv.where(finite).agg(F.count(F.lit(1)).alias("n"),
                             F.regr_slope(y, x).alias("slope"),
                             F.regr_intercept(y, x).alias("intercept"),
                             F.min(x).alias("lo"), F.max(x).alias("hi"))
    step = (F.col("hi") - F.col("lo")) / (points - 1)
    g = s.where(F.col("n") > 1).select(
        F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("point"),
        "slope", "intercept", "lo", "hi", step.alias("step"))
    xs = F.when(F.col("point") == points - 1, F.col("hi")).otherwise(F.col("point") * F.col("step") + F.col("lo"))
    g = g.select("point", "slope", "intercept", xs.alias("duration_minutes"))
    return g.select("point", "duration_minutes",
                    (F.col("slope") * F.col("duration_minutes") + F.col("intercept")).alias("engagement_rate"),
                    "slope", "intercept")


def views_engagement_corr(fv: DataFrame) -> DataFrame:
    """Pearson correlation of views and engagement rate."""
    return fv.agg(F.count(F.lit(1)).alias("videos"),
                  F.corr(F.col("views").cast("double"), F.col("engagement_rate")).alias("corr_views_engagement"))


def week_over_week(v: DataFrame) -> DataFrame:
    """Weekly views, videos and mean engagement with change vs the previous
    week (%, NULL for the first week or a zero base). Weeks without videos are listed
    with 0, so the previous row is always the week before.

    ``lag`` runs on the weekly aggregate (about 52 rows a year), not on videos.
    """
    weekly = (v.where(F.col("publish_date").isNotNull())
              .groupBy(F.to_date(F.date_trunc("week", "publish_date")).alias("week"))
              .agg(F.sum("views").cast("bigint").alias("views"),
                   F.count("video_id").alias("videos"),
                   F.avg("engagement_rate").alias("engagement_rate")))
    weekly = fill_periods(weekly, "week", "7 days", ("views", "videos"))
    w = Window.orderBy("week")
    prev_v = F.lag("views").over(w)
    prev_n = F.lag("videos").over(w)
    return weekly.select(
        "week", "views", "videos", "engagement_rate",
        (F.try_divide(F.col("views").cast("double"), prev_v.cast("double")) * 100 - 100).alias("views_change_pct"),
        (F.try_divide(F.col("videos").cast("double"), prev_n.cast("double")) * 100 - 100).alias("videos_change_pct"),
    )


def last_days(v: DataFrame, days: int = 90, as_of: datetime | None = None) -> DataFrame:
    """Videos published in the ``days`` days up to ``as_of`` (inclusive of
    that day). Without ``as_of`` the window ends at the latest publish date."""
    if as_of is not None:
        start = (as_of.date() if isinstance(as_of, datetime) else as_of) - timedelta(days=days)
        end = (as_of.date() if isinstance(as_of, datetime) else as_of) + timedelta(days=1)
        v = v.where((F.col("publish_date") >= ntz_literal(start)) & (F.col("publish_date") < ntz_literal(end)))
        if "publish_year" in v.columns:  # implied; prunes folders of a partitioned table
            v = v.where((F.col("publish_year") >= start.year) & (F.col("publish_year") <= end.year))
        return v
    # one value, read first (min / max come from parquet footers where these are kept):
    # the window is then a literal range that the scan can push down and prune by
    last = v.agg(F.max("publish_date")).first()[0]
    return v.where(F.lit(False)) if last is None else last_days(v, days, last)
