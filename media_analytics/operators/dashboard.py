"""All grouped reports of one filter from a single scan.

The reports G1, G2, G3, G6, V1, V2, V4 and H1-H4 group the same filtered videos by different
keys. ``report_groups`` aggregates them together by grouping sets: a task reads its videos
once, fans each out to the sets and combines them before the shuffle, so a hot key costs
one row per task. Its result has a row per day, month, label or (hour, weekday), whatever
the number of videos. ``fan_out`` cuts the reports from it, with the rows that the
operators of their own give.

Videos with a missing key are in no row of that key's reports, as there; of no videos
at all, reports over fixed labels list them (counts 0, means NULL) and the others are empty.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.constants import CATEGORIES, DURATION_EDGES, DURATION_LABELS, TITLE_EDGES, TITLE_LABELS, WEEKDAYS
from ..functions.scalar import cut
from .common import dimension, keep_labels
from .performance import CAT
from .rollup import mean_of_int

KEYS = ("day", "month", "publish_day", "publish_hour", "posting_period", CAT, "duration_bucket", "title_bucket")
SETS = (*((k,) for k in KEYS if k != "publish_hour"), ("publish_hour", "publish_day"), ())
RADAR = ("views", "likes", "comments", "engagement_rate", "views_per_day")


def _grouping(keys: tuple[str, ...]) -> int:
    """The ``grouping_id`` of a set: a bit for each key that it leaves out, the first key highest."""
    return sum(1 << (len(KEYS) - 1 - i) for i, k in enumerate(KEYS) if k not in keys)


def report_groups(fv: DataFrame) -> DataFrame:
    """(grouping, keys, rows, videos, views, means) of every set in ``SETS`` over ``fv``."""
    day = F.to_date("publish_date")
    keyed = fv.select(day.alias("day"), F.trunc(day, "MM").alias("month"), "publish_day", "publish_hour",
                      "posting_period", CAT, cut("duration_minutes", DURATION_EDGES, DURATION_LABELS).alias("duration_bucket"),
                      cut("title_length", TITLE_EDGES, TITLE_LABELS).alias("title_bucket"),
                      "video_id", *RADAR)
    return keyed.groupingSets([list(s) for s in SETS], *KEYS).agg(
        F.grouping_id().alias("grouping"), F.count(F.lit(1)).alias("rows"), F.count("video_id").alias("videos"),
        F.sum("views").cast("bigint").alias("views_sum"),
        *[mean_of_int(c).alias(f"{c}_mean") for c in RADAR[:3]],
        *[F.avg(c).alias(f"{c}_mean") for c in RADAR[3:]])


def fan_out(groups: DataFrame) -> dict[str, DataFrame]:
    """The reports by the name of their own operators, from (written) ``report_groups``."""
    spark = groups.sparkSession

    def rows(*keys: str) -> DataFrame:
        return groups.where((F.col("grouping") == _grouping(keys)) & (F.col(keys[0]).isNotNull() if keys else F.lit(True)))

    def labelled(key: str, labels: list, order: str) -> DataFrame:
        return keep_labels(dimension(spark, key, labels, order), rows(key), key)

    mean = {c: F.col(f"{c}_mean").alias(c) for c in RADAR}
    day = F.col("day").alias("publish_date")
    videos = F.coalesce("videos", F.lit(0))
    every = rows().agg(F.coalesce(F.max("rows"), F.lit(0)).alias("total"))
    counted = F.coalesce("rows", F.lit(0)).cast("bigint")
    share = F.try_divide(counted.cast("double"), F.col("total").cast("double")) * 100
    all_views = F.sum("views_sum").over(Window.partitionBy())  # over one row per category
    views_share = F.try_divide(F.col("views_sum").cast("double"), all_views.cast("double")) * 100

    def scaled(c: str):
        x, w = F.col(f"{c}_mean"), Window.partitionBy()
        span = F.max(x).over(w) - F.min(x).over(w)
        return F.when(span != 0, (x - F.min(x).over(w)) / span * 100).otherwise(F.lit(0.0)).alias(c)

    return {
        "engagement_trend": rows("day").select(day, mean["engagement_rate"]),
        "publishing_calendar": rows("day").select(day, videos.alias("videos")),
        "monthly_growth": rows("month").select("month", F.col("views_sum").alias("views"), videos.alias("videos")),
        "engagement_by_weekday": labelled("publish_day", WEEKDAYS, "day_order")
        .select("publish_day", "day_order", mean["engagement_rate"]),
        "period_performance": rows("posting_period").select("posting_period", mean["views"], mean["engagement_rate"]),
        "views_by_category": rows(CAT).select(CAT, F.col("views_sum").alias("views"),
                                              F.coalesce(views_share, F.lit(0.0)).alias("share_pct")),
        "category_mix": labelled(CAT, CATEGORIES, "category_order").crossJoin(F.broadcast(every))  # one row
        .select(CAT, "category_order", counted.alias("videos"), F.coalesce(share, F.lit(0.0)).alias("pct")),
        "radar": rows(CAT).select(CAT, *[scaled(c) for c in RADAR]),
        "views_by_duration": labelled("duration_bucket", DURATION_LABELS, "bucket_order")
        .select("duration_bucket", "bucket_order", mean["views"]),
        "views_by_title_length": labelled("title_bucket", TITLE_LABELS, "bucket_order")
        .select("title_bucket", "bucket_order", mean["views"]),
        "publish_heatmap": rows("publish_hour", "publish_day").groupBy("publish_hour")
        .pivot("publish_day", WEEKDAYS).agg(F.max("views_mean")),
    }


def dashboard_rows(groups: DataFrame) -> DataFrame:
    """All reports as rows (report, item, measure, value), for one read of the whole dashboard."""
    order = {"day_order", "category_order", "bucket_order"}

    def long(name: str, df: DataFrame) -> DataFrame:
        key, *rest = [c for c in df.columns if c not in order]
        pairs = F.array(*[F.struct(F.lit(c).alias("measure"), F.col(c).cast("double").alias("value")) for c in rest])
        return (df.select(F.lit(name).alias("report"), F.col(key).cast("string").alias("item"), F.explode(pairs).alias("p"))
                .select("report", "item", "p.measure", "p.value"))

    return reduce(DataFrame.union, [long(name, df) for name, df in fan_out(groups).items()])
