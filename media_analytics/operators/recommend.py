"""Recommendations and benchmarks: R1-R7, T4, F7."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.constants import BENCHMARK_METRICS, DURATION_EDGES, DURATION_LABELS_SHORT, FREQUENCY_EDGES
from ..functions.scalar import bucket_order, cut, ratio_or_null
from .filters import above_quantile
from .quantiles import approx_quantiles, multi_exact_quantiles, quantiles
from .rollup import mean_of_int


def table_quantiles(df: DataFrame, spec: dict, approx: bool) -> dict:
    """Quantiles of several columns of one table (shared passes when exact)."""
    if approx:
        return {c: approx_quantiles(df, c, ps) for c, ps in spec.items()}
    return multi_exact_quantiles(df, spec)


def best_group(df: DataFrame, key: Column | str, metric: Column, name: str,
               tie: Column | str | None = None) -> DataFrame:
    """T4: the group with the highest mean (NULL means ignored); ties go to the
    first key in ``tie`` order (default: the key itself). One row or none.

    ``orderBy(...).limit(1)`` plans as a top-1 per partition plus a final top-1:
    no shuffle of the groups."""
    k = F.col(key) if isinstance(key, str) else key
    t = k if tie is None else (F.col(tie) if isinstance(tie, str) else tie)
    g = (df.select(k.alias(name), t.alias("_tie"), metric.alias("_m"))
         .where(F.col(name).isNotNull())
         .groupBy(name, "_tie").agg(F.avg("_m").alias("_mean"))
         .where(F.col("_mean").isNotNull()))
    return g.orderBy(F.col("_mean").desc(), F.col("_tie").asc()).limit(1).select(name)


def best_video_groups(fv: DataFrame) -> DataFrame:
    """R1-R3 in one scan: mean views per duration bucket, per publish hour and
    per weekday as GROUPING SETS (partial aggregation, one shuffle of at most
    5 + 24 + 7 groups), then the argmax of each set (first key on ties) over
    those few rows. One row: best_duration, best_hour, best_day."""
    views = F.col("views").cast("double")
    base = fv.select(cut("duration_minutes", DURATION_EDGES, DURATION_LABELS_SHORT).alias("best_duration"),
                     bucket_order("duration_minutes", DURATION_EDGES).alias("_d_order"),
                     F.col("publish_hour").alias("best_hour"), F.col("publish_day").alias("best_day"),
                     views.alias("_m"))
    sets = [["best_duration", "_d_order"], ["best_hour"], ["best_day"]]
    g = (base.groupingSets(sets, "best_duration", "_d_order", "best_hour", "best_day")
         .agg(F.avg("_m").alias("_mean"),
              F.grouping("best_duration").alias("_gd"), F.grouping("best_hour").alias("_gh"),
              F.grouping("best_day").alias("_gw")))
    which = (F.when(F.col("_gd") == 0, F.lit("d")).when(F.col("_gh") == 0, F.lit("h")).otherwise(F.lit("w")))
    key_null = (F.when(which == "d", F.col("best_duration").isNull())
                .when(which == "h", F.col("best_hour").isNull()).otherwise(F.col("best_day").isNull()))
    tie_num = F.when(which == "d", F.col("_d_order")).when(which == "h", F.col("best_hour"))
    g = g.withColumn("_set", which).where(~key_null & F.col("_mean").isNotNull())
    w = Window.partitionBy("_set").orderBy(F.col("_mean").desc(), tie_num.asc(), F.col("best_day").asc())
    top = g.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") == 1)  # <= 36 rows in all
    return top.agg(F.max(F.when(F.col("_set") == "d", F.col("best_duration"))).alias("best_duration"),
                   F.max(F.when(F.col("_set") == "h", F.col("best_hour"))).alias("best_hour"),
                   F.max(F.when(F.col("_set") == "w", F.col("best_day"))).alias("best_day"))


def recommendations(fv: DataFrame, fc: DataFrame, approx: bool = False) -> DataFrame:
    """R1-R6 as one row: best duration bucket, hour and weekday (one grouping-
    sets scan) and posting frequency by mean views; engagement target and title length; q75 targets
    of engagement, like rate and channel engagement score; what top-quartile
    channels (engagement score above its q75) achieve."""
    best_videos = best_video_groups(fv)
    best_freq = best_group(fc, cut("videos_per_month", FREQUENCY_EDGES), F.col("avg_views"),
                           "best_frequency", bucket_order("videos_per_month", FREQUENCY_EDGES))
    qv = table_quantiles(fv, {"engagement_rate": [0.75], "like_rate": [0.75]}, approx)
    eng_q75, lr_q75 = qv["engagement_rate"][0], qv["like_rate"][0]
    top, score_q75 = above_quantile(fc, "engagement_score", 0.75, approx=approx)
    means = fv.agg(F.avg("engagement_rate").alias("target_engagement"),
                   mean_of_int("title_length").alias("avg_title_length"))
    top = top.agg(F.avg("views_per_subscriber").alias("top_views_per_subscriber"),
                  F.avg("videos_per_month").alias("top_videos_per_month"))
    row = means.crossJoin(top).crossJoin(best_videos)  # one-row frames
    row = row.join(best_freq, F.lit(True), "left")  # one row or none
    lit = lambda x: F.lit(None).cast("double") if x is None else F.lit(float(x))
    return row.select("best_duration", "best_hour", "best_day", "best_frequency",
                      "target_engagement", "avg_title_length",
                      lit(eng_q75).alias("engagement_q75"), lit(lr_q75).alias("like_rate_q75"),
                      lit(score_q75).alias("engagement_score_q75"),
                      "top_views_per_subscriber", "top_videos_per_month")


def benchmark_index(fv: DataFrame, fc: DataFrame, v: DataFrame, c: DataFrame,
                    approx: bool = False) -> DataFrame:
    """Filtered mean / unfiltered q75 x 100 for five metrics (benchmark 0 -> 0).

    Views over subscribers is NULL for channels without subscribers (P17)."""
    vir = ratio_or_null("views", "ch_subscribers")
    qv = table_quantiles(v.withColumn("_vir", vir),
                         {"views": [0.75], "engagement_rate": [0.75], "like_rate": [0.75], "_vir": [0.75]}, approx)
    q_views, q_eng, q_lr, q_vir = (qv[k][0] for k in ("views", "engagement_rate", "like_rate", "_vir"))
    q_vpm = quantiles(c, "videos_per_month", [0.75], approx=approx)[0]
    bench = [q_views, q_eng, q_lr, q_vpm, None if q_vir is None else q_vir * 100]
    yours = fv.agg(mean_of_int("views").alias("m0"), F.avg("engagement_rate").alias("m1"),
                   F.avg("like_rate").alias("m2"), (F.avg(vir) * 100).alias("m4")).crossJoin(
        fc.agg(F.avg("videos_per_month").alias("m3")))
    parts = []
    for i, name in enumerate(BENCHMARK_METRICS):
        b = "CAST(NULL AS DOUBLE)" if bench[i] is None else f"CAST({float(bench[i])!r} AS DOUBLE)"
        parts.append(f"'{name}', {i}, CAST(m{i} AS DOUBLE), {b}")
    long = yours.select(F.expr(f"stack(5, {', '.join(parts)}) AS (metric, metric_order, your_value, benchmark_value)"))
    bv = F.col("benchmark_value")
    return long.select(
        "metric", F.col("metric_order").cast("int").alias("metric_order"), "your_value", "benchmark_value",
        F.when(bv.isNotNull() & (bv != 0), F.col("your_value") / bv * 100).otherwise(F.lit(0.0)).alias("performance"),
        F.lit(100.0).alias("benchmark"))
