"""Registered queries: each takes (spark, sf_dir) and returns a DataFrame.

All queries share one prepared context per (session, folder): the videos with
all measures and the channel rollup, written as Parquet to the shared checkpoint
folder when a query first reads them. The videos are partitioned by ``publish_year``, so date filters
skip folders and push ranges into the scan, a report reads only its columns, and a
lost executor costs no recomputation. Reports run over the whole tables.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

from ..functions.constants import CATEGORIES
from ..operators import bucketed, dashboard, enrich, evaluate, filters, growth, kpi, performance, predict
from ..operators import quality, recommend, rollup, state, strategy
from ..operators.common import literal_rows
from ..operators.quantiles import quantile_table
from ..session import ensure_checkpoint_dir
from ..sources import files, pages, testviews
from ..sources.testviews import AS_OF, test_channel_table, test_video_keys, test_video_table
from . import refresh

# fixed values: the filter used by the filtered-report queries
REPORT_SPEC = filters.FilterSpec(start=date(1997, 1, 1), end=date(1999, 12, 31),
                                 categories=("High", "Medium"))
# fixed values: the channels and dates of the by-channel queries
CHANNEL_SPEC = filters.FilterSpec(start=date(1996, 3, 1), end=date(2000, 6, 30),
                                  channels=tuple(f"Customer#{k:09d}" for k in (1, 2, 4, 7, 11, 50, 100, 149)))
DRAWN_POINTS = 150  # of each category
QUANTILE_COLUMNS = ["views", "engagement_rate", "like_rate", "views_per_day", "duration_minutes"]
QUANTILE_PROBS = [0.1, 0.25, 0.5, 0.75, 0.9]
# few distinct values, searched with a small candidate limit: every round of the search runs
DEEP_COLUMNS = ["publish_hour", "title_length", "views", "engagement_rate", "duration_minutes"]
DEEP_CANDIDATES = 200


@dataclass
class Context:
    spark: SparkSession
    channel_attrs: DataFrame
    folder: str | None = None
    source: str = ""
    _base: DataFrame | None = None
    _thresholds: tuple | None = None
    _channels: DataFrame | None = None
    _features: DataFrame | None = None
    _models: dict | None = None
    _dirty_videos: DataFrame | None = None
    _dirty_channels: DataFrame | None = None
    _refreshed: str | None = None
    _checked: bool = False
    _bucketed: bucketed.BucketedTables | None = None

    @property
    def base(self) -> DataFrame:
        """Typed videos with channel attributes and all measures but the category."""
        if self._base is None:
            typed = enrich.attach_channel(test_video_table(self.spark, self.source, SPREAD), self.channel_attrs,
                                          how="left", key_source=test_video_keys(self.spark, self.source))
            self._base = self.keep_measured(typed, "videos")
        return self._base

    @property
    def thresholds(self) -> tuple:
        """(q25, q75) of views."""
        if self._thresholds is None:
            self._thresholds = enrich.category_thresholds(self.base)
        return self._thresholds

    @property
    def videos(self) -> DataFrame:
        """Enriched videos (dashboard semantics)."""
        return _enriched(self.base, self.thresholds)

    @property
    def channels(self) -> DataFrame:
        """Rollup and metrics."""
        if self._channels is None:
            self._channels = self.keep(rollup.rollup_channels(self.videos, self.channel_attrs, AS_OF), "channels")
        return self._channels

    @property
    def bucketed(self) -> bucketed.BucketedTables:
        """The raw videos and the channels in buckets of the channel."""
        if self._bucketed is None:
            tag = uuid.uuid4().hex
            root = f"{self.folder or ensure_checkpoint_dir(self.spark).rstrip('/')}/bucketed-{tag}"
            buckets = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
            raw = self.typed.drop("channel_name", "ch_subscribers", "channel_created")
            self._bucketed = bucketed.store_bucketed(raw, self.channel_attrs, root, f"media_{tag}", buckets)
        return self._bucketed

    @property
    def typed(self) -> DataFrame:
        """Videos with channel attributes, before enrichment."""
        return self.base.select(*TYPED_COLUMNS)

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """Write a shared table once and read it back (``PERSIST`` off: leave it in the plan)."""
        return df if self.folder is None else _written(df, f"{self.folder}/{name}", None)

    def keep_measured(self, typed: DataFrame, name: str) -> DataFrame:
        """``keep`` for typed videos, with their measures and in a folder per year."""
        keyed = typed.withColumn("publish_year", F.year("publish_date"))
        return _measured(keyed) if self.folder is None else _written(keyed, f"{self.folder}/{name}", "publish_year", _measured)

    @property
    def features(self) -> DataFrame:
        """M0 feature table, shared by the model and metric queries."""
        if self._features is None:
            self._features = self.keep(predict.build_features(self.fv, self.channels), "features")
        return self._features

    def model(self, kind: str) -> predict.FittedModel:
        """The fitted forest of one kind (virality / category / views), fitted
        once per context and shared by its prediction, importance and metric
        queries."""
        if self._models is None:
            self._models = {}
        if kind not in self._models:
            fit = {"virality": predict.fit_virality, "category": predict.fit_category,
                   "views": predict.fit_views}[kind]
            self._models[kind] = fit(self.features)
        return self._models[kind]

    @property
    def fv(self) -> DataFrame:
        """The dashboard's default filter: all dates, channels and categories. The
        channel table is the rollup of these videos, so "all channels" is every
        video with a channel name. Reports stop with an error if that is none (S7,
        looked up once)."""
        fv = filters.apply_filters(self.videos, filters.FilterSpec())
        if not self._checked:
            filters.require_rows(fv, "videos match the filters")
            self._checked = True
        return fv

    @property
    def fc(self) -> DataFrame:
        return filters.apply_channel_filter(self.channels, filters.FilterSpec())

    @property
    def dirty_videos(self) -> DataFrame:
        """Videos of the view with faults: unmatched and missing channels, missing dates,
        missing and repeated ids, categories that are no label."""
        if self._dirty_videos is None:
            typed = enrich.attach_channel(testviews.dirty_video_table(self.spark, self.source, SPREAD),
                                          self.channel_attrs, how="left")
            base = self.keep_measured(typed, "dirty")
            self._dirty_videos = testviews.dirty_category(_enriched(base, enrich.category_thresholds(base)))
        return self._dirty_videos

    @property
    def dirty(self) -> tuple[DataFrame, DataFrame]:
        """(videos, channels) of the view with faults."""
        if self._dirty_channels is None:
            self._dirty_channels = self.keep(rollup.rollup_channels(self.dirty_videos, self.channel_attrs, AS_OF),
                                             "dirty_channels")
        return self.dirty_videos, self._dirty_channels

    @property
    def refreshed(self) -> str:
        """Root of the tables after two fetches (``plans.refresh``): the first lacks some videos
        and has older counters and dates of others, the second brings them up to the test views."""
        if self._refreshed is None:
            root = f"{self.folder or ensure_checkpoint_dir(self.spark).rstrip('/')}/refreshed-{uuid.uuid4().hex}"
            for fetch in (1, 2):
                rows = testviews.fetched_videos(self.typed, fetch)
                refresh.refresh(root, enrich.with_time_and_rates(rows, AS_OF).select(
                    "fetched_at", *[c for c in enrich.VIDEO_COLUMNS if c != "performance_category"]), ["fetched_at"])
            self._refreshed = root
        return self._refreshed


_CONTEXTS: dict[tuple[int, str], Context] = {}
# PERSIST = False rebuilds the shared tables inside every plan, for inspecting
# whole plans from the raw tables.
PERSIST = True
# Tasks over which the one-file test tables are dealt (None: as the scan comes).
SPREAD: int | None = None
# Order inside the files of a year: a channel's rows lie together, so the least and largest
# name and the Bloom filter of a row group tell whether it can hold a channel.
SORTED = ("channel_name", "views")
TYPED_COLUMNS = ["channel_id", "video_id", "title", "publish_date", "duration_minutes", "views", "likes", "comments",
                 "channel_name", "ch_subscribers", "channel_created"]


def _dealt(df: DataFrame, partition_by: str, measures: Callable | None = None) -> DataFrame:
    """Rows moved by ``partition_by``: a few files of good size per folder, as AQE merges small partitions
    and splits large ones, instead of a file per task and folder. ``measures`` adds its columns after the move."""
    rows = df.hint("rebalance", partition_by)
    return measures(rows) if measures else rows


def _measured(rows: DataFrame) -> DataFrame:
    return enrich.with_time_and_rates(rows.drop("publish_year"), AS_OF)


def _written(df: DataFrame, path: str, partition_by: str | None, measures: Callable | None = None) -> DataFrame:
    if partition_by:
        df = _dealt(df, partition_by, measures)
        (df.sortWithinPartitions(partition_by, *SORTED).write.mode("overwrite")
         .option("parquet.bloom.filter.enabled#channel_name", "true").partitionBy(partition_by).parquet(path))
    else:
        df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path).select(*df.columns)


def _enriched(base: DataFrame, thresholds: tuple) -> DataFrame:
    return enrich.categorize(base, thresholds=thresholds).select(*enrich.VIDEO_COLUMNS)


def context(spark: SparkSession, sf_dir: str) -> Context:
    key = (id(spark), sf_dir)
    ctx = _CONTEXTS.get(key)
    if ctx is not None and ctx.spark is spark:
        return ctx
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/media-{uuid.uuid4().hex}" if PERSIST else None
    _CONTEXTS[key] = Context(spark, test_channel_table(spark, sf_dir, AS_OF), folder, sf_dir)
    return _CONTEXTS[key]


def release(spark: SparkSession | None = None) -> None:
    """Forget prepared contexts (all, or one session's): unpersist their predictions and
    delete the shared tables they wrote."""
    for key, ctx in list(_CONTEXTS.items()):
        if spark is None or ctx.spark is spark:
            for m in (ctx._models or {}).values():
                m.predictions.unpersist()
            if ctx._bucketed:
                ctx._bucketed.drop()
            if ctx.folder:
                jvm, conf = ctx.spark._jvm, ctx.spark._jsc.hadoopConfiguration()
                path = jvm.org.apache.hadoop.fs.Path(ctx.folder)
                path.getFileSystem(conf).delete(path, True)
            del _CONTEXTS[key]


def round_doubles(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round floating columns for engine-independent comparison.

    ``round(x * 10^d) / 10^d``: the scaled value is rounded to a whole number,
    which every engine does alike (a decimal-string HALF_UP at ``d`` digits
    and a binary round can disagree on values such as 16.0015625)."""
    scale = float(10 ** digits)
    return df.select(*[(F.round(F.col(f.name) * scale) / scale).alias(f.name)
                       if isinstance(f.dataType, (DoubleType, FloatType)) else F.col(f.name)
                       for f in df.schema.fields])


# ----------------------------------------------------------------------------- queries

def q_enriched_videos(spark, d):
    return context(spark, d).videos


def q_enriched_videos_batch_mode(spark, d):
    ctx = context(spark, d)
    return enrich.enrich_videos(ctx.typed, AS_OF, period_mode="month_third", low_inclusive=False,
                                absolute_age=False, thresholds=ctx.thresholds)


def q_videos_inner_channel(spark, d):
    """J2 on the shared table: the rows whose channel was matched."""
    return context(spark, d).typed.where("channel_name IS NOT NULL")


def q_channel_rollup(spark, d):
    return context(spark, d).channels


def q_channel_rollup_batch_mode(spark, d):
    """A1 as the batch script does it: over batch-semantics videos, subscribers
    and created date taken from the video rows (one value per channel)."""
    return rollup.rollup_channels(q_enriched_videos_batch_mode(spark, d), None, AS_OF)


def q_channel_profile(spark, d):
    return rollup.channel_profile(context(spark, d).channels)


def q_snapshot_profile(spark, d):
    ctx = context(spark, d)
    return filters.snapshot_profile(ctx.videos, ctx.channels)


def q_filtered_profile(spark, d):
    """S6 under filters: the dashboard header (videos, channels, date range of fv)."""
    ctx = context(spark, d)
    return filters.snapshot_profile(*filters.select_report(ctx.videos, ctx.channels, REPORT_SPEC))


def q_filtered_strategic_kpis(spark, d):
    """K1-K5 over the filtered videos."""
    ctx = context(spark, d)
    return kpi.strategic_kpis(filters.select_report(ctx.videos, ctx.channels, REPORT_SPEC)[0])


def q_filter_domain(spark, d):
    ctx = context(spark, d)
    return filters.filter_domain(ctx.videos, ctx.channels)


def q_filtered_videos(spark, d):
    return filters.apply_filters(context(spark, d).videos, REPORT_SPEC)


def q_filtered_channels(spark, d):
    return filters.apply_channel_filter(context(spark, d).channels, CHANNEL_SPEC)


def q_filtered_by_channel(spark, d):
    """F2 + F4: a date range and named channels."""
    return filters.apply_filters(context(spark, d).videos, CHANNEL_SPEC)


def q_executive_summary(spark, d):
    ctx = context(spark, d)
    fv, fc = filters.select_report(ctx.videos, ctx.channels, REPORT_SPEC)
    return kpi.executive_summary(fv, fc, ctx.videos)


def q_executive_summary_text(spark, d):
    """A4 as the header shows it: short numbers, percentages and signed changes."""
    return kpi.summary_text(q_executive_summary(spark, d))


def q_strategic_kpis(spark, d):
    return kpi.strategic_kpis(context(spark, d).fv)


def q_kpi_ratings(spark, d):
    return kpi.kpi_ratings(kpi.strategic_kpis(context(spark, d).fv))


def q_engagement_trend(spark, d):
    return growth.engagement_trend(context(spark, d).fv)


def q_views_by_category(spark, d):
    return growth.views_by_category(context(spark, d).fv)


def q_monthly_growth(spark, d):
    return growth.monthly_growth(context(spark, d).fv)


def q_engagement_histogram(spark, d):
    return growth.engagement_histogram(context(spark, d).fv)


def q_engagement_by_weekday(spark, d):
    return growth.engagement_by_weekday(context(spark, d).fv)


def q_driver_points(spark, d):
    return growth.driver_points(context(spark, d).fv)


def q_driver_points_sample(spark, d):
    return growth.driver_sample(context(spark, d).fv, DRAWN_POINTS)


def q_dirty_driver_points_sample(spark, d):
    """Videos without an id are left out before the filters, which fill a missing number with 0."""
    videos, channels = context(spark, d).dirty
    with_id = videos.where("video_id IS NOT NULL")
    return growth.driver_sample(filters.apply_filters(with_id, filters.FilterSpec(), channels), DRAWN_POINTS)


def q_duration_trend(spark, d):
    return growth.duration_trend(context(spark, d).fv)


def q_category_mix(spark, d):
    return performance.category_mix(context(spark, d).fv)


def q_views_by_duration(spark, d):
    return performance.views_by_duration(context(spark, d).fv)


def q_views_distribution(spark, d):
    return performance.views_distribution(context(spark, d).fv)


def q_radar(spark, d):
    return performance.radar(context(spark, d).fv)


def q_publish_heatmap(spark, d):
    return strategy.publish_heatmap(context(spark, d).fv)


def q_period_performance(spark, d):
    return strategy.period_performance(context(spark, d).fv)


def q_views_by_title_length(spark, d):
    return strategy.views_by_title_length(context(spark, d).fv)


def q_publishing_calendar(spark, d):
    return strategy.publishing_calendar(context(spark, d).fv)


def q_top_channels(spark, d):
    return performance.top_channels(context(spark, d).fc)


def q_top_videos(spark, d):
    return performance.top_videos(context(spark, d).fv)


def q_frequency_vs_performance(spark, d):
    return performance.frequency_vs_performance(context(spark, d).fc)


def q_quantile_table(spark, d):
    return quantile_table(context(spark, d).videos, QUANTILE_COLUMNS, QUANTILE_PROBS)


def q_quantile_table_deep(spark, d):
    """Q1 through all its rounds: columns of few values, a small candidate limit."""
    return quantile_table(context(spark, d).videos, DEEP_COLUMNS, QUANTILE_PROBS, max_candidates=DEEP_CANDIDATES)


def _features(spark, d):
    return context(spark, d).features


def q_ml_features(spark, d):
    return _features(spark, d)


def q_ml_split(spark, d):
    f = _features(spark, d)
    return f.select("video_id", predict.test_flag("video_id").alias("is_test"))


def q_viral_label(spark, d):
    return predict.viral_label(_features(spark, d)).select("video_id", "views_per_subscriber", "is_viral")


def q_virality_model(spark, d):
    return context(spark, d).model("virality").predictions


def q_category_model(spark, d):
    return context(spark, d).model("category").predictions


def q_views_model(spark, d):
    return context(spark, d).model("views").predictions


# M8 / T5: importance tables, sorted as the reference charts them
def q_virality_importances(spark, d):
    return context(spark, d).model("virality").importances(ascending=True)


def q_category_importances(spark, d):
    return context(spark, d).model("category").importances(ascending=False)


def q_views_importances(spark, d):
    return context(spark, d).model("views").importances(ascending=True)


# E1-E4 on the fitted forests' test predictions
def q_virality_model_metrics(spark, d):
    return evaluate.binary_metrics(context(spark, d).model("virality").predictions)


def q_category_model_metrics(spark, d):
    m = context(spark, d).model("category")
    return evaluate.multiclass_metrics(m.predictions, m.train_rows)


def q_category_model_confusion(spark, d):
    return evaluate.confusion_matrix(context(spark, d).model("category").predictions)


def q_views_model_metrics(spark, d):
    m = context(spark, d).model("views")
    return evaluate.regression_metrics(m.predictions, m.train_rows).crossJoin(
        predict.prediction_limits(m.predictions))


# Rule-based predictors (no fitting) so the metric operators have an exact oracle.
# fixed values: the rules' parameters (mirrored in oracle.py)
RULE_VIRAL_MEAN_FACTOR = 2        # viral when views > 2 x mean views
RULE_HIGH_LIKES = 12000           # High when likes >= 12000
RULE_LOW_LIKES = 4000             # Low when likes < 4000, else Medium


def _rule_binary(spark, d):
    lab = predict.viral_label(_features(spark, d))
    _, test = predict.split(lab)
    mean = lab.agg(F.avg("views").alias("_mv"))
    return (test.crossJoin(F.broadcast(mean))
            .select("video_id", F.col("is_viral").alias("label"),
                    (F.col("views") > RULE_VIRAL_MEAN_FACTOR * F.col("_mv")).cast("int").alias("prediction")))


def _rule_category(spark, d):
    f = _features(spark, d)
    _, test = predict.split(f)
    rule = (F.when(F.col("likes") >= RULE_HIGH_LIKES, "High").when(F.col("likes") < RULE_LOW_LIKES, "Low")
            .otherwise("Medium"))
    return test.select("video_id", F.col("performance_category").alias("label"), rule.alias("prediction"))


def _rule_views(spark, d):
    f = _features(spark, d)
    _, test = predict.split(f)
    return test.select("video_id", F.col("views").cast("double").alias("label"),
                       F.col("avg_views_per_video").alias("prediction"))


def _train_rows(spark, d):
    train, _ = predict.split(_features(spark, d))
    return train.agg(F.count(F.lit(1)).alias("training_rows"))


def q_binary_metrics(spark, d):
    return evaluate.binary_metrics(_rule_binary(spark, d))


def q_confusion_matrix(spark, d):
    return evaluate.confusion_matrix(_rule_category(spark, d))


def q_multiclass_metrics(spark, d):
    return evaluate.multiclass_metrics(_rule_category(spark, d), _train_rows(spark, d))


def q_regression_metrics(spark, d):
    return evaluate.regression_metrics(_rule_views(spark, d), _train_rows(spark, d))


def q_rmse_residuals(spark, d):
    return evaluate.rmse_residuals(_rule_views(spark, d))


def q_per_class_metrics(spark, d):
    return evaluate.per_class_metrics(_rule_category(spark, d))


def q_axis_limit(spark, d):
    """M7 on the rule predictor."""
    return predict.prediction_limits(_rule_views(spark, d))


# The deterministic parts of the models: labels of the test rows, scaler statistics
def q_virality_labels(spark, d):
    _, test = predict.split(predict.viral_label(_features(spark, d)))
    return test.select("video_id", F.col("is_viral").alias("label"))


def q_category_labels(spark, d):
    _, test = predict.split(_features(spark, d).where(F.col("performance_category").isNotNull()))
    return test.select("video_id", F.col("performance_category").alias("label"))


def q_views_labels(spark, d):
    _, test = predict.split(_features(spark, d))
    return test.select("video_id", F.col("views").cast("double").alias("label"))


def q_scaler_stats(spark, d):
    """M2: mean and standard deviation that the fitted scalers use, per model and feature."""
    f = _features(spark, d)
    virality, _ = predict.split(f.fillna(0, subset=predict.VIRALITY_FEATURES))
    content, _ = predict.split(predict.fill_with_means(f, predict.CONTENT_FEATURES))
    return predict.scaler_stats(virality, predict.VIRALITY_FEATURES).select(F.lit("virality").alias("model"), "*").union(
        predict.scaler_stats(content, predict.CONTENT_FEATURES).select(F.lit("content").alias("model"), "*"))


def q_importance_totals(spark, d):
    """M8: features and total importance of each fitted forest."""
    out = None
    for kind in ("virality", "category", "views"):
        part = context(spark, d).model(kind).importances().agg(
            F.lit(kind).alias("model"), F.count(F.lit(1)).alias("features"), F.sum("importance").alias("total"))
        out = part if out is None else out.union(part)
    return out


# Landed pages (S1-S3, C1-C3): JSON text made from the tables, read with the declared schemas
def q_pages_videos(spark, d):
    return pages.read_video_pages(spark, pages.parse_pages(testviews.video_page_text(spark, d), pages.VIDEO_PAGE))


def q_pages_channels(spark, d):
    return pages.read_channel_pages(spark, pages.parse_pages(testviews.channel_page_text(spark, d), pages.CHANNEL_PAGE))


def q_pages_playlist(spark, d):
    """The videos that the playlist pages list."""
    listed = pages.read_playlist_pages(spark, pages.parse_pages(testviews.playlist_page_text(spark, d),
                                                                pages.PLAYLIST_PAGE))
    return pages.listed_videos(q_pages_videos(spark, d), listed).select("video_id", "views")


# The view with faults (see Context.dirty)
def q_dirty_videos(spark, d):
    return context(spark, d).dirty_videos


def q_dirty_inner(spark, d):
    """J2 with unmatched channels: fewer rows than the left join has."""
    return enrich.attach_channel(testviews.dirty_video_table(spark, d, SPREAD), context(spark, d).channel_attrs, how="inner")


def q_dirty_filtered(spark, d):
    """F4 "all": videos without a date, a channel or a category fall out."""
    videos, channels = context(spark, d).dirty
    return filters.apply_filters(videos, filters.FilterSpec(), channels)


def q_dirty_category_mix(spark, d):
    return performance.category_mix(context(spark, d).dirty_videos)


def q_dirty_data_check(spark, d):
    return quality.data_check(context(spark, d).dirty_videos)


def q_dirty_executive_summary(spark, d):
    videos, channels = context(spark, d).dirty
    fv, fc = filters.select_report(videos, channels, REPORT_SPEC)
    return kpi.executive_summary(fv, fc, videos)


def q_dirty_strategic_kpis(spark, d):
    return kpi.strategic_kpis(q_dirty_filtered(spark, d))


def _gaps(spark, d):
    """The view with faults, without the weeks whose number divides by 5."""
    return context(spark, d).dirty_videos.where(F.weekofyear("publish_date") % 5 != 0)


def q_dirty_week_over_week(spark, d):
    """X6 where weeks have no video."""
    return growth.week_over_week(_gaps(spark, d))


def q_dirty_daily_trend(spark, d):
    """G1 with every day listed."""
    return growth.engagement_trend(_gaps(spark, d), every_day=True)


def q_dirty_monthly_growth(spark, d):
    """G3 with every month listed; only the first quarter of each year has videos."""
    return growth.monthly_growth(_gaps(spark, d).where("publish_month_num <= 3"), every_month=True)


def q_dirty_channel_rollup(spark, d):
    return context(spark, d).dirty[1]


# Tables after two fetches: reports from their merged states and sketches
def _days(spark, d, spec=filters.FilterSpec()):
    return state.filter_days(refresh.stored(spark, context(spark, d).refreshed, "days"), spec)


def q_refreshed_videos(spark, d):
    """S4 after two fetches; the category's thresholds start from the stored sketches."""
    return refresh.enriched(spark, context(spark, d).refreshed)


def q_refreshed_thresholds(spark, d):
    q25, q75 = refresh.thresholds(spark, context(spark, d).refreshed)
    return literal_rows(spark, [("q25", [q25]), ("q75", [q75])])


def q_refreshed_channel_rollup(spark, d):
    ctx = context(spark, d)
    return state.rollup_from_days(refresh.stored(spark, ctx.refreshed, "days"), ctx.channel_attrs, AS_OF)


def q_refreshed_channel_profile(spark, d):
    return rollup.channel_profile(q_refreshed_channel_rollup(spark, d))


def q_refreshed_engagement_trend(spark, d):
    return state.trend_from_days(_days(spark, d))


def q_refreshed_channel_trend(spark, d):
    """G1 of named channels and dates, from the state."""
    return state.trend_from_days(_days(spark, d, CHANNEL_SPEC))


def q_refreshed_monthly_growth(spark, d):
    return state.months_from_days(_days(spark, d))


def q_refreshed_engagement_by_weekday(spark, d):
    return state.weekdays_from_days(_days(spark, d))


def q_refreshed_publishing_calendar(spark, d):
    return state.calendar_from_days(_days(spark, d))


def q_refreshed_publish_heatmap(spark, d):
    return state.heatmap_from_hours(state.filter_days(refresh.stored(spark, context(spark, d).refreshed, "hours")))


def q_bucketed_videos(spark, d):
    """J1 from the buckets, enriched as the shared table."""
    ctx = context(spark, d)
    cold, beside = bucketed.videos_with_channels(ctx.bucketed)
    return _enriched(enrich.with_time_and_rates(cold.unionByName(beside), AS_OF), ctx.thresholds)


def q_bucketed_channel_rollup(spark, d):
    """A1 + A2 and J3 without an exchange of videos."""
    return bucketed.bucketed_rollup(context(spark, d).bucketed, lambda v: enrich.with_time_and_rates(v, AS_OF), AS_OF)


def q_csv_videos(spark, d):
    """S4 + X2: the videos written as CSV, some titles with line breaks and quotes, and read back."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/csv-videos-{uuid.uuid4().hex}"
    files.write_videos(testviews.broken_titles(context(spark, d).videos), path)
    return files.read_table_csv(spark, path)


def q_dashboard_reports(spark, d):
    """G1-G3, G6, V1, V2, V4 and H1-H4 of one filter from a single scan of the videos."""
    ctx = context(spark, d)
    fv, _ = filters.select_report(ctx.videos, ctx.channels, REPORT_SPEC)
    return dashboard.dashboard_rows(ctx.keep(dashboard.report_groups(fv), f"dashboard-{uuid.uuid4().hex}"))


def q_dirty_dashboard_reports(spark, d):
    groups = dashboard.report_groups(q_dirty_filtered(spark, d))
    return dashboard.dashboard_rows(context(spark, d).keep(groups, f"dashboard-{uuid.uuid4().hex}"))


def q_recommendations(spark, d):
    ctx = context(spark, d)
    return recommend.recommendations(ctx.fv, ctx.fc)


def q_benchmark_index(spark, d):
    ctx = context(spark, d)
    fv, fc = filters.select_report(ctx.videos, ctx.channels, REPORT_SPEC)
    return recommend.benchmark_index(fv, fc, ctx.videos, ctx.channels)


def q_data_check(spark, d):
    return quality.data_check(context(spark, d).videos)


def q_views_engagement_corr(spark, d):
    return growth.views_engagement_corr(context(spark, d).fv)


def q_week_over_week(spark, d):
    return growth.week_over_week(context(spark, d).videos)


def q_last_90_days(spark, d):
    return growth.last_days(context(spark, d).videos, 90)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    name[2:]: fn for name, fn in sorted(globals().items()) if name.startswith("q_") and callable(fn)
}

# Queries whose oracle is rows-only (model fits: forests cannot equal another
# library row by row).
ROWS_ONLY = {"virality_model", "category_model", "views_model",
             "virality_importances", "category_importances", "views_importances",
             "virality_model_metrics", "category_model_metrics", "category_model_confusion",
             "views_model_metrics"}


def queries(rounded: bool = True) -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    if not rounded:
        return dict(QUERIES)
    return {k: (lambda fn: lambda spark, d: round_doubles(fn(spark, d)))(fn) for k, fn in QUERIES.items()}


__all__ = ["CATEGORIES", "Context", "QUERIES", "ROWS_ONLY", "context", "queries", "release"]
