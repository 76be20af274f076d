"""Prediction models on ``pyspark.ml``: M0-M8, C22, J5, T5.

Training is distributed (``forest``: per-level split statistics added up on
executors); the driver holds only the trees. Nothing here collects rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import IndexToString, StandardScaler, StringIndexerModel, VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.constants import (CATEGORIES, CONTENT_FEATURES, FOREST_DEPTH, FOREST_TREES, SEED,
                                   TEST_FRACTION_TENTHS, VIRALITY_FEATURES)
from ..functions.scalar import is_weekend, ratio_or_null
from ..session import persist
from .forest import BinnedForest
from .joins import salted_join
from .quantiles import quantiles


def build_features(fv: DataFrame, c: DataFrame) -> DataFrame:
    """M0 + J5: ratio features (+1 smoothed), weekend flag, hour / 24 and the
    channel's average views from the (unfiltered) channel table, falling back
    to the mean views of ``fv``. The channel side is not hinted (it grows with
    the data); hot channels are split by a salted join."""
    v1 = (F.col("views") + 1).cast("double")
    mean_views = fv.agg(F.avg("views").alias("_mean_views"))
    ch = c.select("channel_id", F.col("avg_views_per_video").alias("_ch_avg"))
    f = salted_join(fv, ch, "channel_id", "left").crossJoin(F.broadcast(mean_views))  # one-row side
    return f.select(
        "video_id", "channel_id", "views", "likes", "comments", "ch_subscribers",
        "duration_minutes", "title_length", "publish_hour", "publish_day", "performance_category",
        ((F.col("likes") + F.col("comments")) / v1).alias("early_engagement_rate"),
        (F.col("likes") / v1).alias("likes_views_ratio"),
        (F.col("comments") / v1).alias("comments_views_ratio"),
        is_weekend("publish_day").alias("is_weekend"),
        (F.col("publish_hour") / 24.0).alias("hour_encoded"),
        F.coalesce(F.col("_ch_avg"), F.col("_mean_views")).alias("avg_views_per_video"),
    )


def test_flag(key: str = "video_id") -> Column:
    """M1: repeatable ~30% test rows from the md5 of the key (independent of
    partitioning, unlike ``randomSplit``)."""
    h = F.conv(F.substring(F.md5(F.col(key).cast("string")), 1, 7), 16, 10).cast("bigint")
    return (h % 10) < TEST_FRACTION_TENTHS


def split(df: DataFrame, key: str = "video_id") -> tuple[DataFrame, DataFrame]:
    """M1: (train, test)."""
    t = test_flag(key)
    return df.where(~t), df.where(t)


def viral_label(features: DataFrame, approx: bool = False) -> DataFrame:
    """M3: is_viral = views / subscribers strictly above its q75 (0 subscribers:
    ratio NULL, not viral)."""
    ratio = ratio_or_null("views", "ch_subscribers")
    with_ratio = features.withColumn("views_per_subscriber", ratio)
    vt = quantiles(with_ratio, "views_per_subscriber", [0.75], approx=approx)[0]
    lab = F.lit(0) if vt is None else F.coalesce((F.col("views_per_subscriber") > F.lit(vt)).cast("int"), F.lit(0))
    return with_ratio.withColumn("is_viral", lab)


def fill_with_means(df: DataFrame, cols: list[str]) -> DataFrame:
    """Nulls of ``cols`` -> the column mean over ``df`` (one-row broadcast)."""
    means = df.agg(*[F.avg(c).alias(f"_mu_{c}") for c in cols])
    j = df.crossJoin(F.broadcast(means))
    return j.select(*[F.coalesce(F.col(c), F.col(f"_mu_{c}")).alias(c) if c in cols else F.col(c)
                      for c in df.columns])


@dataclass
class FittedModel:
    model: PipelineModel
    features: list[str]
    predictions: DataFrame  # video_id, label, prediction on the test rows (persisted)
    train_rows: DataFrame   # one row: training_rows

    def importances(self, ascending: bool | None = None) -> DataFrame:
        """M8 / T5: feature importance table (one row per feature), optionally
        sorted by importance (the virality and views charts sort ascending,
        the category chart descending)."""
        imp = self.model.stages[-2 if isinstance(self.model.stages[-1], IndexToString) else -1].featureImportances
        spark = self.predictions.sparkSession
        df = spark.createDataFrame([(f, float(imp[i])) for i, f in enumerate(self.features)],
                                   "feature string, importance double")
        if ascending is None:
            return df
        return df.orderBy(F.col("importance").asc() if ascending else F.col("importance").desc(), "feature")


def _forest(cols: list[str], classes: int = 0, **names) -> BinnedForest:
    """The forest of the models: a classifier of ``classes`` tries the square root of the features at a
    node; a regressor all of them (the in-memory library's default)."""
    subset = math.ceil(math.sqrt(len(cols))) if classes else len(cols)
    return BinnedForest(classes, subset, numTrees=FOREST_TREES, maxDepth=FOREST_DEPTH, seed=SEED,
                        featuresCol="_features", labelCol="_label", **names)


def _assemble(cols: list[str]) -> list:
    return [VectorAssembler(inputCols=cols, outputCol="_raw"),
            StandardScaler(inputCol="_raw", outputCol="_features", withMean=True, withStd=True)]


def _require(train: DataFrame, what: str) -> None:
    if train.isEmpty():
        raise ValueError(f"{what}: no training rows")


# Every tree level ships one statistics array per partition, so partitions are few; and every
# level makes the counts and nodes of all its rows again, so one makes no more of them than this.
FIT_PARTITION_BYTES = 2 * 1024 * 1024 * 1024
FIT_PARTITIONS = 8  # at least this many
ROW_BYTES = 15 * FOREST_TREES  # of a row in one level: its count and node in each tree, made block by block and never stored
DEALT_BY = ["video_id", "channel_id", "views", "likes", "comments"]  # as read, never filled


def _fit(stages: list, train: DataFrame, columns: list[str]) -> PipelineModel:
    """Fit with the ``columns`` of the training rows persisted for the fit only: the scaler
    pass, the split candidates and the forest's bins then read them once
    instead of re-running the feature joins (spills to disk when large). They are dealt by
    id and counters (an id may repeat) to as many partitions as the bagged rows fill, whatever the files they
    come from, so a large table has more tasks, not larger ones. In a partition they lie in the order of the features:
    the same rows are bagged in each run, and successive rows meet the same nodes of a tree."""
    rows = train.select(F.count(F.lit(1))).first()[0]
    n = max(FIT_PARTITIONS, -(-rows * ROW_BYTES // FIT_PARTITION_BYTES))
    cached = persist(train.select(F.xxhash64(*DEALT_BY).alias("_deal"), "video_id", *columns).repartition(n, "_deal")
                     .sortWithinPartitions(*columns, "video_id").drop("_deal"))
    try:
        return Pipeline(stages=stages).fit(cached)
    finally:
        cached.unpersist()


def scaler_stats(train: DataFrame, cols: list[str]) -> DataFrame:
    """M2: (feature, mean, std) of the scaler fitted on the training rows."""
    scaler = Pipeline(stages=_assemble(cols)).fit(train).stages[-1]
    spark = train.sparkSession
    return spark.createDataFrame([(c, float(m), float(s)) for c, m, s in zip(cols, scaler.mean, scaler.std)],
                                 "feature string, mean double, std double")


def fit_virality(features: DataFrame, approx: bool = False) -> FittedModel:
    """M4: random forest classifier of is_viral on six features (null -> 0)."""
    df = viral_label(features, approx).fillna(0, subset=VIRALITY_FEATURES)
    df = df.withColumn("_label", F.col("is_viral").cast("double"))
    train, test = split(df)
    _require(train, "virality model")
    rf = _forest(VIRALITY_FEATURES, classes=2)
    model = _fit(_assemble(VIRALITY_FEATURES) + [rf], train, [*VIRALITY_FEATURES, "_label"])
    pred = persist(model.transform(test).select("video_id", F.col("_label").alias("label"), "prediction"))
    return FittedModel(model, VIRALITY_FEATURES, pred, train.agg(F.count(F.lit(1)).alias("training_rows")))


def fit_category(features: DataFrame) -> FittedModel:
    """M5: random forest classifier of High / Medium / Low (null -> mean)."""
    df = fill_with_means(features, CONTENT_FEATURES).where(F.col("performance_category").isNotNull())
    train, test = split(df)
    _require(train, "category model")
    idx = StringIndexerModel.from_labels(CATEGORIES, inputCol="performance_category", outputCol="_label")
    rf = _forest(CONTENT_FEATURES, classes=len(CATEGORIES), predictionCol="_pred")
    back = IndexToString(inputCol="_pred", outputCol="prediction", labels=CATEGORIES)
    model = _fit([idx] + _assemble(CONTENT_FEATURES) + [rf, back], train, [*CONTENT_FEATURES, "performance_category"])
    pred = persist(model.transform(test).select("video_id", F.col("performance_category").alias("label"),
                                                "prediction"))
    return FittedModel(model, CONTENT_FEATURES, pred, train.agg(F.count(F.lit(1)).alias("training_rows")))


def fit_views(features: DataFrame) -> FittedModel:
    """M6: random forest regressor of views. All features are candidates at
    every split (the in-memory library's default; Spark's ``auto`` would use a
    third for regression)."""
    df = fill_with_means(features, CONTENT_FEATURES).withColumn("_label", F.col("views").cast("double"))
    train, test = split(df)
    _require(train, "views model")
    rf = _forest(CONTENT_FEATURES)
    model = _fit(_assemble(CONTENT_FEATURES) + [rf], train, [*CONTENT_FEATURES, "_label"])
    pred = persist(model.transform(test).select("video_id", F.col("_label").alias("label"), "prediction"))
    return FittedModel(model, CONTENT_FEATURES, pred, train.agg(F.count(F.lit(1)).alias("training_rows")))


def prediction_limits(pred: DataFrame) -> DataFrame:
    """M7: axis limit of the predicted-vs-actual plot: max of both columns."""
    return pred.agg(F.greatest(F.max("label"), F.max("prediction")).alias("axis_limit"))
