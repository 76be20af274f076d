"""Invariants of the reports on the driver's sf0.001 tables."""

import pytest
from pyspark.sql import functions as F

from media_analytics.operators import evaluate, growth, kpi, performance, predict, strategy
from media_analytics.plans import catalog

from .conftest import SF_SMALL


@pytest.fixture(scope="module")
def ctx(spark):
    return catalog.context(spark, SF_SMALL)


def test_category_counts_sum(ctx):
    n = ctx.videos.count()
    mix = performance.category_mix(ctx.fv).collect()
    assert sum(r.videos for r in mix) == n
    assert sum(r.pct for r in mix) == pytest.approx(100.0)


def test_shares_sum_to_100(ctx):
    assert sum(r.share_pct for r in growth.views_by_category(ctx.fv).collect()) == pytest.approx(100.0)


def test_histogram_and_calendar_sum_to_n(ctx):
    n = ctx.videos.count()
    h = growth.engagement_histogram(ctx.fv).collect()
    assert len(h) == 30 and sum(r.videos for r in h) == n
    assert sum(r.videos for r in strategy.publishing_calendar(ctx.fv).collect()) == n


def test_quality_in_range(ctx):
    q = kpi.strategic_kpis(ctx.fv).first().quality_score
    assert 0 <= q <= 100


def test_confusion_sums_to_test_rows(spark, ctx):
    f = predict.build_features(ctx.fv, ctx.channels)
    _, test = predict.split(f)
    pred = test.select("video_id", F.col("performance_category").alias("label"),
                       F.lit("Medium").alias("prediction"))
    cm = evaluate.confusion_matrix(pred).collect()
    assert len(cm) == 9 and sum(r.videos for r in cm) == test.count()


def test_heatmap_has_all_weekdays(ctx):
    cols = strategy.publish_heatmap(ctx.fv).columns
    assert cols == ["publish_hour", "Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]


def test_split_is_about_thirty_percent(ctx):
    f = ctx.videos.select(predict.test_flag("video_id").cast("int").alias("t")).agg(F.avg("t")).first()[0]
    assert 0.2 < f < 0.4
