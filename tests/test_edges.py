"""Edge cases of single operators on hand-made rows."""

import pytest

from media_analytics.operators import evaluate, filters, growth, rollup


def test_binary_metrics_zero_division(spark):
    pred = spark.createDataFrame([(1, 0, 0), (2, 0, 0)], "video_id int, label int, prediction int")
    r = evaluate.binary_metrics(pred).first()
    assert (r.test_rows, r.accuracy, r.precision, r.recall, r.f1) == (2, 1.0, 0.0, 0.0, 0.0)


def test_histogram_constant_values(spark):
    df = spark.createDataFrame([(2.5,)] * 4 + [(None,)], "x double")
    h = growth.histogram(df, "x", 30).orderBy("bin").collect()
    assert len(h) == 30 and h[0].videos == 4 and sum(r.videos for r in h) == 4
    assert h[0].bin_start == h[0].bin_end == 2.5


def test_histogram_max_in_last_bin(spark):
    df = spark.createDataFrame([(float(x),) for x in range(31)], "x double")
    h = {r.bin: r.videos for r in growth.histogram(df, "x", 30).collect()}
    assert h[29] == 2 and sum(h.values()) == 31  # 29 and the maximum 30


def test_duration_trend_needs_two_rows(spark):
    one = spark.createDataFrame([(3.0, 1.0)], "duration_minutes double, engagement_rate double")
    assert growth.duration_trend(one).count() == 0
    two = spark.createDataFrame([(1.0, 2.0), (3.0, 6.0)], "duration_minutes double, engagement_rate double")
    pts = growth.duration_trend(two).orderBy("point").collect()
    assert len(pts) == 100 and pts[0].duration_minutes == 1.0 and pts[-1].duration_minutes == 3.0
    assert pts[-1].engagement_rate == pytest.approx(6.0) and pts[0].slope == pytest.approx(2.0)


def test_above_quantile_is_strict(spark):
    df = spark.createDataFrame([(float(v),) for v in (1, 2, 3, 4, 5)], "s double")
    rows, q = filters.above_quantile(df, "s", 0.75)
    assert q == 4.0 and [r.s for r in rows.collect()] == [5.0]


def test_channel_profile_zero_safe(spark):
    c = spark.createDataFrame([("c1", "A", 0, 0, 0, 0, 0, 0)],
                              "channel_id string, channel_name string, videos bigint, total_views bigint, "
                              "total_likes bigint, total_comments bigint, subscribers bigint, channel_age_days bigint")
    r = rollup.channel_profile(c).first()
    assert r.avg_views == 0.0 and r.engagement_score == 0.0 and r.videos_per_month == 0.0


def test_per_class_metrics_from_confusion(spark):
    pred = spark.createDataFrame([("High", "High"), ("High", "Low"), ("Low", "Low"), ("Medium", "Low")],
                                 "label string, prediction string")
    m = {r["class"]: r for r in evaluate.per_class_metrics(pred).collect()}
    assert m["High"].precision == 1.0 and m["High"].recall == 0.5 and m["High"].support == 2
    assert m["Low"].precision == pytest.approx(1 / 3) and m["Medium"].f1 == 0.0
