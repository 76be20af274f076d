from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from media_analytics.operators import enrich, filters, growth, kpi, performance, recommend, rollup

AS_OF = datetime(2001, 12, 31)
TYPED = ("video_id string, title string, channel_id string, publish_date timestamp_ntz, "
         "duration_minutes double, views bigint, likes bigint, comments bigint")
CH = "channel_id string, channel_name string, ch_subscribers bigint, channel_created timestamp_ntz"


def _videos(spark, rows, channels=None):
    v = spark.createDataFrame(rows, TYPED)
    c = spark.createDataFrame(channels or [("c1", "One", 10, datetime(2001, 1, 1)),
                                           ("c2", "Two", 0, datetime(2001, 6, 1))], CH)
    return enrich.attach_channel(v, c), c


def _row(i, views, ch="c1", ts=datetime(2000, 1, 3, 9, 0), dur=3.0, likes=1, comments=1, title="t"):
    return (f"v{i}", title, ch, ts, dur, views, likes, comments)


def test_category_modes_at_quartiles(spark):
    typed, _ = _videos(spark, [_row(i, v) for i, v in enumerate([1, 2, 3, 4, 5])])
    dash = {r.views: r.performance_category for r in enrich.enrich_videos(typed, AS_OF).collect()}
    batch = {r.views: r.performance_category
             for r in enrich.enrich_videos(typed, AS_OF, low_inclusive=False).collect()}
    assert dash[2] == "Low" and batch[2] == "Medium"  # exactly q25
    assert dash[4] == dash[5] == "High" and batch[4] == "High"
    assert dash[3] == "Medium" and batch[1] == "Low"


def test_rates_zero_safe_and_future_age(spark):
    future = datetime(2002, 1, 1, 2, 0)  # 26 h after as_of
    typed, _ = _videos(spark, [_row(0, 0, ts=future, likes=0, comments=0), _row(1, 100, likes=5, comments=0)])
    rows = {r.video_id: r for r in enrich.enrich_videos(typed, AS_OF).collect()}
    assert rows["v0"].engagement_rate == 0.0 and rows["v0"].video_age_days == 2
    assert rows["v1"].like_rate == 5.0 and rows["v1"].likes_per_comment == 0.0
    batch = {r.video_id: r for r in enrich.enrich_videos(typed, AS_OF, absolute_age=False).collect()}
    assert batch["v0"].video_age_days == -2 and batch["v0"].views_per_day == 0.0


def test_title_length_code_points(spark):
    typed, _ = _videos(spark, [_row(0, 5, title="é🎬")])
    assert enrich.enrich_videos(typed, AS_OF).first().title_length == 2


def test_rollup_drops_unmatched_and_single_video_cv(spark):
    rows = [_row(0, 10), _row(1, 30), _row(2, 7, ch="c2"), _row(3, 9, ch="zz")]
    typed, c = _videos(spark, rows)
    v = enrich.enrich_videos(typed, AS_OF)
    ch = {r.channel_id: r for r in rollup.rollup_channels(v, c, AS_OF).collect()}
    assert set(ch) == {"c1", "c2"}  # null channel name -> absent
    assert ch["c1"].videos == 2 and ch["c1"].total_views == 40 and ch["c1"].avg_views == 20.0
    assert ch["c2"].views_per_subscriber == 0.0  # zero subscribers
    k = kpi.strategic_kpis(filters.apply_filters(v)).first()
    # only c1 has a CV (c2 has one video; the unmatched video has no channel name)
    import statistics
    cv = statistics.stdev([10, 30]) / 20
    assert k.consistency == pytest.approx(100 - cv)


def test_efficiency_and_virality_zero_subscribers(spark):
    rows = [_row(0, 5, ch="c2"), _row(1, 0, ch="c2"), _row(2, 100, ch="c1", dur=2.0)]
    typed, _ = _videos(spark, rows)
    v = enrich.enrich_videos(typed, AS_OF)
    k = kpi.strategic_kpis(v).first()
    # views 5 / 0 -> counts as 0; 0 / 0 skipped; 100 / (2 * 10) = 5
    assert k.video_efficiency == pytest.approx((0 + 5) / 2 * 1000)
    assert k.virality_index == pytest.approx(100 / 10 * 100)  # zero-subscriber rows skipped


def test_quality_score_bounds(spark):
    typed, _ = _videos(spark, [_row(i, 10 * (i + 1), likes=i, comments=1) for i in range(6)])
    q = kpi.strategic_kpis(enrich.enrich_videos(typed, AS_OF)).first().quality_score
    assert 0 <= q <= 100


def test_one_category_left_radar_and_mix(spark):
    typed, _ = _videos(spark, [_row(i, v) for i, v in enumerate([1, 2, 3, 4, 5, 6, 7, 8])])
    v = enrich.enrich_videos(typed, AS_OF)
    fv = filters.apply_filters(v, filters.FilterSpec(categories=("High",)))
    rad = performance.radar(fv).collect()
    assert len(rad) == 1 and all(rad[0][m] == 0.0 for m in ("views", "likes", "views_per_day"))
    mix = {r.performance_category: r.videos for r in performance.category_mix(fv).collect()}
    assert mix["Medium"] == 0 and mix["Low"] == 0 and mix["High"] == 2


def test_tied_means_best_day_alphabetical(spark):
    mon, fri = datetime(2000, 1, 3, 9), datetime(2000, 1, 7, 9)
    typed, c = _videos(spark, [_row(0, 10, ts=mon), _row(1, 10, ts=fri), _row(2, 4, ts=mon), _row(3, 4, ts=fri)])
    v = enrich.enrich_videos(typed, AS_OF)
    best = recommend.best_group(v, "publish_day", F.col("views").cast("double"), "best_day").first()
    assert best.best_day == "Friday"


def test_empty_filter_is_empty(spark):
    typed, _ = _videos(spark, [_row(0, 10)])
    v = enrich.enrich_videos(typed, AS_OF)
    fv = filters.apply_filters(v, filters.FilterSpec(start=date(1990, 1, 1), end=date(1990, 1, 2)))
    assert fv.isEmpty()
    assert growth.engagement_trend(fv).count() == 0
    with pytest.raises(ValueError):
        filters.require_rows(fv, "videos")


def test_single_date_filter_is_that_day(spark):
    typed, _ = _videos(spark, [_row(0, 1, ts=datetime(2000, 1, 3, 23, 59)), _row(1, 1, ts=datetime(2000, 1, 4))])
    v = enrich.enrich_videos(typed, AS_OF)
    fv = filters.apply_filters(v, filters.FilterSpec(start=date(2000, 1, 3)))
    assert [r.video_id for r in fv.collect()] == ["v0"]


def test_channel_filter_by_names_frame(spark):
    typed, c = _videos(spark, [_row(0, 1), _row(1, 2, ch="c2")])
    v = enrich.enrich_videos(typed, AS_OF)
    names = spark.createDataFrame([("Two",)], "n string")
    assert [r.video_id for r in filters.filter_by_names(v, names).collect()] == ["v1"]
    assert filters.apply_filters(v, filters.FilterSpec(channels=("One",))).count() == 1


def test_salted_join_hot_key_equals_plain_join(spark):
    from media_analytics.operators.joins import hot_keys, salted_join
    rows = [(i, "hot" if i % 3 == 0 else f"k{i % 500}") for i in range(3000)] + [(9999, None), (10000, "nodim")]
    big = spark.createDataFrame(rows, "id bigint, k string")
    dim = spark.createDataFrame([("hot", 1)] + [(f"k{i}", i) for i in range(500)], "k string, attr int")
    hot = hot_keys(big, "k", partitions=30).collect()
    assert [(r.k, r._salts) for r in hot] == [("hot", 40)]  # four salts per fair share it fills
    for how in ("left", "inner"):
        a = sorted(salted_join(big, dim, "k", how).collect(), key=lambda r: r.id)
        b = sorted(big.join(dim, "k", how).select("k", "id", "attr").collect(), key=lambda r: r.id)
        assert a == b
    # the hot key's rows land on all of its salts
    salted = big.withColumn("_s", F.pmod(F.xxhash64("id", "k"), F.lit(30)))
    assert salted.where(F.col("k") == "hot").select("_s").distinct().count() == 30


def test_week_over_week_changes(spark):
    rows = [_row(0, 100, ts=datetime(2000, 1, 3, 9)), _row(1, 100, ts=datetime(2000, 1, 5, 9)),
            _row(2, 300, ts=datetime(2000, 1, 10, 9))]
    typed, _ = _videos(spark, rows)
    w = growth.week_over_week(enrich.enrich_videos(typed, AS_OF)).orderBy("week").collect()
    assert [(str(r.week), r.views, r.videos) for r in w] == [("2000-01-03", 200, 2), ("2000-01-10", 300, 1)]
    assert w[0].views_change_pct is None
    assert w[1].views_change_pct == pytest.approx(50.0) and w[1].videos_change_pct == pytest.approx(-50.0)


def test_kpi_ratings_thresholds(spark):
    k = spark.createDataFrame([(150.0, 10.0, 80.0, 300.0, 59.9)],
                              "video_efficiency double, interaction_score double, consistency double, "
                              "virality_index double, quality_score double")
    got = {r.kpi: r.meets_threshold for r in kpi.kpi_ratings(k).collect()}
    assert got == {"video_efficiency": True, "interaction_score": False, "consistency": True,
                   "virality_index": True, "quality_score": False}


def test_last_days_with_as_of(spark):
    rows = [_row(0, 1, ts=datetime(2001, 10, 2, 0, 0)), _row(1, 1, ts=datetime(2001, 10, 1, 23, 59)),
            _row(2, 1, ts=datetime(2001, 12, 31, 23, 0)), _row(3, 1, ts=datetime(2002, 1, 1, 0, 0))]
    typed, _ = _videos(spark, rows)
    v = enrich.enrich_videos(typed, AS_OF)
    assert sorted(r.video_id for r in growth.last_days(v, 90, as_of=AS_OF).collect()) == ["v0", "v2"]
    # without as_of the window ends at the latest publish date: 2001-10-03 .. 2002-01-01
    assert sorted(r.video_id for r in growth.last_days(v, 90).collect()) == ["v2", "v3"]


def test_date_filter_year_bounds_match_date_range(spark):
    rows = [_row(0, 1, ts=datetime(1998, 6, 1)), _row(1, 1, ts=datetime(2000, 1, 3)),
            _row(2, 1, ts=datetime(2000, 2, 1))]
    typed, _ = _videos(spark, rows)
    v = enrich.enrich_videos(typed, AS_OF)
    ids = lambda spec: sorted(r.video_id for r in filters.apply_filters(v, spec).collect())
    assert ids(filters.FilterSpec(end=date(2000, 1, 10))) == ["v0", "v1"]        # no lower bound
    assert ids(filters.FilterSpec(start=date(1999, 1, 1))) == []                  # a single day
    assert ids(filters.FilterSpec(start=date(1999, 1, 1), end=date(2000, 12, 31))) == ["v1", "v2"]


def test_best_video_groups_ties_and_empty_set(spark):
    mon9, fri10 = datetime(2000, 1, 3, 9), datetime(2000, 1, 7, 10)
    rows = [_row(0, 10, ts=mon9, dur=3.0), _row(1, 10, ts=fri10, dur=7.0),
            _row(2, 4, ts=mon9, dur=3.0), _row(3, 4, ts=fri10, dur=7.0)]
    typed, _ = _videos(spark, rows)
    v = enrich.enrich_videos(typed, AS_OF)
    b = recommend.best_video_groups(v).first()
    # means tie everywhere: first bucket, lowest hour, alphabetical day
    assert (b.best_duration, b.best_hour, b.best_day) == ("0-5", 9, "Friday")
    none = recommend.best_video_groups(v.withColumn("duration_minutes", F.lit(0.0))).first()
    assert none.best_duration is None and none.best_day == "Friday"


def test_weeks_without_videos_are_listed(spark):
    """The change is against the week before, not the last one present."""
    from datetime import datetime

    from pyspark.sql import functions as F

    v = spark.createDataFrame([("a", datetime(2024, 1, 1), 100, 1.0), ("b", datetime(2024, 1, 29), 200, 3.0),
                               ("c", datetime(2024, 2, 5), 300, 4.0), ("d", None, 5, 5.0)],
                              "video_id string, publish_date timestamp_ntz, views long, engagement_rate double")
    got = [(str(r.week), r.views, r.videos, r.engagement_rate, r.views_change_pct) for r in growth.week_over_week(v).orderBy("week").collect()]
    assert got == [("2024-01-01", 100, 1, 1.0, None), ("2024-01-08", 0, 0, None, -100.0), ("2024-01-15", 0, 0, None, None),
                   ("2024-01-22", 0, 0, None, None), ("2024-01-29", 200, 1, 3.0, None), ("2024-02-05", 300, 1, 4.0, 50.0)]
    days = growth.engagement_trend(v.where("views < 300"), every_day=True).orderBy("publish_date").collect()
    assert len(days) == 29 and [r.engagement_rate for r in days][::28] == [1.0, 3.0] and days[1].engagement_rate is None
    months = growth.monthly_growth(v, every_month=True).orderBy("month").collect()
    assert [(r.views, r.videos) for r in months] == [(300, 2), (300, 1)]
    none = v.where(F.lit(False))
    assert growth.week_over_week(none).count() == growth.engagement_trend(none, every_day=True).count() == 0
