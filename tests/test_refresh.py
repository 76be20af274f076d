"""Incremental refresh: only the touched years are rewritten, states merge, sketches are reused."""

import os
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from media_analytics.operators import enrich, filters, growth, rollup, state, strategy
from media_analytics.operators import quantiles as qs
from media_analytics.plans import refresh

AS_OF = datetime(2024, 1, 1)
SCHEMA = ("video_id string, title string, channel_id string, publish_date timestamp_ntz, duration_minutes double, views long, "
          "likes long, comments long, channel_name string, ch_subscribers long, channel_created timestamp_ntz, fetched_at int")


def rows(spark, *items):
    """(id, year or None, views, channel, fetched_at)."""
    data = [(i, f"t {i}", c, None if y is None else datetime(y, 3, 5, 10), 4.0, v, v // 10, 1, c and f"name {c}", 100,
             datetime(2020, 1, 1), at) for i, y, v, c, at in items]
    df = enrich.with_time_and_rates(spark.createDataFrame(data, SCHEMA), AS_OF)
    return df.select("fetched_at", *[c for c in enrich.VIDEO_COLUMNS if c != "performance_category"])


def content(spark, root, name="videos"):
    return sorted((r.video_id or "", r.publish_year or 0, r.views) for r in refresh.stored(spark, root, name).collect())


def files_of(root):
    return {os.path.join(d, f) for d, _, names in os.walk(root) for f in names if f.endswith(".parquet")}


def test_only_touched_years_are_rewritten(spark, tmp_dir):
    root = f"{tmp_dir}/t"
    first = rows(spark, ("a", 2020, 10, "c1", 1), ("b", 2021, 20, "c1", 1), ("c", 2022, 30, "c2", 1), ("d", None, 40, None, 1),
                 (None, 2021, 50, "c1", 1))
    assert sorted(refresh.refresh(root, first, ["fetched_at"]), key=str) == [2020, 2021, 2022, None]
    before = files_of(root)
    # a moves from 2020 (left empty) to 2021, b gets new counters twice, e is new
    second = rows(spark, ("a", 2021, 11, "c1", 2), ("b", 2021, 21, "c1", 2), ("b", 2021, 25, "c1", 3), ("e", 2021, 5, "c2", 2),
                  (None, 2022, 99, "c1", 2))
    assert sorted(refresh.refresh(root, second, ["fetched_at"])) == [2020, 2021]
    want = [("a", 2021, 11), ("b", 2021, 25), ("c", 2022, 30), ("d", 0, 40), ("e", 2021, 5)]
    assert content(spark, root) == want
    after = files_of(root)
    for name in ("videos", "days", "hours", "sketches"):
        assert not any(f"/{name}/publish_year=2020" in f for f in after)
    kept = [f for f in before if "publish_year=2022" in f or "DEFAULT" in f]
    assert kept and all(f in after for f in kept)  # not even rewritten
    # the same fetch again changes nothing
    refresh.refresh(root, second, ["fetched_at"])
    assert content(spark, root) == want
    # the year without rows comes back
    refresh.refresh(root, rows(spark, ("f", 2020, 1, "c2", 4)), ["fetched_at"])
    assert ("f", 2020, 1) in content(spark, root)


def test_stored_rows_without_id_stay(spark, tmp_dir):
    path = f"{tmp_dir}/videos"
    table = rows(spark, ("a", 2021, 1, "c1", 1), (None, 2021, 2, "c1", 1)).drop("fetched_at")
    table.write.partitionBy("publish_year").parquet(path)
    refresh.upsert(path, rows(spark, ("a", 2021, 3, "c1", 1)).drop("fetched_at"))
    assert sorted(r.views for r in spark.read.parquet(path).collect()) == [2, 3]


def test_empty_fetch(spark, tmp_dir):
    root = f"{tmp_dir}/t"
    refresh.refresh(root, rows(spark, ("a", 2021, 1, "c1", 1)), ["fetched_at"])
    assert refresh.refresh(root, rows(spark, ("b", 2021, 1, "c1", 1)).limit(0), ["fetched_at"]) == []
    assert content(spark, root) == [("a", 2021, 1)]


def test_written_rows_are_not_moved_again(spark, tmp_dir):
    """The only exchange is the caller's own."""
    df = rows(spark, *[(f"v{k}", 2018 + k % 5, k, "c1", 1) for k in range(200)])
    df = refresh.newest(df, "video_id", ["fetched_at"]).drop("fetched_at")
    spark.sparkContext.setJobGroup("write-years", "write")
    try:
        refresh._write_years(df, f"{tmp_dir}/w", [], [])
        tracker = spark.sparkContext.statusTracker()
        stages = {s for j in tracker.getJobIdsForGroup("write-years") for s in tracker.getJobInfo(j).stageIds
                  if tracker.getStageInfo(s) and tracker.getStageInfo(s).numCompletedTasks}
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(stages) == 2
    assert sorted(r.views for r in spark.read.parquet(f"{tmp_dir}/w").collect()) == list(range(200))


@pytest.fixture(scope="module")
def sample(spark, tmp_path_factory):
    items = [(f"v{k}", None if k % 17 == 0 else 2018 + k % 5, (k * 7919) % 1000, None if k % 11 == 0 else f"c{k % 6}", 1)
             for k in range(600)]
    df = rows(spark, *items).withColumn("likes", F.when(F.col("views") % 9 != 0, F.col("likes")))
    root = f"{tmp_path_factory.mktemp('refresh')}/t"
    refresh.refresh(root, df, ["fetched_at"])
    return root, df.drop("fetched_at")


def same(a, b):
    show = lambda df: sorted(str([round(x, 6) if isinstance(x, float) else x for x in r])
                             for r in df.select(*sorted(df.columns)).collect())
    return show(a) == show(b)


@pytest.mark.parametrize("spec", [filters.FilterSpec(), filters.FilterSpec(start=datetime(2019, 1, 1).date(),
                                                                           end=datetime(2020, 12, 31).date()),
                                  filters.FilterSpec(channels=("name c1", "name c4"))])
def test_reports_of_the_state_equal_those_of_the_videos(spark, sample, spec):
    root, df = sample
    videos = df.withColumn("performance_category", F.lit("High"))
    fv = filters.apply_filters(videos, spec)
    days = state.filter_days(refresh.stored(spark, root, "days"), spec)
    assert same(state.trend_from_days(days), growth.engagement_trend(fv))
    assert same(state.months_from_days(days), growth.monthly_growth(fv))
    assert same(state.weekdays_from_days(days), growth.engagement_by_weekday(fv))
    assert same(state.calendar_from_days(days), strategy.publishing_calendar(fv))
    if spec.channels is None:
        hours = state.filter_days(refresh.stored(spark, root, "hours"), spec)
        assert same(state.heatmap_from_hours(hours), strategy.publish_heatmap(fv))
    else:
        with pytest.raises(ValueError):
            state.filter_days(refresh.stored(spark, root, "hours"), spec)


def test_rollup_of_the_state(spark, sample):
    root, df = sample
    attrs = df.select("channel_id", "channel_name", "ch_subscribers", "channel_created").where("channel_id IS NOT NULL").distinct()
    got = state.rollup_from_days(refresh.stored(spark, root, "days"), attrs, AS_OF)
    assert same(got, rollup.rollup_channels(df, attrs, AS_OF))
    assert all("/days/" in f for f in refresh.stored(spark, root, "days").inputFiles())
    with pytest.raises(ValueError):
        state.filter_days(refresh.stored(spark, root, "days"), filters.FilterSpec(categories=("High",)))


def test_states_of_parts_add_up(spark, sample):
    """Merged states of disjoint videos give the same reports as one state."""
    _, df = sample
    parts = state.channel_days(df.where("views < 300")).union(state.channel_days(df.where("views >= 300")))
    assert same(state.trend_from_days(state.filter_days(parts)), state.trend_from_days(state.filter_days(state.channel_days(df))))


def test_first_round_reads_the_sketches_only(spark, sample, monkeypatch):
    root, df = sample
    read, real = [], qs._read
    monkeypatch.setattr(qs, "_read", lambda merged, grid: read.append(merged.inputFiles()) or real(merged, grid))
    got = refresh.thresholds(spark, root)
    assert read[0] and all("/sketches/" in f for f in read[0])
    assert list(got) == qs.exact_quantiles(df, "views", [0.25, 0.75])
    # a small candidate limit: the search goes on over the videos from there
    deep = qs.multi_exact_quantiles(df, {"views": [0.1, 0.5]}, max_candidates=20, sketches=refresh.stored(spark, root, "sketches"))
    assert deep["views"] == qs.exact_quantiles(df, "views", [0.1, 0.5])
