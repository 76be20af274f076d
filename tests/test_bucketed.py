"""Bucketed tables: no exchange on the cold path, hot and missing channels beside the buckets."""

from datetime import datetime

import pytest

from media_analytics.operators import bucketed, enrich, rollup

AS_OF = datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    videos = spark.createDataFrame(
        [(f"v{k}", "t", None if k % 9 == 0 else "c0" if k % 3 == 0 else f"c{k % 300}", datetime(2023, 1, 1 + k % 28), 3.0, k, k // 5, k // 9)
         for k in range(6000)],
        "video_id string, title string, channel_id string, publish_date timestamp_ntz, duration_minutes double, views long, "
        "likes long, comments long")
    channels = spark.createDataFrame([(f"c{k}", f"n{k}", k, datetime(2020, 1, 1)) for k in range(290)],
                                     "channel_id string, channel_name string, ch_subscribers long, channel_created timestamp_ntz")
    t = bucketed.store_bucketed(videos, channels, f"{tmp_path_factory.mktemp('b')}", "test_bucketed", 8)
    yield videos, channels, t
    t.drop()


def plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def rows(df):
    """Sums of doubles depend on their order in the last digits."""
    return sorted(str([round(x, 6) if isinstance(x, float) else x for x in r]) for r in df.select(*sorted(df.columns)).collect())


def test_parts(spark, tables):
    videos, _, t = tables
    assert t.hot == ["c0"]
    cold, beside = spark.table(t.videos), spark.read.parquet(t.beside)
    assert cold.where("channel_id IS NULL OR channel_id = 'c0'").count() == 0
    assert cold.count() + beside.count() == videos.count()


@pytest.mark.parametrize("how", ["left", "inner"])
def test_join_equals_the_plain_join_and_moves_nothing(tables, how):
    videos, channels, t = tables
    cold, beside = bucketed.videos_with_channels(t, how)
    assert rows(cold.unionByName(beside)) == rows(videos.join(channels, "channel_id", how))
    text = plan(cold)
    assert "SortMergeJoin" in text and "Exchange" not in text


def test_rollup_equals_the_plain_one_and_moves_nothing(tables):
    videos, channels, t = tables
    measures = lambda v: enrich.with_time_and_rates(v, AS_OF)
    got = bucketed.bucketed_rollup(t, measures, AS_OF)
    want = rollup.rollup_channels(measures(enrich.attach_channel(videos, channels)), channels, AS_OF)
    assert rows(got) == rows(want)
    cold, _ = bucketed.videos_with_channels(t)
    text = plan(rollup.rollup_channels(measures(cold), t.spark.table(t.channels).hint("merge"), AS_OF))
    assert "Exchange" not in text and text.count("SortMergeJoin") >= 2
