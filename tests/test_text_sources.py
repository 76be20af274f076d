"""C1-C3 and X2 on text as other writers leave it, in three session zones."""

from datetime import datetime

import pandas as pd
import pytest
from pyspark.sql import functions as F

from media_analytics.functions.scalar import duration_minutes
from media_analytics.sources import files, pages


@pytest.fixture(params=["UTC", "Asia/Tokyo", "America/New_York"])
def zone(spark, request):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", request.param)
    yield request.param
    spark.conf.set("spark.sql.session.timeZone", before)


def test_counters(spark):
    rows = [("12", 12), ("123.0", 123), ("1000.0", 1000), ("12.9", 12), ("9007199254740993", 9007199254740993),
            ("", 0), ("abc", 0), (None, 0), ("nan", 0), ("1e400", 0), ("-5", -5)]
    df = spark.createDataFrame(rows, "t string, want long").withColumn("got", pages.count("t"))
    assert [r.got for r in df.collect()] == [w for _, w in rows]
    assert df.select(pages.count("t", zero_if_missing=False).alias("x")).where("x IS NULL").count() == 5


def test_times_do_not_depend_on_the_session_zone(spark, zone):
    rows = [("2021-11-07T06:30:00Z", datetime(2021, 11, 7, 6, 30)), ("2021-11-07T01:30:00-05:00", datetime(2021, 11, 7, 6, 30)),
            ("2021-03-28T02:30:00+0100", datetime(2021, 3, 28, 1, 30)), ("2021-01-02 03:04:05", datetime(2021, 1, 2, 3, 4, 5)),
            ("2021-01-02T03:04:05.250Z", datetime(2021, 1, 2, 3, 4, 5, 250000)), ("2021-01-02", datetime(2021, 1, 2)),
            ("2021-01-02 03:04:05+00:00", datetime(2021, 1, 2, 3, 4, 5)), ("last week", None), ("", None), (None, None),
            ("2021-13-02T00:00:00Z", None)]
    df = spark.createDataFrame([(t,) for t, _ in rows], "t string").select(pages.utc_timestamp("t").alias("x"))
    assert [r.x for r in df.collect()] == [w for _, w in rows]


def test_long_durations_do_not_raise(spark):
    df = spark.createDataFrame([("PT99999999999999999999M",), ("PT1H2M3S",), ("P1D",)], "d string")
    assert [r.m for r in df.select(duration_minutes("d").alias("m")).collect()] == [1e20, pytest.approx(62.05), None]


def test_csv_as_pandas_writes_it(spark, zone, tmp_dir):
    v = pd.DataFrame({"video_id": ["a", "b", "c"], "title": ['He said "hi", ok', "two\nlines", "plain"],
                      "publish_date": pd.to_datetime(["2021-01-02 03:04:05", None, "2021-11-07 06:30:00"], utc=True),
                      "views": [123.0, None, 7.0], "ch_subscribers": [1000.0, None, 5.0], "duration_minutes": [1.5, 2.0, None]})
    v.to_csv(f"{tmp_dir}/v.csv", index=False)
    rows = {r.video_id: r for r in files.read_table_csv(spark, f"{tmp_dir}/v.csv").collect()}
    assert {k: r.title for k, r in rows.items()} == dict(zip(v.video_id, v.title))
    assert [rows[k].views for k in "abc"] == [123, 0, 7]
    assert [rows[k].ch_subscribers for k in "abc"] == [1000, None, 5]
    assert [rows[k].publish_date for k in "abc"] == [datetime(2021, 1, 2, 3, 4, 5), None, datetime(2021, 11, 7, 6, 30)]


def test_own_csv_reads_back(spark, zone, tmp_dir):
    df = spark.createDataFrame([("a", 'q "x", y\nz \\ w', 5, datetime(2021, 11, 7, 6, 30))],
                               "video_id string, title string, views long, publish_date timestamp_ntz")
    files.write_table(df, f"{tmp_dir}/t", "csv")
    assert files.read_table_csv(spark, f"{tmp_dir}/t").select(*df.columns).collect() == df.collect()


def test_pages_from_text_and_from_a_frame(spark):
    text = spark.createDataFrame([('{"items":[{"id":"v1","statistics":{"viewCount":"3.0"}}]}',), ("not json",)], "value string")
    got = pages.read_video_pages(spark, pages.parse_pages(text, pages.VIDEO_PAGE)).collect()
    assert [(r.video_id, r.views, r.likes, r.publish_date) for r in got] == [("v1", 3, 0, None)]


def test_newest_landed_row_per_video(spark, tmp_dir):
    from media_analytics.streaming import landing

    first = '{"items":[{"id":"v1","statistics":{"viewCount":"3"}},{"id":"v2","statistics":{"viewCount":"8"}}]}'
    again = '{"items":[{"id":"v1","statistics":{"viewCount":"9"}}]}'
    for k, page in enumerate((first, again)):
        spark.createDataFrame([(page,)], "value string").coalesce(1).write.mode("append").text(f"{tmp_dir}/in")
        landing.start_video_ingest(spark, f"{tmp_dir}/in", f"{tmp_dir}/table", f"{tmp_dir}/ckpt").awaitTermination()
    assert spark.read.parquet(f"{tmp_dir}/table").count() == 3
    got = {r.video_id: r.views for r in landing.current_videos(spark, f"{tmp_dir}/table").collect()}
    assert got == {"v1": 9, "v2": 8}


def test_null_keys_spread_over_the_join_tasks(spark):
    from media_analytics.operators.joins import salted_join

    big = spark.range(20_000).selectExpr("id", "CASE WHEN id % 2 = 0 THEN NULL ELSE id % 500 END AS k")
    dim = spark.range(500).selectExpr("id AS k", "id * 2 AS attr")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = salted_join(big, dim, "k", "left", partitions=8)
        sizes = sorted(r.n for r in out.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).collect())
        assert sum(sizes) == 20_000 and sizes[-1] < 2 * sizes[len(sizes) // 2]
        assert out.where("k IS NOT NULL AND attr <> k * 2").count() == 0
        assert salted_join(big, dim, "k", "inner", partitions=8).count() == 10_000
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_labels_bound_what_is_broadcast(spark):
    from media_analytics.operators import performance

    v = spark.range(3000).selectExpr("CASE WHEN id < 10 THEN 'High' ELSE concat('text ', id) END AS performance_category")
    got = {r.performance_category: (r.videos, r.pct) for r in performance.category_mix(v).collect()}
    assert got == {"High": (10, pytest.approx(1 / 3)), "Medium": (0, 0.0), "Low": (0, 0.0)}


def test_all_means_what_can_be_selected(spark):
    from media_analytics.operators import filters

    day = datetime(2020, 1, 1)
    rows = [(1, day, "One", "High"), (2, None, "One", "High"), (3, day, None, "High"), (4, day, "One", None),
            (5, day, "One", "viral"), (6, day, "Gone", "Low")]
    v = spark.createDataFrame(rows, "video_id long, publish_date timestamp_ntz, channel_name string, performance_category string")
    c = spark.createDataFrame([("One", 1), (None, 2)], "channel_name string, videos long")
    assert sorted(r.video_id for r in filters.apply_filters(v, channels=c).collect()) == [1]
    assert sorted(r.video_id for r in filters.apply_filters(v).collect()) == [1, 6]
    with pytest.raises(ValueError, match="no videos match"):
        filters.select_report(v, c, filters.FilterSpec(channels=("Nobody",)))
