import json
import os
from datetime import datetime

from media_analytics.plans.snapshot import build_snapshot, write_snapshot
from media_analytics.sources import files, pages
from media_analytics.streaming.landing import start_video_ingest

CHANNEL = {"items": [{"id": "c1", "snippet": {"title": "Chan", "publishedAt": "2020-01-02T03:04:05Z"},
                      "statistics": {"subscriberCount": "10", "viewCount": "99", "videoCount": "2"},
                      "contentDetails": {"relatedPlaylists": {"uploads": "p1"}}},
                     {"id": "c2", "snippet": {"title": "Other", "publishedAt": "2019-05-01T00:00:00+02:00"},
                      "statistics": {"subscriberCount": "abc"},
                      "contentDetails": {"relatedPlaylists": {"uploads": "p2"}}}]}
PLAYLIST_1 = {"items": [{"contentDetails": {"videoId": "v1"}}], "nextPageToken": "t"}
PLAYLIST_2 = {"items": [{"contentDetails": {"videoId": "v2"}}, {"contentDetails": {"videoId": "v3"}}]}
VIDEOS = {"items": [
    {"id": "v1", "snippet": {"title": "T", "channelId": "c1", "publishedAt": "2021-01-02T03:04:05Z"},
     "statistics": {"viewCount": "12"}, "contentDetails": {"duration": "PT4M"}},
    {"id": "v2", "snippet": {"title": "Longer title", "channelId": "c1", "publishedAt": "2021-02-03T13:00:00Z"},
     "statistics": {"viewCount": "100", "likeCount": "10", "commentCount": "2"},
     "contentDetails": {"duration": "PT1H2M3S"}},
    {"id": "v3", "snippet": {"title": "x", "channelId": "c2", "publishedAt": "2021-03-04T20:00:00Z"},
     "statistics": {"viewCount": "oops", "likeCount": "1"}, "contentDetails": {"duration": "P1DT2H"}},
    {"id": "v9", "snippet": {"title": "unlisted", "channelId": "c1", "publishedAt": "2021-03-05T20:00:00Z"},
     "statistics": {"viewCount": "5"}, "contentDetails": {"duration": "PT10S"}}]}


def _write(d, name, *pages_):
    os.makedirs(d, exist_ok=True)
    with open(os.path.join(d, name), "w") as f:
        for p in pages_:
            f.write(json.dumps(p) + "\n")
    return d


def test_channel_pages(spark, tmp_dir):
    d = _write(f"{tmp_dir}/ch", "p.json", CHANNEL)
    rows = {r.channel_id: r for r in pages.read_channel_pages(spark, d).collect()}
    assert rows["c1"].channel_name == "Chan" and rows["c1"].ch_subscribers == 10
    assert rows["c1"].playlist_id == "p1" and rows["c1"].channel_created == datetime(2020, 1, 2, 3, 4, 5)
    assert rows["c2"].ch_subscribers is None and rows["c2"].total_views == 0
    assert rows["c2"].channel_created == datetime(2019, 4, 30, 22, 0)  # offset -> UTC
    dash = {r.channel_id: r for r in pages.read_channel_pages(spark, d, missing_subscribers_zero=True).collect()}
    assert dash["c2"].ch_subscribers == 0


def test_playlist_pages_append_all_files(spark, tmp_dir):
    d = _write(f"{tmp_dir}/pl", "a.json", PLAYLIST_1)
    _write(d, "b.json", PLAYLIST_2)
    assert sorted(r.video_id for r in pages.read_playlist_pages(spark, d).collect()) == ["v1", "v2", "v3"]


def test_video_pages_missing_counters(spark, tmp_dir):
    d = _write(f"{tmp_dir}/v", "p.json", VIDEOS)
    rows = {r.video_id: r for r in pages.read_video_pages(spark, d).collect()}
    assert (rows["v1"].views, rows["v1"].likes, rows["v1"].comments) == (12, 0, 0)
    assert rows["v1"].duration_minutes == 4.0 and rows["v3"].duration_minutes is None
    assert rows["v3"].views == 0 and rows["v3"].likes == 1
    assert abs(rows["v2"].duration_minutes - 62.05) < 1e-12


def test_multiline_pages(spark, tmp_dir):
    d = f"{tmp_dir}/ml"
    os.makedirs(d)
    with open(f"{d}/p.json", "w") as f:
        json.dump(VIDEOS, f, indent=2)
    assert pages.read_video_pages(spark, d, multi_line=True).count() == 4


def test_snapshot_and_csv_round_trip(spark, tmp_dir):
    ch = _write(f"{tmp_dir}/ch", "p.json", CHANNEL)
    pl = _write(f"{tmp_dir}/pl", "p.json", PLAYLIST_1, PLAYLIST_2)
    vd = _write(f"{tmp_dir}/vd", "p.json", VIDEOS)
    snap = build_snapshot(spark, ch, vd, datetime(2021, 12, 31), playlist_pages=pl)
    vids = {r.video_id: r for r in snap.videos.collect()}
    assert set(vids) == {"v1", "v2", "v3"}  # v9 is not listed by any playlist
    assert vids["v2"].posting_period == "First" and vids["v2"].duration_minutes == 62.05
    chans = {r.channel_id: r for r in snap.channels.collect()}
    assert chans["c1"].videos == 2 and chans["c1"].total_views == 112 and chans["c1"].subscribers == 10
    prof = snap.profile.first()
    assert (prof.channels, prof.videos, prof.total_views) == (2, 3, 112)
    write_snapshot(snap, f"{tmp_dir}/out_v", f"{tmp_dir}/out_c")
    v2, c2 = files.read_tables_csv(spark, f"{tmp_dir}/out_v", f"{tmp_dir}/out_c")
    back = {r.video_id: r for r in v2.collect()}
    assert back["v2"].views == 100 and back["v2"].publish_date == datetime(2021, 2, 3, 13, 0)
    assert back["v2"].engagement_rate == vids["v2"].engagement_rate
    assert {r.channel_id: r.total_views for r in c2.collect()} == {"c1": 112, "c2": 0}


def test_parquet_sink_partitioned(spark, tmp_dir):
    vd = _write(f"{tmp_dir}/vd", "p.json", VIDEOS)
    v = pages.read_video_pages(spark, vd)
    from pyspark.sql import functions as F
    files.write_table(v.withColumn("publish_year", F.year("publish_date")), f"{tmp_dir}/pq", "parquet",
                      partition_by=["publish_year"])
    assert os.path.isdir(f"{tmp_dir}/pq/publish_year=2021")
    assert spark.read.parquet(f"{tmp_dir}/pq").count() == 4


def test_streaming_ingest_available_now(spark, tmp_dir):
    landing = _write(f"{tmp_dir}/landing", "p1.json", VIDEOS)
    q = start_video_ingest(spark, landing, f"{tmp_dir}/table", f"{tmp_dir}/ckpt")
    q.awaitTermination(120)
    assert spark.read.parquet(f"{tmp_dir}/table").count() == 4
    _write(landing, "p2.json", {"items": VIDEOS["items"][:1]})
    q = start_video_ingest(spark, landing, f"{tmp_dir}/table", f"{tmp_dir}/ckpt")
    q.awaitTermination(120)
    assert spark.read.parquet(f"{tmp_dir}/table").count() == 5  # only the new file is added


def test_csv_in_batch_script_layout(spark, tmp_dir):
    """A video CSV in the batch script's column order, with zone-suffixed times
    and a bad counter, reads back typed by header name."""
    header = ("video_id,title,channel_id,publish_date,duration,views,likes,comments,channel_name,"
              "ch_subscribers,channel_created,duration_minutes,publish_hour,publish_day,publish_month,"
              "publish_year,posting_period,video_age_days,engagement_rate,like_rate,comment_rate,"
              "likes_per_comment,views_per_day,title_length,performance_category")
    rows = ["v1,Hello,c1,2021-01-02 03:04:05+00:00,PT4M,12,3,1,Chan,10,2020-01-02 03:04:05+00:00,4.0,3,"
            "Saturday,2021-01,2021,First,100,33.3,25.0,8.3,3.0,0.12,5,High",
            "v2,x,c1,2021-01-02T05:00:00Z,PT1M,oops,,2,Chan,abc,2020-01-02 03:04:05+00:00,1.0,5,"
            "Saturday,2021-01,2021,First,99,0.0,0.0,0.0,0.0,0.0,1,Low"]
    d = f"{tmp_dir}/batch_csv"
    os.makedirs(d)
    with open(f"{d}/video_stats.csv", "w") as f:
        f.write(header + "\n" + "\n".join(rows) + "\n")
    got = {r.video_id: r for r in files.read_table_csv(spark, d).collect()}
    assert got["v1"].publish_date == datetime(2021, 1, 2, 3, 4, 5) and got["v1"].views == 12
    assert got["v1"].engagement_rate == 33.3 and got["v1"].ch_subscribers == 10
    assert got["v2"].views == 0 and got["v2"].likes == 0 and got["v2"].ch_subscribers is None
    assert got["v2"].publish_date == datetime(2021, 1, 2, 5, 0)


def test_snapshot_command_line(spark, tmp_dir, capsys):
    from media_analytics.plans.snapshot import main
    ch = _write(f"{tmp_dir}/ch", "p.json", CHANNEL)
    vd = _write(f"{tmp_dir}/vd", "p.json", VIDEOS)
    main(["--channel-pages", ch, "--video-pages", vd, "--as-of", "2021-12-31T00:00:00",
          "--out-videos", f"{tmp_dir}/ov", "--out-channels", f"{tmp_dir}/oc", "--format", "parquet"], spark=spark)
    assert "channels=2 videos=4 total_views=117" in capsys.readouterr().out
    assert spark.read.parquet(f"{tmp_dir}/ov").count() == 4
    assert spark.read.parquet(f"{tmp_dir}/oc").count() == 2
