"""Video / channel views over the driver's TPC-H-style parquet tables.

One order is one video, one customer is one channel (column meanings in
FIXTURES.md). Only the columns used are read, so the parquet scans prune.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import ntz_literal

# fixed value: the "now" of the test views, so ages repeat
AS_OF = datetime(2001, 12, 31, 0, 0, 0)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _int_sum(x):
    """Sum of values rounded to whole numbers first (exact integer arithmetic)."""
    return F.sum(F.round(x).cast("bigint")).cast("bigint")


def spread(df: DataFrame, partitions: int | None) -> DataFrame:
    """Deal a scan over ``partitions`` tasks if the caller asks for it (a table that is
    one small file); a large scan has its own partitions and needs none."""
    return df.repartition(partitions) if partitions else df


def test_video_table(spark: SparkSession, sf_dir: str, partitions: int | None = None) -> DataFrame:
    """Typed videos (``video_raw`` after C1-C3): one row per order."""
    li = (read_table(spark, sf_dir, "lineitem")
          .groupBy("l_orderkey")
          .agg(_int_sum(F.col("l_extendedprice") * 100).alias("cents"),
               _int_sum(F.col("l_extendedprice") * F.col("l_discount")).alias("li_likes"),
               _int_sum(F.col("l_extendedprice") * F.col("l_tax") / 10).alias("li_comments"),
               F.sum(F.col("l_quantity").cast("bigint")).cast("bigint").alias("qty")))
    orders = spread(read_table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority"), partitions)
    v = orders.join(li, orders.o_orderkey == li.l_orderkey, "left")
    minutes = (F.col("o_orderkey") * 37 % 1440).cast("int")
    return v.select(
        F.col("o_orderkey").alias("video_id"),
        F.concat(F.col("o_orderpriority"), F.repeat(F.lit("x"), (F.col("o_orderkey") % 97).cast("int"))).alias("title"),
        F.col("o_custkey").alias("channel_id"),
        (F.col("o_orderdate") + F.make_dt_interval(F.lit(0), F.lit(0), minutes, F.lit(0))).alias("publish_date"),
        (F.coalesce(F.col("qty"), F.lit(0)) / F.lit(6.0)).alias("duration_minutes"),
        F.floor(F.coalesce(F.col("cents"), F.lit(0)) / F.lit(100.0)).cast("bigint").alias("views"),
        F.coalesce(F.col("li_likes"), F.lit(0)).cast("bigint").alias("likes"),
        F.coalesce(F.col("li_comments"), F.lit(0)).cast("bigint").alias("comments"),
    )


def test_video_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """channel_id of every test video: one pruned column of the orders scan
    (what the hot-channel count needs, without the lineitem join)."""
    return read_table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("channel_id"))


def test_channel_table(spark: SparkSession, sf_dir: str, as_of: datetime = AS_OF) -> DataFrame:
    """Channel attributes (``channel_raw`` after typing): one row per customer."""
    c = read_table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal")
    days = (F.col("c_custkey") % 600 + 1).cast("int")
    return c.select(
        F.col("c_custkey").alias("channel_id"),
        F.col("c_name").alias("channel_name"),
        F.when(F.col("c_acctbal") > 0, F.floor("c_acctbal")).otherwise(F.lit(0)).cast("bigint").alias("ch_subscribers"),
        (ntz_literal(as_of) - F.make_dt_interval(days, F.lit(0), F.lit(0), F.lit(0))).alias("channel_created"),
    )


def dirty_video_table(spark: SparkSession, sf_dir: str, partitions: int | None = None) -> DataFrame:
    """The typed videos with the faults that real tables have: no or unmatched
    channels, missing dates, missing and repeated ids. Which rows: by order key."""
    v = test_video_table(spark, sf_dir, partitions)
    k = F.col("video_id")
    dirty = v.select(
        F.when(k % 29 != 0, k).alias("video_id"), "title",
        F.when(k % 10 == 5, F.col("channel_id") + 10_000_000).when(k % 10 != 3, F.col("channel_id")).alias("channel_id"),
        F.when(k % 23 != 0, F.col("publish_date")).alias("publish_date"),
        "duration_minutes", "views", "likes", "comments", (k % 31 == 0).alias("twice"))
    return dirty.withColumn("copy", F.explode(F.sequence(F.lit(1), F.when(F.col("twice"), 2).otherwise(1)))).drop("twice", "copy")


def dirty_category(videos: DataFrame) -> DataFrame:
    """Some categories replaced by text that is none of the labels (by views)."""
    return videos.withColumn("performance_category", F.when(F.col("views") % 37 == 0, "viral: yes")
                             .otherwise(F.col("performance_category")))


def fetched_videos(typed: DataFrame, fetch: int) -> DataFrame:
    """The rows of the first or second fetch of the test videos, with ``fetched_at``. The first
    lacks every fifth video and has older counters and dates of some. The second has these,
    every 14th video also as an older row of the same fetch."""
    k = F.col("video_id")
    older = typed.select([
        F.when(k % 7 == 0, F.floor(F.col(c) / 2)).otherwise(F.col(c)).cast("bigint").alias(c) if c in ("views", "likes")
        else F.when(k % 11 == 0, F.col(c) - F.make_dt_interval(F.lit(400))).otherwise(F.col(c)).alias(c) if c == "publish_date"
        else F.col(c) for c in typed.columns])
    if fetch == 1:
        return older.where(k % 5 != 1).withColumn("fetched_at", F.lit(1))
    return (typed.where((k % 5 == 1) | (k % 7 == 0) | (k % 11 == 0)).withColumn("fetched_at", F.lit(3))
            .unionByName(older.where(k % 14 == 0).withColumn("fetched_at", F.lit(2))))


def broken_titles(videos: DataFrame) -> DataFrame:
    """Titles as people write them: some with quotes, commas and line breaks."""
    k, t = F.col("video_id"), F.col("title")
    return videos.withColumn("title", F.when(k % 13 == 0, F.concat(t, F.lit('\n"second", line\n\nend')))
                             .when(k % 7 == 0, F.concat(t, F.lit(' "q", x'))).otherwise(t))


# ---- landed pages made from the tables ----------------------------------------

PAGE_ITEMS = 50  # items of one response page


def _page_text(items: DataFrame, key: str, fields) -> DataFrame:
    """Pages of up to PAGE_ITEMS successive items as JSON text; null fields are left out."""
    page = F.floor(F.col(key) / PAGE_ITEMS)
    return (items.groupBy(page.alias("page")).agg(F.collect_list(fields).alias("items"))
            .select(F.to_json(F.struct("items", F.concat(F.lit("t"), F.col("page")).alias("nextPageToken"))).alias("value")))


def _counter(n, key):
    """A counter as text: sometimes missing, no number, or written as a decimal."""
    return (F.when(key % 5 == 0, F.lit(None)).when(key % 17 == 0, "n/a")
            .when(key % 3 == 0, F.concat(n.cast("string"), F.lit(".0"))).otherwise(n.cast("string")))


def _iso(ts, key):
    """A UTC time as ISO text in one of three zones, one value of no known form."""
    shown = lambda minutes: F.date_format(ts + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(minutes)),
                                          "yyyy-MM-dd'T'HH:mm:ss")
    return (F.when(key % 41 == 0, "last week").when(key % 3 == 0, F.concat(shown(0), F.lit("Z")))
            .when(key % 3 == 1, F.concat(shown(330), F.lit("+05:30"))).otherwise(F.concat(shown(-480), F.lit("-0800"))))


def video_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Video pages as JSON text (column value), built from the typed test videos."""
    v = test_video_table(spark, sf_dir)
    k, sec = F.col("video_id"), F.round(F.col("duration_minutes") * 60).cast("bigint")
    duration = (F.when(k % 11 == 0, "P1DT2H").when(k % 13 == 0, "PT").otherwise(F.concat(
        F.lit("PT"), F.when(sec >= 3600, F.concat((sec / 3600).cast("bigint"), F.lit("H"))).otherwise(""),
        F.concat(F.floor(sec % 3600 / 60), F.lit("M")), F.concat(sec % 60, F.lit("S")))))
    title = F.concat(F.col("title"), F.when(k % 7 == 0, ' "q", x').otherwise(""))
    item = F.struct(
        F.concat(F.lit("v"), k).alias("id"),
        F.struct(title.alias("title"), F.concat(F.lit("c"), "channel_id").alias("channelId"),
                 _iso(F.col("publish_date"), k).alias("publishedAt")).alias("snippet"),
        F.struct(_counter(F.col("views"), k).alias("viewCount"), _counter(F.col("likes"), k + 1).alias("likeCount"),
                 _counter(F.col("comments"), k + 2).alias("commentCount")).alias("statistics"),
        F.struct(duration.alias("duration")).alias("contentDetails"))
    return _page_text(v, "video_id", item)


def channel_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Channel pages as JSON text, built from the channel attributes."""
    c = test_channel_table(spark, sf_dir)
    k = F.col("channel_id")
    item = F.struct(
        F.concat(F.lit("c"), k).alias("id"),
        F.struct(F.col("channel_name").alias("title"), _iso(F.col("channel_created"), k).alias("publishedAt")).alias("snippet"),
        F.struct(_counter(F.col("ch_subscribers"), k).alias("subscriberCount"), _counter(k * 1000, k + 1).alias("viewCount"),
                 _counter(k % 100, k + 2).alias("videoCount")).alias("statistics"),
        F.struct(F.struct(F.concat(F.lit("p"), k).alias("uploads")).alias("relatedPlaylists")).alias("contentDetails"))
    return _page_text(c, "channel_id", item)


def playlist_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Playlist pages that list four of five videos as JSON text."""
    o = read_table(spark, sf_dir, "orders").select("o_orderkey").where("o_orderkey % 5 <> 4")
    return _page_text(o, "o_orderkey", F.struct(F.struct(F.concat(F.lit("v"), "o_orderkey").alias("videoId"))
                                                .alias("contentDetails")))
