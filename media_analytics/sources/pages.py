"""Landed API response pages (S1-S3) and typing.

The outside service's pages are stored as JSON files (one page per line, or
one pretty-printed page per file with ``multi_line=True``). A folder of pages
is read in one scan - "appending pages" is simply the multi-file read - with a
declared schema (no inference pass), then ``items[]`` is exploded and nested
fields are lifted. Each file is split across tasks by Spark, so the work grows
with the number of pages, not with a driver loop.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalar import duration_minutes

S = T.StringType()

CHANNEL_PAGE = T.StructType([
    T.StructField("items", T.ArrayType(T.StructType([
        T.StructField("id", S),
        T.StructField("snippet", T.StructType([T.StructField("title", S), T.StructField("publishedAt", S)])),
        T.StructField("statistics", T.StructType([T.StructField("subscriberCount", S),
                                                  T.StructField("viewCount", S),
                                                  T.StructField("videoCount", S)])),
        T.StructField("contentDetails", T.StructType([
            T.StructField("relatedPlaylists", T.StructType([T.StructField("uploads", S)]))])),
    ]))),
    T.StructField("nextPageToken", S),
])

PLAYLIST_PAGE = T.StructType([
    T.StructField("items", T.ArrayType(T.StructType([
        T.StructField("contentDetails", T.StructType([T.StructField("videoId", S)]))]))),
    T.StructField("nextPageToken", S),
])

VIDEO_PAGE = T.StructType([
    T.StructField("items", T.ArrayType(T.StructType([
        T.StructField("id", S),
        T.StructField("snippet", T.StructType([T.StructField("title", S), T.StructField("channelId", S),
                                               T.StructField("publishedAt", S)])),
        T.StructField("statistics", T.StructType([T.StructField("viewCount", S),
                                                  T.StructField("likeCount", S),
                                                  T.StructField("commentCount", S)])),
        T.StructField("contentDetails", T.StructType([T.StructField("duration", S)])),
    ]))),
    T.StructField("nextPageToken", S),
])


Pages = str | list[str] | DataFrame  # a path, several, or pages read before


def _read(spark: SparkSession, path: Pages, schema: T.StructType, multi_line: bool) -> DataFrame:
    if isinstance(path, DataFrame):  # pages that are parsed already
        return path
    reader = spark.read.schema(schema).option("mode", "PERMISSIVE")
    if multi_line:
        reader = reader.option("multiLine", True)
    return reader.json(path)


def _items(pages: DataFrame) -> DataFrame:
    return pages.select(F.explode("items").alias("i"))


def count(c: str | Column, zero_if_missing: bool = True) -> Column:
    """Tolerant counter cast; bad text -> NULL, then 0 for video counters. Whole
    numbers keep all digits; decimal text (``123.0``, as columns that once held a
    missing value are written) is read as a number and cut to its whole part."""
    x = F.col(c) if isinstance(c, str) else c
    v = F.coalesce(x.try_cast("bigint"), x.cast("string").try_cast("double").try_cast("bigint"))
    return F.coalesce(v, F.lit(0).cast("bigint")) if zero_if_missing else v


# date, time of day (may be missing), zone: Z, an offset, or none for UTC
_TIME = (r"^\s*(\d{4}-\d{1,2}-\d{1,2})(?:[T ](\d{1,2}:\d{2}(?::\d{2}(?:\.\d+)?)?))?"
         r"\s*(Z|z|UTC|[+-]\d{2}(?::?\d{2})?)?\s*$")
# the form that tables are written in: no zone, nothing left out
_PLAIN_TIME = r"\A\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:\.\d{1,6})?\z"


def utc_timestamp(c: str | Column) -> Column:
    """ISO-8601 text (``Z``, an offset, or no zone for UTC) -> UTC wall clock as
    TIMESTAMP_NTZ; text that does not parse becomes NULL. The offset is taken from
    the text and subtracted, so the session time zone plays no part. Text in the plain form
    is cast at once; any other is taken apart."""
    x = (F.col(c) if isinstance(c, str) else c).cast("string")
    day, clock, zone = (F.regexp_extract(x, _TIME, i) for i in (1, 2, 3))
    wall = F.concat(day, F.lit(" "), F.when(clock == "", "00:00:00").otherwise(clock)).try_cast("timestamp_ntz")
    digits = F.regexp_replace(zone, "[^0-9]", "")
    minutes = F.coalesce(F.substring(digits, 1, 2).try_cast("int"), F.lit(0)) * 60 + F.coalesce(
        F.substring(digits, 3, 2).try_cast("int"), F.lit(0))
    offset = F.when(F.substring(zone, 1, 1) == "-", -minutes).otherwise(minutes)
    apart = wall - F.make_dt_interval(F.lit(0), F.lit(0), offset, F.lit(0))
    return F.when(x.rlike(_PLAIN_TIME), x.try_cast("timestamp_ntz")).otherwise(apart)


def parse_pages(text: DataFrame, schema: T.StructType, column: str = "value") -> DataFrame:
    """Pages held as JSON text in a column, parsed with the declared schema."""
    return text.select(F.from_json(column, schema).alias("p")).select("p.*")


def read_channel_pages(spark: SparkSession, path: Pages, multi_line: bool = False,
                       missing_subscribers_zero: bool = False) -> DataFrame:
    """One row per channel item: channel_id, channel_name, ch_subscribers
    (NULL when not a number, or 0 with ``missing_subscribers_zero`` as the
    dashboard does), total_views, total_videos, playlist_id, channel_created."""
    i = _items(_read(spark, path, CHANNEL_PAGE, multi_line))
    return i.select(
        F.col("i.id").alias("channel_id"),
        F.col("i.snippet.title").alias("channel_name"),
        count("i.statistics.subscriberCount", zero_if_missing=missing_subscribers_zero).alias("ch_subscribers"),
        count("i.statistics.viewCount").alias("total_views"),
        count("i.statistics.videoCount").alias("total_videos"),
        F.col("i.contentDetails.relatedPlaylists.uploads").alias("playlist_id"),
        utc_timestamp("i.snippet.publishedAt").alias("channel_created"),
    )


def read_playlist_pages(spark: SparkSession, path: Pages, multi_line: bool = False) -> DataFrame:
    """The video ids listed in all pages of all upload playlists."""
    i = _items(_read(spark, path, PLAYLIST_PAGE, multi_line))
    return i.select(F.col("i.contentDetails.videoId").alias("video_id")).where(F.col("video_id").isNotNull())


def read_video_pages(spark: SparkSession, path: Pages, multi_line: bool = False,
                     round_digits: int | None = None) -> DataFrame:
    """S3 + C1-C3: typed videos; a missing or bad counter becomes 0; the ISO
    duration becomes minutes (NULL when it is not a ``PT...`` duration)."""
    return video_rows(_read(spark, path, VIDEO_PAGE, multi_line), round_digits)


def video_rows(video_pages: DataFrame, round_digits: int | None = None) -> DataFrame:
    """The S3 projection of video pages (batch or streaming DataFrame)."""
    i = _items(video_pages)
    return i.select(
        F.col("i.id").alias("video_id"),
        F.col("i.snippet.title").alias("title"),
        F.col("i.snippet.channelId").alias("channel_id"),
        utc_timestamp("i.snippet.publishedAt").alias("publish_date"),
        F.col("i.contentDetails.duration").alias("duration"),
        duration_minutes("i.contentDetails.duration", round_digits).alias("duration_minutes"),
        count("i.statistics.viewCount").alias("views"),
        count("i.statistics.likeCount").alias("likes"),
        count("i.statistics.commentCount").alias("comments"),
    )


def listed_videos(videos: DataFrame, playlist_ids: DataFrame) -> DataFrame:
    """Keep the video rows whose id was listed by a playlist page (left-semi
    join: no duplication, no broadcast assumption on the id list)."""
    return videos.join(playlist_ids.select("video_id").distinct(), "video_id", "left_semi")
