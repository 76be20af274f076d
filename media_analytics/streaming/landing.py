"""Structured Streaming ingest of landed video pages.

The reference refetches a snapshot on every refresh and replaces the old one.
Here pages that land in a folder are picked up incrementally by the file source,
typed with the same projection as the batch reader (S3, C1-C3) and appended with
their landing time to a parquet table. Reports run on ``current_videos``, the
newest row of each video, so a refetched video counts once. Progress lives in a checkpoint under the
cluster's shared ``spark.checkpoint.dir``, so a restarted or failed query
resumes where it stopped and files are not ingested twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..session import ensure_checkpoint_dir
from ..sources.pages import VIDEO_PAGE, video_rows


def video_page_stream(spark: SparkSession, landing_dir: str, multi_line: bool = False,
                      max_files_per_trigger: int | None = None) -> DataFrame:
    """Streaming DataFrame of typed video rows from JSON pages in ``landing_dir``."""
    r = spark.readStream.schema(VIDEO_PAGE)
    if multi_line:
        r = r.option("multiLine", True)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return video_rows(r.json(landing_dir)).withColumn("landed_at", F.current_timestamp().cast("timestamp_ntz"))


def start_video_ingest(spark: SparkSession, landing_dir: str, table_path: str,
                       checkpoint_location: str | None = None, available_now: bool = True,
                       processing_time: str | None = None, name: str = "video_ingest",
                       multi_line: bool = False) -> StreamingQuery:
    """Append typed video rows to a parquet table. ``available_now`` processes
    what has landed and stops (a scheduled refresh); otherwise the query keeps
    running with ``processing_time`` triggers."""
    if checkpoint_location is None:
        checkpoint_location = f"{ensure_checkpoint_dir(spark).rstrip('/')}/streams/{name}"
    w = (video_page_stream(spark, landing_dir, multi_line).writeStream
         .format("parquet").outputMode("append").option("checkpointLocation", checkpoint_location)
         .queryName(name))
    if available_now:
        w = w.trigger(availableNow=True)
    elif processing_time:
        w = w.trigger(processingTime=processing_time)
    return w.start(table_path)


def current_videos(spark: SparkSession, table_path: str) -> DataFrame:
    """The newest landed row of every video_id (the one with the most views, likes and
    comments among rows of one micro-batch). A partial aggregate, so a video that
    was refetched very often is combined in the tasks first."""
    rows = spark.read.parquet(table_path)
    values = [c for c in rows.columns if c != "video_id"]
    first = [c for c in ("landed_at", "views", "likes", "comments") if c in values]
    order = [*first, *[c for c in values if c not in first]]
    newest = rows.groupBy("video_id").agg(F.max(F.struct(*order)).alias("r"))
    return newest.select("video_id", *[F.col(f"r.{c}").alias(c) for c in values if c != "landed_at"])
