"""Videos and channels stored bucketed by channel: joins and the rollup without a shuffle.

A table of videos is joined to its channels and rolled up by channel again and again. Written
once in buckets of ``channel_id`` (sorted inside), both sides already lie together: the join
(J1, J3) and the group-by (A1) read bucket by bucket and no row moves.

A bucket is one task, so channels above half a fair bucket share, and rows without a
channel, would make a few tasks long. These rows are stored beside the buckets in ordinary
files. At most two such channels per bucket can exist, so their channel rows are
broadcast, and their group-by moves partial sums only.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .joins import hot_keys
from .rollup import rollup_channels

KEY = "channel_id"


@dataclass
class BucketedTables:
    """Names of the two bucketed tables, and the folder of the rows beside them."""
    spark: SparkSession
    videos: str
    channels: str
    beside: str
    buckets: int
    hot: list

    def drop(self) -> None:
        for name in (self.videos, self.channels):
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")


def _store(df: DataFrame, name: str, path: str, buckets: int) -> None:
    """One file per bucket and task: rows are dealt by the key first, as the buckets are."""
    (df.repartition(buckets, KEY).write.format("parquet").option("path", path).mode("overwrite")
     .bucketBy(buckets, KEY).sortBy(KEY).saveAsTable(name))


def store_bucketed(videos: DataFrame, channels: DataFrame, root: str, name: str, buckets: int) -> BucketedTables:
    """Write both tables under ``root`` as tables ``<name>_videos`` and ``<name>_channels``."""
    spark = videos.sparkSession
    found = hot_keys(videos.select(KEY), KEY, partitions=buckets).select(KEY).collect()
    hot = [r[0] for r in found]  # at most two per bucket
    apart = F.col(KEY).isNull() | (F.col(KEY).isin(hot) if hot else F.lit(False))
    out = BucketedTables(spark, f"{name}_videos", f"{name}_channels", f"{root}/beside", buckets, hot)
    _store(videos.where(~apart), out.videos, f"{root}/videos", buckets)
    _store(channels, out.channels, f"{root}/channels", buckets)
    videos.where(apart).write.mode("overwrite").parquet(out.beside)
    return out


def videos_with_channels(t: BucketedTables, how: str = "left") -> tuple[DataFrame, DataFrame]:
    """J1 / J2 in two parts: (rows from the buckets, rows beside them), each with
    the channel's columns."""
    spark = t.spark
    channels = spark.table(t.channels)
    cold = spark.table(t.videos).join(channels.hint("merge"), KEY, how)
    beside = spark.read.parquet(t.beside)
    own = channels.where(F.col(KEY).isin(t.hot) if t.hot else F.lit(False))
    return cold, beside.join(F.broadcast(own), KEY, how)  # at most two channels per bucket


def bucketed_rollup(t: BucketedTables, enrich_rows, as_of: datetime) -> DataFrame:
    """A1 + A2 (``rollup_channels``) over both parts; ``enrich_rows`` adds the measures to
    joined rows. A channel lies in one part only, so the parts' results are put together."""
    cold, beside = videos_with_channels(t)
    channels = t.spark.table(t.channels)
    return (rollup_channels(enrich_rows(cold), channels.hint("merge"), as_of)
            .unionByName(rollup_channels(enrich_rows(beside), channels, as_of)))
