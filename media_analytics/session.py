"""Spark session settings and lineage helpers.

The library never creates a session behind the caller's back: operators take
DataFrames. ``local_session`` is for tests, the bench and examples only; on a
cluster the job's own session (with its shared ``spark.checkpoint.dir``) is used.
"""

from __future__ import annotations

import os
import tempfile

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

# Settings every session of this library should have. AQE re-plans joins
# (broadcast when a side is measured small, split skewed partitions) and
# coalesces small shuffle partitions at run time.
RECOMMENDED_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "media_analytics") -> SparkSession:
    """Session for tests and the bench: ``local[cores]``, UI off, UTC."""
    b = (SparkSession.builder.master(f"local[{cores}]").appName(app)
         .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
         .config("spark.driver.memory", "16g")
         .config("spark.sql.execution.arrow.pyspark.enabled", "true")
         .config("spark.ui.showConsoleProgress", "false"))
    for k, v in RECOMMENDED_CONF.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return ``spark.checkpoint.dir``; set a scratch one only when unset.

    On a cluster the setting names a shared folder and is left alone (and a
    cluster without it is an error: a machine-local folder would not survive
    an executor loss). Only a ``local[...]`` session without the setting gets a
    fresh temporary folder.
    """
    sc = spark.sparkContext
    cur = sc._jsc.sc().getCheckpointDir()
    if cur.isDefined():
        return cur.get()
    conf = spark.conf.get("spark.checkpoint.dir", None)
    if not conf:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is not set: name a shared folder for this cluster")
        conf = tempfile.mkdtemp(prefix="ma-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(conf)
    return conf


def persist(df: DataFrame) -> DataFrame:
    """Keep a reused intermediate in memory, spilling to disk (never only memory).

    Lost blocks are recomputed from lineage, so an executor loss costs time,
    not correctness.
    """
    return df.persist(StorageLevel.MEMORY_AND_DISK)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared ``spark.checkpoint.dir``."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
