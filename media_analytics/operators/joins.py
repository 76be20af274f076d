"""Joins of a large fact table to a key-unique dimension with hot keys split.

Assume one channel may own a third of all videos, or a third of them may have
none. A plain shuffle join on ``channel_id`` would send that third to one task.

* The hot keys are found first: a partial group-by count per key, keeping keys
  with more rows than half a fair share of a shuffle partition. With P
  partitions at most 2 P keys can pass, so the list is small by construction; it
  is read to the driver once and broadcast.
* A hot key gets four salts per fair share it fills, so its rows spread over as
  many join tasks as they deserve. All hot keys together have at most 6 P salts,
  so few dimension rows are copied.
* Rows with a null key match nothing. In a left join their salt is the hash of the
  row, which spreads them over all tasks; in an inner join they are dropped before the shuffle.

The rows take a salt from a hash of the row itself, so a recomputed task after
an executor loss salts the same way. The join on ``(key, salt)`` gives every
task about a fair share, and cold keys join as before. AQE may still turn the
join into a broadcast when the dimension is measured small.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOT_SHARE = 0.5  # a key is hot above this part of a fair partition share
SALTS = 4        # per fair share: more than one, since several salts may meet in one task


def hot_keys(df: DataFrame, key: str, fraction: float | None = None,
             partitions: int | None = None) -> DataFrame:
    """(key, _salts) of the keys that hold more than ``fraction`` of the rows (default:
    half a partition's fair share), with the number of salts each gets."""
    p = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    fraction = HOT_SHARE / p if fraction is None else fraction
    counts = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    total = df.agg(F.count(F.lit(1)).alias("_total"))
    share = F.col("_n") * F.lit(float(p)) / F.col("_total")
    return (counts.crossJoin(F.broadcast(total))  # one-row side
            .where(F.col("_n") > F.col("_total") * F.lit(fraction))
            .select(key, F.ceil(share * SALTS).cast("int").alias("_salts"))
            .where("_salts > 1"))


def salted_join(big: DataFrame, dim: DataFrame, key: str, how: str = "left",
                fraction: float | None = None, partitions: int | None = None,
                key_source: DataFrame | None = None) -> DataFrame:
    """``big.join(dim, key, how)`` for a ``dim`` with one row per key, with each
    hot key and the null key of ``big`` spread over join tasks. Output columns as the
    plain join.

    ``key_source`` (one row per row of ``big``, with the ``key`` column) lets
    the hot keys be counted on a narrow source - e.g. one pruned column of the
    table ``big`` is derived from - instead of re-running ``big``'s lineage."""
    if how not in ("left", "inner"):
        raise ValueError("how must be 'left' or 'inner'")
    spark = big.sparkSession
    p = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    counted = key_source.select(key) if key_source is not None else big.select(key)
    found = hot_keys(counted, key, fraction, p)
    hot = F.broadcast(spark.createDataFrame(found.collect(), found.schema))  # at most 1 / fraction rows
    row_hash = F.xxhash64(*[F.col(c) for c in big.columns])
    n_salts = F.coalesce(F.col("_salts"), F.lit(1))
    rows = big.where(F.col(key).isNotNull()) if how == "inner" else big
    b = (rows.join(hot, key, "left")
         .withColumn("_salt", F.when(F.col(key).isNull(), F.pmod(row_hash, F.lit(1 << 30)))
                     .otherwise(F.pmod(row_hash, n_salts)).cast("int"))
         .drop("_salts"))
    d = (dim.join(hot, key, "left")
         .withColumn("_salt", F.explode(F.sequence(F.lit(0), n_salts - 1)))
         .drop("_salts"))
    out = b.join(d, [key, "_salt"], how).drop("_salt")
    return out.select(key, *[c for c in big.columns if c != key], *[c for c in dim.columns if c != key])
