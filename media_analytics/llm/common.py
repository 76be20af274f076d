"""Helpers shared by the operators: tables, shipped code, checkpoints, text blocks,
native word expressions, prefix sums without one big task, connected components."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

# Bytes of A-Z to a-z; other bytes stay, so UTF-8 stays valid.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
WORD = r"[^\x20\x09-\x0D]+"
BLOCK_BYTES = 4 << 20  # texts are handled in blocks of about this many bytes


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per application, so that Python
    workers import it whatever their working folder is."""
    sc = spark.sparkContext
    if getattr(sc, "_llm_shipped", False):
        return
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    if os.path.isdir(package):
        name = os.path.join(tempfile.mkdtemp(prefix="llm-code-"), "media_analytics_code.zip")
        with zipfile.ZipFile(name, "w") as z:
            for folder, _, files in os.walk(package):
                for f in files:
                    if f.endswith(".py"):
                        full = os.path.join(folder, f)
                        z.write(full, os.path.relpath(full, os.path.dirname(package)))
        sc.addPyFile(name)
    sc._llm_shipped = True


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the folder that ``spark.checkpoint.dir`` names: a
    lost executor then costs no recomputation before this point, and what reads
    it sees one fixed result."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared checkpoint folder for files of a job."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def lower_az(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def crc_of_id(doc_id: Column) -> Column:
    """crc32 of the id as text; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary"))


def hashed_sample(df: DataFrame, rows: int, n: int, *keys: str) -> DataFrame:
    """About ``rows`` of the ``n`` rows of ``df``, chosen by a hash of ``keys``: the same
    ones in each run, without sorting or moving the others."""
    if n <= rows:
        return df
    return df.where(F.pmod(F.xxhash64(F.lit("sample"), *keys), F.lit(1 << 40)) < int(rows / n * (1 << 40)))


_caches: dict[str, dict] = {}


def worker_cache(name: str) -> dict:
    """A dict that a Python worker keeps between its tasks, until it works for another operator."""
    return _caches.setdefault(name, {})


def text_blocks(batches, text: str = "text", limit: int = BLOCK_BYTES, keep: str | None = None):
    """Arrow batches cut into runs of rows with about ``limit`` bytes of text (one
    row at least); yields (batch, texts as bytes or None). Only one run is held as
    Python objects at a time. ``keep`` names the operator's own ``worker_cache``;
    those of other operators are emptied."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    for name, cache in _caches.items():
        if name != keep:
            cache.clear()
    for batch in batches:
        at = batch.schema.get_field_index(text)
        sizes = pc.fill_null(pc.binary_length(batch.column(at)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        runs = np.cumsum(sizes + 16) // limit
        cuts = [0, *(np.flatnonzero(np.diff(runs)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            if b > a:
                part = batch.slice(a, b - a)
                yield part, part.column(at).cast(pa.binary()).to_pylist()
    pa.default_memory_pool().release_unused()


def prefix_sums(df: DataFrame, group: list[str], order: list[str], value: str, out: str,
                partitions: int | None = None) -> DataFrame:
    """``df`` with ``out`` = sum of the integer ``value`` over the rows of the same
    ``group`` before this one in ``order``, without a window over a whole group.

    Rows are dealt by range of (group, order), so a group with a third of all
    rows spreads over a third of the partitions. The partition number is fixed
    by a checkpoint. A window inside (group, partition) and one over the totals
    per (group, partition) add up to the prefix sum. Null groups are one group.
    """
    spark = df.sparkSession
    p = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [*group, *order]
    dealt = cut(df.repartitionByRange(p, *[F.col(c).asc_nulls_last() for c in keys])
                .withColumn("__part", F.spark_partition_id()))
    totals = dealt.groupBy(*group, "__part").agg(F.sum(value).alias("__total"))
    w = Window.partitionBy(*group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select(*[F.col(c).alias(f"__g_{c}") for c in group], F.col("__part").alias("__p"),
                           F.coalesce(F.sum("__total").over(w), F.lit(0)).alias("__before"))
    same = F.col("__part") == F.col("__p")
    for c in group:
        same = same & F.col(c).eqNullSafe(F.col(f"__g_{c}"))
    inner = (Window.partitionBy(*group, "__part").orderBy(*[F.col(c).asc_nulls_last() for c in order])
             .rowsBetween(Window.unboundedPreceding, -1))
    return (dealt.withColumn("__inner", F.coalesce(F.sum(value).over(inner), F.lit(0)))
            .join(before, same)
            .withColumn(out, F.col("__before") + F.col("__inner"))
            .select(*df.columns, out))


def connected_components(edges: DataFrame) -> DataFrame:
    """Edges (a, b) of integers -> one row (node, root) per node, root the smallest
    node of its component. Large-star / small-star rounds until nothing changes;
    each round is checkpointed, links never reach the driver."""
    def state(e: DataFrame):
        return e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()

    e = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = state(e)
    while before[0]:
        both = e.union(e.select(F.col("b"), F.col("a")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        # large star: every larger neighbour of a node is tied to the least one
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        # small star: the smaller neighbours of a node are tied to the least one
        small = (large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .union(low.select("a", F.col("m").alias("b"))).distinct())
        e = cut(small)
        after = state(e)
        if after == before:
            break
        before = after
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
