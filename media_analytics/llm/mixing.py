"""Mixing sources to target weights by systematic sampling, DataFrame functions only.

* Size of a document: its words ``[^\\x20\\x09-\\x0D]+`` (null text: 0).
* Targets: the sources, by code point with null last, weigh 1, 2, 3, repeating,
  and share the sum of all sizes. A target stops at ``MAX_REPEAT`` times its
  source's size; the excess goes to the others by weight until none is above.
  The end of those rounds is min(3 * size, level * weight) with one level for all, found
  from prefix sums over the sources sorted by 3 * size / weight.
* Expected copies of a document: target / source size, as an integer count of
  2^-20 (exact sums in any order). The documents of a source are laid out by
  (size, doc_id, text hash) and their expected copies are prefix-summed. One offset per
  source, derived from a fixed seed and its name, is added. A document is
  emitted once per integer boundary crossed. Laid out by size, the words taken
  differ from the target by about one document.
* The prefix sums use no window over a whole source (``common.prefix_sums``):
  a source with a third of all rows spreads over a third of the partitions.

A document is taken at most three times. Reruns agree: nothing depends on
partitioning. Nulls: a null source is a source of its own; a null text has size
0 and takes no words. Repeated rows are separate documents; ties in size are laid
out by doc_id (null last). An empty table gives an empty result. ``emit`` keeps
all columns, whatever their names (own columns begin with ``__``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, prefix_sums, table

MAX_REPEAT = 3
UNIT = 1 << 20     # expected copies are counted in parts of one copy
SEED = "mix-1"
BROADCAST_SOURCES = 50_000
COPIES = 1000      # copies of a row that one task makes at once


def word_count(text):
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame) -> DataFrame:
    """(source, size) rows -> (source, source_size, target, unit_copies, offset), one
    row per source. Its windows run over one row per source."""
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    s = s.withColumn("weight", (F.row_number().over(by_name) - 1) % 3 + 1)
    # filled: sources that stop at their limit, the first ones in this order
    ratio = F.col("source_size") / F.col("weight")
    order = [ratio.asc(), F.col("source").asc_nulls_last()]
    earlier = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    rest = (F.sum("source_size").over(everything)
            - MAX_REPEAT * F.coalesce(F.sum("source_size").over(earlier), F.lit(0)))
    open_weight = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(earlier), F.lit(0))
    # the level if all earlier sources stop and this one does not
    s = s.withColumn("level", rest.cast("double") / open_weight)
    open_ = F.col("level") * F.col("weight") <= MAX_REPEAT * F.col("source_size")
    s = s.withColumn("nth", F.row_number().over(Window.orderBy(*order)))
    s = s.withColumn("level", F.min(F.when(open_, F.struct("nth", "level"))).over(everything)["level"])
    s = s.withColumn("target", F.least((F.lit(MAX_REPEAT) * F.col("source_size")).cast("double"),
                                       F.col("level") * F.col("weight")))
    copies = F.when(F.col("source_size") > 0,
                    F.floor(F.col("target") / F.col("source_size") * UNIT)).otherwise(F.lit(0))
    digest = F.md5(F.concat(F.lit(SEED), F.coalesce(F.concat(F.lit(":"), "source"), F.lit(""))))
    offset = F.conv(F.substring(digest, 1, 5), 16, 10).cast("long")  # 20 bits
    return s.select("source", "source_size", "target", copies.cast("long").alias("unit_copies"),
                    offset.alias("offset"))


def mix(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, source, *keep, size, source_size, target, copies) per row of ``docs``."""
    rows = cut(docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), *keep,
                           word_count(F.col("text")).alias("size"),
                           F.xxhash64(F.lit(1), "text").alias("order_hash")))
    targets = cut(source_targets(rows)).withColumnRenamed("source", "s")
    if targets.count() <= BROADCAST_SOURCES:  # else a shuffle join, which AQE splits at hot sources
        targets = F.broadcast(targets)
    priced = rows.join(targets, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    summed = prefix_sums(priced, ["source"], ["size", "doc_id", "order_hash"], "unit_copies", "before")
    lower = F.expr(f"(before + offset) div {UNIT}")
    upper = F.expr(f"(before + unit_copies + offset) div {UNIT}")
    return (summed.withColumn("copies", (upper - lower).cast("int"))
            .select("doc_id", "source", *keep, "size", "source_size", "target", "copies"))


def op9_mixing(spark, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


OP9_SQL = f"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size, text
  FROM documents),
t AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight FROM t),
lv AS (
  SELECT *, row_number() OVER (ORDER BY source_size / weight, source NULLS LAST) AS nth,
    (sum(source_size) OVER () - {MAX_REPEAT} * coalesce(sum(source_size) OVER before, 0))::DOUBLE
      / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS level
  FROM w WINDOW before AS (ORDER BY source_size / weight, source NULLS LAST
                           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
pick AS (SELECT arg_min(level, nth) AS level FROM lv WHERE level * weight <= {MAX_REPEAT} * source_size),
g AS (
  SELECT lv.source, lv.source_size, least(({MAX_REPEAT} * lv.source_size)::DOUBLE, pick.level * lv.weight) AS target,
    ('0x' || substr(md5('{SEED}' || coalesce(':' || lv.source, '')), 1, 5))::BIGINT AS offs
  FROM lv, pick),
p AS (
  SELECT d.doc_id, d.size, g.source_size, g.target, g.offs,
    CASE WHEN g.source_size > 0 THEN floor(g.target / g.source_size * {UNIT})::BIGINT ELSE 0 END AS unit_copies,
    row_number() OVER (PARTITION BY d.source ORDER BY d.size, d.doc_id NULLS LAST, md5(d.text)) - 1 AS i
  FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target,
  (size * (((i + 1) * unit_copies + offs) // {UNIT} - (i * unit_copies + offs) // {UNIT}))::BIGINT AS taken
FROM p
"""


def emit(docs: DataFrame) -> DataFrame:
    """The mix itself: rows of ``docs``, each as often as it is taken. Rows alike in all columns
    are one row that is taken as often as all of them; they meet in partial aggregates, and
    many copies are made by many tasks."""
    h = F.xxhash64(F.lit(1), *[F.col(c) for c in docs.columns])
    times = (mix(docs.withColumn("__h", h), keep=("__h",)).groupBy("__h").agg(F.sum("copies").alias("__times"))
             .where("__times > 0"))
    rows = docs.withColumn("__h", h).dropDuplicates(["__h"]).join(times, "__h")
    few = rows.where(F.col("__times") <= COPIES).withColumn("__n", F.col("__times"))
    many = (rows.where(F.col("__times") > COPIES)
            .withColumn("__part", F.explode(F.sequence(F.lit(0), F.expr(f"(__times - 1) div {COPIES}"))))
            .repartition("__h", "__part")
            .withColumn("__n", F.least(F.lit(COPIES), F.col("__times") - F.col("__part") * COPIES)))
    return (few.select(*docs.columns, "__n").union(many.select(*docs.columns, "__n"))
            .withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__n").cast("int")))).select(*docs.columns))
