"""CSV records with line breaks inside fields, read in as many tasks as the text splits into.

A line break belongs to a field where an odd number of quotes stands before it. The lines come
from the splittable text source with their file and split. Quotes are summed inside each
split, and over the splits of a file (two levels, as a prefix sum: no task sees a whole
file). That tells for every line whether it begins a record, and the split and line
where the record of any other line begins. Lines that are whole records (nearly all) go
on as they are; only the lines of broken records are grouped.

Quotes enclose fields and are doubled inside them (every CSV writer does so). A file with an
odd number of quotes has a field that never ends: reading it is an error that names the file.
Lines end with LF or CR LF; empty lines are no records. A compressed file is one split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def csv_lines(spark: SparkSession, path: str) -> DataFrame:
    """(value, file, block, line): the lines with their split; ``line`` rises within a split."""
    return (spark.read.option("lineSep", "\n").text(path)
            .select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
                    F.monotonically_increasing_id().alias("line")))


def records(lines: DataFrame) -> DataFrame:
    """(value, header): the records of ``csv_lines``; ``header``: the first one of its file."""
    split = Window.partitionBy("file", "block").orderBy("line")
    before = split.rowsBetween(Window.unboundedPreceding, -1)
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    lines = lines.withColumn("quotes", quotes).withColumn("seen", F.coalesce(F.sum("quotes").over(before), F.lit(0)))
    # a split's last begin of a record, for either state it may be entered in
    blocks = lines.groupBy("file", "block").agg(
        F.sum("quotes").alias("quotes"), F.min("line").alias("first"),
        F.max(F.when(F.col("seen") % 2 == 0, F.col("line"))).alias("last0"),
        F.max(F.when(F.col("seen") % 2 == 1, F.col("line"))).alias("last1"))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    total = F.sum("quotes").over(Window.partitionBy("file"))
    broken = F.raise_error(F.concat(F.lit("a quoted field never ends in "), F.col("file"))).cast("bigint")
    blocks = (blocks.withColumn("entered", F.coalesce(F.sum("quotes").over(earlier), F.lit(0)) % 2)
              .withColumn("entered", F.when(total % 2 == 1, broken).otherwise(F.col("entered")))
              .withColumn("last", F.when(F.col("entered") == 0, F.col("last0")).otherwise(F.col("last1")))
              .withColumn("open", F.last(F.when(F.col("last").isNotNull(), F.struct("block", F.col("last").alias("line"))),
                                         ignorenulls=True).over(earlier))
              .select("file", "block", "entered", "open", "first"))
    begins = (F.col("seen") + F.col("entered")) % 2 == 0
    own = F.max(F.when(begins, F.col("line"))).over(split)
    placed = lines.join(blocks, ["file", "block"]).withColumn("begins", begins).withColumn("own", own)
    whole = F.col("begins") & (F.col("quotes") % 2 == 0)
    header = (F.col("block") == 0) & (F.col("line") == F.col("first"))
    alone = placed.where(whole).select("value", header.alias("header"))
    parts = placed.where(~whole).select(
        "file", F.when(F.col("own").isNotNull(), F.struct("block", F.col("own").alias("line"))).otherwise(F.col("open")).alias("record"),
        F.struct("block", "line", "value").alias("part"), header.alias("header"))
    joined = parts.groupBy("file", "record").agg(F.array_sort(F.collect_list("part")).alias("p"), F.max("header").alias("header"))
    out = alone.union(joined.select(F.array_join(F.col("p.value"), "\n").alias("value"), "header"))
    return out.withColumn("value", F.regexp_replace("value", r"\r\z", "")).where("value <> ''")


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns as text, named by the header of the first file; a header stands in each file."""
    options = {"escape": '"'}
    names = spark.read.options(header=True, multiLine=True, **options).csv(path).columns
    names = [*names[:-1], *(n.removesuffix("\r") for n in names[-1:])]
    schema = ", ".join("`" + n.replace("`", "``") + "` string" for n in names)
    row = F.from_csv("value", schema, options)
    return records(csv_lines(spark, path)).where(~F.col("header")).select(row.alias("r")).select("r.*")
