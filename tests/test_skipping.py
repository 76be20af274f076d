"""Files sorted by channel with Bloom filters: a channel filter reads few row groups."""

from pyspark.sql import functions as F

from media_analytics.plans import catalog


def scanned(df):
    """Rows that the scan read (whole row groups)."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    plan = plan.finalPhysicalPlan() if plan.getClass().getSimpleName().startswith("Adaptive") else plan
    leaves = plan.collectLeaves()
    return sum(leaves.apply(i).metrics().apply("numOutputRows").value() for i in range(leaves.size()))


def test_row_groups_without_the_channel_are_skipped(spark, tmp_path):
    rows = spark.range(60_000).select(
        F.col("id").alias("video_id"), (F.col("id") * 7919 % 1000).alias("views"),
        F.concat(F.lit("name "), F.format_string("%03d", F.col("id") % 400)).alias("channel_name"),
        (2020 + F.col("id") % 2).cast("int").alias("publish_year"))
    spark.sparkContext._jsc.hadoopConfiguration().setInt("parquet.block.size", 32 * 1024)
    try:
        table = catalog._written(rows, f"{tmp_path}/t", "publish_year")
        rows.write.partitionBy("publish_year").parquet(f"{tmp_path}/plain")
    finally:
        spark.sparkContext._jsc.hadoopConfiguration().unset("parquet.block.size")
    pick = lambda df: df.where(F.col("channel_name").isin("name 007", "name 008"))
    plain = pick(spark.read.parquet(f"{tmp_path}/plain"))
    assert sorted(map(str, pick(table).select("video_id").collect())) == sorted(map(str, plain.select("video_id").collect()))
    assert table.count() == 60_000
    assert scanned(pick(table)) < 0.35 * scanned(plain)
