import duckdb
import pytest

from pyspark.sql import functions as F

from media_analytics.llm import mixing
from tools.check_oracle import compare

from .fixtures import documents, empty_documents


def oracle(df):
    con = duckdb.connect()
    con.register("documents", df.select("doc_id", "text", "source").toArrow())
    return con


def result(df):
    return mixing.mix(df).selectExpr("doc_id", "size", "source_size", "target", "size * copies AS taken")


def test_dirty_documents_equal_the_sql(spark):
    df = documents(spark)
    ok, message = compare(result(df), oracle(df), mixing.OP9_SQL)
    assert ok, message


def test_whole_table_equals_the_sql_and_meets_the_targets(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    ok, message = compare(result(df), oracle(df), mixing.OP9_SQL)
    assert ok, message
    by = mixing.mix(df).selectExpr("source", "size * copies taken", "target", "copies").groupBy("source", "target").agg(
        {"taken": "sum", "copies": "max"}).collect()
    assert all(abs(r["sum(taken)"] / r["target"] - 1) < 0.1 and r["max(copies)"] <= 3 for r in by)


def test_targets_stop_and_reshare(spark):
    rows = [("a", 1000), ("b", 10), ("c", 5), ("d", 0), (None, 100)]
    df = spark.createDataFrame(rows, "source string, size long")
    got = {r.source: r.target for r in mixing.source_targets(df).collect()}
    sizes, weight = dict(rows), {"a": 1, "b": 2, "c": 3, "d": 1, None: 2}
    fixed, total = {}, sum(sizes.values())
    while True:  # rounds as stated: stop what is above, share the rest anew
        open_ = [s for s in sizes if s not in fixed]
        rest = total - sum(fixed.values())
        share = {s: rest * weight[s] / sum(weight[x] for x in open_) for s in open_}
        above = [s for s in open_ if share[s] > 3 * sizes[s]]
        if not above:
            break
        fixed |= {s: 3.0 * sizes[s] for s in above}
    want = fixed | share
    assert got.keys() == want.keys() and all(got[s] == pytest.approx(want[s]) for s in want)
    assert sum(got.values()) == pytest.approx(total)


def test_emit(spark):
    df = documents(spark)
    emitted = mixing.emit(df)
    assert emitted.columns == df.columns
    want = sum(r.copies for r in mixing.mix(df).collect())
    rows = emitted.collect()
    assert len(rows) == want and sorted(map(str, rows)) == sorted(map(str, mixing.emit(df.repartition(5)).collect()))


def test_empty(spark):
    assert result(empty_documents(spark)).count() == 0 and mixing.emit(empty_documents(spark)).count() == 0


def test_a_hot_identical_row_is_emitted_by_many_tasks(spark):
    """A third of all rows is one row: no list, no window over it."""
    same = spark.range(20_000).selectExpr("CAST(NULL AS BIGINT) doc_id", "'some words of one text' text", "'a' source", "1 extra")
    other = spark.range(40_000).selectExpr("id doc_id", "concat('text ', id) text", "concat('s', id % 3) source", "2 extra")
    df = same.union(other)
    got = mixing.emit(df)
    want = {r.doc_id: r.n for r in mixing.mix(df).groupBy("doc_id").agg({"copies": "sum"}).toDF("doc_id", "n").where("n > 0").collect()}
    have = {r.doc_id: r["count"] for r in got.groupBy("doc_id").count().collect()}
    assert have == want and want[None] > 2 * mixing.COPIES
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # would merge so few rows
    try:
        parts = [r["count"] for r in got.where("doc_id IS NULL").groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(parts) > 2
    plan = mixing.mix(df)._jdf.queryExecution().toString() + got._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))
