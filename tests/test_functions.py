from datetime import datetime

from pyspark.sql import functions as F

from media_analytics.functions import (DURATION_EDGES, DURATION_LABELS, age_days, cut, duration_minutes,
                                       percent_text, posting_period, safe_div, short_number)


def test_iso_duration(spark):
    df = spark.createDataFrame([("PT1H2M3S",), ("PT15M",), ("PT",), ("P1DT2H",), ("P0D",), (None,)], "d string")
    got = [r[0] for r in df.select(duration_minutes("d")).collect()]
    assert abs(got[0] - 62.05) < 1e-12
    assert got[1:] == [15.0, 0.0, None, None, None]


def test_iso_duration_rounding(spark):
    df = spark.createDataFrame([("PT1M1S",)], "d string")
    assert df.select(duration_minutes("d", round_digits=2)).first()[0] == 1.02


def test_short_number(spark):
    vals = [0.0, None, 999.0, 1500.0, 2.5e6, 3e9, -1500.0]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    got = [r[0] for r in df.select(short_number("x")).collect()]
    assert got == ["0", "0", "999", "1.5K", "2.5M", "3.0B", "-1.5K"]


def test_percent_text(spark):
    df = spark.createDataFrame([(12.3456,), (-1.2,)], "x double")
    assert [r[0] for r in df.select(percent_text("x")).collect()] == ["12.35%", "-1.20%"]
    assert df.select(percent_text("x", signed=True)).first()[0] == "+12.35%"


def test_posting_period_dayparts(spark):
    rows = [(datetime(2020, 1, 1, h, 0),) for h in (5, 6, 11, 12, 17, 18, 21, 22)]
    df = spark.createDataFrame(rows, "ts timestamp_ntz")
    got = [r[0] for r in df.select(posting_period("ts")).collect()]
    assert got == ["Night", "Morning", "Morning", "Afternoon", "Afternoon", "Evening", "Evening", "Night"]


def test_posting_period_month_thirds(spark):
    df = spark.createDataFrame([(datetime(2020, 1, d),) for d in (1, 10, 11, 20, 21, 31)], "ts timestamp_ntz")
    got = [r[0] for r in df.select(posting_period("ts", "month_third")).collect()]
    assert got == ["First", "First", "Middle", "Middle", "Last", "Last"]


def test_cut_edges(spark):
    df = spark.createDataFrame([(x,) for x in (0.0, 5.0, 5.1, 100.0, 101.0)], "x double")
    got = [r[0] for r in df.select(cut("x", DURATION_EDGES, DURATION_LABELS)).collect()]
    assert got == [None, "0-5min", "5-10min", "20+min", None]
    lab = [r[0] for r in df.select(cut("x", [0, 4, 8])).collect()]
    assert lab == [None, "(4, 8]", "(4, 8]", None, None]


def test_age_floors_then_abs(spark):
    as_of = datetime(2001, 12, 31)
    df = spark.createDataFrame([(datetime(2002, 1, 1, 2, 0),), (datetime(2001, 12, 29, 23, 0),)], "ts timestamp_ntz")
    got = df.select(age_days("ts", as_of, absolute=False).alias("a"), age_days("ts", as_of).alias("b")).collect()
    assert (got[0]["a"], got[0]["b"]) == (-2, 2)  # 26 h in the future
    assert (got[1]["a"], got[1]["b"]) == (1, 1)


def test_safe_div_never_raises(spark):
    df = spark.createDataFrame([(1, 0), (0, 0), (3, 2)], "a bigint, b bigint")
    assert [r[0] for r in df.select(safe_div("a", "b")).collect()] == [0.0, 0.0, 1.5]
    assert df.select(F.sum(safe_div("a", "b"))).first()[0] == 1.5
