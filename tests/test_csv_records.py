import csv
import random

import pytest
from pyspark.sql import functions as F

from media_analytics.sources import csv_records, files, pages


def write(path, rows, end="\n"):
    with open(path, "w", newline="", encoding="utf-8") as f:
        csv.writer(f, lineterminator=end).writerows(rows)


def plain_rows(rows):
    """Empty fields read as null."""
    return [tuple(x or None for x in r) for r in rows]


FIELDS = ["a", "", 'say "x"', '"', '""', "l1\nl2", "\n", "x\n\n\ny", ",", "é, \U0001f600", "  s ", "l1\r\nl2", '"\n"', "end"]


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_random_records_in_many_splits(spark, tmp_path, end):
    """Splits of a few hundred bytes: records span several, some splits hold no begin of one."""
    rng = random.Random(5)
    rows = [[str(i), *(rng.choice(FIELDS) for _ in range(3))] for i in range(400)]
    rows[200][1] = "\n".join(f'line {k}, "quoted"' for k in range(150))  # longer than several splits
    write(tmp_path / "a.csv", [["id", "x", "y\nz", "w`"], *rows[:300]], end)
    write(tmp_path / "b.csv", [["id", "x", "y\nz", "w`"], *rows[300:]], end)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        assert csv_records.csv_lines(spark, str(tmp_path)).rdd.getNumPartitions() > 30
        df = csv_records.read_csv(spark, str(tmp_path))
        assert df.columns == ["id", "x", "y\nz", "w`"]
        assert [tuple(map(str, r)) for r in sorted(map(tuple, df.collect()), key=str)] == [
            tuple(map(str, r)) for r in sorted(plain_rows(rows), key=str)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_large_file_is_many_tasks(spark, tmp_path):
    rows = [[i, f"title {i}\nsecond line" if i % 50 == 0 else f"title {i} " + "x" * 60] for i in range(400_000)]
    write(tmp_path / "v.csv", [["video_id", "title"], *rows])
    assert (tmp_path / "v.csv").stat().st_size > 30e6
    assert csv_records.csv_lines(spark, str(tmp_path)).rdd.getNumPartitions() >= 8
    df = files.read_table_csv(spark, str(tmp_path))
    assert df.count() == 400_000
    assert df.where("title LIKE '%\nsecond line'").count() == 8000


def test_a_field_that_never_ends_is_an_error(spark, tmp_path):
    (tmp_path / "bad.csv").write_text('a,b\n1,"x\n2,y\n')
    with pytest.raises(Exception, match="never ends"):
        csv_records.read_csv(spark, str(tmp_path)).collect()


def test_blank_lines_header_only_and_short_rows(spark, tmp_path):
    (tmp_path / "a.csv").write_text('a,b\n\n1,x\r\n\r\n2\n')
    assert sorted(map(tuple, csv_records.read_csv(spark, str(tmp_path)).collect())) == [("1", "x"), ("2", None)]
    (tmp_path / "a.csv").write_text('a,b\n')
    assert csv_records.read_csv(spark, str(tmp_path)).collect() == []


def test_quotes_are_counted_without_a_look_at_each_character_in_a_map(spark, tmp_path):
    """``translate`` looks every character up; it took most of the reader's time."""
    (tmp_path / "a.csv").write_text('a,b\n1,"x ""y"" é"\n')
    lines = csv_records.csv_lines(spark, str(tmp_path))
    assert "translate(" not in csv_records.records(lines)._jdf.queryExecution().optimizedPlan().toString()
    assert csv_records.read_csv(spark, str(tmp_path)).collect() == [("1", 'x "y" é')]


def test_plain_times_are_cast_as_when_taken_apart(spark, monkeypatch):
    texts = ["1996-03-01T10:20:30.000", "1996-03-01 10:20:30", "1996-03-01T10:20:30.123456", "1996-02-30T10:20:30",
             "1996-03-01T25:00:00", "0000-01-01T00:00:00", "1996-03-01T10:20:30Z", "1996-03-01T10:20:30+05:30",
             "1996-03-01T10:20", "1996-03-01", " 1996-03-01T10:20:30 ", "1996-03-01T10:20:30\n", "last week", "", None,
             "1996-03-01T23:59:59.9", "1996-03-01T10:20:60", "9999-12-31T23:59:59.999999"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.select(pages.utc_timestamp("t").cast("string").alias("u"))
    plain = df.where(F.col("t").rlike(pages._PLAIN_TIME)).count()
    monkeypatch.setattr(pages, "_PLAIN_TIME", r"(?!)")  # no text has this form
    want = df.select(pages.utc_timestamp("t").cast("string").alias("u"))
    assert got.collect() == want.collect() and plain == 9
