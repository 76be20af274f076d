"""Incremental refresh of the stored tables: a fetch changes only the years it touches.

Under one root lie ``videos`` (one row per video with all measures but the category), the
merged states ``days`` and ``hours`` (``operators.state``) and ``sketches`` (a KLL sketch of views
per year), all in folders by ``publish_year``. ``refresh`` takes the rows of a fetch:

1. The newest row of each video is kept (``newest``).
2. The affected years are those of the fetched rows and those in which the fetched ids
   stand now (a video's date may have moved). Only their folders are read and
   rewritten, by dynamic partition overwrite; a year without rows is deleted.
3. The states and sketches of these years are computed again from their videos.

Running the same fetch again gives the same tables, so a job that died midway is run
again. Rows without an id cannot be matched: those of a fetch are left out, those
already stored stay. Years are few (calendar years), so their list fits the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import enrich, state
from ..operators.quantiles import kept_sketches, multi_exact_quantiles
from ..session import cut_lineage

YEAR = "publish_year"


def newest(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """One row per ``key``: the one with the largest ``order`` columns (other columns break
    ties). A partial aggregate, so a key with very many rows is combined in the tasks."""
    rest = [c for c in rows.columns if c not in (key, *order)]
    best = rows.groupBy(key).agg(F.max(F.struct(*order, *rest)).alias("_r"))
    return best.select(*[F.col(c) if c == key else F.col(f"_r.{c}").alias(c) for c in rows.columns])


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _path(spark, path)
    return fs.exists(p)


def _in_years(years: list[int | None]):
    known = [y for y in years if y is not None]
    c = F.col(YEAR).isin(known) if known else F.lit(False)
    return c | F.col(YEAR).isNull() if None in years else c


def _write_years(df: DataFrame, path: str, years: list[int | None], emptied: list[int | None]) -> None:
    """Replace the folders of ``years`` by the rows of ``df``, which are written from where the last
    join or aggregate left them: AQE has merged its small partitions, and each task writes a file for each
    year it holds, so the rows are not moved once more."""
    spark = df.sparkSession
    (df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(YEAR).parquet(path))
    for y in emptied:
        fs, p = _path(spark, f"{path}/{YEAR}={'__HIVE_DEFAULT_PARTITION__' if y is None else y}")
        fs.delete(p, True)


def upsert(path: str, fetched: DataFrame, key: str = "video_id") -> tuple[list, list]:
    """Replace or add the ``fetched`` rows (one per ``key``) in the table at ``path``; returns the
    years rewritten and, of these, the ones left without rows."""
    spark = fetched.sparkSession
    changed = fetched.where(F.col(key).isNotNull())
    if not exists(spark, path):
        _write_years(changed, path, [], [])
        return [r[0] for r in spark.read.schema(changed.schema).parquet(path).select(YEAR).distinct().collect()], []
    changed = cut_lineage(changed)
    added = {r[0]: r[1] for r in changed.groupBy(YEAR).count().collect()}
    old = spark.read.schema(changed.schema).parquet(path)
    ids = changed.select(key)
    gone = {r[0]: r[1] for r in old.select(key, YEAR).where(F.col(key).isNotNull())
            .join(ids, key, "left_semi").groupBy(YEAR).count().collect()}
    years = list(dict.fromkeys([*added, *gone]))
    touched = old.where(_in_years(years))
    stored = {r[0]: r[1] for r in touched.groupBy(YEAR).count().collect()}
    emptied = [y for y in years if y not in added and stored.get(y, 0) == gone.get(y, 0)]
    # rows without an id match nothing and stay out of the join
    kept = (touched.where(F.col(key).isNotNull()).join(ids, key, "left_anti")
            .unionByName(touched.where(F.col(key).isNull())))
    _write_years(kept.select(*changed.columns).unionByName(changed), path, years, emptied)
    return years, emptied


def refresh(root: str, fetched: DataFrame, order: list[str]) -> list:
    """Bring the tables under ``root`` to the state after ``fetched``: enriched rows (all
    measures but the category) with the columns ``order`` that tell which of a video's rows is
    newest; those that are no columns of the table are dropped. Returns the years rewritten."""
    spark = fetched.sparkSession
    rows = newest(fetched.where("video_id IS NOT NULL"), "video_id", order).drop(*[c for c in order if c not in enrich.VIDEO_COLUMNS])
    years, emptied = upsert(f"{root}/videos", rows)
    videos = spark.read.schema(rows.schema).parquet(f"{root}/videos").where(_in_years(years))
    for name, table in (("days", state.channel_days(videos)), ("hours", state.day_hours(videos)),
                        ("sketches", kept_sketches(videos, ["views"], YEAR))):
        _write_years(table, f"{root}/{name}", years, emptied)
    return years


def stored(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}")


def thresholds(spark: SparkSession, root: str) -> tuple[float | None, float | None]:
    """(q25, q75) of views: the first round of the search reads the sketches only."""
    found = multi_exact_quantiles(stored(spark, root, "videos"), {"views": [0.25, 0.75]},
                                  sketches=stored(spark, root, "sketches"))["views"]
    return found[0], found[1]


def enriched(spark: SparkSession, root: str) -> DataFrame:
    """The stored videos with their category."""
    return enrich.categorize(stored(spark, root, "videos"), thresholds=thresholds(spark, root)).select(*enrich.VIDEO_COLUMNS)
