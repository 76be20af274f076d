"""Filters (F1-F6), snapshot profile (S6) and empty guards."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from ..functions.constants import CATEGORIES
from ..functions.scalar import ntz_literal


@dataclass(frozen=True)
class FilterSpec:
    """Report filters; ``None`` means "all" on that dimension: every date, every
    channel of the channel table, every one of the three categories. A video
    without a date, a channel name or a category belongs to none of these and is
    never selected.

    ``start``/``end`` are inclusive calendar dates; a single date means that day.
    ``channels`` are channel names; ``categories`` are performance categories.
    """
    start: date | None = None
    end: date | None = None
    channels: tuple[str, ...] | None = None
    categories: tuple[str, ...] | None = None


def _day(d: date | datetime) -> date:
    return d.date() if isinstance(d, datetime) else d


def date_predicate(ts_col: str, start: date | None, end: date | None):
    """F1 as a range on the raw timestamp (``ts >= a AND ts < b + 1 day``) so the
    parquet scan can push it down; null timestamps fall out."""
    if start is None and end is None:
        return None
    if start is not None and end is None:
        end = start
    cond = F.col(ts_col).isNotNull()
    if start is not None:
        cond = cond & (F.col(ts_col) >= ntz_literal(_day(start)))
    if end is not None:
        cond = cond & (F.col(ts_col) < ntz_literal(_day(end) + timedelta(days=1)))
    return cond


def fill_numeric_zero(df: DataFrame) -> DataFrame:
    """Zero-fill numeric columns only (strings / dates keep their nulls)."""
    cols = [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType)]
    return df.fillna(0, subset=cols) if cols else df


def apply_filters(videos: DataFrame, spec: FilterSpec = FilterSpec(), channels: DataFrame | None = None) -> DataFrame:
    """date range AND channel set AND category set, then numeric zero fill.

    On a table with ``publish_year`` (the parquet sink can partition by it) the
    date range also prunes year partitions.

    "All channels" means the names in ``channels`` (a left-semi join); without that
    table, every video with a channel name - the same set when the table is the
    rollup of these videos, which has every name they carry. A channel list is an
    ``isin`` (Catalyst turns long lists into an InSet hash lookup); a DataFrame of
    names can be used with ``filter_by_names``.
    """
    v = videos.where(F.col("publish_date").isNotNull() & F.col("channel_name").isNotNull())
    dp = date_predicate("publish_date", spec.start, spec.end)
    if dp is not None:
        v = v.where(dp)
        if "publish_year" in videos.columns:
            # implied by the date range (publish_year = year(publish_date)): lets a
            # table partitioned by publish_year skip whole folders
            last = spec.end if spec.end is not None else spec.start  # as date_predicate
            if spec.start is not None:
                v = v.where(F.col("publish_year") >= _day(spec.start).year)
            v = v.where(F.col("publish_year") <= _day(last).year)
    if spec.channels is not None:
        v = v.where(F.col("channel_name").isin(list(spec.channels)))
    elif channels is not None:
        v = filter_by_names(v, channels.where(F.col("channel_name").isNotNull()).select("channel_name"))
    v = v.where(F.col("performance_category").isin(list(spec.categories if spec.categories is not None else CATEGORIES)))
    return fill_numeric_zero(v)


def select_report(videos: DataFrame, channels: DataFrame, spec: FilterSpec = FilterSpec()) -> tuple[DataFrame, DataFrame]:
    """F4, F5 and S7 as a report takes them: (filtered videos, filtered channels), or an
    error that says so when no video is left."""
    fv = require_rows(apply_filters(videos, spec, channels), "videos match the filters")
    return fv, apply_channel_filter(channels, spec)


def filter_by_names(df: DataFrame, names: DataFrame, column: str = "channel_name") -> DataFrame:
    """F2 for very long selections: left-semi join against a DataFrame of names."""
    kept = df.join(names.select(F.col(names.columns[0]).alias(column)).distinct(), column, "left_semi")
    return kept.select(*df.columns)


def apply_channel_filter(channels: DataFrame, spec: FilterSpec = FilterSpec()) -> DataFrame:
    """channels ignore date and category filters (P16); name filter, zero fill."""
    c = channels.where(F.col("channel_name").isNotNull())
    if spec.channels is not None:
        c = c.where(F.col("channel_name").isin(list(spec.channels)))
    return fill_numeric_zero(c)


def filter_domain(videos: DataFrame, channels: DataFrame) -> DataFrame:
    """the selectable channel names with the selectable date range."""
    names = channels.where(F.col("channel_name").isNotNull()).select("channel_name").distinct()
    rng = videos.agg(F.to_date(F.min("publish_date")).alias("first_date"),
                     F.to_date(F.max("publish_date")).alias("last_date"))
    return names.crossJoin(F.broadcast(rng)).orderBy("channel_name")  # one-row side; sorted list


def snapshot_profile(videos: DataFrame, channels: DataFrame) -> DataFrame:
    """Channels, videos, total views and likes, first and last publish date."""
    v = videos.agg(F.count(F.lit(1)).alias("videos"),
                   F.coalesce(F.sum("views"), F.lit(0)).cast("bigint").alias("total_views"),
                   F.coalesce(F.sum("likes"), F.lit(0)).cast("bigint").alias("total_likes"),
                   F.to_date(F.min("publish_date")).alias("first_date"),
                   F.to_date(F.max("publish_date")).alias("last_date"))
    c = channels.agg(F.count(F.lit(1)).alias("channels"))
    return c.crossJoin(v).select("channels", "videos", "total_views", "total_likes",
                                 "first_date", "last_date")


def above_quantile(df: DataFrame, column: str, p: float, approx: bool = False) -> tuple[DataFrame, float | None]:
    """rows whose ``column`` is strictly above its ``p`` quantile over ``df``
    (exact and distributed unless ``approx``), with that quantile."""
    from .quantiles import quantiles
    q = quantiles(df, column, [p], approx=approx)[0]
    return (df.where(F.col(column) > F.lit(q)) if q is not None else df.where(F.lit(False))), q


def require_rows(df: DataFrame, what: str) -> DataFrame:
    """Raise a clear error when a required input is empty."""
    if df.isEmpty():
        raise ValueError(f"no {what}: nothing to analyse")
    return df
