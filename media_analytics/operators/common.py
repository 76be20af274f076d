"""Small shared helpers for report operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def dimension(spark: SparkSession, column: str, labels: list, order_col: str | None = None) -> DataFrame:
    """A fixed label list as a tiny DataFrame (label, order) used to keep empty
    buckets / days / categories in a report via a left join."""
    order_col = order_col or f"{column}_order"
    return literal_rows(spark, [(column, labels), (order_col, list(range(len(labels))))])


def literal_rows(spark: SparkSession, columns: list[tuple[str, list]]) -> DataFrame:
    """A handful of constant rows built inside the JVM plan (``inline`` of a
    literal array), without shipping Python data. ``columns`` is
    ``[(name, values), ...]`` with equally long value lists."""
    n = len(columns[0][1])
    structs = [F.struct(*[F.lit(vals[i]).alias(name) for name, vals in columns]) for i in range(n)]
    return spark.range(1).select(F.inline(F.array(*structs)))


def keep_labels(dim: DataFrame, agg: DataFrame, key: str) -> DataFrame:
    """Left join an aggregate onto a label dimension. Only the rows of its labels are
    broadcast, so that side is no larger than the dimension whatever values
    the key column holds."""
    known = agg.join(F.broadcast(dim.select(key)), key, "left_semi")
    return dim.join(F.broadcast(known), key, "left")
