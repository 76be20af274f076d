"""Exact quantiles with linear interpolation (Q1), computed without one big task.

Spark's exact ``percentile`` aggregate merges a map of every distinct value in
a single final task, which does not survive a 100 TB column. Here exact order
statistics are found by bracketing. A wanted rank lies in an open interval of
values, at first all of them. Each round narrows every open interval of every
column at once, in two passes over the table:

1. a KLL sketch per interval (one per input partition, merged as a two-level
   tree so no task merges every partition's state), read a little below and
   above the wanted rank: two values of the column;
2. how many rows lie below, on, between and above these two values. A rank
   that falls on one of them is answered; any other goes on in the open interval
   beside or between them. The sketch's bound is probabilistic, but the counts are
   exact, so a rank is never lost, and an interval shrinks by its end values
   in every round however often they repeat.

An interval shrinks to about 0.5% of its rows a round, so the number of rounds
is small and does not depend on the number of columns. Intervals of at most
``max_candidates`` rows are gathered in one last pass as (value, count) pairs.
The result equals pandas / DuckDB ``quantile_cont``:
``v[k] + (v[k+1] - v[k]) * frac`` at position ``p * (n - 1)``.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import literal_rows

DEFAULT_MAX_CANDIDATES = 20_000
_MARGIN = 3.0  # bracket half-width in units of the sketch's rank error
KLL_K = 4096
KLL_EPS = 2.296 / KLL_K ** 0.9444  # KLL normalized rank error (99% confidence), ~9e-4
KLL_BUCKETS = 1024


@dataclass
class _Interval:
    """Ranks searched among the ``size`` values of ``column`` in the open interval
    (low, high); ``before`` values are not above low. None: no bound."""
    column: str
    ranks: list[int]
    before: int
    size: int
    low: float | None = None
    high: float | None = None

    def inside(self) -> Column:
        x = F.col(self.column)
        c = x.isNotNull()
        if self.low is not None:
            c = c & (x > F.lit(self.low))
        if self.high is not None:
            c = c & (x < F.lit(self.high))
        return c


def _sketches(base: DataFrame, values: dict[str, Column]) -> DataFrame:
    """One row: for each name its non-null count ``n<name>`` and KLL sketch ``k<name>``,
    merged per bucket of partitions first and then from at most KLL_BUCKETS sketches."""
    level1 = base.groupBy((F.spark_partition_id() % KLL_BUCKETS).alias("_b")).agg(
        *[a for name, x in values.items() for a in (F.count(x).alias(f"n{name}"),
                                                    F.kll_sketch_agg_double(x, KLL_K).alias(f"k{name}"))])
    return level1.agg(*[a for name in values for a in (F.coalesce(F.sum(f"n{name}"), F.lit(0)).alias(f"n{name}"),
                                                       F.kll_merge_agg_double(f"k{name}").alias(f"k{name}"))])


def _read(sketches: DataFrame, fractions: dict[str, Sequence[float]]):
    """Counts (n<name>) and sketch values (q<name>) at the fractions."""
    out = []
    for name, fr in fractions.items():
        q = F.kll_sketch_get_quantile_double(
            f"k{name}", F.array(*[F.lit(min(max(float(f), 0.0), 1.0)) for f in fr or [0.5]]))
        out += [F.col(f"n{name}").cast("bigint").alias(f"n{name}"), F.when(F.col(f"n{name}") > 0, q).alias(f"q{name}")]
    return sketches.select(*out).first()


def _numbers(df: DataFrame, columns: Sequence[str], *others: str) -> tuple[DataFrame, dict[str, str]]:
    """The columns as doubles under safe names, NaN as null, and the ``others`` as they are."""
    name = {c: f"_x{j}" for j, c in enumerate(columns)}
    x = {c: F.col(c).cast("double") for c in columns}
    return df.select(*others, *[F.when(~F.isnan(x[c]), x[c]).alias(name[c]) for c in columns]), name


def _plan(probs: Sequence[float], n: int):
    plan = []
    for p in probs:
        if not 0.0 <= p <= 1.0:
            raise ValueError(f"probability out of range: {p}")
        pos = p * (n - 1)
        k0 = math.floor(pos)
        plan.append((k0, min(k0 + 1, n - 1) if pos > k0 else k0, pos - k0))
    return plan


def _split(b: _Interval, low: float | None, high: float | None, counts, found: dict) -> list[_Interval]:
    """Answers the ranks of ``b`` that fall on ``low`` or ``high`` (values inside it) and
    returns the narrower intervals of the others. counts: rows below, on low,
    between, on high."""
    below, on_low, between, on_high = counts
    parts: dict[int, _Interval] = {}
    for r in b.ranks:
        at = r - b.before
        if low is not None and at < below:
            key, part = 0, _Interval(b.column, [], b.before, below, b.low, low)
        elif low is not None and at < below + on_low:
            found[b.column, r] = low
            continue
        elif at < below + on_low + between:
            key, part = 1, _Interval(b.column, [], b.before + below + on_low, between,
                                     b.low if low is None else low, b.high if high is None else high)
        elif at < below + on_low + between + on_high:
            found[b.column, r] = high
            continue
        else:
            gone = below + on_low + between + on_high
            key, part = 2, _Interval(b.column, [], b.before + gone, b.size - gone, high, b.high)
        parts.setdefault(key, part).ranks.append(r)
    return list(parts.values())


def _narrow(base: DataFrame, big: list[_Interval], found: dict, sketched=None) -> list[_Interval]:
    """One round over all the intervals: two passes over the table."""
    m = _MARGIN * KLL_EPS
    fractions = {str(i): [(b.ranks[0] - b.before) / b.size - m, (b.ranks[-1] + 1 - b.before) / b.size + m]
                 for i, b in enumerate(big)}
    if sketched is None:
        sketched = _sketches(base, {str(i): F.when(b.inside(), F.col(b.column)) for i, b in enumerate(big)})
        row = _read(sketched, fractions)
        values = [row[f"q{i}"] for i in range(len(big))]
    else:
        values = sketched(fractions)
    ends, aggs = [], []
    for i, (b, v) in enumerate(zip(big, values)):
        low, high = (x if 0 < f < 1 else None for x, f in zip(v, fractions[str(i)]))
        if low is not None and low == high:
            high = None
        if low is None and high is None:
            low = v[0]  # the least value: the interval still shrinks
        ends.append((low, high))
        x, inside, none = F.col(b.column), b.inside(), F.lit(False)
        between = inside
        if low is not None:
            between = between & (x > F.lit(low))
        if high is not None:
            between = between & (x < F.lit(high))
        for name, c in (("b", none if low is None else inside & (x < F.lit(low))),
                        ("l", none if low is None else x == F.lit(low)), ("m", between),
                        ("h", none if high is None else x == F.lit(high))):
            aggs.append(F.count_if(c).alias(f"{name}{i}"))
    got = base.agg(*aggs).first()
    out = []
    for i, (b, (low, high)) in enumerate(zip(big, ends)):
        out += _split(b, low, high, [got[f"{k}{i}"] for k in "blmh"], found)
    return out


def _gather(base: DataFrame, small: list[_Interval], found: dict) -> None:
    """Ranks the (value, count) pairs of intervals that hold few rows."""
    arr = F.array(*[F.when(b.inside(), F.struct(F.lit(i).alias("t"), F.col(b.column).alias("x")))
                    for i, b in enumerate(small)])
    picked = base.select(F.explode(F.filter(arr, lambda e: e.isNotNull())).alias("e"))
    pairs: dict[int, list] = {}
    for r in picked.groupBy("e.t", "e.x").agg(F.count(F.lit(1)).alias("c")).collect():
        pairs.setdefault(r["t"], []).append((r["x"], r["c"]))
    for i, b in enumerate(small):
        seen, todo = b.before, sorted(b.ranks)
        for v, c in sorted(pairs.get(i, [])):
            while todo and todo[0] < seen + c:
                found[b.column, todo.pop(0)] = v
            seen += c


def kept_sketches(df: DataFrame, columns: Sequence[str], by: str) -> DataFrame:
    """A row per value of ``by`` with the count ``n_<column>`` and the KLL sketch
    ``k_<column>`` of each column, to be written and merged later."""
    base, name = _numbers(df.select(by, *columns), columns, by)
    level1 = base.groupBy(by, (F.spark_partition_id() % KLL_BUCKETS).alias("_b")).agg(
        *[a for c in columns for a in (F.count(name[c]).alias(f"n_{c}"),
                                       F.kll_sketch_agg_double(name[c], KLL_K).alias(f"k_{c}"))])
    return level1.groupBy(by).agg(*[a for c in columns for a in (F.sum(f"n_{c}").alias(f"n_{c}"),
                                                                 F.kll_merge_agg_double(f"k_{c}").alias(f"k_{c}"))])


def multi_exact_quantiles(df: DataFrame, spec: dict[str, Sequence[float]], *,
                          max_candidates: int = DEFAULT_MAX_CANDIDATES,
                          sketches: DataFrame | None = None) -> dict[str, list[float | None]]:
    """Exact linear quantiles of several columns of one table in shared passes
    (nulls and NaN ignored; None for an empty column).

    ``sketches``: the ``kept_sketches`` of exactly these rows; the first round then merges
    them and reads no row of ``df``."""
    cols = list(spec)
    if not cols:
        return {}
    base, name = _numbers(df, cols)
    # the first round's sketches need no counts before them: read on a grid of the wanted fractions
    m = _MARGIN * KLL_EPS
    grid = {name[c]: [f for p in spec[c] for f in (p - m, p + m)] for c in cols}
    if sketches is None:
        merged = _sketches(base, {x: F.col(x) for x in name.values()})
    else:
        merged = sketches.agg(*[a for c, x in name.items() for a in (
            F.coalesce(F.sum(f"n_{c}"), F.lit(0)).alias(f"n{x}"), F.kll_merge_agg_double(f"k_{c}").alias(f"k{x}"))])
    first = _read(merged, grid)
    plans, found, open_ = {}, {}, []
    start: dict[int, list[float]] = {}
    for c in cols:
        n = first[f"n{name[c]}"]
        if not n:
            continue
        plans[c] = _plan(spec[c], n)
        if n <= max_candidates:
            open_.append(_Interval(name[c], sorted({k for k0, k1, _ in plans[c] for k in (k0, k1)}), 0, n))
            continue
        for i, (k0, k1, _) in enumerate(plans[c]):
            b = _Interval(name[c], [k0, k1] if k1 > k0 else [k0], 0, n)
            start[id(b)] = first[f"q{name[c]}"][2 * i:2 * i + 2]
            open_.append(b)
    small = []
    while open_:
        small += [b for b in open_ if b.size <= max_candidates]
        big = [b for b in open_ if b.size > max_candidates]
        known = start and (lambda _, big=big: [start[id(b)] for b in big])
        open_ = _narrow(base, big, found, known or None) if big else []
        start = {}
    if small:
        _gather(base, small, found)
    out: dict[str, list[float | None]] = {}
    for c in cols:
        if c not in plans:
            out[c] = [None for _ in spec[c]]
            continue
        ends = [(found[name[c], k0], found[name[c], k1], frac) for k0, k1, frac in plans[c]]
        out[c] = [lo if frac == 0 or lo == hi else lo + (hi - lo) * frac for lo, hi, frac in ends]
    return out


def exact_quantiles(df: DataFrame, column: str, probs: Sequence[float], *,
                    max_candidates: int = DEFAULT_MAX_CANDIDATES) -> list[float | None]:
    """Linear-interpolated quantiles of ``column`` (nulls and NaN ignored).

    Returns one float per probability, ``None`` for an empty column.
    """
    return multi_exact_quantiles(df, {column: list(probs)}, max_candidates=max_candidates)[column]


def multi_approx_quantiles(df: DataFrame, spec: dict[str, Sequence[float]]) -> dict[str, list[float | None]]:
    """One-pass sketch quantiles of several columns (values of the data, rank error about KLL_EPS)."""
    base, name = _numbers(df, list(spec))
    row = _read(_sketches(base, {x: F.col(x) for x in name.values()}), {name[c]: list(p) for c, p in spec.items()})
    return {c: list(row[f"q{name[c]}"] or [None] * len(p))[:len(p)] for c, p in spec.items()}


def approx_quantiles(df: DataFrame, column: str, probs: Sequence[float]) -> list[float | None]:
    """One-pass sketch quantiles of one column."""
    return multi_approx_quantiles(df, {column: list(probs)})[column]


def quantiles(df: DataFrame, column: str, probs: Sequence[float], approx: bool = False,
              **kw) -> list[float | None]:
    """Exact (default) or sketch quantiles of one column."""
    return approx_quantiles(df, column, probs) if approx else exact_quantiles(df, column, probs, **kw)


def quantile_table(df: DataFrame, columns: Sequence[str], probs: Sequence[float],
                   approx: bool = False, **kw) -> DataFrame:
    """Long table (metric, p, value) of quantiles of several columns."""
    spark = df.sparkSession
    if approx:
        got = multi_approx_quantiles(df, {c: list(probs) for c in columns})
    else:
        got = multi_exact_quantiles(df, {c: list(probs) for c in columns}, **kw)
    rows = [(c, float(p), F.lit(None).cast("double") if v is None else float(v))
            for c in columns for p, v in zip(probs, got[c])]
    return literal_rows(spark, [(name, [r[k] for r in rows]) for k, name in enumerate(["metric", "p", "value"])])
