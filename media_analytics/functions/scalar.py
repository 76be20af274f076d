"""Column expressions (JVM-side, whole-stage-codegen friendly). No Python UDFs."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

from .constants import DAYPARTS, MONTH_THIRDS, WEEKEND

ColumnOrName = Column | str

MICROS_PER_DAY = 86_400_000_000


def col(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ntz_literal(ts: datetime | date | str) -> Column:
    """A TIMESTAMP_NTZ literal (no zone conversion anywhere)."""
    if isinstance(ts, datetime):
        text = ts.strftime("%Y-%m-%d %H:%M:%S.%f")
    elif isinstance(ts, date):
        text = ts.strftime("%Y-%m-%d 00:00:00")
    else:
        text = str(ts)
    return F.expr(f"TIMESTAMP_NTZ '{text}'")


def safe_div(num: ColumnOrName, den: ColumnOrName) -> Column:
    """num / den as double; 0 when den is 0 or null (ANSI-safe, never inf)."""
    return F.coalesce(F.try_divide(col(num).cast("double"), col(den).cast("double")), F.lit(0.0))


def ratio_or_null(num: ColumnOrName, den: ColumnOrName) -> Column:
    """num / den as double; NULL when den is 0 or null."""
    return F.try_divide(col(num).cast("double"), col(den).cast("double"))


def micros_between(start: str, end_sql: str) -> Column:
    """Microseconds from column ``start`` to SQL expression ``end_sql`` (NTZ safe)."""
    return F.expr(f"timestampdiff(MICROSECOND, `{start}`, {end_sql})")


def age_days(ts_col: str, as_of: datetime, absolute: bool = True) -> Column:
    """Whole days elapsed from ``ts_col`` to ``as_of``, floored toward minus infinity.

    26 hours in the future gives -2 (floor), then 2 when ``absolute``.
    """
    as_of_sql = f"TIMESTAMP_NTZ '{as_of.strftime('%Y-%m-%d %H:%M:%S.%f')}'"
    days = F.floor(micros_between(ts_col, as_of_sql) / F.lit(float(MICROS_PER_DAY))).cast("bigint")
    return F.abs(days) if absolute else days


# fixed value: ISO-8601 duration, matched at the start of the text only: PT[nH][nM][nS].
_ISO_DURATION = r"^PT(?:(\d+)H)?(?:(\d+)M)?(?:(\d+)S)?"


def duration_minutes(c: ColumnOrName, round_digits: int | None = None) -> Column:
    """ISO-8601 duration text to minutes; ``PT`` is 0, no ``PT`` prefix is NULL."""
    d = col(c).cast("string")

    def grp(i: int) -> Column:
        g = F.regexp_extract(d, _ISO_DURATION, i)
        return F.coalesce(F.when(g != "", g).cast("double"), F.lit(0.0))

    minutes = grp(1) * 60 + grp(2) + grp(3) / 60.0
    out = F.when(d.rlike(r"^PT"), minutes)
    if round_digits is not None:
        out = F.bround(out, round_digits)
    return out


def posting_period(ts: ColumnOrName, mode: str = "daypart") -> Column:
    """Day part from the hour (default) or third of the month from the day."""
    t = col(ts)
    if mode == "daypart":
        h = F.hour(t)
        morning, afternoon, evening, night = DAYPARTS
        return (F.when((h >= 6) & (h < 12), morning)
                .when((h >= 12) & (h < 18), afternoon)
                .when((h >= 18) & (h < 22), evening)
                .otherwise(night))
    if mode == "month_third":
        d = F.dayofmonth(t)
        first, middle, last = MONTH_THIRDS
        return F.when(d <= 10, first).when(d <= 20, middle).otherwise(last)
    raise ValueError(f"unknown posting period mode {mode!r}")


def cut(c: ColumnOrName, edges: list[float], labels: list[str] | None = None) -> Column:
    """Right-closed bucket label: (e0, e1] -> labels[0] ...; outside -> NULL.

    Without labels the label is the interval text ``(lo, hi]``.
    """
    x = col(c)
    if labels is None:
        labels = [f"({_num_text(lo)}, {_num_text(hi)}]" for lo, hi in zip(edges, edges[1:])]
    if len(labels) != len(edges) - 1:
        raise ValueError("need one label per bucket")
    out = None
    for lo, hi, lab in zip(edges, edges[1:], labels):
        cond = (x > F.lit(lo)) & (x <= F.lit(hi))
        out = F.when(cond, lab) if out is None else out.when(cond, lab)
    return out


def bucket_order(c: ColumnOrName, edges: list[float]) -> Column:
    """0-based index of the right-closed bucket, NULL outside (for sorting labels)."""
    x = col(c)
    out = None
    for i, (lo, hi) in enumerate(zip(edges, edges[1:])):
        cond = (x > F.lit(lo)) & (x <= F.lit(hi))
        out = F.when(cond, F.lit(i)) if out is None else out.when(cond, F.lit(i))
    return out


def _num_text(v: float) -> str:
    return str(int(v)) if float(v).is_integer() else str(v)


def short_number(c: ColumnOrName) -> Column:
    """Fixed format: 0 or NULL -> '0'; otherwise K / M / B with one decimal by absolute value."""
    x = col(c).cast("double")
    a = F.abs(x)
    return (F.when(x.isNull() | (x == 0), F.lit("0"))
            .when(a >= 1e9, F.format_string("%.1fB", x / 1e9))
            .when(a >= 1e6, F.format_string("%.1fM", x / 1e6))
            .when(a >= 1e3, F.format_string("%.1fK", x / 1e3))
            .otherwise(F.format_string("%.0f", x)))


def percent_text(c: ColumnOrName, digits: int = 2, signed: bool = False) -> Column:
    """``12.34%``; ``+1.20%`` style when ``signed``."""
    fmt = ("%+." if signed else "%.") + f"{digits}f%%"
    return F.format_string(fmt, col(c).cast("double"))


def is_weekend(day_name: ColumnOrName) -> Column:
    return col(day_name).isin(*WEEKEND).cast("int")
