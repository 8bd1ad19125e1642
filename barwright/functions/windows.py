"""Column builders over a series of bars: rolling frames, recursive inputs, session anchors.

NULL is the only missing marker. A rolling value is NULL until its frame holds n non-missing values, since Spark
would otherwise return a value for a part of the frame.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

SERIES, TIME = "series_id", "ts"
#: What windows are partitioned by, and where they note how far they look back.
_KEYS: ContextVar[tuple[str, ...]] = ContextVar("keys", default=(SERIES,))
_REACH: ContextVar[list[int] | None] = ContextVar("reach", default=None)


@contextmanager
def keyed(*keys: str) -> Iterator[None]:
    """Windows built inside run over rows of equal ``keys``: over blocks of series, say."""
    token = _KEYS.set(keys)
    try:
        yield
    finally:
        _KEYS.reset(token)


@contextmanager
def noted() -> Iterator[list[int]]:
    """A list of how many rows back each window looks that is built inside."""
    seen: list[int] = []
    token = _REACH.set(seen)
    try:
        yield seen
    finally:
        _REACH.reset(token)


def keys() -> tuple[str, ...]:
    return _KEYS.get()


def note(n: int) -> None:
    if (seen := _REACH.get()) is not None:
        seen.append(n)


def line() -> WindowSpec:
    """All bars of a series in order."""
    return Window.partitionBy(*_KEYS.get()).orderBy(TIME)


def frame(n: int) -> WindowSpec:
    note(n - 1)
    return line().rowsBetween(-(n - 1), 0)


def so_far() -> WindowSpec:
    return line().rowsBetween(Window.unboundedPreceding, 0)


def rolling(agg, x: Column, n: int) -> Column:
    return F.when(F.count(x).over(frame(n)) == n, agg(x).over(frame(n)))


def ratio(a: Column, b: Column) -> Column:
    """a / b, NULL where b is 0: Spark in ANSI mode raises otherwise."""
    return a / F.nullif(b, F.lit(0.0))


def clip(x: Column, lo: float, hi: float) -> Column:
    """Keeps NULL, which least and greatest would skip; bounds in the wrong order are swapped."""
    lo, hi = min(lo, hi), max(lo, hi)
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(float(lo))), F.lit(float(hi))))


def sma(x: Column, n: int) -> Column:
    return rolling(F.avg, x, n)


def stdev(x: Column, n: int) -> Column:
    return rolling(F.stddev_samp, x, n)


def zscore(x: Column, n: int) -> Column:
    return F.coalesce(ratio(x - sma(x, n), stdev(x, n)), F.lit(0.0))


def highest(x: Column, n: int) -> Column:
    return rolling(F.max, x, n)


def lowest(x: Column, n: int) -> Column:
    return rolling(F.min, x, n)


def corr(a: Column, b: Column, n: int) -> Column:
    """Rolling correlation; NULL on a constant window (F.corr raises there in ANSI mode)."""
    both = a.isNotNull() & b.isNotNull()
    x, y = F.when(both, a), F.when(both, b)
    w = frame(n)
    value = F.covar_samp(x, y).over(w) / F.nullif(F.stddev_samp(x).over(w) * F.stddev_samp(y).over(w), F.lit(0.0))
    return F.when(F.count(x).over(w) == n, value)


def bar_index() -> Column:
    return (F.row_number().over(line()) - 1).cast("double")


def raw_slope(x: Column, index: Column, n: int) -> Column:
    """Least-squares slope per bar, 0 where it has no value."""
    return F.coalesce(F.when(F.count(x).over(frame(n)) == n, F.regr_slope(x, index).over(frame(n))), F.lit(0.0))


def previous(x: Column, n: int = 1) -> Column:
    note(n)
    return F.lag(x, n).over(line())


def forward_fill(x: Column) -> Column:
    return F.last(x, ignorenulls=True).over(so_far())


def pct_change(x: Column) -> Column:
    """Change to the last known value before, 0 where there is none."""
    before = F.last(x, ignorenulls=True).over(line().rowsBetween(Window.unboundedPreceding, -1))
    return F.coalesce(ratio(forward_fill(x), before) - 1, F.lit(0.0))


def true_range() -> Column:
    before = previous(F.col("close"))
    return F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before))


def typical() -> Column:
    return (F.col("high") + F.col("low") + F.col("close")) / 3.0


def vwap_core(n: int) -> Column:
    return ratio(rolling(F.sum, typical() * F.col("volume"), n), rolling(F.sum, F.col("volume"), n))


def today() -> WindowSpec:
    """The bars of a bar's day so far."""
    return Window.partitionBy(*_KEYS.get(), F.to_date(TIME)).orderBy(TIME).rowsBetween(Window.unboundedPreceding, 0)


def bb_width(x: Column, n: int, k: float) -> Column:
    return ratio(2.0 * k * stdev(x, n), x)


def bands(x: Column, n: int, k: float) -> tuple[Column, Column, Column]:
    mid = sma(x, n)
    off = k * stdev(x, n)
    return mid - off, mid, mid + off


def log_return(x: Column) -> Column:
    step = ratio(x, previous(x))
    return F.when(step > 0, F.ln(step))


def directional(up: bool) -> Column:
    """Directional movement up or down of a bar; 0 on the first."""
    rise = F.coalesce(F.col("high") - previous(F.col("high")), F.lit(None).cast("double"))
    fall = F.coalesce(previous(F.col("low")) - F.col("low"), F.lit(None).cast("double"))
    a, b = (rise, fall) if up else (fall, rise)
    return F.when((a > b) & (a > 0), a).otherwise(0.0)


def finite(x: Column) -> Column:
    """NULL for NaN and infinite values."""
    return F.when(~F.isnan(x) & (F.abs(x) < F.lit(math.inf)), x)


def finite_or_same(x: Column) -> Column:
    """NaN, which some sources use for missing, becomes NULL; infinite values stay until the end."""
    return F.when(~F.isnan(x), x)
