"""Bars: schema, building them from events, deduplication, closed-bar cutoff, as-of joins, datasets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BAR_COLUMNS = ("open", "high", "low", "close", "volume")
#: Timeframes in milliseconds.
TIMEFRAME_MS = {"1m": 60_000, "5m": 300_000, "15m": 900_000, "1h": 3_600_000, "4h": 14_400_000, "8h": 28_800_000, "1d": 86_400_000, "3d": 259_200_000}


def interval(timeframe: str) -> str:
    return f"{TIMEFRAME_MS[timeframe] // 1000} seconds"


def validate_bars(df: DataFrame, needed: tuple[str, ...] = ("close", "high", "low")) -> DataFrame:
    """Raise ValueError if a needed column is absent; NaN becomes NULL in every double column."""
    missing = [c for c in needed if c not in df.columns]
    if missing:
        raise ValueError(f"bars lack the columns {missing}")
    return df.withColumns({n: F.when(~F.isnan(n), F.col(n)) for n, t in df.dtypes if t in ("double", "float")})


def bars_from_events(events: DataFrame, timeframe: str, price: Column, size: Column, series: Column | None = None, ts: str = "ts", order: str | None = None) -> DataFrame:
    """OHLCV bars of ``timeframe`` from priced events: one shuffle, with the aggregates built up before it."""
    by = F.struct(F.col(ts), *([F.col(order)] if order else []))
    opened = F.window(F.col(ts), interval(timeframe))["start"]
    rows = events.select((series if series is not None else F.lit("all")).cast("string").alias("series_id"), opened.alias("bar"), price.alias("p"), size.cast("double").alias("v"), by.alias("o"))
    return rows.groupBy("series_id", F.col("bar").alias("ts")).agg(F.min_by("p", "o").alias("open"), F.max("p").alias("high"), F.min("p").alias("low"), F.max_by("p", "o").alias("close"), F.sum("v").alias("volume"))


def rebucket(bars: DataFrame, timeframe: str) -> DataFrame:
    """Bars of a longer timeframe from shorter ones."""
    rows = bars.withColumn("bar", F.window("ts", interval(timeframe))["start"])
    return rows.groupBy("series_id", F.col("bar").alias("ts")).agg(
        F.min_by("open", rows.ts).alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", rows.ts).alias("close"), F.sum("volume").alias("volume")
    )


def first_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in ``order``: deduplication that does not depend on the rows' places."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__bw_rn", F.row_number().over(w)).where("__bw_rn = 1").drop("__bw_rn")


def closed_bars(bars: DataFrame, timeframe: str, now: Column) -> DataFrame:
    """Only bars that had closed at ``now``."""
    return bars.where(F.col("ts") <= now - F.expr(f"interval {interval(timeframe)}"))


def with_sessions(bars: DataFrame, gap: str, keys: tuple[str, ...] = ("series_id",), out: str = "session") -> DataFrame:
    """When each bar's session began: one begins with a series and with every bar more than ``gap`` (an interval) after the one before."""
    w = Window.partitionBy(*keys).orderBy("ts")
    began = F.when(F.lag("ts").over(w).isNull() | (F.col("ts") > F.lag("ts").over(w) + F.expr(f"interval {gap}")), F.col("ts"))
    return bars.withColumn("__bw_began", began).withColumn(out, F.last("__bw_began", True).over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__bw_began")


def _sides(left: DataFrame, right: DataFrame, values: list[str]) -> DataFrame:
    """Both sides in one table: the bars' rows carry their columns, the others' a struct of values."""
    own = [c for c in left.columns if c not in ("series_id", "ts")]
    held = F.struct(F.col("ts").alias("__bw_at"), *values)
    a = left.select("series_id", "ts", F.lit(1).alias("__bw_side"), F.struct(*own, F.lit(1).alias("__bw_own")).alias("__bw_left"))
    b = right.select("series_id", "ts", F.lit(0).alias("__bw_side"), held.alias("__bw_right"))
    return a.unionByName(b, allowMissingColumns=True)


def asof_backward(left: DataFrame, right: DataFrame, values: list[str], names: list[str] | None = None) -> DataFrame:
    """Each row of ``left`` with the values of the last row of ``right`` at or before it, of its series; NULL values match too.

    A union and one window, no range join. Of several right rows of one time the last in the order of their values counts.
    """
    w = Window.partitionBy("series_id").orderBy("ts", "__bw_side", "__bw_right").rowsBetween(Window.unboundedPreceding, 0)
    both = _sides(left, right, values).withColumn("__bw_m", F.last("__bw_right", ignorenulls=True).over(w))
    own = [c for c in left.columns if c not in ("series_id", "ts")]
    return both.where("__bw_side = 1").select("series_id", "ts", *[F.col(f"__bw_left.{c}").alias(c) for c in own], *[F.col(f"__bw_m.{v}").alias(n) for v, n in zip(values, names or values, strict=True)])


def asof_nearest(left: DataFrame, right: DataFrame, values: list[str], tolerance_s: int, names: list[str] | None = None) -> DataFrame:
    """As ``asof_backward``, with the nearest row within ``tolerance_s`` seconds (inclusive); of two equally near, the later one."""
    w = Window.partitionBy("series_id").orderBy("ts", "__bw_side", "__bw_right")
    both = _sides(left, right, values).withColumns({
        "__bw_b": F.last("__bw_right", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)),
        "__bw_f": F.first("__bw_right", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing)),
    })
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    back, ahead = micros("ts") - micros("__bw_b.__bw_at"), micros("__bw_f.__bw_at") - micros("ts")
    most = F.lit(tolerance_s * 1_000_000)
    pick = F.when(ahead.isNotNull() & (back.isNull() | (ahead <= back)) & (ahead <= most), F.col("__bw_f")).when(back <= most, F.col("__bw_b"))
    own = [c for c in left.columns if c not in ("series_id", "ts")]
    both = both.where("__bw_side = 1").withColumn("__bw_m", pick)
    return both.select("series_id", "ts", *[F.col(f"__bw_left.{c}").alias(c) for c in own], *[F.col(f"__bw_m.{v}").alias(n) for v, n in zip(values, names or values, strict=True)])


def asof_closed(left: DataFrame, right: DataFrame, timeframe: str, values: list[str], names: list[str] | None = None) -> DataFrame:
    """As-of join with bars of another timeframe that had closed: they count from open + duration on, so none looks ahead."""
    later = right.withColumn("ts", F.col("ts") + F.expr(f"interval {interval(timeframe)}"))
    return asof_backward(left, later, values, names)


def build_dataset(klines: DataFrame, funding: DataFrame | None = None, open_interest: DataFrame | None = None) -> DataFrame:
    """Bars with the last funding rate (backward) and open interest (nearest, within an hour); NULL where there is none."""
    df = klines
    if funding is not None:
        df = asof_backward(df, funding, ["funding_rate"])
    else:
        df = df.withColumn("funding_rate", F.lit(None).cast("double"))
    if open_interest is not None:
        return asof_nearest(df, open_interest, ["open_interest"], 3600)
    return df.withColumn("open_interest", F.lit(None).cast("double"))
