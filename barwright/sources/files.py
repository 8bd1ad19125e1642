"""Bars and signals from files, a partitioned bar store, and symbols."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BAR_SCHEMA = "series_id string, ts timestamp_ntz, open double, high double, low double, close double, volume double, quote_volume double, taker_buy_quote double, funding_rate double, open_interest double"


def read_bars(spark: SparkSession, path: str, series: str | None = None) -> DataFrame:
    """Bars from a Parquet or CSV path (by its ending; CSV with a header, time first), read with a stated schema."""
    if path.rstrip("/").endswith(".csv"):
        df = spark.read.csv(path, header=True, schema="ts timestamp_ntz, open double, high double, low double, close double, volume double")
    else:
        df = spark.read.parquet(path)
    return df if "series_id" in df.columns else df.withColumn("series_id", F.lit(series or "all"))


def write_store(bars: DataFrame, path: str, kind: str, timeframe: str) -> None:
    """Add bars to a store partitioned by kind, timeframe, series and day; days that are written again are replaced."""
    df = bars.withColumns({"kind": F.lit(kind), "timeframe": F.lit(timeframe), "day": F.to_date("ts")})
    df.write.partitionBy("kind", "timeframe", "series_id", "day").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)


def read_store(spark: SparkSession, path: str, kind: str, timeframe: str, series: str, start: str, end: str) -> DataFrame:
    """Bars of a store in [start, end): series and days are pruned as partitions, the rest is pushed to the scan."""
    df = spark.read.parquet(path)
    days = (F.col("day") >= F.to_date(F.lit(start))) & (F.col("day") <= F.to_date(F.lit(end)))
    chosen = (F.col("kind") == kind) & (F.col("timeframe") == timeframe) & (F.col("series_id") == series)
    span = (F.col("ts") >= F.lit(start).cast("timestamp_ntz")) & (F.col("ts") < F.lit(end).cast("timestamp_ntz"))
    return df.where(chosen & days & span).drop("kind", "timeframe", "day")


def venue_coin(symbol: Column) -> Column:
    """A symbol without its USDT ending; names with a prefix stay."""
    return F.when(symbol.contains(":"), symbol).otherwise(F.regexp_replace(symbol, "(?i)USDT$", ""))


def is_builder_market(symbol: Column) -> Column:
    return F.instr(symbol, ":") > 0


def builder_prefix(symbol: Column) -> Column:
    return F.when(is_builder_market(symbol), F.lower(F.split_part(symbol, F.lit(":"), F.lit(1)))).otherwise("")


def funding_per_bar(rate: Column, bars_per_period: int = 8) -> Column:
    """The share of a funding rate that a bar pays; missing rates are 0."""
    return F.coalesce(rate, F.lit(0.0)) / float(bars_per_period)
