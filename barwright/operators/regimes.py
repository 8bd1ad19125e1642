"""Market regimes: trending up, trending down, or neither."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barwright.functions import windows as W
from barwright.operators.factors import _P, SINGLE, _factors, free, in_blocks, reach, smoothed
from barwright.plans import blocks
from barwright.plans.config import REGIMES, FactorConfig


def classify(bars: DataFrame, cfg: FactorConfig | None = None, adx_threshold: float = 25.0, slope_lookback: int = 24, min_dwell: int = 6, out: str = "regime", causal: bool = False) -> DataFrame:
    """``bars`` with a regime: the trend's sign where ADX reaches the threshold, ``chop`` elsewhere.

    A new label is taken over if its run lasts ``min_dwell`` bars. By default it is so from the run's first bar, which looks
    ahead within the run; ``causal`` takes it over when the run has lasted so long.
    """
    cfg = cfg or FactorConfig()
    with in_blocks(bars):
        df = _labelled(smoothed(bars, cfg), bars.columns, cfg, adx_threshold, slope_lookback, out)
    return dwell(blocks.own(df) if blocks.is_laid_out(bars) else df, min_dwell, out, causal)


def features(bars: DataFrame, cfg: FactorConfig | None = None, adx_threshold: float = 25.0, slope_lookback: int = 24, min_dwell: int = 6, out: str = "regime") -> DataFrame:
    """``bars`` with all factors and the regime, which share the means: ``compute_all_factors`` and ``classify`` in one."""
    cfg = cfg or FactorConfig()
    free(bars)
    with in_blocks(bars):
        df = _labelled(_factors(smoothed(bars, cfg), cfg), [*bars.columns, *[f"f_{n}" for n in SINGLE]], cfg, adx_threshold, slope_lookback, out)
    return dwell(blocks.own(df) if blocks.is_laid_out(bars) else df, min_dwell, out)


def _labelled(df: DataFrame, columns: list[str], cfg: FactorConfig, adx_threshold: float, slope_lookback: int, out: str) -> DataFrame:
    if blocks.is_laid_out(df) and slope_lookback > reach(cfg):
        df = blocks.halo(blocks.own(df), slope_lookback)
    e = F.col(f"{_P}e{cfg.means[2]}")
    df = df.withColumn(_P + "was", W.previous(e, slope_lookback))
    slope = W.ratio(e - F.col(_P + "was"), F.col(_P + "was"))
    strong = F.col(_P + "adx") >= adx_threshold
    return df.select(*columns, F.when(strong & (slope > 0), "trend_up").when(strong & (slope < 0), "trend_down").otherwise("chop").alias(out))


def dwell(df: DataFrame, min_dwell: int, out: str = "regime", causal: bool = False) -> DataFrame:
    """Smooth labels: runs shorter than ``min_dwell`` keep the label before; the first bar's label always counts."""
    if min_dwell <= 1:
        return df
    columns = df.columns
    if blocks.is_laid_out(df):
        return _dwell_in_blocks(df, min_dwell, out, causal)
    df = df.withColumn(_P + "new", (F.col(out) != W.previous(F.col(out))).cast("int"))
    df = df.withColumn(_P + "run", F.sum(F.coalesce(_P + "new", F.lit(0))).over(W.so_far()))
    run = Window.partitionBy(W.SERIES, _P + "run")
    length = F.row_number().over(run.orderBy(W.TIME)) if causal else F.count("*").over(run)
    df = df.withColumn(_P + "len", length)
    taken = F.when((F.col(_P + "len") >= min_dwell) | (F.col(_P + "run") == 0), F.col(out))
    df = df.withColumn(_P + "kept", F.last(taken, ignorenulls=True).over(W.so_far()))
    return df.select(*[F.col(_P + "kept").alias(c) if c == out else c for c in columns])


def _dwell_in_blocks(df: DataFrame, min_dwell: int, out: str, causal: bool) -> DataFrame:
    """The same over own rows of a laid-out frame: with ``min_dwell`` rows on either side a block sees as much of each run as matters."""
    columns = df.columns
    with W.keyed(W.SERIES, blocks.BLOCK):
        wide = blocks.halo(df, min_dwell, min_dwell)
        wide = wide.withColumn(_P + "new", (F.col(out) != W.previous(F.col(out))).cast("int"))
        wide = wide.withColumn(_P + "run", F.sum(F.coalesce(_P + "new", F.lit(0))).over(W.so_far()))
        run = Window.partitionBy(W.SERIES, blocks.BLOCK, _P + "run")
        length = F.row_number().over(run.orderBy(W.TIME)) if causal else F.count("*").over(run)
        wide = wide.withColumns({_P + "len": length, _P + "from": F.min(blocks.PLACE).over(run)})
        taken = F.when((F.col(_P + "len") >= min_dwell) | (F.col(_P + "from") == 0), F.col(out))
        wide = blocks.own(wide.select(*columns, taken.alias(_P + "taken")))
    return blocks.last_known(wide, _P + "taken").select(*[F.col("__bw_value").alias(c) if c == out else c for c in columns])


def regime_stats(df: DataFrame, column: str = "regime") -> DataFrame:
    """Bars and percentage (one decimal) of every regime, absent ones with 0: one aggregate, stood on end."""
    counts = df.agg(*[F.count_if(F.col(column) == r).alias(r) for r in REGIMES], F.count("*").alias("total"))
    rows = counts.selectExpr(f"stack({len(REGIMES)}, {', '.join(f"'{r}', {r}, total" for r in REGIMES)}) as (regime, bars, total)")
    return rows.select("regime", "bars", F.coalesce(F.round(100.0 * F.col("bars") / F.nullif("total", F.lit(0)), 1), F.lit(0.0)).alias("pct"))
