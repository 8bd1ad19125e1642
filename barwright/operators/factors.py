"""The factor library: seventeen views of a bar in -1..1, positive for long.

All smoothing that the factors share is done in two passes over the sorted series, whatever factors are asked for; the
rest are windows over the same order.
"""

from __future__ import annotations

from contextlib import nullcontext

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barwright.functions import windows as W
from barwright.functions.compiler import dx_value, rsi_value
from barwright.functions.sequential import block_medians, ewm, span, wilder
from barwright.plans import blocks
from barwright.plans.config import FactorConfig

#: What ``compute_all_factors`` adds, in order.
SINGLE = ("rsi", "ema_cross", "macd", "trend", "volume", "oi", "funding", "slope_regression", "adx_strength", "rsi_delta", "volume_zscore", "atr_stability", "bb_width", "vwap_distance")
_P = "__bw_f_"


def _c(name: str) -> Column:
    return F.col(_P + name)


def _tanh(x: Column, scale: float) -> Column:
    return F.coalesce(F.tanh(x * scale), F.lit(0.0))


def _third(z: Column) -> Column:
    return W.clip(z, -3, 3) / 3.0


def reach(cfg: FactorConfig) -> int:
    """Rows before a block that the factors' windows need at most, one window upon another."""
    return sum(cfg.usual) + 5 * cfg.bands[0] + cfg.vwap + cfg.slope + 8


def in_blocks(df: DataFrame):
    """Windows by series, or by block of a laid-out frame."""
    return W.keyed(W.SERIES, blocks.BLOCK) if blocks.is_laid_out(df) else nullcontext()


def _ewm(df: DataFrame, specs: dict[str, tuple[str, float]], cfg: FactorConfig, medians: dict[str, tuple[str, int]] | None = None) -> DataFrame:
    """Means and rolling medians; of a laid-out frame over own rows, after which each block gets its rows before again."""
    if not blocks.is_laid_out(df):
        return ewm(df, specs, medians)
    df = blocks.halo(ewm(blocks.own(df), specs), reach(cfg))
    return block_medians(df, medians) if medians else df


def smoothed(df: DataFrame, cfg: FactorConfig, smooth: int = 4) -> DataFrame:
    """``df`` with the smoothed inputs of all factors in temporary columns; a laid-out frame gets the halos of the factors' windows."""
    with in_blocks(df):
        return _smoothed(df, cfg, smooth)


def _smoothed(df: DataFrame, cfg: FactorConfig, smooth: int) -> DataFrame:
    if blocks.is_laid_out(df):
        df = blocks.halo(blocks.last_known(df, "close").withColumnRenamed("__bw_value", _P + "known"), reach(cfg))
    else:
        df = df.withColumn(_P + "known", W.forward_fill(F.col("close")))
    close = F.col("close")
    for name in ("open_interest", "funding_rate"):
        if name not in df.columns:
            df = df.withColumn(name, F.lit(None).cast("double"))
    change = close - W.previous(close)
    oi = F.col("open_interest")
    inputs = {
        "up": F.when(change.isNotNull(), F.greatest(change, F.lit(0.0))), "down": F.when(change.isNotNull(), F.greatest(-change, F.lit(0.0))),
        "tr": W.true_range(), "plus": W.directional(True), "minus": W.directional(False), "ret": F.coalesce(W.ratio(_c("known"), W.previous(_c("known"))) - 1, F.lit(0.0)),
        "vol_z": W.zscore(F.col("volume"), cfg.usual[0]), "oi_step": oi - W.previous(oi), "close": close, "width": W.bb_width(close, cfg.bands[0], cfg.bands[1]),
    }
    df = df.withColumns({_P + k: v.cast("double") for k, v in inputs.items()})
    df = df.withColumn(_P + "oi_z", W.zscore(_c("oi_step"), cfg.usual[1]))
    first = {f"e{n}": ("close", span(n)) for n in (cfg.means[0], cfg.means[1], cfg.means[2], cfg.macd[0], cfg.macd[1])}
    first |= {"rsi_up": ("up", wilder(cfg.rsi)), "rsi_down": ("down", wilder(cfg.rsi))}
    first |= {f"{k}_{n}": (k, wilder(n)) for k, n in (("tr", cfg.atr), ("tr", cfg.adx), ("plus", cfg.adx), ("minus", cfg.adx))}
    first |= {"direction": ("ret", span(smooth))}
    df = _ewm(df, {_P + k: (_P + c, a) for k, (c, a) in first.items()}, cfg, {_P + "width_mid": (_P + "width", cfg.bands[0] * 4)})
    sign = F.coalesce(F.signum(_c("direction")), F.lit(0.0))
    df = df.withColumns({
        _P + "dx": dx_value(_c(f"tr_{cfg.adx}"), _c(f"plus_{cfg.adx}"), _c(f"minus_{cfg.adx}")),
        _P + "line": _c(f"e{cfg.macd[0]}") - _c(f"e{cfg.macd[1]}"),
        _P + "vol_s": _third(_c("vol_z")) * sign, _P + "oi_s": _third(_c("oi_z")) * sign,
    })
    second = {"adx": ("dx", wilder(cfg.adx)), "signal": ("line", span(cfg.macd[2])), "vol_e": ("vol_s", span(smooth)), "oi_e": ("oi_s", span(smooth))}
    return _ewm(df, {_P + k: (_P + c, a) for k, (c, a) in second.items()}, cfg).withColumn(_P + "adx", F.coalesce(_c("adx"), F.lit(0.0)))


def free(bars: DataFrame) -> None:
    taken = [f"f_{c}" for c in SINGLE if f"f_{c}" in bars.columns]
    if taken:
        raise ValueError(f"the bars have columns {taken} already")


def compute_all_factors(bars: DataFrame, cfg: FactorConfig | None = None) -> DataFrame:
    """``bars`` with fourteen factor columns, named ``f_`` and the factor. Missing funding and open interest give 0.

    ``atr_stability`` looks at the median of the whole series, as its definition says; all others look back only.
    """
    cfg = cfg or FactorConfig()
    free(bars)
    with in_blocks(bars):
        found = _factors(smoothed(bars, cfg), cfg)
        found = blocks.own(found) if blocks.is_laid_out(bars) else found
        return found.select(*bars.columns, *[f"f_{n}" for n in SINGLE])


def _factors(df: DataFrame, cfg: FactorConfig) -> DataFrame:
    close, volume = F.col("close"), F.col("volume")
    trend = _c(f"e{cfg.means[2]}")
    atr = _c(f"tr_{cfg.atr}")
    df = df.withColumns({
        _P + "rsi": rsi_value(_c("rsi_up"), _c("rsi_down")), _P + "slope": W.raw_slope(close, F.col(blocks.PLACE).cast("double") if blocks.is_laid_out(df) else F.row_number().over(W.line()).cast("double"), cfg.slope),
        _P + "fund_z": W.zscore(F.col("funding_rate"), cfg.usual[2]), _P + "vwap": W.vwap_core(cfg.vwap),
    })
    if blocks.is_laid_out(df):
        df = blocks.with_median(df, _P + f"tr_{cfg.atr}", _P + "atr_mid")
    else:
        df = df.withColumn(_P + "atr_mid", F.median(atr).over(Window.partitionBy(W.SERIES)))
    df = df.withColumns({_P + "rsi_was": W.previous(_c("rsi")), _P + "atr_step": F.abs(atr - W.previous(atr))})
    eps = F.when(_c("atr_mid") > 0, _c("atr_mid") * 0.0001).otherwise(1e-6)
    stable = W.clip(1.0 - _c("atr_step") / F.when(atr.isNotNull(), F.greatest(atr, eps)), 0, 1)
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    out = {
        "rsi": W.clip((50.0 - _c("rsi")) / 50.0, -1, 1),
        "ema_cross": _tanh(W.ratio(_c(f"e{cfg.means[0]}") - _c(f"e{cfg.means[1]}"), close), 50.0),
        "macd": _tanh(W.ratio(_c("line") - _c("signal"), close), 200.0),
        "trend": zero(F.tanh(W.ratio(close - trend, trend) * 30.0) * W.clip((_c("adx") - 15.0) / 25.0, 0, 1)),
        "volume": zero(_c("vol_e")),
        "oi": zero(_c("oi_e")),
        "funding": zero(0.0 - _third(_c("fund_z"))),
        "slope_regression": _tanh(zero(W.ratio(_c("slope"), close)), 2000.0),
        "adx_strength": zero(W.clip((_c("adx") - 27.5) / 12.5, -1, 1)),
        "rsi_delta": zero(W.clip((_c("rsi") - _c("rsi_was")) / 50.0, -1, 1)),
        "volume_zscore": zero(_third(_c("vol_z"))),
        "atr_stability": zero(stable * 2.0 - 1.0),
        "bb_width": _tanh(zero(W.ratio(_c("width") - _c("width_mid"), _c("width_mid"))), 2.0),
        "vwap_distance": _tanh(zero(W.ratio(close - _c("vwap"), _c("vwap"))), 50.0),
    }
    return df.withColumns({f"f_{n}": out[n] for n in SINGLE})
