"""Several timeframes: volatility, the choice of a primary one, and factor frames aligned without looking ahead."""

from __future__ import annotations

import datetime as dt
from collections import OrderedDict
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barwright.functions import windows as W
from barwright.operators.factors import SINGLE, compute_all_factors
from barwright.operators.regimes import features
from barwright.plans.bars import asof_closed
from barwright.plans.config import FACTORS, TF_CANDIDATES, TF_TIERS, FactorConfig

SLOW = {"rsi_slow": "rsi", "ema_cross_slow": "ema_cross", "macd_slow": "macd"}


def tf_volatility(bars: DataFrame, n: int = 14) -> DataFrame:
    """The median of the mean true range of ``n`` bars over the close, for each series."""
    df = bars.withColumn("__bw_tr", W.true_range())
    df = df.withColumn("v", W.ratio(W.sma(F.col("__bw_tr"), n), F.col("close")))
    return df.groupBy(W.SERIES).agg(F.median("v").alias("volatility"))


def pick_primary_tf(by_tf: dict[str, DataFrame], stop_pct: float, target: float = 1.0) -> DataFrame:
    """For each series the timeframe whose volatility is nearest to ``stop_pct * target``; of equals the shortest.

    Timeframes without a value are left out; RuntimeError if the map has none of the known timeframes.
    """
    found = None
    for place, tf in enumerate(t for t in TF_CANDIDATES if t in by_tf):
        own = tf_volatility(by_tf[tf]).withColumns({"timeframe": F.lit(tf), "place": F.lit(place)})
        found = own if found is None else found.unionByName(own)
    if found is None:
        raise RuntimeError("no timeframe to choose from")
    off = F.abs(F.col("volatility") - stop_pct * target)
    best = F.min_by(F.struct("timeframe", "volatility"), F.struct(off, "place"))
    return found.where("volatility is not null").groupBy(W.SERIES).agg(best.alias("b")).select(W.SERIES, "b.*")


def build_mtf_features(primary: DataFrame, primary_tf: str, slower: DataFrame | None = None, faster: DataFrame | None = None, cfg: FactorConfig | None = None) -> DataFrame:
    """Primary bars with seventeen factors (``f_...``) and a regime.

    The trend, the slow factors and the regime come from the last slower bar that had closed at the primary bar's open,
    volume and open interest likewise from the faster timeframe; 0 and ``chop`` before the first one. A tier that the
    timeframe does not have, or that is not given, is taken by the primary bars themselves.
    """
    cfg = cfg or FactorConfig()
    fast_tf, slow_tf = TF_TIERS[primary_tf]
    if slower is not None and slow_tf is not None:
        own, other = compute_all_factors(primary, cfg), features(slower, cfg)
        names = ["f_trend", *[f"f_{c}" for c in SLOW.values()], "regime"]
        own = asof_closed(own.drop("f_trend"), other, slow_tf, names, ["f_trend", *[f"f_{n}" for n in SLOW], "regime"])
    else:
        own = features(primary, cfg).withColumns({f"f_{n}": F.col(f"f_{c}") for n, c in SLOW.items()})
    if faster is not None and fast_tf is not None:
        other = compute_all_factors(faster, cfg)
        own = asof_closed(own.drop("f_volume", "f_oi"), other, fast_tf, ["f_volume", "f_oi"])
    own = own.withColumns({f"f_{n}": F.coalesce(f"f_{n}", F.lit(0.0)) for n in FACTORS})
    return own.withColumn("regime", F.coalesce("regime", F.lit("chop")))


def warm_up(primary_tf: str) -> dt.timedelta:
    """How much earlier than its window a build starts to read, so that the slowest means have settled."""
    return dt.timedelta(days=60 if TF_TIERS[primary_tf][1] in (None, "1d") else 30)


def load_mtf_features(load: Callable[[str, dt.datetime, dt.datetime], DataFrame], primary_tf: str, start: dt.datetime, end: dt.datetime, cfg: FactorConfig | None = None, include_oi: bool = True) -> DataFrame:
    """``build_mtf_features`` over [start, end), from ``load(timeframe, start, end)``, a dataset of bars of any number of series.

    The three timeframes are read from ``warm_up`` before ``start``; those bars stay in the result, as the caller may need
    them. Without ``include_oi`` open interest counts as absent. Nothing runs until the result is used.
    """
    fast_tf, slow_tf = TF_TIERS[primary_tf]
    since = start - warm_up(primary_tf)
    read = lambda tf: load(tf, since, end) if include_oi else load(tf, since, end).drop("open_interest")
    return build_mtf_features(read(primary_tf), primary_tf, read(slow_tf) if slow_tf else None, read(fast_tf) if fast_tf else None, cfg)


class FeatureCache:
    """The last few feature frames of a session by key, persisted while they are in; the least recently used goes first."""

    def __init__(self, most: int = 8):
        self.most, self.frames = most, OrderedDict()

    def get(self, key: tuple, build) -> DataFrame:
        if key in self.frames:
            self.frames.move_to_end(key)
            return self.frames[key]
        self.frames[key] = build().persist()
        while len(self.frames) > self.most:
            _, old = self.frames.popitem(last=False)
            old.unpersist()
        return self.frames[key]

    def clear(self) -> None:
        for df in self.frames.values():
            df.unpersist()
        self.frames.clear()


__all__ = ["SINGLE", "FeatureCache", "build_mtf_features", "load_mtf_features", "pick_primary_tf", "tf_volatility", "warm_up"]
