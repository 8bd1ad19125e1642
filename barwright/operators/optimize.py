"""Random search and walk-forward tests: trials and folds are rows, so the cluster works on all of them at once."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barwright.functions import windows as W
from barwright.operators import backtest
from barwright.operators.signals import min_hold
from barwright.operators.trials import REGIME_KNOBS, searched
from barwright.plans.config import KNOB_BOUNDS, BacktestConfig, RiskConfig
from barwright.plans.shared import stage

def sample_knobs(n: int, seed: int) -> list[dict[str, float]]:
    """n draws, uniform within the bounds, knob by knob in their fixed order from one generator."""
    rng = np.random.default_rng(seed)
    return [{k: float(rng.uniform(lo, hi)) for k, (lo, hi) in KNOB_BOUNDS.items()} for _ in range(n)]


def knobs_to_weights(knobs: dict[str, float]) -> dict[str, dict[str, float]]:
    """The weight matrix of a draw: the trend weight in three equal parts, the flow weight in two."""
    out = {}
    for regime, p in REGIME_KNOBS.items():
        trend, flow = knobs[f"{p}_trend"] / 3.0, knobs[f"{p}_flow"] / 2.0
        out[regime] = {"rsi": knobs[f"{p}_rsi"], "ema_cross": trend, "macd": trend, "trend": trend, "volume": flow, "oi": flow, "funding": knobs[f"{p}_funding"]}
    return out


def _score_of(knob: str, regime: Column) -> Column:
    """The weighted score with weights from the struct column ``knob``."""
    term = lambda f, w: F.coalesce(F.col(f"f_{f}") * w, F.lit(0.0))
    out = F.lit(0.0)
    for name, p in REGIME_KNOBS.items():
        k = lambda x, p=p: F.col(f"{knob}.{p}_{x}")
        total = term("rsi", k("rsi")) + term("funding", k("funding"))
        for f in ("ema_cross", "macd", "trend"):
            total = total + term(f, k("trend") / 3.0)
        for f in ("volume", "oi"):
            total = total + term(f, k("flow") / 2.0)
        out = F.when(regime == name, total).otherwise(out)
    return W.clip(out, -1, 1)


def trial_score(sharpe: Column, trades: Column, fewest: int = 5) -> Column:
    """Sharpe ratio, less for under 30 trades; NULL for too few trades or no ratio."""
    return F.when((trades >= fewest) & sharpe.isNotNull(), sharpe * F.sqrt(F.least(trades, F.lit(30)) / 30.0))


def _trial_metrics(df: DataFrame, keys: list[str], cfg: BacktestConfig, risk: RiskConfig, per_year: float) -> tuple[DataFrame, DataFrame]:
    """Per-bar results and metrics for rows (keys, ts, bars, factors, regime, knobs)."""
    score = _score_of("knobs", F.col("regime"))
    signal = F.when(score <= F.col("knobs.short_thr"), -1).when(score >= F.col("knobs.long_thr"), 1).otherwise(0)
    needed = [*keys, W.TIME, "close", "high", "low", *(["funding_rate"] if "funding_rate" in df.columns else [])]
    rows = df.select(*needed, signal.cast("int").alias("signal"))
    if cfg.min_hold_bars > 0:
        rows = min_hold(rows, cfg.min_hold_bars, "signal", tuple(keys))
    bars = backtest.run(rows, cfg, risk, keys=keys)
    return bars, backtest.metrics(bars, per_year, cfg.costs.per_side, risk.leverage, keys)


def random_search(df: DataFrame, cfg: BacktestConfig | None = None, risk: RiskConfig | None = None, per_year: float = 8760, n_trials: int = 300, seed: int = 0) -> DataFrame:
    """One row a series and trial: its score (NULL: not viable), metrics and knobs. Rows of ``df``: bars, factors, regime.

    One shuffle of the bars, whatever the number of trials.
    """
    found = searched(df, [W.SERIES], lambda key: sample_knobs(n_trials, seed), cfg or BacktestConfig(), risk or RiskConfig(), per_year)
    return found.withColumn("score", trial_score(F.col("sharpe"), F.col("trades")))


def best_trials(trials: DataFrame, keys: list[str]) -> DataFrame:
    """The viable trial with the highest score of each key, the first of equals."""
    return trials.where("score is not null").groupBy(*keys).agg(F.max_by(F.struct("trial", "score", "knobs"), F.struct("score", -F.col("trial"))).alias("best")).select(*keys, "best.*")


def fold_bounds(n: int, train: int, test: int, step: int) -> int:
    """How many folds n bars hold."""
    return max(0, math.floor((n - train - test) / step) + 1) if n >= train + test else 0


def walk_forward(df: DataFrame, train: int, test: int, step: int, cfg: BacktestConfig | None = None, risk: RiskConfig | None = None, per_year: float = 8760, n_trials: int = 300, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """Fit on ``train`` bars, test on the next ``test``, move on by ``step``: (folds, per-bar results of the tests).

    Fold i draws its trials with seed + i. A series without a viable trial in a fold has no row for it. All folds and
    trials of all series are one plan, in which a bar travels once for each fold that trains on it. The features, and each
    fold's best trial, are written once, since several parts read them.
    """
    cfg, risk = cfg or BacktestConfig(), risk or RiskConfig()
    df = stage(df, "features")
    numbered = df.withColumn("rn", F.row_number().over(W.line()) - 1).withColumn("n", F.count("*").over(Window.partitionBy(W.SERIES)))
    # the folds that a bar is in follow from its number
    first = F.greatest(F.lit(0), F.ceil((F.col("rn") - (train + test - 1)) / step)).cast("int")
    last = F.least(F.floor(F.col("rn") / step), F.floor((F.col("n") - (train + test)) / step)).cast("int")
    own = numbered.withColumns({"first": first, "last": last}).where("first <= last").withColumn("fold", F.explode(F.sequence("first", "last"))).drop("first", "last")
    own = own.withColumn("in_train", F.col("rn") < F.col("fold") * step + train)
    scored = searched(own.where("in_train"), [W.SERIES, "fold"], lambda key: sample_knobs(n_trials, seed + key[1]), cfg, risk, per_year)
    scored = scored.withColumn("score", trial_score(F.col("sharpe"), F.col("trades")))
    best = stage(best_trials(scored, [W.SERIES, "fold"]), "best")
    keys = [W.SERIES, "fold"]
    tests, found = _trial_metrics(own.where("not in_train").join(best.select(*keys, "knobs"), keys), keys, cfg, risk, per_year)
    span = own.groupBy(*keys).agg(*[f(F.when(F.col("in_train") == flag, F.col(W.TIME))).alias(name) for f, flag, name in ((F.min, True, "train_start"), (F.max, True, "train_end"), (F.min, False, "test_start"), (F.max, False, "test_end"))])
    folds = span.join(best.withColumnRenamed("score", "train_score").withColumnRenamed("knobs", "best_knobs"), keys).join(found, keys)
    return folds, tests


def aggregate_oos(tests: DataFrame, per_year: float) -> DataFrame:
    """Tests put end to end: each fold's returns from its equity, the first fold's of a bar kept, compounded; a row a series."""
    fold = Window.partitionBy(W.SERIES, "fold").orderBy(W.TIME)
    r = W.ratio(F.col("equity"), F.coalesce(F.lag("equity").over(fold), F.lit(1.0))) - 1
    rows = tests.withColumn("r", F.coalesce(r, F.lit(0.0)))
    w = Window.partitionBy(W.SERIES, W.TIME).orderBy("fold")
    rows = rows.withColumn("__bw_rn", F.row_number().over(w))
    folds = tests.groupBy(W.SERIES).agg(F.count_distinct("fold").alias("folds"))
    kept = rows.where("__bw_rn = 1").select(W.SERIES, W.TIME, "r")
    kept = kept.withColumn("equity", F.product(1.0 + F.col("r")).over(W.so_far()))
    last, n = F.max_by("equity", W.TIME), F.count("*")
    out = backtest.drawdowns(kept, [W.SERIES]).groupBy(W.SERIES).agg(n.alias("bars"), (last - 1).alias("total_return"), backtest._cagr(last, n, per_year).alias("cagr"), backtest._sharpe("r", per_year).alias("sharpe"), F.min("__bw_dd").alias("max_drawdown"))
    return out.join(folds, W.SERIES).select(W.SERIES, "bars", "folds", "total_return", "cagr", "sharpe", "max_drawdown")


__all__ = ["aggregate_oos", "best_trials", "fold_bounds", "knobs_to_weights", "random_search", "sample_knobs", "trial_score", "walk_forward"]
