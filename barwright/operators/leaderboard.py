"""Many strategies on the same bars: positions side by side, one grouped backtest, one ranking; and text reports."""

from __future__ import annotations

import json

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barwright.functions import windows as W
from barwright.operators import backtest
from barwright.operators.definitions import SignalDef, parse_signal
from barwright.operators.signals import combine, discretize, min_hold
from barwright.plans.config import BacktestConfig, RiskConfig


def read_signals(spark: SparkSession, path: str) -> tuple[dict[str, SignalDef], dict[str, str]]:
    """The strategies in JSON files, read by Spark: (by file name, errors by file name). A bad file does not stop the others."""
    good, bad = {}, {}
    for row in spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value").collect():
        name = row.file.rsplit("/", 1)[-1]
        try:
            good[name] = parse_signal(json.loads(row.value))
        except ValueError as e:
            bad[name] = str(e)
    return good, bad


def positions(bars: DataFrame, signals: dict[str, SignalDef], cfg: BacktestConfig | None = None, failed: dict[str, str] | None = None) -> DataFrame:
    """Long form: a row for each bar and strategy, with its position.

    A strategy whose expressions cannot be evaluated on these bars stops all, or, where ``failed`` is given, is left out and
    named there with the reason.

    All strategies are columns of one plan over the bars, which are read and sorted once; then the columns are stood on end.
    """
    cfg = cfg or BacktestConfig()
    if not signals:
        raise ValueError("no strategy")
    base = [c for c in (W.SERIES, W.TIME, "close", "high", "low", "funding_rate") if c in bars.columns]
    df, cells = bars, []
    for i, (name, s) in enumerate(signals.items()):
        score, signal = f"__bw_score_{i}", f"__bw_signal_{i}"
        own = BacktestConfig(cfg.symbol, cfg.timeframe, s.long_threshold, s.short_threshold, 0, cfg.costs)
        try:
            scored = combine(df, s.weights, s.score or None, score) if s.score or "regime" in bars.columns else df.withColumn(score, F.lit(0.0))
            df = discretize(scored, own, s.long_when, s.short_when, score, signal)
        except (ValueError, AnalysisException) as e:
            if failed is None:
                raise
            failed[name] = str(e)
            continue
        cells.append(F.struct(F.lit(name).alias("strategy"), F.col(signal).alias("signal")))
    if not cells:
        raise ValueError("no strategy could be evaluated")
    long = df.select(*base, F.explode(F.array(*cells)).alias("__bw_cell")).select(*base, "__bw_cell.strategy", "__bw_cell.signal")
    return min_hold(long, cfg.min_hold_bars, "signal", (W.SERIES, "strategy")) if cfg.min_hold_bars > 0 else long


def leaderboard(bars: DataFrame, signals: dict[str, SignalDef], per_year: float = 8760, cfg: BacktestConfig | None = None, risk: RiskConfig | None = None, failed: dict[str, str] | None = None) -> DataFrame:
    """Metrics of every series and strategy, best Sharpe ratio first, without one last.

    By default all strategies trade with leverage 1 and the default stops and holding time, whatever they state.
    """
    cfg, risk = cfg or BacktestConfig(), risk or RiskConfig(leverage=1.0)
    keys = [W.SERIES, "strategy"]
    rows = positions(bars, signals, cfg, failed)
    done = backtest.run(rows, cfg, risk, keys=keys)
    return backtest.metrics(done, per_year, cfg.costs.per_side, risk.leverage, keys).orderBy(F.desc_nulls_last("sharpe"), *keys)


def percent(x: float | None) -> str:
    return "  n/a" if x is None or x != x else f"{x * 100:7.2f}%"


def number(x: float | None, width: int = 7, places: int = 2) -> str:
    return "n/a".rjust(width) if x is None or x != x else f"{x:{width}.{places}f}"


def window_summary(label: str, m: dict, b: dict, regimes: dict[str, int] | None = None) -> str:
    """A block of text on one backtest and on holding the series."""
    lines = [f"=== {label} ({m['bars']} bars) ==="]
    for name, x in (("strategy total", m), ("buy-and-hold  ", b)):
        lines.append(f"  {name}: {percent(x['total_return'])}    CAGR: {percent(x['cagr'])}    Sharpe: {number(x['sharpe'])}    MaxDD: {percent(x['max_drawdown'])}")
    lines.append(f"  trades: {m['trades']:4d}   win-rate: {percent(m['win_rate'])}   avg trade: {percent(m['avg_trade_return'])}   exposure: {percent(m['exposure'])}")
    lines.append("  exits: " + " ".join(f"{k}={m.get(f'exits_{k}', 0)}" for k in ("tp", "sl", "flip", "flat")))
    lines.append(f"  turnover: {number(m['turnover'], 6, 1)}   total cost: {percent(m['total_cost'])}")
    if regimes is not None:
        lines.append("  regimes: " + " ".join(f"{k}={n}" for k, n in regimes.items()))
    return "\n".join(lines)


def overall_table(metrics: DataFrame) -> DataFrame:
    """Metrics as formatted text columns, for ``show`` or a text sink."""
    pct = lambda c: F.coalesce(F.format_string("%7.2f%%", F.col(c) * 100), F.lit("  n/a")).alias(c)
    shown = [pct(c) if c in ("total_return", "cagr", "max_drawdown", "win_rate", "avg_trade_return", "exposure", "total_cost") else F.coalesce(F.format_string("%7.2f", c), F.lit("    n/a")).alias(c) if c in ("sharpe", "turnover") else F.col(c) for c in metrics.columns]
    return metrics.select(*shown)
