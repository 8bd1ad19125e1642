"""Streaming: events to closed bars, and passes in order whose state carries over between batches.

The states are those of the batch operators, so a stream gives the rows that one pass over all of its bars would give. With
``late`` bars may come out of order between batches (``processors``). Without it, each batch's rows come out at once, and a
series' bars must come in order from batch to batch; in a batch its new bars are sorted first.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from barwright.functions.sequential import Ewm
from barwright.operators import backtest
from barwright.operators.signals import Hold
from barwright.plans.bars import interval
from barwright.plans.config import BacktestConfig, PolicyConfig, RiskConfig
from barwright.streaming.processors import in_order


def stream_bars(events: DataFrame, timeframe: str, price: Column, size: Column, series: Column, late: str = "10 minutes", ts: str = "ts", order: str = "event_id") -> DataFrame:
    """Bars of a stream of priced events; in append mode each comes once, when the watermark says that it has closed."""
    by = F.struct(F.col(ts), F.col(order))
    rows = events.withWatermark(ts, late).groupBy(series.cast("string").alias("series_id"), F.window(ts, interval(timeframe)).alias("w"))
    out = rows.agg(F.min_by(price, by).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, by).alias("close"), F.sum(size).alias("volume"))
    return out.select("series_id", F.col("w.start").alias("ts"), "open", "high", "low", "close", "volume")


def carried(rows: DataFrame, keys: list[str], start: Callable[[], object], schema: str, late: str | None = None, gap: str | None = None) -> DataFrame:
    """The stream's counterpart of ``scan``: the attributes of what ``start()`` makes are the state of a key between batches.

    A key's new rows of one batch are in memory together; the state must stay small. ``late`` and ``gap`` are those of ``in_order``.
    """
    if late is not None:
        return in_order(rows, keys, start, schema, late, gap)
    if gap is not None:
        raise ValueError("sessions need a limit for late bars")
    names = [c.name for c in rows.sparkSession.createDataFrame([], schema).schema]

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = start()
        if state.exists:
            vars(now).update(pickle.loads(state.get[0]))
        yield now(pd.concat(list(frames)).sort_values("ts", kind="stable", ignore_index=True))[names]
        state.update((pickle.dumps(vars(now)),))

    return rows.groupBy(*keys).applyInPandasWithState(step, schema, "state binary", "append", GroupStateTimeout.NoTimeout)


def stream_ewm(bars: DataFrame, column: str, alpha: float, out: str = "ewm", late: str | None = None, gap: str | None = None) -> DataFrame:
    """An exponential mean of a stream of bars; gaps count as rows that passed, as in a batch."""
    rows = bars.select("series_id", "ts", F.col(column).cast("double").alias(column))
    schema = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes) + f", `{out}` double"
    return carried(rows, ["series_id"], lambda: Ewm({out: (column, alpha)}), schema, late, gap)


def stream_min_hold(bars: DataFrame, n: int, column: str = "signal", keys: tuple[str, ...] = ("series_id",), late: str | None = None, gap: str | None = None) -> DataFrame:
    """Positions of a stream of bars, kept for ``n`` bars at least."""
    rows = bars.withColumn(column, F.col(column).cast("int"))
    return carried(rows, list(keys), lambda: Hold(n, column), ", ".join(f"`{c}` {t}" for c, t in rows.dtypes), late, gap)


def stream_backtest(bars: DataFrame, cfg: BacktestConfig | None = None, risk: RiskConfig | None = None, policy: PolicyConfig | None = None, keys: tuple[str, ...] = ("series_id",), signal: str = "signal", late: str | None = None, gap: str | None = None) -> DataFrame:
    """Per-bar results of a stream of bars and signals, with the columns of ``backtest.run``."""
    cfg, risk, policy = cfg or BacktestConfig(), risk or RiskConfig(), policy or PolicyConfig()
    rows, start, schema = backtest.machine(bars, risk, cfg.costs.per_side, cfg.min_hold_bars, policy, list(keys), signal)
    return carried(rows, list(keys), start, schema, late, gap)
