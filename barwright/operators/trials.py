"""All trials of a search along one pass over the bars.

The scores of a stretch of bars under all trials are a matrix product a regime; positions, costs and equity are arrays of
(trials, bars), or, where stops and holding times make a bar depend on the one before, vectors over the trials from bar to bar. What is
shuffled is the bars, whatever the number of trials; what leaves a task is a row for each trial.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barwright.functions import windows as W
from barwright.functions.sequential import _runs
from barwright.operators import backtest
from barwright.plans.bars import validate_bars
from barwright.plans.config import KNOB_BOUNDS, BacktestConfig, RiskConfig

#: The factors that trials weigh, and the knob and share of each.
WEIGHED = {"rsi": ("rsi", 1.0), "ema_cross": ("trend", 3.0), "macd": ("trend", 3.0), "trend": ("trend", 3.0), "volume": ("flow", 2.0), "oi": ("flow", 2.0), "funding": ("funding", 1.0)}
#: Prefixes of the knobs of each regime.
REGIME_KNOBS = {"trend_up": "up", "trend_down": "dn", "chop": "cp"}
#: Bars that are worked on at a time.
STRETCH = 2048
KNOBS = "struct<" + ",".join(f"{k}:double" for k in KNOB_BOUNDS) + ">"
_COUNTS = ("bars", "trades", "exits_sl", "exits_tp", "exits_flip", "exits_flat")
_SUMS = ("last", "mean", "deviation", "max_drawdown", "wins", "returns", "turnover", "exposed", "total_cost")
_BARS = ("close", "high", "low", "funding_rate")


class Ledger:
    """What is known of all trials of one key after the bars so far."""

    def __init__(self, knobs: list[dict[str, float]], cfg: BacktestConfig, risk: RiskConfig):
        n = len(knobs)
        self.knobs, self.lev, self.fee = knobs, float(risk.leverage), cfg.costs.per_side * risk.leverage
        self.tp, self.sl, self.hold = risk.take_profit_pct, risk.stop_loss_pct, max(cfg.min_hold_bars, 0)
        column = lambda name: np.array([k[name] for k in knobs], float)
        self.weights = {r: np.stack([column(f"{p}_{knob}") / share for knob, share in WEIGHED.values()]) for r, p in REGIME_KNOBS.items()}
        self.long, self.short = column("long_thr")[:, None], column("short_thr")[:, None]
        self.count = {c: np.zeros(n, np.int64) for c in _COUNTS[1:]}
        self.total = {c: np.zeros(n) for c in ("mean", "squares", "max_drawdown", "wins", "returns", "turnover", "exposed", "total_cost")}
        self.bars, self.close = 0, np.nan
        self.equity, self.peak, self.grown = np.ones(n), np.zeros(n), np.ones(n)
        self.side, self.was, self.since = np.zeros(n), np.zeros(n), np.zeros(n, bool)
        # of the machine with stops: entry price, bars held, the position that the holding time lets through, and for how long
        self.entry, self.held, self.wish, self.kept = np.zeros(n), np.zeros(n, np.int64), np.zeros(n), np.zeros(n, np.int64)

    def wanted(self, factors: np.ndarray, regime: list[str | None]) -> np.ndarray:
        """Positions (trials, bars) that the scores ask for."""
        score = np.zeros((len(self.long), len(regime)))
        names = np.array([r or "" for r in regime])
        for r, w in self.weights.items():
            at = np.flatnonzero(names == r)
            if len(at):
                score[:, at] = w.T @ factors[at].T
        score = np.clip(score, -1, 1)
        return np.where(score <= self.short, -1.0, np.where(score >= self.long, 1.0, 0.0))

    def add(self, bars: dict[str, np.ndarray], wanted: np.ndarray) -> None:
        """The next bars, of at most ``STRETCH`` or so."""
        if self.tp is None and self.sl is None and self.hold == 0:
            side, ret, cost, paid, ended, kind = self._free(bars, wanted)
        else:
            side, ret, cost, paid, ended, kind = self._bound(bars, wanted)
        self._book(side, ret, cost, paid, ended, kind)
        self.close = bars["close"][-1]

    def _free(self, bars: dict[str, np.ndarray], wanted: np.ndarray) -> tuple:
        """Without stops and holding times a bar's position is what the bar before asked for."""
        close = bars["close"]
        before = np.concatenate([[self.close], close[:-1]])
        known = np.isfinite(before) & np.isfinite(close) & (before != 0)
        step = np.where(known, (close - before) / np.where(known, before, 1.0), 0.0)
        side = np.concatenate([self.wish[:, None], wanted[:, :-1]], axis=1)
        self.wish = wanted[:, -1].copy()
        changed = wanted != side
        ended = changed & (side != 0)
        cost = self.fee * (ended.astype(float) + (changed & (wanted != 0)))
        return side, step * side * self.lev, cost, side * self.lev * bars["funding_rate"] / 8.0, ended, np.where(wanted != 0, 2, 3)

    def _bound(self, bars: dict[str, np.ndarray], wanted: np.ndarray) -> tuple:
        """Stops and holding times: bar by bar, all trials at once."""
        sides, rets, costs, paids, ends, kinds = (np.zeros_like(wanted) for _ in range(6))
        side, entry, held, wish, kept = self.side, self.entry, self.held, self.wish, self.kept
        before = self.close if self.bars else bars["close"][0]
        for i in range(wanted.shape[1]):
            close, high, low, funding = (bars[c][i] for c in _BARS)
            if self.hold:
                turn = (wanted[:, i] != wish) & ((wish == 0) | (kept >= self.hold))
                wish, kept = np.where(turn, wanted[:, i], wish), np.where(turn, 1, kept + 1)
            else:
                wish = wanted[:, i]
            inside, price = side != 0, np.full(len(side), close)
            stopped, aimed = np.zeros(len(side), bool), np.zeros(len(side), bool)
            if self.sl is not None:
                at = entry * (1 - side * self.sl)
                stopped = inside & np.where(side > 0, low <= at, high >= at)
                price = np.where(stopped, at, price)
            if self.tp is not None:
                at = entry * (1 + side * self.tp)
                aimed = inside & ~stopped & np.where(side > 0, high >= at, low <= at)
                price = np.where(aimed, at, price)
            hit = stopped | aimed
            ret = (price - before) / before * side * self.lev if before else np.zeros(len(side))
            rets[:, i] = np.where(inside, ret, 0.0)
            paids[:, i] = side * self.lev * funding / 8.0 * np.where(hit, 0.5, 1.0)
            held = held + (inside & ~hit)
            left = inside & ~hit & (wish != side) & (held >= self.hold)
            sides[:, i], ends[:, i] = side, hit | left
            kinds[:, i] = np.where(stopped, 0, np.where(aimed, 1, np.where(wish != 0, 2, 3)))
            gone = hit | left
            side, held = np.where(gone, 0.0, side), np.where(gone, 0, held)
            enter = ~hit & (side == 0) & (wish != 0)
            costs[:, i] = self.fee * (gone.astype(float) + enter)
            entry, side = np.where(enter, close, entry), np.where(enter, wish, side)
            before = close
        self.side, self.entry, self.held, self.wish, self.kept = side, entry, held, wish, kept
        return sides, rets, costs, paids, ends.astype(bool), kinds

    def _book(self, side: np.ndarray, ret: np.ndarray, cost: np.ndarray, paid: np.ndarray, ended: np.ndarray, kind: np.ndarray) -> None:
        n = side.shape[1]
        net = np.maximum(ret - cost - paid, -1.0)
        # moments of two sets joined, without the loss of a sum of squares
        mean, total = net.mean(axis=1), self.total
        squares, off = ((net - mean[:, None]) ** 2).sum(axis=1), mean - total["mean"]
        total["squares"] += squares + off**2 * self.bars * n / (self.bars + n)
        total["mean"] += off * n / (self.bars + n)
        equity = np.maximum(self.equity[:, None] * np.cumprod(1.0 + net, axis=1), 0.0)
        peak = np.maximum(np.maximum.accumulate(equity, axis=1), self.peak[:, None])
        fall = np.where(peak > 0, equity / np.where(peak > 0, peak, 1.0) - 1.0, 0.0)
        total["max_drawdown"] = np.minimum(total["max_drawdown"], fall.min(axis=1))
        self.equity, self.peak = equity[:, -1].copy(), peak[:, -1].copy()
        was = np.concatenate([self.was[:, None] if self.bars else side[:, :1], side[:, :-1]], axis=1)
        total["turnover"] += np.abs(side - was).sum(axis=1) * self.lev
        total["exposed"] += (side != 0).sum(axis=1)
        total["total_cost"] += (cost + paid).sum(axis=1)
        self._trades(side, 1.0 + ret - paid, ended)
        for code, name in enumerate(("exits_sl", "exits_tp", "exits_flip", "exits_flat")):
            self.count[name] += (ended & (kind == code)).sum(axis=1)
        self.was, self.bars = side[:, -1].copy(), self.bars + n

    def _trades(self, side: np.ndarray, growth: np.ndarray, ended: np.ndarray) -> None:
        """Trades run over the bars with a position up to the one that ends them; an open one goes on in the next bars."""
        growth = np.where(side != 0, growth, 1.0)
        first = np.zeros(side.shape, bool)
        first[:, 0] = True
        first[:, 1:] = ended[:, :-1]
        starts = np.flatnonzero(first.ravel())
        product = np.multiply.reduceat(growth.ravel(), starts)
        row = starts // side.shape[1]
        lead = np.searchsorted(starts, np.arange(len(side)) * side.shape[1])
        product[lead] *= self.grown
        stop = np.append(starts[1:], side.size) - 1
        over = ended.ravel()[stop]
        result = (1 - self.fee) ** 2 * product[over] - 1
        self.count["trades"] += np.bincount(row[over], minlength=len(side))
        self.total["wins"] += np.bincount(row[over], result > 0, minlength=len(side))
        self.total["returns"] += np.bincount(row[over], result, minlength=len(side))
        tail = np.append(lead[1:], len(starts)) - 1
        still = ~over[tail]
        self.grown = np.where(still, product[tail], 1.0)
        self.since = still & (side[:, -1] != 0)

    def rows(self) -> dict[str, np.ndarray]:
        """A row for each trial; a trade that is still open counts, without the fee of its end."""
        open_ = (1 - self.fee) * self.grown - 1
        count = self.count | {"trades": self.count["trades"] + self.since, "bars": np.full(len(self.equity), self.bars)}
        total = self.total | {"last": self.equity, "wins": self.total["wins"] + (self.since & (open_ > 0)), "returns": self.total["returns"] + np.where(self.since, open_, 0.0)}
        total["deviation"] = np.sqrt(total["squares"] / (self.bars - 1)) if self.bars > 1 else np.full(len(self.equity), np.nan)
        return {c: count[c] for c in _COUNTS} | {c: total[c] for c in _SUMS}


def searched(df: DataFrame, keys: list[str], draws: Callable[[tuple], list[dict[str, float]]], cfg: BacktestConfig, risk: RiskConfig, per_year: float) -> DataFrame:
    """Metrics of all trials of each key, (keys, trial, knobs, metrics), for rows (keys, ts, bars, factors, regime).

    ``draws`` (values of the keys) gives a key's trials. The bars are sorted once; a task carries a few vectors a key.
    """
    kinds = dict(df.dtypes)
    factors = [F.coalesce(F.col(f"f_{f}").cast("double"), F.lit(0.0)) if f"f_{f}" in df.columns else F.lit(0.0) for f in WEIGHED]
    funding = F.coalesce(F.col("funding_rate").cast("double"), F.lit(0.0)) if "funding_rate" in df.columns else F.lit(0.0)
    rows = validate_bars(df).select(*keys, W.TIME, *[F.col(c).cast("double").alias(c) for c in _BARS[:3]], funding.alias("funding_rate"), F.array(*factors).alias("factors"), F.col("regime").cast("string").alias("regime"))
    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + f", trial int, knobs {KNOBS}, " + ", ".join(f"{c} long" for c in _COUNTS) + ", " + ", ".join(f"`{c}` double" for c in _SUMS)
    own_types = rows.select(*keys).limit(0).toArrow().schema

    def emit(now: tuple, book: Ledger) -> pa.RecordBatch:
        n, found = len(book.knobs), book.rows()
        columns = [pa.array([v] * n, t) for v, t in zip(now, own_types.types, strict=True)]
        knobs = pa.StructArray.from_arrays([pa.array([k[name] for k in book.knobs], pa.float64()) for name in KNOB_BOUNDS], list(KNOB_BOUNDS))
        return pa.RecordBatch.from_arrays([*columns, pa.array(np.arange(n, dtype=np.int32)), knobs, *[pa.array(x) for x in found.values()]], [*keys, "trial", "knobs", *found])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, book = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            at = _runs(batch, keys)
            for a, b in zip(at, at[1:], strict=False):
                own = tuple(batch.column(k)[a].as_py() for k in keys)
                if book is None or own != now:
                    if book is not None:
                        yield emit(now, book)
                    now, book = own, Ledger(draws(own), cfg, risk)
                for i in range(a, b, STRETCH):
                    part = batch.slice(i, min(STRETCH, b - i))
                    bars = {c: part.column(c).to_numpy(zero_copy_only=False).astype(float) for c in _BARS}
                    values = part.column("factors").flatten().to_numpy(zero_copy_only=False).reshape(-1, len(WEIGHED))
                    book.add(bars, book.wanted(values, part.column("regime").to_pylist()))
        if book is not None:
            yield emit(now, book)

    found = rows.repartition(*keys).sortWithinPartitions(*keys, W.TIME).mapInArrow(run, schema)
    some = F.col("trades") > 0
    sd = F.col("deviation") * per_year**0.5
    return found.select(
        *keys, "trial", "knobs", "bars", (F.col("last") - 1).alias("total_return"), backtest._cagr(F.col("last"), F.col("bars"), per_year).alias("cagr"),
        F.when(sd > 0, F.when(~F.isnan(sd), F.col("mean") * per_year / F.nullif(sd, F.lit(0.0)))).alias("sharpe"), "max_drawdown", "trades", F.when(some, F.col("wins") / F.col("trades")).alias("win_rate"),
        F.when(some, F.col("returns") / F.col("trades")).alias("avg_trade_return"), "turnover", (F.col("exposed") / F.col("bars")).alias("exposure"), "total_cost", *_COUNTS[2:],
    )
