"""Backtests: positions and bars to per-bar results, trades and metrics, for any number of series and strategies.

Two ways give the same rows. Without stops, minimum holding time and policies the position of a bar is the signal of the
bar before, and everything is windows (``fast``). Otherwise a small state goes through each series' bars in order
(``stateful``), in bounded memory. Trades and metrics are aggregates over either's rows.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barwright.functions import windows as W
from barwright.functions.sequential import scan
from barwright.plans import blocks
from barwright.plans.bars import validate_bars
from barwright.plans.chains import chained
from barwright.plans.config import BacktestConfig, PolicyConfig, RiskConfig

DAY_MS = 86_400_000
#: Bars without a change after which the next one is looked for rather than gone to bar by bar.
QUIET = 24
#: Bars that are gone to one by one before their results are put in columns.
MOST = 4096
RESULT = "position double, bar_ret double, trade_cost double, funding_cost double, net_ret double, equity double, exit string, trade long, side int"


def policy_mask(policy: PolicyConfig, ts: str = W.TIME) -> Column:
    """True where a policy bars entries: hours of the day, and minutes around news, both ends included."""
    blocked = F.lit(False)
    if policy.skip_hours_utc:
        blocked = blocked | F.hour(ts).isin(*[int(h) for h in policy.skip_hours_utc])
    if policy.news_timestamps_ms:
        at, most = epoch_ms(ts), max(1, int(policy.news_skip_minutes)) * 60_000
        near = F.exists(F.array(*[F.lit(int(t)) for t in policy.news_timestamps_ms]), lambda t: F.abs(at - t) <= most)
        blocked = blocked | near
    return F.coalesce(blocked, F.lit(False))


def epoch_ms(ts: str = W.TIME) -> Column:
    """Milliseconds since 1970. A timestamp without a zone is read as UTC; one with a zone is seen in the session's, which should be UTC."""
    return F.expr(f"timestampdiff(MILLISECOND, timestamp_ntz'1970-01-01 00:00:00', cast(`{ts}` as timestamp_ntz))")


def _prepared(df: DataFrame, signal: str) -> DataFrame:
    df = validate_bars(df)
    funding = F.coalesce(F.col("funding_rate").cast("double"), F.lit(0.0)) if "funding_rate" in df.columns else F.lit(0.0)
    return df.withColumns({"__bw_funding": funding, "__bw_signal": F.coalesce(F.col(signal).cast("int"), F.lit(0))})


def fast(df: DataFrame, leverage: float, cost: float, keys: list[str], signal: str = "signal") -> DataFrame:
    """Windows only: no stops, no holding time, no policy."""
    laid = blocks.is_laid_out(df) and keys == [W.SERIES]
    base = blocks.halo(_prepared(df, signal), 1) if laid else _prepared(df, signal)
    placed = [c for c in (blocks.PLACE, blocks.BLOCK) if c in df.columns]
    w = Window.partitionBy(*keys, *([blocks.BLOCK] if laid else [])).orderBy(W.TIME)
    was = F.coalesce(F.lag("__bw_signal").over(w), F.lit(0))
    base = base.withColumns({"__bw_was": was, "__bw_before": F.lag("close").over(w)})
    base = base.withColumn("__bw_flip", (F.col("__bw_signal") != F.col("__bw_was")).cast("int"))
    side, now, changed = F.col("__bw_was"), F.col("__bw_signal"), F.col("__bw_flip") == 1
    step = F.coalesce(W.ratio(F.col("close") - F.col("__bw_before"), F.col("__bw_before")), F.lit(0.0))
    c = cost * leverage
    base = base.withColumns({
        "position": side * F.lit(float(leverage)),
        "bar_ret": step * side * leverage,
        "trade_cost": F.when(changed & (side != 0), c).otherwise(0.0) + F.when(changed & (now != 0), c).otherwise(0.0),
        "funding_cost": side * leverage * F.col("__bw_funding") / 8.0,
        "exit": F.when(changed & (side != 0), F.when(now != 0, "flip").otherwise("flat")).otherwise(""),
        "side": side,
    })
    if laid:
        base = blocks.running_sum(blocks.own(base), "__bw_flip").withColumn("trade", F.col("__bw_value") - F.col("__bw_flip")).drop("__bw_value")
    else:
        base = base.withColumn("trade", F.sum("__bw_flip").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    base = base.withColumn("net_ret", F.greatest(F.col("bar_ret") - F.col("trade_cost") - F.col("funding_cost"), F.lit(-1.0)))
    if laid:
        base = blocks.running(base.withColumn("__bw_grown", 1.0 + F.col("net_ret")), "__bw_grown", "product").withColumnRenamed("__bw_value", "equity")
    else:
        base = base.withColumn("equity", F.greatest(F.product(1.0 + F.col("net_ret")).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0.0)))
    base = base.withColumn("trade", F.when(side != 0, F.col("trade")).cast("long"))
    return base.select(*keys, W.TIME, *placed, "close", "position", "bar_ret", "trade_cost", "funding_cost", "net_ret", "equity", "exit", "trade", F.col("side").cast("int").alias("side"))


class Bars(NamedTuple):
    close: np.ndarray
    high: np.ndarray
    low: np.ndarray
    funding: np.ndarray
    wanted: np.ndarray
    barred: np.ndarray
    ms: np.ndarray


class Book:
    """The state of one series and strategy between bars."""

    KEPT = ("close", "side", "entry", "held", "pnl", "trade", "equity", "day", "losses", "latched", "entries", "ms")

    def __init__(self, risk: RiskConfig, cost: float, min_hold: int, policy: PolicyConfig):
        self.lev, self.tp, self.sl = float(risk.leverage), risk.take_profit_pct, risk.stop_loss_pct
        self.fee, self.min_hold = cost * self.lev, min_hold
        self.most_trades, self.most_losses = policy.max_trades_per_24h, policy.max_consecutive_losses
        self.close: float | None = None
        self.side, self.entry, self.held, self.pnl, self.trade = 0, 0.0, 0, 0.0, 0
        self.equity, self.day, self.losses, self.latched = 1.0, None, 0, False
        self.entries: deque[int] = deque()
        self.ms: int | None = None

    def hand_over(self) -> tuple:
        """What later bars depend on, but for the equity and the number of the last trade."""
        recent = tuple(t for t in self.entries if self.ms is None or t >= self.ms - DAY_MS)
        day = (self.day, self.latched, self.losses) if self.most_losses else None
        if not self.side:
            return self.close, 0, 0.0, 0, 0.0, day, recent, self.ms
        return self.close, self.side, self.entry, min(self.held, max(self.min_hold, 0)), self.pnl if self.most_losses else 0.0, day, recent, self.ms

    def totals(self) -> list[float]:
        """Trades begun, and growth, since this state was made."""
        return [float(self.trade), self.equity]

    def take_over(self, state: tuple) -> None:
        self.close, self.side, self.entry, self.held, self.pnl, day, recent, self.ms = state
        if day is not None:
            self.day, self.latched, self.losses = day
        self.entries = deque(recent)

    def _stopped(self, high: float, low: float) -> tuple[float, str] | None:
        """The price and kind of a stop or target that the bar reaches; a stop comes before a target."""
        if self.sl is not None:
            price = self.entry * (1 - self.side * self.sl)
            if (low <= price) if self.side > 0 else (high >= price):
                return price, "sl"
        if self.tp is not None:
            price = self.entry * (1 + self.side * self.tp)
            if (high >= price) if self.side > 0 else (low <= price):
                return price, "tp"
        return None

    def _ended(self) -> None:
        """Book the position's end; losses in a row stop entries until the next day."""
        if self.most_losses:
            self.losses = self.losses + 1 if self.pnl < 0 else 0
            self.latched = self.latched or self.losses >= self.most_losses
        self.side, self.entry, self.held, self.pnl = 0, 0.0, 0, 0.0

    def _may_enter(self, barred: bool, ms: int) -> bool:
        if barred or (self.most_losses and self.latched):
            return False
        if self.most_trades:
            while self.entries and self.entries[0] < ms - DAY_MS:
                self.entries.popleft()
            return len(self.entries) < self.most_trades
        return True

    def bar(self, close: float, high: float, low: float, funding: float, wanted: int, barred: bool, ms: int) -> tuple:
        before = self.close if self.close is not None else close
        self.close, self.ms = close, ms
        if self.most_losses and ms // DAY_MS != self.day:
            self.day, self.latched, self.losses = ms // DAY_MS, False, 0
        side, trade = self.side, self.trade
        ret = cost = paid = 0.0
        kind, stop = "", None
        if side:
            stop = self._stopped(high, low)
            price, share = (stop[0], 0.5) if stop else (close, 1.0)
            ret = (price - before) / before * side * self.lev if before else 0.0
            paid = side * self.lev * funding / 8.0 * share
            self.pnl += ret
            self.held += not stop
        if stop:
            kind, cost = stop[1], self.fee
            self._ended()
        else:
            if self.side and wanted != self.side and self.held >= self.min_hold:
                kind, cost = ("flip" if wanted else "flat"), self.fee
                self._ended()
            if not self.side and wanted and self._may_enter(barred, ms):
                cost += self.fee
                self.side, self.entry = wanted, close
                self.trade += 1
                if self.most_trades:
                    self.entries.append(ms)
        net = max(ret - cost - paid, -1.0)
        self.equity = max(self.equity * (1.0 + net), 0.0)
        return side * self.lev, ret, cost, paid, net, self.equity, kind, (trade if side else None), side

    def _next_event(self, at: int, bars: Bars) -> int:
        """The first bar from ``at`` on that may change the side; it is looked for in stretches that grow."""
        n, size = len(bars.close), 64
        free = at + self.min_hold - self.held - 1  # the first bar that a wish may end
        levels = []
        if self.side and self.sl is not None:
            levels.append((self.side > 0, self.entry * (1 - self.side * self.sl)))
        if self.side and self.tp is not None:
            levels.append((self.side < 0, self.entry * (1 + self.side * self.tp)))
        while at < n:
            part = slice(at, min(at + size, n))
            if self.side:
                found = (bars.wanted[part] != self.side) & (np.arange(part.start, part.stop) >= free)
                for from_above, price in levels:
                    found |= bars.low[part] <= price if from_above else bars.high[part] >= price
            else:
                found = (bars.wanted[part] != 0) & ~bars.barred[part]
            hits = np.flatnonzero(found)
            if len(hits):
                return at + int(hits[0])
            at, size = part.stop, 2 * size
        return n

    def _pass_over(self, a: int, b: int, bars: Bars, out: dict[str, np.ndarray]) -> None:
        """Bars in which the side stays: what ``bar`` does, in the same order of operations."""
        own = slice(a, b)
        if self.most_losses:
            days = bars.ms[own] // DAY_MS
            if (days != self.day).any():
                self.latched, self.losses = False, 0
            self.day = int(days[-1])
        if self.side:
            close = bars.close[own]
            before = np.concatenate([[self.close], close[:-1]])
            with np.errstate(all="ignore"):
                ret = np.where(before != 0, (close - before) / before * self.side * self.lev, 0.0)
                paid = self.side * self.lev * bars.funding[own] / 8.0
                net = np.maximum(ret - paid, -1.0)
                equity = np.multiply.accumulate(np.concatenate([[self.equity], 1.0 + net]))[1:]
            self.pnl = float(np.add.accumulate(np.concatenate([[self.pnl], ret]))[-1])
            self.held += b - a
            self.equity = float(equity[-1])
            for name, x in (("position", self.side * self.lev), ("bar_ret", ret), ("funding_cost", paid), ("net_ret", net), ("equity", equity), ("trade", self.trade), ("side", self.side)):
                out[name][own] = x
        else:
            out["equity"][own] = self.equity
        self.close, self.ms = float(bars.close[b - 1]), int(bars.ms[b - 1])

    def __call__(self, frame: pd.DataFrame) -> pd.DataFrame:
        """Bar by bar where the side changes often; after a while without a change, on to the next bar that may bring one."""
        bars = Bars(*[frame[c].to_numpy().astype(t) for c, t in (("close", float), ("high", float), ("low", float), ("__bw_funding", float), ("__bw_signal", int), ("__bw_barred", bool), ("__bw_ms", int))])
        rows = list(zip(*[x.tolist() for x in bars], strict=True))
        names, n = [x.split()[0] for x in RESULT.split(", ")], len(rows)
        out = {name: np.zeros(n) for name in names} | {"exit": np.full(n, "", object), "side": np.zeros(n, np.int64), "trade": np.full(n, -1, np.int64)}
        at = 0
        while at < n:
            start, quiet, done = at, 0, []
            for row in rows[at : at + MOST]:
                side = self.side
                done.append(self.bar(*row))
                quiet = quiet + 1 if self.side == side and not done[-1][6] else 0
                if quiet >= QUIET:
                    break
            at += len(done)
            for name, column in zip(names, zip(*done, strict=True), strict=True):
                out[name][start:at] = [-1 if x is None else x for x in column] if name == "trade" else column
            if quiet >= QUIET and (end := self._next_event(at, bars)) > at:
                self._pass_over(at, end, bars, out)
                at = end
        made = pd.DataFrame(out, index=frame.index)
        made["trade"] = made["trade"].astype("Int64").mask(made["trade"] < 0)
        return pd.concat([frame.drop(columns=[c for c in names if c in frame]), made], axis=1)


def machine(df: DataFrame, risk: RiskConfig, cost: float, min_hold: int, policy: PolicyConfig, keys: list[str], signal: str = "signal") -> tuple[DataFrame, Callable[[], Book], str]:
    """What a pass in order needs: its rows, what makes the state of a new key, the schema of the results."""
    base = _prepared(df, signal).withColumns({"__bw_barred": policy_mask(policy), "__bw_ms": F.coalesce(epoch_ms(), F.lit(0))})
    placed = [c for c in (blocks.PLACE, blocks.BLOCK) if c in df.columns]
    needed = [*keys, W.TIME, *placed, "close", "high", "low", "__bw_funding", "__bw_signal", "__bw_barred", "__bw_ms"]
    base = base.select(*needed).withColumns({c: F.col(c).cast("double") for c in ("close", "high", "low")})
    kinds = dict(base.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in [*keys, W.TIME, *placed, "close"]) + ", " + RESULT
    return base, lambda: Book(risk, cost, min_hold, policy), schema


def stateful(df: DataFrame, risk: RiskConfig, cost: float, min_hold: int, policy: PolicyConfig, keys: list[str], signal: str = "signal") -> DataFrame:
    """A scan of each series; of a laid-out frame block by block, each block from the state in which the one before ends."""
    base, start, schema = machine(df, risk, cost, min_hold, policy, keys, signal)
    if not blocks.is_laid_out(base):
        return scan(base, keys, [W.TIME], start, schema)
    done, ends = chained(base, keys, start, schema)
    # trades are numbered, and equity grows, from each block's beginning: what the blocks before have of both comes on top
    before = Window.partitionBy(*keys).orderBy(blocks.BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(*[F.col(k).alias(f"__bw_k_{k}") for k in keys], F.col(blocks.BLOCK).alias("__bw_of"), F.sum(F.col("totals")[0]).over(before).alias("__bw_trades"), F.product(F.col("totals")[1]).over(before).alias("__bw_grown"))
    same = F.col(blocks.BLOCK) == F.col("__bw_of")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__bw_k_{k}"))
    done = done.join(ends, same).withColumns({"trade": F.col("trade") + F.coalesce("__bw_trades", F.lit(0)).cast("long"), "equity": F.col("equity") * F.coalesce("__bw_grown", F.lit(1.0))})
    return done.select(*[c.split()[0].strip("`") for c in schema.split(", ")])


def run(df: DataFrame, cfg: BacktestConfig | None = None, risk: RiskConfig | None = None, policy: PolicyConfig | None = None, keys: list[str] | None = None, signal: str = "signal") -> DataFrame:
    """Per-bar results of ``df`` (keys, ts, close, high, low[, funding_rate], signal): one row a bar.

    The signal is cut to an integer, a missing one counts as 0. Chooses the way by the settings; raises ValueError if close,
    high or low is absent.
    """
    cfg, risk, policy = cfg or BacktestConfig(), risk or RiskConfig(), policy or PolicyConfig()
    keys = keys or [W.SERIES]
    if risk.take_profit_pct is None and risk.stop_loss_pct is None and cfg.min_hold_bars <= 0 and not policy.is_active():
        return fast(df, risk.leverage, cfg.costs.per_side, keys, signal)
    return stateful(df, risk, cfg.costs.per_side, cfg.min_hold_bars, policy, keys, signal)


def trades(bars: DataFrame, cost: float, leverage: float, keys: list[str] | None = None) -> DataFrame:
    """The trades in per-bar results: start, end, bars, side, ret (net of fees and funding), exit (``open`` at the end)."""
    keys = keys or [W.SERIES]
    held = bars.where("trade is not null")
    c = cost * leverage
    ended = F.max(F.nullif("exit", F.lit("")))
    growth = F.product(1.0 + F.col("bar_ret") - F.col("funding_cost"))
    out = held.groupBy(*keys, "trade").agg(F.min(W.TIME).alias("start"), F.max(W.TIME).alias("end"), F.count("*").alias("bars"), F.max("side").alias("s"), growth.alias("g"), F.coalesce(ended, F.lit("open")).alias("exit"))
    ret = (1 - c) * F.col("g") * F.when(F.col("exit") == "open", 1.0).otherwise(1 - c) - 1
    return out.select(*keys, "start", "end", F.col("bars").cast("int").alias("bars"), F.when(F.col("s") > 0, "long").otherwise("short").alias("side"), ret.alias("ret"), "exit")


def _cagr(last: Column, bars: Column, per_year: float) -> Column:
    return F.when((last > 0) & (bars > 0), W.finite(F.pow(last, F.lit(float(per_year)) / bars) - 1))


def _sharpe(x: str, per_year: float) -> Column:
    sd = F.stddev_samp(x) * per_year**0.5
    return F.when(sd > 0, F.avg(x) * per_year / F.nullif(sd, F.lit(0.0)))


def drawdowns(df: DataFrame, keys: list[str], equity: str = "equity") -> DataFrame:
    if blocks.is_laid_out(df) and keys == [W.SERIES]:
        df = blocks.running(df, equity, "max")
        return df.withColumn("__bw_dd", W.ratio(F.col(equity), F.col("__bw_value")) - 1).drop("__bw_value")
    peak = F.max(equity).over(Window.partitionBy(*keys).orderBy(W.TIME).rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("__bw_peak", peak).withColumn("__bw_dd", W.ratio(F.col(equity), F.col("__bw_peak")) - 1).drop("__bw_peak")


def metrics(bars: DataFrame, per_year: float, cost: float, leverage: float, keys: list[str] | None = None) -> DataFrame:
    """Fifteen numbers for each key: returns, risk, trades, costs. NULL where a number has no value."""
    keys = keys or [W.SERIES]
    w = Window.partitionBy(*keys).orderBy(W.TIME)
    moved = drawdowns(bars, keys)
    if blocks.is_laid_out(bars) and keys == [W.SERIES]:
        w = Window.partitionBy(W.SERIES, blocks.BLOCK).orderBy(W.TIME)
        moved = blocks.own(blocks.halo(moved, 1).withColumn("__bw_turn", F.abs(F.col("position") - F.lag("position").over(w))))
    else:
        moved = moved.withColumn("__bw_turn", F.abs(F.col("position") - F.lag("position").over(w)))
    last = F.max_by("equity", W.TIME)
    own = moved.groupBy(*keys).agg(
        F.count("*").alias("bars"), (last - 1).alias("total_return"), _cagr(last, F.count("*"), per_year).alias("cagr"), _sharpe("net_ret", per_year).alias("sharpe"), F.min("__bw_dd").alias("max_drawdown"),
        F.coalesce(F.sum("__bw_turn"), F.lit(0.0)).alias("turnover"), F.avg((F.abs("position") > 0).cast("double")).alias("exposure"), F.sum(F.col("trade_cost") + F.col("funding_cost")).alias("total_cost"),
    )
    ledger = trades(bars, cost, leverage, keys)
    per = ledger.groupBy(*keys).agg(
        F.count("*").alias("trades"), F.avg((F.col("ret") > 0).cast("double")).alias("win_rate"), F.avg("ret").alias("avg_trade_return"),
        *[F.count_if(F.col("exit") == k).alias(f"exits_{k}") for k in ("sl", "tp", "flip", "flat")],
    )
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__bw_p_{k}"))
    out = own.join(per.withColumnsRenamed({k: f"__bw_p_{k}" for k in keys}), same, "left")
    zero = ("trades", "exits_sl", "exits_tp", "exits_flip", "exits_flat")
    order = ("bars", "total_return", "cagr", "sharpe", "max_drawdown", "trades", "win_rate", "avg_trade_return", "turnover", "exposure", "total_cost", "exits_sl", "exits_tp", "exits_flip", "exits_flat")
    return out.select(*keys, *[F.coalesce(n, F.lit(0)).alias(n) if n in zero else n for n in order])


def buy_and_hold(bars: DataFrame, per_year: float, keys: list[str] | None = None) -> DataFrame:
    """Return, growth a year, drawdown and Sharpe ratio of holding each series; zeros and no Sharpe ratio below two bars."""
    keys = keys or [W.SERIES]
    w = Window.partitionBy(*keys).orderBy(W.TIME)
    df = bars.withColumn("r", F.coalesce(W.ratio(F.col("close"), F.lag("close").over(w)) - 1, F.lit(0.0)))
    df = df.withColumn("equity", F.product(1.0 + F.col("r")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    last, n = F.max_by("equity", W.TIME), F.count("*")
    enough = n >= 2
    return drawdowns(df, keys).groupBy(*keys).agg(
        F.when(enough, last - 1).otherwise(0.0).alias("total_return"), F.when(enough, _cagr(last, n, per_year)).otherwise(0.0).alias("cagr"), F.when(enough, F.min("__bw_dd")).otherwise(0.0).alias("max_drawdown"), F.when(enough, _sharpe("r", per_year)).alias("sharpe")
    )
