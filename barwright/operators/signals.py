"""From factors and regimes, or an expression, to positions -1, 0, 1."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barwright.functions import windows as W
from barwright.functions.compiler import evaluate, evaluate_bool
from barwright.functions.sequential import scan
from barwright.plans import blocks
from barwright.plans.chains import chained
from barwright.plans.config import REGIME_WEIGHTS, BacktestConfig


def weighted(weights: dict[str, dict[str, float]], regime: Column, columns: list[str]) -> Column:
    """Sum of factor (columns ``f_...``) times the regime's weight, clipped; a missing factor adds nothing, an unknown regime scores 0."""
    out = F.lit(0.0)
    for name, own in weights.items():
        total = F.lit(0.0)
        for factor, w in own.items():
            if f"f_{factor}" in columns and w:
                total = total + F.coalesce(F.col(f"f_{factor}") * F.lit(float(w)), F.lit(0.0))
        out = F.when(regime == name, total).otherwise(out)
    return W.clip(out, -1, 1)


def combine(df: DataFrame, weights: dict[str, dict[str, float]] | None = None, score_expr: str | None = None, out: str = "score", regime: str = "regime") -> DataFrame:
    """``df`` with a score: of the expression if there is one, else the factors weighted by regime."""
    if score_expr:
        return evaluate(df, score_expr, out)
    return df.withColumn(out, weighted(weights or REGIME_WEIGHTS, F.col(regime), df.columns))


def discretize(df: DataFrame, cfg: BacktestConfig | None = None, long_when: str = "", short_when: str = "", score: str = "score", out: str = "signal") -> DataFrame:
    """``df`` with positions from thresholds (inclusive) or conditions.

    What is stated later wins: long condition, short condition, long threshold (without a long condition), short threshold
    (without a short one). With a short condition alone, a bar that meets it and the long threshold is thus long.
    A minimum holding time then applies.
    """
    cfg = cfg or BacktestConfig()
    columns = [c for c in df.columns if c != out]
    rules: list[tuple[Column, int]] = []
    for i, (text, side) in enumerate(((long_when, 1), (short_when, -1))):
        if text:
            name = f"__bw_when_{i}"
            df = evaluate_bool(df, text, name)
            rules.append((F.col(name), side))
    if not long_when:
        rules.append((F.col(score) >= cfg.long_threshold, 1))
    if not short_when:
        rules.append((F.col(score) <= cfg.short_threshold, -1))
    position = F.lit(0)
    for condition, side in rules:
        position = F.when(condition, side).otherwise(position)
    df = df.select(*columns, position.cast("int").alias(out))
    return min_hold(df, cfg.min_hold_bars, out) if cfg.min_hold_bars > 0 else df


class Hold:
    """Carries the position, and for how many bars it has been held, from batch to batch; goes from change to change."""

    KEPT = ("now", "held")

    def __init__(self, n: int, column: str):
        self.n, self.column, self.now, self.held = n, column, 0, 0

    def hand_over(self) -> tuple:
        """What later bars depend on: how long beyond ``n`` bars does not matter, nor for how long there was no position."""
        return self.now, min(self.held, self.n) if self.now else 0

    def take_over(self, state: tuple) -> None:
        self.now, self.held = state

    def __call__(self, frame: pd.DataFrame) -> pd.DataFrame:
        wanted = frame[self.column].fillna(0).to_numpy().astype(np.int32)
        starts = np.flatnonzero(np.concatenate([[True], wanted[1:] != wanted[:-1]]))  # of runs of one wish
        at, values, since = [0], [self.now], -self.held
        while True:
            free = at[-1] if self.now == 0 else max(at[-1], since + self.n)  # the first bar that may change it
            run = int(np.searchsorted(starts, free, "right")) - 1
            if free < len(wanted) and wanted[free] == self.now:
                free = int(starts[run + 1]) if run + 1 < len(starts) else len(wanted)
            if free >= len(wanted):
                break
            self.now, since = int(wanted[free]), free
            at.append(free)
            values.append(self.now)
        self.held = len(wanted) - since
        got = np.repeat(np.array(values, np.int32), np.diff([*at, len(wanted)]))
        return frame.assign(**{self.column: got})


def min_hold(df: DataFrame, n: int, column: str = "signal", keys: tuple[str, ...] = (W.SERIES,)) -> DataFrame:
    """Positions that are kept for ``n`` bars at least before they change or end."""
    schema = ", ".join(f"`{c}` {t}" for c, t in df.dtypes)
    if blocks.is_laid_out(df):
        return chained(df, list(keys), lambda: Hold(n, column), schema)[0]
    return scan(df, list(keys), [W.TIME], lambda: Hold(n, column), schema)
