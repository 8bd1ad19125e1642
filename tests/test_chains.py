"""State machines over blocks of long series give what one pass over each series gives."""

import datetime as dt
import random

import numpy as np
import pytest

from barwright.operators import backtest
from barwright.operators.signals import min_hold
from barwright.plans import blocks as B
from barwright.plans.config import BacktestConfig, PolicyConfig, RiskConfig

T0 = dt.datetime(2024, 1, 1)
SCHEMA = "series_id string, ts timestamp, close double, high double, low double, funding_rate double, signal int"


@pytest.fixture(scope="module")
def both(spark):
    rng, rows = random.Random(2), []
    for name, n in (("a", 230), ("b", 60), (None, 45), ("one", 1)):
        price, wish = 100.0, 0
        for i in range(n):
            price = max(5.0, price * (1 + rng.gauss(0, 0.01)))
            wish = rng.choice([-1, 0, 1]) if rng.random() < 0.2 else wish
            rows.append((name, T0 + dt.timedelta(hours=3 * i), price, price * (1 + rng.random() * 0.01), price * (1 - rng.random() * 0.01), rng.gauss(0, 1e-4), rng.choice([wish, wish, wish, None])))
    rows += [("still", T0 + dt.timedelta(hours=i), 100.0 + i * 0.01, 100.1 + i * 0.01, 99.9 + i * 0.01, None, 1) for i in range(70)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3).cache()
    return df, B.lay_out(df, 16)


def ordered(df):
    return df.toPandas().sort_values(["series_id", "ts"]).reset_index(drop=True)


@pytest.mark.parametrize("n", [1, 3, 12, 40])
def test_holding_times(both, n):
    df, laid = both
    got, want = min_hold(laid, n), min_hold(df, n)
    assert got.columns == laid.columns
    assert ordered(got)["signal"].tolist() == ordered(want)["signal"].tolist()


CASES = [
    (RiskConfig(3.0, 0.02, 0.01), BacktestConfig(min_hold_bars=4), PolicyConfig()),
    (RiskConfig(1.0, None, 0.03), BacktestConfig(min_hold_bars=20), PolicyConfig(skip_hours_utc=(3, 9))),
    (RiskConfig(2.0, 0.01, 0.01), BacktestConfig(min_hold_bars=0), PolicyConfig(max_trades_per_24h=2, max_consecutive_losses=2)),
    (RiskConfig(2.0, 0.5, 0.5), BacktestConfig(min_hold_bars=2), PolicyConfig()),
    (RiskConfig(2.0, None, None), BacktestConfig(min_hold_bars=0), PolicyConfig()),
]


@pytest.mark.parametrize(("risk", "cfg", "policy"), CASES)
def test_backtests(both, risk, cfg, policy):
    df, laid = both
    got, want = backtest.run(laid, cfg, risk, policy), backtest.run(df, cfg, risk, policy)
    per = lambda x: x.drop(B.PLACE, B.BLOCK)
    a, b = ordered(per(got)), ordered(want)
    assert a.columns.tolist() == b.columns.tolist()
    for c in b.columns:
        if a[c].dtype.kind == "f" and c != "trade":
            np.testing.assert_allclose(a[c], b[c], rtol=1e-12, atol=1e-15)
        else:
            assert a[c].astype(str).tolist() == b[c].astype(str).tolist(), c
    m = [ordered_metrics(backtest.metrics(x, 8760, 0.0006, risk.leverage)) for x in (got, want)]
    assert m[0] == m[1]


def ordered_metrics(df):
    return sorted((str(tuple(round(x, 9) if isinstance(x, float) else x for x in r)) for r in df.collect()))


def test_no_rows(both):
    _, laid = both
    assert min_hold(laid.where("false"), 3).count() == 0
    assert backtest.run(laid.where("false"), *CASES[0][1::-1], CASES[0][2]).count() == 0
