import datetime as dt
import itertools
import random

import numpy as np
import pandas as pd
import pytest

from barwright.operators import backtest as B
from barwright.plans.config import BacktestConfig, Costs, PolicyConfig, RiskConfig

START = dt.datetime(2024, 1, 1)


def frame(spark, close, signal, high=None, low=None, funding=None, series="a"):
    n = len(close)
    rows = [(series, START + dt.timedelta(hours=i), float(close[i]), float((high or close)[i]), float((low or close)[i]), float((funding or [0] * n)[i]), signal[i]) for i in range(n)]
    return spark.createDataFrame(rows, "series_id string, ts timestamp_ntz, close double, high double, low double, funding_rate double, signal int")


def run(spark, close, signal, fee=0.0, lev=1.0, tp=None, sl=None, hold=0, policy=None, **k):
    cfg, risk = BacktestConfig(min_hold_bars=hold, costs=Costs(fee, fee)), RiskConfig(lev, tp, sl)
    bars = B.run(frame(spark, close, signal, **k), cfg, risk, policy)
    m = B.metrics(bars, 8760, cfg.costs.per_side, lev).collect()
    t = B.trades(bars, cfg.costs.per_side, lev).orderBy("start").collect()
    return (m[0].asDict() if m else {}), t, bars.orderBy("ts").collect()


CASES = {
    "long": (dict(close=[100, 110, 121, 121], signal=[1, 1, 0, 0]), [(0.21, "long", "flat", 2)]),
    "leverage": (dict(close=[100, 110, 121, 121], signal=[1, 1, 0, 0], lev=2.0), [(0.44, "long", "flat", 2)]),
    "short": (dict(close=[100, 90, 90], signal=[-1, 0, 0]), [(0.10, "short", "flat", 1)]),
    "target": (dict(close=[100, 104, 104], signal=[1, 0, 0], high=[100, 106, 104], low=[100, 100, 104], tp=0.05), [(0.05, "long", "tp", 1)]),
    "stop": (dict(close=[100, 98, 98], signal=[1, 0, 0], high=[100, 100, 98], low=[100, 96, 98], sl=0.03), [(-0.03, "long", "sl", 1)]),
    "both": (dict(close=[100, 100, 100], signal=[1, 0, 0], high=[100, 106, 100], low=[100, 96, 100], tp=0.05, sl=0.03), [(-0.03, "long", "sl", 1)]),
    "stop before holding time": (dict(close=[100, 98, 98], signal=[1, 0, 0], high=[100, 100, 98], low=[100, 96, 98], sl=0.03, hold=99), [(-0.03, "long", "sl", 1)]),
    "two": (dict(close=[100, 120, 120, 120, 108, 108], signal=[1, 1, 0, 1, 0, 0]), [(0.20, "long", "flat", 2), (-0.10, "long", "flat", 1)]),
    "flip": (dict(close=[100, 110, 99, 99], signal=[1, -1, 0, 0]), [(0.10, "long", "flip", 1), (0.10, "short", "flat", 1)]),
    "open": (dict(close=[100, 110, 121], signal=[1, 1, 1]), [(0.21, "long", "open", 2)]),
}


@pytest.mark.parametrize("name", CASES)
def test_cases_worked_out_by_hand(spark, name):
    given, want = CASES[name]
    m, t, _ = run(spark, **given)
    assert [(pytest.approx(r.ret), r.side, r.exit, r.bars) for r in t] == want
    total = 1.0
    for r in t:
        total *= 1 + r.ret
    assert m["total_return"] == pytest.approx(total - 1)
    assert m["trades"] == len(t)


def test_numbers(spark):
    m, _, _ = run(spark, *CASES["two"][0].values())
    assert (m["win_rate"], m["avg_trade_return"], m["max_drawdown"]) == (0.5, pytest.approx(0.05), pytest.approx(-0.10))
    m, _, _ = run(spark, [100, 101, 102, 102], [1, 1, 0, 0], fee=5.0)
    assert m["total_cost"] == pytest.approx(0.002)
    m, t, _ = run(spark, [100, 110, 99, 99], [1, -1, 0, 0], fee=5.0)
    assert m["total_cost"] == pytest.approx(0.004) and all(r.ret < 0.10 - 0.0015 for r in t)
    m, t, _ = run(spark, [100, 100.1, 100.1], [1, 0, 0], fee=5.0)
    assert m["win_rate"] == 0 and t[0].ret < 0
    m, t, rows = run(spark, [100, 100, 100], [1, 0, 0], funding=[0, 0.08, 0])
    assert (rows[1].funding_cost, rows[1].net_ret) == (pytest.approx(0.01), pytest.approx(-0.01))
    m, _, _ = run(spark, [100, 110, 121, 121], [1, 1, 0, 0])
    assert m["exposure"] == 0.5 and m["max_drawdown"] == 0
    assert run(spark, [], [])[1] == []


def test_buy_and_hold(spark):
    for close, total, down in (([100, 110, 121], 0.21, 0.0), ([100, 120, 108], 0.08, -0.10), ([100], 0.0, 0.0)):
        r = B.buy_and_hold(frame(spark, close, [0] * len(close)), 8760).first()
        assert (r.total_return, r.max_drawdown) == (pytest.approx(total), pytest.approx(down))


def test_both_ways_agree(spark):
    rng = random.Random(5)
    close = [100.0]
    for _ in range(400):
        close.append(close[-1] * (1 + rng.gauss(0, 0.01)))
    signal = [rng.choice([-1, 0, 0, 1, 1]) for _ in close]
    df = frame(spark, close, signal, funding=[rng.gauss(0, 1e-4) for _ in close])
    a = B.fast(df, 2.0, 6e-4, ["series_id"]).orderBy("ts").collect()
    b = B.stateful(df, RiskConfig(2.0, None, None), 6e-4, 0, PolicyConfig(), ["series_id"]).orderBy("ts").collect()
    for x, y in zip(a, b, strict=True):
        assert (x.exit, x.side, x.position) == (y.exit, y.side, y.position)
        assert (x.net_ret, x.equity, x.trade_cost) == (pytest.approx(y.net_ret), pytest.approx(y.equity), pytest.approx(y.trade_cost))
    ends = [B.trades(spark.createDataFrame(r), 6e-4, 2.0).orderBy("start").collect() for r in (a, b)]
    assert [(r.start, r.exit, pytest.approx(r.ret)) for r in ends[0]] == [(r.start, r.exit, r.ret) for r in ends[1]]


def test_policies(spark):
    ms = int(START.replace(tzinfo=dt.UTC).timestamp() * 1000)
    on = [1, 0] * 15
    flat = [100.0] * 30

    def entries(**k):
        rows = run(spark, flat, on, fee=5.0, policy=PolicyConfig(**k))[2]
        return [i for i, r in enumerate(rows) if r.trade_cost > 0 and r.exit == ""]

    assert entries(skip_hours_utc=(0, 2)) == [4, 6, 8, 10, 12, 14, 16, 18, 20, 22, 28]
    assert 8 not in entries(news_timestamps_ms=(ms + 8 * 3600_000 + 15 * 60_000,)) and 8 in entries(news_timestamps_ms=(ms + 8 * 3600_000 + 16 * 60_000,))
    assert entries(max_trades_per_24h=2) == [0, 2, 26, 28]
    losing = [100.0 - i for i in range(30)]
    rows = run(spark, losing, on, fee=5.0, policy=PolicyConfig(max_consecutive_losses=2))[2]
    assert [i for i, r in enumerate(rows) if r.trade_cost > 0 and r.exit == ""] == [0, 2, 24, 26]


def test_missing_columns(spark):
    with pytest.raises(ValueError, match="high"):
        B.run(frame(spark, [1], [0]).drop("high"))


@pytest.mark.parametrize("keep", [1, 4, 60])
@pytest.mark.parametrize("broken", [False, True])
def test_passing_over_equals_bar_by_bar(monkeypatch, keep, broken):
    """Bars in which the side stays give the very same numbers, whatever the stops, holding times, limits and cuts into batches."""
    rng, n = np.random.default_rng(keep), 500
    close = 100 * np.exp(np.cumsum(rng.normal(0, 0.003, n)))
    if broken:
        close[rng.random(n) < 0.004] = 0.0
        close[rng.random(n) < 0.004] = np.nan
    bars = pd.DataFrame({
        "close": close, "high": close * 1.002, "low": close * 0.998, "__bw_funding": rng.normal(0, 1e-4, n), "__bw_signal": np.repeat(rng.integers(-1, 2, n // keep + 1), keep)[:n],
        "__bw_barred": rng.random(n) < 0.1, "__bw_ms": 1_704_067_200_000 + np.arange(n) * 3_600_000,
    })
    for risk, hold, policy in itertools.product(
        (RiskConfig(2.0, None, None), RiskConfig(2.0, 0.05, 0.03), RiskConfig(60.0, 0.3, None)), (0, 5, 90), (PolicyConfig(), PolicyConfig((), (), 15, 2, 0), PolicyConfig((), (), 15, 3, 1))
    ):
        done = []
        for quiet in (10**9, 1, 6):
            monkeypatch.setattr(B, "QUIET", quiet)
            book = B.Book(risk, 0.001, hold, policy)
            done.append((pd.concat([book(bars.iloc[a : a + 170]) for a in range(0, n, 170)]), repr(book.hand_over()), repr(book.totals())))
        for other in done[1:]:
            pd.testing.assert_frame_equal(done[0][0], other[0], check_exact=True)
            assert done[0][1:] == other[1:]
