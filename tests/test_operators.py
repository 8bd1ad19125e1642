import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from barwright.operators import optimize, regimes, signals
from barwright.operators.definitions import parse_signal, set_market_meta
from barwright.plans import bars as P
from barwright.plans.config import BacktestConfig

START = dt.datetime(2024, 1, 1)


def labels(spark, text):
    rows = [("a", START + dt.timedelta(hours=i), c) for i, c in enumerate(text)]
    return spark.createDataFrame(rows, "series_id string, ts timestamp_ntz, regime string")


@pytest.mark.parametrize(("given", "want"), [("aabbbbbbaa", "aabbbbbbbb"), ("abab", "aaaa"), ("ab", "aa"), ("aaabbbccc", "aaabbbccc")])
def test_dwell(spark, given, want):
    out = regimes.dwell(labels(spark, given), 3 if len(given) == 9 else 6).orderBy("ts").collect()
    assert "".join(r.regime for r in out) == want


def test_causal_dwell_waits(spark):
    out = regimes.dwell(labels(spark, "aabbbb"), 3, causal=True).orderBy("ts").collect()
    assert "".join(r.regime for r in out) == "aaaabb"


def test_combine(spark):
    rows = [("a", START, "chop", 0.5, None), ("a", START + dt.timedelta(hours=1), "odd", 1.0, 1.0), ("a", START + dt.timedelta(hours=2), "trend_up", 1.0, 1.0)]
    df = spark.createDataFrame(rows, "series_id string, ts timestamp_ntz, regime string, f_rsi double, f_trend double")
    assert [round(r.score, 6) for r in signals.combine(df).orderBy("ts").collect()] == [0.25, 0.0, 0.45]


def scores(spark, xs):
    rows = [("a", START + dt.timedelta(hours=i), 1.0, 1.0, 1.0, float(i), 1.0, x) for i, x in enumerate(xs)]
    return spark.createDataFrame(rows, "series_id string, ts timestamp_ntz, open double, high double, low double, close double, volume double, score double")


def positions(df):
    return [r.signal for r in df.orderBy("ts").collect()]


def test_discretize(spark):
    df = scores(spark, [0.2, -0.2, 0.1, None, 0.9])
    flat = BacktestConfig(min_hold_bars=0)
    assert positions(signals.discretize(df, flat)) == [1, -1, 0, 0, 1]
    assert positions(signals.discretize(df, flat, short_when="close >= 3")) == [1, 0, 0, -1, 1]
    assert positions(signals.discretize(df, flat, long_when="close < 9")) == [1, -1, 1, 1, 1]
    assert positions(signals.discretize(df, flat, "close < 3", "close > 0")) == [1, -1, -1, -1, -1]
    assert positions(signals.discretize(scores(spark, [0.3, -0.3, -0.3, 0.3, 0.0, 0.0]), BacktestConfig(min_hold_bars=2))) == [1, 1, -1, -1, 0, 0]


def test_asof(spark):
    at = lambda h, m=0: START + dt.timedelta(hours=h, minutes=m)
    left = spark.createDataFrame([("a", at(h)) for h in range(5)], "series_id string, ts timestamp_ntz").withColumn("x", F.lit(1))
    right = spark.createDataFrame([("a", at(1), 1.0), ("a", at(2), None), ("a", at(3, 30), 3.0), ("b", at(0), 9.0)], "series_id string, ts timestamp_ntz, v double")
    assert [r.v for r in P.asof_backward(left, right, ["v"]).orderBy("ts").collect()] == [None, 1.0, None, None, 3.0]
    assert [r.v for r in P.asof_nearest(left, right, ["v"], 1800).orderBy("ts").collect()] == [None, 1.0, None, 3.0, 3.0]
    ties = spark.createDataFrame([("a", at(0, 30), 1.0), ("a", at(1, 30), 2.0)], "series_id string, ts timestamp_ntz, v double")
    assert [r.v for r in P.asof_nearest(left, ties, ["v"], 1800).orderBy("ts").collect()] == [1.0, 2.0, 2.0, None, None]
    assert [r.v for r in P.asof_closed(left, right, "1h", ["v"]).orderBy("ts").collect()] == [None, None, 1.0, None, None]


BODY = {"name": "x", "score": "sma(close, 5", "long_threshold": 0.3}


def test_definitions():
    s = parse_signal(BODY)
    assert s.score == "sma(close, 5)" and s.auto_repair_notes == ("score: closed 1 bracket",)
    assert s.signal_id() == parse_signal(BODY | {"name": "y", "score": " sma(close,  5)"}).signal_id()
    assert s.signal_id() != parse_signal(BODY | {"leverage": 4}).signal_id()
    assert json.dumps(s.canonical(), sort_keys=True) and "leverage" not in s.canonical()
    assert parse_signal({"weights": {r: {"rsi": 1} for r in ("trend_up", "trend_down", "chop")}}).weights["chop"]["rsi"] == 1
    assert parse_signal(BODY | {"asset": " ethusdt"}).asset == "ETHUSDT"


@pytest.mark.parametrize(
    "body",
    [
        [], {}, {"weights": {}}, {"weights": {"chop": {}}}, {"weights": {"up": {}}}, {"weights": {r: {} for r in ("trend_up", "trend_down", "chop")}}, {"score": "a <"}, BODY | {"long_threshold": 0}, BODY | {"short_threshold": 0.1},
        BODY | {"take_profit_pct": 0.6}, BODY | {"stop_loss_pct": "x"}, BODY | {"min_hold_bars": 101}, BODY | {"leverage": 0.5}, BODY | {"skip_hours_utc": [24]}, BODY | {"skip_hours_utc": 3}, BODY | {"news_timestamps_ms": [1_700_000_000]},
        BODY | {"news_skip_minutes": 0}, BODY | {"max_trades_per_24h": 101}, BODY | {"max_consecutive_losses": -1}, BODY | {"asset": "DOGEUSDT"}, BODY | {"primary_tf": "3d"}, BODY | {"name": "a\nb"}, BODY | {"description": "x" * 401}, BODY | {"weights": {"chop": {"rsi": 6}}},
    ],
)
def test_rejected_definitions(body):
    with pytest.raises(ValueError):
        parse_signal(body)


def test_market_provider():
    class Market:
        def canonical_coin(self, s):
            return "xyz:TSLA" if s.lower() == "xyz:tsla" else None

        def is_listed(self, s):
            return s in ("xyz:TSLA", "kPEPEUSDT")

    set_market_meta(Market())
    try:
        assert parse_signal(BODY | {"asset": "XYZ:tsla"}).asset == "xyz:TSLA"
        assert parse_signal(BODY | {"asset": "kPEPEUSDT"}).asset == "kPEPEUSDT"
    finally:
        set_market_meta(None)
    with pytest.raises(ValueError):
        parse_signal(BODY | {"asset": "xyz:TSLA"})


def test_knobs():
    import numpy as np

    first = optimize.sample_knobs(2, 3)
    rng = np.random.default_rng(3)
    # the first numbers of the generator, as numbers
    assert [round(v, 12) for v in list(first[0].values())[:4]] == [0.085649167144, -0.157913696042, 0.400637232603, 0.049297221639]
    assert first[0]["up_trend"] == rng.uniform(0.0, 1.0) and first[0]["up_rsi"] == rng.uniform(-0.3, 0.3)
    w = optimize.knobs_to_weights(first[1])
    assert w["chop"]["macd"] == first[1]["cp_trend"] / 3 and w["trend_down"]["oi"] == first[1]["dn_flow"] / 2
    assert optimize.fold_bounds(500, 200, 100, 100) == 3 and optimize.fold_bounds(299, 200, 100, 100) == 0


@pytest.mark.parametrize(("hold", "tp", "sl", "lev"), [(0, None, None, 1.0), (8, 0.04, 0.015, 3.0), (3, 0.01, None, 2.0), (0, None, 0.02, 1.0)])
def test_all_trials_at_once_are_single_backtests(spark, hold, tp, sl, lev, monkeypatch):
    import random

    from barwright.operators import backtest as B
    from barwright.operators import trials
    from barwright.plans.config import RiskConfig

    monkeypatch.setattr(trials, "STRETCH", 37)
    rng, rows = random.Random(4), []
    names = ("rsi", "ema_cross", "macd", "trend", "volume", "oi", "funding")
    for s, n in (("a", 260), ("b", 1), (None, 90)):
        close = 100.0
        for i in range(n):
            close *= 1 + rng.gauss(0, 0.01)
            factors = [rng.choice([None, rng.uniform(-1, 1), rng.uniform(-1, 1)]) for _ in names]
            rows.append((s, START + dt.timedelta(hours=i), close, close * 1.005, close * 0.995, rng.choice([None, 1e-4]), rng.choice(["chop", "trend_up", "trend_down", "none"]), *factors))
    df = spark.createDataFrame(rows, "series_id string, ts timestamp_ntz, close double, high double, low double, funding_rate double, regime string, " + ", ".join(f"f_{n} double" for n in names))
    cfg, risk = BacktestConfig(min_hold_bars=hold), RiskConfig(lev, tp, sl)
    found = optimize.random_search(df.repartition(3), cfg, risk, 8760, 4, 1)
    got = {(r.series_id, r.trial): r for r in found.collect()}
    assert len(got) == 12
    for i, k in enumerate(optimize.sample_knobs(4, 1)):
        own = BacktestConfig(long_threshold=k["long_thr"], short_threshold=k["short_thr"], min_hold_bars=hold)
        one = signals.discretize(signals.combine(df, optimize.knobs_to_weights(k)), own)
        for m in B.metrics(B.run(one, own, risk), 8760, own.costs.per_side, lev).collect():
            mine = got[m.series_id, i]
            assert mine.knobs.asDict() == k
            for c in m.asDict():
                if c != "series_id":
                    assert getattr(mine, c) == (None if m[c] is None else pytest.approx(m[c], rel=1e-8, abs=1e-12)), (c, m.series_id, i)


def test_a_trial_is_a_single_backtest(spark):
    from barwright.operators import backtest as B
    from barwright.plans.config import RiskConfig

    import math

    rows = [("a", START + dt.timedelta(hours=i), 100 + 5 * math.sin(i / 5), ["chop", "trend_up"][i % 2], *[math.sin(i / k) for k in range(2, 9)]) for i in range(200)]
    names = ("rsi", "ema_cross", "macd", "trend", "volume", "oi", "funding")
    df = spark.createDataFrame(rows, "series_id string, ts timestamp_ntz, close double, regime string, " + ", ".join(f"f_{n} double" for n in names)).withColumns({"high": F.col("close"), "low": F.col("close")})
    cfg, risk = BacktestConfig(min_hold_bars=0), RiskConfig(1.0, None, None)
    got = {r.trial: r for r in optimize.random_search(df, cfg, risk, 8760, 3, 1).collect()}
    for i, k in enumerate(optimize.sample_knobs(3, 1)):
        one = signals.combine(df, optimize.knobs_to_weights(k))
        own = BacktestConfig(long_threshold=k["long_thr"], short_threshold=k["short_thr"], min_hold_bars=0)
        m = B.metrics(B.run(signals.discretize(one, own), own, risk), 8760, own.costs.per_side, 1.0).first()
        assert m.total_return == pytest.approx(got[i].total_return) and m.trades == got[i].trades


def test_min_hold_in_batches_equals_a_loop():
    import random

    import pandas as pd

    from barwright.operators.signals import Hold

    rng = random.Random(1)
    for _ in range(200):
        n, wanted = rng.randrange(1, 6), [rng.choice([-1, 0, 0, 1, 1, None]) for _ in range(rng.randrange(1, 40))]
        now, held, want = 0, 0, []
        for x in wanted:
            x = x or 0
            now, held = (x, 1) if x != now and (now == 0 or held >= n) else (now, held + 1)
            want.append(now)
        hold, got, at = Hold(n, "signal"), [], 0
        while at < len(wanted):
            size = rng.randrange(1, 9)
            got += hold(pd.DataFrame({"signal": wanted[at : at + size]}, dtype="float"))["signal"].tolist()
            at += size
        assert got == want


def test_walk_forward_has_the_bars_of_each_fold(spark):
    import datetime as dt
    import math

    from pyspark.sql import functions as F

    from barwright.operators.optimize import sample_knobs, walk_forward
    from barwright.plans.config import FACTORS, BacktestConfig, RiskConfig

    start = dt.datetime(2024, 1, 1)
    rows = [(s, start + dt.timedelta(hours=i), 100 + 5 * math.sin(i / 7)) for s, n in (("a", 83), ("b", 60), ("c", 39)) for i in range(n)]
    df = spark.createDataFrame(rows, "series_id string, ts timestamp, close double").withColumns({"high": F.col("close"), "low": F.col("close"), "regime": F.lit("chop")})
    df = df.withColumns({f"f_{n}": F.sin(F.col("close") * (i + 1)) for i, n in enumerate(FACTORS)})
    folds, tests = walk_forward(df, 30, 10, 10, BacktestConfig(min_hold_bars=0), RiskConfig(1.0, None, None), 8760, 6, 3)
    got = folds.collect()
    count = {"a": 5, "b": 3}
    assert {r.series_id for r in got} <= set(count) and got
    at = lambda i: start + dt.timedelta(hours=i)
    for r in got:
        assert r.fold < count[r.series_id]
        assert (r.train_start, r.train_end, r.test_start, r.test_end) == (at(10 * r.fold), at(10 * r.fold + 29), at(10 * r.fold + 30), at(10 * r.fold + 39))
    assert tests.groupBy("series_id", "fold").count().where("count <> 10").count() == 0
    assert all(r.best_knobs.asDict() == sample_knobs(6, 3 + r.fold)[r.trial] for r in got)


def test_a_strategy_that_fails_is_named(spark):
    import datetime as dt
    from dataclasses import replace

    from barwright.operators.definitions import parse_signal
    from barwright.operators.leaderboard import leaderboard

    df = spark.createDataFrame([("a", dt.datetime(2024, 1, 1, i), 100.0 + i % 3, 101.0 + i % 3, 99.0 + i % 3) for i in range(20)], "series_id string, ts timestamp, close double, high double, low double")
    df = df.withColumns({"open": F.col("close"), "volume": F.lit(1.0)})
    good = parse_signal({"weights": {r: {} for r in ("trend_up", "trend_down", "chop")}, "score": "close - 101", "long_threshold": 0.2, "short_threshold": -0.2})
    failed: dict[str, str] = {}
    out = leaderboard(df, {"good": good, "bad": replace(good, score="no_such_name(close)")}, failed=failed)
    assert {r.strategy for r in out.collect()} == {"good"} and set(failed) == {"bad"}


def test_features_of_three_timeframes_from_one_call(spark, tmp_path):
    from barwright.operators import mtf
    from barwright.sources.files import read_store, write_store

    hours = spark.range(24 * 100).select(
        F.lit("a").alias("series_id"), (F.lit(START).cast("timestamp_ntz") + F.make_interval(hours=F.col("id"))).alias("ts"), (100 + 10 * F.sin(F.col("id") / 17)).alias("close"), (100.0 + F.col("id") % 7).alias("volume"), (1000.0 + F.col("id") % 11).alias("open_interest")
    )
    hours = hours.withColumns({"open": F.col("close"), "high": F.col("close") + 1, "low": F.col("close") - 1})
    write_store(hours, str(tmp_path), "klines", "1h")
    asked = []

    def load(tf, start, end):
        asked.append((tf, start, end))
        rows = read_store(spark, str(tmp_path), "klines", "1h", "a", str(start), str(end))
        return rows if tf == "1h" else P.rebucket(rows, tf)

    start, end = START + dt.timedelta(days=70), START + dt.timedelta(days=90)
    out = mtf.load_mtf_features(load, "4h", start, end, include_oi=False)
    assert {a[0] for a in asked} == {"4h", "1d", "1h"} and {a[1] for a in asked} == {start - dt.timedelta(days=60)}
    rows = out.orderBy("ts").collect()
    assert len(rows) == 80 * 6 and rows[0].ts == START + dt.timedelta(days=10)
    assert all(r.f_oi == 0.0 for r in rows) and {r.regime for r in rows} <= {"trend_up", "trend_down", "chop"}
    own = mtf.build_mtf_features(load("4h", *asked[0][1:]), "4h", load("1d", *asked[0][1:]), load("1h", *asked[0][1:]))
    assert [r.f_trend for r in own.orderBy("ts").collect()] == [r.f_trend for r in rows]
    assert mtf.warm_up("1h") == dt.timedelta(days=30) and mtf.warm_up("1d") == mtf.warm_up("4h") == dt.timedelta(days=60)


def test_frames_in_use_stay_cached(spark):
    from barwright.operators.mtf import FeatureCache

    cache, built = FeatureCache(2), []
    make = lambda k: lambda: built.append(k) or spark.range(k)
    for k in (1, 2, 1, 3, 1, 2):
        assert cache.get((k,), make(k)).count() == k
    assert built == [1, 2, 3, 2]
    cache.clear()
    assert not cache.frames
