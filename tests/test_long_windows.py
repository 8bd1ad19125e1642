"""Long frames from two running aggregates equal frames that are evaluated one by one."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from barwright.functions import long_windows as L
from barwright.functions.compiler import evaluate
from barwright.plans.blocks import lay_out

T0 = dt.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def bars(spark):
    rng, rows = random.Random(3), []
    for name, n in (("a", 400), ("b", 64), ("c", 63), (None, 130)):
        close = 1e6  # large beside its changes: sums of squares would lose them
        for i in range(n):
            close += rng.gauss(0, 1)
            gap = name == "a" and 100 < i < 180 and rng.random() < 0.3
            rows.append((name, T0 + dt.timedelta(hours=i), close, close + 1, close - rng.random(), None if gap else close, float(rng.randrange(9))))
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "series_id string, ts timestamp, open double, high double, low double, close double, volume double").repartition(3).cache()


TEXTS = ["sma(close, 64)", "stdev(close, 100)", "zscore(close, 77) + zscore(volume, 77)", "highest(high, 90) - lowest(low, 90)", "corr(close, volume, 70)", "slope(close, 65) * 1000", "bb_upper(close, 80, 2) - bb_lower(close, 80, 1) + bb_width(close, 80)", "sma(sma(volume, 70), 64) - prev(volume, 3)"]


@pytest.mark.parametrize("text", TEXTS)
def test_long_frames(bars, text, monkeypatch):
    ordered = lambda df: df.toPandas().sort_values(["series_id", "ts"])["score"].to_numpy()
    got, blocks = ordered(evaluate(bars, text, limit=False)), ordered(evaluate(lay_out(bars, 90), text, limit=False))
    monkeypatch.setattr(L, "LONG", 10**9)
    want = ordered(evaluate(bars, text, limit=False))
    np.testing.assert_allclose(got, want, rtol=1e-7, atol=1e-7)
    np.testing.assert_allclose(blocks, want, rtol=1e-7, atol=1e-7)
    assert np.abs(want).max() > 0


def test_frames_of_missing_values(spark):
    df = spark.createDataFrame([("s", T0 + dt.timedelta(hours=i), None if i % 3 else float(i)) for i in range(50)], "series_id string, ts timestamp, x double")
    df = df.withColumn("i", F.lit(0)).withColumn("i", (F.unix_timestamp("ts") - F.unix_timestamp(F.lit(T0))) / 3600)
    for kind in ("max", "min", "moments"):
        rows = L.with_frames(df, kind, 8, F.col("i"), "f", F.col("x")).orderBy("ts").select("i", "f.*").collect()
        for r in rows:
            own = [j for j in range(max(0, int(r.i) - 7), int(r.i) + 1) if j % 3 == 0]
            if r.i >= 7:
                assert r.n == len(own)
                if kind == "moments":
                    assert r.mx == pytest.approx(np.mean(own)) and r.sx == pytest.approx(np.var(own) * len(own))
                else:
                    assert r[{"max": "top", "min": "low"}[kind]] == (max if kind == "max" else min)(own)


@pytest.mark.parametrize("laid", (None, 7, 50))
def test_rolling_medians(spark, laid):
    """Odd and even frames, missing and infinite values, frames longer than series and blocks, several batches."""
    from barwright.functions.sequential import rolling_medians

    rng = np.random.default_rng(5)
    rows = [(s, int(i), None if rng.random() < 0.02 else float(rng.choice([rng.normal(), 1.0, np.inf, -np.inf], p=[0.6, 0.3, 0.05, 0.05]))) for s, n in (("a", 200), ("b", 3), ("c", 90)) for i in range(n)]
    df = spark.createDataFrame(rows, "series_id string, n int, x double").selectExpr("series_id", "timestamp_seconds(n) as ts", "n", "x")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 17)
    try:
        got = rolling_medians(lay_out(df, laid) if laid else df, {"m1": ("x", 1), "m4": ("x", 4), "m25": ("x", 25)}).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    series = {s: [x for t, _, x in rows if t == s] for s in "abc"}
    assert len(got) == len(rows)
    for r in got:
        for n in (1, 4, 25):
            frame = series[r.series_id][max(r.n - n + 1, 0) : r.n + 1]
            full = len(frame) == n and None not in frame
            mid = sorted(frame)[(n - 1) // 2 : n // 2 + 1] if full else []
            want = sum(mid) / len(mid) if full else None
            have = r[f"m{n}"]
            want = 0.0 if want is not None and want != want else want  # (midway between the infinities)
            assert have == (None if want is None else pytest.approx(want, abs=1e-12))
    assert rolling_medians(df.limit(0), {"m": ("x", 3)}).count() == 0
