"""Laid-out series: blocks give what whole series give."""

import datetime as dt
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barwright.functions.compiler import evaluate, evaluate_bool
from barwright.functions.sequential import ewm, means, wilder
from barwright.plans import blocks as B

T0 = dt.datetime(2024, 1, 1)
SCHEMA = "series_id string, ts timestamp, open double, high double, low double, close double, volume double, sparse double"


def bars(spark, lengths=(("a", 150), ("b", 41), ("c", 1), (None, 60)), seed=1):
    rng, rows = random.Random(seed), []
    for name, n in lengths:
        price = 100.0
        for i in range(n):
            was, price = price, max(5.0, price + rng.gauss(0, 1))
            top, low = max(was, price) + rng.random(), min(was, price) - rng.random()
            rows.append((name, T0 + dt.timedelta(hours=5 * i), was, top, low, price, rng.random() * 100, rng.gauss(0, 1) if rng.random() < 0.05 else None))
    rng.shuffle(rows)
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def both(spark):
    df = bars(spark).cache()
    return df, B.lay_out(df, 16)


def test_places_and_blocks(both):
    df, laid = both
    rows = laid.select("series_id", "ts", B.PLACE, B.BLOCK).toPandas()
    assert len(rows) == df.count() and B.rows_of(laid) == 16
    for _, own in rows.groupby("series_id", dropna=False):
        own = own.sort_values("ts")
        assert own[B.PLACE].tolist() == list(range(len(own))) and own[B.BLOCK].tolist() == [i // 16 for i in range(len(own))]
    assert B.taken_up(laid).columns == df.columns
    again = B.lay_out(laid, 50)
    assert again.columns == laid.columns and again.count() == len(rows)
    assert B.lay_out(df.where("false")).count() == 0
    with pytest.raises(ValueError):
        B.lay_out(df, 0)


def test_halos(both):
    _, laid = both
    wide = B.halo(laid, 40, 3)
    n = {r[B.BLOCK]: r["n"] for r in wide.where("series_id = 'a'").groupBy(B.BLOCK).agg(F.count("*").alias("n")).collect()}
    assert n[0] == 19 and n[1] == 35 and n[4] == 59
    assert B.own(wide).count() == laid.count()


EXPRESSIONS = [
    "zscore(close, 30)", "ema(close, 5) - ema(close, 20)", "sma(sma(close, 20), 20) - prev(close, 7)", "slope(ema(highest(high, 12), 9), 15)", "adx(5) + rsi(close, 14) * 0.1", "obv() / 1000",
    "vwap(24) - session_vwap()", "bar_index / 100 + ema(ema(close, 3), 4)", "cci(20) / 100 + mfi(14)", "corr(close, volume, 24)", "keltner_width(7)",
]


@pytest.mark.parametrize("text", EXPRESSIONS)
def test_expressions(both, text):
    df, laid = both
    df, laid = (x.drop("sparse") for x in (df, laid))
    want = evaluate(df, text, limit=False).toPandas().sort_values(["series_id", "ts"])["score"].to_numpy()
    got = evaluate(laid, text, limit=False)
    assert got.columns == [*laid.columns, "score"]
    got = got.toPandas().sort_values(["series_id", "ts"])["score"].to_numpy()
    np.testing.assert_allclose(got, want, rtol=1e-9, atol=1e-9)


def test_conditions(both):
    df, laid = both
    text = "close > sma(close, 40) and ema(close, 3) > prev(ema(close, 3), 20)"
    want = {(r[0], r[1], r[2]) for r in evaluate_bool(df, text).select("series_id", "ts", "condition").collect()}
    assert {(r[0], r[1], r[2]) for r in evaluate_bool(laid, text).select("series_id", "ts", "condition").collect()} == want


SPECS = {"e3": ("close", 0.5), "e20": ("close", 2 / 21), "e900": ("close", 2 / 901), "one": ("sparse", 1.0), "s9": ("sparse", 0.9), "s14": ("sparse", wilder(14))}


def pandas_means(df):
    pdf = df.toPandas().sort_values(["series_id", "ts"]).reset_index(drop=True)
    for n, (c, a) in SPECS.items():
        pdf[n] = pdf.groupby("series_id", dropna=False)[c].transform(lambda x, a=a: x.ewm(alpha=a, adjust=False).mean())
    return pdf


def test_means_as_columns_and_over_blocks(both):
    df, laid = both
    want = pandas_means(df)
    for got in (means(df, SPECS, ["series_id"]), ewm(laid, SPECS), ewm(df, SPECS)):
        got = got.toPandas().sort_values(["series_id", "ts"]).reset_index(drop=True)
        for n in SPECS:
            np.testing.assert_allclose(got[n].astype(float), want[n], rtol=1e-12, atol=1e-12)


def test_long_gaps_and_many_stretches(spark):
    rng = np.random.default_rng(3)
    x = pd.Series(rng.normal(size=6000).cumsum())
    x[rng.random(6000) < 0.4] = None
    x[500:4000] = None
    df = spark.createDataFrame([("s", T0 + dt.timedelta(minutes=i), None if v != v else float(v)) for i, v in enumerate(x)], "series_id string, ts timestamp, x double")
    specs = {f"m{i}": ("x", a) for i, a in enumerate((0.99, 0.7, 0.3, 0.01, 0.001))}
    for frame in (means(df, specs, ["series_id"]), ewm(B.lay_out(df, 900), specs)):
        got = frame.toPandas().sort_values("ts")
        for n, (_, a) in specs.items():
            np.testing.assert_allclose(got[n].astype(float), x.ewm(alpha=a, adjust=False).mean(), rtol=1e-11, atol=1e-12)


def test_plans_have_no_exchange_on_the_series_alone_and_no_python(both):
    _, laid = both
    for text in ("zscore(close, 30)", "ema(close, 20)"):
        plan = evaluate(laid, text)._jdf.queryExecution().executedPlan().toString()
        hashed = [line for line in plan.splitlines() if "Exchange hashpartitioning(series_id" in line]
        rows = [line for line in hashed if "__bw_block" in line]
        assert rows and "Python" not in plan and "MapInArrow" not in plan
        if "zscore" in text:
            assert rows == hashed


def same(a, b, columns):
    a, b = (x.toPandas().sort_values(["series_id", "ts"]).reset_index(drop=True) for x in (a, b))
    for c in columns:
        if a[c].dtype == object or b[c].dtype == object:
            assert a[c].astype(str).tolist() == b[c].astype(str).tolist(), c
        else:
            np.testing.assert_allclose(a[c].astype(float), b[c].astype(float), rtol=1e-9, atol=1e-9, err_msg=c)


def test_factors(spark):
    from barwright.operators.factors import SINGLE, compute_all_factors

    df = bars(spark, (("a", 700), ("b", 30)), 5).withColumn("open_interest", F.col("volume") * 3).withColumn("close", F.when(F.col("volume") > 3, F.col("close")))
    laid = B.lay_out(df, 64)
    same(compute_all_factors(laid), compute_all_factors(df), [f"f_{n}" for n in SINGLE])


@pytest.mark.parametrize("causal", [False, True])
def test_regimes(both, causal):
    from barwright.operators.regimes import classify, dwell

    df, laid = both
    label = F.when(F.pmod(F.hash("volume"), F.lit(5)) > 2, "x").otherwise("y")
    for d in (2, 5, 20):
        same(dwell(laid.withColumn("regime", label), d, causal=causal), dwell(df.withColumn("regime", label), d, causal=causal), ["regime"])
    same(classify(laid, adx_threshold=15, causal=causal), classify(df, adx_threshold=15, causal=causal), ["regime"])


def test_medians(spark):
    rng = random.Random(8)
    rows = [("a", rng.gauss(0, 1) * 10 ** rng.randrange(-3, 6)) for _ in range(3001)] + [("b", float(rng.randrange(3))) for _ in range(500)] + [("c", 1.5), (None, -2.0), (None, 3.0), ("d", None), ("e", -1.7e308), ("e", 1.7e308), ("e", 4.0)]
    got = {r[0]: r[1] for r in B.medians(spark.createDataFrame(rows, "series_id string, x double"), "x").collect()}
    want = pd.DataFrame(rows, columns=["s", "x"]).dropna(subset="x").groupby("s", dropna=False)["x"].median()
    assert got == {None if s != s else s: v for s, v in want.items()}
