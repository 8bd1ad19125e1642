"""Streams in order of time: bars out of order, late ones, a restart in the middle, sessions, series that end."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from barwright.functions.sequential import ewm
from barwright.operators import backtest
from barwright.operators.signals import min_hold
from barwright.plans.bars import with_sessions
from barwright.plans.config import BacktestConfig, PolicyConfig, RiskConfig
from barwright.streaming.closed_bars import carried, stream_backtest, stream_ewm, stream_min_hold
from barwright.streaming.processors import start_query

@pytest.fixture(autouse=True)
def _few_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


START = dt.datetime(2024, 3, 1)
SCHEMA = "series_id string, ts timestamp, close double, high double, low double, x double, signal int"


def _rows(hours, names, seed):
    rng = np.random.default_rng(seed)
    rows = []
    for s in names:
        close = 100 * np.exp(np.cumsum(rng.normal(0, 0.01, len(hours))))
        rows += [(s, START + dt.timedelta(hours=h), float(c), float(c * 1.006), float(c * 0.994), None if rng.random() < 0.3 else float(rng.normal()), int(rng.integers(-1, 2))) for h, c in zip(hours, close, strict=True)]
    return sorted(rows, key=lambda r: (r[1], str(r[0])))


def _add(spark, path, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)


def _go(stream, path):
    """What is there goes through; the counts of rows that came too late."""
    q = start_query(stream, f"{path}/out", f"{path}/checkpoint")
    q.awaitTermination(120)
    assert not q.isActive
    return sum(op["numRowsDroppedByWatermark"] for p in q.recentProgress for op in p["stateOperators"]), q.recentProgress[-1]["stateOperators"][0]["numRowsTotal"]


def _same(got, want, columns):
    order = lambda df: sorted((tuple(r) for r in df.select(*columns).collect()), key=lambda r: (str(r[0]), r[1]))
    got, want = order(got), order(want)
    assert len(got) == len(want)
    for g, w in zip(got, want, strict=True):
        assert all(a == b or a == pytest.approx(b, rel=1e-9) for a, b in zip(g, w, strict=True))
    return len(got)


CFG, RISK, POLICY = BacktestConfig(min_hold_bars=2), RiskConfig(2.0, 0.02, 0.01), PolicyConfig((3,), (), 15, 4, 2)
WAYS = {
    "means": (lambda b: ewm(b.select("series_id", "ts", "x"), {"m": ("x", 0.3)}), lambda s, **o: stream_ewm(s, "x", 0.3, "m", **o)),
    "holds": (lambda b: min_hold(b, 4), lambda s, **o: stream_min_hold(s, 4, **o)),
    "tested": (lambda b: backtest.run(b, CFG, RISK, POLICY), lambda s, **o: stream_backtest(s, CFG, RISK, POLICY, **o)),
}


@pytest.mark.parametrize("way", WAYS)
def test_out_of_order_and_restarted(spark, tmp_path, way):
    """Bars up to five hours late take their places, in every batch and over a restart; one far behind is dropped and counted."""
    batch, live = WAYS[way]
    rng, path = np.random.default_rng(8), str(tmp_path / "in")
    rows = _rows(range(60), ["a", "b", None], 8)
    rows = [rows[i] for i in np.argsort([r[1].timestamp() / 3600 + rng.uniform(0, 4.5) for r in rows], kind="stable")]
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(path)
    late = "5 hours"
    _add(spark, path, rows[:50])
    _add(spark, path, rows[50:90])
    dropped, _ = _go(live(stream, late=late), str(tmp_path))
    assert dropped == 0
    stray = ("a", START + dt.timedelta(minutes=30), 1.0, 1.0, 1.0, 1.0, 1)
    _add(spark, path, [*rows[90:140], stray])
    _add(spark, path, rows[140:])
    dropped, waiting = _go(live(stream, late=late), str(tmp_path))
    assert dropped == 1 and waiting > 0
    want = batch(spark.createDataFrame(rows, SCHEMA)).where(F.col("ts") <= F.lit(START + dt.timedelta(hours=59 - 5)))
    assert _same(spark.read.parquet(f"{tmp_path}/out"), want, want.columns) == 3 * 55


def test_sessions(spark, tmp_path):
    """A long gap begins a session; the state of a series that ended is deleted, whether or not it comes back."""
    path = str(tmp_path / "in")
    rows = _rows([*range(10), *range(12, 20), *range(40, 60)], ["a"], 3) + _rows(range(8), ["gone"], 4) + _rows([*range(6), *range(50, 58)], ["back"], 5)
    rows = sorted(rows, key=lambda r: r[1])
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(path)
    live = stream_backtest(stream, CFG, RISK, POLICY, late="1 hour", gap="3 hours")
    cuts = [0, 12, 30, 45, len(rows)]
    for a, b in zip(cuts, cuts[1:], strict=False):
        _add(spark, path, rows[a:b])
        assert _go(live, str(tmp_path))[0] == 0
    bars = with_sessions(spark.createDataFrame(rows, SCHEMA), "3 hours")
    assert sorted((r.series_id, r.n) for r in bars.groupBy("series_id").agg(F.countDistinct("session").alias("n")).collect()) == [("a", 2), ("back", 2), ("gone", 1)]
    want = backtest.run(bars, CFG, RISK, POLICY, keys=["series_id", "session"]).where(F.col("ts") <= F.lit(START + dt.timedelta(hours=58)))
    got = spark.read.parquet(f"{tmp_path}/out")
    assert _same(got, want, ["series_id", "ts", *[c for c in want.columns if c not in ("series_id", "ts")]]) == len(rows) - 1
    states = spark.read.format("statestore").option("stateVarName", "state").load(f"{tmp_path}/checkpoint")
    assert sorted(r[0] for r in states.select("key.series_id").collect()) == ["a", "back"]


def test_an_empty_stream_and_what_is_refused(spark, tmp_path):
    path = str(tmp_path / "in")
    _add(spark, path, [])
    stream = spark.readStream.schema(SCHEMA).parquet(path)
    _go_empty = start_query(stream_min_hold(stream, 3, late="1 hour"), f"{tmp_path}/out", f"{tmp_path}/c")
    _go_empty.awaitTermination(60)
    assert spark.read.schema(SCHEMA).parquet(f"{tmp_path}/out").count() == 0
    with pytest.raises(ValueError):
        stream_min_hold(stream, 3, gap="3 hours")
    with pytest.raises(ValueError):
        stream_min_hold(stream.withColumn("session", F.col("ts")), 3, late="1 hour", gap="3 hours")
    with pytest.raises(TypeError):
        carried(stream, ["series_id"], lambda: object(), SCHEMA, "1 hour")
