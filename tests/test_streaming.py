import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from barwright.functions.sequential import ewm
from barwright.operators import backtest
from barwright.operators.signals import min_hold
from barwright.plans.config import BacktestConfig, PolicyConfig, RiskConfig
from barwright.streaming.closed_bars import stream_backtest, stream_bars, stream_ewm, stream_min_hold


def test_closed_bars_and_state(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    path = str(tmp_path / "in")
    for part in range(2):
        rows = [(i, start + dt.timedelta(minutes=20 * i), "a", float(i)) for i in range(part * 6, part * 6 + 6)]
        spark.createDataFrame(rows, "event_id long, ts timestamp, kind string, value double").coalesce(1).write.mode("append").parquet(path)
    events = spark.readStream.schema("event_id long, ts timestamp, kind string, value double").option("maxFilesPerTrigger", 1).parquet(path)
    bars = stream_bars(events, "1h", F.col("value"), F.lit(1.0), F.col("kind"))
    q = bars.writeStream.format("memory").queryName("bars").outputMode("append").option("checkpointLocation", str(tmp_path / "c1")).start()
    q.processAllAvailable()
    q.stop()
    got = spark.sql("select * from bars order by ts").collect()
    assert [(r.open, r.close, r.volume) for r in got] == [(0.0, 2.0, 3.0), (3.0, 5.0, 3.0), (6.0, 8.0, 3.0)]  # the last hour has not closed

    q = stream_ewm(events.select(F.col("kind").alias("series_id"), "ts", "value"), "value", 0.5).writeStream.format("memory").queryName("ewm").outputMode("append").option("checkpointLocation", str(tmp_path / "c2")).start()
    q.processAllAvailable()
    q.stop()
    value = 0.0
    for r in spark.sql("select * from ewm order by ts").collect():
        value = r.value if r.value == 0.0 else 0.5 * value + 0.5 * r.value
        assert r.ewm == pytest.approx(value)


def test_streams_equal_batches(spark, tmp_path):
    """Bars in batches of ten give what one pass gives, gaps and two series included."""
    rng, path = np.random.default_rng(5), str(tmp_path / "bars")
    schema = "series_id string, ts timestamp, close double, high double, low double, x double, signal int"
    close = {s: 100 * np.exp(np.cumsum(rng.normal(0, 0.01, 60))) for s in "ab"}
    for part in range(6):
        rows = []
        for i in range(part * 10, part * 10 + 10):
            for s, c in close.items():
                rows.append((s, dt.datetime(2024, 1, 1) + dt.timedelta(hours=i), float(c[i]), float(c[i] * 1.006), float(c[i] * 0.994), None if rng.random() < 0.3 else float(rng.normal()), int(rng.integers(-1, 2))))
        spark.createDataFrame([rows[i] for i in rng.permutation(len(rows))], schema).coalesce(1).write.mode("append").parquet(path)
    bars, stream = spark.read.parquet(path), spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    cfg, risk, policy = BacktestConfig(min_hold_bars=2), RiskConfig(2.0, 0.02, 0.01), PolicyConfig((3,), (), 15, 4, 2)
    wanted = {
        "means": (ewm(bars.select("series_id", "ts", "x"), {"m": ("x", 0.3)}), stream_ewm(stream, "x", 0.3, "m")),
        "holds": (min_hold(bars, 4), stream_min_hold(stream, 4)),
        "tested": (backtest.run(bars, cfg, risk, policy), stream_backtest(stream, cfg, risk, policy)),
    }
    for name, (batch, live) in wanted.items():
        q = live.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).start()
        q.processAllAvailable()
        q.stop()
        order = lambda df, b=batch: [tuple(r) for r in df.select(*b.columns).orderBy("series_id", "ts").collect()]
        got, want = order(spark.table(name)), order(batch)
        assert len(got) == len(want) == 120
        for g, w in zip(got, want, strict=True):
            assert all(a == b or a == pytest.approx(b, rel=1e-9) for a, b in zip(g, w, strict=True)), name
