"""Keyed passes in order over streams whose bars come late, out of order, or not at all for a while.

Bars wait in a list state until the watermark has passed them; a timer then hands them on in order of time, whatever
batch they came in. So a stream gives what one pass over all bars gives, and a query that is stopped and started again
goes on from its checkpoint. What a series carries on is a value state, in typed columns and JSON.

What becomes of a bar: on time or late by less than ``late``, it takes its place in order. Later than that, Spark drops
it before it gets here, and counts it in the query's progress (numRowsDroppedByWatermark). Bars newer than the watermark wait
for the next batch. A bar more than ``gap`` after the one before begins a session, with a new state; a series of which nothing
came for so long has its state deleted by a timer, which changes no result, since its next bar begins a session anyway.
"""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from barwright.plans.shared import new_path

AT, SESSION = "__bw_at", "session"
PROVIDER, ROCKS = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _packed(frame: pd.DataFrame) -> bytes:
    batch = pa.RecordBatch.from_pandas(frame, preserve_index=False)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _unpacked(data: bytes) -> pd.DataFrame:
    return pa.ipc.open_stream(data).read_pandas()


def _held(now: object) -> str:
    """The attributes that ``KEPT`` names, as JSON."""
    plain = lambda x: list(x) if isinstance(x, deque) else x.item()
    return json.dumps({name: getattr(now, name) for name in now.KEPT}, default=plain)


def _restored(now: object, held: str) -> object:
    for name, value in json.loads(held).items():
        setattr(now, name, deque(value) if isinstance(getattr(now, name), deque) else value)
    return now


class InOrder(StatefulProcessor):
    """One series (or series and strategy): bars that wait, and the state after the last bar handed on."""

    def __init__(self, start: Callable[[], object], columns: list[str], names: list[str], gap: int | None):
        self.start, self.columns, self.names, self.gap = start, columns, names, gap

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "first long, bars binary")
        self.state = handle.getValueState("state", "held string, last long, session long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        first = None
        for frame in rows:
            if len(frame):
                frame = frame.set_axis(self.columns, axis=1)  # (names that begin with _ do not get here)
                own = int(frame[AT].min())
                self.waiting.appendValue((own, _packed(frame)))
                first = own if first is None else min(first, own)
        if first is not None:
            self._wake(first)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now = timerValues.getCurrentWatermarkInMs() * 1000
        held = list(self.waiting.get()) if self.waiting.exists() else []
        if any(first <= now for first, _ in held):
            bars = pd.concat([_unpacked(bytes(data)) for _, data in held]).sort_values(AT, kind="stable", ignore_index=True)
            ready = int(np.searchsorted(bars[AT].to_numpy(), now, "right"))
            rest = bars.iloc[ready:]
            if len(rest):
                first = int(rest[AT].iloc[0])
                self.waiting.put([(first, _packed(rest))])
                self._wake(first)
            else:
                self.waiting.clear()
            yield self._pass(bars.iloc[:ready])
        elif self.gap is not None and self.state.exists() and self.state.get()[1] + self.gap < now:
            self.state.clear()

    def close(self) -> None:
        pass

    def _wake(self, at: int) -> None:
        """A timer in the first millisecond at which the watermark has passed ``at``."""
        self.handle.registerTimer(-(-at // 1000))

    def _pass(self, bars: pd.DataFrame) -> pd.DataFrame:
        at = bars[AT].to_numpy()
        held, last, session = self.state.get() if self.state.exists() else (None, None, None)
        fresh = np.zeros(len(at), bool)
        if self.gap is not None:
            fresh[1:] = np.diff(at) > self.gap
            fresh[0] = last is not None and at[0] - last > self.gap
        cuts = sorted({0, *np.flatnonzero(fresh).tolist(), len(at)})
        now, out = (self.start() if held is None else _restored(self.start(), held)), []
        if session is None:
            session = int(at[0])
        for a, b in zip(cuts, cuts[1:], strict=False):
            if fresh[a]:
                now, session = self.start(), int(at[a])
            out.append(now(bars.iloc[a:b].reset_index(drop=True)).assign(**{SESSION: session}))
        self.state.update((_held(now), int(at[-1]), session))
        if self.gap is not None:
            self._wake(int(at[-1]) + self.gap + 1000)
        return pd.concat(out)[self.names]


def in_order(rows: DataFrame, keys: list[str], start: Callable[[], object], schema: str, late: str, gap: str | None = None) -> DataFrame:
    """Run what ``start()`` makes over each key's rows in order of ``ts``, as ``sequential.scan`` does for a table.

    ``late`` is how far behind the newest bar one may come. With a ``gap`` (such as "6 hours") bars that come more than it
    after the one before begin anew, and a column ``session`` says when the bar's session began. Rows without a ts are left
    out: they have no place. A null key is a series. State is kept by RocksDB: see ``written``.
    """
    made = start()
    if not hasattr(made, "KEPT"):
        raise TypeError(f"{type(made).__name__} does not say what it keeps")
    names = [c.name for c in rows.sparkSession.createDataFrame([], schema).schema]
    if gap is not None and SESSION in names:
        raise ValueError(f"a column {SESSION} is in the way")
    span = None if gap is None else pd.Timedelta(gap) // pd.Timedelta(microseconds=1)
    rows = rows.where("ts is not null").withColumn(AT, F.unix_micros("ts")).withWatermark("ts", late)
    if gap is not None:
        names, schema = [*names, SESSION], f"{schema}, {SESSION} long"
    columns = rows.columns
    out = rows.groupBy(*keys).transformWithStateInPandas(InOrder(start, columns, names, span), schema, "append", "eventTime")
    return out if gap is None else out.withColumn(SESSION, F.timestamp_micros(SESSION))


def start_query(df: DataFrame, path: str, checkpoint: str):
    """A query that appends what is there of the stream to a Parquet table and ends; with the same checkpoint, goes on."""
    conf = df.sparkSession.conf
    before = conf.get(PROVIDER, None)
    conf.set(PROVIDER, ROCKS)
    try:
        return df.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        if before is None:
            conf.unset(PROVIDER)
        else:
            conf.set(PROVIDER, before)


def written(df: DataFrame, name: str) -> DataFrame:
    """What the stream gives of all there is now, as a table in the shared folder."""
    spark: SparkSession = df.sparkSession
    path = new_path(spark, name)
    start_query(df, path, new_path(spark, f"{name}-checkpoint")).awaitTermination()
    return spark.read.schema(df.schema).parquet(path)
