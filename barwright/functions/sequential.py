"""Order-dependent passes over series.

A ``scan`` brings rows together by key, sorted within partitions; a task reads them batch by batch with a small state, so a
long series needs no more memory than a short one. A worker that is lost costs its partitions, which Spark computes again
from their beginning. ``means`` are exponential means as columns: each row is an affine map of the mean before it,
and running products and sums of these maps over stretches, in which no product leaves the range of doubles, give all
means without a loop, for whole series or for blocks of one.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _runs(batch: pa.RecordBatch, keys: list[str]) -> list[int]:
    """Where in a batch another key begins, with 0 and the batch's length."""
    new = np.zeros(max(batch.num_rows - 1, 0), bool)
    for key in keys:
        column = batch.column(key)
        a, b = column[:-1], column[1:]
        differs = pc.or_kleene(pc.not_equal(a, b).fill_null(False), pc.xor(pc.is_null(a), pc.is_null(b)))
        new |= differs.to_numpy(zero_copy_only=False)
    return [0, *(np.flatnonzero(new) + 1).tolist(), batch.num_rows]


def _emitter(schema: str) -> tuple[pa.Schema, Callable[[pd.DataFrame], pa.RecordBatch]]:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    target = to_arrow_schema(_parse_datatype_string(schema))
    return target, lambda frame: pa.RecordBatch.from_pandas(frame[target.names], schema=target, preserve_index=False)


def scan(df: DataFrame, keys: list[str], order: list[str], start: Callable[[], object], schema: str, last: Callable | None = None) -> DataFrame:
    """Run a stateful function over every key's rows in order.

    ``start()`` makes a callable for a new key; it is given the key's next rows as a pandas frame, in order, as often as
    there are batches, and returns a frame with the columns of ``schema`` (or None). ``last`` (state, keys) may give a
    closing frame when the key ends.
    """
    _, emit = _emitter(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            frame, at = batch.to_pandas(), _runs(batch, keys)
            for a, b in zip(at, at[1:], strict=False):
                own = tuple(batch.column(k)[a].as_py() for k in keys)
                if state is None or own != now:
                    if state is not None and last is not None and (out := last(state, now)) is not None:
                        yield emit(out)
                    now, state = own, start()
                out = state(frame.iloc[a:b])
                if out is not None and len(out):
                    yield emit(out)
        if state is not None and last is not None and (out := last(state, now)) is not None:
            yield emit(out)

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


class Ewm:
    """Exponential means of columns without adjustment; gaps count as rows that passed."""

    KEPT = ("state",)

    def __init__(self, specs: dict[str, tuple[str, float]]):
        self.specs, self.state = specs, {}

    def __call__(self, frame: pd.DataFrame) -> pd.DataFrame:
        new = {}
        for out, (column, alpha) in self.specs.items():
            x = frame[column].astype("float64")
            value, gap = self.state.get(out, (np.nan, 0))
            lead = [value, *[np.nan] * gap] if value == value else []
            y = pd.Series(np.concatenate([lead, x.to_numpy()])).ewm(alpha=alpha, adjust=False).mean().to_numpy()[len(lead) :]
            seen = np.flatnonzero(x.notna().to_numpy())
            if len(seen):
                self.state[out] = (y[-1], len(x) - 1 - seen[-1])
            elif value == value:
                self.state[out] = (value, gap + len(x))
            new[out] = y
        return frame.assign(**new)


class Medians:
    """Medians of the last n rows, without a value unless all n have one: name -> (column, n).

    A window in order, with one insertion and one removal a row (log n steps); the last n - 1 values are carried on.
    """

    def __init__(self, specs: dict[str, tuple[str, int]]):
        self.specs, self.tails = specs, {out: np.empty(0) for out in specs}

    def __call__(self, frame: pd.DataFrame) -> pd.DataFrame:
        new, top = {}, np.finfo("float64").max
        for out, (column, n) in self.specs.items():
            tail = self.tails[out]
            x = np.concatenate([tail, frame[column].astype("float64").to_numpy()])
            y = pd.Series(np.clip(x, -top, top)).rolling(n, min_periods=n).median().to_numpy()[len(tail) :]  # (infinite values would count as missing)
            new[out] = np.where(np.abs(y) > top / 4, np.copysign(np.inf, y), y)
            self.tails[out] = x[max(len(x) - n + 1, 0) :]
        return frame.assign(**new)


def rolling_medians(df: DataFrame, specs: dict[str, tuple[str, int]]) -> DataFrame:
    """``df`` (series_id, ts, ...) with the medians of the last n rows for each of ``specs``: name -> (column, n).

    NULL until n rows have a value; 0 midway between the two infinities. A scan of each series; of a laid-out frame, of each block, which has the n - 1 rows before
    it already or gets them here: own rows come back.
    """
    from barwright.plans import blocks

    if not blocks.is_laid_out(df):
        return scan(df, ["series_id"], ["ts"], lambda: Medians(specs), _widened(df, specs))
    df = blocks.halo(blocks.own(df), max(n for _, n in specs.values()) - 1)
    return blocks.own(block_medians(df, specs))


def block_medians(df: DataFrame, specs: dict[str, tuple[str, int]]) -> DataFrame:
    """``rolling_medians`` of a laid-out frame whose blocks have their rows before; right for own rows."""
    from barwright.plans import blocks

    marks = df.schema[blocks.PLACE].metadata
    got = scan(df, [blocks.SERIES, blocks.BLOCK], [blocks.PLACE], lambda: Medians(specs), _widened(df, specs))
    return got.withMetadata(blocks.PLACE, marks)


def _widened(df: DataFrame, more: dict) -> str:
    return ", ".join(f"`{n}` {t}" for n, t in df.dtypes if n not in more) + "".join(f", `{n}` double" for n in more)


#: Decay (in powers of e) of a stretch at most; means whose rates differ more than ``ALIKE`` times do not share stretches.
DECAY, ALIKE = 600.0, 12.0


def _together(specs: dict[str, tuple[str, float]]) -> list[tuple[str, float, list[str]]]:
    """Means that share their stretches: (input, the quickest one's alpha, names), quickest first."""
    groups: list[tuple[str, float, list[str]]] = []
    for name, (column, alpha) in sorted(specs.items(), key=lambda s: (s[1][0], -s[1][1], s[0])):
        if groups and groups[-1][0] == column and math.log1p(-groups[-1][1]) / math.log1p(-alpha) <= ALIKE:
            groups[-1][2].append(name)
        else:
            groups.append((column, alpha, [name]))
    return groups


def means(df: DataFrame, specs: dict[str, tuple[str, float]], keys: list[str], maps: bool = False) -> DataFrame:
    """``df`` with the exponential means ``specs`` over its rows of each of ``keys``, in the order of ``ts``.

    With ``maps`` the mean is taken as a function of its first value y, m = v + p * y: columns ``v_...`` and ``p_...``.

    A row that follows k rows after the last one with a value makes of a mean m: (w * m + alpha * x) / (w + alpha), w = (1 - alpha) ** k.
    A stretch ends where its maps have decayed by ``DECAY``. The mean at a row is what its stretch gives from nothing, plus what was
    before it, times the stretch's decay up to the row; of that, one stretch is enough, since an older one weighs less than e ** -50.
    """
    by = ", ".join(f"`{k}`" for k in keys)
    line = f"partition by {by} order by ts"
    upto, before = f"over ({line} rows unbounded preceding)", f"over ({line} rows between unbounded preceding and 1 preceding)"
    inputs = {column: i for i, column in enumerate(dict.fromkeys(column for column, _ in specs.values()))}
    kept = df.columns
    # (SQL text: one call a step, where columns would be thousands)
    df = df.selectExpr("*", f"row_number() over ({line}) as __bw_at", *[f"cast(`{x}` as double) as __bw_x{i}" for x, i in inputs.items()])
    df = df.selectExpr("*", *[f"__bw_at - last(if(__bw_x{i} is not null, __bw_at, null), true) {before} as __bw_k{i}" for i in inputs.values()])
    number = {name: i for i, name in enumerate(specs)}
    steps: list[str] = []
    for name, (column, alpha) in specs.items():
        i, n = inputs[column], number[name]
        x, k, w = f"__bw_x{i}", f"__bw_k{i}", f"pow({1.0 - alpha!r}D, __bw_k{i})"
        steps.append(f"if({x} is null or {k} is null, 1D, greatest({w} / ({w} + {alpha!r}D), 1e-300D)) as __bw_a{n}")
        steps.append(f"if({x} is null, 0D, if({k} is null, {'0D' if maps else x}, {alpha!r}D * {x} / ({w} + {alpha!r}D))) as __bw_b{n}")
    df = df.selectExpr("*", *steps)
    groups = [(g, number[names[0]], [number[n] for n in names]) for g, (_, _, names) in enumerate(_together({n: s for n, s in specs.items() if s[1] < 1.0}))]
    df = df.selectExpr("*", *[f"floor(sum(-ln(__bw_a{quick})) {upto} / {DECAY}D) as __bw_s{g}" for g, quick, _ in groups])
    stretch = {g: f"partition by {by}, __bw_s{g} order by ts" for g, _, _ in groups}
    df = df.selectExpr("*", *[f"row_number() over ({stretch[g]}) = 1 as __bw_f{g}" for g, _, _ in groups])
    running = lambda x, *also: F.product(F.expr(x)).over(Window.partitionBy(*keys, *also).orderBy("ts").rowsBetween(Window.unboundedPreceding, 0))
    df = df.select("*", *[running(f"if(__bw_f{g}, 1D, __bw_a{n})", f"__bw_s{g}").alias(f"__bw_q{n}") for g, _, own in groups for n in own])
    df = df.selectExpr("*", *[f"__bw_q{n} * sum(__bw_b{n} / __bw_q{n}) over ({stretch[g]} rows unbounded preceding) as __bw_v{n}" for g, _, own in groups for n in own])
    df = df.selectExpr("*", *[f"if(__bw_f{g}, __bw_a{n} * lag(__bw_v{n}) over ({line}), null) as __bw_c{n}" for g, _, own in groups for n in own])
    out: list[str] = []
    for name, (column, alpha) in specs.items():
        x, n = f"__bw_x{inputs[column]}", number[name]
        seen = f"count({x}) {upto}"
        if alpha >= 1.0:
            value = f"last({x}, true) {upto}"
            value = f"if({seen} > 1, {value}, 0D)" if maps else value
        else:
            value = f"__bw_v{n} + __bw_q{n} * coalesce(last(__bw_c{n}, true) {upto}, 0D)"
        out.append(f"if({seen} > 0, {value}, null) as `{'v_' if maps else ''}{name}`")
    # (the first value has a = 1, and a quickest mean 0 for all later ones)
    decay = [F.when(F.col(f"__bw_x{inputs[column]}").isNotNull() | (running(f"__bw_a{number[name]}") >= 0), running(f"__bw_a{number[name]}")).alias(f"p_{name}") for name, (column, _) in specs.items()] if maps else []
    return df.select(*[F.col(f"`{k}`") for k in kept], *map(F.expr, out), *decay)


def ewm(df: DataFrame, specs: dict[str, tuple[str, float]], medians: dict[str, tuple[str, int]] | None = None) -> DataFrame:
    """``df`` (series_id, ts, ...) with a column for each of ``specs``: name -> (input column, alpha).

    A value repeats over missing inputs and weighs less the more rows have passed, as many means as there are specs in one pass.
    NULL before the first input. A laid-out frame (own rows) is done by columns, block by block; else a series is one task's scan,
    which costs a fraction of the plan where series are short. Such a scan may take ``rolling_medians`` along.
    """
    from barwright.plans import blocks

    if blocks.is_laid_out(df):
        got = blocks.ewm(df, specs)
        return rolling_medians(got, medians) if medians else got

    def start() -> Callable[[pd.DataFrame], pd.DataFrame]:
        means_, medians_ = Ewm(specs), Medians(medians or {})
        return lambda frame: medians_(means_(frame))

    return scan(df, ["series_id"], ["ts"], start, _widened(df, specs | (medians or {})))


def span(n: int) -> float:
    return 2.0 / (n + 1)


def wilder(n: int) -> float:
    return 1.0 / n
