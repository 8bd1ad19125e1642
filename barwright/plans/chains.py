"""State machines over long series: blocks run at once, each from a guess at the state in which the one before ends.

In the first round every block starts anew. Where a block's end is not what the next one started from, that one runs again from it; this
is repeated until nothing differs, which is then what one pass over the series gives. A state that forgets (a position that ends, a
holding time that is over) makes two runs of a block meet, so that two or three rounds do; at worst there are as many
as blocks, since each round makes one more block of a series right for good.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barwright.functions.sequential import _emitter, _runs
from barwright.plans.blocks import BLOCK, PLACE
from barwright.plans.shared import stage

_ENTRY = "__bw_entry"


def _same(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    on = left[BLOCK] == right[BLOCK]
    for k in keys:
        on = on & left[k].eqNullSafe(right[k])
    return on


def _in_order(rows: DataFrame, entries: DataFrame | None, keys: list[str]) -> DataFrame:
    """Blocks in order, the state to start from as a row before a block's rows: one exchange."""
    rows = rows.withColumn(_ENTRY, F.lit(None).cast("binary"))
    if entries is not None:
        rows = rows.unionByName(entries.select(*keys, BLOCK, F.lit(-1).cast("long").alias(PLACE), _ENTRY), allowMissingColumns=True)
    return rows.repartition(*keys, BLOCK).sortWithinPartitions(*keys, BLOCK, PLACE)


def _blocks(batches: Iterator[pa.RecordBatch], keys: list[str], start: Callable[[], object]) -> Iterator[tuple]:
    """(key, block, entry, state, rows or None) of each piece of a block, and once more without rows when it ends."""
    now, state, entry = None, None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        at = _runs(batch, [*keys, BLOCK])
        for a, b in zip(at, at[1:], strict=False):
            own = tuple(batch.column(k)[a].as_py() for k in (*keys, BLOCK))
            if state is None or own != now:
                if state is not None:
                    yield now, entry, state, None
                now, state, entry = own, start(), None
            if batch.column(PLACE)[a].as_py() == -1:
                if (entry := batch.column(_ENTRY)[a].as_py()) is not None:
                    state.take_over(pickle.loads(entry))
                a += 1
            if a < b:
                yield now, entry, state, batch.slice(a, b - a).to_pandas()
    if state is not None:
        yield now, entry, state, None


def chained(df: DataFrame, keys: list[str], start: Callable[[], object], schema: str) -> tuple[DataFrame, DataFrame]:
    """What ``sequential.scan`` gives for a laid-out frame (own rows), and a row for each block: (keys, block, totals).

    ``start()`` makes a callable as there, with ``hand_over()`` (a picklable value that says all that later rows depend on) and
    ``take_over(value)``; if it has ``totals()``, an array of what the block adds from its own beginning, that is in the second frame.
    """
    kinds = dict(df.dtypes)
    ends = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + f", `{BLOCK}` long, `{_ENTRY}` binary, exit binary, totals array<double>"
    target, _ = _emitter(ends)
    _, emit = _emitter(schema)
    rows = stage(df, "chain")

    def states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for now, entry, state, frame in _blocks(batches, keys, start):
            if frame is not None:
                state(frame)
                continue
            totals = state.totals() if hasattr(state, "totals") else None
            cells = [*now, entry, pickle.dumps(state.hand_over()), totals]
            yield pa.RecordBatch.from_arrays([pa.array([x], kind) for x, kind in zip(cells, target.types, strict=True)], schema=target)

    def results(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, state, frame in _blocks(batches, keys, start):
            if frame is not None:
                yield emit(state(frame))

    line = Window.partitionBy(*keys).orderBy(BLOCK)
    found = stage(_in_order(rows, None, keys).mapInArrow(states, ends), "chain-ends")
    while True:
        due = found.withColumn("due", F.lag("exit").over(line))
        due = stage(due.where(F.col("due").isNotNull() & ~F.col("due").eqNullSafe(F.col(_ENTRY))).select(*keys, BLOCK, F.col("due").alias(_ENTRY)), "chain-due")
        if due.isEmpty():
            break
        again = rows.join(due.drop(_ENTRY), _same(rows, due, keys), "left_semi")
        new = _in_order(again, due, keys).mapInArrow(states, ends)
        found = stage(found.join(due, _same(found, due, keys), "left_anti").unionByName(new), "chain-ends")
    done = _in_order(rows, found, keys).mapInArrow(results, schema)
    if PLACE in done.columns:
        done = done.withMetadata(PLACE, df.schema[PLACE].metadata)
    return done, found.select(*keys, BLOCK, "totals")
