"""Packing by concatenate and cut: all documents' ids in one line, cut into windows of a fixed length.

Two passes: ids are written once with the running total of their task, the tasks' totals give every document's place
in the line, and each document then cuts itself at the window bounds. No shuffle, no sort; only the last
window can be shorter.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from barwright.llm.textarrays import give_back
from barwright.llm.tokens import as_ids, tokenize, with_starts
from barwright.plans.shared import stage

#: Ids of the rows that are cut at a time, about: a worker holds no more of them at once (a longer row stands alone).
MOST_IDS = 1 << 18
PIECES = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


def _some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of rows with about ``MOST_IDS`` ids."""
    for batch in batches:
        ends = np.cumsum(batch.column("n_tokens").to_numpy())
        cuts = [0, *(np.flatnonzero(np.diff(ends // MOST_IDS)) + 1), len(ends)]
        yield from (batch.slice(int(a), int(b - a)) for a, b in itertools.pairwise(cuts) if b > a)
    give_back()


def _cut(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _some(batches):
            n, at = (batch.column(c).to_numpy() for c in ("n_tokens", "start"))
            first, last = at // length, (at + n - 1) // length
            count = last - first + 1
            row = np.repeat(np.arange(len(n)), count)
            window = first[row] + np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            begin = np.maximum(window * length, at[row])
            end = np.minimum((window + 1) * length, (at + n)[row])
            start = begin - at[row]
            ids, out, own, last_row = batch.column("ids"), [], None, -1
            width = batch.column("width").to_numpy()
            for r, s, m in zip(row, start, end - begin, strict=True):
                if r != last_row:
                    own, last_row = as_ids(ids[int(r)].as_buffer(), width[r]).astype("<u4"), r
                out.append(own[s : s + m].tobytes())
            doc = batch.column("doc_id").take(pa.array(row))
            yield pa.RecordBatch.from_arrays([doc, pa.array(start), pa.array(end - begin), pa.array(n[row]), pa.array(window), pa.array(begin - window * length), pa.array(out, pa.binary())], ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"])

    return run


def pack(docs: DataFrame, length: int = 2048, path: str | None = None, end_id: int = 1) -> DataFrame:
    """Pieces of ``docs(doc_id, text)`` in sequences of ``length`` ids: (doc_id, start, length, doc_tokens, sequence_id, offset, ids).

    ``start`` counts the document's ids before the piece, ``offset`` the sequence's; ``ids`` are little-endian
    unsigned 32-bit integers. Every sequence but the last is full. A null or empty text has its end id as its one
    piece. Repeated rows, and a null doc_id, are packed like any other. Other columns are not looked at. No rows, no pieces.
    """
    tokens = with_starts(stage(tokenize(docs, path, end_id), "tokens"))
    return tokens.select("doc_id", "start", "n_tokens", "width", "ids").mapInArrow(_cut(length), PIECES)
