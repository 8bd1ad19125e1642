"""Which tokens do two sets or more have, over all sets of the input, without a group that grows with a hot token.

Tokens are 64-bit hashes. A batch of sets (a few million tokens of one task) counts its own tokens first and sends each
distinct token once to the bucket that counts it; what several sets of the batch share stays with the batch. A
bucket answers every batch with those tokens of the batch that two sets or more have, and their counts. A token of a
third of all rows is thus one entry a batch. ``coarse`` tokens carry the bucket and 32 bits of the hash: the number of
buckets follows the input, so the share of tokens that meet by chance stays the same at any size, and tokens that
meet only make a count larger.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from barwright.llm.textarrays import U64, binary, mix, segments

MANY = 65535
#: Sets of a batch at most: their numbers take two bytes.
MOST_SETS = MANY - 1
_WIRE = "bucket long, batch long, tok binary, idx binary, cnt binary, ids binary, sizes binary"
_NAMES = ["bucket", "batch", "tok", "idx", "cnt", "ids", "sizes"]

#: Pairs of 64-bit numbers that name the sets of a batch, the sets' sizes, and their tokens one set after another.
Batch = tuple[np.ndarray, np.ndarray, np.ndarray]


def coarse(tok: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket in the high 32 bits, the low 32 bits of the token below; ordered as tokens are, up to the low bits."""
    return ((tok >> U64(32)) * U64(buckets) >> U64(32)) << U64(32) | tok & U64(0xFFFFFFFF)


def _name(ids: np.ndarray, sizes: np.ndarray) -> int:
    """A number for a batch, by the ids and sizes of all its sets in their order: a repeated task gives the same."""
    each = np.arange(1, len(ids) + 1, dtype=np.uint64)
    for column in (*ids.T, sizes):
        each = mix(mix(each) ^ column.astype(np.int64).view(np.uint64))
    return int(mix(each).sum() >> U64(1))


def _send(groups: Iterable[Batch], buckets: int) -> Iterator[pa.RecordBatch]:
    for ids, sizes, toks in groups:
        batch = _name(ids, sizes)
        idx = segments(sizes).astype(np.uint16)
        toks = coarse(toks, buckets)
        order = np.argsort(toks, kind="stable")
        toks, idx = toks[order], idx[order]
        new = np.flatnonzero(np.concatenate([[True], toks[1:] != toks[:-1]])) if len(toks) else np.zeros(0, np.int64)
        cnt = np.diff(np.append(new, len(toks))).astype(np.uint32)
        many = cnt > 1
        kept = np.repeat(many, cnt)
        tok, who = toks[new], np.where(many, MANY, idx[new]).astype(np.uint16)
        cuts = np.searchsorted((tok >> U64(32)).astype(np.int64), np.arange(buckets + 1))
        full = np.flatnonzero(np.diff(cuts))
        spans = [slice(cuts[b], cuts[b + 1]) for b in full]
        none = pa.array([b""] * len(spans), pa.binary())
        low = (tok & U64(0xFFFFFFFF)).astype(np.uint32)
        yield pa.RecordBatch.from_arrays(
            [pa.array(full.astype(np.int64)), pa.array(np.full(len(full), batch)), binary(low[s] for s in spans), binary(who[s] for s in spans), binary(cnt[s][many[s]] for s in spans), none, none], _NAMES
        )
        # the batch's own part passes through a bucket drawn by its number
        yield pa.RecordBatch.from_arrays(
            [pa.array([-1 - batch % buckets]), pa.array([batch]), binary([toks[kept]]), binary([idx[kept]]), pa.array([b""], pa.binary()), binary([ids]), binary([sizes.astype(np.int64)])], _NAMES
        )


def _count(table: pa.Table) -> pa.Table:
    """One bucket: to every batch, those of its tokens that two sets or more have, with their counts."""
    bucket = table.column("bucket")[0].as_py()
    if bucket < 0:
        return table
    get = lambda name, kind: [np.frombuffer(x.as_py(), kind) for x in table.column(name)]
    toks, idx, cnts = get("tok", np.uint32), get("idx", np.uint16), get("cnt", np.uint32)
    each = []
    for i, c in zip(idx, cnts, strict=True):
        each.append(full := np.ones(len(i), np.int64))
        full[i == MANY] = c
    tok = np.concatenate(toks)
    order = np.argsort(tok, kind="stable")
    ranked = tok[order]
    new = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
    df = np.empty(len(tok), np.int64)
    df[order] = np.repeat(np.add.reduceat(np.concatenate(each)[order], new), np.diff(np.append(new, len(tok))))
    at, out = 0, []
    for row, (t, i) in enumerate(zip(toks, idx, strict=True)):
        own = df[at : at + len(t)]
        at += len(t)
        keep = own > 1
        if keep.any():
            out.append((row, (U64(bucket) << U64(32)) | t[keep].astype(np.uint64), i[keep], np.minimum(own[keep], 2**32 - 1).astype(np.uint32)))
    none = pa.array([b""] * len(out), pa.binary())
    return pa.Table.from_arrays(
        [pa.array(np.full(len(out), bucket)), table.column("batch").combine_chunks().take(pa.array([r[0] for r in out], pa.int64())), binary(r[1] for r in out), binary(r[2] for r in out), binary(r[3] for r in out), none, none], _NAMES
    )


def _answered(table: pa.Table):
    """One batch: ids, sizes, and the shared tokens as (set number, coarse token, count).

    Batches of the same sets in the same order are one batch: their rows are equal, and one of each bucket is read.
    """
    ids, (sizes, m_tok, m_idx) = np.zeros((0, 2), np.int64), (np.zeros(0, kind) for kind in (np.int64, np.uint64, np.uint16))
    toks, idx, df = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint16)], [np.zeros(0, np.uint32)]
    seen, own = set(), set()
    for i in range(table.num_rows):
        row = {c: table.column(c)[i].as_py() for c in ("bucket", "tok", "idx", "cnt", "ids", "sizes")}
        if row["bucket"] < 0:
            own.add((row["ids"], row["sizes"]))
            if len(own) > 1:
                raise ValueError("two batches of different sets have one name")
        if row["bucket"] in seen:
            continue
        seen.add(row["bucket"])
        if row["bucket"] < 0:
            ids, sizes = np.frombuffer(row["ids"], np.int64).reshape(-1, 2), np.frombuffer(row["sizes"], np.int64)
            m_tok, m_idx = np.frombuffer(row["tok"], np.uint64), np.frombuffer(row["idx"], np.uint16)
        else:
            toks.append(np.frombuffer(row["tok"], np.uint64))
            idx.append(np.frombuffer(row["idx"], np.uint16))
            df.append(np.frombuffer(row["cnt"], np.uint32))
    tok, who, df = (np.concatenate(x) for x in (toks, idx, df))
    order = np.argsort(tok, kind="stable")
    tok, who, df = tok[order], who[order], df[order]
    one = who != MANY
    m_df = df[~one][np.searchsorted(tok[~one], m_tok)] if len(m_tok) else np.zeros(0, np.uint32)
    return ids, sizes, np.concatenate([who[one], m_idx]).astype(np.int64), np.concatenate([tok[one], m_tok]), np.concatenate([df[one], m_df])


def shared_tokens(rows: DataFrame, batches: Callable[[Iterator[pa.RecordBatch]], Iterator[Batch]], buckets: int, use: Callable[..., pa.Table], schema: str) -> DataFrame:
    """Apply ``use(ids, sizes, who, tok, count)`` to the shared tokens of every batch that ``batches`` makes of ``rows``.

    ``who`` numbers the sets of the batch, ``tok`` is coarse; tokens of one set only are left out.
    """
    sent = rows.mapInArrow(lambda it: _send(batches(it), buckets), _WIRE)
    counted = sent.groupBy("bucket").applyInArrow(_count, _WIRE)
    return counted.groupBy("batch").applyInArrow(lambda table: use(*_answered(table)), schema)
