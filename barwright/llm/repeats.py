"""Removal of repeated byte strings by longest-previous-factor arrays, over all documents.

A string of ``width`` bytes that a document shares with an earlier one (a smaller doc_id) is removed from the later
one. A suffix array of the whole corpus would not spread over a cluster, so the suffixes that can match are first
brought together, and each bucket of them has its own arrays:

1. Of every window of ``width`` bytes, the smallest hash among its k-byte strings is its anchor. Equal windows have
   equal anchors, and neighbouring windows mostly share theirs: a document becomes a few runs of windows.
2. Anchors are counted over all documents (``shared_tokens``). A run whose anchor no other document has cannot match.
3. The remaining runs, as short pieces of text, go to buckets by anchor. Equal pieces of a batch travel once, under
   their smallest doc_id and with all places that this document has them at; the places of later documents are
   settled there. A run whose anchor is very frequent goes by its windows instead, one by one, so that a bucket's
   group does not grow with a hot string.
4. A bucket puts the suffixes of its pieces in order, with the lengths that neighbours have in common. The previous and the
   next suffix of a smaller document give each suffix its longest previous factor; where that has ``width`` bytes,
   these bytes go.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barwright.llm.shared_tokens import MOST_SETS, coarse, shared_tokens
from barwright.llm.textarrays import _BYTE, _STEP, U64, Texts, binary, mix, powers, slices
from barwright.plans.shared import stage

#: Anchors of a batch; bytes of text behind a bucket (about); documents from which an anchor is frequent; windows of a piece.
BATCH_ANCHORS, BUCKET_BYTES, FREQUENT, PIECE = 500_000, 4 << 20, 4096, 512
#: Bytes of text that are hashed at once, for anchors and for pieces.
SLICE, SENT = 1 << 20, 4 << 20
#: Slots by which ids that stand more than once are known.
SLOTS = 1 << 17
_BASE = 0x9FB21C651E98DF25 | 1
_INVERSE = pow(_BASE, -1, 2**64)
_cache: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    if len(_cache.get(base, ())) < n:
        _cache[base] = powers(base, 1 << max(16, int(n - 1).bit_length()))
    return _cache[base][:n]


class Rolling:
    """Hashes of any substrings of ``data``, by prefix sums."""

    def __init__(self, data: np.ndarray):
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTE[data] * _power(_BASE, len(data)), out=self.sums[1:])
        self.inverse = _power(_INVERSE, len(data) + 1)

    def all(self, k: int) -> np.ndarray:
        n = max(0, len(self.sums) - k)
        return mix((self.sums[k:] - self.sums[:n]) * self.inverse[:n])

    def some(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * self.inverse[starts] + (ends - starts).astype(np.uint64))


def runs(t: Texts, width: int, k: int) -> tuple[Rolling, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one anchor: (hashes, first window, last window, text number, anchor)."""
    rolling, n, none = Rolling(t.data), len(t.data), np.zeros(0, np.int64)
    if n < width:
        return rolling, none, none, none, np.zeros(0, np.uint64)
    low, span, reach = rolling.all(k), 1, width - k + 1
    while span < reach:  # the minimum over reach neighbours, by doubling
        step = min(span, reach - span)
        low = np.minimum(low[: len(low) - step], low[step:])
        span += step
    lens = np.diff(t.offs)
    ok = np.zeros(n - width + 2, np.int32)  # a window must not cross into the next text
    has = lens >= width
    np.add.at(ok, t.offs[:-1][has], 1)
    np.add.at(ok, (t.offs[1:] - width + 1)[has], -1)
    ok = np.cumsum(ok[:-1]) > 0
    starts = np.zeros(n - width + 2, bool)
    starts[1:-1] = low[1:] != low[:-1]
    starts[t.offs[:-1][has]] = True
    first = np.flatnonzero(starts[:-1] & ok)
    stop = starts.copy()
    stop[:-1] |= ~ok
    stop[-1] = True
    bounds = np.flatnonzero(stop)
    last = bounds[np.searchsorted(bounds, first, "right")] - 1
    # (mixed once more: smallest hashes are small, and would crowd into the first buckets)
    return rolling, first, last, np.searchsorted(t.offs, first, "right") - 1, mix(low[first])


def _anchor_batches(width: int, k: int, most: int):
    def run(batches):
        ids, sizes, toks, total = [], [], [], 0
        for t in slices(batches, most=SLICE):
            _, _, _, text, anchor = runs(t, width, k)
            doc, key = t.column("doc_id"), t.column("key")
            valid = t.rows.column("doc_id").is_valid().to_numpy(zero_copy_only=False)
            cuts = np.searchsorted(text, np.arange(len(t) + 1))
            for i in range(len(t)):
                if not valid[i] or cuts[i] == cuts[i + 1]:
                    continue
                own = np.unique(anchor[cuts[i] : cuts[i + 1]])
                ids.append((doc[i], key[i]))
                sizes.append(len(own))
                toks.append(own)
                total += len(own)
                if total >= most or len(ids) >= MOST_SETS:
                    yield np.array(ids, np.int64), np.array(sizes), np.concatenate(toks)
                    ids, sizes, toks, total = [], [], [], 0
        if ids:
            yield np.array(ids, np.int64), np.array(sizes), np.concatenate(toks)

    return run


def _to_documents(frequent: int):
    """Of a batch's shared anchors: one row a document, frequent anchors marked."""

    def run(ids, sizes, who, tok, df) -> pa.Table:
        order = np.lexsort((tok, who))
        who, tok, hot = who[order], tok[order], (df[order] > frequent).astype(np.uint8)
        docs = np.unique(who)
        cuts = np.append(np.searchsorted(who, docs), len(who))
        spans = [slice(cuts[i], cuts[i + 1]) for i in range(len(docs))]
        return pa.table({"doc_id": pa.array(ids[docs, 0]), "key": pa.array(ids[docs, 1]), "anchors": binary(tok[s] for s in spans), "hot": binary(hot[s] for s in spans)})

    return run


_PIECES = "bucket long, count long, places long, size long, docs binary, keys binary, lens binary, times binary, starts binary, body binary"
_SPANS = "doc_id long, key long, start long, end long"


def _same(data: np.ndarray, x: np.ndarray, y: np.ndarray, lens: np.ndarray, most: int = 4 << 20) -> np.ndarray:
    """Whether data[x : x + lens] and data[y : y + lens] are equal, pair by pair."""
    out, i = np.zeros(len(x), bool), 0
    ends = np.cumsum(lens)
    while i < len(x):
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + most, "right")))
        n = lens[i:j]
        first = np.cumsum(n) - n
        at = np.arange(n.sum()) - np.repeat(first, n)
        out[i:j] = np.logical_and.reduceat(data[at + np.repeat(x[i:j], n)] == data[at + np.repeat(y[i:j], n)], first)
        i = j
    return out


def merged(doc: np.ndarray, key: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, ...]:
    """The union of spans, row by row of (doc, key): spans that touch or overlap become one."""
    if not len(doc):
        return doc, key, start, end
    order = np.lexsort((start, key, doc))
    doc, key, start, end = doc[order], key[order], start[order], end[order]
    row = np.cumsum(np.concatenate([[0], (doc[1:] != doc[:-1]) | (key[1:] != key[:-1])]))
    top = np.maximum.accumulate(end + row * (int(end.max()) + 1)) - row * (int(end.max()) + 1)
    new = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (start[1:] > top[:-1])]))
    return doc[new], key[new], start[new], top[np.append(new[1:], len(top)) - 1]


def _pieces(width: int, k: int, buckets: int):
    """The pieces of text that may match, by bucket, equal ones once; spans that an earlier document of the batch settles go along."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in slices(batches, most=SENT):
            rolling, first, last, text, anchor = runs(t, width, k)
            anchor = coarse(anchor, buckets)
            keep, hot = np.zeros(len(first), bool), np.zeros(len(first), bool)
            cuts = np.searchsorted(text, np.arange(len(t) + 1))
            shared, marks = t.rows.column("anchors"), t.rows.column("hot")
            for i in range(len(t)):
                if shared[i].is_valid and cuts[i] < cuts[i + 1]:
                    own = np.frombuffer(shared[i].as_buffer(), np.uint64)
                    at = np.minimum(np.searchsorted(own, anchor[cuts[i] : cuts[i + 1]]), len(own) - 1)
                    keep[cuts[i] : cuts[i + 1]] = own[at] == anchor[cuts[i] : cuts[i + 1]]
                    hot[cuts[i] : cuts[i + 1]] = np.frombuffer(marks[i].as_buffer(), np.uint8)[at]
            first, last, text, anchor, hot = (x[keep] for x in (first, last, text, anchor, hot))
            # long runs are cut; runs of frequent anchors become single windows
            step = np.where(hot, 1, PIECE)
            parts = (last - first) // step + 1
            which = np.repeat(np.arange(len(first)), parts)
            nth = np.arange(len(which)) - np.repeat(np.cumsum(parts) - parts, parts)
            begin = first[which] + nth * step[which]
            end = np.minimum(begin + step[which] - 1, last[which]) + width
            own = rolling.some(begin, end)
            bucket = np.where(hot[which], (own >> U64(32)) * U64(buckets) >> U64(32), anchor[which] >> U64(32)).astype(np.int64)
            doc, key = t.column("doc_id")[text[which]], t.column("key")[text[which]]
            start = begin - t.offs[text[which]]
            order = np.lexsort((start, key, doc, own))
            begin, end, own, bucket, doc, key, start = (x[order] for x in (begin, end, own, bucket, doc, key, start))
            if not len(own):
                continue
            lens = end - begin
            new = np.concatenate([[True], own[1:] != own[:-1]])
            head = np.flatnonzero(new)[np.cumsum(new) - 1]
            rest = np.flatnonzero(~new)
            met = lens[rest] == lens[head[rest]]
            met[met] = _same(t.data, begin[rest[met]], begin[head[rest[met]]], lens[rest[met]])
            head[rest[~met]] = rest[~met]  # hashes met by chance: the piece travels on its own
            settled = doc > doc[head]
            gone = merged(doc[settled], key[settled], start[settled], end[settled] - begin[settled] + start[settled])
            yield _settled(-1 - int(own[0] % U64(buckets)), *gone)
            # equal pieces of one row travel once, with all their places
            go = np.flatnonzero(~settled)
            lead = head[go]
            again = np.concatenate([[False], (lead[1:] == lead[:-1]) & (doc[go][1:] == doc[go][:-1]) & (key[go][1:] == key[go][:-1])])
            rep = go[~again]
            which = np.cumsum(~again) - 1
            times = np.bincount(which, minlength=len(rep))
            by = np.lexsort((start[rep], key[rep], doc[rep], bucket[rep]))
            places = start[go][np.argsort(np.argsort(by)[which], kind="stable")]
            pick = rep[by]
            yield _packed(bucket[pick], doc[pick], key[pick], lens[pick], times[by], places, begin[pick], t.data)

    return run


def _zip(arrays) -> pa.Array:
    """Arrays as compressed bytes: fragments of text and their places make up most of what is shuffled."""
    codec = pa.Codec("zstd", compression_level=6)
    return pa.array([codec.compress(np.ascontiguousarray(a).tobytes(), asbytes=True) if len(a) else b"" for a in arrays], pa.binary())


def _unzip(data: bytes, kind, count: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(data, decompressed_size=count * np.dtype(kind).itemsize, codec="zstd"), kind) if count else np.zeros(0, kind)


def _row(values: pa.Array, *cells) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([values, *cells], ["bucket", "count", "places", "size", "docs", "keys", "lens", "times", "starts", "body"])


def _settled(bucket: int, doc, key, start, end) -> pa.RecordBatch:
    """Spans that need no bucket's answer: ends are carried as lengths, each span has one place."""
    n = [pa.array([x], pa.int64()) for x in (len(doc), len(doc), 0)]
    none = pa.array([b""], pa.binary())
    return _row(pa.array([bucket]), *n, _zip([_steps(doc)]), _zip([key]), _zip([(end - start).astype(np.int32)]), none, _zip([_steps(start)]), none)


def _steps(values: np.ndarray) -> np.ndarray:
    """Differences of neighbours, which compress better than the values."""
    return np.diff(values, prepend=0)


def _packed(bucket, doc, key, lens, times, places, begin, data) -> pa.RecordBatch:
    values = np.unique(bucket)
    cuts = np.append(np.searchsorted(bucket, values), len(bucket))
    spans = [slice(cuts[i], cuts[i + 1]) for i in range(len(values))]
    at = np.concatenate([[0], np.cumsum(times)])
    body = []
    for s in spans:
        n = lens[s]
        body.append(data[np.arange(n.sum()) + np.repeat(begin[s] - (np.cumsum(n) - n), n)])
    sizes = [pa.array(x, pa.int64()) for x in (np.diff(cuts), [at[s.stop] - at[s.start] for s in spans], [len(x) for x in body])]
    cells = [_zip([_steps(doc[s]) for s in spans]), _zip([key[s] for s in spans])]
    cells += [_zip([x[s].astype(np.int32) for s in spans]) for x in (lens, times)]
    return _row(pa.array(values), *sizes, *cells, _zip([_steps(places[at[s.start] : at[s.stop]]) for s in spans]), _zip(body))


class Windows:
    """Strings of ``width`` bytes of ``data`` as a few numbers each, of up to 8 bytes, the last one overlapping."""

    def __init__(self, data: np.ndarray, width: int):
        self.values, self.size, self.width = data.astype(np.uint64), 1, width
        while self.size < 8 and 2 * self.size <= width:
            self.values = self.values[: max(0, len(self.values) - self.size)] << U64(8 * self.size) | self.values[self.size :]
            self.size *= 2
        self.offsets = [min(i, width - self.size) for i in range(0, width, self.size)]

    def hashes(self, starts: np.ndarray) -> np.ndarray:
        out = np.zeros(len(starts), np.uint64)
        for i, at in enumerate(self.offsets):
            out += mix(self.values[starts + at] ^ _STEP[i % len(_STEP)]) * _STEP[i % len(_STEP)]
        return mix(out)


def suffix_order(windows: Windows, starts: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of the suffixes at ``starts`` by their first ``width`` bytes, and how many of these neighbours in that
    order have in common. All ``starts`` have ``width`` bytes after them; ``own`` are their hashes.

    Equal strings are brought together by their hashes, compared byte by byte, and one of each is put in order.
    """
    by = np.argsort(own)
    new = np.concatenate([[True], own[by[1:]] != own[by[:-1]]])[: len(by)]
    group = np.cumsum(new) - 1
    odd, lead = np.zeros(len(by), bool), by[new]
    for at in windows.offsets:
        value = windows.values[starts + at]
        odd |= value[by] != value[lead][group]
    if odd.any():  # hashes met by chance: such a string stands alone, next to its equals
        again = np.lexsort((odd, group))
        by, new = by[again], new | odd[again]
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, len(by)))
    keys = [windows.values[starts[by[first]] + at] for at in windows.offsets]
    rank = np.lexsort(keys[::-1])
    between = np.full(max(0, len(rank) - 1), windows.width)
    for at, key in reversed(list(zip(windows.offsets, keys, strict=True))):
        differ = key[rank[1:]] ^ key[rank[:-1]]
        hit = np.flatnonzero(differ)
        between[hit] = at + sum((differ[hit] >> U64(8 * (windows.size - 1 - i)) == 0).astype(np.int64) for i in range(windows.size - 1))
    size = size[rank]
    ends = np.cumsum(size)
    order = by[np.repeat(first[rank] - (ends - size), size) + np.arange(len(by))]
    common = np.full(max(0, len(by) - 1), windows.width)
    common[ends[:-1] - 1] = between
    return order, common


def longest_previous(document: np.ndarray, common: np.ndarray, least: int) -> np.ndarray:
    """The longest previous factor of each suffix, in suffix order: what it has in common with the nearest suffix of a smaller
    document before or after it, whichever is more; 0 where that is below ``least``.

    Both neighbours are found by jumps: a suffix that is not of a smaller document passes on its own nearest one so far, with the
    least length in common on the way.
    """
    n, out = len(document), np.zeros(len(document), np.int64)
    for own, lengths in ((document, common), (document[::-1], common[::-1])):
        to, held = np.arange(n) - 1, np.concatenate([[0], lengths]).astype(np.int64)[:n]
        found = np.zeros(n, np.int64)
        left = np.flatnonzero(held >= least)
        while len(left):
            smaller = own[to[left]] < own[left]
            found[left[smaller]] = held[left[smaller]]
            left = left[~smaller]
            over = to[left]
            to[left], held[left] = to[over], np.minimum(held[left], held[over])
            left = left[held[left] >= least]
        out = np.maximum(out, found if own is document else found[::-1])
    return out


def _previous_factors(width: int):
    """One bucket: the spans that have a previous factor of ``width`` bytes in an earlier document."""

    def run(table: pa.Table) -> pa.Table:
        cell = lambda name, r: table.column(name)[r].as_py()
        rows = range(table.num_rows)
        counts, places = ([cell(c, r) for r in rows] for c in ("count", "places"))
        got = lambda name, kind, sizes: [_unzip(cell(name, r), kind, n) for r, n in zip(rows, sizes, strict=True)]
        docs, keys, lens = [np.cumsum(x) for x in got("docs", np.int64, counts)], got("keys", np.int64, counts), got("lens", np.int32, counts)
        if cell("bucket", 0) < 0:
            doc, key, n = (np.concatenate(x) for x in (docs, keys, lens))
            start = np.concatenate([np.cumsum(x) for x in got("starts", np.int64, places)])
            return _table(doc, key, start, start + n)
        data = np.concatenate(got("body", np.uint8, [cell("size", r) for r in rows]))
        size = np.concatenate(lens).astype(np.int64)
        count = size - width + 1
        first = np.cumsum(count) - count
        piece = np.repeat(np.arange(len(size), dtype=np.int32), count)
        nth = np.arange(len(piece)) - np.repeat(first, count)
        starts = np.repeat(np.cumsum(size) - size, count) + nth
        _, number = np.unique(np.concatenate(docs), return_inverse=True)
        windows = Windows(data, width)
        own = windows.hashes(starts)
        # a window that only one document has, by its hash, has no previous factor of its length and need not be put in order
        order = np.argsort(own)
        new = np.flatnonzero(np.concatenate([[True], own[order[1:]] != own[order[:-1]]]))
        ranked = number[piece[order]]
        mixed = np.minimum.reduceat(ranked, new) < np.maximum.reduceat(ranked, new)
        pick = order[np.repeat(mixed, np.diff(np.append(new, len(order))))]
        order, common = suffix_order(windows, starts[pick], own[pick])
        order = pick[order]
        gone = order[longest_previous(number[piece[order]], common, width) >= width]
        del windows, own, order, common, starts, data
        gone.sort()
        p, w = piece[gone], nth[gone]
        new = np.concatenate([[True], (p[1:] != p[:-1]) | (w[1:] != w[:-1] + 1)]) if len(gone) else np.zeros(0, bool)
        a = np.flatnonzero(new)
        b = np.append(a[1:], len(gone)) - 1 if len(a) else a
        p, low, high = p[a], w[a], w[b] + width
        # spans of pieces become spans of texts, for each of the piece's places, row by row of the table
        out, at = [], 0
        for r in rows:
            lo, hi = np.searchsorted(p, [at, at + counts[r]])
            if lo < hi:
                own, times = p[lo:hi] - at, _unzip(cell("times", r), np.int32, counts[r]).astype(np.int64)
                begins = np.cumsum(_unzip(cell("starts", r), np.int64, places[r]))
                n = times[own]
                span = np.repeat(np.arange(lo, hi), n)
                place = begins[np.repeat((np.cumsum(times) - times)[own] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
                row = own[span - lo]
                out.append(merged(docs[r][row], keys[r][row], place + low[span], place + high[span]))
            at += counts[r]
        return _table(*(np.concatenate(x) for x in zip(*out, strict=True))) if out else _table(*(np.zeros(0, np.int64) for _ in range(4)))

    return run


def _table(doc, key, start, end) -> pa.Table:
    return pa.table({"doc_id": pa.array(doc), "key": pa.array(key), "start": pa.array(start), "end": pa.array(end)})


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for t in slices(batches):
        found = t.rows.column("spans")
        cuts = found.offsets.to_numpy()
        begins, ends = (found.values.field(i).to_numpy() for i in (0, 1))
        kept, counts, firsts, lasts = [], [], [], []
        for i in range(len(t)):
            text = t.data[t.offs[i] : t.offs[i + 1]]
            x, y = begins[cuts[i] : cuts[i + 1]], ends[cuts[i] : cuts[i + 1]]
            if found[i].is_valid and len(x):
                order = np.argsort(x, kind="stable")
                x, top = x[order], np.maximum.accumulate(y[order])
                new = np.flatnonzero(np.concatenate([[True], x[1:] > top[:-1]]))
                x, y = x[new], top[np.append(new[1:], len(top)) - 1]
                keep = np.ones(len(text), bool)
                for p, q in zip(x, y, strict=True):
                    keep[p:q] = False
                text = text[keep]
            else:
                x = y = begins[:0]
            kept.append(text)
            counts.append(len(x))
            firsts.append(x)
            lasts.append(y)
        spans = pa.StructArray.from_arrays([pa.array(np.concatenate(firsts)), pa.array(np.concatenate(lasts))], ["start", "end"])
        removed = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), spans)
        yield pa.RecordBatch.from_arrays([t.rows.column("doc_id"), pa.array(np.diff(t.offs)), removed, binary(kept)], ["doc_id", "n_bytes", "removed", "kept"])


def _keyed(docs: DataFrame) -> DataFrame:
    """Add ``key``, which tells the rows of one doc_id apart: a hash of the text, and 0 where a doc_id stands once.

    Zeros are compressed away. Ids that stand more than once are known by slots of a hash, ``SLOTS`` at most, so
    that these may be broadcast; an id that only shares a slot with such a one has the hash as well.
    """
    slot = F.pmod(F.xxhash64("doc_id"), F.lit(SLOTS))
    several = docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 and doc_id is not null")
    several = stage(several.select(slot.alias("slot")).distinct(), "several")
    docs = docs.withColumn("slot", slot).join(F.broadcast(several.select("slot", F.lit(True).alias("several"))), "slot", "left")
    return docs.select("doc_id", F.when(F.col("several") | F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(0).alias("key"), "text")


def remove_repeats(docs: DataFrame, width: int = 50, k: int = 24, bucket_bytes: int = BUCKET_BYTES, frequent: int = FREQUENT) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: doc_id, n_bytes, removed (array of start, end), kept (binary).

    Texts are UTF-8 bytes, null texts empty. A byte is removed if a ``width``-byte string that covers it also starts
    in a document with a smaller doc_id; strings are judged on the input and never cross documents. ``removed`` has the
    maximal removed runs in order, ``kept`` the remaining bytes, which need not be valid UTF-8.

    Rows that share a doc_id (told apart by a 64-bit hash of their texts), repeated ones too, do not remove from each other,
    and all of them lose what an earlier document has. A null doc_id is neither smaller nor larger than another: such a row loses nothing and removes nothing.
    Other columns are not looked at. No rows give no rows.
    """
    docs = _keyed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(1, -(-total // bucket_bytes), min(total // 65536, 64))
    anchors = shared_tokens(docs, _anchor_batches(width, k, BATCH_ANCHORS), buckets, _to_documents(frequent), "doc_id long, key long, anchors binary, hot binary")
    anchors = anchors.dropDuplicates(["doc_id", "key"])
    pieces = docs.join(anchors, ["doc_id", "key"], "left").select("doc_id", "key", "text", "anchors", "hot").mapInArrow(_pieces(width, k, buckets), _PIECES)
    spans = pieces.groupBy("bucket").applyInArrow(_previous_factors(width), _SPANS)
    spans = spans.groupBy("doc_id", "key").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    return docs.join(spans, ["doc_id", "key"], "left").select("doc_id", "text", "spans").mapInArrow(_cut, "doc_id long, n_bytes long, removed array<struct<start:long,end:long>>, kept binary")
