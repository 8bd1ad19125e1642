"""Numpy over the bytes of many texts at once, for use inside ``mapInArrow`` tasks."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Texts are worked on in slices of about this many bytes, so that a task's memory does not grow.
SLICE_BYTES = 1 << 20

_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
_MULT = int(_rng.integers(1, 2**62)) * 2 + 1

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


@dataclass
class Texts:
    """Consecutive rows: text i is ``data[offs[i]:offs[i + 1]]``; null texts are empty."""

    rows: pa.RecordBatch
    data: np.ndarray
    offs: np.ndarray

    def __len__(self) -> int:
        return len(self.offs) - 1

    def column(self, name: str, null: int = 0) -> np.ndarray:
        return self.rows.column(name).fill_null(null).to_numpy(zero_copy_only=False)


def slices(batches: Iterable[pa.RecordBatch], column: str = "text", most: int = SLICE_BYTES) -> Iterator[Texts]:
    """Cut record batches into runs of rows with about ``most`` bytes of text (a longer text stands alone)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        array = batch.column(column).cast(pa.large_string()).fill_null("")
        offs = np.frombuffer(array.buffers()[1], np.int64)[array.offset : array.offset + len(array) + 1]
        body = array.buffers()[2]
        data = np.frombuffer(body, np.uint8) if body is not None else np.zeros(0, np.uint8)
        i = 0
        while i < len(array):
            j = max(i + 1, int(np.searchsorted(offs, offs[i] + most, "right")) - 1)
            yield Texts(batch.slice(i, j - i), data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
            i = j
    give_back()


def give_back() -> None:
    """Return freed memory to the system: Python workers live on from task to task."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x = x * U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base & (2**64 - 1), np.uint64)
    if n:
        out[0] = 1
        np.multiply.accumulate(out, out=out)
    return out


_POW = powers(_MULT, 1 << 12)
_STEP = powers(0xD6E8FEB86659FD93, 65)[1:]


def words(t: Texts, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of every text: (start byte, end byte, first word of each text, plus the total)."""
    solid = ~SPACE[t.data]
    n = len(t.data)
    before = np.zeros(n, bool)
    before[1:] = solid[:-1]
    inner = t.offs[(t.offs > 0) & (t.offs < n)]
    before[inner] = False
    starts = np.flatnonzero(solid & ~before)
    after = np.zeros(n, bool)
    after[:-1] = solid[1:]
    after[inner - 1] = False
    ends = np.flatnonzero(solid & ~after) + 1
    return starts, ends, np.searchsorted(starts, t.offs)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """A 64-bit hash of the bytes of every word."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    global _POW
    lens = ends - starts
    if lens.max() > len(_POW):
        _POW = powers(_MULT, 1 << int(lens.max()).bit_length())
    total = int(lens.sum())
    at = np.arange(total, dtype=np.int64)
    first = np.cumsum(lens) - lens
    within = at - np.repeat(first, lens)
    picked = data[at + np.repeat(starts - first, lens)]
    values = _BYTE[LOWER[picked] if lower else picked] * _POW[within]
    return mix(np.add.reduceat(values, first) + lens.astype(np.uint64))


def shingles(t: Texts, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-word shingles in text order, and the first shingle of each text (plus the total).

    A text of fewer words than k, but at least one, has its whole word sequence as one shingle.
    """
    starts, ends, first = words(t)
    h = word_hashes(t.data, starts, ends)
    n_words = np.diff(first)
    counts = np.where(n_words >= k, n_words - k + 1, np.minimum(n_words, 1))
    out_first = np.concatenate([[0], np.cumsum(counts)])
    total = int(out_first[-1])
    if not total:
        return np.zeros(0, np.uint64), out_first
    at = np.repeat(first[:-1] - out_first[:-1], counts) + np.arange(total)
    size = np.repeat(np.minimum(n_words, k), counts)
    padded = np.concatenate([h, np.zeros(k, np.uint64)])
    acc = size.astype(np.uint64)
    for j in range(k):
        acc += np.where(size > j, padded[at + j] * _STEP[j], U64(0))
    return mix(acc), out_first



def per_text_sets(values: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sort and deduplicate ``values`` within each text; returns the same layout."""
    if not len(values):
        return values, np.zeros(len(first), np.int64)
    out, counts = [], np.zeros(len(first) - 1, np.int64)
    for i in range(len(first) - 1):
        u = np.unique(values[first[i] : first[i + 1]])
        counts[i] = len(u)
        out.append(u)
    return np.concatenate(out), np.concatenate([[0], np.cumsum(counts)])


def segments(counts: np.ndarray) -> np.ndarray:
    """Group number of every element, given group sizes."""
    return np.repeat(np.arange(len(counts)), counts)


def binary(arrays: Iterable[np.ndarray]) -> pa.Array:
    return pa.array([np.ascontiguousarray(a).tobytes() for a in arrays], pa.binary())
