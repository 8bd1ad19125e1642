"""Token ids of whole texts, by a public tokenizer, with each distinct piece of text encoded once a worker."""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barwright.llm.textarrays import U64, binary, mix, slices, word_hashes

#: Bytes of pieces and their ids that a worker remembers at most; pieces that are encoded as one text.
ROOM, JOINED = 24 << 20, 512
#: Bytes of a piece that its hash is made of, besides its length.
HASHED = 256
#: Marks that end a word.
_ENDS = r"([A-Za-z])([!-&(-/:-@\[-`{-~]+)(\s|$)"


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _hashes(names: pa.Array) -> np.ndarray:
    """A 64-bit number for each piece, by its first bytes and its length."""
    if not len(names):
        return np.zeros(0, np.uint64)
    offs = np.frombuffer(names.buffers()[1], np.int64)[names.offset : names.offset + len(names) + 1]
    size, out = np.diff(offs), np.zeros(len(names), np.uint64)
    solid = np.flatnonzero(size)
    for i in range(0, len(solid), 4096):
        some = solid[i : i + 4096]
        data = np.frombuffer(names.buffers()[2], np.uint8)
        out[some] = mix(word_hashes(data, offs[some], offs[some] + np.minimum(size[some], HASHED), lower=False) + size[some].astype(U64))
    return out


class Encoder:
    """Encodes texts with a tokenizer file whose pre-tokenizer never joins text across white space and lower-cases it.

    A slice of texts is lower-cased (A-Z), cut at blanks and line feeds and before the marks that end a word, where the
    tokenizer cuts too, and each distinct piece is encoded once. Pieces of letters alone are encoded many at a time, as
    one text with blanks between, and told apart by the ids that end a word. A slice in which a special token
    could stand is cut at blanks and line feeds only, so that the library finds these tokens. Pieces are
    remembered, the first ones up to ``ROOM`` bytes; any other is encoded anew in each slice. Remembered ones are found
    by hashes that stay in order, and then compared, so that a slice costs what its own pieces do.
    """

    def __init__(self, path: str, room: int = ROOM):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.room = Tokenizer.from_file(path), room
        self.pieces = pa.array([], pa.large_string())
        self.hashes, self.order = np.zeros(0, np.uint64), np.zeros(0, np.int32)
        self.ids, self.ends = np.zeros(0, np.uint32), np.zeros(1, np.int64)
        self.full = False
        vocabulary, mark = self.tokenizer.get_vocab(with_added_tokens=False), getattr(self.tokenizer.model, "end_of_word_suffix", None)
        self.closes = np.zeros(1 + max(vocabulary.values()), bool)
        if mark:
            self.closes[[i for token, i in vocabulary.items() if token.endswith(mark)]] = True

    def _through_library(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces one after another, and how many each has."""
        ids, counts = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for i in range(0, len(pieces), 4096):
            for got in self.tokenizer.encode_batch_fast(pieces[i : i + 4096], add_special_tokens=False):
                ids.append(np.array(got.ids, np.uint32))
                counts.append(np.array([len(got.ids)]))
        return np.concatenate(ids), np.concatenate(counts)

    def _letters(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same for pieces of letters alone."""
        ids, counts = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        groups = [pieces[i : i + JOINED] for i in range(0, len(pieces), JOINED)]
        for own, got in zip(groups, self.tokenizer.encode_batch_fast([" ".join(g) for g in groups], add_special_tokens=False), strict=True):
            found = np.array(got.ids, np.uint32)
            ends = np.flatnonzero(self.closes[np.minimum(found, len(self.closes) - 1)]) + 1
            if len(ends) == len(own) and ends[-1] == len(found):
                ids.append(found)
                counts.append(np.diff(ends, prepend=0))
            else:  # a tokenizer without marks of word ends, or one that cuts words elsewhere
                one, n = self._through_library(own)
                ids.append(one)
                counts.append(n)
        return np.concatenate(ids), np.concatenate(counts)

    def _find(self, names: pa.Array, hashes: np.ndarray) -> np.ndarray:
        """Which of the remembered pieces each piece is, or -1."""
        if not len(self.pieces) or not len(names):
            return np.full(len(names), -1)
        ranked = np.argsort(hashes)
        near = np.empty(len(names), np.int64)
        near[ranked] = np.minimum(np.searchsorted(self.hashes, hashes[ranked]), len(self.hashes) - 1)
        at = self.order[near].astype(np.int64)
        like = np.flatnonzero(self.hashes[near] == hashes)
        same = pc.equal(names.take(pa.array(like)), self.pieces.take(pa.array(at[like]))).to_numpy(zero_copy_only=False)
        found = np.full(len(names), -1)
        found[like[same]] = at[like[same]]
        return found

    def _places(self, names: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For distinct pieces: ids, and where in them each piece begins and how many it has."""
        hashes = _hashes(names)
        at = self._find(names, hashes)
        new = at < 0
        begin, count = self.ends[np.maximum(at, 0)], np.zeros(len(names), np.int64)
        count[~new] = (self.ends[1:] - self.ends[:-1])[at[~new]]
        if not new.any():
            return self.ids, begin, count
        fresh = names.filter(pa.array(new))
        letters = pc.utf8_is_alpha(fresh).to_numpy(zero_copy_only=False)
        fresh = pa.concat_arrays([fresh.filter(pa.array(letters)), fresh.filter(pa.array(~letters))])
        where = np.flatnonzero(new)
        where = np.concatenate([where[letters], where[~letters]])
        n = int(letters.sum())
        (ids, c), (more, d) = self._letters(fresh[:n].to_pylist()), self._through_library(fresh[n:].to_pylist())
        c = np.concatenate([c, d])
        ids = np.concatenate([self.ids, ids, more])
        ends = len(self.ids) + np.cumsum(c)
        begin[where], count[where] = ends - c, c
        if not self.full:
            fits = np.cumsum(pc.binary_length(fresh).to_numpy(zero_copy_only=False).astype(np.int64) + 32) + 4 * (ends - len(self.ids)) <= self.room
            m = int(fits.sum())
            self.full = m < len(fresh)
            if m:
                self.room -= int(pc.sum(pc.binary_length(fresh[:m])).as_py()) + 32 * m + 4 * int(ends[m - 1] - len(self.ids))
                self.hashes, self.order = np.concatenate([self.hashes, hashes[where[:m]]]), np.concatenate([self.order, np.arange(m, dtype=np.int32) + len(self.pieces)])
                ranked = np.argsort(self.hashes, kind="stable")
                self.hashes, self.order = self.hashes[ranked], self.order[ranked]
                self.pieces = pa.concat_arrays([self.pieces, fresh[:m]])
                self.ids, self.ends = ids[: ends[m - 1]], np.concatenate([self.ends, ends[:m]])
        return ids, begin, count

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and how many each has."""
        if not pc.any(pc.match_substring(texts, "<|")).as_py():
            # (in this order: Arrow lower-cases an array wrongly whose first offset is not 0)
            texts = pc.ascii_lower(pc.replace_substring_regex(texts, _ENDS, r"\1 \2\3"))
        pieces = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        coded = pieces.flatten().dictionary_encode()
        ids, begin, count = self._places(coded.dictionary)
        codes = coded.indices.to_numpy()
        each = count[codes]
        ends = np.cumsum(each)
        total = int(ends[-1]) if len(ends) else 0
        out = ids[np.repeat(begin[codes] - (ends - each), each) + np.arange(total)]
        cuts = np.diff(pieces.offsets.to_numpy())
        bounds = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(cuts)])]
        return out, np.diff(bounds)


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder for a file: it stays for the worker's later tasks."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


SCHEMA = "part int, seq long, doc_id long, key long, local long, n_tokens long, width byte, ids binary"


def _run(path: str, end_id: int, keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, before = TaskContext.get().partitionId(), 0, 0
        for t in slices(batches):
            ids, counts = encoder(path).encode(t.rows.column("text").cast(pa.large_string()).fill_null(""))
            ids = ids.astype(np.uint16 if ids.max(initial=0) < 65536 and end_id < 65536 else np.uint32)
            ends = np.cumsum(counts)
            tail = np.array([end_id], ids.dtype)
            own = [np.concatenate([ids[e - c : e], tail]).tobytes() for c, e in zip(counts, ends, strict=True)]
            n = counts + 1
            start = before + np.cumsum(n) - n
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(t), part, np.int32)), pa.array(seq + np.arange(len(t))), *[t.rows.column(c) for c in keep], pa.array(start), pa.array(n), pa.array(np.full(len(t), ids.itemsize, np.int8)), pa.array(own, pa.binary())],
                ["part", "seq", *keep, "local", "n_tokens", "width", "ids"],
            )
            seq += len(t)
            before += int(n.sum())

    return run


def tokenize(docs: DataFrame, path: str | None = None, end_id: int = 1) -> DataFrame:
    """Ids of every whole text of ``docs(doc_id, text)`` with ``end_id`` after them; a null text has that id alone.

    ``part`` and ``seq`` are the task and the row's place in it, ``local`` the ids of the task's rows before it,
    ``ids`` little-endian unsigned integers of ``width`` bytes (2, or 4 in a slice with larger ids), ``key`` a hash of
    the text. Write the result before using ``part``: the numbers belong to one run.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("key"), "text")
    return docs.mapInArrow(_run(path or tokenizer_path(), end_id, ["doc_id", "key"]), SCHEMA)


def with_starts(tokens: DataFrame) -> DataFrame:
    """Add ``start``: the ids of all rows before, parts in order. Two passes: totals of the parts, then offsets.

    Of the parts, one row each of 16 bytes is summed up and broadcast: a bound by the number of tasks, not of rows.
    """
    from pyspark.sql import Window

    totals = tokens.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    before = totals.select("part", (F.sum("total").over(Window.orderBy("part")) - F.col("total")).alias("before"))
    return tokens.join(F.broadcast(before), "part").withColumn("start", F.col("before") + F.col("local")).drop("before")


def as_ids(data: bytes, width: int) -> np.ndarray:
    return np.frombuffer(data, np.uint16 if width == 2 else np.uint32)


__all__ = ["SCHEMA", "Encoder", "as_ids", "binary", "encoder", "tokenize", "tokenizer_path", "with_starts"]
