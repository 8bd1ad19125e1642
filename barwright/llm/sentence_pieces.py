"""Encoding and decoding with a sentencepiece model of merges with byte fallback, many words at a time.

Texts are cut before each run of blanks; equal words of a slice are encoded once. The symbols of all words lie in one
array, and each round finds every word's best pair, merges all places where it stands, from the left, and closes the gaps, until
no word has a pair left. Numpy does the rounds, Spark deals out the texts.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from barwright.llm.textarrays import slices
from barwright.llm.tokens import tokenizer_path

#: The mark that stands for a blank; bits of a symbol in the key of a pair; the rank of no pair.
BLANK, BITS, NONE = "▁", 21, np.iinfo(np.int32).max
#: Rounds after which what is left of a word is merged by a queue: such a word has thousands of symbols without a cut.
ROUNDS = 256
SLICE = 4 << 20


class Slots:
    """Where keys (not negative, all different) stand in their list: a table of slots, read for many keys at once."""

    def __init__(self, keys: np.ndarray):
        self.bits = max(8, int(len(keys) * 4).bit_length())
        self.key, self.place = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, -1, np.int32)
        left, at, self.steps = np.arange(len(keys)), self._slot(keys), 0
        while len(left):
            free = self.key[at] < 0
            self.key[at[free]] = keys[left[free]]  # of several keys for one free slot the last is in it
            in_it = self.key[at] == keys[left]
            self.place[at[in_it]] = left[in_it]
            left, at = left[~in_it], (at[~in_it] + 1) & ((1 << self.bits) - 1)
            self.steps += 1

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key, -1 for one that is not there."""
        at = self._slot(keys)
        found = np.where(self.key[at] == keys, self.place[at], np.int32(-1))
        left = np.flatnonzero((found < 0) & (self.key[at] >= 0))
        for step in range(1, self.steps):
            if not len(left):
                break
            here = (at[left] + step) & ((1 << self.bits) - 1)
            found[left] = np.where(self.key[here] == keys[left], self.place[here], np.int32(-1))
            left = left[(found[left] < 0) & (self.key[here] >= 0)]
        return found


class Pieces:
    """The model's tables. Symbols are piece ids, and for a character that is no piece the number of pieces plus its code point.

    Only models are taken that leave texts as they are but for blanks, put one blank before, and never join a blank to what
    stands before it; others raise ValueError.
    """

    def __init__(self, path: str):
        import sentencepiece

        self.library = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = sp.get_piece_size()
        names = [sp.id_to_piece(i) for i in range(self.size)]
        special = np.array([sp.is_control(i) or sp.is_unknown(i) for i in range(self.size)])
        is_byte = np.array([sp.is_byte(i) for i in range(self.size)])
        self.usual = ~special
        normal = {names[i]: i for i in np.flatnonzero(~special & ~is_byte).tolist()}
        if any(sp.is_unused(i) for i in range(self.size)) or is_byte.sum() != 256 or any(BLANK in n.lstrip(BLANK) for n in normal) or sp.normalize(" ﬁ  Ａ ").strip() != f"{BLANK}{BLANK}ﬁ{BLANK}{BLANK}Ａ{BLANK}":
            raise ValueError("not a merge model with byte fallback and texts as they are")
        self.bytes = np.zeros(256, np.int32)
        for i in np.flatnonzero(is_byte).tolist():
            self.bytes[int(names[i][3:5], 16)] = i
        self.symbol = np.arange(0x110000, dtype=np.int32) + self.size
        for name, i in normal.items():
            if len(name) == 1:
                self.symbol[ord(name)] = i
        scores = np.array([sp.get_score(i) for i in range(self.size)])
        self.rank = np.unique(-scores, return_inverse=True)[1].astype(np.int32)
        self._pairs(normal)
        self._texts(names, is_byte)

    def _pairs(self, normal: dict[str, int]) -> None:
        """Which two symbols make which piece, which characters stand side by side in a piece, and pieces that can be outrun."""
        keys, made, beside = [], [], set()
        of = lambda s: normal.get(s) if len(s) > 1 else int(self.symbol[ord(s)])
        for name, i in normal.items():
            for c in range(1, len(name)):
                beside.add(ord(name[c - 1]) << BITS | ord(name[c]))
                a, b = of(name[:c]), of(name[c:])
                if a is not None and b is not None:
                    keys.append(a << BITS | b)
                    made.append(i)
        self.keys, self.made = np.array(keys, np.int64), np.array(made, np.int32)
        self.pair_slots, self.beside_slots = Slots(self.keys), Slots(np.array(sorted(beside), np.int64))
        # a piece after whose making a pair with it may come before other places of the same piece
        self.outrun = np.zeros(self.size, bool)
        for part in (self.keys >> BITS, self.keys & ((1 << BITS) - 1)):
            own = part < self.size
            early = self.rank[self.made[own]] <= self.rank[part[own]]
            self.outrun[part[own][early]] = True

    def _texts(self, names: list[str], is_byte: np.ndarray) -> None:
        own = [b"" if not self.usual[i] else bytes([int(n[3:5], 16)]) if is_byte[i] else n.replace(BLANK, " ").encode() for i, n in enumerate(names)]
        self.text_len = np.array([len(x) for x in own])
        self.text_at = np.cumsum(self.text_len) - self.text_len
        self.text = np.frombuffer(b"".join(own), np.uint8)
        self.blank_first = np.array([n.startswith(BLANK) for n in names])

    def pair(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The piece that two symbols make, or -1."""
        at = self.pair_slots.find(left.astype(np.int64) << BITS | right)
        return np.where(at >= 0, self.made[at], np.int32(-1))

    def ranks(self, pairs: np.ndarray) -> np.ndarray:
        return np.where(pairs >= 0, self.rank[pairs], NONE).astype(np.int32)

    def queue(self, symbols: np.ndarray) -> np.ndarray:
        """One word, pair by pair: best rank first, of equal ones the leftmost."""
        sym = symbols.tolist()
        after, before = list(range(1, len(sym) + 1)), list(range(-1, len(sym) - 1))
        pairs = self.pair(symbols[:-1], symbols[1:])
        heap = [(r, i, i + 1, sym[i], sym[i + 1], p) for i, (r, p) in enumerate(zip(self.ranks(pairs).tolist(), pairs.tolist(), strict=True)) if p >= 0]
        heapq.heapify(heap)
        made = dict(zip(self.keys.tolist(), self.made.tolist(), strict=True)) if heap else {}

        def add(a: int, b: int) -> None:
            if a >= 0 and b < len(sym) and (p := made.get(sym[a] << BITS | sym[b], -1)) >= 0:
                heapq.heappush(heap, (int(self.rank[p]), a, b, sym[a], sym[b], p))

        while heap:
            _, a, b, x, y, p = heapq.heappop(heap)
            if sym[a] != x or sym[b] != y or after[a] != b:
                continue
            sym[a], sym[b] = p, -1
            after[a] = c = after[b]
            if c < len(sym):
                before[c] = a
            add(before[a], a)
            add(a, c)
        return np.array([s for s in sym if s >= 0], np.int32)

    def merge(self, sym: np.ndarray, first: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
        """Merge the symbols of words that begin at ``first``, none of them empty: (symbols, how many each word has)."""
        count = np.diff(np.append(first, len(sym)))
        own = np.arange(len(first))
        word = np.repeat(own, count)
        pair = np.full(len(sym), -1, np.int32)
        inner = np.flatnonzero(word[1:] == word[:-1])
        pair[inner] = self.pair(sym[inner], sym[inner + 1])
        rank = self.ranks(pair)
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for turn in range(rounds + 1):
            if not len(own):
                break
            first = np.cumsum(count) - count
            best = np.minimum.reduceat(rank, first)
            ended = best == NONE
            if ended.any() or turn == rounds:
                out = ended[word]
                done.append((own[ended], count[ended], sym[out]))
                live = ~ended
                sym, pair, rank = sym[~out], pair[~out], rank[~out]
                own, count, best = own[live], count[live], best[live]
                word = np.repeat(np.arange(len(own)), count)
                first = np.cumsum(count) - count
            if turn == rounds:
                for i, a, n in zip(own, first, count, strict=True):
                    left = self.queue(sym[a : a + n])
                    done.append((np.array([i]), np.array([len(left)]), left))
                break
            if not len(own):
                break
            hit = np.flatnonzero(rank == best[word])
            at = word[hit]
            careful = np.zeros(len(own), bool)
            careful[at[self.outrun[pair[hit]]]] = True
            lead = np.concatenate([[True], at[1:] != at[:-1]])
            hit = hit[lead | ~careful[at]]
            # of places side by side every other one, from the left
            run = np.concatenate([[True], hit[1:] != hit[:-1] + 1])
            start = np.maximum.accumulate(np.where(run, np.arange(len(hit)), 0))
            hit = hit[(np.arange(len(hit)) - start) % 2 == 0]
            sym[hit] = pair[hit]
            stay = np.ones(len(sym), bool)
            stay[hit + 1] = False
            count = count - np.bincount(word[hit], minlength=len(own))
            now = hit - np.arange(len(hit))
            sym, pair, rank, word = sym[stay], pair[stay], rank[stay], word[stay]
            touched = np.zeros(len(sym) + 1, bool)
            touched[now] = touched[now - 1] = True  # (before the first there is a place that does not count)
            anew = np.flatnonzero(touched[:-1])
            inside = np.zeros(len(anew), bool)
            some = anew < len(sym) - 1
            inside[some] = word[anew[some]] == word[anew[some] + 1]
            pair[anew] = -1
            anew_in = anew[inside]
            pair[anew_in] = self.pair(sym[anew_in], sym[anew_in + 1])
            rank[anew] = self.ranks(pair[anew])
        order = np.concatenate([d[0] for d in done]) if done else np.zeros(0, np.int64)
        counts = np.concatenate([d[1] for d in done]) if done else np.zeros(0, np.int64)
        flat = np.concatenate([d[2] for d in done]) if done else np.zeros(0, np.int32)
        by = np.argsort(order)
        starts = (np.cumsum(counts) - counts)[by]
        counts = counts[by]
        return flat[_spread(starts, counts)], counts

    def words(self, names: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words (binary, none empty, blanks as blanks) one after another, and how many each has."""
        offs = np.frombuffer(names.buffers()[1], np.int64)[names.offset : names.offset + len(names) + 1]
        data = np.frombuffer(names.buffers()[2], np.uint8)[offs[0] : offs[-1]]
        chars = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32).astype(np.int64)
        chars[chars == 32] = ord(BLANK)
        begin = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offs - offs[0]]
        cut = np.ones(len(chars), bool)
        cut[1:] = self.beside_slots.find(chars[:-1] << BITS | chars[1:]) < 0
        cut[begin[:-1]] = True
        first = np.flatnonzero(cut)
        sym, count = self.merge(self.symbol[chars], first)
        ends = np.concatenate([[0], np.cumsum(count)])[np.searchsorted(first, begin)]
        ids, each = self._ids(sym)
        return ids, np.diff(np.concatenate([[0], np.cumsum(each)])[ends])

    def _ids(self, sym: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of symbols, and how many each has: characters that are no pieces become the ids of their bytes."""
        strange, which = np.unique(sym[sym >= self.size], return_inverse=True)
        own = [self.bytes[np.frombuffer(chr(s - self.size).encode(), np.uint8)] for s in strange.tolist()]
        lens = np.array([len(x) for x in own], np.int64)
        each = np.ones(len(sym), np.int64)
        odd = np.flatnonzero(sym >= self.size)
        each[odd] = lens[which] if len(odd) else 0
        ids = np.repeat(sym, each)
        if len(odd):
            table = np.concatenate(own)
            place = np.repeat(sym >= self.size, each)
            ids[place] = table[_spread((np.cumsum(lens) - lens)[which], lens[which])]
        return ids, each

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts (large_string without nulls) one after another, and how many each has."""
        texts = pc.replace_substring(texts, BLANK, " ")
        some = pc.greater(pc.binary_length(texts), 0)
        texts = pc.if_else(some, pc.binary_join_element_wise(pa.scalar("", pa.large_string()), texts, pa.scalar(" ", pa.large_string())), texts)
        offs = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        if offs[0] == offs[-1]:
            return np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
        base, offs = offs[0], offs - offs[0]
        data = np.frombuffer(texts.buffers()[2], np.uint8)[base : base + offs[-1]]
        blank = data == 32
        cut = blank.copy()
        cut[1:] &= ~blank[:-1]
        cut[offs[:-1][np.diff(offs) > 0]] = True
        first = np.flatnonzero(cut)
        edges = np.append(first, len(data)).astype(np.int64)
        words = pa.Array.from_buffers(pa.large_binary(), len(first), [None, pa.py_buffer(edges), pa.py_buffer(np.ascontiguousarray(data))])
        coded = words.dictionary_encode()
        ids, count = self.words(coded.dictionary)
        codes = coded.indices.to_numpy()
        each = count[codes]
        out = ids[_spread((np.cumsum(count) - count)[codes], each)]
        return out, np.diff(np.concatenate([[0], np.cumsum(each)])[np.searchsorted(first, offs)])

    def decode(self, ids: np.ndarray, count: np.ndarray) -> list[str]:
        """Texts of rows of ids: bytes from a table; rows that hold special ids, or bytes that are no text, through the library."""
        odd = (ids < 0) | (ids >= self.size)
        known = np.where(odd, 0, ids)
        lens = self.text_len[known]
        flat = self.text[_spread(self.text_at[known], lens)].tobytes()
        ends, at = np.cumsum(count), np.concatenate([[0], np.cumsum(lens)])
        strange = np.concatenate([[0], np.cumsum(odd | ~self.usual[known])])
        out = []
        for a, b in zip((ends - count).tolist(), ends.tolist(), strict=True):
            if a < b and (strange[b] > strange[a] or not self.blank_first[ids[a]]):
                out.append(self.library.decode(ids[a:b].tolist()))
                continue
            try:
                out.append(flat[at[a] + (a < b) : at[b]].decode())
            except UnicodeDecodeError:
                out.append(self.library.decode(ids[a:b].tolist()))
        return out


def _spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Indices of runs one after another."""
    total = int(counts.sum()) if len(counts) else 0
    return np.repeat(starts - (np.cumsum(counts) - counts), counts) + np.arange(total)


_models: dict[str, Pieces] = {}


def model(path: str) -> Pieces:
    """The worker's tables of a file: they stay for its later tasks."""
    if path not in _models:
        _models[path] = Pieces(path)
    return _models[path]


def encode_pieces(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, ids array<int>) of every whole text of ``docs(doc_id, text)``, as the library encodes it, without begin or end.

    A null or empty text has no ids; null ids and repeated rows stay rows of their own; other columns are not looked at.
    """
    path = path or tokenizer_path("piece_bpe_32k.model")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in slices(batches, most=SLICE):
            ids, count = model(path).encode(t.rows.column("text").cast(pa.large_string()).fill_null(""))
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(count)]).astype(np.int32)), pa.array(ids.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([t.rows.column("doc_id"), lists], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, ids array<int>")


def decode_pieces(df: DataFrame, column: str = "ids", out: str = "decoded", path: str | None = None, rows: int = 256) -> DataFrame:
    """``df`` with the text of the ids in ``column`` as ``out``, as the library decodes them; null ids give null, no ids an empty text.

    All columns stay; one that is called ``out`` is replaced.
    """
    path = path or tokenizer_path("piece_bpe_32k.model")
    keep = [c for c in df.columns if c != out]
    schema = StructType([*[df.schema[c] for c in keep], StructField(out, StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, rows):
                batch = whole.slice(i, rows)
                lists = batch.column(column)
                count = pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
                texts = model(path).decode(lists.flatten().fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64), count)
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(texts, pa.string(), mask=lists.is_null().to_numpy(zero_copy_only=False))], [*keep, out])

    return df.select(*[F.col(f"`{c}`") for c in keep]).mapInArrow(run, schema)
