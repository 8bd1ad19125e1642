"""Benchmark decontamination by spaced seeds, tolerant of substituted words.

A seed is a mask over a few consecutive words: the hash takes the words at the marked places and ignores the others,
so a substituted word at an ignored place does no harm.

1. All seeds of all items become a table (hash, item, place), made and kept by the cluster. A table of bits, of a size
   with a fixed bound, says which hashes it may have.
2. One pass over the documents hashes their words under the same masks. Texts of which some hash is in the bits, few in
   the usual case, are written with the hashes of their words; all others are done.
3. Their seeds and the items' are joined on the hash. Each distinct (text, item, alignment) lays text and item side by side,
   and the equal words, or the stretch with the best balance of equal and substituted ones, are measured.

Seeds that many items share (items made from a template) are not enough to lay every text beside every item: see ``_shared``.

Neither items nor documents reach the driver: only the bits do. With more items than the bits can tell apart, more
texts go through the join, and the result is the same.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barwright.llm.textarrays import _STEP, U64, binary, mix, slices, word_hashes, words
from barwright.plans.shared import stage

#: Marked places. Together they find any 16 aligned words with up to 3 substituted ones, wherever these are.
MASKS = ("101001011", "1000011011", "11001101")
#: For items of fewer words (from 5, 7, 10, 12 on; from 13 on the above), so that a fifth of an item may be substituted.
SHORT = ((5, ("1101", "1011")), (7, ("11011",)), (10, ("1101",)), (12, ("11011",)))
#: Bits that tell hashes apart: 2 ** least to 2 ** most, 512 times the seeds between; 2 ** 27 bits are 16 MB. Each hash has
#: three of them, by its upper, middle and lower part: by chance two words in ten million pass.
LEAST_BITS, MOST_BITS, PAGE_BITS, TIMES, PARTS = 16, 27, 15, 512, (0, 20, 37)
#: Items that may share a seed before more than the seed is asked for.
HOT = 64


def masks_for(n: int) -> tuple[str, ...]:
    """The masks of an item of n words; below 5 words it is found only where it stands whole."""
    if n >= 13:
        return MASKS
    return next((masks for least, masks in reversed(SHORT) if n >= least), ("1" * n,))


_KINDS = sorted({m for _, masks in SHORT for m in masks} | set(MASKS) | {"1" * n for n in range(1, 5)}, key=lambda m: (len(m), m))


def seeds(h: np.ndarray, mask: str) -> np.ndarray:
    """The seed hash at every word with room for the mask."""
    n = max(0, len(h) - len(mask) + 1)
    acc = np.full(n, _KINDS.index(mask) + 1, np.uint64)
    for j, at in enumerate(i for i, c in enumerate(mask) if c == "1"):
        acc += h[at : at + n] * _STEP[j]
    return mix(acc)


def _hashed(t) -> tuple[np.ndarray, np.ndarray]:
    starts, ends, first = words(t)
    return word_hashes(t.data, starts, ends), first


def _items(least: int):
    """Items with the hashes of their words, and their seeds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in slices(batches):
            h, first = _hashed(t)
            item, item_id = t.column("item"), t.column("item_id")
            for i in range(len(t)):
                own = h[first[i] : first[i + 1]]
                if len(own) < max(1, least):
                    continue
                masks = [m for m in masks_for(len(own)) if len(m) <= len(own)]
                found = [seeds(own, m) for m in masks]
                place, kind = np.concatenate([np.arange(len(x)) for x in found]), np.repeat([_KINDS.index(m) for m in masks], [len(x) for x in found])
                cells = [pa.array([x], k) for x, k in zip((np.concatenate(found).view(np.int64), place.astype(np.int32), kind.astype(np.int32)), (pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32())), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([item[i]]), pa.array([item_id[i]]), pa.array([own.tobytes()]), *cells], ["item", "item_id", "words", "hash", "place", "kind"])

    return run


def _pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i in range(b.num_rows):
            page = np.zeros(1 << PAGE_BITS, np.uint8)
            page[b.column("own")[i].values.to_numpy()] = 1
            yield pa.RecordBatch.from_arrays([b.column("page").slice(i, 1), pa.array([np.packbits(page, bitorder="little").tobytes()])], ["page", "bits"])


def _bits(table: DataFrame, count: int) -> tuple[np.ndarray, int]:
    """The bits of all hashes of ``table``, and how many of a hash's own bits name one."""
    n = min(MOST_BITS, max(LEAST_BITS, int(TIMES * count).bit_length()))
    parts = F.array(*[F.shiftrightunsigned(F.shiftleft("hash", part), 64 - n) for part in PARTS])
    slots = table.select(F.explode(parts).alias("slot")).distinct()
    pages = slots.groupBy(F.shiftright("slot", PAGE_BITS).alias("page")).agg(F.collect_list(F.col("slot").bitwiseAND((1 << PAGE_BITS) - 1)).alias("own"))
    bits = np.zeros((1 << n) // 8, np.uint8)
    for r in pages.mapInArrow(_pages, "page long, bits binary").collect():  # 2 ** (n - PAGE_BITS) rows at most
        at = r["page"] << (PAGE_BITS - 3)
        bits[at : at + (1 << (PAGE_BITS - 3))] = np.frombuffer(r["bits"], np.uint8)
    return bits, n


def _suspects(bits: np.ndarray, n: int, masks: list[str], keep: list[str]):
    """Texts with a hash among the bits: the kept columns, the hashes of their words, and these seeds with their places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        for t in slices(batches):
            h, first = _hashed(t)
            end = first[1:][np.repeat(np.arange(len(t)), np.diff(first))]
            own, at = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
            for mask in masks:
                found = seeds(h, mask)
                near = np.flatnonzero(np.arange(len(found)) + len(mask) <= end[: len(found)])
                for part in PARTS:
                    slot = found[near] << U64(part) >> U64(64 - n)
                    near = near[bits[slot >> U64(3)] >> (slot & U64(7)).astype(np.uint8) & 1 > 0]
                own.append(found[near])
                at.append(near)
            own, at = np.concatenate(own), np.concatenate(at)
            order = np.argsort(at, kind="stable")
            own, at = own[order], at[order]
            cuts = np.searchsorted(at, first)
            rows = np.flatnonzero(np.diff(cuts))
            if len(rows):
                pick = pa.array(rows)
                lists = [pa.array([x[cuts[i] : cuts[i + 1]] for i in rows], pa.list_(pa.int64())) for x in (own.view(np.int64), at - np.repeat(first[:-1], np.diff(cuts)))]
                yield pa.RecordBatch.from_arrays([pa.array(row + rows), *[t.rows.column(c).take(pick) for c in keep], binary(h[first[i] : first[i + 1]] for i in rows), *lists], ["row", *keep, "words", "hash", "at"])
            row += len(t)

    return run


def _features(hashes: np.ndarray, places: np.ndarray, words_: np.ndarray) -> np.ndarray:
    """What names a word at a place counted from a seed."""
    return mix(hashes * _STEP[0] + places.astype(np.int64).view(np.uint64) * _STEP[1] + words_ * _STEP[2])


def _with_features(keep: list[str], of: Callable[[pa.RecordBatch], Callable[[int], np.ndarray]]):
    """For each row its kept columns beside each of its features."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names, held, at = of(b), [], 0
            for i in range(b.num_rows):
                held.append(names(i))
                if i + 1 == b.num_rows or sum(map(len, held[-64:])) > 1 << 16 or len(held) >= 4096:
                    rows = pa.array(np.repeat(np.arange(at, i + 1), [len(x) for x in held]))
                    yield pa.RecordBatch.from_arrays([*[b.column(c).take(rows) for c in keep], pa.array(np.concatenate(held).view(np.int64))], [*keep, "feature"])
                    held, at = [], i + 1

    return run


def _beside_in_items(b: pa.RecordBatch) -> Callable[[int], np.ndarray]:
    """The words of an item beside those that its seed has."""
    hashes, place, kind = b.column("hash").to_numpy().view(np.uint64), b.column("place").to_numpy(), b.column("kind").to_numpy()

    def names(i: int) -> np.ndarray:
        own = np.frombuffer(b.column("words")[i].as_buffer(), np.uint64)
        at = np.delete(np.arange(len(own)), [place[i] + j for j, c in enumerate(_KINDS[kind[i]]) if c == "1"])
        return _features(np.full(len(at), hashes[i]), at - place[i], own[at])

    return names


def _beside_in_texts(b: pa.RecordBatch) -> Callable[[int], np.ndarray]:
    """The words of a text around a seed."""
    hashes, first = b.column("hash").to_numpy().view(np.uint64), b.column("first").to_numpy()

    def names(i: int) -> np.ndarray:
        own = np.frombuffer(b.column("near")[i].as_buffer(), np.uint64)
        return _features(np.full(len(own), hashes[i]), np.arange(len(own)) + first[i], own)

    return names


def _shared(table: DataFrame, items: DataFrame, own: DataFrame, suspects: DataFrame) -> DataFrame:
    """Alignments (row, item, n, begin) by seeds that many items share, without those that cannot be leaks.

    A leak needs ``need`` equal words beside the seed's own, at the same distance from it. Of an item's other words all but
    ``need`` - 1 are looked up, those that most items with the seed have left out: with ``need`` equal ones, one of
    the rest is equal. What a template's items have in common, unless it is a leak, is thus never looked up.
    """
    keep = ["hash", "item", "n", "place", "need"]
    features = table.join(items.select("item", "words"), "item").mapInArrow(_with_features(keep, _beside_in_items), "hash long, item long, n int, place int, need int, feature long")
    features = stage(features, "seed_words")
    usual = features.groupBy("feature").agg(F.count("*").alias("usual"))
    whole = Window.partitionBy("hash", "item", "place")  # as many rows as an item has words
    one = whole.orderBy("usual", "feature")
    rare = features.join(usual, "feature").withColumns({"rank": F.row_number().over(one), "words": F.count("*").over(whole)}).where(F.col("rank") <= F.col("words") - F.col("need") + 1)
    reach = table.groupBy("hash").agg(F.min(-F.col("place")).alias("lo"), F.max(F.col("n") - 1 - F.col("place")).alias("hi"))
    lo = F.greatest(F.col("at") + F.col("lo"), F.lit(0))
    near = F.expr("substring(words, cast(8 * begin + 1 as int), cast(8 * (at + hi + 1 - begin) as int))")
    around = own.join(reach, "hash").join(suspects.select("row", "words"), "row").withColumn("begin", lo)
    around = around.select("row", "at", "hash", (F.col("begin") - F.col("at")).alias("first"), near.alias("near"))
    around = around.mapInArrow(_with_features(["row", "at"], _beside_in_texts), "row long, at long, feature long")
    return around.join(rare.select("feature", "item", "n", "place"), "feature").select("row", "item", "n", (F.col("at") - F.col("place")).alias("begin"))


def best_stretch(same: np.ndarray, penalty: float) -> tuple[int, int, int]:
    """The stretch with the largest (equal - penalty * substituted): (begin, end, equal)."""
    score = np.where(same, 1.0, -penalty)
    total = np.concatenate([[0], np.cumsum(score)])
    lowest = np.minimum.accumulate(total)
    end = int(np.argmax(total - lowest))
    begin = int(np.flatnonzero(total[: end + 1] == lowest[end])[-1])
    return begin, end, int(same[begin:end].sum())


def measure(own: np.ndarray, item: np.ndarray, item_words: int, min_words: int, penalty: float) -> tuple[int, int, int] | None:
    """Of aligned words of a text and an item: (begin, end, equal) of the leak, if it is one."""
    same = own == item
    equal = np.flatnonzero(same)
    if len(equal) and len(equal) >= item_words - item_words // 5:
        return int(equal[0]), int(equal[-1]) + 1, len(equal)
    begin, end, matched = best_stretch(same, penalty)
    return (begin, end, matched) if matched >= min_words and 3 * matched >= 2 * (end - begin) else None


def _measured(keep: list[str], min_words: int, penalty: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, lo, skip = (b.column(c).to_numpy() for c in ("n", "lo", "skip"))
            rows, out = [], []
            for i in range(b.num_rows):
                own, item = (np.frombuffer(b.column(c)[i].as_buffer(), np.uint64) for c in ("own", "words"))
                item = item[skip[i] : skip[i] + len(own)]
                if found := measure(own[: len(item)], item, int(n[i]), min_words, penalty):
                    rows.append(i)
                    out.append((n[i], found[2], skip[i] + found[0], lo[i] + found[0], lo[i] + found[1]))
            if rows:
                pick = pa.array(rows, pa.int64())
                cells = [pa.array([o[c] for o in out], pa.int32()) for c in range(5)]
                yield pa.RecordBatch.from_arrays([b.column(c).take(pick) for c in ("row", *keep, "item_id")] + cells, ["row", *keep, "item_id", "item_words", "matched", "item_start", "start_word", "end_word"])

    return run


def leaks(docs: DataFrame, benchmark: DataFrame, keep: tuple[str, ...], min_words: int = 13, min_item_words: int = 5, penalty: float = 0.5, hot: int = HOT) -> DataFrame:
    """One row for each row of ``docs`` and item of ``benchmark(item_id, text)`` that leaked into its ``text``: the columns
    ``keep`` of the row, item_id, item_words, matched, item_start, start_word, end_word. See ``find_leaks``."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("long"), F.lit(-1)).alias("item_id"), "text").where("text is not null").distinct()
    items = items.withColumn("item", F.monotonically_increasing_id())
    items = stage(items.mapInArrow(_items(min_item_words), "item long, item_id long, words binary, hash array<long>, place array<int>, kind array<int>"), "items")
    table = items.select("item", (F.octet_length("words") / 8).cast("int").alias("n"), F.explode(F.arrays_zip("hash", "place", "kind")).alias("s")).select("item", "n", "s.hash", "s.place", "s.kind")
    # words of a leak beside those of the seed; where there are none, each meeting is a leak
    weight = F.element_at(F.array(*[F.lit(k.count("1")) for k in _KINDS]), F.col("kind") + 1)
    need = F.least(F.lit(min_words), F.col("n") - F.floor(F.col("n") / 5)).cast("int") - weight
    often = table.groupBy("hash").count().where(F.col("count") > hot)
    table = table.join(often, "hash", "left").withColumn("need", need).withColumn("many", F.col("count").isNotNull() & (F.col("need") > 0)).drop("count")
    table = stage(table, "seeds")
    counts = table.groupBy("kind", "many").count().collect()  # a few masks
    kinds = {r["kind"] for r in counts}
    bits, n = _bits(table, sum(r["count"] for r in counts))
    types = dict(docs.dtypes)
    fields = "".join(f"{c} {types[c]}, " for c in keep)
    suspects = docs.select(*keep, "text").mapInArrow(_suspects(bits, n, [_KINDS[k] for k in sorted(kinds)], list(keep)), f"row long, {fields}words binary, hash array<long>, at array<long>")
    suspects = stage(suspects, "suspects")
    own = suspects.select("row", F.explode(F.arrays_zip("hash", "at")).alias("s")).select("row", "s.hash", "s.at")
    met = own.join(table.where("not many"), "hash").select("row", "item", "n", (F.col("at") - F.col("place")).alias("begin"))
    if any(r["many"] for r in counts):
        met = met.unionByName(_shared(table.where("many"), items, own, suspects))
    met = met.distinct()
    met = met.join(items.select("item", "item_id", "words"), "item")
    rows = suspects.select("row", *keep, F.col("words").alias("text_words"))
    # the words of the text that lie beside the item's
    lo = F.greatest(F.col("begin"), F.lit(0))
    beside = met.join(rows, "row").withColumns({"lo": lo, "skip": lo - F.col("begin")})
    window = F.expr("substring(text_words, cast(8 * lo + 1 as int), cast(8 * (n - skip) as int))")
    beside = beside.select("row", *keep, "item_id", "n", "lo", "skip", "words", window.alias("own"))
    out = "item_id long, item_words int, matched int, item_start int, start_word int, end_word int"
    found = beside.mapInArrow(_measured(list(keep), min_words, penalty), f"row long, {fields}{out}")
    # of several alignments with one item, the one with most equal words, then the first in the text, then the longest item
    rank = F.struct("matched", -F.col("start_word"), "item_words", -F.col("item_start"), -F.col("end_word"))
    best = found.groupBy("row", "item_id").agg(F.max_by(F.struct(*keep, "item_words", "matched", "item_start", "start_word", "end_word"), rank).alias("b"))
    return best.select(*[f"b.{c}" for c in keep], "item_id", "b.item_words", "b.matched", "b.item_start", "b.start_word", "b.end_word")


def find_leaks(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """Pairs of ``docs(doc_id, text)`` and ``benchmark(item_id, text)`` items that leaked into them, one row a pair and row of docs:
    doc_id, item_id, item_words, matched, item_start, start_word, end_word.

    Text and item are aligned; a leak has four fifths of the item's words equal, or a stretch with ``min_words`` equal words that
    are two thirds of its own; a stretch grows while a substituted word costs less, at ``penalty`` equal ones, than
    what follows brings. All items of 5 to 16 words are found with a fifth of their words substituted, wherever
    these are; in longer ones some window of 16 words needs to have no more than 3 substituted. Words are runs of
    non-blank characters, A-Z lower-cased. ``start_word`` and ``end_word`` (exclusive) are places in the
    text, ``item_start`` in the item; of several alignments with most equal words the first in the text is reported.

    Null and empty texts have no leaks; texts of any length are read whole. Items with fewer than ``min_item_words`` words
    (null ones too) carry too little to tell a leak and are not looked for; with a smaller ``min_item_words`` those
    below 5 words are found where they stand whole. A null item_id counts as -1. Items that are repeated, or
    share an id, are all looked for, and the best is kept. Seeds of more than ``hot`` items (items made from a template) are
    looked up with words beside them that fewer items have, which changes no result. Rows that repeat, or share a doc_id, report each their own; a
    null doc_id reports as null. Other columns are not looked at. Empty inputs give no rows.
    """
    return leaks(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), benchmark, ("doc_id",), **options)


def without_leaks(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` whose ``text`` has no leak of ``benchmark``, with all their columns; null texts stay.

    Rows are matched by two 64-bit hashes of the text, whatever their other columns hold.
    """
    used = {c.lower() for c in docs.columns}
    free = lambda name: name if name not in used else free(f"_{name}")
    one, two = free("text_hash"), free("text_hash_2")
    keys = {one: F.xxhash64("text"), two: F.xxhash64(F.lit(1), "text")}
    found = leaks(docs.select("text").withColumns(keys), benchmark, (one, two), **options)
    found = stage(found.select(one, two).distinct(), "leaky")
    return docs.withColumns(keys).join(found, [one, two], "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
