"""Ranked lexical search: all documents against all items of a query set, as a blocked sparse matrix product.

The rows of one matrix are items, with a term's multiplicity in each; those of the other are terms, with a document's
integer impact. Documents come in blocks of a few megabytes of text: a block's counts of the terms that items hold are
written once, as sparse columns; the totals of all blocks give the weights; then each block is multiplied with the
items, row by row (Gustavson: the impact rows of an item's terms are added into one row of scores), and every task keeps the best
of the blocks it has seen. Only those go through a shuffle.

The query set may be of any size: items are dealt into blocks by a hash, so many that a block has about ``BLOCK_PAIRS``
distinct pairs of item and term (one item's own terms are the least a block can have). A block's pairs, and the totals
of its terms, are what the driver and each worker hold at a time.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barwright.llm.textarrays import LOWER, Texts, binary, slices
from barwright.plans.shared import stage

BLOCK_PAIRS = 1 << 19
BLOCK_BYTES = 4 << 20
#: Partial results meet in this many parts of an item first.
PARTS = 64
#: 100 - 90 and 90 in the length term, the impact's scale, a weight's scale.
FLAT, SLOPE, SCALE, WEIGHT = 10, 90, 1_000_000_000, 1000

TERM = np.zeros(256, bool)
for _a, _b in ((0x30, 0x3A), (0x41, 0x5B), (0x61, 0x7B), (0x80, 0x100)):
    TERM[_a:_b] = True

_ITEMS = "item_id long, term binary, times long"
_BLOCKS = "docs long, terms long, ids binary, nulls binary, lengths binary, term binary, df binary, doc binary, tf binary"
_BEST = "item_id long, part int, doc_id long, score long"


def terms(t: Texts) -> tuple[pa.Array, np.ndarray]:
    """All terms of a slice, A-Z lower-cased, and the first of each text (plus the total)."""
    inside = np.zeros(len(t.data) + 2, bool)
    inside[1:-1] = TERM[t.data]
    change = inside[1:] != inside[:-1]
    change[t.offs] |= inside[t.offs] & inside[t.offs + 1]  # a term ends with its text
    edges = np.flatnonzero(change)
    both = np.flatnonzero(inside[edges] & inside[edges + 1]) if len(edges) else edges
    edges = np.sort(np.concatenate([edges, edges[both]]))  # where one ends and the next begins
    starts = edges[::2]
    # terms and what lies between them as one array over the lower-cased bytes: every other one is a term
    offsets = np.append(edges, edges[-1:]).astype(np.int64) if len(edges) else np.zeros(1, np.int64)
    every = pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(LOWER[t.data]))])
    return every, np.searchsorted(starts, t.offs)


def _own(every: pa.Array, values: pa.Array) -> np.ndarray:
    """For each term its place among ``values``, or -1."""
    return pc.index_in(every, values).fill_null(-1).to_numpy(zero_copy_only=False)[::2].astype(np.int64)


def item_terms(items: DataFrame) -> DataFrame:
    """(item_id, term, times) of ``items(item_id, text)``; rows of one item_id, null among them, are one item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in slices(batches):
            every, first = terms(t)
            if len(every):
                own = every.take(pa.array(np.arange(0, len(every), 2))).cast(pa.binary())
                ids = t.rows.column("item_id").take(pa.array(np.repeat(np.arange(len(t)), np.diff(first))))
                yield pa.RecordBatch.from_arrays([ids, own, pa.array(np.ones(len(own), np.int64))], ["item_id", "term", "times"])

    found = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, _ITEMS)
    return found.groupBy("item_id", "term").agg(F.sum("times").alias("times"))


def count_blocks(docs: DataFrame, vocabulary: pa.Array) -> DataFrame:
    """A row for each block of ``docs(doc_id, text)``: ids and lengths of its documents, and the counts of ``vocabulary`` by term.

    ``term`` and ``df`` say which terms it has and in how many of its documents, ``doc`` and ``tf`` go through these documents
    term by term. A document without a term is left out: it has no score and counts in no total.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in slices(batches, most=BLOCK_BYTES):
            every, first = terms(t)
            lengths = np.diff(first)
            some = np.flatnonzero(lengths)
            if not len(some):
                continue
            at = _own(every, shared.value)
            doc = np.repeat(np.arange(len(some)), lengths[some])
            known = at >= 0
            keys, tf = np.unique(at[known] * len(some) + doc[known], return_counts=True)
            term, df = np.unique(keys // len(some), return_counts=True)
            ids = t.column("doc_id")[some].astype("<i8")
            nulls = t.rows.column("doc_id").is_null().to_numpy(zero_copy_only=False)[some]
            cells = [ids, np.packbits(nulls), lengths[some].astype("<i4"), term.astype("<u4"), df.astype("<u4"), (keys % len(some)).astype("<u4" if len(some) > 65536 else "<u2"), tf.astype("<u4" if tf.max(initial=0) > 65535 else "<u2")]
            yield pa.RecordBatch.from_arrays([pa.array([len(some)]), pa.array([int(lengths.sum())]), *[binary([c]) for c in cells]], [c.split()[0] for c in _BLOCKS.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, _BLOCKS)


def totals(blocks: DataFrame, n_terms: int) -> tuple[int, int, np.ndarray]:
    """Documents and terms of all blocks, and the documents of each of the vocabulary's terms (as many numbers as it has)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(n_terms + 2, np.int64)
        for batch in batches:
            sums[n_terms:] += [pc.sum(batch.column("docs")).as_py() or 0, pc.sum(batch.column("terms")).as_py() or 0]
            for term, df in zip(batch.column("term").to_pylist(), batch.column("df").to_pylist(), strict=True):
                sums[np.frombuffer(term, "<u4")] += np.frombuffer(df, "<u4")
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(sums[at])], ["at", "n"])

    found = blocks.select("docs", "terms", "term", "df").mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    sums = np.zeros(n_terms + 2, np.int64)
    sums[found.column("at").to_numpy()] = found.column("n").to_numpy()
    return int(sums[n_terms]), int(sums[n_terms + 1]), sums[:n_terms]


@dataclass
class Product:
    """What a worker needs for a block of items: rows of terms with their multiplicities, and the weights."""

    items: list[int | None]
    first: np.ndarray
    term: np.ndarray
    times: np.ndarray
    weight: np.ndarray
    docs: int
    terms: int

    def rows(self, lengths: np.ndarray, term: np.ndarray, df: np.ndarray, doc: np.ndarray, tf: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """Each item's scores of a block's documents: (place of the item, scores). The array is used again for the next item."""
        m = FLAT + (SLOPE * lengths.astype(np.int64) * self.docs) // self.terms
        tf = tf.astype(np.int64)
        impact = np.repeat(self.weight[term], df) * ((SCALE * tf) // (WEIGHT * tf + 8 * m[doc]))
        end = np.concatenate([[0], np.cumsum(df.astype(np.int64))])
        place = np.full(len(self.weight), -1, np.int64)
        place[term] = np.arange(len(term))
        own = place[self.term]
        row = np.zeros(len(lengths), np.int64)
        for i in range(len(self.items)):
            row[:] = 0
            here = slice(self.first[i], self.first[i + 1])
            for p, times in zip(own[here], self.times[here], strict=True):
                if p >= 0:
                    a, b = end[p], end[p + 1]
                    row[doc[a:b]] += impact[a:b] if times == 1 else times * impact[a:b]
            yield i, row


def _best(k: int, scores: np.ndarray, ids: np.ndarray, nulls: np.ndarray) -> np.ndarray:
    """Places of the k highest scores, equal ones by ascending id, null last."""
    at = np.arange(len(scores))
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        at = np.flatnonzero(scores >= least)
    return at[np.lexsort((ids[at], nulls[at], -scores[at]))[:k]]


def best_of_blocks(blocks: DataFrame, product: Product, k: int) -> DataFrame:
    """Each task's ``k`` best documents of every item: (item_id, part, doc_id, score)."""
    shared = blocks.sparkSession.sparkContext.broadcast(product)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = shared.value
        empty = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool))
        held = [empty] * len(p.items)
        for batch in batches:
            for r in range(batch.num_rows):
                cell = lambda name, kind, r=r, batch=batch: np.frombuffer(batch.column(name)[r].as_buffer(), kind)
                ids, lengths, term, df = cell("ids", "<i8"), cell("lengths", "<i4"), cell("term", "<u4"), cell("df", "<u4")
                nulls = np.unpackbits(cell("nulls", np.uint8))[: len(ids)].astype(bool)
                n = int(df.sum())
                doc, tf = (cell(c, "<u2" if len(batch.column(c)[r].as_buffer()) == 2 * n else "<u4") for c in ("doc", "tf"))
                for i, row in p.rows(lengths, term, df, doc, tf):
                    scores, own, null = held[i]
                    at = np.flatnonzero(row >= max(1, scores[-1] if len(scores) == k else 1))
                    if len(at):
                        at = at[_best(k, row[at], ids[at], nulls[at])]
                        scores, own, null = np.concatenate([scores, row[at]]), np.concatenate([own, ids[at]]), np.concatenate([null, nulls[at]])
                        keep = _best(k, scores, own, null)
                        held[i] = scores[keep], own[keep], null[keep]
        count = [len(s) for s, _, _ in held]
        if sum(count):
            part = TaskContext.get().partitionId() % PARTS
            scores, own, null = (np.concatenate(x) for x in zip(*held, strict=True))
            names = pa.array(p.items, pa.int64()).take(pa.array(np.repeat(np.arange(len(p.items)), count)))
            yield pa.RecordBatch.from_arrays([names, pa.array(np.full(len(own), part, np.int32)), pa.array(own, mask=null), pa.array(scores)], ["item_id", "part", "doc_id", "score"])

    return blocks.select("ids", "nulls", "lengths", "term", "df", "doc", "tf").mapInArrow(run, _BEST)


def rank_documents(docs: DataFrame, items: DataFrame, k: int = 10, repeats: bool = False, block_pairs: int = BLOCK_PAIRS) -> DataFrame:
    """The ``k`` best of ``docs(doc_id, text)`` for each of ``items(item_id, text)``: (item_id, rank, doc_id, score), scores above 0.

    Terms are runs of letters and digits, and of all characters beyond ASCII; A-Z are lower-cased. ``repeats`` counts an item's term as
    often as it has it, else once. Equal scores rank by ascending doc_id, null last; repeated rows of a document have ranks of
    their own. Rows of one item_id (or of a null one) are one item. Null and empty texts have no terms, and no result.
    Other columns are not looked at. Without documents or items there are no rows.
    """
    spark = docs.sparkSession
    pairs = stage(item_terms(items), "item-terms")
    n_blocks = -(-pairs.count() // block_pairs)
    found = []
    for b in range(n_blocks):
        own = pairs.where(F.pmod(F.xxhash64("item_id"), F.lit(n_blocks)) == b).orderBy(F.col("item_id").asc_nulls_first(), "term").toArrow()
        if not own.num_rows:
            continue
        vocabulary = own.column("term").combine_chunks().cast(pa.large_binary()).unique()
        ids = own.column("item_id").to_pylist()
        first = np.flatnonzero([i == 0 or ids[i] != ids[i - 1] for i in range(len(ids))])
        blocks = stage(count_blocks(docs, vocabulary), "search-blocks")
        n_docs, n_terms, df = totals(blocks, len(vocabulary))
        if not n_docs:
            continue
        weight = np.array([math.floor(WEIGHT * math.log((2 * n_docs + 2) / (2 * int(x) + 1))) for x in df], np.int64)
        times = own.column("times").to_numpy() if repeats else np.ones(len(ids), np.int64)
        at = pc.index_in(own.column("term").combine_chunks().cast(pa.large_binary()), vocabulary).to_numpy().astype(np.int64)
        product = Product([ids[i] for i in first], np.append(first, len(ids)), at, times, weight, n_docs, n_terms)
        found.append(stage(best_of_blocks(blocks, product, k), "search-best"))
    if not found:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    best = found[0]
    for more in found[1:]:
        best = best.union(more)
    order = (F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    for keys in (("item_id", "part"), ("item_id",)):
        best = best.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k)
    return best.select("item_id", "rank", "doc_id", "score")
