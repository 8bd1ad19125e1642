"""Token files: frequency-ranked ids in a byte-aligned variable-length code with separate control bytes.

An id is replaced by its rank among the ids of the corpus, most frequent first, so that the 256 most frequent take
one byte. Four values share a control byte with two bits each, the value's bytes less one; the data bytes stand apart.
A numpy table of the 256 control bytes gives all lengths at once, and sums of lengths the places to read.

A token folder has two Parquet data sets, so that Spark's commit protocol, its readers and any store serve it:

- ``ranks``: id, rank, count; one row for each id that occurs.
- ``blocks``: documents in ascending doc_id order in rows of about ``BLOCK_TOKENS`` ids: shard and block (their
  order is the order of documents), first_token (ids of the shard before the block), n_tokens, doc_ids, lengths, control, data.

Texts are tokenized where they are read, and only ids, two bytes each, are sorted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barwright.llm.tokens import as_ids, tokenize
from barwright.plans.shared import stage

BLOCK_TOKENS = 1 << 16
BLOCKS = "shard int, block long, first_token long, n_tokens long, doc_ids array<long>, lengths array<long>, control binary, data binary"
#: Bytes of each of the four values of a control byte.
LENGTHS = np.array([[(c >> (2 * i) & 3) + 1 for i in range(4)] for c in range(256)], np.uint8)


def encode(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Control bytes and data bytes of unsigned 32-bit values."""
    values = values.astype("<u4")
    size = 1 + (values > 0xFF) + (values > 0xFFFF) + (values > 0xFFFFFF)
    codes = np.zeros(-(-len(values) // 4) * 4, np.uint8)
    codes[: len(values)] = size - 1
    codes = codes.reshape(-1, 4)
    control = codes[:, 0] | codes[:, 1] << 2 | codes[:, 2] << 4 | codes[:, 3] << 6
    wide = values.view(np.uint8).reshape(-1, 4)
    return control.astype(np.uint8), wide[np.arange(4) < size[:, None]]


def decode(control: np.ndarray, data: np.ndarray, n: int) -> np.ndarray:
    """The n values of control and data bytes."""
    size = LENGTHS[control].reshape(-1)[:n].astype(np.int64)
    at = np.cumsum(size) - size
    padded = np.concatenate([data, np.zeros(4, np.uint8)])
    out = padded[at].astype(np.uint32)
    for i in (1, 2, 3):
        more = np.flatnonzero(size > i)
        if len(more):
            out[more] |= padded[at[more] + i].astype(np.uint32) << np.uint32(8 * i)
    return out


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(1 << 16, np.int64)
    for batch in batches:
        ids, width = batch.column("ids"), batch.column("width").to_numpy()
        for w in (2, 4):
            own = [ids[int(i)].as_buffer() for i in np.flatnonzero(width == w)]
            if own:
                got = np.bincount(np.concatenate([as_ids(x, w) for x in own]))
                if len(got) > len(total):
                    total = np.pad(total, (0, len(got) - len(total)))
                total[: len(got)] += got
    seen = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], ["id", "count"])


def _blocks(ranks: np.ndarray, most: int):
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary()]
    names = ["shard", "block", "first_token", "n_tokens", "doc_ids", "lengths", "control", "data"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, block, first = TaskContext.get().partitionId(), 0, 0
        docs, lens, values, total = [], [], [], 0

        def packed() -> pa.RecordBatch:
            control, data = encode(ranks[np.concatenate(values)])
            cells = (shard, block, first, total, docs, lens, control.tobytes(), data.tobytes())
            return pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip(cells, kinds, strict=True)], names)

        for batch in batches:
            doc, n, width = (batch.column(c).to_pylist() for c in ("doc_id", "n_tokens", "width"))
            ids = batch.column("ids")
            for i in range(batch.num_rows):
                if total >= most:
                    yield packed()
                    block, first = block + 1, first + total
                    docs, lens, values, total = [], [], [], 0
                docs.append(doc[i])
                lens.append(n[i])
                values.append(as_ids(ids[i].as_buffer(), width[i]))
                total += n[i]
        if docs:
            yield packed()

    return run


def write_token_files(docs: DataFrame, folder: str, path: str | None = None, end_id: int = 1, block_tokens: int = BLOCK_TOKENS) -> None:
    """Encode ``docs(doc_id, text)`` and write ``ranks`` and ``blocks`` below ``folder``, in ascending doc_id order.

    Null texts are empty: they have ``end_id`` alone. Null doc_ids come first; rows that share a doc_id are in
    the order of a hash of their texts, repeated rows each keep their own place. Other columns are not looked at. Without
    rows both data sets are written with no row. The rank table has at most one row for each id of the vocabulary and is
    the only thing that reaches the driver.
    """
    tokens = stage(tokenize(docs, path, end_id), "tokens")
    counts = tokens.select("ids", "width").mapInArrow(_counts, "id long, count long").groupBy("id").agg(F.sum("count").alias("count"))
    ranks = counts.select("id", (F.row_number().over(Window.orderBy(F.desc("count"), "id")) - 1).alias("rank"), "count")
    ranks.write.parquet(f"{folder}/ranks")
    table = np.zeros(0, np.uint32)
    if found := docs.sparkSession.read.parquet(f"{folder}/ranks").select("id", "rank").collect():
        table = np.zeros(max(r.id for r in found) + 1, np.uint32)
        table[[r.id for r in found]] = [r.rank for r in found]
    # (part and seq split equal rows, however many there are, over tasks)
    order = [F.col("doc_id").asc_nulls_first(), "key", "part", "seq"]
    ordered = tokens.select("doc_id", "key", "part", "seq", "n_tokens", "width", "ids").repartitionByRange(*order).sortWithinPartitions(*order)
    ordered.select("doc_id", "n_tokens", "width", "ids").mapInArrow(_blocks(table, block_tokens), BLOCKS).write.parquet(f"{folder}/blocks")


def _read(ids_of: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in range(batch.num_rows):
                lens = batch.column("lengths")[b].values.to_numpy()
                ends = np.cumsum(lens)
                control, data = (np.frombuffer(batch.column(c)[b].as_buffer(), np.uint8) for c in ("control", "data"))
                ids = ids_of[decode(control, data, int(ends[-1]))]
                start = batch.column("first_token")[b].as_py() + ends - lens
                yield pa.RecordBatch.from_arrays([batch.column("doc_ids")[b].values, pa.array(start), pa.array(lens), pa.array([ids[e - n : e].tobytes() for n, e in zip(lens, ends, strict=True)], pa.binary())], ["doc_id", "start", "n_tokens", "ids"])

    return run


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """The documents of a token folder: doc_id, start (ids before it), n_tokens, ids (little-endian unsigned 32-bit integers)."""
    found = spark.read.parquet(f"{folder}/ranks").select("id", "rank").collect()
    ids_of = np.zeros(len(found), "<u4")
    ids_of[[r["rank"] for r in found]] = [r["id"] for r in found]
    blocks = spark.read.schema(BLOCKS).parquet(f"{folder}/blocks")
    # of the shards one row each, of 16 bytes, is summed up and broadcast
    totals = blocks.groupBy("shard").agg(F.sum("n_tokens").alias("total"))
    before = totals.select("shard", (F.sum("total").over(Window.orderBy("shard")) - F.col("total")).alias("before"))
    blocks = blocks.join(F.broadcast(before), "shard").withColumn("first_token", F.col("before") + F.col("first_token"))
    return blocks.select("first_token", "doc_ids", "lengths", "control", "data").mapInArrow(_read(ids_of), "doc_id long, start long, n_tokens long, ids binary")
