"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

The score of a text is a logistic of w0 + sum w_i x_i + sum over pairs <v_i, v_j> x_i x_j; with the sum-of-squares
identity the pairs cost as much as the features. Hashed words, each distinct one once, have x = 1 / sqrt(distinct words);
structure and metadata are standardised.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barwright.llm.textarrays import U64, mix, slices, word_hashes, words

#: Hashed word features (a power of two), factors of a feature, and labelled rows that a fit takes at most.
WORDS, FACTORS, MOST_LABELLED = 1 << 15, 8, 6000
_UPPER, _LETTER, _DIGIT, _MARK = (np.zeros(256, bool) for _ in range(4))
_UPPER[65:91] = _LETTER[65:91] = _LETTER[97:123] = _DIGIT[48:58] = True
_LETTER[128:] = True
_MARK[33:127] = ~(_LETTER | _DIGIT)[33:127]
STRUCTURE = ("bytes", "word length", "upper", "digits", "marks", "other bytes", "lines", "distinct words", "distinct lines", "words of no letter", "words that end in marks", "longest word", "has n_chars", "n_chars")


def _sum(values: np.ndarray, offs: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values, dtype=np.float64)])
    return total[offs[1:]] - total[offs[:-1]]


def features(text: pa.Array, n_chars: pa.Array):
    """For slices of the texts: (distinct word features, how many each text has, structure and metadata)."""
    batch = pa.RecordBatch.from_arrays([text, n_chars.cast(pa.float64())], ["text", "n_chars"])
    for t in slices([batch]):
        starts, ends, first = words(t)
        h = word_hashes(t.data, starts, ends)
        n_words = np.diff(first)
        doc = np.repeat(np.arange(len(t)), n_words)
        code = np.unique(doc.astype(np.int64) * WORDS + (h & U64(WORDS - 1)).astype(np.int64))
        counts = np.bincount(code // WORDS, minlength=len(t))
        size = np.diff(t.offs).astype(np.float64)
        some, some_words = np.maximum(size, 1), np.maximum(n_words, 1).astype(np.float64)
        share = lambda table: _sum(table[t.data], t.offs) / some
        # lines: runs between line feeds, by the hash of their words
        breaks = np.flatnonzero(t.data == 10)
        line = np.searchsorted(breaks, starts) if len(starts) else np.zeros(0, np.int64)
        new = np.concatenate([[True], (line[1:] != line[:-1]) | (doc[1:] != doc[:-1])]) if len(starts) else np.zeros(0, bool)
        lines = np.flatnonzero(new)
        sums = mix(np.add.reduceat(h, lines)) if len(lines) else np.zeros(0, np.uint64)
        line_doc = doc[lines]
        n_lines = np.bincount(line_doc, minlength=len(t))
        order = np.lexsort((sums, line_doc))
        fresh = np.concatenate([[True], (sums[order][1:] != sums[order][:-1]) | (line_doc[order][1:] != line_doc[order][:-1])]) if len(lines) else np.zeros(0, bool)
        n_fresh = np.bincount(line_doc[order][fresh], minlength=len(t))
        lens = (ends - starts).astype(np.float64)
        letters = np.concatenate([[0], np.cumsum(_LETTER[t.data])])
        longest = np.zeros(len(t))
        np.maximum.at(longest, doc, lens)
        by_word = lambda v: np.bincount(doc, v, minlength=len(t)) / some_words
        meta = t.rows.column("n_chars")
        known = meta.is_valid().to_numpy(zero_copy_only=False).astype(np.float64)
        stats = [
            np.log1p(size), by_word(lens), share(_UPPER), share(_DIGIT), share(_MARK), share(np.arange(256) > 127), np.log1p(n_lines), counts / some_words, n_fresh / np.maximum(n_lines, 1),
            by_word((letters[ends] == letters[starts]).astype(float)), by_word(_MARK[t.data[ends - 1]].astype(float) if len(ends) else lens), np.log1p(longest), known, np.log1p(np.maximum(meta.fill_null(0).to_numpy(zero_copy_only=False), 0)),
        ]
        yield (code % WORDS), counts, np.stack(stats, axis=1)


@dataclass
class Machine:
    """w0, weights and factors of WORDS hashed features and the structure features after them."""

    bias: float
    weights: np.ndarray
    factors: np.ndarray
    mean: np.ndarray
    scale: np.ndarray

    def inputs(self, code, counts, stats):
        """Feature numbers, values, and row bounds: each row's words, then its standardised statistics."""
        n, s = len(counts), stats.shape[1]
        z = np.clip((stats - self.mean) / self.scale, -4, 4)
        ends = np.cumsum(counts + s)
        bounds = np.concatenate([[0], ends])
        index, value = np.empty(bounds[-1], np.int64), np.empty(bounds[-1], np.float32)
        tail = (ends[:, None] - s + np.arange(s)).reshape(-1)
        head = np.ones(bounds[-1], bool)
        head[tail] = False
        index[head], index[tail] = code, np.tile(WORDS + np.arange(s), n)
        value[head] = np.repeat(1 / np.sqrt(np.maximum(counts, 1)), counts)
        value[tail] = z.reshape(-1)
        return index, value, bounds

    def raw(self, index, value, bounds):
        """Scores before the logistic, and the sums of v x of each row."""
        v = self.factors[index] * value[:, None]
        total, squares = np.add.reduceat(v, bounds[:-1]), np.add.reduceat(v * v, bounds[:-1])
        linear = np.add.reduceat(self.weights[index] * value, bounds[:-1])
        return self.bias + linear + 0.5 * (total * total - squares).sum(axis=1), total

    def score(self, code, counts, stats) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(*self.inputs(code, counts, stats))[0].astype(np.float64), -40, 40)))


def fit_machine(rows: list[tuple[np.ndarray, np.ndarray, int]], epochs: int = 12, rate: float = 0.1, decay: float = 1e-4, seed: int = 7, batch: int = 128) -> Machine:
    """Fit to (word features, statistics, label) by Adagrad on the logistic loss, in batches of a fixed shuffle."""
    rng = np.random.default_rng(seed)
    size = WORDS + len(STRUCTURE)
    stats = np.stack([r[1] for r in rows]) if rows else np.zeros((1, len(STRUCTURE)))
    m = Machine(0.0, np.zeros(size, np.float32), rng.normal(0, 0.02, (size, FACTORS)).astype(np.float32), stats.mean(axis=0), np.maximum(stats.std(axis=0), 1e-6))
    labels = np.array([r[2] for r in rows], np.float64)
    if not rows:
        m.factors[:] = 0  # nothing is known: 0.5 for every text
        return m
    p = np.clip(labels.mean(), 0.01, 0.99)
    m.bias = float(np.log(p / (1 - p)))
    seen_w, seen_v = np.full(size, 1e-6), np.full((size, FACTORS), 1e-6)
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for i in range(0, len(rows), batch):
            pick = order[i : i + batch]
            counts = np.array([len(rows[j][0]) for j in pick])
            index, value, bounds = m.inputs(np.concatenate([rows[j][0] for j in pick]), counts, stats[pick])
            raw, total = m.raw(index, value, bounds)
            off = (1 / (1 + np.exp(-np.clip(raw, -40, 40))) - labels[pick]) / len(pick)
            row = np.repeat(np.arange(len(pick)), np.diff(bounds))
            slope = (off[row] * value).astype(np.float64)
            used, at = np.unique(index, return_inverse=True)
            grad = np.bincount(at, slope) + decay * m.weights[used]
            seen_w[used] += grad * grad
            m.weights[used] -= (rate * grad / np.sqrt(seen_w[used])).astype(np.float32)
            pull = slope[:, None] * (total[row] - m.factors[index] * value[:, None])
            grad = np.stack([np.bincount(at, pull[:, f]) for f in range(FACTORS)], axis=1) + decay * m.factors[used]
            seen_v[used] += grad * grad
            m.factors[used] -= (0.3 * rate * grad / np.sqrt(seen_v[used])).astype(np.float32)
            m.bias -= rate * 0.1 * float(off.sum())
    return m


def _gather(batches):
    best = {}  # an id's least key so far: rows of the task that cannot stand for their id go no further
    for b in batches:
        keep = {}
        for i, (doc, key) in enumerate(zip(b.column("doc_id").to_pylist(), b.column("key").to_pylist(), strict=True)):
            if doc not in best or key < best[doc]:
                best[doc], keep[doc] = key, i
        b = b.take(pa.array(sorted(keep.values()), pa.int64()))
        at = 0
        for code, counts, stats in features(b.column("text"), b.column("n_chars")):
            cuts = np.concatenate([[0], np.cumsum(counts)])
            n = len(counts)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").slice(at, n), b.column("key").slice(at, n), b.column("label").slice(at, n), pa.array([code[cuts[i] : cuts[i + 1]].astype(np.int32).tobytes() for i in range(n)], pa.binary()), pa.array([stats[i].tobytes() for i in range(n)], pa.binary())],
                ["doc_id", "key", "label", "code", "stats"],
            )
            at += n


def with_n_chars(docs: DataFrame) -> Column:
    return F.col("n_chars").cast("double") if "n_chars" in docs.columns else F.lit(None).cast("double")


def fold(column: str = "doc_id", of: int = 3) -> Column:
    """crc32 of the id as text, modulo ``of``; null for a null id."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % of


def train(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED, held_out: int = 1, of: int = 3) -> Machine:
    """Fit on ``labels(doc_id, quality)`` of ``docs(doc_id, text[, n_chars])`` whose fold is not ``held_out``.

    At most ``most`` labelled ids are taken, in the order of a hash of the id; their texts are read whole. A null
    label or id is not learnt from; an id with several labels counts as 1 if any is 1. Of rows that share an
    id, the one with the least hash of its text and n_chars is learnt from. Without labelled rows the model gives every text the score 0.5.
    """
    ids = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("label")).where("doc_id is not null and label is not null")
    ids = ids.where(fold(of=of) != held_out).groupBy("doc_id").agg(F.max("label").alias("label"))
    ids = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)  # bounded by ``most``, so it may be broadcast
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), with_n_chars(docs).alias("n_chars")).join(F.broadcast(ids), "doc_id")
    rows = rows.withColumn("key", F.xxhash64("text", "n_chars")).mapInArrow(_gather, "doc_id long, key long, label int, code binary, stats binary")
    one = rows.groupBy("doc_id").agg(F.min(F.struct("key", "label", "code", "stats")).alias("r"))
    got = one.select("doc_id", "r.label", "r.code", "r.stats").toArrow().to_pylist()
    got.sort(key=lambda r: r["doc_id"])
    return fit_machine([(np.frombuffer(r["code"], np.int32).astype(np.int64), np.frombuffer(r["stats"], np.float64), int(r["label"] == 1)) for r in got])


def score_column(machine: Machine, docs: DataFrame) -> Column:
    """The score, 0 to 1, of each row of ``docs`` from its text (null: empty) and n_chars (null or absent: unknown)."""

    def run(text: pa.Array, n_chars: pa.Array) -> pa.Array:
        found = [machine.score(*x) for x in features(text, n_chars)]
        return pa.array(np.concatenate(found) if found else np.zeros(0))

    return F.arrow_udf(run, "double")(F.coalesce("text", F.lit("")), with_n_chars(docs))


def score_quality(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted; the model is fitted first (see ``train``).

    A null doc_id is scored like any other and has a null held_out. Repeated rows have equal scores. Columns other
    than doc_id, text and n_chars are not looked at. Empty tables give no rows.
    """
    machine = train(docs, labels, **options)
    held, of = options.get("held_out", 1), options.get("of", 3)
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), score_column(machine, docs).alias("score"))
    return out.select("doc_id", (fold(of=of) == held).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
