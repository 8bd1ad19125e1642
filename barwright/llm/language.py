"""Language identification by mixtures: each document is a mixture of languages whose shares are inferred.

A language is a distribution over hashed byte trigrams, learnt from labelled documents. A text is read in blocks of a
few dozen bytes; expectation-maximisation estimates the shares of the languages from the blocks' likelihoods. Languages
are then given up, smallest share first, as long as the likelihood lost is below a penalty that grows with the
logarithm of the number of blocks: what stays is the document's language set, its largest share the prediction.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barwright.llm.quality import fold
from barwright.llm.textarrays import LOWER, slices

#: Hashed trigrams (bits), bytes of a block, and labelled documents that the language models take at most.
BITS, BLOCK, MOST_LABELLED = 15, 48, 8000


def trigrams(data: np.ndarray) -> np.ndarray:
    """Hashed trigram at every byte but the last two, A-Z lower-cased."""
    if len(data) < 3:
        return np.zeros(0, np.int64)
    low = LOWER[data].astype(np.uint32)
    return ((low[:-2] << np.uint32(16) | low[1:-1] << np.uint32(8) | low[2:]) * np.uint32(2654435761) >> np.uint32(32 - BITS)).astype(np.int64)


@dataclass
class Models:
    names: list[str]
    #: log p(trigram | language), trigrams by languages
    logs: np.ndarray

    def mixtures(self, data: np.ndarray, offs: np.ndarray, rounds: int, penalty: float) -> np.ndarray:
        """Shares of the languages in each text, zero for those given up."""
        n_texts, n_langs = len(offs) - 1, len(self.names)
        codes = trigrams(data)
        # the trigrams of each text, without those that reach into the next
        lens = np.maximum(np.diff(offs) - 2, 0)
        at = np.arange(lens.sum()) + np.repeat(offs[:-1] - (np.cumsum(lens) - lens), lens)
        blocks = -(-lens // BLOCK)
        begin = np.repeat(np.cumsum(lens) - lens, blocks) + BLOCK * (np.arange(blocks.sum()) - np.repeat(np.cumsum(blocks) - blocks, blocks))
        shares = np.full((n_texts, n_langs), 1 / n_langs)
        if not len(begin):
            return shares
        ll = np.empty((len(begin), n_langs))
        own = codes[at]
        for j in range(n_langs):
            ll[:, j] = np.add.reduceat(self.logs[:, j][own], begin)
        text = np.repeat(np.arange(n_texts), blocks)
        has = np.flatnonzero(blocks)
        cut = (np.cumsum(blocks) - blocks)[has]
        like = np.exp(np.maximum(ll - ll.max(axis=1, keepdims=True), -60))

        def em(pi: np.ndarray, times: int) -> tuple[np.ndarray, np.ndarray]:
            for _ in range(times):
                r = pi[text] * like
                total = r.sum(axis=1, keepdims=True)
                r /= total
                pi = pi.copy()
                pi[has] = np.add.reduceat(r, cut) / blocks[has, None]
            value = np.full(n_texts, 0.0)
            value[has] = np.add.reduceat(np.log((pi[text] * like).sum(axis=1)), cut)
            return pi, value

        shares, value = em(shares, rounds)
        cost = penalty * np.log(np.maximum(blocks, 2))
        live = np.ones(n_texts, bool)
        for _ in range(n_langs - 1):
            rank = np.where(shares > 0, shares, np.inf)
            drop = np.argmin(rank, axis=1)
            fewer = shares.copy()
            rows = np.flatnonzero(live & ((shares > 0).sum(axis=1) > 1) & (blocks > 0))
            if not len(rows):
                break
            fewer[rows, drop[rows]] = 0
            fewer[rows] /= fewer[rows].sum(axis=1, keepdims=True)
            fewer = np.where((shares > 0) & (fewer > 0), np.maximum(fewer, 1e-12), 0.0)
            fewer, less = em(fewer, 3)
            kept = rows[value[rows] - less[rows] < cost[rows]]
            live[:] = False
            live[kept] = True
            shares[kept], value[kept] = fewer[kept], less[kept]
        return shares


def _counts(batches):
    for b in batches:
        lang = np.array(b.column("lang").to_pylist(), object)
        names = sorted(set(lang))
        total = np.zeros((len(names), 1 << BITS), np.int64)
        at = 0
        for t in slices([b]):
            for i in range(len(t)):
                total[names.index(lang[at + i])] += np.bincount(trigrams(t.data[t.offs[i] : t.offs[i + 1]]), minlength=1 << BITS)
            at += len(t)
        row, gram = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array([names[i] for i in row], pa.string()), pa.array(gram.astype(np.int32)), pa.array(total[row, gram])], ["lang", "gram", "count"])


def train(docs: DataFrame, most: int = MOST_LABELLED, held_out: int = 2, of: int = 4, smooth: float = 0.05) -> Models:
    """Language models from ``docs(doc_id, text, lang)`` with a non-null lang and text, whose fold is not ``held_out``.

    At most ``most`` documents are taken, in the order of a hash of the id; their texts are read whole. A null id
    has no fold and is not learnt from.
    """
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id")).where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold(of=of) != held_out)).distinct()
    ids = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)  # bounded by ``most``, so it may be broadcast
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("lang").cast("string").alias("lang")).where("text is not null and lang is not null").join(F.broadcast(ids), "doc_id")
    got = rows.mapInArrow(_counts, "lang string, gram int, count long").groupBy("lang", "gram").agg(F.sum("count").alias("count")).toArrow()
    names = sorted(set(got.column("lang").to_pylist()))
    counts = np.zeros((1 << BITS, len(names)))
    where = {x: i for i, x in enumerate(names)}
    counts[got.column("gram").to_numpy(), [where[x] for x in got.column("lang").to_pylist()]] = got.column("count").to_numpy()
    total = counts.sum(axis=0)
    smoothed = counts + smooth * (1 + counts.sum(axis=1, keepdims=True) / max(counts.sum(), 1) * (1 << BITS))
    return Models(names, np.log(smoothed / np.maximum(smoothed.sum(axis=0), 1e-9)) if total.size else np.zeros((1 << BITS, 0)))


RESULT = "struct<lang_pred:string,score:double,languages:array<struct<lang:string,share:double>>>"


def language_column(models: Models, text: str = "text", rounds: int = 12, penalty: float = 3.0) -> Column:
    """A struct: lang_pred, score (its share) and languages (the document's set with shares, largest first).

    A null text, and one without a letter, is ``und`` with score 0 and no languages; so is every text if no
    language was learnt. Equal shares go to the smaller name.
    """

    def run(texts: pa.Array) -> pa.Array:
        letters = pc.fill_null(pc.match_substring_regex(texts, r"\p{L}"), False).to_numpy(zero_copy_only=False)
        out, at = [], 0
        for t in slices([pa.RecordBatch.from_arrays([texts], ["text"])]):
            shares = models.mixtures(t.data, t.offs, rounds, penalty) if models.names else None
            for i in range(len(t)):
                if shares is None or not letters[at + i]:
                    out.append({"lang_pred": "und", "score": 0.0, "languages": []})
                    continue
                order = np.argsort(-shares[i], kind="stable")
                held = [{"lang": models.names[j], "share": float(shares[i, j])} for j in order if shares[i, j] > 0]
                out.append({"lang_pred": held[0]["lang"], "score": min(1.0, held[0]["share"]), "languages": held})
            at += len(t)
        kind = pa.struct([("lang_pred", pa.string()), ("score", pa.float64()), ("languages", pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())])))])
        return pa.array(out, kind)

    return F.arrow_udf(run, RESULT)(F.col(text))


def identify_languages(docs: DataFrame, held_out: int = 2, of: int = 4, **options) -> DataFrame:
    """One row per row of ``docs(doc_id, text, lang)``: doc_id, held_out, lang_pred, score, languages.

    ``lang`` is only learnt from (see ``train``). A null doc_id has a null held_out; repeated rows have equal results.
    Other columns are not looked at. An empty table gives no rows.
    """
    models = train(docs, held_out=held_out, of=of, **options)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), language_column(models).alias("found"))
    return rows.select("doc_id", (fold(of=of) == held_out).alias("held_out"), "found.lang_pred", "found.score", "found.languages")
