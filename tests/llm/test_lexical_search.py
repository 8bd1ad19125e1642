import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from barwright.llm import lexical_search as L
from barwright.llm.queries import op12_lexical_search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, k=10, repeats=False):
    own = [(i, terms(t)) for i, t in docs]
    own = [(i, w) for i, w in own if w]
    n_docs, total = len(own), sum(len(w) for _, w in own)
    asked = {}
    for i, t in items:
        for w in terms(t):
            asked.setdefault(i, {}).setdefault(w, 0)
            asked[i][w] += 1
    df = {}
    for _, w in own:
        for x in set(w):
            df[x] = df.get(x, 0) + 1
    out = []
    for item, words in asked.items():
        scored = []
        for i, w in own:
            m = 100 - 90 + (90 * len(w) * n_docs) // total
            s = 0
            for x, times in words.items():
                if tf := w.count(x):
                    s += (times if repeats else 1) * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[x] + 1))) * ((1000000000 * tf) // (1000 * tf + 8 * m))
            if s > 0:
                scored.append((-s, i is None, i or 0, i))
        out += [(item, r + 1, i, -s) for r, (s, _, _, i) in enumerate(sorted(scored, key=lambda x: x[:3])[:k])]
    return sorted(out, key=str)


def rows(df):
    return sorted((tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect()), key=str)


def corpus(seed, n):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(40)] + ["Été", "ÉTÉ", "naïve", "日本", "A1", "a1", "x_y", "q-r", "don't"]
    text = lambda most: " ".join(rng.choice(words[: rng.choice([4, 20, 49])]) for _ in range(rng.randrange(most)))
    docs = [(rng.choice([i, i, i, 7, None]), rng.choice([text(60), text(60), text(4), "", None, "!?", "w1 w2 w3"])) for i in range(n)]
    items = [(rng.choice([i, i, 3, None]), rng.choice([text(12), text(30), "", None, "none of these zzz"])) for i in range(14)]
    return docs, items


@pytest.mark.parametrize("seed", range(3))
def test_equals_brute_force(spark, seed):
    docs, items = corpus(seed, 150)
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"item_id": F.lit(5), "score": F.lit("x"), "term": F.lit("y")}).repartition(5)
    i = spark.createDataFrame(items, "item_id long, text string").withColumns({"doc_id": F.lit(5), "times": F.lit("x")})
    assert rows(L.rank_documents(d, i)) == brute(docs, items)
    assert rows(L.rank_documents(d, i, 3, True, block_pairs=20)) == brute(docs, items, 3, True)


def test_no_rows(spark):
    docs, items = corpus(9, 20)
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert rows(L.rank_documents(d.where("false"), i)) == []
    assert rows(L.rank_documents(d, i.where("false"))) == []
    assert rows(L.rank_documents(spark.createDataFrame([(1, " ")], "doc_id long, text string"), i)) == []


def test_a_long_text_and_many_ties_over_blocks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(L, "BLOCK_BYTES", 3000)
    rng = random.Random(4)
    long = " ".join(rng.choice(["alpha", "beta", "gamma"]) + str(rng.randrange(3)) for _ in range(90000))
    docs = [(100 - i, "alpha1 beta2 same text") for i in range(100)] + [(500, long), (501, None)]
    items = [(1, "Alpha1 ALPHA1, same"), (2, "gamma0")]
    spark.createDataFrame(docs, "doc_id long, text string").repartition(4).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = rows(op12_lexical_search(spark, str(tmp_path)))
    assert got == brute(docs, items) and [r[2] for r in got if r[0] == 1 and r[1] < 10] == list(range(1, 10))


def test_terms_end_with_their_text():
    import pyarrow as pa

    from barwright.llm.textarrays import slices

    texts = ["ab", "cd", "", "é-X", None, " a ", "z"]
    (t,) = slices([pa.record_batch({"text": pa.array(texts)})])
    every, first = L.terms(t)
    got = [x.decode() for x in every.to_pylist()[::2]]
    assert [got[a:b] for a, b in zip(first, first[1:], strict=False)] == [terms(x) for x in texts]
    assert np.diff(first).tolist() == [len(terms(x)) for x in texts]
