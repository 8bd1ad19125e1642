"""Operators that learn: held-out accuracy on texts made here, and the edges."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from barwright.llm import language as L
from barwright.llm import quality as Q

SYLLABLES = {"en": "the and of ing tion er", "fr": "le eau ou que é ment", "de": "der sch ung ein ich ü"}


def text(rng, lang, words):
    s = SYLLABLES[lang].split()
    return " ".join("".join(rng.choice(s) for _ in range(rng.randrange(1, 4))) for _ in range(words))


def corpus(n, seed=1):
    rng, rows = random.Random(seed), []
    for i in range(n):
        lang, good = rng.choice(list(SYLLABLES)), rng.random() < 0.7
        t = text(rng, lang, rng.randrange(8, 60))
        if not good:
            t = "\n".join([t.upper()] * 3) if rng.random() < 0.5 else " ".join(w + "$$$" for w in t.split())
        rows.append((i, t, lang, len(t), int(good)))
    return rows


def frame(spark, rows):
    return spark.createDataFrame([r[:4] for r in rows], "doc_id long, text string, lang string, n_chars long")


def test_quality_on_rows_not_learnt_from(spark):
    rows = corpus(500)
    labels = spark.createDataFrame([(r[0], r[4]) for r in rows], "doc_id long, quality int")
    out = {r.doc_id: r for r in Q.score_quality(frame(spark, rows), labels).collect()}
    held = [r for r in rows if out[r[0]].held_out]
    assert {r[0] for r in held} == {r[0] for r in rows if zlib.crc32(str(r[0]).encode()) % 3 == 1}
    assert np.mean([out[r[0]].predicted == r[4] for r in held]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in out.values())


def test_quality_edges(spark):
    rows = [(1, None, None), (2, "", 0), (3, "\n\n", 2), (None, "text", None), (4, "x" * 200_000, -5), (4, "x" * 200_000, -5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_chars long").withColumns({"score": F.lit("x"), "label": F.lit(1)})
    none = spark.createDataFrame([], "doc_id long, quality int")
    odd = spark.createDataFrame([(1, None), (None, 1), (3, 1), (3, 0), (77, 1)], "doc_id long, quality int")
    for labels in (none, odd):
        got = Q.score_quality(df, labels).collect()
        assert len(got) == 6 and all(0 <= r.score <= 1 for r in got)
        assert [r.held_out for r in got if r.doc_id is None] == [None]
    assert Q.score_quality(df.where("false"), odd).count() == 0
    assert Q.score_quality(df.select("doc_id", "text"), none).count() == 6


def test_quality_learns_one_row_an_id(spark, monkeypatch):
    seen, fit = [], Q.fit_machine
    monkeypatch.setattr(Q, "fit_machine", lambda rows: seen.append(rows) or fit(rows))
    rows = [(1, f"row {i} of the id that repeats", i) for i in range(60)] + [(1, "twice", 5)] * 9 + [(i, f"good text {i}", i) for i in range(2, 9)]
    labels = spark.createDataFrame([(i, int(i > 1)) for i in range(1, 9)], "doc_id long, quality int")
    for order, parts in ((rows, 1), (rows[::-1], 3)):
        Q.train(spark.createDataFrame(order, "doc_id long, text string, n_chars long").repartition(parts), labels, most=8, held_out=1, of=1)
    assert [r[2] for r in seen[0]] == [0] + [1] * 7
    assert [[(*code, *stats) for code, stats, _ in s] for s in seen[:1]] == [[(*code, *stats) for code, stats, _ in s] for s in seen[1:]]


def test_the_identity_equals_all_pairs():
    rng = np.random.default_rng(2)
    m = Q.fit_machine([])
    m.factors[:] = rng.normal(size=m.factors.shape)
    m.weights[:] = rng.normal(size=m.weights.shape)
    index, value = np.array([3, 9, 40, 7]), np.array([0.5, -1.0, 2.0, 0.25], np.float32)
    raw, _ = m.raw(index, value, np.array([0, 3, 4]))
    pairs = sum(float(m.factors[index[i]] @ m.factors[index[j]]) * value[i] * value[j] for i in range(3) for j in range(i))
    assert raw[0] == pytest.approx(m.bias + float(m.weights[index[:3]] @ value[:3]) + pairs, rel=1e-4)
    assert raw[1] == pytest.approx(m.bias + float(m.weights[7]) * 0.25, rel=1e-4)


def test_language_on_rows_not_learnt_from(spark):
    rows = [r for r in corpus(300, 2)]
    out = {r.doc_id: r for r in L.identify_languages(frame(spark, rows)).collect()}
    held = [r for r in rows if out[r[0]].held_out]
    assert {r[0] for r in held} == {r[0] for r in rows if zlib.crc32(str(r[0]).encode()) % 4 == 2}
    assert np.mean([out[r[0]].lang_pred == r[2] for r in held]) > 0.97


def test_mixtures(spark):
    rng = random.Random(4)
    df = frame(spark, corpus(200, 3))
    models = L.train(df)
    mixed = " ".join(text(rng, x, 150) for x in ("en", "de", "en"))
    test = spark.createDataFrame([(1, mixed), (2, text(rng, "fr", 200))], "doc_id long, text string")
    got = {r.doc_id: r.x for r in test.select("doc_id", L.language_column(models).alias("x")).collect()}
    assert [x.lang for x in got[1].languages] == ["en", "de"] and 0.55 < got[1].score < 0.8
    assert [x.lang for x in got[2].languages] == ["fr"] and got[2].score == pytest.approx(1)


def test_language_edges(spark):
    rows = [(1, None, "en"), (2, "", "en"), (3, "123 !?", None), (None, "the and of", "en"), (4, "é", "fr"), (5, "the ing tion and", "en"), (5, "the ing tion and", "en"), (6, "x" * 100_000, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("found", F.lit(1))
    got = L.identify_languages(df).collect()
    assert len(got) == 8 and all(r.lang_pred == "und" and r.score == 0 for r in got if r.doc_id in (1, 2, 3))
    assert all(0 <= r.score <= 1 for r in got)
    assert {r.lang_pred for r in L.identify_languages(df.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert L.identify_languages(df.where("false")).count() == 0


def test_without_labels_every_text_scores_the_same(spark):
    from barwright.llm.quality import score_quality

    docs = spark.createDataFrame([(i, t, None) for i, t in enumerate(["One two three.", "", None, "!!! $$$ 123"])], "doc_id long, text string, n_chars long")
    got = score_quality(docs, spark.createDataFrame([], "doc_id long, quality int")).collect()
    assert {(r.score, r.predicted) for r in got} == {(0.5, 1)} and len(got) == 4
