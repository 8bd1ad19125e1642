import random

from pyspark.sql import functions as F

from barwright.llm import repeats as R

SCHEMA = "doc_id long, text string"


def brute(rows, width):
    out, seen = [], {}
    for i, t in rows:
        b = (t or "").encode()
        for j in range(len(b) - width + 1):
            if i is not None:
                seen[b[j : j + width]] = min(i, seen.get(b[j : j + width], i))
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for j in range(len(b) - width + 1):
            if i is not None and seen[b[j : j + width]] < i:
                gone[j : j + width] = b"\1" * width
        spans, at = [], None
        for j, g in enumerate(bytes(gone) + b"\0"):
            if g and at is None:
                at = j
            if not g and at is not None:
                spans.append((at, j))
                at = None
        out.append((str(i), len(b), spans, bytes(x for x, g in zip(b, gone, strict=True) if not g)))
    return sorted(out)


def same(spark, rows, width=50, **options):
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"key": F.lit(1), "spans": F.lit("x")}).repartition(3)
    got = R.remove_repeats(df, width, **options).collect()
    assert sorted((str(r.doc_id), r.n_bytes, [(s.start, s.end) for s in r.removed], bytes(r.kept)) for r in got) == brute(rows, width)


def test_edges(spark):
    line = "The quick brown fox jumps over the lazy dog, twice a day in spring."
    rows = [(3, line), (1, f"xx {line} yy"), (2, None), (4, ""), (5, line[:49]), (6, line[:50]), (None, line), (7, "a" * 300), (8, "a" * 200), (9, line), (9, line), (9, f"{line}é{line}"), (10, f"é{line[:30]}"), (11, line + line)]
    same(spark, rows)
    assert R.remove_repeats(spark.createDataFrame([], SCHEMA)).count() == 0


def test_equals_brute_force(spark):
    rng = random.Random(1)
    words = ["on", "the", "é", "alpha", "betagamma", "x"]
    text = lambda n: " ".join(rng.choice(words) + str(rng.randrange(40)) for _ in range(n))
    passages = [text(20) for _ in range(4)]
    rows = [(i, " ".join([text(rng.randrange(8)), *rng.sample(passages, rng.randrange(3)), text(rng.randrange(8))])) for i in range(60)]
    rng.shuffle(rows)
    same(spark, rows)
    same(spark, rows, 20, k=10, bucket_bytes=500)


def test_frequent_anchors_go_by_windows(spark):
    rng = random.Random(2)
    hot = "This passage stands in very many of the documents here, with other words around."
    rows = [(i, f"{rng.random()} {hot} {rng.random()}") for i in range(40)]
    same(spark, rows, frequent=3)


def test_texts_of_one_id_whose_32_bit_hashes_meet(spark):
    hot = "This passage stands in very many of the documents here, with other words around."
    texts = [f"{i} {'y' * (i % 7)}{hot}" for i in (5733, 162104)]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    assert df.select(F.hash("text")).distinct().count() == 1
    same(spark, [(1, hot), *[(2, t) for t in texts], (3, texts[0]), (None, texts[1])])


def test_keys_only_for_ids_that_repeat(spark):
    rows = [(i, f"text {i}") for i in range(50)] + [(7, "other"), (8, "text 8"), (None, "x"), (None, "y")]
    got = [(r.doc_id, r.key, r.text) for r in R._keyed(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()]
    assert sorted((str(i), t) for i, _, t in got) == sorted((str(i), t) for i, t in rows)
    assert {i for i, k, _ in got if k} == {7, 8, None} and len({k for i, k, _ in got if i == 7}) == 2


def test_long_text(spark):
    body = " ".join(str(i * 7919 % 10007) for i in range(30000))
    got = R.remove_repeats(spark.createDataFrame([(1, body), (2, "x" + body[1000:150000])], SCHEMA)).orderBy("doc_id").collect()
    assert [len(r.kept) for r in got] == [len(body), 1]


def test_texts_that_repeat_themselves(spark):
    line = "One and the same line stands in this text again and again, with a few more words. "
    rows = [(1, line * 40 + "a" * 700), (2, "b" + "a" * 900 + line * 25), (3, "ab" * 400), (4, "ba" * 300 + line), (4, "ba" * 300 + line), (5, "c" * 60)]
    same(spark, rows)
    same(spark, rows, frequent=1)
