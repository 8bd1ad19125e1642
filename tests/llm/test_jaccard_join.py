import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from barwright.llm import jaccard_join as J
from barwright.llm.components import connected_components, joined_components
from barwright.llm.shared_tokens import _answered, _send

SCHEMA = "doc_id long, text string"
_UPPER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def brute(rows, num=4, den=5):
    """doc_id -> (set size of each row, component), by comparing all pairs."""
    def shingles(text):
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(_UPPER))
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())

    sets = [(i, shingles(t)) for i, t in rows]
    up = {i: i for i, _ in rows if i is not None}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, (i, s) in enumerate(sets):
        for j, t in sets[:a]:
            if i is not None and j is not None and s and t and den * len(s & t) >= num * len(s | t):
                x, y = sorted((find(i), find(j)))
                up[y] = x
    key = lambda r: (r[0] is None, r)
    return sorted(((i, len(s), None if i is None else find(i)) for i, s in sets), key=key)


def same(spark, rows, **options):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = sorted((tuple(r) for r in J.jaccard_components(df, **options).collect()), key=lambda r: (r[0] is None, r))
    assert got == brute(rows)


def corpus(rng, groups, copies, words=60, edits=3, vocabulary=400):
    rows = []
    for _ in range(groups):
        base = [f"w{rng.randrange(vocabulary)}" for _ in range(words)]
        for _ in range(copies):
            own = list(base)
            for _ in range(rng.randrange(edits)):
                own[rng.randrange(len(own))] = f"x{rng.randrange(9999)}"
            rows.append((len(rows), " ".join(own)))
    rng.shuffle(rows)
    return rows


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, "One"), (5, "one"), (6, "a b c d"), (7, "a b c d e"), (8, "A B c d e"), (None, "one"), (9, "a b c d e f g h i j k"), (9, "one"), (4, "One"), (10, "é É")]
    same(spark, rows)
    same(spark, [(i, " ".join(map(str, range(i, i + 40)))) for i in range(12)])
    assert J.jaccard_components(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_all_pairs(spark, seed):
    rng = random.Random(seed)
    shared = " ".join(f"s{i}" for i in range(60))
    rows = corpus(rng, 12, 6) + [(1000 + i, f"{shared} {' '.join(f'u{i}_{j}' for j in range(rng.randrange(5, 25)))}") for i in range(25)]
    same(spark, rows)


def test_a_cloud_of_near_copies_block_by_block(spark, monkeypatch):
    rng = random.Random(3)
    rows = corpus(rng, 1, 60, words=80, edits=7) + [(500 + i, t) for i, t in corpus(rng, 8, 5)]
    for pairwise, rounds, size in ((64, 12, 256 << 10), (0, 1, 2000)):
        monkeypatch.setattr(J, "PAIRWISE", pairwise)
        monkeypatch.setattr(J, "STAR_ROUNDS", rounds)
        monkeypatch.setattr(J, "BLOCK_BYTES", size)
        same(spark, rows, batch_shingles=500, bucket_shingles=300)


def test_batches_with_the_same_ends_and_sizes(spark):
    rng = random.Random(5)
    texts = {c: [f"{c}{rng.randrange(10**6)}" for _ in range(40)] for c in "abxyz"}
    near = {c: " ".join([*texts[c][:-1], "other"]) for c in "xy"}
    whole = {c: " ".join(t) for c, t in texts.items()}
    for second in ("ayb", "bya", "axb"):
        parts = [[whole[c] for c in "axb"], [whole[c] for c in second], [near["x"], near["y"], whole["z"]]]
        rows = [(3 * p + i, t) for p, part in enumerate(parts) for i, t in enumerate(part)]
        df = spark.createDataFrame(spark.sparkContext.parallelize(rows, 3), SCHEMA)
        assert sorted(tuple(r) for r in J.jaccard_components(df).collect()) == brute(rows)


def test_names_of_batches():
    batch = lambda *signs: (np.array([(s, s) for s in signs]), np.full(len(signs), 9), np.arange(9 * len(signs), dtype=np.uint64))
    names = [next(_send([batch(*signs)], 1)).column("batch")[0].as_py() for signs in ((1, 2, 3), (1, 4, 3), (3, 4, 1), (3, 2, 1), (1, 2, 3))]
    assert len(set(names)) == 4 and names[0] == names[-1]
    parts = [pa.Table.from_batches([list(_send([batch(*signs)], 1))[1]]) for signs in ((1, 2, 3), (1, 4, 3))]
    with pytest.raises(ValueError, match="one name"):
        _answered(pa.concat_tables(parts))


def test_other_columns_do_not_matter(spark):
    rows = corpus(random.Random(4), 3, 3)
    df = spark.createDataFrame(rows, SCHEMA)
    for name in ("n", "cid", "label", "items", "a", "component_id"):
        df = df.withColumn(name, F.lit("x"))
    assert sorted(tuple(r) for r in J.jaccard_components(df).collect()) == brute(rows)


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (101, 102), (7, 7), (None, 3), (200, 201), (201, 200)]
    got = {r.node: r.label for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100, 200: 200, 201: 200}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_joined_by_later_links(spark):
    rng = random.Random(8)
    links = [(rng.randrange(90), rng.randrange(90)) for _ in range(70)]
    frame = lambda rows: spark.createDataFrame(rows, "a long, b long")
    labels = None
    for at in (0, 25, 50):
        labels = joined_components(labels, frame([(a, b) for a, b in links[at : at + 25] if a != b]))
    as_map = lambda df: {r.node: r.label for r in df.collect()}
    assert as_map(labels) == as_map(connected_components(frame(links)))
    assert as_map(joined_components(labels, frame([]))) == as_map(labels)


def test_overlaps_derived_from_a_leader(spark):
    rng = random.Random(6)
    of = {0: set(range(100))}
    for i in range(1, 12):
        of[i] = (of[0] - set(rng.sample(range(100), rng.randrange(5)))) | set(rng.sample(range(100, 140), rng.randrange(5)))
    sets = spark.createDataFrame([(i, bytearray(np.array(sorted(s), np.uint64).tobytes())) for i, s in of.items()], "cid long, items binary")
    pairs = spark.createDataFrame([(a, b, 0 if a % 3 else a) for a in range(1, 12) for b in range(1, a)], "a long, b long, la long")
    got = J.derived(pairs, sets).collect()
    assert len(got) == 55 and all((r.overlap, r.na, r.nb) == (len(of[r.a] & of[r.b]), len(of[r.a]), len(of[r.b])) for r in got)


def test_a_long_text_and_how_pairs_were_settled(spark):
    rng = random.Random(7)
    long = " ".join(f"w{rng.randrange(10**6)}" for _ in range(60000))
    rows = [(1, long), (2, long.upper() + " end"), (3, long[: len(long) // 2]), *[(i + 10, t) for i, t in corpus(rng, 4, 5)]]
    tally = {}
    df = spark.createDataFrame(rows, SCHEMA)
    assert sorted(tuple(r) for r in J.jaccard_components(df, tally=tally).collect()) == brute(rows)
    assert tally["compared with heads"] > 0
