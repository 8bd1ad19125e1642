import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from barwright.llm import merkle as M
from barwright.llm.queries import op13_merkle_manifest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, lower=False):
    d, text, lang, source, n = row
    if lower and text is not None:
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (d, source, lang, n, text)])


def climb(nodes):
    """Root of a list of digests, and for each of them its (left, right) siblings level by level."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        runs = [nodes[i : i + 16] for i in range(0, len(nodes), 16)]
        for i, a in enumerate(at):
            run = runs[a // 16]
            paths[i].append((run[: a % 16], run[a % 16 + 1 :]))
            at[i] = a // 16
        nodes = [h(*r) for r in runs]
    return (nodes[0] if nodes else None), paths


def brute(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[3], []).append((r[0] is not None, r[0] or 0, leaf(r), r))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: (sorted(g, key=lambda x: x[:3]), *climb([x[2] for x in sorted(g, key=lambda x: x[:3])])) for s, g in groups.items()}
    root, over = climb([trees[s][1] for s in names])
    out = []
    for s, up in zip(names, over, strict=True):
        own, sub, paths = trees[s]
        for (_, _, d, r), path in zip(own, paths, strict=True):
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
            now = leaf(r, True) if hit else d
            for left, right in path + up:
                now = h(*left, now, *right)
            out.append((r[0], d, sub, root, h(*[x for left, right in path + up for x in left + right]), now, now == root))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()), key=str)


def table(seed, n, sources):
    rng = random.Random(seed)
    rows = [(rng.choice([i, i, i, 4, None]), rng.choice(["Text", "text ÉÀ Z", "", None, f"T{i}"]), rng.choice(["en", None]), rng.choice(sources), rng.choice([i, None, -1])) for i in range(n)]
    return rows + rows[:3]


@pytest.mark.parametrize(("n", "sources"), [(300, ["a", "B", "é", "", None]), (40, [f"s{i}" for i in range(39)]), (18, ["one"]), (1, [None])])
def test_equals_brute_force(spark, n, sources, tmp_path):
    rows = table(n, n, sources)
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"pos": F.lit("x"), "grp": F.lit(1), "hash": F.lit(None).cast("int"), "n": F.lit(2)}).repartition(5)
    df.write.parquet(str(tmp_path / "documents.parquet"))
    assert got(op13_merkle_manifest(spark, str(tmp_path))) == brute(rows)


def test_one_leaf_and_none(spark):
    row = (5, "A" * 100000, None, "s", 3)
    df = spark.createDataFrame([row], SCHEMA)
    ((_, d, sub, root, proof, _, _),) = got(M.verify(M.prove(M.build(df))))
    assert d == sub == root == leaf(row) and proof == h()
    assert got(M.verify(M.prove(M.build(df.where("false"))))) == []


def test_only_tampered_rows_fail_and_a_large_source_lies_in_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(M, "MOST_STRETCHES", 1)  # stretches joined by key
    rows = [(i, f"Row {i}", "en", "hot" if i % 3 else f"s{i % 50}", i) for i in range(5000)]
    manifest = M.build(spark.createDataFrame(rows, SCHEMA).repartition(4))
    assert [level.count() for level in manifest.over] == [51, 4, 1]
    found = got(M.verify(M.prove(manifest)))
    assert found == brute(rows)
    assert {r[0] for r in found if not r[6]} == {i for i in range(5000) if zlib.crc32(str(i).encode()) % 5 == 0}
