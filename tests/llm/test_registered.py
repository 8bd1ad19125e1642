"""Every registered query over the smallest tables: the contract's columns and types, a row for each document, and the SQL where there is some."""

import os
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from barwright.llm.queries import llm_queries

DATA = Path(os.environ.get("BARWRIGHT_DATA", "/root/testdata/sf0.001"))
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no tables")
#: The first columns and their types, and what has one row each.
CONTRACT = {
    "op2_token_files": ("doc_id, start bigint, n_tokens bigint, ids_crc32 bigint", "documents"),
    "op3_repeats": ("doc_id, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string", "documents"),
    "op4_pack": ("doc_id, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint", None),
    "op5_quality": ("doc_id, held_out boolean, score double, predicted int", "documents"),
    "op6_topk": ("query_id bigint, rank int, vec_id bigint, score bigint", None),
    "op7_url_filter": ("page_id, host string, path string, rule string, verdict string", "pages"),
    "op8_jaccard_join": ("doc_id, n_shingles bigint, component_id", "documents"),
    "op9_secrets": ("doc_id, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string", "documents"),
    "op10_language": ("doc_id, held_out boolean, lang_pred string, score double", "documents"),
    "op11_sentence_pieces": ("doc_id, n_tokens bigint, ids_sha256 string, decoded_sha256 string", "documents"),
    "op12_lexical_search": ("item_id, rank int, doc_id, score bigint", None),
    "op13_merkle_manifest": ("doc_id, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean", "documents"),
}


def result(spark, name):
    return llm_queries()[name](spark, str(DATA)).cache()


@pytest.mark.parametrize("name", CONTRACT)
def test_contract(spark, name):
    columns, of = CONTRACT[name]
    df = result(spark, name)
    types = dict(df.dtypes)
    for wanted in columns.split(", "):
        column, *kind = wanted.split()
        assert column in types and (not kind or types[column] == kind[0]), (wanted, df.dtypes)
    if of:
        key = columns.split(",")[0]
        want = sorted(r[0] for r in spark.read.parquet(str(DATA / f"{of}.parquet")).select(key).collect())
        assert sorted(r[0] for r in df.select(key).collect()) == want
    if name == "op4_pack":  # every document from its start to its end, every sequence without a gap
        for by, at in (("doc_id", "start"), ("sequence_id", "offset")):
            after = sorted((r[by], r[at], r["length"]) for r in df.collect())
            for a, b in zip(after, after[1:]):
                assert b[1] == (a[1] + a[2] if a[0] == b[0] else 0)
        assert df.agg(F.max(F.col("offset") + F.col("length"))).first()[0] <= 2048
    if name == "op2_token_files":
        rows = sorted((r.doc_id, r.start, r.n_tokens) for r in df.collect())
        assert rows[0][1] == 0 and all(b[1] == a[1] + a[2] for a, b in zip(rows, rows[1:]))
    if name in ("op6_topk", "op12_lexical_search"):
        first = "query_id" if name == "op6_topk" else "item_id"
        ranks = df.groupBy(first).agg(F.max("rank").alias("most"), F.count_distinct("rank").alias("n")).collect()
        assert ranks and all(r.most == r.n <= (5 if name == "op6_topk" else 10) for r in ranks)


def test_leaks_of_the_tables(spark):
    """Items of any length are looked for, and what is reported lies in the document and in the item."""
    df = result(spark, "op1_decontaminate")
    docs = {r.doc_id: (r.text or "").lower().split() for r in spark.read.parquet(str(DATA / "documents.parquet")).collect()}
    items = {r.item_id: r.text.lower().split() for r in spark.read.parquet(str(DATA / "benchmark.parquet")).collect()}
    rows = df.collect()
    assert rows
    for r in rows:
        text, item = docs[r.doc_id][r.start_word : r.end_word], items[r.item_id][r.item_start :]
        assert sum(a == b for a, b in zip(text, item)) == r.matched >= min(13, len(items[r.item_id]) - len(items[r.item_id]) // 5)


def test_short_items_are_looked_for(spark, tmp_path):
    spark.createDataFrame([(1, "a few Words here"), (2, "a few other words"), (3, None)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(7, "few words"), (8, "here"), (9, "words a")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = llm_queries()["op1_decontaminate"](spark, str(tmp_path)).collect()
    assert {(r.doc_id, r.item_id, r.item_words) for r in got} == {(1, 7, 2), (1, 8, 1)}
