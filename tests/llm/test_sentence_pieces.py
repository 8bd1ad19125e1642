import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

pytest.importorskip("public_tokenizers")
from barwright.llm import sentence_pieces as S
from barwright.llm.queries import op11_sentence_pieces
from barwright.llm.tokens import tokenizer_path

MODEL = S.Pieces(tokenizer_path("piece_bpe_32k.model"))
ODD = ["", " ", "  ", "   a", "a  b ", "▁x ▁", "é é ﬁ", "<s> hi </s><unk>", "<0x0A>\n\t\r", "\x00z\x7f", "日本語 テスト 😀 𝔘", "a" * 3000, " " * 777 + "b" + " " * 33, "　x y ", "Hello, World! 12,345 it's\n\nso"]


def check(texts, model=MODEL):
    ids, count = model.encode(pa.array(texts, pa.large_string()))
    want = model.library.encode(texts)
    assert [x.tolist() for x in np.split(ids, np.cumsum(count)[:-1])] == want
    assert model.decode(ids, count) == [model.library.decode(x) for x in want]


def test_odd_texts_as_the_library():
    check(ODD)
    check(["", ""])
    check(["one"])


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text(max_size=60), min_size=1, max_size=6))
def test_any_text(texts):
    check([t.encode("utf-8", "ignore").decode() for t in texts])


def test_few_letters_and_blanks_meet_every_tie():
    rng = random.Random(5)
    for letters in ("ab ", " e", "the in", "日本 語", "\t \n"):
        check(["".join(rng.choice(letters) for _ in range(rng.randrange(150))) for _ in range(60)])


def test_what_rounds_leave_is_merged_by_the_queue():
    rng = random.Random(6)
    texts = ["".join(rng.choice("etaoinshrdlu") for _ in range(n)) for n in (1, 40, 900)] + [" " * 700]
    symbols = MODEL.symbol[np.array([ord(c) for c in "".join(texts)])]
    first = np.cumsum([0, *map(len, texts[:-1])])
    whole, counts = MODEL.merge(symbols, first)
    for rounds in (0, 1, 7):
        some, n = MODEL.merge(symbols, first, rounds)
        assert some.tolist() == whole.tolist() and n.tolist() == counts.tolist()


def test_decoding_any_ids_as_the_library():
    rng = random.Random(7)
    rows = [[rng.choice([0, 1, 2, 5, 200, 258, 259, 300, 31999]) for _ in range(rng.randrange(8))] for _ in range(200)] + [[MODEL.library.piece_to_id("▁▁"), 300], [300, 259]]
    got = MODEL.decode(np.array([i for r in rows for i in r]), np.array([len(r) for r in rows]))
    assert got == [MODEL.library.decode(r) for r in rows]


def test_other_kinds_of_models_are_refused():
    with pytest.raises(Exception):
        S.Pieces(tokenizer_path("word_bpe_49k.json"))


def test_documents(spark, tmp_path):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(None, "no id"), (3, "twice"), (3, "twice"), (50, None), (60, "long text. " * 30000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"ids": F.lit(1), "decoded": F.lit("x"), "lang": F.lit(None).cast("string")})
    found = S.decode_pieces(S.encode_pieces(df.repartition(3)))
    assert found.columns == ["doc_id", "ids", "decoded"]
    got = sorted((str(r.doc_id), r.ids, r.decoded) for r in found.collect())
    encode = lambda t: MODEL.library.encode(t or "")
    assert got == sorted((str(i), encode(t), MODEL.library.decode(encode(t))) for i, t in rows)
    assert S.encode_pieces(df.where("false")).count() == 0
    none = S.decode_pieces(spark.createDataFrame([(1, None), (2, [])], "ids int, pieces array<int>"), "pieces", "text").collect()
    assert sorted((r.ids, r.text) for r in none) == [(1, None), (2, "")]
    df.write.parquet(str(tmp_path / "documents.parquet"))
    digests = {(str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in op11_sentence_pieces(spark, str(tmp_path)).collect()}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    assert digests == {(i, len(x), sha(",".join(map(str, x))), sha(t)) for i, x, t in got}
