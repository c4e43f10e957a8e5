import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from gaugeline.llm import piece_codec

PATH = public_tokenizers.path("piece_bpe_32k.model")
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PATH)
TEXTS = ["", " ", "Hello  world", "  a b ", "x\n\ty", "é ﬁ á", "a" * 200, " " * 100, "the theory of everything, don't!", "漢字かな 🎉\u0000 x", "▁x ▁▁", "Übung ÑANDÚ être\r\n" * 30, "### $$$ &&& %%% ***", "1234567890.com"]


def ids_of(texts):
    ids, first = piece_codec.codec(PATH).encode(pa.array(texts))
    return [ids[a:b].tolist() for a, b in zip(first[:-1], first[1:], strict=True)], (ids, first)


def test_ids_equal_the_library():
    got, coded = ids_of(TEXTS)
    assert got == LIBRARY.encode(TEXTS)
    assert piece_codec.codec(PATH).decode(*coded) == [t.replace("▁", " ") for t in TEXTS]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.one_of(st.sampled_from("abcdeonrst hTA.,'-\n"), st.characters(exclude_categories=["Cs"])), max_size=40), min_size=1, max_size=5))
def test_any_text_equals_the_library(texts):
    got, coded = ids_of(texts)
    assert got == LIBRARY.encode(texts)
    assert piece_codec.codec(PATH).decode(*coded) == [t.replace("▁", " ") for t in texts]


def test_query_over_a_real_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = {r["doc_id"]: r["ids"] for r in piece_codec.encode(docs, PATH).collect()}
    for r in docs.collect():
        assert rows[r["doc_id"]] == LIBRARY.encode(r["text"])
    assert piece_codec.round_trips(docs, PATH).where("not round_trip").count() == 0


@pytest.mark.parametrize("rows", [[], [(1, None), (None, "a b"), (1, "")]])
def test_nulls_and_empty_tables(docs, rows):
    d = docs(rows)
    out = piece_codec.round_trips(d, PATH).collect()
    assert len(out) == len(rows) and all(r["round_trip"] for r in out)
    assert piece_codec.decode(piece_codec.encode(d, PATH), PATH).count() == len(rows)


def test_long_and_repeated_texts_and_clashing_columns(docs):
    long = "Hello  world, été 漢字 don't " * 30_000
    texts = [long, long, "a b", "a b", "c" * 50_000, long[5:] + " "]
    d = docs([(i // 2, t) for i, t in enumerate(texts)]).selectExpr("*", "'x' ids", "0 n_pieces", "1 ids_crc32", "2 decoded_chars", "'y' round_trip")
    want = sorted(zip([i // 2 for i in range(len(texts))], LIBRARY.encode(texts), strict=True))
    assert sorted((r["doc_id"], r["ids"]) for r in piece_codec.encode(d, PATH).collect()) == want
    out = piece_codec.round_trips(d, PATH).collect()
    assert sorted((r["doc_id"], r["n_pieces"]) for r in out) == sorted((i, len(x)) for i, x in want) and all(r["round_trip"] for r in out)
