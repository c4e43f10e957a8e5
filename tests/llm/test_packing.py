import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from gaugeline.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)
TEXTS = ["Σας ΟΔΟΣ", "á  x　y\x85z", "<|endoftext|> x<|startoftext|>y", "a\x1cb c", "don't I'LL 12345 ﬁ", "", " ", "漢字 かな", "<|x|> a<", "Über, Straße! İstanbul word### (a)", None]


def ids_of(texts):
    ids, first = packing.encoder(PATH).encode(pa.array(texts, pa.string()))
    return [ids[a:b].tolist() for a, b in zip(first[:-1], first[1:], strict=True)]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.one_of(st.sampled_from("abcdeonrst hTA.,'-#<|>\n"), st.characters(exclude_categories=["Cs"])), max_size=40), min_size=1, max_size=5))
def test_ids_equal_the_library(texts):
    assert ids_of(texts) == [LIBRARY.encode(t, add_special_tokens=False).ids for t in texts]


def test_fixed_texts_equal_the_library():
    assert ids_of(TEXTS) == [LIBRARY.encode(t or "", add_special_tokens=False).ids for t in TEXTS]


def check(rows, size):
    by = defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= size
    return len(by)


def test_pieces_and_places(docs):
    texts = [*TEXTS, "word " * 10_000, "word " * 4095, "word " * 4096]
    rows = packing.pack(packing.pieces(docs(list(enumerate(texts))), PATH, with_ids=True)).collect()
    check(rows, 4096)
    for i, t in enumerate(texts):
        want = [*LIBRARY.encode(t or "", add_special_tokens=False).ids, 1]
        mine = sorted((r for r in rows if r["doc_id"] == i), key=lambda r: r["piece"])
        assert [x for r in mine for x in r["ids"]] == want
        assert all(r["start"] == 4096 * r["piece"] and r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes()) for r in mine)
        assert [r["length"] for r in mine[:-1]] == [4096] * (len(mine) - 1)


@pytest.mark.parametrize("seed", range(3))
def test_few_sequences_are_used(spark, seed):
    rng = np.random.default_rng(seed)
    lengths = np.minimum(1 + rng.lognormal(6, 1.1, 3000).astype(int), 4096)
    rows = spark.createDataFrame([(i, 0, int(n)) for i, n in enumerate(lengths)], "doc_id long, piece int, length long")
    used = check(packing.pack(rows).collect(), 4096)
    assert used <= 1.01 * -(-int(lengths.sum()) // 4096) + 1


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 50), max_size=30))
def test_plans_place_every_piece_once(hist):
    p = packing.plan(hist, 64, (1, 4))
    seen = defaultdict(list)
    for length, n in hist.items():
        for s, o in zip(*p.place(np.full(n, length), np.arange(n)), strict=True):
            seen[int(s)].append((int(o), length))
    check([{"sequence_id": s, "offset": o, "length": n} for s, x in seen.items() for o, n in x], 64)
    assert len(seen) == p.sequences and sum(map(len, seen.values())) == sum(hist.values())


def test_nnls_fits_a_solvable_histogram():
    p = packing.patterns(np.array([1, 2, 3]), 4, 0)
    x = packing.nnls(p, np.array([20.0, 7.0, 10.0]), 3000)
    assert (x >= 0).all() and np.allclose(np.bincount(p.ravel() + 1, np.repeat(x, 3), 4)[1:], [20, 7, 10], atol=0.1)


def test_repeated_rows_and_empty_table(docs):
    d = docs([(1, "a b c"), (1, "a b c"), (None, "x"), (None, None)])
    assert check(packing.pack(packing.pieces(d, PATH)).collect(), 4096) == 1
    assert packing.pack(packing.pieces(docs([]), PATH)).count() == 0
