import hashlib
import random
import re
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from gaugeline.llm import queries, runs

SF = "/root/testdata/sf0.001"


def brute(words, least=24, times=3):
    """Every lag and every stretch of equal pairs; the smallest period by trying all smaller ones."""
    out, n = [], len(words)
    for q in range(1, n // times + 1):
        at = 0
        while at < n - q:
            to = at
            while to < n - q and words[to] == words[to + q]:
                to += 1
            whole = words[at : to + q]
            if len(whole) >= max(least, times * q) and not any(whole[d:] == whole[:-d] for d in range(1, q)):
                out.append((at, len(whole), q))
            at = to + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def found(texts, **settings):
    lists = [list(t) for t in texts]
    first = np.concatenate([[0], np.cumsum([len(t) for t in lists])]).astype(np.int64)
    flat = np.array([x for t in lists for x in t], np.int64)
    got = runs.runs_of(flat, first, **settings)
    return [[r[1:] for r in got if r[0] == i] for i in range(len(lists))]


def periodic(rng, n, q, letters):
    unit = [rng.randrange(letters) for _ in range(q)]
    return [unit[i % q] for i in range(n)]


def test_runs_equal_brute_force():
    rng = random.Random(5)
    texts = [[], [1], [1] * 23, [1] * 24, [1] * 500, [1, 2] * 12, [1, 2, 3] * 8, list(range(300))]
    for _ in range(150):
        letters, text = rng.choice([1, 2, 2, 3, 50]), []
        while len(text) < 260:
            kind = rng.randrange(3)
            if kind == 0:
                text += [rng.randrange(letters) for _ in range(rng.randrange(30))]
            elif kind == 1:
                text += periodic(rng, rng.randrange(1, 150), rng.randrange(1, 45), letters)
            elif text:
                a = rng.randrange(len(text))
                text += text[a : a + rng.randrange(60)]
        texts.append(text)
    assert found(texts) == [brute(t) for t in texts]
    assert sum(map(len, map(brute, texts))) > 100


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.integers(0, 1), max_size=70), min_size=1, max_size=4), st.integers(1, 9), st.integers(3, 4))
def test_small_alphabets_and_other_bounds(texts, least, times):
    assert found(texts, least=least, times=times) == [brute(t, least, times) for t in texts]


def test_long_constant_and_long_period_texts_take_few_extensions(monkeypatch):
    calls = []
    plain = runs.equal_for
    monkeypatch.setattr(runs, "equal_for", lambda *a: calls.append(a) or plain(*a))
    rng = random.Random(1)
    texts = [[7] * 50_000, periodic(rng, 60_000, 20_000, 1000), periodic(rng, 40_000, 777, 5)]
    assert found(texts) == [[(0, 50_000, 1)], [(0, 60_000, 20_000)], [(0, 40_000, 777)]]
    assert len(calls) < 40


def expected(doc_id, text):
    """The row of op11 from the contract's words."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    got = [tuple(r) for r in found([[hash(w) for w in words]])[0]]
    gone = {i for s, length, q in got for i in range(s + q, s + length)}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    best = min(got, key=lambda r: (-r[1] / r[2], r[0], r[2])) if got else (None, None, None)
    milli = 1000 * best[1] // best[2] if got else None
    return (doc_id, len(got), best[0], best[1], best[2], milli, sha("".join(f"{s},{length},{q}\n" for s, length, q in got)), sha(" ".join(w for i, w in enumerate(words) if i not in gone))), got, words


COLUMNS = ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


def test_query_equals_the_contract_on_a_whole_table(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in queries.op11_runs(spark, SF).collect()}
    want = {i: expected(i, t) for i, t in rows}
    assert got == {i: w[0] for i, w in want.items()} and sum(w[0][1] for w in want.values()) > 5
    short = [w for w in want.values() if len(w[2]) < 700]
    assert len(short) > 100 and all(w[1] == brute(w[2]) for w in short)


def test_nulls_empty_ties_repeats_and_clashing_names(docs):
    line = "one two three\n" * 20
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, line), (4, line), (5, "a b c d " * 6 + "x " + "e f g h " * 6), (None, line), (6, "w " * 30 + "w"), (7, "é" * 3 + " " + "p\x0bq\x0c" * 40)]
    got = [tuple(r[c] for c in COLUMNS) for r in runs.digest(runs.find_runs(docs(rows))).collect()]
    by = {r[0]: r[1:] for r in got}
    assert len(got) == len(rows)
    assert sum(r[0] == 4 for r in got) == 2 and len({r for r in got if r[0] == 4}) == 1
    assert all(by[k][:5] == (0, None, None, None, None) for k in (1, 2, 3))
    assert by[4][:5] == (1, 0, 60, 3, 20_000) and by[None] == by[4]
    assert by[5][:5] == (2, 0, 24, 4, 6_000)  # two of equal exponent: the first
    assert by[6][:5] == (1, 0, 31, 1, 31_000) and by[7][:4] == (1, 1, 80, 2)


def test_an_empty_table_gives_no_rows(docs):
    assert runs.digest(runs.find_runs(docs([(1, "a")]).limit(0))).count() == 0


def test_collapsed_keeps_columns_and_other_texts(docs):
    rows = [(1, "a  b\nc"), (2, "say it again " * 10 + "end"), (3, None)]
    df = docs(rows)
    out = runs.collapsed(df)
    assert out.columns == df.columns
    assert {r["doc_id"]: r["text"] for r in out.collect()} == {1: "a  b\nc", 2: "say it again end", 3: None}
