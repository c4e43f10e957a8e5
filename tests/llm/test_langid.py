import itertools

import numpy as np
import pyarrow as pa
import pytest

from gaugeline.llm import crf_langid as crf


def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(0)
    first, states = np.array([0, 5, 5, 6, 9]), 3
    emit, move, start = rng.random((9, states)) + 0.1, rng.random((states, states)) + 0.1, rng.random(states) + 0.5
    post, moves = crf.forward_backward(emit, move, start, first)
    want, counts = np.zeros((9, states)), np.zeros((states, states))
    for a, b in itertools.pairwise(first):
        paths = list(itertools.product(range(states), repeat=b - a)) if b > a else []
        p = np.array([start[x[0]] * np.prod([emit[a + i, k] for i, k in enumerate(x)]) * np.prod([move[i, j] for i, j in itertools.pairwise(x)]) for x in paths])
        for x, w in zip(paths, p / p.sum() if len(p) else p, strict=True):
            for i, k in enumerate(x):
                want[a + i, k] += w
            for i, j in itertools.pairwise(x):
                counts[i, j] += w
    assert np.allclose(post, want) and np.allclose(moves, counts)


def test_blocks_equal_one_long_sweep():
    rng = np.random.default_rng(1)
    n, states = 5 * crf.BLOCK + 7, 4
    emit, move = rng.random((n, states)) + 0.01, rng.random((states, states)) + 0.05
    alpha, beta = np.zeros((n, states)), np.ones((n, states))
    for t in range(n):
        a = emit[t] * (alpha[t - 1] @ move if t else 1)
        alpha[t] = a / a.sum()
    for t in range(n - 2, -1, -1):
        b = move @ (emit[t + 1] * beta[t + 1])
        beta[t] = b / b.sum()
    want = alpha * beta
    post, _ = crf.forward_backward(emit, move, np.ones(states), np.array([0, n]))
    assert np.allclose(post, want / want.sum(1, keepdims=True))


WORDS = {"aa": "alpha banal canal fatal naval papal", "zz": "zuzu yuzu kudzu uzzu zulu guzu"}


@pytest.fixture
def labelled(spark):
    rows = [(i, " ".join(WORDS[lang].split()[(i + k) % 6] + str(k % 3 or "") for k in range(12)), lang) for i, lang in enumerate(["aa", "zz"] * 40)]
    rows += [(1000, None, "aa"), (1001, "", "zz"), (1002, "123 !!", "aa"), (1004, "²½ Ⅷ ٣", "aa"), (None, "banal canal", None), (3, rows[3][1], "zz"), (1003, "papal zulu " * 9000, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "1 score", "'x' words", "0 n")


def test_predictions_and_defined_cases(labelled):
    model = crf.fit(labelled)
    rows = crf.predict(labelled, model).collect()
    assert len(rows) == labelled.count()
    by = {r["doc_id"]: r for r in rows}
    assert all(by[i]["lang_pred"] == ("aa", "zz")[i % 2] and by[i]["score"] > 0.8 for i in range(80))
    assert [by[i]["lang_pred"] for i in (1000, 1001, 1002, 1004)] == ["und"] * 4 and by[1000]["score"] == 0
    assert by[None]["lang_pred"] == "aa" and by[1003]["lang_pred"] in ("aa", "zz")


def test_words_of_switched_text(labelled):
    model = crf.fit(labelled)
    text = "alpha banal canal fatal naval zuzu yuzu kudzu uzzu zulu"
    out = crf.label_words(labelled.limit(0).selectExpr("doc_id", "text").union(labelled.selectExpr("cast(7 as long) doc_id", f"'{text}' text").limit(1)), model)
    assert [r["lang"] for r in out.orderBy("n").collect()] == ["aa"] * 5 + ["zz"] * 5


def test_empty_table(labelled):
    none = labelled.limit(0)
    assert crf.fit(none) is None and crf.predict(none, None).count() == 0
    assert crf.predict(labelled, None).select("lang_pred").distinct().count() == 1


def test_feature_numbers_tell_words_apart():
    f = crf.feature_numbers(["a", "ab", "x" * 500])
    assert (f[0] >= 0).sum() < (f[1] >= 0).sum() and len(pa.array(f.tolist())) == 3


def test_a_singular_transition_matrix_equals_enumeration():
    rng = np.random.default_rng(5)
    first, states = np.array([0, 4]), 3
    emit, start = rng.random((4, states)) + 0.1, np.array([0.7, 0.2, 0.1])
    move = np.repeat(rng.random((1, states)) + 0.1, states, 0)  # three equal rows
    want = np.zeros((4, states))
    for x in itertools.product(range(states), repeat=4):
        w = start[x[0]] * np.prod([emit[i, k] for i, k in enumerate(x)]) * np.prod([move[i, j] for i, j in itertools.pairwise(x)])
        for i, k in enumerate(x):
            want[i, k] += w
    assert np.allclose(crf.forward_backward(emit, move, start, first)[0], want / want.sum(1, keepdims=True))


def test_every_letter_of_a_long_word_counts():
    a, b = "x" * 40 + "q" + "x" * 40, "x" * 40 + "v" + "x" * 40
    rows = dict((i, f[k].tolist()) for at, f in crf.featured([a, b, "ab"]) for k, i in enumerate(at.tolist()))
    assert rows[0] != rows[1] and sorted(rows) == [0, 1, 2]
    words = ["w" * n for n in (1, 5, 9, 100, 20_000, 3)]
    got = {i: sorted(x for x in f[k].tolist() if x >= 0) for at, f in crf.featured(words, 50_000) for k, i in enumerate(at.tolist())}
    assert all(got[i] == sorted(x for x in crf.feature_numbers([w])[0].tolist() if x >= 0) for i, w in enumerate(words))


def test_held_out_is_the_checksum_rule_and_votes_are_posterior_mass(labelled):
    import zlib

    model = crf.fit(labelled)
    rows = crf.predict(labelled, model).collect()
    assert all(r["held_out"] == (zlib.crc32(("" if r["doc_id"] is None else str(r["doc_id"])).encode()) % 3 == 1) for r in rows)
    text = "alpha zulu kudzu banal"
    words, at, first = crf.letter_words(pa.array([text]))
    post = model.posteriors(words, at, first)
    mass = sum(p * len(w) for p, w in zip(post, text.split(), strict=True))
    r = crf.predict(labelled.limit(1).selectExpr("cast(1 as long) doc_id", f"'{text}' text"), model).first()
    assert r["lang_pred"] == model.langs[mass.argmax()] and abs(r["score"] - mass.max() / mass.sum()) < 1e-9


def test_an_id_that_repeats_very_often_fills_no_sample(spark):
    rows = spark.range(50_000).selectExpr("7L doc_id", "concat('banal papal word', id) text", "'aa' lang").unionAll(spark.createDataFrame([(i, "zuzu yuzu kudzu", "zz") for i in (2, 5, 8)], "doc_id long, text string, lang string"))
    assert crf.sample_stretches(rows, 2_000, 200, 4).where("lang = 'aa'").count() <= 4
    model = crf.fit(rows)
    assert crf.predict(rows.where("doc_id = 7"), model).count() == 50_000
