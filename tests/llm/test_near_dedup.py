import re

import numpy as np
import pytest

import corpus_pipeline
from gaugeline.llm import components, near_dedup


def brute(rows):
    """(n_shingles, component_id) of every doc_id, from all pairs of full sets."""
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    up = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                both = len(sets[a] & sets[b])
                if a < b and both and 100 * both >= 85 * len(sets[a] | sets[b]) and up[a] != up[b]:
                    up[a] = up[b] = min(up[a], up[b])
                    changed = True
    return {i: (len(s), up[i]) for i, s in sets.items()}


def corpus(seed=0):
    rng = np.random.default_rng(seed)
    words = [f"w{k}" for k in range(400)]
    base = [" ".join(rng.choice(words, 120)) for _ in range(6)]
    rows = []
    for t in base:
        rows += [t] * 3
        for edits in (1, 1, 2, 2, 3, 4, 6):
            w = t.split()
            for at in rng.integers(0, len(w), edits):
                w[at] = str(rng.integers(10**6))
            rows.append(" ".join(w))
    rows += [" ".join(rng.choice(words, 60)) + " " + base[0][:300] for _ in range(20)]
    rows += [None, "", " \t\n", "one two", "One  TWO", "one two three four", "É é", "é é", "x" * 5000]
    return [(7 * k, t) for k, t in enumerate(rows)]


@pytest.mark.parametrize("blocks", [(512, 128), (8, 4)])
def test_components_equal_brute_force(docs, blocks):
    rows = corpus()
    out = near_dedup.near_duplicates(docs(rows), bucket_block=blocks[0], set_block=blocks[1]).collect()
    want = brute(rows)
    assert len(out) == len(rows)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in out} == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in out)


def test_repeated_rows_null_ids_and_columns(docs):
    text = " ".join(f"a{k}" for k in range(30))
    d = docs([(5, text), (5, text), (9, text), (None, text), (2, None), (3, "")])
    out = {(r["doc_id"], r["component_id"], r["kept"]) for r in near_dedup.near_duplicates(d).collect()}
    assert out == {(5, 5, True), (9, 5, False), (None, None, True), (2, 2, True), (3, 3, True)}
    kept = near_dedup.keep_first(d)
    assert kept.columns == d.columns
    assert sorted((r["doc_id"] or -1) for r in kept.collect()) == [-1, 2, 3, 5]


def test_an_id_with_several_texts_keeps_those_that_are_no_copies(docs):
    a, b, c = (" ".join(f"{x}{k}" for k in range(30)) for x in "abc")
    rows = [(1, a), (5, a), (5, b), (5, b.upper()), (7, c), (7, c), (7, None), (7, ""), (7, ""), (2, "  "), (8, c), (8, a + " z"), (9, b), (9, "other words")]
    kept = sorted((r["doc_id"], str(r["text"]).lower()) for r in near_dedup.keep_first(docs(rows)).collect())
    assert kept == sorted([(1, a), (5, b), (7, c), (7, "none"), (7, ""), (2, "  "), (9, "other words")])
    renamed = docs(rows).selectExpr("*", "'m' mixed", "'w' words_hash", "'z' wordless")
    out = near_dedup.keep_first(renamed)
    assert out.columns == renamed.columns and out.count() == len(kept) and {(r["mixed"], r["words_hash"]) for r in out.collect()} == {("m", "w")}


def test_empty_table(docs):
    assert near_dedup.near_duplicates(docs([])).count() == 0


def test_components_of_a_chain_a_star_and_nulls(spark):
    edges = [(k, k + 1) for k in range(40)] + [(1000, 1000 + k) for k in range(1, 50)] + [(7, 7), (None, 3)]
    roots = {r["v"]: r["root"] for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert all(roots[k] == 0 for k in range(41)) and all(roots[1000 + k] == 1000 for k in range(50)) and len(roots) == 91


def test_pruning_keeps_what_reaches_the_similarity():
    rng = np.random.default_rng(4)
    lost = 0
    for _ in range(400):
        both = rng.integers(0, 2**63, 200, dtype=np.uint64)
        a, b = (np.unique(np.concatenate([both, rng.integers(0, 2**63, 17, dtype=np.uint64)])) for _ in range(2))
        signs = np.stack([near_dedup.signature(near_dedup.minima(s)) for s in (a, b)])
        lost += not len(near_dedup.survivors(signs, np.array([0]), np.array([1]), 0.85, 1e-6)[0])
    assert lost == 0


def test_bands_follow_the_similarity():
    assert near_dedup.bands_for(85) == (6, 28)
    for percent in (50, 70, 80, 85, 90, 95, 100):
        rows, bands = near_dedup.bands_for(percent)
        assert (1 - (percent / 100) ** rows) ** bands <= near_dedup.BAND_MISS and rows * bands <= near_dedup.FEW


def test_the_stage_links_from_four_fifths_on(spark, docs):
    """Sets of 96 and 96 runs with 86 in common: similarity 86 / 106 = 0.811; and 84 / 108 = 0.778."""
    words = [[f"t{t}w{k}" for k in range(100)] for t in range(40)]
    near = [w[:90] + [f"n{t}x{k}" for k in range(10)] for t, w in enumerate(words)]
    far = [w[:88] + [f"f{t}x{k}" for k in range(12)] for t, w in enumerate(words)]
    rows = [(i, " ".join(w)) for i, w in enumerate(words[:20] + near[:20] + words[20:] + far[20:])]
    d = docs(rows)
    assert sorted(r["doc_id"] for r in corpus_pipeline.drop_duplicates(spark, d, "").collect()) == [*range(20), *range(40, 80)]
    assert near_dedup.near_duplicates(d).where("kept").count() == 80


def test_very_long_texts_of_many_words(docs):
    words = [f"w{k}" for k in range(120_000)]
    near = ["x" if k % 2_000 == 0 else w for k, w in enumerate(words)]
    half = words[:60_000] + [f"v{k}" for k in range(60_000)]
    out = {r["doc_id"]: r for r in near_dedup.near_duplicates(docs([(5, " ".join(words)), (3, " ".join(near)), (4, " ".join(half)), (9, "  ".join(words))])).collect()}
    assert {i: r["component_id"] for i, r in out.items()} == {3: 3, 5: 3, 9: 3, 4: 4}
    assert out[5]["n_shingles"] == out[9]["n_shingles"] == 119_996
