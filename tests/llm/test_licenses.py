import random
import re

import pytest

from gaugeline.llm import licenses, queries
from gaugeline.llm.license_texts import NOTICES, PHRASES

SF = "/root/testdata/sf0.001"
COLUMNS = ("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def base(doc_id, text):
    words = words_of(text)
    found = [(i, label) for label, phrase in PHRASES for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    at = [i for i, _ in found]
    return (doc_id, len(words), len(found), min(at, default=None), max(at, default=None), ",".join(sorted({label for _, label in found})))


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        last, row[0] = row[0], i + 1
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], min(row[j + 1] + 1, row[j] + 1, last + (x != y))
    return row[-1]


@pytest.fixture(scope="module")
def scanned(spark):
    return {r["doc_id"]: r for r in licenses.digest(licenses.scan(spark.read.parquet(f"{SF}/documents.parquet"))).collect()}


def test_query_has_the_contract_s_base_on_a_whole_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    got = {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in queries.op12_licenses(spark, SF).collect()}
    assert got == {r["doc_id"]: base(r["doc_id"], r["text"]) for r in docs}
    assert sum(r[2] for r in got.values()) > 2


def test_places_of_phrases_equal_brute_force(docs):
    rng = random.Random(4)
    parts = ["Under the MIT License", "under the mit", "Apache License, Version 2", "apache license version 3", "CC BY-NC", "cc by", "nc", "the", "ünder", "mit license", "\n", "CC-BY-NC-4.0", "x" * 50]
    rows = [(i, " ".join(rng.choice(parts) for _ in range(rng.randrange(60)))) for i in range(150)]
    rows += [(200, "cc by nc " * 3000), (201, "cc by nc " * 3000), (202, None), (203, ""), (204, "--- !!"), (205, "cc by nc"), (None, "under the mit license")]
    got = {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in licenses.digest(licenses.scan(docs(rows))).collect()}
    assert got == {i: base(i, t) for i, t in rows} and got[200][2] == 3000


def changed(words, rng, edits):
    words = list(words)
    for _ in range(edits):
        i = rng.randrange(1, len(words) - 1)
        kind = rng.randrange(3)
        words[i : i + (kind != 1)] = ["zzz"] if kind < 2 else []
    return words


@pytest.mark.parametrize("notice", range(len(NOTICES)))
def test_notices_are_found_where_few_words_differ(docs, notice):
    label, text = NOTICES[notice]
    rng, template = random.Random(notice), tuple(words_of(text))
    most = int(licenses.DIFFER * len(template))
    rows, want = [], {}
    for i, edits in enumerate([0, most // 2, most, most, 3 * most + 2]):
        inside = changed(template, rng, edits)
        before = [f"a{rng.randrange(50)}" for _ in range(rng.randrange(40))]
        rows.append((i, " ".join([*before, *inside, "after", "it"])))
        want[i] = (edit_distance(template, inside), len(before))
    got = {r["doc_id"]: r["places"] or [] for r in licenses.scan(docs(rows), phrases=()).collect()}
    for i, (distance, before) in want.items():
        if distance <= most:  # this notice, or a like one that is nearer by now
            best = max(got[i], key=lambda p: p["similarity"])
            assert best["similarity"] >= 1 - distance / len(template) - 1e-9 and abs(best["start"] - before) <= most + 2
        else:
            assert all(p["label"] != label or p["similarity"] < 1 for p in got[i])
    assert got[0][0]["similarity"] == 1.0 and got[0][0]["length"] == len(template)


def test_two_copies_of_a_notice_and_its_nearest_kin(docs):
    gpl2, gpl3 = (dict(NOTICES)[k] for k in ("gpl-2", "gpl-3"))
    rows = [(1, f"{gpl2} {gpl2}"), (2, f"x {gpl3} y {gpl2} z"), (3, dict(NOTICES)["cc-by-nc"])]
    got = {r["doc_id"]: [(p["label"], p["start"]) for p in r["places"]] for r in licenses.scan(docs(rows)).collect()}
    n2, n3 = len(words_of(gpl2)), len(words_of(gpl3))
    assert got == {1: [("gpl-2", 0), ("gpl-2", n2)], 2: [("gpl-3", 1), ("gpl-2", n3 + 2)], 3: [("cc-by-nc", 0)]}
    r = licenses.digest(licenses.scan(docs(rows))).orderBy("doc_id").collect()
    assert [x["labels"] for x in r] == ["gpl-2", "gpl-2,gpl-3", "cc-by-nc"] and all(x["n_base"] == 0 and x["base_labels"] == "" and x["score"] == 1.0 for x in r)


def test_repeated_rows_and_an_empty_table(docs):
    rows = [(1, "Licensed under CC BY-NC 4.0."), (1, "Licensed under CC BY-NC 4.0."), (1, "nothing")]
    got = sorted(tuple(r[c] for c in COLUMNS) for r in licenses.digest(licenses.scan(docs(rows))).collect())
    assert got == sorted(base(*r) for r in rows)
    assert licenses.scan(docs(rows).limit(0)).count() == 0
    with pytest.raises(ValueError):
        licenses.templates_of([("x", "two words")])
