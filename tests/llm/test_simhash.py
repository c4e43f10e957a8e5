import hashlib
import tracemalloc

import numpy as np
import pyarrow as pa

from gaugeline.llm import simhash

TEXTS = [None, "", "a", "ab", "héé wörld " * 7, "the quick brown fox jumps over the lazy dog " * 20, "x" * 10_001, "🎉🎉🎉 emoji text"]


def test_rows_equal_a_plain_loop(docs):
    rng = np.random.default_rng(2)
    rows = [(int(i), TEXTS[int(i) % len(TEXTS)] if i % 3 else " ".join(map(str, rng.integers(0, 50, 60)))) for i in rng.permutation(200)]
    got = {r["doc_id"]: r for r in simhash.fingerprint_rows(docs(rows)).collect()}
    order = sorted(rows, reverse=True)
    assert len(got) == len(rows)
    for k, (i, text) in enumerate(order):
        text, following = text or "", order[(k + 1) % len(order)][1] or ""
        n = len(text) // 2
        changed = text[: len(text) - n] + following[:n]
        prints = simhash.fingerprints(pa.array([text, changed, following]))
        r = got[i]
        assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(changed.encode()).hexdigest()
        assert (r["fingerprint"], r["edited_fingerprint"]) == tuple(p.tobytes().hex() for p in prints[:2])
        assert r["near_edited"] == simhash.likeness(prints[:1], prints[1:2])[0] and r["near_next"] == simhash.likeness(prints[:1], prints[2:])[0]


def test_classes_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    prints = rng.integers(0, 256, (40, 32), dtype=np.uint8)
    rows = []
    for p in prints:
        for flips in (0, 0, 3, 7, 8, 12):
            q = p.copy()
            for at in rng.choice(256, flips, replace=False):
                q[at // 8] ^= 1 << (at % 8)
            rows.append((len(rows), q.tobytes().hex()))
    bits = np.array([np.frombuffer(bytes.fromhex(f), np.uint8) for _, f in rows])
    near = simhash.BIT_COUNT[bits[:, None] ^ bits[None]].sum(2) <= 7
    up = np.arange(len(rows))
    for _ in range(len(rows)):
        new = np.array([up[near[i]].min() for i in range(len(rows))])
        if (new == up).all():
            break
        up = new
    df = spark.createDataFrame(rows, "doc_id long, fingerprint string")
    for block in (512, 3):
        got = {r["fingerprint"]: r["class_id"] for r in simhash.classes(df, 7, block).collect()}
        assert all(got[f] == up[i] for i, f in rows)


def test_half_edited_texts_are_nearer_than_others(spark):
    df = simhash.fingerprint_documents(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))
    rows = [r for r in df.collect() if r["n_chars"] > 200]
    assert np.mean([r["near_edited"] > r["near_next"] for r in rows if r["near_next"] < 0.75]) > 0.99


def test_one_row_repeats_nulls_and_empty(docs):
    r = simhash.fingerprint_documents(docs([(1, "abcd")])).first()
    assert r["edited_sha256"] == hashlib.sha256(b"abab").hexdigest() and r["near_next"] == 1.0
    rows = simhash.fingerprint_documents(docs([(4, "b"), (4, "a"), (4, "a"), (None, "z y"), (2, None)])).collect()
    assert len(rows) == 5 and len({r["fingerprint"] for r in rows if r["doc_id"] == 4}) == 2
    assert simhash.fingerprint_documents(docs([])).count() == 0


def test_near_copies_of_usual_length_share_a_class(docs):
    rng = np.random.default_rng(5)
    rows = []
    for t in range(12):
        w = [f"t{t}w{k}" for k in rng.integers(0, 10**6, 150)]
        for edits in (0, 1, 2):
            v = list(w)
            for at in rng.choice(150, edits, replace=False):
                v[at] = f"new{rng.integers(10**6)}"
            rows.append((len(rows), " ".join(v)))
    got = {r["doc_id"]: r["class_id"] for r in simhash.fingerprint_documents(docs(rows)).collect()}
    assert got == {i: i - i % 3 for i, _ in rows}


def test_classes_at_a_wide_radius_equal_brute_force(spark):
    rng = np.random.default_rng(6)
    rows = []
    for p in rng.integers(0, 256, (30, 32), dtype=np.uint8):
        for flips in (0, 12, 20, 24, 25, 26, 40):
            q = p.copy()
            for at in rng.choice(256, flips, replace=False):
                q[at // 8] ^= 1 << (at % 8)
            rows.append((len(rows), q.tobytes().hex()))
    # one bit apart in every first block but the last: the two share that block only, and one of the second cut
    spread = np.zeros(256, np.uint8)
    spread[[a for a in simhash.cuts_of(256, 25)[:24]]] = 1
    rows += [(1000, "00" * 32), (1001, np.packbits(spread).tobytes().hex())]
    bits = np.array([np.frombuffer(bytes.fromhex(f), np.uint8) for _, f in rows])
    near = simhash.BIT_COUNT[bits[:, None] ^ bits[None]].sum(2) <= 24
    up = np.array([i for i, _ in rows])
    for _ in range(len(rows)):
        up = np.array([up[near[i]].min() for i in range(len(rows))])
    df = spark.createDataFrame(rows, "doc_id long, fingerprint string")
    for block, most in ((2048, None), (2048, 1), (1, 1)):
        got = {r["fingerprint"]: r["class_id"] for r in simhash.classes(df, 24, block, most).collect()}
        assert all(got[f] == up[k] for k, (_, f) in enumerate(rows))
    assert up[-1] == 1000


def test_ranges_of_any_number_and_rows_without_ids(docs, spark):
    rows = [(None, f"no id {i} {i % 7}") for i in range(40)] + [(i // 3, f"text {i}") for i in range(30)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    found = []
    try:
        for parts in ("1", "3", "64"):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            got = simhash.fingerprint_rows(docs(rows))
            assert got.select("doc_id", "n_chars", "fingerprint").count() == len(rows)
            found.append(sorted(map(str, (tuple(r) for r in got.collect()))))
        spark.conf.set("spark.sql.shuffle.partitions", "20000")
        ranges = docs(rows).repartitionByRange(20_000, "doc_id")  # the form that fingerprint_rows uses plans at any number
        assert "20000" in ranges._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert found[0] == found[1] == found[2]


def test_link_counts_equal_brute_force(spark):
    rng = np.random.default_rng(8)
    rows = []
    for p in rng.integers(0, 256, (25, 32), dtype=np.uint8):
        for flips in (0, 0, 9, 12, 14, 20, 24, 25):
            q = p.copy()
            for at in rng.choice(256, flips, replace=False):
                q[at // 8] ^= 1 << (at % 8)
            rows.append((len(rows), q.tobytes().hex()))
    bits = np.array([np.frombuffer(bytes.fromhex(f), np.uint8) for _, f in rows])
    near = (simhash.BIT_COUNT[bits[:, None] ^ bits[None]].sum(2) <= 24).sum(1) - 1
    df = spark.createDataFrame(rows, "doc_id long, fingerprint string")
    for block, most in ((2048, None), (2048, 1), (1, None), (1, 10**6), (2, 1)):
        got = {r["fingerprint"]: r["n_links"] for r in simhash.classes(df, 24, block, most).collect()}
        assert [got[f] for _, f in rows] == near.tolist()


def test_memory_of_a_bucket_of_near_copies_is_bounded():
    """All pairs of the group are near; their bits are not held at once."""
    rng = np.random.default_rng(9)
    bits = np.repeat(rng.integers(0, 2, (1, 256), dtype=np.uint8), 1500, axis=0)
    for row in bits:
        row[rng.choice(np.arange(20, 256), 10, replace=False)] ^= 1  # the first block is the same in all
    prints, part, cuts = np.packbits(bits, axis=1), np.zeros(1500, np.int64), simhash.cuts_of(256, 25)
    apart = np.array([(bits != b).sum(1) for b in bits])
    shared = np.array([[(bits[:, a:z] == b[a:z]).all(1) for a, z in zip(cuts[:-1], cuts[1:], strict=True)] for b in bits[:60]])
    inside, borders = simhash.inner_cuts(0, cuts, 24)
    second = np.array([[(bits[:, inside[a:z]] == b[inside[a:z]]).all(1) for a, z in zip(borders[:-1], borders[1:], strict=True)] for b in bits[:60]])
    for table, inner, first in ((0, -1, None), (3, -1, shared), (0, 5, second)):
        tracemalloc.start()
        got = set()
        for i, j in simhash.own_pairs(prints, 24, part, False, table << simhash.FIRST, inner if inner < 0 else inner << simhash.FIRST):
            assert len(i) <= simhash.PAIRS
            few = i < 60
            got |= set(zip(i[few].tolist(), j[few].tolist(), strict=True))
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        before = table if inner < 0 else inner
        assert got == {(i, j) for i in range(60) for j in range(i + 1, 1500) if apart[i, j] <= 24 and (first is None or not first[i, :before, j].any())}
        assert peak < 60e6


def test_memory_of_a_long_text_is_bounded():
    text = " ".join(map(str, range(60_000)))
    tracemalloc.start()
    simhash.fingerprints(pa.array([text]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60e6
