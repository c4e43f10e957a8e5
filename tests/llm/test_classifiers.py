import numpy as np
import pytest

from gaugeline.llm import quality, toxicity
from gaugeline.llm.queries import op8_toxicity, op9_quality

SF = "/root/testdata/sf0.1"  # enough held-out rows of the rare label


def auc(scores, labels):
    order = np.argsort(np.argsort(scores, kind="stable"), kind="stable") + 1
    pos = np.array(labels) == 1
    return (order[pos].sum() - pos.sum() * (pos.sum() + 1) / 2) / (pos.sum() * (~pos).sum())


@pytest.mark.parametrize(("query", "label", "least"), [(op8_toxicity, "toxic", 0.85), (op9_quality, "quality", 0.95)])
def test_held_out_rows_are_told_apart(spark, query, label, least):
    rows = query(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").where("held_out").collect()
    assert auc([r["score"] for r in rows], [r[label] for r in rows]) > least
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in rows)


def labelled(spark, docs, op):
    words = "good kind calm fine".split()
    rows = [(i, " ".join(words[(i + k) % 4] for k in range(30)) + (" you idiot!!" if i % 4 == 0 else "") + (" ### $$$ &&&" * 9 if i % 5 == 0 else "")) for i in range(300)]
    labels = spark.createDataFrame([(i, int(i % 5 != 0), int(i % 4 == 0)) for i, _ in rows] + [(None, 1, 1), (7, None, None), (8, 5, 5), (1, 1, 0)], "doc_id long, quality int, toxic int")
    more = [(1000, None), (1001, ""), (1002, "idiot " * 30_000), (1003, "i d i o t you"), (4, rows[4][1]), (None, "you idiot")]
    return docs(rows + more), labels


def test_toxicity_cases(spark, docs):
    d, labels = labelled(spark, docs, toxicity)
    model = toxicity.fit(d, labels)
    out = toxicity.score(d, model).collect()
    assert len(out) == 306
    by = {r["doc_id"]: r for r in out}
    assert all(by[i]["predicted"] == int(i % 4 == 0) for i in range(300)) and by[1000]["score"] == by[1001]["score"]
    kept = toxicity.keep_clean(d, model)
    assert kept.columns == d.columns and {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in out if not r["predicted"]}


def test_quality_cases(spark, docs):
    d, labels = labelled(spark, docs, quality)
    model = quality.fit(d, labels)
    out = quality.score(d, model).collect()
    assert len(out) == 306
    by = {r["doc_id"]: r for r in out}
    assert all(by[i]["predicted"] == int(i % 5 != 0) for i in range(300)) and by[1000]["score"] == by[1001]["score"]
    kept = quality.keep_good(d, model)
    assert kept.columns == d.columns and kept.count() == sum(r["predicted"] for r in out)


@pytest.mark.parametrize("op", [toxicity, quality])
def test_no_labels_and_empty_tables(spark, docs, op):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = op.fit(docs([]), none)
    assert op.score(docs([]), model).count() == 0
    rows = op.score(docs([(1, "a"), (2, None)]), model).collect()
    assert len({r["score"] for r in rows}) == 1 and 0 <= rows[0]["score"] <= 1


def test_scores_are_the_sparse_dot_product():
    import pyarrow as pa

    rng = np.random.default_rng(0)
    model, texts = quality.Model(rng.normal(size=2**quality.BITS)), pa.array(["A b c, d!", None, "x", "one two three one two three"])
    want = [1 / (1 + np.exp(-(model.weights[at] @ x))) for at, x in quality.vectors(texts)]
    assert np.allclose(model.score(texts), want, atol=1e-5)


def test_features_see_hidden_words():
    import pyarrow as pa

    f = toxicity.features(pa.array(["an 1d1ot here", "what an i d i o t you", "you IDIOT!!", "plain words", None]), {"idiot": 2.0})
    assert f.shape == (5, toxicity.N_FEATURES) and f[0, 17] == f[1, 17] == 1 and f[2, 1] > 0 and f[2, 9] > 0 and not f[3, [1, 17]].any()


def test_equal_margins_are_one_point():
    from gaugeline.llm import boosting

    rng = np.random.default_rng(4)
    y = (rng.random(400) < 0.1075).astype(float)
    centres, values = boosting.isotonic(np.full(400, -1.5), y)
    assert len(centres) == 1 and abs(values[0] - y.mean()) < 1e-3
    m = rng.integers(-5, 6, 3000).astype(float)
    y = (rng.random(3000) < 1 / (1 + np.exp(-m))).astype(float)
    centres, values = boosting.isotonic(m, y)
    # brute force: the least-squares monotone fit is max over starts of min over ends of block means
    points = np.unique(m)
    s, n = (np.array([f(m == p) for p in points]) for f in (lambda k: y[k].sum(), lambda k: k.sum()))
    want = [max(min(s[a : b + 1].sum() / n[a : b + 1].sum() for b in range(k, len(points))) for a in range(k + 1)) for k in range(len(points))]
    assert np.allclose(np.interp(points, centres, values), want, atol=0.05) and (np.diff(values) >= 0).all()
    assert boosting.isotonic(np.zeros(0), np.zeros(0))[1].tolist() == [0.5]


@pytest.mark.parametrize(("op", "n", "rest"), [(toxicity, 5, 0), (quality, 3, 1)])
def test_held_out_is_the_checksum_rule(spark, docs, op, n, rest):
    import zlib

    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    d = docs([(i * 7919, "a") for i in range(300)] + [(None, "b")])
    rows = op.score(d, op.fit(d, none)).collect()
    assert len(rows) == 301
    assert all(r["held_out"] == (zlib.crc32(("" if r["doc_id"] is None else str(r["doc_id"])).encode()) % n == rest) for r in rows)


def test_ftrl_equals_its_formulas():
    rng = np.random.default_rng(1)
    model = quality.Ftrl()
    z, n = {}, {}
    for _ in range(60):
        at, x, y = rng.choice(30, 5, replace=False).astype(np.int32), rng.random(5), int(rng.random() < 0.5)
        w = {}
        for i in at.tolist():
            zi, ni = z.get(i, 0.0), n.get(i, 0.0)
            w[i] = 0.0 if abs(zi) <= model.l1 else -(zi - np.sign(zi) * model.l1) / ((model.beta + ni**0.5) / model.alpha + model.l2)
        p = 1 / (1 + np.exp(-sum(w[i] * v for i, v in zip(at.tolist(), x, strict=True))))
        for i, v in zip(at.tolist(), x.tolist(), strict=True):
            g = (p - y) * v
            s = ((n.get(i, 0.0) + g * g) ** 0.5 - n.get(i, 0.0) ** 0.5) / model.alpha
            z[i], n[i] = z.get(i, 0.0) + g - s * w[i], n.get(i, 0.0) + g * g
        model.update(at, x, y)
    assert all(np.isclose(model.z[i], z[i]) and np.isclose(model.n[i], n[i]) for i in z)
