import numpy as np
import pytest

from gaugeline.llm import kmeans_tree


def brute(rows, every, k):
    keep = {i: np.array(v, float) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(v).all() and np.any(v)}
    out = {}
    for q in keep:
        if q % every == 0:
            unit = lambda x: x / np.linalg.norm(x)
            near = sorted(((-float(unit(keep[q]) @ unit(v)), i) for i, v in keep.items() if i != q))
            out[q] = [(i, -s) for s, i in near[:k]]
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 label", "2 node", "3 leaf", "'x' v", "4 rank", "5 score")


def test_small_tables_and_bad_vectors(spark):
    rows = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [1.0, 1.0]), (3, None), (4, [0.0, 0.0]), (5, [float("nan"), 1.0]), (6, [None, 1.0]), (50, [0.0, 3.0]), (7, [float("inf"), 1.0]), (None, [1.0, 1.0]), (8, [1.0, 2.0, 3.0]), (100, None)]
    got = {}
    for r in kmeans_tree.search(frame(spark, rows)).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    want = brute([r for r in rows if r[0] != 8], 50, 5)
    assert set(got) == set(want)
    for q, near in want.items():
        assert [(k + 1, i) for k, (i, _) in enumerate(near)] == [x[:2] for x in sorted(got[q])]
        assert np.allclose([s for _, s in near], [x[2] for x in sorted(got[q])], atol=1e-12)


def test_recall_with_a_common_vector(spark):
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(12, 16))
    x = centres[rng.integers(0, 12, 3000)] + 0.6 * rng.normal(size=(3000, 16))
    x[::3] = x[0]  # a third of the rows are one vector
    rows = [(i, v.tolist()) for i, v in enumerate(x.astype(np.float32))]
    got = {}
    for r in kmeans_tree.search(frame(spark, rows)).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    want = brute(rows, 50, 5)
    assert set(got) == set(want)
    hits = 0
    for q, near in want.items():
        mine = sorted(got[q])
        assert len(mine) == 5 and all(a[2] >= b[2] - 1e-15 for a, b in zip(mine, mine[1:], strict=False))
        hits += len({i for i, _ in near} & {x[1] for x in mine})
        if q % 3 == 0:  # ties go to the smaller ids
            assert [x[1] for x in mine] == [i for i in range(0, 30, 3) if i != q][:5]
    assert hits >= 0.9 * 5 * len(want)


def test_best_bins_visits_every_leaf_once():
    rng = np.random.default_rng(1)
    x = kmeans_tree.unit(rng.normal(size=(2000, 8)))
    tree = kmeans_tree.grow(x, 50)
    order = [leaf for leaf, _ in tree.best_bins(x[0], tree.leaves)]
    assert sorted(order) == list(range(tree.leaves)) and set(tree.leaf_of(x).tolist()) <= set(order)


def test_enough_bins_for_a_share():
    assert [kmeans_tree.enough(list(range(100)), r) for r in (0.0, 0.5, 0.97, 1.0)] == [1, 51, 98, 100]
    assert kmeans_tree.enough([], 0.9) == 1


def clustered(n):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(40, 16))[rng.integers(0, 40, n)] + 0.3 * rng.normal(size=(n, 16))
    return [(i, v.tolist()) for i, v in enumerate(x.astype(np.float32))]


@pytest.fixture
def parts(spark):
    """filed and levels of a small top (2 trained leaves or so) whose leaves are split at 40 rows."""

    def of(rows):
        x = kmeans_tree.unit(np.array([v for _, v in rows], float))
        tree = kmeans_tree.grow(x[:100], 60)
        filed = spark.createDataFrame([(i, [float(c) for c in v], int(leaf)) for (i, v), leaf in zip(rows, tree.leaf_of(x), strict=True)], "vec_id long, v array<double>, leaf long")
        return tree, *kmeans_tree.split(filed, 16, 40)

    return of


def test_leaves_grow_with_the_table(parts):
    counts, shares = [], []
    for n in (1000, 4000):
        rows = clustered(n)
        tree, filed, levels = parts(rows)
        assert len(levels) >= 1 and sorted(r["vec_id"] for r in filed.select("vec_id").collect()) == list(range(n))
        counts.append(filed.select("leaf").distinct().count())
        probes = filed.orderBy("vec_id").limit(60).collect()
        visits = kmeans_tree.calibrate(probes, filed, tree, levels, 5, 0.97)
        assert len(visits) == len(levels) + 1
        shares.append(visits[-1] / counts[-1])
    assert counts[1] > 2.5 * counts[0] and shares[1] < shares[0] < 1


def test_probes_meet_every_row(spark, parts):
    rows = clustered(1000)
    _, filed, _ = parts(rows)
    probes = filed.where("vec_id % 50 = 0").collect()
    got = {}
    for r in kmeans_tree.neighbours_of(probes, filed, 5).collect():
        got.setdefault(r["node"], set()).add(r["vec_id"])
    assert got == {q: {i for i, _ in near} for q, near in brute(rows, 50, 5).items()}


def test_recall_through_split_leaves(spark):
    rows = clustered(3000)
    got = {}
    for r in kmeans_tree.search(frame(spark, rows), leaves=4, leaf_rows=60, block=16).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    want = brute(rows, 50, 5)
    assert set(got) == set(want) and all(len(v) == 5 for v in got.values())
    assert sum(len(got[q] & {i for i, _ in near}) for q, near in want.items()) >= 0.9 * 5 * len(want)


def test_leaves_that_do_not_give_way(spark):
    rows = [(i, [1.0, 0.0], 0) for i in range(90)]
    filed, levels = kmeans_tree.split(spark.createDataFrame(rows, "vec_id long, v array<double>, leaf long"), 2, 40)
    assert filed.count() == 90 and len(levels) <= 1


def test_recall_on_the_given_embeddings(spark):
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    got = {}
    for r in kmeans_tree.search(table).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    want = brute([tuple(r) for r in table.select("vec_id", "embedding").collect()], 50, 5)
    assert set(got) == set(want)
    assert sum(len(got[q] & {i for i, _ in near}) for q, near in want.items()) >= 0.9 * 5 * len(want)


def brute_of_rows(rows, every, k):
    """All (query_id, rank, vec_id) with every row on its own: a query's candidates are the other rows of its length."""
    unit = [np.array(v, float) / np.linalg.norm(v) for _, v in rows]
    out = []
    for a, (q, v) in enumerate(rows):
        if q % every == 0:
            near = sorted((-round(float(unit[a] @ unit[b]), 12), i) for b, (i, w) in enumerate(rows) if b != a and len(w) == len(v))
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(near[:k])]
    return sorted(out)


def test_repeated_ids_scaled_copies_and_other_lengths(spark):
    rng = np.random.default_rng(5)
    few = lambda n, width: rng.normal(size=(n, width)).astype(np.float32).tolist()
    rows = list(enumerate(few(300, 6)))
    rows += [rows[0]] * 9 + [rows[50]] * 2 + [rows[7]] * 3  # whole rows again, more often than k + 1
    rows += list(zip([0, 50, 50, 7, 8], few(5, 6), strict=True))  # the same ids with other vectors
    rows += [(i, [4 * c for c in rows[100][1]]) for i in (100, 101, 900)]  # scaled copies: equal cosines
    rows += list(zip([0, 50, 350, 351, 352], few(5, 9), strict=True)) + [(400, [1.0])] + list(zip(range(450, 460), few(10, 2000), strict=True))
    got = sorted((r["query_id"], r["rank"], r["vec_id"], round(r["score"], 12)) for r in kmeans_tree.search(frame(spark, rows), recall=1.0, leaves=2, leaf_rows=80).collect())
    want = brute_of_rows(rows, 50, 5)
    assert [x[:3] for x in got] == [x[:3] for x in want]
    assert np.allclose([x[3] for x in got], [x[3] for x in want], atol=1e-11)


@pytest.mark.parametrize("rows", [[], [(0, None)], [(0, [1.0, 2.0])]])
def test_no_candidates(spark, rows):
    out = kmeans_tree.search(frame(spark, rows))
    assert out.columns == ["query_id", "rank", "vec_id", "score"] and out.count() == 0
