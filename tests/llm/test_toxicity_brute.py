"""The twenty features and the trees of the toxicity model against plain loops over one text at a time."""

import math
import random
import re

import numpy as np
import pyarrow as pa

from gaugeline.llm import boosting, toxicity

LETTER_RUN = re.compile(r"[^\W\d_]+")  # the test's texts hold no numerals but digits


def hidden(word, lexicon):
    return word.translate(toxicity.LEET) in lexicon or word.replace("*", "") in lexicon


def brute_features(text, lexicon):
    tokens = [t for t in re.split(r"[\x20\x09-\x0D]+", text or "") if t]
    words = [LETTER_RUN.findall(t.lower()) for t in tokens]
    flat = [w for ws in words for w in ws]
    found = [[w for w in ws if w in lexicon] for ws in words]
    hits, weight = sum(map(len, found)), sum(lexicon[w] for f in found for w in f)
    you = [any(w in toxicity.YOU for w in ws) for ws in words]
    near = sum(bool(f) and any(you[max(0, i - 5) : i + 6]) for i, f in enumerate(found))
    mixed = [m[0] for t in tokens for m in toxicity.MIXED.finditer(t.lower())]
    runs = spelt = i = 0
    single = [len(ws) == 1 and len(ws[0]) == 1 for ws in words]
    while i < len(tokens):
        to = i
        while to < len(tokens) and single[to]:
            to += 1
        if to - i >= 4:
            runs += 1
            spelt += "".join(w for ws in words[i:to] for w in ws) in lexicon
        i = max(to, i + 1)
    n, letters, size = max(len(flat), 1), max(sum(map(len, flat)), 1), max(len(text or ""), 1)
    count = lambda pattern: sum(len(re.findall(pattern, t)) for t in tokens)
    return [
        math.log1p(len(flat)), math.log1p(hits), hits / n, len({w for f in found for w in f}), max((lexicon[w] for f in found for w in f), default=0),
        weight, weight / n, weight / math.sqrt(n), sum(w in toxicity.YOU for w in flat) / n, math.log1p(near), near / n,
        sum(c.isupper() for t in tokens for c in t) / letters, count("!") / size, count(r"\?") / size, count(r"[^\w\s]") / size, count(r"[!?*#$%&@]{2,}") / n,
        len(mixed) / n, sum(hidden(m, lexicon) for m in mixed) + spelt, runs / n, sum(bool(re.search(r"([^\W\d_])\1\1", t.lower())) for t in tokens) / n,
    ]


def test_features_equal_plain_loops():
    rng, lexicon = random.Random(8), {"idiot": 2.0, "moron": 1.5, "du": 1.0, "grrr": 0.5}
    parts = ["idiot", "Idiot", "IDIOT!!", "moron.", "you", "You", "your", "1d1ot", "m*o*r*o*n", "i d i o t", "a b c", "x y z w", "word", "Wörter,", "loooong", "grrr", "???", "&&&", "3rd", "e-mail", "du", "usted;", "it's", "\n", "ÉTÉ", "ok#$ok", "i.", "d"]
    texts = [None, "", "   ", "idiot"] + [" ".join(rng.choice(parts) for _ in range(rng.randrange(1, 60))) for _ in range(300)]
    got, want = toxicity.features(pa.array(texts), lexicon), np.array([brute_features(t, lexicon) for t in texts])
    assert got.shape == want.shape and np.allclose(got, want, atol=1e-6), np.argwhere(~np.isclose(got, want, atol=1e-6))[:5]


def test_margins_equal_a_walk_through_every_tree():
    rng = np.random.default_rng(4)
    x = np.round(rng.random((400, 5)), 2)
    trees = boosting.fit(x, ((x[:, 0] > 0.5) ^ (x[:, 3] > 0.7)).astype(float), trees=20)
    depth = int(np.log2(trees.leaf.shape[1]))
    want = []
    for row in x:
        bins, margin = [sum(v >= e for e in edges) for v, edges in zip(row, trees.edges, strict=True)], trees.bias
        for feature, cut, leaf in zip(trees.feature, trees.cut, trees.leaf, strict=True):
            node = 0
            for level in range(depth):
                k = 2**level - 1 + node
                node = 2 * node + int(bins[feature[k]] > cut[k])
            margin += leaf[node]
        want.append(margin)
    assert np.allclose(trees.margin(x), want)


def test_a_split_is_the_best_of_all_cuts():
    rng = np.random.default_rng(6)
    x, g = rng.integers(0, 8, (60, 3)), rng.normal(size=60)
    h, l2, least = np.full(60, 0.25), 1.0, 2.0
    hist = lambda w: np.stack([np.bincount(x[:, j], w, 8)[None] for j in range(3)], 1)
    gains = {}
    for j in range(3):
        for c in range(8):
            left = x[:, j] <= c
            if min(h[left].sum(), h[~left].sum()) >= least:
                gains[j, c] = sum(g[s].sum() ** 2 / (h[s].sum() + l2) for s in (left, ~left))
    feature, cut = boosting.best_splits(hist(g), hist(h), l2, least)
    assert gains[int(feature[0]), int(cut[0])] >= max(gains.values()) - 1e-12
