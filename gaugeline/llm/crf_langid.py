"""Language identification of words in code-switched text with a linear-chain conditional random field.

States are the languages of the labelled documents. A word's features are its affixes (one to three
letters at either end), its letter n-grams with borders, and whether it is in a language's lexicon of
frequent words; transitions are learned. Training sequences are made of stretches of labelled texts
of several languages put end to end, so that switches occur in them. Texts are labelled by
forward-backward, computed for all words of a batch at once: sequences are cut into blocks, the blocks'
transfer matrices are multiplied up, and each block is then swept from its true border values.

A document's language is the one with the largest share of the words' posterior mass (weighed by
letters); that share is the score.

Fitting uses a bounded sample: at most `bound` labelled ids, `each` rows of an id that repeats and `stretch`
words of each row, from a place given by a hash, which the driver collects; the lexicon holds the `lexicon_size` most frequent words of each language in it. Everything
else reads whole texts and whole words.
Defined results: a text that is null or has no letter is `und` with score 0; ties go to the first
language in alphabetical order; without labelled texts all are `und`; repeated rows get equal results;
extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeline.llm.common import few_of_each, letter_runs, mapped, mix, remainder, words_of

BITS, BLOCK = 16, 64


def feature_numbers(words: list[str]) -> np.ndarray:
    """Hashed features of each word: prefixes, suffixes, bigrams and trigrams with borders; -1 where none.

    The row is as wide as the longest word needs; see featured() for words of any length."""
    longest = max(map(len, words), default=0) + 2
    a = np.array([f"^{w}$" for w in words], dtype=f"U{longest}")
    c = a.view(np.uint32).reshape(len(words), -1).astype(np.uint64)
    n = (c > 0).sum(1)
    rows, out = np.arange(len(words)), []
    with np.errstate(over="ignore"):
        for size in (1, 2, 3):  # affixes
            for kind, at in ((1, np.ones(len(words), int)), (2, np.maximum(n - 1 - size, 1))):
                h = np.full(len(words), 10 * size + kind, np.uint64)
                for k in range(size):
                    h = mix(h + c[rows, np.minimum(at + k, c.shape[1] - 1)])
                out.append(np.where(n - 2 >= size, (h >> np.uint64(64 - BITS)).astype(np.int64), -1)[:, None])
        for size in (2, 3):  # n-grams
            h = np.full((len(words), c.shape[1] - size + 1), 100 * size, np.uint64)
            for k in range(size):
                h = mix(h + c[:, k : c.shape[1] - size + 1 + k])
            inside = np.arange(h.shape[1]) + size <= n[:, None]
            out.append(np.where(inside, (h >> np.uint64(64 - BITS)).astype(np.int64), -1))
    return np.concatenate(out, 1)


def featured(words: list[str], cells: int = 2_000_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places of words, their feature rows), words of like length together and about `cells` numbers at a
    time, so that one very long word widens its own row only; every letter counts."""
    size = np.fromiter(map(len, words), np.int64, len(words))
    order, at = np.argsort(size, kind="stable"), 0
    while at < len(order):
        to = at + 1
        most = max(8, 2 * int(size[order[at]]))
        width = 2 * most + 16
        to = max(to, min(int(np.searchsorted(size[order], most, "right")), at + max(1, cells // width)))
        yield order[at:to], feature_numbers([words[k] for k in order[at:to]])
        at = to


def forward_backward(emit: np.ndarray, move: np.ndarray, start: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Posteriors of every word's state, and the expected counts of transitions.

    emit (words x states) and move (states x states, from row to column) are positive scores, start the
    scores of first states; sequence i has the words first[i] to first[i + 1]. Sequences are cut into
    blocks of BLOCK words; a scaled transfer matrix of each block carries the border values."""
    states, words = len(start), len(emit)
    if not words:
        return np.zeros((0, states)), np.zeros((states, states))
    size = np.diff(first)
    blocks = -(-size // BLOCK)
    seq = np.repeat(np.arange(len(size)), blocks)
    nth = np.arange(len(seq)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    at = first[seq] + nth * BLOCK
    n = np.minimum(BLOCK, first[seq + 1] - at)
    e = np.ones((len(seq), BLOCK, states))
    live = np.arange(BLOCK) < n[:, None]
    e[live] = emit
    scaled = lambda m: m / m.sum(tuple(range(1, m.ndim)), keepdims=True)
    transfer = np.broadcast_to(np.eye(states), (len(seq), states, states)).copy()
    for t in range(BLOCK):
        on = live[:, t]
        moved = transfer[on] @ move
        if t == 0:
            moved = np.where((nth[on] > 0)[:, None, None], moved, transfer[on])
        transfer[on] = scaled(moved * e[on, t][:, None, :])
    # `enter` is the state mass before a block's first word; no move leads into the first word of a sequence
    enter, leave = np.ones((len(seq), states)), np.ones((len(seq), states))
    order = np.argsort(nth, kind="stable")
    steps = np.split(order, np.cumsum(np.bincount(nth))[:-1])
    for k, here in enumerate(steps):
        enter[here] = start if k == 0 else scaled(np.einsum("bs,bst->bt", enter[here - 1], transfer[here - 1]) + 1e-300)
    ends = np.cumsum(blocks)[blocks > 0] - 1
    last = np.zeros(len(seq), bool)
    last[ends] = True
    for here in reversed(steps):
        inner = here[~last[here]]
        leave[inner] = scaled(np.einsum("bst,bt->bs", transfer[inner + 1], leave[inner + 1]) + 1e-300)
    alpha, a = np.empty_like(e), enter
    for t in range(BLOCK):
        moved = a @ move if t else np.where((nth > 0)[:, None], a @ move, a)
        a = np.where(live[:, t, None], scaled(moved * e[:, t] + 1e-300), a)
        alpha[:, t] = a
    post, moves, b = np.empty_like(e), np.zeros((states, states)), leave
    for t in range(BLOCK - 1, -1, -1):
        on = live[:, t]
        g = scaled(alpha[:, t] * b + 1e-300)
        post[:, t] = g
        before = alpha[:, t - 1] if t else enter
        pair = before[:, :, None] * move[None] * (e[:, t] * b)[:, None, :]
        inner = on & ((nth > 0) | (t > 0))
        if inner.any():
            moves += scaled(pair[inner] + 1e-300).sum(0)
        b = np.where(on[:, None], scaled((e[:, t] * b) @ move.T + 1e-300), b)
    return post[live], moves


@dataclass(frozen=True)
class Model:
    langs: list[str]
    weights: np.ndarray  # (2^BITS + 1) x states; the last row is zero
    bias: np.ndarray
    lexicon: dict[str, int]  # word -> bit mask of languages
    lexicon_weights: np.ndarray  # languages x states
    move: np.ndarray  # log scores

    def emissions(self, words: list[str]) -> np.ndarray:
        """Log scores of distinct words."""
        if not words:
            return np.zeros((0, len(self.langs)))
        out = np.empty((len(words), len(self.langs)))
        for at, feats in featured(words):
            out[at] = self.weights[feats].sum(1) + self.bias
        masks = np.array([self.lexicon.get(w, 0) for w in words])
        return out + (masks[:, None] >> np.arange(len(self.langs)) & 1) @ self.lexicon_weights

    def posteriors(self, words: list[str], at: np.ndarray, first: np.ndarray) -> np.ndarray:
        e = self.emissions(words)
        e = np.exp(np.clip(e - e.max(1, keepdims=True), -60, 0))[at] if len(e) else np.zeros((0, len(self.langs)))
        return forward_backward(e, np.exp(self.move), np.ones(len(self.langs)), first)[0]


def letter_words(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct words of letters in small letters, the number of every word in order, and where texts begin."""
    words = words_of(texts)
    number: dict[str, int] = {}
    each = [[number.setdefault(w, len(number)) for w in letter_runs(t.lower())] for t in words.tokens]
    count = np.fromiter(map(len, each), np.int64, len(each))
    start, flat = np.cumsum(count) - count, np.array([x for xs in each for x in xs], np.int64)
    n = count[words.at]
    end = np.cumsum(n)
    at = flat[np.repeat(start[words.at] - end + n, n) + np.arange(n.sum())] if len(flat) else flat
    return list(number), at, np.concatenate([[0], end])[words.first]


def sample_stretches(docs: DataFrame, bound: int, stretch: int, each: int) -> DataFrame:
    """(lang, words) of at most `bound` labelled rows whose crc32(doc_id as text) mod 3 is not 1."""
    schema = pa.schema([("lang", pa.string()), ("words", pa.list_(pa.string()))])

    def cut(part: pa.RecordBatch) -> list:
        words, at, first = letter_words(part.column(1))
        out = []
        for a, b, h in zip(first[:-1].tolist(), first[1:].tolist(), part.column(2).to_pylist(), strict=True):
            a += h % max(1, b - a - stretch + 1)
            out.append([words[k] for k in at[a : min(b, a + stretch)].tolist()])
        return [part.column(0), pa.array(out, pa.list_(pa.string()))]

    rows = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").isNotNull() & (remainder(3) != 1))
    chosen = rows.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)
    rows = few_of_each(rows.select("doc_id", "lang", "text").join(F.broadcast(chosen), "doc_id"), each).select(F.col("lang").cast("string"), F.col("text").cast("string"), F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(2**31)).alias("h"))
    return rows.mapInArrow(mapped(cut, schema), "lang string, words array<string>")


def fit(docs: DataFrame, bound: int = 2_000, stretch: int = 200, steps: int = 40, lexicon_size: int = 300, each: int = 4) -> Model | None:
    rows = sorted((r["lang"], r["words"]) for r in sample_stretches(docs, bound, stretch, each).collect() if r["words"])
    if not rows:
        return None
    langs = sorted({lang for lang, _ in rows})
    states, rng = len(langs), np.random.default_rng(3)
    counts = [Counter(w for lang, ws in rows if lang == x for w in ws) for x in langs]
    lexicon: dict[str, int] = {}
    for k, c in enumerate(counts):
        for w, _ in sorted(c.items(), key=lambda x: (-x[1], x[0]))[:lexicon_size]:
            lexicon[w] = lexicon.get(w, 0) | 1 << k
    # stretches of 5 to 60 words in random order, 8 to a sequence
    pieces: list[tuple[int, list[str]]] = []
    for lang, ws in rows:
        at = 0
        while at < len(ws):
            n = int(rng.integers(5, 61))
            pieces.append((langs.index(lang), ws[at : at + n]))
            at += n
    pieces = [pieces[i] for i in rng.permutation(len(pieces))]
    number: dict[str, int] = {}
    at = np.array([number.setdefault(w, len(number)) for _, ws in pieces for w in ws])
    y = np.repeat([k for k, _ in pieces], [len(ws) for _, ws in pieces])
    ends = np.cumsum([len(ws) for _, ws in pieces])
    first = np.unique(np.concatenate([[0], ends[7::8], ends[-1:]]))
    words, seen = list(number), np.bincount(at, minlength=len(number))
    masks = (np.array([lexicon.get(w, 0) for w in words])[:, None] >> np.arange(states) & 1).astype(float)
    found = [(feats[feats >= 0], at[np.nonzero(feats >= 0)[0]]) for at, feats in featured(words)]
    flat, owner = (np.concatenate(x) for x in zip(*found, strict=True))
    model = Model(langs, np.zeros((2**BITS + 1, states)), np.zeros(states), lexicon, np.zeros((states, states)), np.zeros((states, states)))
    truth = np.zeros((len(words), states))
    np.add.at(truth, (at, y), 1)
    inner = np.ones(len(y), bool)
    inner[first[:-1]] = False
    went = np.zeros((states, states))
    np.add.at(went, (y[:-1][inner[1:]], y[1:][inner[1:]]), 1)
    move = np.log((went + 1) / (went + 1).sum(1, keepdims=True))  # starts at the observed shares
    params = [model.weights, model.bias, model.lexicon_weights, move]
    power = [np.full_like(p, 1e-6) for p in params]
    for _ in range(steps):
        e = model.emissions(words)
        e = np.exp(np.clip(e - e.max(1, keepdims=True), -60, 0))
        post, moves = forward_backward(e[at], np.exp(move), np.ones(states), first)
        gap = truth - np.stack([np.bincount(at, post[:, k], len(words)) for k in range(states)], 1)
        gap /= len(y)
        g = [np.stack([np.bincount(flat, gap[owner, k], 2**BITS + 1) for k in range(states)], 1), gap.sum(0), masks.T @ gap, (went - moves) / len(y)]
        for p, s, d, rate in zip(params, power, g, (0.1, 0.1, 0.1, 0.02), strict=True):
            s += d * d
            p += rate * d / np.sqrt(s)
        model.weights[-1] = 0
    del seen
    return Model(langs, model.weights.astype(np.float32), model.bias, lexicon, model.lexicon_weights, move)


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row."""
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64())])

    def run(part: pa.RecordBatch) -> list:
        n = part.num_rows
        if model is None:
            return [part.column(0), part.column(1), pa.array(["und"] * n), pa.array([0.0] * n)]
        words, at, first = letter_words(part.column(2))
        post = model.posteriors(words, at, first) * np.array([len(w) for w in words], float)[at][:, None]
        mass = np.concatenate([np.zeros((1, len(model.langs))), np.cumsum(post, 0)])
        mass = mass[first[1:]] - mass[first[:-1]]
        total = np.maximum(mass.sum(1), 1e-12)
        known, best = np.diff(first) > 0, mass.argmax(1)
        return [part.column(0), part.column(1), pa.array([model.langs[b] if k else "und" for k, b in zip(known, best, strict=True)]), pa.array(np.where(known, np.clip(mass.max(1) / total, 0, 1), 0.0))]

    rows = docs.select(F.col("doc_id").cast("long"), (remainder(3) == 1).alias("held_out"), F.col("text").cast("string"))
    return rows.mapInArrow(mapped(run, schema), "doc_id long, held_out boolean, lang_pred string, score double")


def label_words(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, word, lang, score) for every word of letters of every text, in order of its place `n`."""
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("word", pa.string()), ("lang", pa.string()), ("score", pa.float64())])

    def run(part: pa.RecordBatch) -> list:
        words, at, first = letter_words(part.column(1))
        post = model.posteriors(words, at, first)
        size = np.diff(first)
        ids = np.repeat(part.column(0).to_numpy(zero_copy_only=False), size)
        return [pa.array(ids, pa.int64(), from_pandas=True), pa.array(np.arange(len(at)) - np.repeat(first[:-1], size)), pa.array([words[k] for k in at]), pa.array([model.langs[k] for k in post.argmax(1)]), pa.array(post.max(1) if len(post) else [])]

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(mapped(run, schema), "doc_id long, n long, word string, lang string, score double")
