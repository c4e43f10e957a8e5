"""Quality: logistic regression on hashed word n-grams, trained with follow-the-regularised-leader.

Tokens are the words between white space. A token gives two terms, its lower-cased form and its shape
(runs of capitals, of title, of small letters, of digits and of equal marks as one sign each); neighbouring tokens give the pair of their forms and
the pair of their shapes. Terms are hashed into a fixed number of weights, and a
text's vector holds each term's share of the terms; the score is the logistic of a sparse dot product.

Training reads a bounded sample of labelled rows, dealt to a fixed number of shards, one task each by
its number; a task streams its rows through FTRL-proximal updates, and the shards' weights are averaged.
No text leaves the executors, and the driver holds shards x weights numbers.

Defined results: a null text counts as empty, and an empty text is scored by the bias alone; repeated
rows get equal scores; without labels the score is 0.5; extra columns of the input are ignored.
"""

from __future__ import annotations

import itertools
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeline.llm.common import Words, labelled_sample, mapped, mix, remainder, slices, using, words_of

BITS = 18
SCALE = 8.0
SHAPES = ((re.compile(r"[^\W\d_]*[A-ZÀ-ÖØ-Þ][A-ZÀ-ÖØ-Þ]+[^\W\d_]*"), "C"), (re.compile(r"[A-ZÀ-ÖØ-Þ][^\W\d_]*"), "T"), (re.compile(r"[^\W\d_A-Z]+"), "s"), (re.compile(r"\d+"), "9"))
AGAIN = re.compile(r"(.)\1+")


class Terms(dict):
    """Token -> row of `hashes` (its form, its shape), up to a bound; one per Python worker."""

    most = 400_000

    def __init__(self) -> None:
        super().__init__()
        self.hashes = np.zeros((self.most, 2), np.uint64)

    def __missing__(self, token: str) -> int:
        i = self[token] = len(self)
        self.hashes[i] = xxhash.xxh3_64_intdigest("f" + token.lower()), xxhash.xxh3_64_intdigest("s" + shape(token))
        return i

    def of(self, tokens: list[str]) -> np.ndarray:
        """Hashes of distinct tokens."""
        if len(self) + len(tokens) > self.most:
            self.clear()
            if len(tokens) > self.most:
                self.most = 2 * len(tokens)
                self.hashes = np.zeros((self.most, 2), np.uint64)
        return self.hashes[np.fromiter(map(self.__getitem__, tokens), np.int64, len(tokens))]


def shape(token: str) -> str:
    """Runs of letters as C (capitals), T (title) or s (small), of digits as 9, and marks as they are; runs of one sign are one."""
    if token.isalpha() and token.islower():
        return "s"
    for pattern, sign in SHAPES:
        token = pattern.sub(sign, token)
    return AGAIN.sub(r"\1", token)


TERMS = Terms()


def terms(texts: pa.Array) -> tuple[Words, np.ndarray]:
    """Weight numbers of the four terms of every word: form, shape, and both paired with the next word's.

    The last word of a text has no pairs; theirs are number 0, which is the bias."""
    using("quality", TERMS.clear)
    words = words_of(texts)
    t = TERMS.of(words.tokens)[words.at]
    pairs = mix(t * np.uint64(0xD6E8FEB86659FD93) + np.roll(t, -1, 0))
    out = (np.concatenate([t, pairs], 1) % np.uint64(2**BITS - 1)).astype(np.int32) + 1
    last = words.first[1:][words.first[1:] > words.first[:-1]] - 1
    out[last, 2:] = 0
    return words, out


def vectors(texts: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """Weight numbers and values of every text; number 0 is the bias, with value 1."""
    words, t = terms(texts)
    out = []
    for a, b in itertools.pairwise(words.first.tolist()):
        at, n = np.unique(t[a:b], return_counts=True)
        n = SCALE * n[at > 0] / max(b - a, 1)
        out.append((np.concatenate([[0], at[at > 0]]).astype(np.int32), np.concatenate([[1.0], n]).astype(np.float32)))
    return out


class Ftrl:
    """FTRL-proximal with per-weight rates (McMahan et al., 2013)."""

    def __init__(self, alpha: float = 0.1, beta: float = 1.0, l1: float = 0.02, l2: float = 0.1) -> None:
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros(2**BITS), np.zeros(2**BITS)

    def weights(self, at: np.ndarray | slice) -> np.ndarray:
        z = self.z[at]
        return np.where(np.abs(z) <= self.l1, 0.0, -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(self.n[at])) / self.alpha + self.l2))

    def update(self, at: np.ndarray, x: np.ndarray, y: int) -> None:
        w = self.weights(at)
        g = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - y) * x
        s = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / self.alpha
        self.z[at] += g - s * w
        self.n[at] += g * g


@dataclass(frozen=True)
class Model:
    weights: np.ndarray

    def score(self, texts: pa.Array) -> np.ndarray:
        words, t = terms(texts)
        w = np.concatenate([[0.0], self.weights[1:]])
        dot = words.sums(w[t].sum(1)) * SCALE / np.maximum(np.diff(words.first), 1)
        return 1 / (1 + np.exp(-np.clip(self.weights[0] + dot, -35, 35)))


def fit(docs: DataFrame, labels: DataFrame, bound: int = 16_000, shards: int = 8, epochs: int = 2) -> Model:
    """Fit on at most `bound` labelled rows whose crc32(doc_id as text) mod 3 is not 1.

    Epochs after the first read the same rows again, so each shard holds its sparse vectors."""
    sample = labelled_sample(docs, labels, "quality", remainder(3) != 1, bound)
    rows = (
        sample.select(F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(shards)).cast("int").alias("shard"), F.xxhash64("doc_id").alias("at"), "label", "text")
        .repartitionById(shards, F.col("shard"))
        .sortWithinPartitions("shard", "at", "label", "text")
    )

    def train(batches):
        held: dict[int, list] = {}
        for part in (p for batch in batches for p in slices(batch)):
            for s, y, (at, x) in zip(part.column(0).to_pylist(), part.column(2).to_pylist(), vectors(part.column(3)), strict=True):
                held.setdefault(s, []).append((at, x, y))
        for s, docs in held.items():
            model = Ftrl()
            for _ in range(epochs):
                for at, x, y in docs:
                    model.update(at, x.astype(float), y)
            yield pa.RecordBatch.from_pydict({"shard": [s], "n": [len(docs)], "w": [model.weights(slice(None)).astype(np.float32).tobytes()]}, schema=pa.schema([("shard", pa.int32()), ("n", pa.int64()), ("w", pa.binary())]))

    found = sorted(rows.mapInArrow(train, "shard int, n long, w binary").collect())
    total = sum(r["n"] for r in found) or 1
    return Model(sum((np.frombuffer(r["w"], np.float32).astype(float) * r["n"] / total for r in found), np.zeros(2**BITS)))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted for every row."""
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64())])
    f = mapped(lambda b: [b.column(0), b.column(1), model.score(b.column(2))], schema)
    rows = docs.select(F.col("doc_id").cast("long"), (remainder(3) == 1).alias("held_out"), F.col("text").cast("string"))
    return rows.mapInArrow(f, "doc_id long, held_out boolean, score double").withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def keep_good(docs: DataFrame, model: Model) -> DataFrame:
    """The rows whose score is at least 0.5, with the columns they came with."""

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                yield part.filter(pa.array(model.score(part.column(part.schema.get_field_index("text"))) >= 0.5))

    return docs.mapInArrow(run, docs.schema)
