"""Toxicity: gradient-boosted trees over dense text features, with isotonic calibration.

The features of a whole text are lexicon counts and densities, second-person proximity, capitals,
punctuation and obfuscation rates. The lexicon is a short list of common insults joined with the words
that labelled rows show to be tied to the label, at most `most` of them (200). Lexicon, trees and calibration
are fitted on a bounded sample of labelled rows, of which only numbers and the lexicon reach the driver; an
eighth of the rows, chosen by a hash of the id, calibrate and take no part in the lexicon or the trees.

Defined results: a null text counts as empty; an empty text is scored from its (zero) features;
repeated rows get equal scores; without labels of both kinds the score is constant; extra columns
of the input are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeline.llm import boosting
from gaugeline.llm.common import Words, labelled_sample, letter_runs, mapped, remainder, slices, using, words_of

#: Insults and second-person words that stand at the start of the lexicon.
INSULTS = (
    "idiot idiots moron morons stupid dumb loser losers scum trash garbage pathetic worthless disgusting clown "
    "fool imbecile freak filth vermin pig bastard bitch asshole shit fuck fucking damn crap hate kill"
).split()
YOU = frozenset("you your yours yourself u ur du dich dir dein deine tu te toi ton ta vous votre tú ti tus usted".split())
LEET = str.maketrans("013457@$!", "oieastasi")
MIXED = re.compile(r"[0-9@$]+[^\W\d_]+(?:[0-9@$!*]+[^\W\d_]+)*|[^\W\d_]+(?:[0-9@$!*]+[^\W\d_]+)+")
MARK = re.compile(r"[^\w\s]")
RUN = re.compile(r"[!?*#$%&@]{2,}")
STRETCH = re.compile(r"([^\W\d_])\1\1")
N_FEATURES = 20
#: Columns of a token's counts.
WORDS, LETTER, UPPER, HIT, WEIGHT, YOUS, BANG, QUERY, MARKS, RUNS, MIX, HIDDEN, STRETCHED, SINGLE = range(14)


class Tokens(dict):
    """Token between white space -> row of `counts`, up to a bound; one per model and Python worker."""

    most = 400_000

    def __init__(self, lexicon: dict[str, float]) -> None:
        super().__init__()
        self.lexicon, self.counts, self.hits, self.fresh = lexicon, np.zeros((self.most, 14), np.float32), {}, []

    def __missing__(self, token: str) -> int:
        i = self[token] = len(self)
        low, lexicon = token.lower(), self.lexicon
        plain = token if token.isalpha() else token[:-1] if token[-1:] in ".,;:" and token[:-1].isalpha() else ""
        if plain and plain == low[: len(plain)].capitalize() or plain == low[: len(plain)] != "":
            word, n = low[: len(plain)], len(plain)
            if hit := word in lexicon:
                self.hits[i] = [word]
            self.fresh.append((1, n, plain is not word and plain[0].isupper(), hit, lexicon[word] if hit else 0, word in YOU, 0, 0, len(token) - n, 0, 0, 0, STRETCH.search(word) is not None, n == 1))
            return i
        words = letter_runs(low)
        if found := [w for w in words if w in lexicon]:
            self.hits[i] = found
        mixed = MIXED.findall(low)
        self.fresh.append((
            len(words), sum(map(len, words)), sum(map(str.isupper, token)), len(found), sum(lexicon[w] for w in found), sum(w in YOU for w in words),
            token.count("!"), token.count("?"), len(MARK.findall(token)), len(RUN.findall(token)),
            len(mixed), sum(w.translate(LEET) in lexicon or w.replace("*", "") in lexicon for w in mixed),
            STRETCH.search(low) is not None, len(words) == 1 and len(words[0]) == 1,
        ))
        return i

    def of(self, tokens: list[str]) -> np.ndarray:
        """Row numbers of distinct tokens; `counts` holds them all."""
        if len(self) + len(tokens) > self.most:
            self.clear()
            self.hits.clear()
            if len(tokens) > self.most:
                self.most = 2 * len(tokens)
                self.counts = np.zeros((self.most, 14), np.float32)
        at = np.fromiter(map(self.__getitem__, tokens), np.int64, len(tokens))
        if self.fresh:
            self.counts[len(self) - len(self.fresh) : len(self)] = self.fresh
            self.fresh.clear()
        return at


def spaced_out(words: Words, single: np.ndarray, lexicon: dict[str, float]) -> tuple[np.ndarray, np.ndarray]:
    """For every text, its runs of four or more one-letter tokens and how many of them spell a word of the lexicon."""
    runs, spelt = np.zeros(len(words.first) - 1), np.zeros(len(words.first) - 1)
    full = np.flatnonzero(single[:-3] * single[1:-2] * single[2:-1] * single[3:]) if len(single) > 3 else ()
    end = -1
    for i in map(int, full):
        text = int(np.searchsorted(words.first, i, "right")) - 1
        if i < end or i + 4 > words.first[text + 1]:
            continue
        end = i + 4
        while end < words.first[text + 1] and single[end]:
            end += 1
        runs[text] += 1
        spelt[text] += "".join(letter_runs("".join(words.tokens[k] for k in words.at[i:end]).lower())) in lexicon
    return runs, spelt


#: The last model's tokens, in each Python worker.
KNOWN: list[Tokens] = []


def features(texts: pa.Array, lexicon: dict[str, float]) -> np.ndarray:
    """A row of features for every text."""
    using("toxicity", KNOWN.clear)
    if not KNOWN or KNOWN[0].lexicon != lexicon:
        KNOWN[:] = [Tokens(lexicon)]
    known, words = KNOWN[0], words_of(texts)
    row = known.of(words.tokens)
    column = lambda k: known.counts[row, k][words.at]
    t = np.stack([words.sums(column(k)) for k in range(14)], 1)
    n, letters = np.maximum(t[:, WORDS], 1), np.maximum(t[:, LETTER], 1)
    size = np.maximum(np.nan_to_num(pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(float)), 1)
    names, top, near = np.zeros(len(t)), np.zeros(len(t)), np.zeros(len(t))
    hit, you = column(HIT), column(YOUS)
    for i in np.flatnonzero(t[:, HIT]):
        a, b = words.first[i], words.first[i + 1]
        hits = np.flatnonzero(hit[a:b])
        found = {w for k in set(words.at[a + hits].tolist()) for w in known.hits[row[k]]}
        names[i], top[i] = len(found), max(lexicon[w] for w in found)
        if t[i, YOUS]:
            spots = np.concatenate([[-(10**9)], np.flatnonzero(you[a:b]), [10**9]])
            after = np.searchsorted(spots, hits)
            near[i] = (np.minimum(hits - spots[after - 1], spots[after] - hits) <= 5).sum()
    runs, spelt = spaced_out(words, column(SINGLE), lexicon)
    return np.stack(
        [
            np.log1p(t[:, WORDS]), np.log1p(t[:, HIT]), t[:, HIT] / n, names, top,
            t[:, WEIGHT], t[:, WEIGHT] / n, t[:, WEIGHT] / np.sqrt(n), t[:, YOUS] / n, np.log1p(near), near / n,
            t[:, UPPER] / letters, t[:, BANG] / size, t[:, QUERY] / size, t[:, MARKS] / size, t[:, RUNS] / n,
            t[:, MIX] / n, t[:, HIDDEN] + spelt, runs / n, t[:, STRETCHED] / n,
        ],
        1,
    )


@dataclass(frozen=True)
class Model:
    lexicon: dict[str, float]
    trees: boosting.Trees
    centres: np.ndarray
    values: np.ndarray

    def score(self, texts: pa.Array) -> np.ndarray:
        return np.interp(self.trees.margin(features(texts, self.lexicon)), self.centres, self.values)


def learn_lexicon(sample: DataFrame, most: int = 200, support: int = 5) -> dict[str, float]:
    """Words of the sample whose presence raises the odds of the label, at most `most`, with their log odds."""
    words = sample.select("label", F.explode(F.array_distinct(F.split(F.lower(F.coalesce("text", F.lit(""))), r"[^\p{L}]+"))).alias("word")).where("word != ''")
    totals = sample.agg(F.sum("label").alias("a"), F.count(F.lit(1)).alias("n")).first()
    toxic, clean = (totals["a"] or 0), totals["n"] - (totals["a"] or 0)
    pos, neg = F.col("a") + 0.5, F.col("n") - F.col("a") + 0.5
    odds = F.log(pos / F.lit(toxic + 1.0)) - F.log(neg / F.lit(clean + 1.0))
    found = (
        words.groupBy("word")
        .agg(F.sum("label").alias("a"), F.count(F.lit(1)).alias("n"))
        .where(F.col("a") >= support)
        .select("word", odds.alias("odds"), (odds / F.sqrt(1 / pos + 1 / neg)).alias("z"))
        .where("odds >= 1.0 and z >= 4")
        .orderBy(F.desc("z"), "word")
        .limit(most)
        .collect()
    )
    return dict.fromkeys(INSULTS, 1.0) | {r["word"]: float(r["odds"]) for r in found}


def fit(docs: DataFrame, labels: DataFrame, bound: int = 12_000) -> Model:
    """Fit on at most `bound` labelled rows whose crc32(doc_id as text) mod 5 is not 0; an eighth of them calibrate."""
    sample = labelled_sample(docs, labels, "toxic", remainder(5) != 0, bound)
    calibrates = F.pmod(F.xxhash64("doc_id", F.lit(9)), F.lit(8)) == 3
    lexicon = learn_lexicon(sample.where(~calibrates))
    schema = pa.schema([("doc_id", pa.int64()), ("label", pa.int32()), ("x", pa.list_(pa.float64()))])
    f = mapped(lambda b: [b.column(0), b.column(1), pa.array(list(features(b.column(2), lexicon)), pa.list_(pa.float64()))], schema)
    rows = (
        sample.select(F.col("doc_id").cast("long"), "label", "text")
        .mapInArrow(f, "doc_id long, label int, x array<double>")
        .groupBy("doc_id")
        .agg(F.max("label").alias("label"), F.min("x").alias("x"))
        .withColumn("calibrates", calibrates)
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .collect()
    )
    x = np.array([r["x"] for r in rows], float).reshape(-1, N_FEATURES)
    y = np.array([r["label"] for r in rows], float)
    test = np.array([r["calibrates"] for r in rows], bool)
    trees = boosting.fit(x[~test], y[~test])
    return Model(lexicon, trees, *boosting.isotonic(trees.margin(x[test]), y[test]))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted for every row."""
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64())])
    f = mapped(lambda b: [b.column(0), b.column(1), model.score(b.column(2))], schema)
    rows = docs.select(F.col("doc_id").cast("long"), (remainder(5) == 0).alias("held_out"), F.col("text").cast("string"))
    return rows.mapInArrow(f, "doc_id long, held_out boolean, score double").withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def keep_clean(docs: DataFrame, model: Model) -> DataFrame:
    """The rows whose score is under 0.5, with the columns they came with."""

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                yield part.filter(pa.array(model.score(part.column(part.schema.get_field_index("text"))) < 0.5))

    return docs.mapInArrow(run, docs.schema)
