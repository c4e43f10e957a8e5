"""Periodic runs: stretches of words that repeat with a period, by seeds that are extended on diagonals.

A run of smallest period q has at least max(least, times q) words and no neighbouring word that keeps the
period. On the diagonal of lag q, the pairs of words q apart, it is a stretch of equal pairs of length - q, so
of max(least - q, (times - 1) q) at least. Lags are dealt to classes so that this overlap holds a k-gram that
is no shorter than the lag: the first class has the least overlap of all lags as its k, and each following
class doubles k and takes the lags from k/2 to k. Within a class,
1. the k-grams that occur twice or more in a document are indexed (a k-gram is named by the names of two
   shorter ones, and only places whose shorter ones occur twice are looked at, so names are exact);
2. each occurrence is paired with the next one of the same document if their lag is of the class. A run's
   k-grams cover its period, so inside it the next occurrence is exactly one period on: no other pairs are
   needed, and there are no more of them than words;
3. a pair is a seed that is extended to both sides on its diagonal, unless the table of the furthest place
   covered on each lag shows that an earlier extension went over it.
A stretch that is long enough is a run, and its lag the smallest period, since a smaller one would have put a
nearer occurrence between.

Every document is read once and no row leaves its task, so nothing is shuffled; what a task holds is a few
numbers a word of a slice of its rows (one text at least).

Defined results: a null or empty text has no words and no runs; rows that repeat get equal results; an empty
table gives no rows; extra columns are ignored by find_runs(), and collapsed() hands them on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeline.llm.common import mapped, slices, words_of

LEAST, TIMES = 24, 3


def lag_classes(longest: int, least: int = LEAST, times: int = TIMES) -> Iterator[tuple[int, int]]:
    """(k, least lag) of every class that a text of `longest` words needs; its lags go to k."""
    if least < 1 or times < 3:
        raise ValueError("a run has at least one word and three periods")
    k, lag = min(max(least - q, (times - 1) * q) for q in range(1, least + 1)), 1
    while times * lag <= longest:
        yield k, lag
        k, lag = 2 * k, k + 1


class Grams:
    """The places of grams that occur twice or more in one document, and the name of the gram at each place.

    `end` is the end of the document of every place."""

    def __init__(self, document: np.ndarray, words: np.ndarray, end: np.ndarray) -> None:
        self.end, self.k = end, 1
        self.name = np.full(len(words), -1, np.int64)
        self._index(np.arange(len(words)), document * (int(words.max(initial=0)) + 1) + words)

    def _index(self, places: np.ndarray, keys: np.ndarray) -> None:
        order = np.argsort(keys, kind="stable")
        keys, self.places = keys[order], places[order]
        new = np.ones(len(keys), bool)
        new[1:] = keys[1:] != keys[:-1]
        again = ~new | ~np.append(new[1:], True)[: len(new)]
        self.places, names = self.places[again], np.cumsum(new)[again]
        self.name[places] = -1
        self.name[self.places] = names

    def lengthen(self, k: int) -> None:
        """Goes on to grams of k words, of twice the present length at most."""
        shift, places = k - self.k, np.sort(self.places)
        places = places[places + k <= self.end[places]]
        places = places[self.name[places + shift] >= 0]
        keys = self.name[places] * (int(self.name.max(initial=0)) + 1) + self.name[places + shift]
        self.name[self.places] = -1
        self._index(places, keys)
        self.k = k

    def pairs(self, least: int) -> tuple[np.ndarray, np.ndarray]:
        """(place, lag) of occurrences whose next one in the document is from `least` to k words on, by lag and place."""
        here, lag = self.places[:-1], np.diff(self.places)
        seed = (self.name[here] == self.name[self.places[1:]]) & (lag >= least) & (lag <= self.k)
        here, lag = here[seed], lag[seed]
        order = np.lexsort((here, lag))
        return here[order], lag[order]


def equal_for(words: np.ndarray, at: int, lag: int, stop: int, step: int) -> int:
    """How many pairs (x, x + lag) are equal from `at` on, up to `stop`, forwards (step 1) or backwards (-1)."""
    done, chunk, most = 0, 64, (stop - at) * step
    while done < most:
        n = min(chunk, most - done)
        x = np.arange(done, done + n) * step + at
        bad = np.flatnonzero(words[x] != words[x + lag])
        if len(bad):
            return done + int(bad[0])
        done, chunk = done + n, chunk * 4
    return done


def runs_of(words: np.ndarray, first: np.ndarray, least: int = LEAST, times: int = TIMES) -> list[tuple[int, int, int, int]]:
    """(document, start, length, period) of every run, in that order without the length; document i has the
    words from first[i] to first[i + 1], and start counts from the document's first word."""
    lengths = np.diff(first)
    document = np.repeat(np.arange(len(lengths)), lengths)
    start, end = first[:-1][document], first[1:][document]
    grams, found = Grams(document, words, end), []
    for k, lag_from in lag_classes(int(lengths.max(initial=0)), least, times):
        while grams.k < k and len(grams.places):
            grams.lengthen(min(2 * grams.k, k))
        if not len(grams.places):
            break
        covered: dict[int, int] = {}
        places, lags = grams.pairs(lag_from)
        follows = np.zeros(len(places), bool)  # the pair before is on the same diagonal, one word back
        follows[1:] = (places[1:] == places[:-1] + 1) & (lags[1:] == lags[:-1])
        for i, q in zip(places[~follows].tolist(), lags[~follows].tolist(), strict=True):
            if i < covered.get(q, 0):
                continue
            to = i + k + equal_for(words, i + k, q, int(end[i]) - q, 1)
            at = i - equal_for(words, i - 1, q, int(start[i]) - 1, -1)
            covered[q] = to
            if to - at + q >= max(least, times * q):
                found.append((int(document[i]), at - int(start[i]), to - at + q, q))
    return sorted(found, key=lambda r: (r[0], r[1], r[3]))


def repeats(first: np.ndarray, runs: list[tuple[int, int, int, int]]) -> np.ndarray:
    """For every word whether it stands in a run, after the run's first period."""
    change = np.zeros(int(first[-1]) + 1, np.int64)
    for document, start, length, period in runs:
        change[first[document] + start + period] += 1
        change[first[document] + start + length] -= 1
    return np.cumsum(change)[:-1] > 0


RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def _found(texts: pa.Array, least: int, times: int) -> tuple[pa.Array, pa.Array, pa.Array]:
    """Of every text the number of words, the runs and the text without its repeats."""
    words = words_of(texts)
    first = np.asarray(words.first, np.int64)
    runs = runs_of(np.asarray(words.at, np.int64), first, least, times)
    table = np.array(runs, np.int64).reshape(-1, 4)
    bounds = np.searchsorted(table[:, 0], np.arange(len(first)))
    listed = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.StructArray.from_arrays([pa.array(table[:, c]) for c in (1, 2, 3)], fields=list(RUN)))
    keep = ~repeats(first, runs)
    kept = np.concatenate([[0], np.cumsum(keep)])[first]
    left = pa.array(words.tokens, pa.string()).take(pa.array(np.asarray(words.at)[keep], pa.int64()))
    text = pc.binary_join(pa.ListArray.from_arrays(pa.array(kept, pa.int32()), left), " ")
    return pa.array(np.diff(first), pa.int64()), listed, text


def find_runs(docs: DataFrame, least: int = LEAST, times: int = TIMES) -> DataFrame:
    """(doc_id, n_words, runs, collapsed) of every row: runs is an array of (start, length, period) by start, then
    period; collapsed is the text's words without those that only repeat a run's first period, one space between."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("runs", pa.list_(RUN)), ("collapsed", pa.string())])
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    run = mapped(lambda part: [part.column(0), *_found(part.column(1), least, times)], schema)
    return rows.mapInArrow(run, "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string")


def collapsed(docs: DataFrame, least: int = LEAST, times: int = TIMES) -> DataFrame:
    """The rows with their columns; texts that hold a run are replaced by their collapsed form, others stay as they are."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (p for b in batches for p in slices(b)):
            texts = part.column(at)
            _, runs, fresh = _found(texts.cast(pa.string()), least, times)
            columns = list(part.columns)
            columns[at] = pc.if_else(pc.greater(pc.list_value_length(runs), 0), fresh.cast(texts.type), texts)
            yield pa.RecordBatch.from_arrays(columns, names=part.schema.names)

    return docs.mapInArrow(run, docs.schema)


def digest(found: DataFrame) -> DataFrame:
    """doc_id, n_runs, the strongest run and hashes of the runs and of the collapsed text.

    The strongest run has the greatest length / period, of equal ones the least start, then period. The
    quotients of whole numbers below 2^26 are compared exactly as doubles."""
    best = F.array_min(F.transform("runs", lambda r: F.struct((-(r["length"] / r["period"])).alias("e"), r["start"].alias("start"), r["period"].alias("period"), r["length"].alias("length"))))
    lines = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    rows = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("b"), F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    return rows.select(
        "doc_id", "n_runs", F.col("b.start").alias("start"), F.col("b.length").alias("length"), F.col("b.period").alias("period"),
        F.expr("(1000 * b.length) div b.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256",
    )


def _crc(column: str) -> Column:
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary"))


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, text) in which the texts of one id in ten are made periodic from some word on, by the id's crc32.

    A null id counts as the empty text, whose crc32 is 0."""
    h = _crc("doc_id")
    words = F.filter(F.split(F.col("text").cast("string"), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.floor(h / 10).alias("g"), F.when(h % 10 == 0, words).alias("w"))
    rows = rows.withColumn("n", F.size("w")).withColumn("a", F.when(F.col("n") > 0, F.expr("cast(g % n as int)")))
    rows = rows.withColumn("p", F.when(F.col("n") > 0, F.expr("cast(1 + (n - a) div (3 + g % 8) as int)")))
    periodic = F.expr("array_join(transform(sequence(0, n - 1), i -> w[if(i < a, i, a + (i - a) % p)]), ' ')")
    return rows.select("doc_id", F.when(F.col("n") > 0, periodic).otherwise(F.col("text")).alias("text"))
