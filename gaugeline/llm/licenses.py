"""License scans: rolling word k-grams vote for the diagonals on which a template lies in a text.

Words are runs of letters, digits and all signs beyond U+007F, with A-Z small. Templates are phrases, which are
found only where their words stand consecutively, and notices, which are found where at most `differ` of their
words have to be put in, left out or changed.

1. Every run of GRAM words of every text, as a 64-bit hash with its place, is joined by Spark with the runs of
   the templates. A match votes for a diagonal: its place in the text less its place in the template.
2. Votes are aggregated by text, template and diagonal as bit masks of the template's places, so a place of
   the template counts once and copies of a text count as one text before anything is shuffled.
3. Diagonals of a notice that are no further apart than its words may differ are merged, since words put in
   or left out shift what follows. A notice of n words with e differing ones keeps n - GRAM + 1 - GRAM e of
   its runs at least, so candidates with fewer votes cannot be one. Diagonals of phrases stay apart and need
   every vote.
4. Candidates are verified on the words themselves: phrases word by word, notices by the edit distance to
   the best stretch of the window that their diagonals span, and again to the left and right of that stretch.
   Of notices that overlap, the most similar one stays, of equal ones the longer, then the earlier.

Only texts that a bitmap of the candidates' texts lets through are shuffled to meet them, once for each task.
The templates' runs are what is broadcast; their number is that of the templates' words.

Defined results: a null text counts as empty, and texts without words have no places; rows that repeat get
equal results; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gaugeline.llm.common import HASHES, Words, chain, hold, mapped, slices, using, words_of
from gaugeline.llm.license_texts import NOTICES, PHRASES
from gaugeline.llm.pii import bitmap

GRAM, DIFFER = 3, 0.2
#: A-Z become small; what is neither a letter, a digit nor beyond U+007F becomes a space.
SIGNS = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c > 0x7F else 0x20 for c in range(256))


def scan_words(texts: pa.Array) -> Words:
    """The words of every text; nulls have none."""
    texts = pc.fill_null(texts.cast(pa.string()), "")
    if texts.offset:
        texts = pa.concat_arrays([texts])
    valid, offsets, data = texts.buffers()
    plain = pa.Array.from_buffers(pa.string(), len(texts), [valid, offsets, pa.py_buffer(data.to_pybytes().translate(SIGNS)) if data else data])
    return words_of(plain)


def words_in(text: str) -> list[str]:
    return [w.decode() for w in text.encode().translate(SIGNS).split()]


def grams_of(words: Words) -> np.ndarray:
    """The hash of the GRAM words from every place on; the last places of a text have those of no use."""
    using("hashes", HASHES.clear)
    h = HASHES.of(words.tokens)[words.at]
    return chain([h[i : len(h) - GRAM + 1 + i] for i in range(GRAM)]).view(np.int64) if len(h) >= GRAM else np.zeros(0, np.int64)


@dataclass(frozen=True)
class Template:
    label: str
    words: tuple[str, ...]
    exact: bool

    @property
    def edits(self) -> int:
        """How many words may differ."""
        return 0 if self.exact else int(DIFFER * len(self.words))

    @property
    def grams(self) -> int:
        return len(self.words) - GRAM + 1

    @property
    def votes(self) -> int:
        """The fewest votes of a place."""
        return max(1, self.grams - GRAM * self.edits)


def templates_of(phrases: Sequence[tuple[str, str]] = PHRASES, notices: Sequence[tuple[str, str]] = NOTICES) -> list[Template]:
    made = [Template(label, tuple(words_in(text)), exact) for exact, given in ((True, phrases), (False, notices)) for label, text in given]
    if any(t.grams < 1 for t in made):
        raise ValueError(f"a template has {GRAM} words at least")
    return made


def template_grams(spark: SparkSession, templates: list[Template]) -> DataFrame:
    """(gram, template, at): the templates' runs of words, with the number of the template and the place in it."""
    rows = []
    for n, t in enumerate(templates):
        words = scan_words(pa.array([" ".join(t.words)]))
        rows += [(int(g), n, at) for at, g in enumerate(grams_of(words))]
    return spark.createDataFrame(rows, "gram long, template int, at int")


def votes(docs: DataFrame, templates: list[Template]) -> DataFrame:
    """(text_hash, template, diagonal, mask_0, mask_1 ..): for every diagonal the places of the template that voted."""
    schema = pa.schema([("text_hash", pa.string()), ("grams", pa.list_(pa.int64()))])

    def cut(part: pa.RecordBatch) -> list:
        words = scan_words(part.column(0))
        grams, size = grams_of(words), np.diff(words.first)
        last = np.repeat(np.asarray(words.first[1:]), size)  # the end of the text of every word
        whole = (np.arange(len(last)) + GRAM <= last)[: len(grams)]
        offsets = np.concatenate([[0], np.cumsum(np.maximum(size - GRAM + 1, 0))])
        return [hashes_of(part.column(0)), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(grams[whole]))]

    places = docs.select(F.col("text").cast("string")).mapInArrow(mapped(cut, schema), "text_hash string, grams array<long>")
    places = places.select("text_hash", F.posexplode("grams").alias("place", "gram"))
    met = places.join(F.broadcast(template_grams(docs.sparkSession, templates)), "gram")
    segments = 1 + max(t.grams - 1 for t in templates) // 64
    bit = F.expr("shiftleft(1L, at % 64)")
    masks = [F.coalesce(F.bit_or(F.when(F.floor(F.col("at") / 64) == s, bit)), F.lit(0)).alias(f"mask_{s}") for s in range(segments)]
    return met.groupBy("text_hash", "template", (F.col("place") - F.col("at")).alias("diagonal")).agg(*masks)


def candidates(voted: DataFrame, templates: list[Template]) -> DataFrame:
    """(text_hash, template, low, high): neighbouring diagonals with enough votes, from the least to the largest."""
    masks = [c for c in voted.columns if c.startswith("mask_")]
    bounds = voted.sparkSession.createDataFrame([(n, t.edits, t.votes) for n, t in enumerate(templates)], "template int, edits int, least int")
    in_turn = Window.partitionBy("text_hash", "template").orderBy("diagonal")
    rows = voted.join(F.broadcast(bounds), "template")  # a row a template
    apart = F.col("diagonal") - F.lag("diagonal").over(in_turn) > F.col("edits")
    rows = rows.withColumn("apart", F.coalesce(apart.cast("int"), F.lit(0)))
    rows = rows.withColumn("group", F.sum("apart").over(in_turn))
    merged = rows.groupBy("text_hash", "template", "group").agg(
        F.min("diagonal").alias("low"), F.max("diagonal").alias("high"), F.first("least").alias("least"), *(F.bit_or(m).alias(m) for m in masks)
    )
    counted = sum((F.bit_count(m) for m in masks), F.lit(0))
    return merged.where(counted >= F.col("least")).select("text_hash", "template", "low", "high")


def distances(template: np.ndarray, window: np.ndarray, anchored: bool) -> np.ndarray:
    """For every j the least number of edits between the template and a stretch of the window that ends at j;
    `anchored`: the stretch from the window's start."""
    steps = np.arange(len(window) + 1)
    row = steps.copy() if anchored else np.zeros_like(steps)
    for word in template:
        fresh = row + 1
        np.minimum(fresh[1:], row[:-1] + (window != word), out=fresh[1:])
        row = np.minimum.accumulate(fresh - steps) + steps
    return row


def best_stretches(template: np.ndarray, window: np.ndarray, edits: int, offset: int = 0) -> Iterator[tuple[int, int, int]]:
    """(start, end, distance) of the stretch nearest to the template, and of those to its left and right."""
    if len(window) < len(template) - edits:
        return
    row = distances(template, window, False)
    end = int(row.argmin())
    if row[end] > edits:
        return
    start = end - int(distances(template[::-1], window[:end][::-1], True).argmin())
    yield offset + start, offset + end, int(row[end])
    yield from best_stretches(template, window[:start], edits, offset)
    yield from best_stretches(template, window[end:], edits, offset + end)


def verified(words: list[str], found: list[dict], templates: list[Template]) -> list[dict]:
    """The places (label, start, length, similarity, base) of one text's candidates, in order."""
    number: dict[str, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words])
    places, notices = [], set()
    for c in found:
        t, n = templates[c["template"]], len(templates[c["template"]].words)
        if t.exact:
            if tuple(words[c["low"] : c["low"] + n]) == t.words:
                places.append({"label": t.label, "start": c["low"], "length": n, "similarity": 1.0, "base": True})
            continue
        low, high = max(0, c["low"] - t.edits), c["high"] + n + t.edits
        template = np.array([number.get(w, -1) for w in t.words])
        notices |= {(-(1 - d / n), -n, a, b, t.label) for a, b, d in best_stretches(template, ids[low:high], t.edits, low)}
    taken: list[tuple[int, int]] = []
    for similarity, _, a, b, label in sorted(notices):
        if all(b <= x or y <= a for x, y in taken):
            taken.append((a, b))
            places.append({"label": label, "start": a, "length": b - a, "similarity": -similarity, "base": False})
    return sorted(places, key=lambda p: (p["start"], p["label"], p["length"]))


def hashes_of(texts: pa.Array) -> pa.Array:
    return pa.array([xxhash.xxh3_128_hexdigest(t or "") for t in texts.to_pylist()], pa.string())


PLACE = pa.struct([("label", pa.string()), ("start", pa.int64()), ("length", pa.int64()), ("similarity", pa.float64()), ("base", pa.bool_())])


def scan(docs: DataFrame, phrases: Sequence[tuple[str, str]] = PHRASES, notices: Sequence[tuple[str, str]] = NOTICES) -> DataFrame:
    """(doc_id, n_words, places) of every row; places is an array of (label, start, length, similarity, base), null
    where there is none; start counts words from 0, base is true for phrases."""
    templates = templates_of(phrases, notices)
    found = candidates(votes(docs, templates), templates)
    found = hold(found.groupBy("text_hash").agg(F.collect_list(F.struct("template", "low", "high")).alias("found")))  # of one text
    wanted = bitmap(found.select("text_hash"), found.count())
    text_schema = pa.schema([("text_hash", pa.string()), ("text", pa.string())])
    place_schema = pa.schema([("text_hash", pa.string()), ("places", pa.list_(PLACE))])
    row_schema = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.string()), ("n_words", pa.int64())])

    def wanted_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[str] = set()
        for part in (p for b in batches for p in slices(b)):
            hashes = hashes_of(part.column(0))
            here = wanted.has(np.fromiter(map(xxhash.xxh3_64_intdigest, hashes.to_pylist()), np.uint64, len(hashes)))
            fresh = []
            for h, x in zip(hashes.to_pylist(), here.tolist(), strict=True):
                fresh.append(x and h not in seen)
                if x:
                    seen.add(h)
            if len(seen) > 100_000:
                seen.clear()
            keep = pa.array(fresh, pa.bool_())
            yield pa.RecordBatch.from_arrays([hashes.filter(keep), part.column(0).filter(keep)], schema=text_schema)

    def verify(part: pa.RecordBatch) -> list:
        out = [verified(words_in(t or ""), c, templates) for t, c in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True)]
        return [part.column(0), pa.array(out, pa.list_(PLACE))]

    texts = docs.select(F.col("text").cast("string")).mapInArrow(wanted_texts, "text_hash string, text string")
    kind = "array<struct<label: string, start: long, length: long, similarity: double, base: boolean>>"
    places = texts.join(found, "text_hash").select("text_hash", "text", "found").mapInArrow(mapped(verify, place_schema), f"text_hash string, places {kind}")
    places = places.where(F.size("places") > 0).dropDuplicates(["text_hash"])
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    count = mapped(lambda p: [p.column(0), hashes_of(p.column(1)), pa.array(np.diff(scan_words(p.column(1)).first))], row_schema)
    return rows.mapInArrow(count, "doc_id long, text_hash string, n_words long").join(places, "text_hash", "left").select("doc_id", "n_words", "places")


def digest(scanned: DataFrame) -> DataFrame:
    """doc_id, n_words, the number of phrases' places with the first and last, labels, and the largest similarity."""
    places = F.coalesce("places", F.array().cast(scanned.schema["places"].dataType))
    base = F.filter(places, lambda p: p["base"])
    starts = F.transform(base, lambda p: p["start"])
    names = lambda c: F.array_join(F.array_sort(F.array_distinct(F.transform(c, lambda p: p["label"]))), ",")
    return scanned.select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        names(base).alias("base_labels"), names(places).alias("labels"), F.coalesce(F.array_max(F.transform(places, lambda p: p["similarity"])), F.lit(0.0)).alias("score"),
    )
