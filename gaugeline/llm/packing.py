"""Pattern packing of token sequences by non-negative least squares.

Documents are tokenized and cut into pieces of at most `size` tokens. Everything that decides the
packing is done on the histogram of piece lengths, which has at most `size` entries at any scale:
patterns of one to three length classes that nearly fill a sequence are enumerated, their repeat
counts are fitted to the histogram by non-negative least squares and rounded, the documents of a
pattern are drawn from its classes, and what is left is packed best-fit, longest first, into the
room that patterns leave and then into new sequences. This is done for a few class widths, and the
plan with the fewest sequences is taken.

The plan is a table of intervals: ranks a to b of the pieces of one length go to sequences from s, at
offset o. It is all that is sent to tasks, and the histogram bounds it: it has at most three intervals a pattern
(of which there are some (size / width)^2 / 6) and a few a length, however many pieces there are. A piece's rank among those of its length comes from a window over (length, salt) of about `group` rows, so
that a length that holds a third of the pieces is ranked in as many tasks as it needs.

Defined results: a null text counts as empty, and an empty text is the end token alone; rows that
repeat a doc_id are packed each for itself; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import itertools
import os
import re
import zlib
from collections import defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gaugeline.llm.common import hold, mapped, using, words_of

#: A word of Latin letters, then at most one run of marks: each is one word to the tokenizer.
SIMPLE = re.compile("([A-Za-zÀ-ÖØ-öø-įı-ſ]+)([!-&(-/:;=?@*#$%^~|]*)")


class Encoder:
    """The tokenizer's ids of whole texts, by way of their distinct words between white space.

    The tokenizer's own words never cross white space, so a text's ids are those of its words in order.
    A simple word's ids are those of its small letters and of its marks, kept in `parts` (at most
    `most` of them); new parts are encoded many at a time and told apart by the ids that end a word.
    All other words go to the tokenizer as they are."""

    most = 700_000

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.path, self.tokenizer, self.parts = path, Tokenizer.from_file(path), {"": b""}
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def learn(self, new: list[str]) -> None:
        for at in range(0, len(new), 64):
            part = new[at : at + 64]
            ids = np.array(self.tokenizer.encode(" ".join(part), add_special_tokens=False).ids, "<u4")
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) == len(part):
                self.parts.update(zip(part, (ids[a:b].tobytes() for a, b in itertools.pairwise([0, *cuts.tolist()])), strict=True))
            else:
                self.parts.update((t, self.whole(t)) for t in part)

    def of(self, tokens: list[str]) -> list[bytes]:
        """Each token's ids as little-endian bytes."""
        parts, match = self.parts, SIMPLE.fullmatch
        out = list(map(parts.get, tokens))
        pairs = {i: (m[1].lower(), m[2]) if (m := match(tokens[i])) else None for i, x in enumerate(out) if x is None}
        new = {x for p in pairs.values() if p for x in p} - parts.keys()
        if len(parts) + len(new) > self.most:
            new |= {x for p in pairs.values() if p for x in p}
            self.parts = parts = {"": b""}
        self.learn(list(new))
        for i, p in pairs.items():
            out[i] = self.whole(tokens[i]) if p is None else parts[p[0]] + parts[p[1]]
        return out

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids in order, and where each text's begin (one more entry than texts)."""
        words = words_of(texts)
        each = self.of(words.tokens)
        size = np.fromiter(map(len, each), np.int64, len(each)) // 4
        start, flat = np.cumsum(size) - size, np.frombuffer(b"".join(each), "<u4")
        n = size[words.at]
        end = np.cumsum(n)
        ids = flat[np.repeat(start[words.at] - end + n, n) + np.arange(n.sum())]
        return ids, np.concatenate([[0], end])[words.first]


ENCODERS: list[Encoder] = []


def encoder(path: str) -> Encoder:
    using("packing", ENCODERS.clear)
    if not ENCODERS or ENCODERS[0].path != path:
        ENCODERS[:] = [Encoder(path)]
    return ENCODERS[0]


def pieces(docs: DataFrame, tokenizer: str, size: int = 4096, end: int = 1, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) of every document: its ids and the end token, cut every `size`."""
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.list_(pa.int64()))][: 5 + with_ids])
    tail = np.array([end], "<u4")

    def run(part: pa.RecordBatch) -> list:
        ids, first = encoder(tokenizer).encode(part.column(1))
        out: list[tuple] = []
        for doc, a, b in zip(part.column(0).to_pylist(), first[:-1].tolist(), first[1:].tolist(), strict=True):
            whole = np.concatenate([ids[a:b], tail])
            for k in range(0, len(whole), size):
                cut = whole[k : k + size]
                out.append((doc, k // size, k, len(cut), zlib.crc32(cut), *([cut.astype(np.int64)] * with_ids)))
        return [pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)]

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(mapped(run, schema), "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<long>" * with_ids)


def patterns(classes: np.ndarray, units: int, slack: int = 1) -> np.ndarray:
    """Multisets of one to three classes whose sizes add up to units - slack .. units; rows padded with -1."""
    at, known = {int(c): i for i, c in enumerate(classes)}, classes.tolist()
    rows = [(at[c], -1, -1) for c in known if units - slack <= c <= units]
    for total in range(units - slack, units + 1):
        rows += [(at[a], at[total - a], -1) for a in known if 2 * a <= total and total - a in at]
        rows += [(at[a], at[b], at[total - a - b]) for a, b in itertools.combinations_with_replacement(known, 2) if a + 2 * b <= total and total - a - b in at]
    return np.array(rows, np.int64).reshape(-1, 3)


def nnls(p: np.ndarray, want: np.ndarray, steps: int = 300) -> np.ndarray:
    """Non-negative x that fits sum of x over the patterns of a class to `want`, by accelerated projected gradients."""
    n = len(want)
    times = lambda x: np.bincount(p.ravel() + 1, np.repeat(x, 3), n + 1)[1:]
    back = lambda r: np.concatenate([[0.0], r])[p + 1].sum(1)
    v = np.ones(len(p))
    for _ in range(12):
        v = back(times(v))
        bound = np.linalg.norm(v)
        v /= bound
    x = y = np.zeros(len(p))
    t = 1.0
    for _ in range(steps):
        new = np.maximum(y - back(times(y) - want) / (1.05 * bound), 0)
        s = (1 + np.sqrt(1 + 4 * t * t)) / 2
        x, y, t = new, new + (t - 1) / s * (new - x), s
    return x


@dataclass
class Bin:
    """`count` sequences alike: runs of (length, how many), and the room left in each."""

    items: list[tuple[int, int]]
    count: int
    room: int


def from_patterns(hist: dict[int, int], size: int, width: int) -> list[Bin]:
    """Sequences of fitted patterns; what they take is removed from hist."""
    by_class: dict[int, list[int]] = defaultdict(list)
    for length in sorted(hist, reverse=True):
        by_class[-(-length // width)].append(length)
    classes = np.array(sorted(by_class), np.int64)
    p = patterns(classes, size // width)
    if not len(p):
        return []
    left = np.array([sum(hist[x] for x in by_class[int(c)]) for c in classes])
    x = nnls(p, left.astype(float))
    bins: list[Bin] = []
    for k in np.argsort(-x, kind="stable").tolist():
        if x[k] < 0.5:
            break
        need = defaultdict(int)
        for c in p[k][p[k] >= 0].tolist():
            need[c] += 1
        repeat = min(int(np.rint(x[k])), *(int(left[c]) // m for c, m in need.items()))
        for c, m in need.items():
            left[c] -= repeat * m
        while repeat > 0:
            items, times = [], repeat
            for c, m in need.items():
                lengths = by_class[int(classes[c])]
                while not hist[lengths[0]]:
                    lengths.pop(0)
                if hist[lengths[0]] >= m:
                    items.append((lengths[0], m))
                    times = min(times, hist[lengths[0]] // m)
                else:  # the run of the longest ends within one sequence
                    times, rest = 1, m
                    for length in lengths:
                        if n := min(rest, hist[length]):
                            items.append((length, n))
                            rest -= n
            for length, m in items:
                hist[length] -= m * times
            bins.append(Bin(items, times, size - sum(a * b for a, b in items)))
            repeat -= times
    return bins


def best_fit(hist: dict[int, int], size: int, bins: list[Bin]) -> list[Bin]:
    """Packs what hist still holds, longest first, each into the sequence with the least sufficient room."""
    by_room: dict[int, list[Bin]] = defaultdict(list)
    for b in bins:
        by_room[b.room].append(b)
    rooms = np.zeros(size + 1, bool)
    rooms[list(by_room)] = True
    done: list[Bin] = []
    for length in sorted((x for x, n in hist.items() if n), reverse=True):
        n = hist[length]
        while n:
            fits = length + int(np.argmax(rooms[length:])) if rooms[length:].any() else 0
            if not fits:
                b = Bin([], -(-n // (size // length)), size)
            else:
                b = by_room[fits].pop()
                rooms[fits] = bool(by_room[fits])
            each = min(b.room // length, max(1, n // b.count))
            count = min(b.count, n // each)
            if count < b.count:
                rest = Bin(list(b.items), b.count - count, b.room)
                if rest.items:
                    by_room[rest.room].append(rest)
                    rooms[rest.room] = True
            b = Bin([*b.items, (length, each)], count, b.room - each * length)
            n -= each * count
            by_room[b.room].append(b)
            rooms[b.room] = True
        hist[length] = 0
    return done + [b for x in by_room.values() for b in x]


@dataclass(frozen=True)
class Plan:
    """Intervals of ranks among the pieces of a length, in order of (length, first rank)."""

    base: np.ndarray  # first global rank of each length
    first: np.ndarray  # first global rank of each interval
    sequence: np.ndarray
    repeat: np.ndarray
    offset: np.ndarray
    length: np.ndarray
    sequences: int

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = self.base[length] + rank
        i = np.searchsorted(self.first, at, "right") - 1
        turn, seq = np.divmod(at - self.first[i], self.repeat[i])
        return self.sequence[i] + seq, self.offset[i] + turn * self.length[i]


def plan(hist: dict[int, int], size: int, widths: tuple[int, ...] = (4, 8, 16, 32)) -> Plan:
    tried = []
    for width in widths:
        left = dict(hist)
        bins = from_patterns(left, size, width)
        tried.append(best_fit(left, size, bins))
    bins = min(tried, key=lambda b: sum(x.count for x in b), default=[])
    used, rows, sequences = defaultdict(int), [], 0
    for b in bins:
        offset = 0
        for length, m in b.items:
            rows.append((length, used[length], sequences, b.count, offset))
            used[length] += b.count * m
            offset += length * m
        sequences += b.count
    r = np.array(sorted(rows), np.int64).reshape(-1, 5)
    counts = np.zeros(size + 2, np.int64)
    for length, n in used.items():
        counts[length + 1] = n
    base = counts.cumsum()
    return Plan(base, base[r[:, 0]] + r[:, 1], r[:, 2], r[:, 3], r[:, 4], r[:, 0], sequences)


def pack(rows: DataFrame, size: int = 4096, group: int = 200_000) -> DataFrame:
    """Adds sequence_id and offset to rows with doc_id, piece and length (1 to size)."""
    columns = rows.columns
    rows = hold(rows)
    lengths = rows.groupBy("length").agg(F.count(F.lit(1)).alias("n"))  # at most `size` rows
    made = plan({r["length"]: r["n"] for r in lengths.collect()}, size)
    salts = lengths.select("length", F.ceil(F.col("n") / F.lit(group)).alias("_salts"))
    salted = rows.join(F.broadcast(salts), "length").withColumn("_salt", F.pmod(F.xxhash64(*(c for c in columns if c != "ids")), F.col("_salts")))
    counts = salted.groupBy("length", "_salt").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("length", "_salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before"))
    within = F.row_number().over(Window.partitionBy("length", "_salt").orderBy("doc_id", "piece"))
    # both sides are dealt by length and salt; a row a group is what `starts` has
    ranked = salted.withColumn("_rank", within).join(starts, ["length", "_salt"])
    ranked = ranked.select(*columns, (F.col("_rank") - 1 + F.col("_before")).alias("_rank"))

    def run(batches):
        for b in batches:
            seq, offset = made.place(np.array(b.column(b.schema.get_field_index("length"))), np.array(b.column(b.num_columns - 1)))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(seq), pa.array(offset)], names=[*b.schema.names[:-1], "sequence_id", "offset"])

    kinds = ", ".join(f"`{n}` {t}" for n, t in ranked.dtypes[:-1])
    return ranked.mapInArrow(run, f"{kinds}, sequence_id long, offset long")
