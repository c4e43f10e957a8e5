"""SentencePiece encoding and decoding by suffix-array matching.

The vocabulary (pieces and scores) is read from a byte-pair model of public form; nothing is trained.
A batch's texts are cut where no piece has the two characters side by side, so no merge can cross a
cut, and only distinct stretches that are not known yet are encoded. Their concatenation is indexed by
a suffix array (prefix doubling, as deep as the longest piece); a binary search over it gives every
piece's range of occurrences at once; the occurrences are edges, sorted by their end, and relaxed from
left to right: an edge is taken when the piece before it and its own piece are the merge result of
their two texts, which for byte-pair merges holds for exactly one edge at every position. Characters
outside the vocabulary are edges of their bytes.

Runs of spaces, in which pieces of equal score compete, are merged pair by pair with a queue instead.

Defined results: a null text counts as empty and has no pieces; every row gets a result, repeated rows
equal ones; decoding gives the text back but for U+2581, which the model cannot tell from a space;
extra columns are ignored.
"""

from __future__ import annotations

import heapq
import itertools
import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeline.llm.common import mapped, using

SPACE = "▁"
RUN = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")
UNKNOWN = -1


class Codec:
    """The vocabulary and what a Python worker has learned; `known` holds at most `most` stretches."""

    most = 500_000

    def __init__(self, path: str) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.path, size = path, model.get_piece_size()
        plain = [i for i in range(size) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        self.text = {i: model.id_to_piece(i) for i in plain}
        self.number = {t: i for i, t in self.text.items()}
        self.score = {t: model.get_score(i) for t, i in self.number.items()}
        self.byte = {int(model.id_to_piece(i)[3:5], 16): i for i in range(size) if model.is_byte(i)}
        raw = [self.text[i].replace(SPACE, " ").encode() if i in self.text else b"" for i in range(size)]
        for b, i in self.byte.items():
            raw[i] = bytes([b])
        self.raw = pa.array(raw, pa.binary())
        self.ids = np.array(plain)
        self.length = np.array([len(self.text[i]) for i in plain])
        self.longest = int(self.length.max(initial=1))
        self.codes = np.zeros((len(plain), self.longest), np.int64)
        for row, i in enumerate(plain):
            self.codes[row, : len(self.text[i])] = [ord(c) + 1 for c in self.text[i]]
        inside = {(a, b) for t in self.number for a, b in itertools.pairwise(t)}
        self.inside = np.array(sorted((ord(a) << 32) + ord(b) for a, b in inside), np.int64)
        self.known: dict[str, bytes] = {}
        self.pairs: dict[int, bool] = {}

    def merged(self, text: str) -> list[int]:
        """Piece numbers by merging the best pair first, the left one of equals; UNKNOWN for characters outside the vocabulary."""
        part, left, right = list(text), [*range(-1, len(text) - 1)], [*range(1, len(text) + 1)]
        queue: list[tuple[float, int, str]] = []

        def offer(i: int) -> None:
            j = right[i]
            if 0 <= i and j < len(part) and (s := self.score.get(part[i] + part[j])) is not None:
                heapq.heappush(queue, (-s, i, part[i] + part[j]))

        for i in range(len(part) - 1):
            offer(i)
        while queue:
            _, i, both = heapq.heappop(queue)
            j = right[i] if part[i] else len(part)
            if j >= len(part) or part[i] + part[j] != both:
                continue
            part[i], part[j], right[i] = both, "", right[j]
            if right[i] < len(part):
                left[right[i]] = i
            offer(i)
            if left[i] >= 0:
                offer(left[i])
        return [self.number.get(p, UNKNOWN) for p in part if p]

    def follows(self, a: int, b: int) -> bool:
        """Whether the two pieces are what merging makes of their texts put together."""
        key = (a << 20) + b
        if (v := self.pairs.get(key)) is None:
            if len(self.pairs) > 1_000_000:
                self.pairs.clear()
            v = self.pairs[key] = self.merged((self.text[a] if a >= 0 else "") + self.text[b]) == ([a, b] if a >= 0 else [b])
        return v

    def edges(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(end, start, row of the piece) of every occurrence of a piece, sorted by end, longest first."""
        n = len(codes)
        rank, span = np.unique(codes, return_inverse=True)[1].astype(np.int64), 1
        while span < self.longest:
            after = np.zeros(n, np.int64)
            after[: max(0, n - span)] = rank[span:] + 1
            rank = np.unique(rank * (n + 1) + after, return_inverse=True)[1]
            span *= 2
        order = np.argsort(rank, kind="stable")
        padded = np.concatenate([codes, np.zeros(self.longest, np.int64)])
        column, live = np.arange(self.longest), np.arange(self.longest) < self.length[:, None]

        def bound(upper: bool) -> np.ndarray:
            lo, hi = np.zeros(len(self.length), np.int64), np.full(len(self.length), n, np.int64)
            while (todo := np.flatnonzero(lo < hi)).size:
                mid = (lo[todo] + hi[todo]) // 2
                gap = np.where(live[todo], padded[order[mid][:, None] + column] - self.codes[todo], 0)
                first = gap[np.arange(len(todo)), (gap != 0).argmax(1)]
                right = first <= 0 if upper else first < 0
                lo[todo[right]] = mid[right] + 1
                hi[todo[~right]] = mid[~right]
            return lo

        low, high = bound(False), bound(True)
        count = high - low
        row = np.repeat(np.arange(len(count)), count)
        start = order[np.repeat(low - np.cumsum(count) + count, count) + np.arange(count.sum())]
        end = start + self.length[row]
        by = np.lexsort((start, end))
        return end[by], start[by], row[by]

    def learn(self, new: list[str]) -> None:
        """Encodes distinct stretches with at most one leading space mark."""
        size = np.array([len(t) for t in new])
        first = np.cumsum(size + 1) - size - 1
        codes = np.frombuffer(("\0".join(new) + "\0").encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64) + 1
        codes[first + size] = 0
        end, start, row = self.edges(codes)
        bounds = np.searchsorted(end, np.arange(len(codes) + 2)).tolist()
        starts, pieces, judged = start.tolist(), self.ids[row].tolist(), self.pairs
        for text, a, n in zip(new, first.tolist(), size.tolist(), strict=True):
            last = [UNKNOWN] * (n + 1)
            width = [1] * (n + 1)
            for e in range(1, n + 1):
                for k in range(bounds[a + e], bounds[a + e + 1]):
                    s, piece = starts[k] - a, pieces[k]
                    before = last[s] if s else UNKNOWN
                    v = judged.get((before << 20) + piece)
                    if v or (v is None and self.follows(before, piece)):
                        last[e], width[e] = piece, e - s
                        break
            out, e = [], n
            while e:
                out.append(last[e] if last[e] >= 0 else text[e - 1])
                e -= width[e]
            self.known[text] = self.pack(out[::-1])

    def pack(self, pieces: list[int | str]) -> bytes:
        ids: list[int] = []
        for p in pieces:
            ids += [p] if isinstance(p, int) else [self.byte[b] for b in p.encode("utf-8", "surrogatepass")]
        return np.array(ids, "<u4").tobytes()

    def run_of(self, text: str) -> bytes:
        """Ids of a stretch with a run of space marks, by merging."""
        out: list[int | str] = []
        at = 0
        for p in self.merged(text):
            n = len(self.text[p]) if p >= 0 else 1
            out.append(p if p >= 0 else text[at])
            at += n
        return self.pack(out)

    def stretches(self, texts: list[str]) -> list[list[str]]:
        """Each text cut where its two characters stand side by side in no piece."""
        if not texts:
            return []
        joined = "".join(texts)
        c = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        key = (c[:-1] << 32) + c[1:]
        at = np.minimum(np.searchsorted(self.inside, key), len(self.inside) - 1)
        ends = np.cumsum([len(t) for t in texts])
        cut = np.concatenate([[True], self.inside[at] != key, [True]])
        cut[ends[:-1]] = True
        where = np.flatnonzero(cut)
        out = [joined[a:b] for a, b in itertools.pairwise(where.tolist())]
        number = np.searchsorted(where, np.concatenate([[0], ends])).tolist()
        return [out[a:b] for a, b in itertools.pairwise(number)]

    def of(self, texts: list[str]) -> list[bytes]:
        """Ids of texts that a merge never leaves, as little-endian bytes."""
        known = self.known
        cut = [[t] if t in known else None for t in texts]
        todo = [i for i, ss in enumerate(cut) if ss is None]
        for i, ss in zip(todo, self.stretches([texts[i] for i in todo]), strict=True):
            cut[i] = ss
        new = {s for i in todo for s in cut[i]} - known.keys()
        if len(known) + len(new) > self.most:
            known.clear()
            new = {s for ss in cut for s in ss}
        runs = [s for s in new if s.count(SPACE) > 1]
        known.update((s, self.run_of(s)) for s in runs)
        if rest := sorted(new.difference(runs)):
            self.learn(rest)
        return [known[ss[0]] if len(ss) == 1 else b"".join(map(known.__getitem__, ss)) for ss in cut]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids in order, and where each text's begin (one more entry than texts)."""
        texts = pc.fill_null(texts, "")
        odd = pc.fill_null(pc.match_substring_regex(texts, f"^$|^ | $|  |{SPACE}"), False).to_numpy(zero_copy_only=False)
        lists = pc.split_pattern(texts, " ")
        coded = lists.flatten().dictionary_encode()
        plain = [SPACE + t for t in coded.dictionary.to_pylist()]
        each = self.of(plain)
        size = np.fromiter(map(len, each), np.int64, len(each)) // 4
        start, flat = np.cumsum(size) - size, np.frombuffer(b"".join(each), "<u4")
        at = coded.indices.to_numpy()
        n = size[at]
        end = np.cumsum(n)
        ids = flat[np.repeat(start[at] - end + n, n) + np.arange(n.sum())]
        first = np.concatenate([[0], end])[lists.offsets.to_numpy()]
        if odd.any():
            parts = [ids[a:b] for a, b in itertools.pairwise(first.tolist())]
            for i in np.flatnonzero(odd):
                t = texts[int(i)].as_py()
                runs = RUN.findall(SPACE + t.replace(" ", SPACE)) if t else []
                parts[i] = np.frombuffer(b"".join(self.of(runs)), "<u4")
            ids, first = np.concatenate([*parts, np.zeros(0, "<u4")]), np.cumsum([0, *map(len, parts)])
        return ids, first

    def decode(self, ids: np.ndarray, first: np.ndarray) -> list[str]:
        """Texts of runs of ids; bytes that are no UTF-8 become U+FFFD."""
        taken = self.raw.take(pa.array(ids.astype(np.int64)))
        place = np.frombuffer(taken.buffers()[1], "<i4", len(taken) + 1, taken.offset * 4) if len(taken) else np.zeros(1, int)
        data = bytes(taken.buffers()[2] or b"")
        texts = [data[a:b].decode("utf-8", "replace") for a, b in itertools.pairwise(place[first].tolist())]
        return [t.removeprefix(" ") for t in texts]


CODECS: list[Codec] = []


def codec(path: str) -> Codec:
    using("pieces", CODECS.clear)
    if not CODECS or CODECS[0].path != path:
        CODECS[:] = [Codec(path)]
    return CODECS[0]


def encode(docs: DataFrame, model: str) -> DataFrame:
    """(doc_id, ids) of every row."""
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int64()))])

    def run(part: pa.RecordBatch) -> list:
        ids, first = codec(model).encode(part.column(1))
        return [part.column(0), pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(ids.astype(np.int64)))]

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(mapped(run, schema), "doc_id long, ids array<long>")


def decode(rows: DataFrame, model: str) -> DataFrame:
    """(doc_id, text) of rows with ids; null ids give the empty text."""

    def run(batches):
        for b in batches:
            ids = [np.array(x or (), np.int64) for x in b.column(1).to_pylist()]
            texts = codec(model).decode(np.concatenate([*ids, np.zeros(0, np.int64)]), np.cumsum([0, *map(len, ids)]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return rows.select(F.col("doc_id").cast("long"), "ids").mapInArrow(run, "doc_id long, text string")


def round_trips(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, n_pieces, ids_crc32 (of the ids as unsigned little-endian 32-bit numbers), decoded_chars and round_trip for every row."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_pieces", pa.int64()), ("ids_crc32", pa.int64()), ("decoded_chars", pa.int64()), ("round_trip", pa.bool_())])

    def run(part: pa.RecordBatch) -> list:
        c = codec(model)
        ids, first = c.encode(part.column(1))
        back = c.decode(ids, first)
        crc = [zlib.crc32(ids[a:b]) for a, b in itertools.pairwise(first.tolist())]
        same = [t == (s or "") for t, s in zip(back, part.column(1).to_pylist(), strict=True)]
        return [part.column(0), pa.array(np.diff(first)), pa.array(crc, pa.int64()), pa.array(list(map(len, back)), pa.int64()), pa.array(same, pa.bool_())]

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(mapped(run, schema), "doc_id long, n_pieces long, ids_crc32 long, decoded_chars long, round_trip boolean")
