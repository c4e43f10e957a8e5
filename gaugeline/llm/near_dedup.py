"""Near-duplicates by MinHash bands, sequential Bayesian pruning and exact verification.

1. Rows with the same words are one node, named by their least doc_id, so copies are never paired.
2. A node's MinHash values are cut into bands; nodes that agree on a band share a bucket. The similarity
   sets how many bands of how many values there are, so that a pair at it misses all bands with
   probability BAND_MISS at most. Buckets with the same members are looked at once.
3. Inside a bucket, signatures are compared a batch at a time; a pair is pruned as soon as the
   posterior probability of reaching the similarity falls under `miss`. A bucket of more than `block`
   nodes is dealt out as pairs of blocks, so no task holds more than two blocks. Only links of
   survivors to the least node they hang together with leave the task, at most one per node.
4. Components of those links are candidate groups. Each member's text is read once, and its full
   shingle set is compared with those of the group that may reach the similarity (pairs of blocks
   again); pairs already joined are skipped. The links that hold exactly go into the final components.

Defined results: null texts and texts without words have an empty set and are linked with nothing;
texts under five words are one shingle; rows that repeat a doc_id count as one document in the links;
rows without a doc_id take no part and have a null component_id (kept); extra columns are ignored.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeline.llm.common import HASHES, Words, chain, groups, hold, mapped, mix, slices, unused, using, words_of
from gaugeline.llm.components import components

SHINGLE = 5
BATCH, BAND_MISS, FEW, MOST = 42, 2e-6, 176, 2048
_rng = np.random.default_rng(20)
MULTIPLY = _rng.integers(1, 2**32, MOST, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
ADD = _rng.integers(0, 2**32, MOST, dtype=np.uint64).astype(np.uint32)


@cache
def bands_for(percent: int) -> tuple[int, int]:
    """(rows, bands): the most values a band with which FEW values in all keep a pair at the similarity
    from missing every band with a probability over BAND_MISS; one value a band where FEW do not."""
    if not 1 <= percent <= 100:
        raise ValueError("percent is a whole number from 1 to 100")
    best = None
    for rows in range(1, 17):
        at_once = (percent / 100) ** rows
        bands = 1 if at_once == 1 else math.ceil(math.log(BAND_MISS) / math.log1p(-at_once))
        if best is None or rows * bands <= FEW:
            best = rows, bands
    return best


ROWS, BANDS = bands_for(85)
HASH_COUNT = ROWS * BANDS


def shingle_sets(texts: pa.Array) -> tuple[Words, list[np.ndarray]]:
    """For every text the 64-bit hashes of its runs of five words, a set in order of size."""
    using("hashes", HASHES.clear)
    words = words_of(texts, lower=True)
    h = HASHES.of(words.tokens)[words.at]
    whole = chain([h[i : len(h) - SHINGLE + 1 + i] for i in range(SHINGLE)]) if len(h) >= SHINGLE else h
    out = []
    for a, b in itertools.pairwise(words.first.tolist()):
        if b - a >= SHINGLE:
            out.append(np.unique(whole[a : b - SHINGLE + 1]))
        else:
            out.append(chain([np.full(1, b - a, np.uint64), *(h[i : i + 1] for i in range(a, b))]) if b > a else np.zeros(0, np.uint64))
    return words, out


def minima(s: np.ndarray, count: int = HASH_COUNT) -> np.ndarray:
    """The first `count` MinHash values of a set of hashes."""
    x, least = (mix(s) >> np.uint64(32)).astype(np.uint32), np.full(count, 2**32 - 1, np.uint32)
    for at in range(0, len(x), 2048):
        part = x[at : at + 2048]
        np.minimum(least, (MULTIPLY[:count, None] * (part ^ ADD[:count, None])).min(1), out=least)
    return least


def signature(least: np.ndarray) -> np.ndarray:
    """One byte of each MinHash value (b-bit minwise hashing)."""
    return (mix(least.astype(np.uint64)) >> np.uint64(56)).astype(np.uint8)


def band_keys(least: np.ndarray, rows: int = ROWS) -> np.ndarray:
    values = least.reshape(-1, rows).astype(np.uint64)
    return chain([np.arange(len(values), dtype=np.uint64), *values.T]).view(np.int64)


@cache
def least_matches(similarity: float, miss: float, count: int = HASH_COUNT) -> list[tuple[int, int]]:
    """(hashes compared, least matches to go on): below it, P(J >= similarity | matches) < miss.

    The prior of J is uniform; one-byte hashes also match by chance with probability 1/256."""
    j = (np.arange(4000) + 0.5) / 4000
    p = j + (1 - j) / 256
    out = []
    for n in sorted({*range(BATCH, count, BATCH), count}):
        m = np.arange(n + 1)[:, None]
        log = m * np.log(p) + (n - m) * np.log1p(-p)
        w = np.exp(log - log.max(1, keepdims=True))
        tail = w[:, j >= similarity].sum(1) / w.sum(1)
        out.append((n, int(np.argmax(tail >= miss))))
    return out


def survivors(signs: np.ndarray, left: np.ndarray, right: np.ndarray, similarity: float, miss: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs left[k], right[k] whose posterior stays above `miss` in every batch, and their matches."""
    same, done = np.zeros(len(left), np.int64), 0
    for n, least in least_matches(similarity, miss, signs.shape[1]):
        same += (signs[left, done:n] == signs[right, done:n]).sum(1)
        keep = same >= least
        left, right, same, done = left[keep], right[keep], same[keep], n
    return left, right, same


def pairs_of(block: np.ndarray, chunk: int = 200_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs within a group: all of them for one block, only those across for two."""
    n, first = len(block), block.min()
    cross = (block != first).any()
    rows = max(1, chunk // max(n, 1))
    for at in range(0, n, rows):
        i, j = np.meshgrid(np.arange(at, min(n, at + rows)), np.arange(n), indexing="ij")
        keep = ((block[i] == first) & (block[j] != first)) if cross else (i < j)
        yield i[keep], j[keep]


class Joined:
    """Union of indices within one task's group."""

    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        a, b = self.find(i), self.find(j)
        self.up[max(a, b)] = min(a, b)
        return a != b


def dealt(df: DataFrame, key: str, size: str, node: str, block: int) -> DataFrame:
    """Adds lo, hi and part: groups (key, lo, hi) hold at most about two blocks, and every two nodes
    of a key meet in one of them."""
    blocks = F.ceil(F.col(size) / F.lit(block)).cast("int")
    df = df.withColumn("part", F.pmod(F.xxhash64(node, F.lit(11)), blocks).cast("int"))
    df = df.withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    return df.withColumn("lo", F.least("part", "other")).withColumn("hi", F.greatest("part", "other")).drop("other")


EDGE = pa.schema([("u", pa.int64()), ("v", pa.int64())])


def edges(rows: list[tuple[int, int]]) -> pa.RecordBatch:
    u, v = zip(*rows, strict=True) if rows else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], schema=EDGE)


def first_pass(docs: DataFrame, percent: int = 85) -> DataFrame:
    """(doc_id, words_hash, n_shingles, sign, bands) for every row; the last three are null or 0 without words."""
    per_band, bands = bands_for(percent)
    schema = pa.schema([("doc_id", pa.int64()), ("words_hash", pa.string()), ("n_shingles", pa.int64()), ("sign", pa.binary()), ("bands", pa.list_(pa.int64()))])

    def run(part: pa.RecordBatch) -> list:
        words, sets = shingle_sets(part.column(1))
        h = HASHES.of(words.tokens)[words.at]
        out: list[tuple] = []
        for s, a, b in zip(sets, words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
            if not len(s):
                out.append((None, 0, None, None))
                continue
            least = minima(s, per_band * bands)
            out.append((xxhash.xxh3_128_hexdigest(h[a:b]), len(s), signature(least).tobytes(), band_keys(least, per_band)))
        return [part.column(0), *(pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), list(schema)[1:], strict=True))]

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(mapped(run, schema), "doc_id long, words_hash string, n_shingles long, sign binary, bands array<long>")


def candidate_links(reps: DataFrame, similarity: float, miss: float, block: int) -> DataFrame:
    """Links (u, v) of nodes (node, sign, bands) such that nodes with a surviving pair hang together."""
    banded = reps.select("node", F.explode("bands").alias("bucket"))
    full = (
        banded.groupBy("bucket")
        .agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("node")).alias("f1"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("f2"))
        .where("n > 1")
        .groupBy("n", "f1", "f2")
        .agg(F.min("bucket").alias("bucket"))
        .select("bucket", "n")
    )
    rows = dealt(banded.join(full, "bucket"), "bucket", "n", "node", block).join(reps.select("node", "sign"), "node")
    rows = rows.select("bucket", "lo", "hi", "part", "node", "sign").repartition("bucket", "lo", "hi").sortWithinPartitions("bucket", "lo", "hi", "node", "part")

    def run(batches):
        out = []
        for _, t in groups(batches, ["bucket", "lo", "hi"]):
            node = np.array(t.column("node"))
            signs = np.frombuffer(b"".join(t.column("sign").to_pylist()), np.uint8).reshape(len(node), -1)
            joined, touched = Joined(len(node)), set()
            for i, j in pairs_of(np.array(t.column("part"))):
                for a, b in zip(*(x.tolist() for x in survivors(signs, i, j, similarity, miss)[:2]), strict=True):
                    joined.join(a, b)
                    touched.update((a, b))
            out += [(int(node[joined.find(a)]), int(node[a])) for a in touched if joined.find(a) != a]
            if len(out) > 10_000:
                yield edges(out)
                out = []
        yield edges(out)

    return rows.mapInArrow(run, "u long, v long")


def exact_links(docs: DataFrame, groups_of: DataFrame, percent: int, miss: float, block: int) -> DataFrame:
    """Links (u, v) of nodes (v, root) that hold on their full sets, enough of them to join all that do."""
    sized = groups_of.join(groups_of.groupBy("root").agg(F.count(F.lit(1)).alias("n")), "root").select(F.col("v").alias("node"), "root", "n")
    count = math.prod(bands_for(percent))
    texts = docs.select(F.col("doc_id").cast("long").alias("node"), "text").join(sized.hint("shuffle_hash"), "node")
    schema = pa.schema([("node", pa.int64()), ("root", pa.int64()), ("n", pa.int64()), ("items", pa.binary()), ("sign", pa.binary())])

    def sets(part: pa.RecordBatch) -> list:
        found = shingle_sets(part.column(3))[1]
        return [*part.columns[:3], pa.array([s.tobytes() for s in found], pa.binary()), pa.array([signature(minima(s, count)).tobytes() for s in found], pa.binary())]

    rows = texts.select("node", "root", "n", F.col("text").cast("string").alias("text")).mapInArrow(mapped(sets, schema), "node long, root long, n long, items binary, sign binary")
    rows = dealt(rows.where(F.octet_length("items") > 0), "root", "n", "node", block).repartition("root", "lo", "hi").sortWithinPartitions("root", "lo", "hi", "node")

    def run(batches):
        out = []
        for _, t in groups(batches, ["root", "lo", "hi"]):
            node = np.array(t.column("node"))
            items = [np.frombuffer(x, np.uint64) for x in t.column("items").to_pylist()]
            signs = np.frombuffer(b"".join(t.column("sign").to_pylist()), np.uint8).reshape(len(node), -1)
            size, joined = np.array([len(x) for x in items]), Joined(len(node))
            for i, j in pairs_of(np.array(t.column("part"))):
                near = 100 * np.minimum(size[i], size[j]) >= percent * np.maximum(size[i], size[j])
                i, j, same = survivors(signs, i[near], j[near], percent / 100, miss)
                for k in np.argsort(-same, kind="stable").tolist():
                    a, b = int(i[k]), int(j[k])
                    if joined.find(a) == joined.find(b):
                        continue
                    both = len(np.intersect1d(items[a], items[b], assume_unique=True))
                    if 100 * both >= percent * (size[a] + size[b] - both):
                        joined.join(a, b)
                        out.append((int(node[a]), int(node[b])))
            if len(out) > 10_000:
                yield edges(out)
                out = []
        yield edges(out)

    return rows.mapInArrow(run, "u long, v long")


def classes(docs: DataFrame, percent: int, miss: float, bucket_block: int, set_block: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, words_hash, n_shingles, ..) of every row, and (words_hash, node, component_id) of every text with words."""
    rows = hold(first_pass(docs, percent))
    reps = hold(
        rows.where("n_shingles > 0 and doc_id is not null")
        .groupBy("words_hash")
        .agg(F.min(F.struct("doc_id", "sign", "bands")).alias("r"))
        .select("words_hash", F.col("r.doc_id").alias("node"), "r.sign", "r.bands")
    )
    near = components(candidate_links(reps, percent / 100, miss, bucket_block))
    roots = components(exact_links(docs, near, percent, miss, set_block)).withColumnRenamed("v", "node")
    return rows, reps.select("words_hash", "node").join(roots, "node", "left").select("words_hash", "node", F.coalesce("root", "node").alias("component_id"))


def near_duplicates(docs: DataFrame, percent: int = 85, miss: float = 1e-6, bucket_block: int = 512, set_block: int = 128) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row: see the module's text.

    `percent` is the least similarity in hundredths, `miss` the posterior probability at which a pair is pruned."""
    rows, named = classes(docs, percent, miss, bucket_block, set_block)
    out = rows.select("doc_id", "words_hash", "n_shingles").join(named.drop("node"), "words_hash", "left")
    return out.select(
        "doc_id",
        "n_shingles",
        F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"),
    ).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def keep_first(docs: DataFrame, percent: int = 85, miss: float = 1e-6, bucket_block: int = 512, set_block: int = 128) -> DataFrame:
    """One row of each group of near-duplicates, the one with the least doc_id, with the columns it came with.

    What is kept is a doc_id with its words: of an id that repeats with several texts, those stay that are
    the least of their group, once each. Rows without words are copies only of rows of the same id and text;
    all rows without an id stay."""
    rows, named = classes(docs, percent, miss, bucket_block, set_block)
    rows = rows.where("doc_id is not null").select("doc_id", F.coalesce("words_hash", F.lit("")).alias("words_hash"))
    first = named.where("node = component_id").select(F.col("node").alias("doc_id"), "words_hash")
    stays = first.union(rows.where("words_hash = ''")).distinct()
    mixed = rows.groupBy("doc_id").agg((F.min("words_hash") != F.max("words_hash")).alias("mixed"))
    ids = stays.groupBy("doc_id").agg(F.bool_or(F.col("words_hash") == "").alias("wordless")).join(mixed, "doc_id")
    key, bare, words = (unused(docs.columns, n) for n in ("mixed", "wordless", "words_hash"))
    met = docs.join(ids.select("doc_id", F.col("mixed").alias(key), F.col("wordless").alias(bare)).hint("shuffle_hash"), "doc_id")
    # dealt by doc_id already, so that copies of an id of one text are told apart without another shuffle
    plain = met.where(~F.col(key)).withColumn(words, F.when(F.col(bare), F.col("text"))).dropDuplicates(["doc_id", words]).select(docs.columns)
    at, kinds = docs.columns.index("text"), ", ".join(f"`{n}` {t}" for n, t in docs.dtypes)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (p for b in batches for p in slices(b)):
            found = words_of(part.column(at).cast(pa.string()), lower=True)
            h = HASHES.of(found.tokens)[found.at]
            hashes = [xxhash.xxh3_128_hexdigest(h[a:b]) if b > a else "" for a, b in itertools.pairwise(found.first.tolist())]
            yield part.append_column(words, pa.array(hashes, pa.string()))

    several = met.where(key).select(docs.columns).mapInArrow(hashed, f"{kinds}, `{words}` string")
    several = several.join(stays.withColumnRenamed("words_hash", words), ["doc_id", words], "left_semi")
    several = several.withColumn(key, F.when(F.col(words) == "", F.col("text"))).dropDuplicates(["doc_id", words, key])
    return plain.unionByName(several.select(docs.columns)).unionByName(docs.where(F.col("doc_id").isNull()))
