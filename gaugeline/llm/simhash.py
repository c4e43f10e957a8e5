"""Document fingerprints: SimHash of weighted term hashes, and the links within a Hamming radius.

Terms are the distinct words of a text (A-Z small), of weight 2, and its distinct pairs of neighbouring
words, of weight 1. Each term's 256-bit hash votes with its weight on the bits. Links: a fingerprint is cut
into radius + 1 blocks, one of which two fingerprints within the radius must share, so a table a block (a
permutation of the bits that puts the block first) finds them all. The other bits of a very large bucket are
cut into radius + 1 blocks again, so that only fingerprints that share a block of either cut meet (each
combination of two blocks is a permutation). A link counts in the first table, and there in the first
combination, that finds it. Equal fingerprints are one, and large buckets are dealt out in pairs of parts of
bounded size; what leaves a task is its links reduced to a tree, and how many each fingerprint has.

Defined results: a null text counts as empty, the fingerprint of no terms is all zeros; equal texts have
equal fingerprints; rows that repeat a doc_id follow each other in order of a hash of their texts; rows
without a doc_id come last; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeline.llm.common import HASHES, groups, hold, mix, release, slices, using, words_of
from gaugeline.llm.components import components
from gaugeline.llm.near_dedup import Joined, dealt

SIZE = 256
LANES = np.arange(1, SIZE // 64 + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
RADIUS = 24  # near copies of five-word similarity 0.8 are some 17 bits apart, 23 in nine of ten; other texts about 120
FIRST = 11  # bits of a block that name its bucket at most
TERMS = 8192  # terms of a text whose bits are held at once
PAIRS = 16_384  # near pairs of a bucket that are looked at at once
BIT_COUNT = np.array([bin(i).count("1") for i in range(256)], np.uint8)


def fingerprints(texts: pa.Array) -> np.ndarray:
    """One row of 32 bytes for every text."""
    using("hashes", HASHES.clear)
    words = words_of(texts, lower=True)
    h = HASHES.of(words.tokens)[words.at]
    pairs = mix(h * np.uint64(0xD6E8FEB86659FD93) + np.roll(h, -1))
    out = np.zeros((len(words.first) - 1, SIZE // 8), np.uint8)
    for i, (a, b) in enumerate(zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True)):
        if a == b:
            continue
        u, v = np.unique(h[a:b]), np.unique(pairs[a : b - 1])
        weight = np.repeat(np.array([2, 1], np.float32), [len(u), len(v)])
        terms, votes = np.concatenate([u, v]), np.zeros(SIZE)
        for at in range(0, len(terms), TERMS):
            bits = np.unpackbits(mix(terms[at : at + TERMS, None] ^ LANES).view(np.uint8), axis=1)
            votes += weight[at : at + TERMS] @ bits.astype(np.float32)
        out[i] = np.packbits(2 * votes > weight.sum(dtype=np.float64))
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return 1 - BIT_COUNT[a ^ b].sum(1) / SIZE


def edited(text: str, following: str) -> str:
    """The last half of the code points replaced by the first as many, or all, of the next text."""
    n = len(text) // 2
    return text[: len(text) - n] + following[:n]


RESULT = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])
RESULT_DDL = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
#: Rows of a range: results, and the texts of its first and its last row.
DONE, FIRST_ROW, LAST_ROW = 0, 1, 2
STEP = pa.schema([*RESULT, ("part", pa.int32()), ("kind", pa.int32()), ("text", pa.string())])


def outcome(ids: list, texts: list[str], prints: np.ndarray, following: list[str], their_prints: np.ndarray) -> list[pa.Array]:
    """The columns of RESULT for rows and the rows that follow them."""
    changed = [edited(t, f) for t, f in zip(texts, following, strict=True)]
    other = fingerprints(pa.array(changed, pa.string()))
    return [
        pa.array(ids, pa.int64()),
        pa.array(list(map(len, texts)), pa.int64()),
        pa.array([hashlib.sha256(t.encode()).hexdigest() for t in changed], pa.string()),
        *(pa.array([p.tobytes().hex() for p in x], pa.string()) for x in (prints, other)),
        *(pa.array(likeness(prints, x), pa.float64()) for x in (other, their_prints)),
    ]


def ranged(docs: DataFrame) -> DataFrame:
    """Rows of STEP, from one shuffle of the texts to ranges of (doc_id, hash of the text, place); ids that
    many rows share are split too. A range knows the followers of all its rows but the last, and hands on the
    texts of its first and its last row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumns({"tie": F.xxhash64("text"), "place": F.monotonically_increasing_id()})
    order = [F.desc_nulls_last("doc_id"), F.asc("tie"), F.asc("place")]
    parts = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranges = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("doc_id", "text")

    def run(batches):
        part, held = TaskContext.get().partitionId(), None  # the last row seen and its fingerprint
        edge = lambda kind, doc, text: pa.RecordBatch.from_pylist([{"doc_id": doc, "part": part, "kind": kind, "text": text}], STEP)
        for b in (p for batch in batches for p in slices(batch)):
            ids, texts, prints = b.column(0).to_pylist(), b.column(1).to_pylist(), fingerprints(b.column(1))
            if held:
                ids, texts, prints = [held[0], *ids], [held[1], *texts], np.concatenate([held[2], prints])
            else:
                yield edge(FIRST_ROW, ids[0], texts[0])
            held = ids[-1], texts[-1], prints[-1:]
            n = len(ids) - 1
            done = outcome(ids[:-1], texts[:-1], prints[:-1], texts[1:], prints[1:])
            yield pa.RecordBatch.from_arrays([*done, pa.array([part] * n, pa.int32()), pa.array([DONE] * n, pa.int32()), pa.nulls(n, pa.string())], schema=STEP)
        if held:
            yield edge(LAST_ROW, held[0], held[1])

    return hold(ranges.mapInArrow(run, RESULT_DDL + ", part int, kind int, text string"))


def fingerprint_rows(docs: DataFrame) -> DataFrame:
    """Every row's doc_id, n_chars, fingerprint, and the edited text's, with the next row in descending order of
    doc_id: within ranges as ranged() has them, and the last row of a range with the first of the next."""
    spark = docs.sparkSession
    step = ranged(docs)
    full = [r["part"] for r in step.where(F.col("kind") == FIRST_ROW).select("part").orderBy("part").collect()]  # a number a range
    release(spark)  # the shuffled texts; a query that just ended is held until the next one has run
    after = spark.createDataFrame(list(zip(full, full[1:] + full[:1], strict=True)), "part int, next int")
    firsts = step.where(F.col("kind") == FIRST_ROW).select(F.col("part").alias("next"), F.col("text").alias("following"))
    lasts = step.where(F.col("kind") == LAST_ROW).select("doc_id", "text", "part").join(after, "part").join(firsts, "next")

    def finish(batches):
        for b in (p for batch in batches for p in slices(batch)):
            ids, texts, following = (c.to_pylist() for c in b.columns)
            yield pa.RecordBatch.from_arrays(outcome(ids, texts, fingerprints(b.column(1)), following, fingerprints(b.column(2))), schema=RESULT)

    ends = lasts.select("doc_id", "text", "following").mapInArrow(finish, RESULT_DDL)
    return step.where(F.col("kind") == DONE).select(*RESULT.names).union(ends)


def cuts_of(bits: int, blocks: int) -> list[int]:
    """Borders of so many blocks of about equal width."""
    return [k * bits // blocks for k in range(blocks + 1)]


def number(bits: np.ndarray) -> np.ndarray:
    """The number that up to FIRST leading bits of each row write."""
    bits = bits[:, :FIRST]
    return bits.astype(np.int32) @ (1 << np.arange(bits.shape[1], dtype=np.int32))


def numbers(bits: np.ndarray, borders: list[int]) -> np.ndarray:
    """number() of every block, a column each."""
    return np.stack([number(bits[:, a:z]) for a, z in itertools.pairwise(borders)], axis=1)


def shares_one(blocks: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether rows i and j agree in a column."""
    return (blocks[i] == blocks[j]).any(axis=1)


def near_pairs(prints: np.ndarray, radius: int, part: np.ndarray, cross: bool, cells: int = 400_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs within the radius, each once and up to PAIRS at a time, since of a group of near copies all
    are: all of one part, or with `cross` only those across two."""
    lanes = prints.view(np.uint64)
    rows = max(1, cells // len(prints))
    for at in range(0, len(prints), rows):
        head = lanes[at : at + rows]
        apart = np.zeros((len(head), len(lanes) - at), np.uint16)
        for k in range(lanes.shape[1]):
            apart += np.bitwise_count(head[:, k, None] ^ lanes[at:, k])
        i, j = np.nonzero(apart <= radius)
        keep = i < j
        i, j = i[keep] + at, j[keep] + at
        if cross:
            keep = part[i] != part[j]
            i, j = i[keep], j[keep]
        for k in range(0, len(i), PAIRS):
            yield i[k : k + PAIRS], j[k : k + PAIRS]


def inner_cuts(table: int, cuts: list[int], radius: int) -> tuple[np.ndarray, list[int]]:
    """The bits that are cut inside a bucket of `table`, those but its leading ones, and their borders; all bits for -1."""
    inside = np.ones(SIZE, bool)
    if table >= 0:
        inside[cuts[table] : min(cuts[table + 1], cuts[table] + FIRST)] = False
    return np.flatnonzero(inside), cuts_of(int(inside.sum()), radius + 1)


def own_pairs(prints: np.ndarray, radius: int, part: np.ndarray, cross: bool, bucket: int, inner: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """near_pairs that no table before that of `bucket` finds and, within a second cut, no combination before `inner`."""
    cuts, before = cuts_of(SIZE, radius + 1), None
    for i, j in near_pairs(prints, radius, part, cross):
        if before is None:  # most buckets have no pair
            bits = np.unpackbits(prints, axis=1)
            inside, borders = inner_cuts(bucket >> FIRST, cuts, radius)
            before = [numbers(bits, cuts)[:, : bucket >> FIRST]]
            if inner >= 0:
                before.append(numbers(bits[:, inside], borders)[:, : inner >> FIRST])
        own = ~np.logical_or.reduce([shares_one(b, i, j) for b in before])
        yield i[own], j[own]


FOUND = pa.schema([("u", pa.int64()), ("v", pa.int64()), ("n", pa.int64())])


def classes(rows: DataFrame, radius: int = RADIUS, block: int = 2048, most: int | None = None) -> DataFrame:
    """(fingerprint, class_id, n_links): fingerprints joined by steps of at most `radius` bits share the least
    doc_id of the class; n_links counts the other rows within the radius of one, those of equal fingerprints too.

    rows have doc_id and fingerprint; those without an id take no part. Buckets of more than `most` fingerprints
    (by default where a second cut sends each fewer times than dealing would) are cut again; buckets of more
    than `block` are dealt out."""
    most = block * (radius + 1) if most is None else most
    reps = rows.where("doc_id is not null").groupBy("fingerprint").agg(F.min("doc_id").alias("node"), F.count(F.lit(1)).alias("copies"))
    reps = hold(reps.select("node", F.unhex("fingerprint").alias("print"), "copies", "fingerprint"))
    release(rows.sparkSession)
    cuts = cuts_of(SIZE, radius + 1)

    def tables(batches):
        """Each fingerprint's buckets: table and leading bits of the block; `bucket` -1 asks for the first cut."""
        for b in batches:
            prints = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint8).reshape(-1, SIZE // 8)
            bits = np.unpackbits(prints, axis=1)
            before = np.array(b.column(3))
            out = np.empty((len(bits), radius + 1), np.int32)
            for bucket in np.unique(before >> FIRST):  # rows of one table of the first cut leave out the same bits
                here = np.flatnonzero(before >> FIRST == bucket)
                inside, borders = inner_cuts(int(bucket), cuts, radius)
                rest = bits[np.ix_(here, inside)]
                for k, (a, z) in enumerate(itertools.pairwise(borders)):
                    out[here, k] = number(rest[:, a:z]) + (k << FIRST)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(prints) + 1, dtype=np.int32) * (radius + 1)), pa.array(out.ravel()))
            yield pa.RecordBatch.from_arrays([*b.columns, lists], names=["node", "print", "copies", "bucket", "found"])

    cut = lambda df: df.mapInArrow(tables, "node long, print binary, copies long, bucket int, found array<int>").withColumn("found", F.explode("found"))
    keyed = cut(reps.select("node", "print", "copies", F.lit(-1).alias("bucket"))).select("node", "print", "copies", F.col("found").alias("bucket"))
    sizes = hold(keyed.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))  # at most 2^FIRST rows a table
    keyed = keyed.join(F.broadcast(sizes), "bucket")
    met = keyed.where(F.col("n") <= most).withColumn("inner", F.lit(-1))
    if sizes.where(F.col("n") > most).count():
        again = cut(keyed.where(F.col("n") > most).select("node", "print", "copies", "bucket")).withColumnRenamed("found", "inner")
        counts = again.groupBy("bucket", "inner").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        met = met.unionByName(again.join(counts, ["bucket", "inner"]))
    key = ["bucket", "inner", "lo", "hi"]
    met = dealt(met, "bucket", "n", "node", block).select(*key, "part", "node", "print", "copies")
    met = met.repartition(*key).sortWithinPartitions(*key, "node")

    def run(batches):
        out: list[tuple] = []
        for (bucket, inner, lo, hi), t in groups(batches, key):
            if t.num_rows < 2:
                continue
            node, copies, links = np.array(t.column("node")), np.array(t.column("copies")), np.zeros(t.num_rows)
            prints = np.frombuffer(b"".join(t.column("print").to_pylist()), np.uint8).reshape(-1, SIZE // 8)
            joined = Joined(len(node))
            for i, j in own_pairs(prints, radius, np.array(t.column("part")), lo != hi, bucket, inner):
                links += np.bincount(i, copies[j], len(node)) + np.bincount(j, copies[i], len(node))
                out += [(int(node[a]), int(node[b]), None) for a, b in zip(i.tolist(), j.tolist(), strict=True) if joined.join(a, b)]
            out += [(int(node[a]), None, int(links[a])) for a in np.flatnonzero(links)]
            if len(out) > 10_000:
                yield rows_of(out)
                out = []
        yield rows_of(out)

    found = hold(met.mapInArrow(run, "u long, v long, n long"))
    release(rows.sparkSession)
    roots = components(found.where("v is not null").select("u", "v")).withColumnRenamed("v", "node")
    counts = found.where("n is not null").groupBy(F.col("u").alias("node")).agg(F.sum("n").alias("n"))
    named = reps.join(roots, "node", "left").join(counts, "node", "left")
    return named.select("fingerprint", F.coalesce("root", "node").alias("class_id"), (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"))


def rows_of(found: list[tuple]) -> pa.RecordBatch:
    columns = zip(*found, strict=True) if found else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], schema=FOUND)


def fingerprint_documents(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """fingerprint_rows with class_id, the least doc_id of the fingerprints that hang together within the radius,
    and n_links, the number of other rows whose fingerprints lie within it; both are null for the fingerprint of
    rows without an id alone."""
    rows = fingerprint_rows(docs)
    return rows.join(classes(rows, radius), "fingerprint", "left").select(*RESULT.names, "class_id", "n_links")
