"""The trie of conversations' prefixes, as tables of nodes under a minimal perfect hash.

A node is a distinct sequence of first turns (role, text); the root is the empty one. A turn is its md5, a node
the 128-bit hash of its parent's and its last turn's digests.

1. Equal conversations become one path with their number and least conv_id, before anything else is dealt out,
   and paths are dealt in ranges of their digests' order, so every subtree lies in one shard or in shards that
   follow each other. No range has more than about `shard` turns, however common a first turn may be.
2. A shard enumerates its distinct digests and gives each a slot by a minimal perfect hash: levels of bit
   arrays, a digest taking the place that it has to itself in the first level where it has one. Every look-up
   is verified against the digest kept in the slot, so no two nodes can share one. Members, words and parents
   are scattered to flat arrays by slot, and sums go up through the array of parents' slots, deepest first.
3. Only nodes on a shard's first or last path can also lie in another shard. A shard hands on, for these border
   nodes, what hangs below them in it. They are merged by digest, and one more table of the same kind adds
   them up: two paths a shard, which is the only thing that one task sees of all shards.
4. The conv_ids that end at a node are written out in chunks by the order of their range and hashed as a
   stream, so a node at which a third of all conversations end is never held.

Defined results: rows without a conv_id take no part; a null role or text is empty; turns of equal number
follow each other in order of their md5; a conversation without turns ends at the root; an empty table gives
no nodes; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeline.llm.common import hold, mix

ROOT = bytes(16)
SHARD, CHUNK = 500_000, 4096
WORDS = r"[^\x20\x09-\x0D]+"


def conversation_paths(conversations: DataFrame) -> DataFrame:
    """(conv_id, path) of every conversation; path is an array of (digest, words) in order of turns.

    A conversation is one row, like a text."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)))
    turn = F.struct(F.col("turn").isNotNull().alias("numbered"), F.col("turn").cast("long").alias("turn"), digest.alias("digest"), F.regexp_count(text, F.lit(WORDS)).alias("words"))
    rows = conversations.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long"), turn.alias("t"))
    paths = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("p"))
    return paths.select("conv_id", F.transform("p", lambda t: F.struct(t["digest"].alias("digest"), t["words"].alias("words"))).alias("path"))


def with_shared_heads(paths: DataFrame, every: int = 20, most: int = 4) -> DataFrame:
    """The paths, in which the first turns are those of the first conversation of their `every`: as many as the
    crc32 of the conv_id leaves over `most`, fewer if that one has fewer, none if it is absent."""
    first = F.col("conv_id") - F.pmod("conv_id", F.lit(every))
    own = paths.select("conv_id", "path", first.alias("first"), (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("int").alias("h"))
    heads = paths.where(F.pmod("conv_id", F.lit(every)) == 0).select(F.col("conv_id").alias("first"), F.slice("path", 1, most - 1).alias("head"))
    kept = F.slice("path", F.col("h") + 1, F.greatest(F.size("path"), F.lit(1)))
    lent = F.coalesce(F.slice("head", F.lit(1), F.col("h")), F.array().cast(paths.schema["path"].dataType))
    return own.join(heads, "first", "left").select("conv_id", F.concat(lent, kept).alias("path"))


def digested(paths: DataFrame) -> DataFrame:
    """(conv_id, end, nodes, words): the digests of a conversation's nodes below the root, and the one it ends at."""
    schema = pa.schema([("conv_id", pa.int64()), ("end", pa.binary()), ("nodes", pa.list_(pa.binary())), ("words", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ends, nodes = [], []
            for turns in b.column(1).to_pylist():
                at, here = ROOT, []
                for digest in turns:
                    at = xxhash.xxh3_128_digest(at + digest)
                    here.append(at)
                ends.append(at)
                nodes.append(here)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ends, pa.binary()), pa.array(nodes, schema[2].type), b.column(2)], schema=schema)

    turns = paths.select("conv_id", F.col("path.digest").alias("digests"), F.col("path.words").alias("words"))
    return turns.mapInArrow(run, "conv_id long, end binary, nodes array<binary>, words array<int>")


class SlotTable:
    """A minimal perfect hash of distinct 128-bit digests: each has a slot from 0 to their number, less 1.

    In every level a digest has one place; those alone at theirs stay and the rest go to the next level. A
    slot is the rank of the place among the taken ones of all levels. The digests are kept by slot."""

    def __init__(self, digests: np.ndarray, roomy: float = 1.3) -> None:
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        left, taken = digests, 0
        while len(left):
            if len(self.levels) > 200:
                raise ValueError("digests are not distinct")
            at = self._places(left, len(self.levels), max(2, int(roomy * len(left))))
            alone = np.bincount(at, minlength=max(2, int(roomy * len(left)))) == 1
            self.levels.append((alone, np.cumsum(alone) - 1 + taken))
            taken += int(alone.sum())
            left = left[~alone[at]]
        self.digests = np.zeros_like(digests)
        self.digests[self._slots(digests)] = digests
        self.slots(digests)  # a digest that another one has overwritten is found here

    @staticmethod
    def _places(digests: np.ndarray, level: int, size: int) -> np.ndarray:
        h = mix(digests[:, 0] ^ mix(digests[:, 1] + np.uint64((level + 1) * 0x9E3779B97F4A7C15 % 2**64)))
        return (h % np.uint64(size)).astype(np.int64)

    def _slots(self, digests: np.ndarray) -> np.ndarray:
        out, todo = np.full(len(digests), -1, np.int64), np.arange(len(digests))
        for level, (alone, rank) in enumerate(self.levels):
            at = self._places(digests[todo], level, len(alone))
            hit = alone[at]
            out[todo[hit]] = rank[at[hit]]
            todo = todo[~hit]
        return out

    def slots(self, digests: np.ndarray) -> np.ndarray:
        """The slot of every digest; one that is not in the table is an error."""
        out = self._slots(digests)
        if (out < 0).any() or (self.digests[out] != digests).any():
            raise KeyError("a digest is not in the table")
        return out


def as_pairs(digests: pa.Array) -> np.ndarray:
    """Digests as rows of two 64-bit numbers."""
    return np.frombuffer(b"".join(digests.to_pylist()), np.uint64).reshape(-1, 2)


def distinct(digests: np.ndarray) -> np.ndarray:
    ordered = digests[np.lexsort((digests[:, 1], digests[:, 0]))]
    return ordered[np.append(True, (ordered[1:] != ordered[:-1]).any(1))[: len(ordered)]]


def summed_up(depth: np.ndarray, parent: np.ndarray, of: np.ndarray, *arrays: np.ndarray) -> None:
    """Adds the arrays' values at the nodes `of` to their parents', the deepest nodes first."""
    of = of[depth[of] > 0]
    of = of[np.argsort(-depth[of], kind="stable")]
    for level in np.split(of, np.flatnonzero(np.diff(depth[of])) + 1):
        for a in arrays:
            np.add.at(a, parent[level], a[level])


NODE = pa.schema([
    ("digest", pa.binary()), ("parent_digest", pa.binary()), ("depth", pa.int64()), ("conv_id", pa.int64()), ("parent_conv_id", pa.int64()), ("n_convs", pa.int64()),
    ("n_children", pa.int64()), ("n_leaves", pa.int64()), ("saved_tokens", pa.int64()), ("words", pa.int64()), ("border", pa.bool_()),
])
NODE_SQL = "digest binary, parent_digest binary, depth long, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, words long, border boolean"


def _rows(table: SlotTable, depth: np.ndarray, parent: np.ndarray, known: np.ndarray, conv: np.ndarray, *numbers: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The nodes in slot order; a parent's conv_id is given where it is known."""
    names = [table.digests[i].tobytes() for i in range(len(depth))]
    for at in range(0, len(depth), 50_000):
        s = slice(at, at + 50_000)
        up = [names[p] if d else None for p, d in zip(parent[s].tolist(), depth[s].tolist(), strict=True)]
        columns = [pa.array(names[s], pa.binary()), pa.array(up, pa.binary()), pa.array(depth[s]), pa.array(conv[s]), pa.array(conv[parent[s]], mask=~(known[parent[s]] & (depth[s] > 0)))]
        yield pa.RecordBatch.from_arrays([*columns, *(pa.array(n[s]) for n in numbers)], schema=NODE)


def shard_nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The nodes of a range of paths (conv_id, n, nodes, words) in order; see the module's text for border nodes."""
    rows = [b for b in batches if b.num_rows]
    if not rows:
        return
    paths = pa.Table.from_batches(rows).combine_chunks()
    conv, n, nodes, words = (paths.column(c).combine_chunks() for c in range(4))
    size = pc.list_value_length(nodes).to_numpy(zero_copy_only=False).astype(np.int64) + 1
    first = np.concatenate([[0], np.cumsum(size)])
    depth_at = np.arange(first[-1]) - np.repeat(first[:-1], size)
    below = depth_at > 0
    digests, words_at = np.zeros((first[-1], 2), np.uint64), np.zeros(first[-1], np.int64)
    digests[below], words_at[below] = as_pairs(nodes.flatten()), words.flatten().to_numpy(zero_copy_only=False)
    table = SlotTable(distinct(digests))
    slot, m = table.slots(digests), len(table.digests)
    depth, parent, length, convs, least = (np.zeros(m, np.int64) for _ in range(5))
    depth[slot], length[slot] = depth_at, words_at
    parent[slot[below]] = slot[np.flatnonzero(below) - 1]
    np.add.at(convs, slot, np.repeat(n.to_numpy(), size))
    least[:] = np.iinfo(np.int64).max
    np.minimum.at(least, slot, np.repeat(conv.to_numpy(), size))
    border = np.zeros(m, bool)
    border[slot[: first[1]]] = border[slot[first[-2] :]] = True
    inner = np.flatnonzero(~border)
    children, leaves, saved = np.zeros(m, np.int64), np.zeros(m, np.int64), np.zeros(m, np.int64)
    np.add.at(children, parent[inner], 1)
    leaves[inner], saved[inner] = children[inner] == 0, (convs[inner] - 1) * length[inner]
    summed_up(depth, parent, inner, leaves, saved)
    yield from _rows(table, depth, parent, ~border, least, convs, children, leaves, saved, length, border)


def border_nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The border nodes of all shards, merged by digest before, with their sums."""
    rows = [b for b in batches if b.num_rows]
    if not rows:
        return
    t = pa.Table.from_batches(rows).combine_chunks()
    digests = as_pairs(t.column("digest").combine_chunks())
    table = SlotTable(digests)
    slot, m = table.slots(digests), len(digests)

    def by_slot(name: str) -> np.ndarray:
        out = np.zeros(m, np.int64)
        out[slot] = t.column(name).to_numpy()
        return out

    depth, least, convs, children, leaves, saved, length = map(by_slot, ("depth", "conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "words"))
    below = t.column("depth").to_numpy() > 0
    parent = np.zeros(m, np.int64)
    parent[slot[below]] = table.slots(as_pairs(t.column("parent_digest").combine_chunks().filter(pa.array(below))))
    np.add.at(children, parent[depth > 0], 1)
    leaves += children == 0
    saved += (convs - 1) * length
    summed_up(depth, parent, np.arange(m), leaves, saved)
    yield from _rows(table, depth, parent, np.ones(m, bool), least, convs, children, leaves, saved, length, np.ones(m, bool))


def ends_hashed(ends: DataFrame) -> DataFrame:
    """(digest, ends_sha256) of (end, conv_id): the hash of a node's conv_ids in order, joined by commas."""
    chunks_schema = pa.schema([("end", pa.binary()), ("first", pa.int64()), ("ids", pa.string())])
    hash_schema = pa.schema([("digest", pa.binary()), ("ends_sha256", pa.string())])

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            end, ids = b.column(0).to_pylist(), b.column(1).to_pylist()
            out, at = [], 0
            for i in range(1, len(end) + 1):
                if i == len(end) or end[i] != end[at] or i - at == CHUNK:
                    out.append((end[at], ids[at], ",".join(map(str, ids[at:i]))))
                    at = i
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True) if out else ((), (), ()), chunks_schema, strict=True)], schema=chunks_schema)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = None, hashlib.sha256()
        for b in batches:
            done: list[tuple[bytes, str]] = []
            for end, ids in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
                if end == last:
                    state.update(b",")
                elif last is not None:
                    done.append((last, state.hexdigest()))
                    state = hashlib.sha256()
                last = end
                state.update(ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in done], pa.binary()), pa.array([x[1] for x in done], pa.string())], schema=hash_schema)
        if last is not None:
            yield pa.RecordBatch.from_arrays([pa.array([last], pa.binary()), pa.array([state.hexdigest()], pa.string())], schema=hash_schema)

    parts = ends.repartitionByRange("end", "conv_id").sortWithinPartitions("end", "conv_id").mapInArrow(chunks, "end binary, first long, ids string")
    return parts.repartition("end").sortWithinPartitions("end", "first").mapInArrow(hashed, "digest binary, ends_sha256 string")


def prefix_trie(paths: DataFrame, shard: int = SHARD) -> DataFrame:
    """(digest, conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) of every
    node of the paths (conv_id, path), one row a conversation; `shard` is about the most turns of a shard."""
    spark = paths.sparkSession
    held = hold(digested(paths))
    turns = held.agg(F.sum(F.size("nodes"))).first()[0] or 0
    whole = held.groupBy("end").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n"), F.first("nodes").alias("nodes"), F.first("words").alias("words"))
    shards = max(-(-turns // shard), min(int(spark.conf.get("spark.sql.shuffle.partitions")), 1 + turns // 1000))
    ordered = whole.select("conv_id", "n", "nodes", "words").repartitionByRange(shards, "nodes").sortWithinPartitions("nodes")
    nodes = hold(ordered.mapInArrow(shard_nodes, NODE_SQL))
    same: list[Column] = [F.first(c).alias(c) for c in ("parent_digest", "depth", "words")]
    summed: list[Column] = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    border = nodes.where("border").groupBy("digest").agg(F.min("conv_id").alias("conv_id"), *same, *summed)
    border = hold(border.repartition(1).mapInArrow(border_nodes, NODE_SQL))  # two paths a shard
    known = border.select(F.col("digest").alias("parent_digest"), F.col("conv_id").alias("border_conv_id"))
    inner = nodes.where("not border").join(known, "parent_digest", "left").withColumn("parent_conv_id", F.coalesce("parent_conv_id", "border_conv_id"))
    columns = ["digest", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    out = inner.select(columns).unionByName(border.select(columns)).join(ends_hashed(held.select("end", "conv_id")), "digest", "left")
    return out.withColumn("ends_sha256", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)))
