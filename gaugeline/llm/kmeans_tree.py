"""Approximate nearest neighbours with a hierarchical k-means tree and best-bin-first search.

The top of the tree is fitted on a bounded sample of vectors; every vector is filed in one of its leaves.
Leaves that hold too many rows are split again by Spark, level by level, each by k-means on a bounded
sample of its own rows, so that leaves grow in number with the table and not in size; these lower
centres are a table that is joined, never sent whole to a task. A query walks the top with a priority queue
of branches, nearest centre first, and so meets leaves in best-bin order; at a lower level the bins it holds
are replaced by their children and ordered again.

How many bins to keep at each level is calibrated on the whole table: for some probe rows the true
neighbours are found by comparing all rows, and the search is widened until the wanted share of them lies
in the bins kept.

The search is a join of queries and candidates on the leaf. Equal vectors are one candidate that
carries its k + 1 least ids, which is all that any query can return of it. A leaf of many vectors is
dealt in cells of bounded size, and each cell meets the leaf's queries in blocks; a cell gives each
query its k best at most, and the best of all cells are taken.

Nearness is the cosine of the original vectors in double precision; ties go to the smaller id.
Defined results: vectors that are null or zero, or hold a null or a non-finite component, take no part,
nor do rows whose id is null. Every other row is a query, if its id says so, and a candidate for all
queries but itself, so rows that repeat an id, with the same vector or another, are candidates of each
other. A cosine needs vectors of one length: those of the length that most have are searched by the tree,
and those of any other length are one bin, which all queries of that length visit. With fewer candidates
than k all are returned; extra columns are ignored.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gaugeline.llm.common import groups, hold

BRANCH, CELL = 8, 2048
FAN, TRAIN = 64, 32  # children of a leaf that is split at most, and rows that train each
PROBES, COPIES = 200, 4096


@dataclass(frozen=True)
class Tree:
    """centres[i] are the unit centres of node i's branches, child[i] their node numbers, or -1 - leaf."""

    centres: list[np.ndarray]
    child: list[list[int]]
    leaves: int

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        """The leaf that each unit vector falls in."""
        out, todo = np.zeros(len(x), np.int64), [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            at = (x[rows] @ self.centres[node].T).argmax(1)
            for k, c in enumerate(self.child[node]):
                if len(mine := rows[at == k]):
                    if c < 0:
                        out[mine] = -1 - c
                    else:
                        todo.append((c, mine))
        return out

    def best_bins(self, q: np.ndarray, most: int) -> list[tuple[int, float]]:
        """The first `most` leaves in best-bin-first order, each with the cosine of its centre."""
        queue, out = [(0.0, 0)], []
        while queue and len(out) < most:
            far, node = heapq.heappop(queue)
            if node < 0:
                out.append((-1 - node, -far))
                continue
            for near, c in zip((self.centres[node] @ q).tolist(), self.child[node], strict=True):
                heapq.heappush(queue, (-near, c))
        return out


def kmeans(x: np.ndarray, k: int, rng: np.random.Generator, steps: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means: unit centres and each row's number. Distinct starts; an empty cluster keeps its centre."""
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(steps):
        at = (x @ centres.T).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, at, x)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(size > 0, sums / np.maximum(size, 1e-12), centres)
    return centres, (x @ centres.T).argmax(1)


def grow(x: np.ndarray, leaf_size: int = 200, seed: int = 7) -> Tree:
    rng, centres, child, leaves = np.random.default_rng(seed), [], [], 0
    todo = [(np.arange(len(x)), None)]
    while todo:
        rows, place = todo.pop(0)
        node = len(centres)
        if place:
            child[place[0]][place[1]] = node
        c, at = kmeans(x[rows], BRANCH, rng)
        centres.append(c)
        child.append([0] * len(c))
        for k in range(len(c)):
            mine = rows[at == k]
            if len(mine) > leaf_size and len(mine) < len(rows):
                todo.append((mine, (node, k)))
            else:
                child[node][k] = -1 - leaves
                leaves += 1
    return Tree(centres, child, leaves)


def enough(ranks: list[int], recall: float) -> int:
    """The least number of bins that holds the share `recall` of neighbours, whose bins have these ranks from 0."""
    ranks = sorted(ranks)
    return ranks[min(len(ranks) - 1, int(np.ceil(recall * len(ranks))))] + 1 if ranks else 1


def usable(rows: DataFrame) -> DataFrame:
    """(vec_id, v, n): the rows that take part, v an array of doubles, n the number of rows that are alike."""
    v = F.col("embedding").cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & ~bad & F.exists("v", lambda x: x != 0))
    return rows.groupBy("vec_id", "v").agg(F.count(F.lit(1)).alias("n"))


def unit(v: np.ndarray) -> np.ndarray:
    v = v / np.maximum(np.abs(v).max(1, keepdims=True), 1e-300)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten()).reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def cosines(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Row-by-row cosines in double precision, scaled first so that no square overflows."""
    return (unit(q) * unit(x)).sum(1)


SCHEMA = "query_id long, rank int, vec_id long, score double"


def against(rows: DataFrame, centres: DataFrame, width: int, all_children: bool) -> DataFrame:
    """(id, v, leaf, near): the child of its leaf that each row of (leaf, part, id, v) is nearest to, or all of them.

    A row of centres has the leaf and its children's centres of `width` components one after another in v."""
    heads = centres.join(rows.select("leaf", "part").distinct(), "leaf").selectExpr("leaf", "part", "0 side", "cast(null as long) id", "v")
    met = heads.unionByName(rows.selectExpr("leaf", "part", "1 side", "id", "v"))
    met = met.repartition("leaf", "part").sortWithinPartitions("leaf", "part", "side", "id")

    def run(batches):
        centre = None
        for (leaf, _, side), t in groups(batches, ["leaf", "part", "side"]):
            if side == 0:
                centre = matrix(t.column("v")).reshape(-1, width)
                continue
            near = unit(matrix(t.column("v"))) @ centre.T
            child = np.tile(np.arange(len(centre)), (len(near), 1)) if all_children else near.argmax(1)[:, None]
            row = np.repeat(np.arange(len(near)), child.shape[1])
            v = pa.nulls(len(row), pa.list_(pa.float64())) if all_children else t.column("v").combine_chunks()
            yield pa.RecordBatch.from_arrays([t.column("id").combine_chunks().take(pa.array(row)), v, pa.array(leaf * FAN + child.ravel()), pa.array(near[row, child.ravel()])], names=["id", "v", "leaf", "near"])

    return met.mapInArrow(run, "id long, v array<double>, leaf long, near double")


def split(filed: DataFrame, width: int, leaf_rows: int) -> tuple[DataFrame, list[DataFrame]]:
    """filed (vec_id, v, leaf) with leaves of more than `leaf_rows` rows split until none is, or none gives way,
    and the centres of each level. At every level all leaves are numbered anew: leaf * FAN + child."""
    levels, before = [], None
    while True:
        big = hold(filed.groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > leaf_rows))
        left = big.agg(F.sum("n")).first()[0]
        if left is None or left == before or len(levels) == 8:
            return filed, levels
        mine, before = filed.join(big, "leaf"), left
        nth = F.row_number().over(Window.partitionBy("leaf").orderBy(F.xxhash64("vec_id"), "vec_id"))
        train = mine.withColumn("nth", nth).where(F.col("nth") <= FAN * TRAIN).select("leaf", "n", "vec_id", "v")

        def fit(batches):
            for (leaf, n), t in groups(batches, ["leaf", "n"]):
                c, _ = kmeans(unit(matrix(t.column("v"))), min(FAN, -(-n // leaf_rows)), np.random.default_rng(leaf))
                yield pa.RecordBatch.from_arrays([pa.array([leaf]), pa.array([c.ravel().tolist()])], names=["leaf", "v"])

        centres = hold(train.repartition("leaf").sortWithinPartitions("leaf", "n", "vec_id").mapInArrow(fit, "leaf long, v array<double>"))
        part = F.pmod(F.xxhash64("vec_id"), F.ceil(F.col("n") / F.lit(CELL))).cast("int").alias("part")
        moved = against(mine.select("leaf", part, F.col("vec_id").alias("id"), "v"), centres, width, False)
        rest = filed.join(big, "leaf", "left_anti").select("vec_id", "v", (F.col("leaf") * FAN).alias("leaf"))
        filed = hold(rest.union(moved.select("id", "v", "leaf")))
        levels.append(centres)


def neighbours_of(probes: list, filed: DataFrame, k: int) -> DataFrame:
    """(node, vec_id, leaf): the k nearest rows of each probe, by comparing it with every row."""
    ids, q = np.array([p["vec_id"] for p in probes]), unit(np.array([p["v"] for p in probes]))

    def run(batches):
        best = None
        for b in batches:
            vec, leaf, near = np.array(b.column(0)), np.array(b.column(2)), q @ unit(matrix(b.column(1))).T
            near[ids[:, None] == vec] = -2
            found = np.broadcast_to(vec, near.shape), np.broadcast_to(leaf, near.shape), near
            best = found if best is None else tuple(np.concatenate([x, y], 1) for x, y in zip(best, found, strict=True))
            top = np.argsort(-best[2], 1)[:, :k]
            best = tuple(np.take_along_axis(x, top, 1) for x in best)
        if best is not None:
            columns = [np.repeat(ids, best[0].shape[1]), *(x.ravel() for x in best)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["node", "vec_id", "leaf", "near"])

    found = filed.select("vec_id", "v", "leaf").mapInArrow(run, "node long, vec_id long, leaf long, near double").where("near > -2")
    nth = F.row_number().over(Window.partitionBy("node").orderBy(F.desc("near"), "vec_id"))
    return found.withColumn("nth", nth).where(F.col("nth") <= k).select("node", "vec_id", "leaf")


def in_order(found: DataFrame) -> DataFrame:
    """Each node's bins with their places in best-bin order, from 1."""
    return found.withColumn("nth", F.row_number().over(Window.partitionBy("node").orderBy(F.desc("near"), "leaf")))


def walk_top(nodes: DataFrame, tree: Tree, most: int) -> DataFrame:
    """(node, leaf, near): the first bins of the top for every row of (node, v)."""

    def walk(batches):
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                bins = [tree.best_bins(q, most) for q in unit(matrix(part.column(1)))]
                leaf, near = (pa.array([[x[i] for x in found] for found in bins]).flatten() for i in (0, 1))
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array(part.column(0)), list(map(len, bins)))), leaf, near], names=["node", "leaf", "near"])

    return nodes.select("node", "v").mapInArrow(walk, "node long, leaf long, near double")


def descend(found: DataFrame, nodes: DataFrame, centres: DataFrame, width: int, parts: int) -> DataFrame:
    """The bins (node, leaf, near) of one level below: those of split leaves give way to their children."""
    marked = found.join(centres.select("leaf", F.lit(True).alias("split")), "leaf", "left")
    still = marked.where("split is null").select("node", (F.col("leaf") * FAN).alias("leaf"), "near")
    part = F.pmod(F.xxhash64("node"), F.lit(parts)).cast("int").alias("part")
    asks = marked.where("split").select("node", "leaf").join(nodes, "node").select("leaf", part, F.col("node").alias("id"), "v")
    return still.union(against(asks, centres, width, True).select("id", "leaf", "near"))


def calibrate(probes: list, filed: DataFrame, tree: Tree, levels: list[DataFrame], k: int, recall: float) -> list[int]:
    """How many bins to keep at the top and at each level below for the share `recall` of the probes' true neighbours."""
    spark, depth = filed.sparkSession, len(levels)
    share = recall ** (1 / (depth + 1))
    true = neighbours_of(probes, filed, k).collect()  # k rows a probe
    probe = {p["vec_id"]: unit(np.array([p["v"]]))[0] for p in probes}
    ranks = {n: {leaf: i for i, (leaf, _) in enumerate(tree.best_bins(v, tree.leaves))} for n, v in probe.items()}
    visits = [enough([ranks[t["node"]][t["leaf"] // FAN**depth] for t in true], share)]
    if levels:
        nodes = spark.createDataFrame([(p["vec_id"], p["v"]) for p in probes], "node long, v array<double>")
        found = walk_top(nodes, tree, visits[0])
        for i, centres in enumerate(levels):
            found = hold(in_order(descend(found, nodes, centres, len(probes[0]["v"]), 1)))
            want = spark.createDataFrame([(t["node"], t["leaf"] // FAN ** (depth - i - 1)) for t in true], "node long, leaf long")
            visits.append(enough([r["nth"] - 1 for r in want.join(found, ["node", "leaf"]).select("nth").collect()], share))
            found = found.where(F.col("nth") <= visits[-1]).drop("nth")
    return visits


def search(rows: DataFrame, every: int = 50, k: int = 5, recall: float = 0.97, numbers: int = 1_280_000, leaves: int = 96, block: int = 1024, leaf_rows: int = 512) -> DataFrame:
    """query_id, rank, vec_id, score for every row whose vec_id is divisible by `every`; see the module's text.

    The top of the tree, of about `leaves` leaves and more, is fitted on at most `numbers` vector components,
    of the rows lowest in a hash order of their ids; leaves of more than `leaf_rows` rows are split again."""
    spark = rows.sparkSession
    rows = hold(usable(rows))
    widths = rows.groupBy(F.size("v").alias("width")).agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "width").take(2)
    if not widths:
        return spark.createDataFrame([], SCHEMA)
    width, others = widths[0]["width"], len(widths) > 1
    usual, own_bin = F.size("v") == width, (-F.size("v")).cast("long").alias("leaf")
    bound = max(64, numbers // max(1, width))
    chosen = rows.where(usual).orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(bound).select("vec_id", "v").collect()
    sample = unit(np.array([r["v"] for r in chosen]))
    tree = grow(sample, max(32, len(sample) // leaves))

    def file(batches):
        for b in batches:
            yield b.append_column("leaf", pa.array(tree.leaf_of(unit(matrix(b.column(1)))), pa.int64()))

    # every distinct vector stands for itself with its k + 1 least ids, each at most k + 1 times; map tasks keep no more of them
    least = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
    copies = F.sequence(F.lit(1), F.least("n", F.lit(k + 1)).cast("int"))
    standing = rows.withColumn("nth", least).where(F.col("nth") <= k + 1).select("vec_id", "v", F.explode(copies)).select("vec_id", "v")
    filed = hold(standing.where(usual).mapInArrow(file, "vec_id long, v array<double>, leaf long"))
    filed, levels = split(filed, width, leaf_rows)
    probes = list({r["vec_id"]: r for r in chosen}.values())[:PROBES]
    visits = calibrate(probes, filed, tree, levels, k, recall)
    if others:
        filed = hold(filed.union(standing.where(~usual).select("vec_id", "v", own_bin)))
    cells = hold(filed.groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / F.lit(CELL)).cast("int").alias("cells")))
    candidates = filed.join(cells, "leaf").select("leaf", F.pmod(F.xxhash64("vec_id"), F.col("cells")).cast("int").alias("cell"), F.lit(0).alias("side"), F.lit(0).alias("part"), F.col("vec_id").alias("id"), "v")
    asked = rows.where(F.col("vec_id") % every == 0)
    nodes = hold(asked.select("v").distinct().withColumn("node", F.monotonically_increasing_id()))
    parts = max(1, -(-nodes.count() // block))
    found = walk_top(nodes.where(usual), tree, visits[0])
    for centres, most in zip(levels, visits[1:], strict=True):
        found = in_order(descend(found, nodes, centres, width, parts)).where(F.col("nth") <= most).drop("nth")
    if others:
        found = found.union(nodes.where(~usual).select("node", own_bin, F.lit(1.0)))
    queries = (
        found.join(cells, "leaf")
        .join(nodes, "node")
        .select("leaf", F.explode(F.sequence(F.lit(0), F.col("cells") - 1)).alias("cell"), F.lit(1).alias("side"), F.pmod(F.xxhash64("node"), F.lit(parts)).cast("int").alias("part"), F.col("node").alias("id"), "v")
    )
    met = candidates.union(queries).repartition("leaf", "cell").sortWithinPartitions("leaf", "cell", "side", "part", "id")

    def kept(found: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
        """The k + 1 best of every query among what a task has found so far."""
        node, vec, score, same = (np.concatenate(c) for c in zip(*found, strict=True))
        order = np.lexsort((vec, -score, node))
        node, vec, score, same = node[order], vec[order], score[order], same[order]
        first = np.concatenate([[True], node[1:] != node[:-1]])
        nth = np.arange(len(node)) - np.flatnonzero(first)[np.cumsum(first) - 1]
        return node[nth <= k], vec[nth <= k], score[nth <= k], same[nth <= k]

    def best(batches):
        here, ids, x, found, rows = None, None, None, [], 0
        emit = lambda f: pa.RecordBatch.from_arrays([pa.array(c) for c in kept(f)], names=["node", "vec_id", "score", "same"])
        for (leaf, cell, side, _), t in groups(batches, ["leaf", "cell", "side", "part"]):
            v, own = matrix(t.column("v")), np.array(t.column("id"))
            if side == 0:
                here, ids, x, ux = (leaf, cell), own, v, unit(v)
                continue
            if here != (leaf, cell):
                continue
            near = unit(v) @ ux.T
            top = np.argsort(-near, 1, kind="stable")[:, : k + 9]
            q = np.repeat(np.arange(len(own)), top.shape[1])
            score = cosines(v[q], x[top.ravel()]).reshape(top.shape)
            order = np.lexsort((ids[top], -score), axis=1)[:, : k + 1]
            top, score = np.take_along_axis(top, order, 1).ravel(), np.take_along_axis(score, order, 1).ravel()
            q = np.repeat(np.arange(len(own)), order.shape[1])
            found.append((own[q], ids[top], score, (v[q] == x[top]).all(1)))
            rows += order.size
            if rows > 200_000:
                found = [kept(found)]
                rows = len(found[0][0])
                if rows > 150_000:  # many queries in one task: hand on what there is
                    yield emit(found)
                    found, rows = [], 0
        if found:
            yield emit(found)

    found = met.mapInArrow(best, "node long, vec_id long, score double, same boolean")
    rank = F.row_number().over(Window.partitionBy("node").orderBy(F.desc("score"), "vec_id"))
    found = found.withColumn("nth", rank).where(F.col("nth") <= k + 1).drop("nth")
    named = asked.join(nodes, "v").select(F.col("vec_id").alias("query_id"), "node", "n")
    out = named.join(found, "node").withColumn("own", F.col("same") & (F.col("query_id") == F.col("vec_id")))
    # of the rows that are alike, one is the query itself
    out = out.withColumn("nth", F.row_number().over(Window.partitionBy("node", "query_id", "own").orderBy("vec_id"))).where("not own or nth > 1")
    rank = F.row_number().over(Window.partitionBy("node", "query_id").orderBy(F.desc("score"), "vec_id"))
    out = out.withColumn("rank", rank).where(F.col("rank") <= k)
    # a row of the result for each of the query's rows, made in blocks so that no array grows with them
    out = out.withColumn("past", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(COPIES).cast("long"))))
    out = out.withColumn("copy", F.explode(F.sequence(F.lit(1), F.least(F.col("n") - F.col("past"), F.lit(COPIES)).cast("int"))))
    return out.select("query_id", "rank", "vec_id", "score")
