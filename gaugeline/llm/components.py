"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeline.llm.common import hold


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(v, root) for every node of the edges (u, v), two long columns: root is the component's least node.

    First the edges of a node to several lesser ones are replaced by one to the least of them and by edges
    between those, of which a large group has few. Each round takes the least label among a node's neighbours
    and then the label of that label, so that a path shortens by more than half a round. Only a flag per round
    reaches the driver; labels are cut with a shared checkpoint. Edges to a node of many are plain rows of a
    join, which Spark splits when they are skewed. Nulls and loops are left out; no edges give no rows.
    """
    e = edges.where("u is not null and v is not null and u != v")
    e = hold(e.select(F.least("u", "v").alias("lesser"), F.greatest("u", "v").alias("node")).distinct())
    least = e.groupBy("node").agg(F.min("lesser").alias("least"))
    e = e.join(least, "node").where("lesser != least").select(F.col("least").alias("u"), F.col("lesser").alias("v")).union(least.select("least", "node"))
    e = hold(e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    labels = hold(e.groupBy(F.col("u").alias("v")).agg(F.least(F.min("v"), F.first("u")).alias("root")))
    for _ in range(rounds):
        near = e.join(labels, "v").groupBy(F.col("u").alias("v")).agg(F.min("root").alias("near"))
        least = labels.join(near, "v").select("v", F.col("root").alias("was"), F.least("root", "near").alias("root"))
        up = labels.select(F.col("v").alias("root"), F.col("root").alias("up"))
        labels = hold(least.join(up, "root").select("v", F.least("root", "up").alias("root"), "was"))
        changed = labels.agg(F.coalesce(F.bool_or(F.col("root") != F.col("was")), F.lit(False))).first()[0]
        labels = labels.select("v", "root")
        if not changed:
            return labels
    raise RuntimeError(f"labels still change after {rounds} rounds")
