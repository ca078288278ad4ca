"""Connected components of an edge table."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.operators.skew import shuffled
from sievework.session import cut

#: Edges up to this number are joined up by one task; more are contracted first, however many there are.
TASK_EDGES = 2_000_000


def union(table: pa.Table) -> pa.Table:
    """The component of each node of an edge table (src, dst) in memory, nodes ascending."""
    a, b = table["src"].to_numpy(), table["dst"].to_numpy()
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    parent = np.arange(len(nodes))
    u, v = ends[: len(a)], ends[len(a) :]
    while True:  # hook each root to the least root across an edge, then halve paths
        pu, pv = parent[u], parent[v]
        apart = pu != pv
        if not apart.any():
            break
        high, low = np.maximum(pu, pv)[apart], np.minimum(pu, pv)[apart]
        np.minimum.at(parent, high, low)
        while True:
            up = parent[parent]
            if np.array_equal(up, parent):
                break
            parent = up
    return pa.table({"node": nodes, "component": nodes[parent]})


def connected_components(edges: DataFrame, task_edges: int = TASK_EDGES, seed: int = 7) -> DataFrame:
    """The component of each node of an edge table (src, dst bigint), named by its least node: columns node, component.

    Direction, repeats and loops don't matter; edges with a null end are left out; no edges give no rows.
    While there are more than task_edges edges, each node is contracted into that neighbour (or itself) whose hash under a seed of
    the round is least. This takes about log(nodes) rounds for any shape, long chains too, and no round gathers a node's neighbours:
    minima are taken on the map side first. Each round's tables are cut in the shared folder. Nothing comes to the driver but counts.
    """
    spark = edges.sparkSession
    now = cut(edges.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).where("src IS NOT NULL AND dst IS NOT NULL").distinct())
    # a loop only says that its node is there
    alone = now.where("src = dst").select(F.col("src").alias("node"))
    now = now.where("src <> dst")
    n, rounds = now.count(), []
    while n > task_edges:
        key = F.xxhash64(F.lit(seed + len(rounds)), "other")
        both = now.select(F.col("src").alias("node"), F.col("dst").alias("other")).unionByName(now.select(F.col("dst").alias("node"), F.col("src").alias("other")))
        own = both.select("node", F.col("node").alias("other"))
        into = cut(both.unionByName(own).groupBy("node").agg(F.min_by("other", F.struct(key, F.col("other"))).alias("into")))
        rounds.append(into)
        at = lambda end: into.select(F.col("node").alias(end), F.col("into").alias(f"{end}_into"))
        now = cut(
            now.join(shuffled(at("src")), "src").join(shuffled(at("dst")), "dst").where("src_into <> dst_into")
            .select(F.least("src_into", "dst_into").alias("src"), F.greatest("src_into", "dst_into").alias("dst")).distinct()
        )
        n = now.count()
    found = now.groupBy(F.lit(1).alias("one")).applyInArrow(union, "node bigint, component bigint") if n else spark.createDataFrame([], "node bigint, component bigint")
    for into in reversed(rounds):
        found = into.join(shuffled(found.withColumnRenamed("node", "into")), "into", "left").select("node", F.coalesce("component", "into").alias("component"))
    if rounds:  # names so far are whichever node was left
        found = cut(found)
        least = found.groupBy("component").agg(F.min("node").alias("least"))
        found = found.join(shuffled(least), "component").select("node", F.col("least").alias("component"))
    return found.unionByName(alone.join(shuffled(found.select("node")), "node", "left_anti").select("node", F.col("node").alias("component")))
