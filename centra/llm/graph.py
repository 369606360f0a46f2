"""Connected components of a graph given as edges, by alternating large and small stars.

Every step is a minimum per node (summed before the shuffle) and a join of edges with those minima. The
minima are written before the join, so both sides of it are shuffled for it alone and Spark can split the
partition of a node with very many edges. Nothing but two numbers a round reaches the driver. A graph of up to SMALL
edges is one task's work instead, which gives the same.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from centra.llm.shared import cut


#: Edges that one task joins by itself.
SMALL = 200_000


def _sum(edges: DataFrame) -> tuple[int, int]:
    """Count and an order-free checksum."""
    row = edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
    return row[0], int(row[1])


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """u points to v, which is smaller, in and out."""
    sides = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = cut(sides.groupBy(F.col("u").alias("of")).agg(F.min("v").alias("least")).withColumn("least", F.least("of", "least")))
    joined = sides.join(least, F.col("u") == F.col("of"))
    if large:
        moved = joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("least").alias("v"))
    else:
        own = least.select(F.col("of").alias("u"), F.col("least").alias("v"))
        moved = joined.select(F.col("v").alias("u"), F.col("least").alias("v")).where(F.col("u") != F.col("v")).unionAll(own)
    return moved.where(F.col("u") != F.col("v")).distinct()


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All edges (u, v) to (node, root)."""
    u, v = (np.concatenate([np.zeros(0, "i8"), *c]) for c in zip(*[(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches], (np.zeros(0, "i8"),) * 2, strict=True))
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    root = np.arange(len(nodes))
    while len(a):
        np.minimum.at(root, np.maximum(root[a], root[b]), np.minimum(root[a], root[b]))
        while not np.array_equal(jumped := root[root], root):
            root = jumped
        apart = root[a] != root[b]
        a, b = a[apart], b[apart]
    moved = np.flatnonzero(root != np.arange(len(root)))
    yield pa.RecordBatch.from_arrays([pa.array(nodes[moved], pa.int64()), pa.array(nodes[root[moved]], pa.int64())], ["node", "root"])


def components(edges: DataFrame) -> DataFrame:
    """(u, v) pairs of bigint to (node, root): the smallest node that each node of an edge can reach; a root's own row is not in it."""
    now = cut(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where(F.col("u") != F.col("v")).distinct())
    seen = _sum(now)
    if seen[0] <= SMALL:
        return cut(now.coalesce(1).mapInArrow(_whole, "node bigint, root bigint"))
    while seen[0]:
        now = cut(_star(cut(_star(now, True)), False))
        was, seen = seen, _sum(now)
        if was == seen:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
