"""Center updates: means of the assigned points.

Means are aggregates with partial sums, so a large cluster is no hot key. An empty cluster keeps its center.
Assigned points are (id, v, cid).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from centra.operators.points import centers_frame, matrix, sums


def group_mean(assigned: DataFrame, centers: np.ndarray) -> DataFrame:
    """cid, pos, value: means by built-in aggregates; one row for every coordinate of every center."""
    spark = assigned.sparkSession
    means = assigned.select("cid", F.posexplode("v").alias("pos", "x")).groupBy("cid", "pos").agg(F.avg("x").alias("mean"))
    old = centers_frame(spark, centers).select("cid", F.posexplode("c").alias("pos", "old"))
    return old.join(means, ["cid", "pos"], "left").select("cid", "pos", F.coalesce("mean", "old").alias("value"))


def mean_matrix(assigned: DataFrame, centers: np.ndarray, parts: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """New centers and members of each, by sums in NumPy: one pass, no shuffle of points."""
    k, d = centers.shape

    def partial(batches: Iterator[pa.RecordBatch]) -> np.ndarray | None:
        total = np.zeros((k, d + 1))
        for b in batches:
            x, cid = matrix(b.column(0), d), b.column(1).to_numpy()
            np.add.at(total, cid, np.column_stack([x, np.ones(len(x))]))
        return total

    total = sums(assigned.select("v", "cid"), partial, k, d + 1, parts)
    return means(total[:, :d], total[:, d], centers)


def means(total: np.ndarray, count: np.ndarray, old: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    filled = count > 0
    new = old.copy()
    new[filled] = total[filled] / count[filled, None]
    return new, count.astype("i8")


def incremental_mean(moved: DataFrame, centers: np.ndarray, counts: np.ndarray, only_changed: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """New centers from the points that changed (id, v, old_cid, cid): (c n_old + joined - left) / n_new.

    Only rows whose cid changed are read from the sum; with `only_changed`, centers that none joined or left are
    copied as they are, otherwise recomputed from their own sum, which is the same but for rounding.
    """
    k, d = centers.shape
    changed = moved.where("old_cid <> cid")

    def partial(batches: Iterator[pa.RecordBatch]) -> np.ndarray | None:
        total = np.zeros((k, d + 2))
        for b in batches:
            x, old, new = matrix(b.column(0), d), b.column(1).to_numpy(), b.column(2).to_numpy()
            one = np.ones((len(x), 1))
            np.add.at(total, new, np.column_stack([x, one, one]))
            np.add.at(total, old, np.column_stack([-x, -one, one]))
        return total

    delta = sums(changed.select("v", "old_cid", "cid"), partial, k, d + 2)
    n_new = counts + delta[:, d]
    out = centers.copy()
    at = (n_new > 0) & ((delta[:, d + 1] > 0) | (not only_changed))
    out[at] = (centers[at] * counts[at, None] + delta[at, :d]) / n_new[at, None]
    return out, n_new.astype("i8")


def incremental_rows(moved: DataFrame, centers: np.ndarray, counts: np.ndarray) -> DataFrame:
    """The same as cid, pos, value, by built-in aggregates over signed rows."""
    spark = moved.sparkSession
    changed = moved.where("old_cid <> cid")
    signed = changed.select(F.col("cid").alias("cid"), F.lit(1.0).alias("sign"), "v").unionAll(changed.select(F.col("old_cid").alias("cid"), F.lit(-1.0).alias("sign"), "v"))
    delta = signed.select("cid", "sign", F.posexplode("v").alias("pos", "x")).groupBy("cid", "pos").agg(F.sum(F.col("sign") * F.col("x")).alias("dx"), F.sum("sign").alias("dn"))
    old = spark.createDataFrame([(i, [float(x) for x in row], float(counts[i])) for i, row in enumerate(centers)], "cid bigint, c array<double>, n double").select("cid", "n", F.posexplode("c").alias("pos", "old"))
    n_new = F.col("n") + F.coalesce("dn", F.lit(0.0))
    return old.join(delta, ["cid", "pos"], "left").select("cid", "pos", F.when(n_new > 0, (F.col("old") * F.col("n") + F.coalesce("dx", F.lit(0.0))) / n_new).otherwise(F.col("old")).alias("value"))


def member_count(assigned: DataFrame, k: int) -> DataFrame:
    """cid, n for all k centers, 0 where there is no member."""
    spark: SparkSession = assigned.sparkSession
    return spark.range(k).select(F.col("id").alias("cid")).join(assigned.groupBy("cid").agg(F.count("*").alias("n")), "cid", "left").select("cid", F.coalesce("n", F.lit(0)).alias("n"))


def group_points(assigned: DataFrame) -> DataFrame:
    """cid, ids in order. The list is the result that is asked for; averages never need it."""
    return assigned.groupBy("cid").agg(F.sort_array(F.collect_list("id")).alias("ids"))


def sorted_runs(assigned: DataFrame) -> DataFrame:
    """Points dealt by cid and sorted within partitions: the sort-based grouping, whose runs need no list in memory."""
    return assigned.repartition("cid").sortWithinPartitions("cid", "id")
