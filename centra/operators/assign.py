"""Assignment of points to their nearest center.

`by_expression` is a plain Column expression: the centers are one constant row, so there is no join and no row
for each pair. `assign` runs a NumPy kernel over Arrow batches, for many centers or many points. Both decide ties
by the lowest center.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from centra.functions.distance import Distance, named, nearest
from centra.operators.points import lists, literal, matrix


def ranked(v: Column, centers: Column, distance: Distance) -> Column:
    """ARRAY<STRUCT<d, cid>> over all centers."""
    return F.transform(centers, lambda c, i: F.struct(distance.column(v, c).alias("d"), i.cast("bigint").alias("cid")))


def by_expression(points: DataFrame, centers: np.ndarray, distance: str | Distance = "Euclidean", center_type: str | None = None) -> DataFrame:
    """id, v, cid, d. With center_type "int", centers are first truncated toward zero, as for integer data."""
    c = np.trunc(centers) if center_type == "int" else centers
    found = points.select("*", F.array_min(ranked(F.col("v"), literal(c), named(distance))).alias("nearest_"))
    return found.select(*points.columns, F.col("nearest_.cid").alias("cid"), F.col("nearest_.d").alias("d"))


def keep_ties(points: DataFrame, centers: np.ndarray, distance: str | Distance = "Euclidean") -> DataFrame:
    """id, v, cid, d for points that have a cid: they move only to a strictly nearer center."""
    all_ = ranked(F.col("v"), literal(centers), named(distance))
    found = points.select("*", all_.alias("all_")).select("*", F.array_min("all_").alias("best_"), F.element_at("all_", (F.col("cid") + 1).cast("int"))["d"].alias("own_"))
    moved = F.col("best_.d") < F.col("own_")
    return found.select(*[c for c in points.columns if c != "cid"], F.when(moved, F.col("best_.cid")).otherwise(F.col("cid")).alias("cid"), F.when(moved, F.col("best_.d")).otherwise(F.col("own_")).alias("d"))


def assign(points: DataFrame, centers: np.ndarray, distance: str | Distance = "Euclidean") -> DataFrame:
    """id, cid, d, by blocks of NumPy."""
    found = named(distance)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            best, d = nearest(matrix(b.column(1), centers.shape[1]), centers, found)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(best, pa.int64()), pa.array(d, pa.float64())], ["id", "cid", "d"])

    return points.select("id", "v").mapInArrow(run, "id bigint, cid bigint, d double")


def assigned(points: DataFrame, centers: np.ndarray, distance: str | Distance = "Euclidean") -> DataFrame:
    """id, v, cid, d, by blocks of NumPy; also of a stream."""
    found = named(distance)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            best, d = nearest(matrix(b.column(1), centers.shape[1]), centers, found)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(best, pa.int64()), pa.array(d, pa.float64())], ["id", "v", "cid", "d"])

    return points.select("id", F.col("v").cast("array<double>").alias("v")).mapInArrow(run, "id bigint, v array<double>, cid bigint, d double")


def top2_by_group(points: DataFrame, centers: np.ndarray, groups: list[int], distance: str | Distance = "Euclidean") -> DataFrame:
    """id, group_id, place (1 and 2), cid, d: the two nearest centers of each group."""
    of = F.array(*[F.lit(g).cast("bigint") for g in groups])
    every = points.select("id", F.array_sort(ranked(F.col("v"), literal(centers), named(distance))).alias("all_"))
    each = every.select("id", F.explode(F.array_distinct(of)).alias("group_id"), "all_")
    two = each.select("id", "group_id", F.slice(F.filter("all_", lambda s: F.get(of, s["cid"].cast("int")) == F.col("group_id")), 1, 2).alias("two_"))
    return two.select("id", "group_id", F.posexplode("two_").alias("place_", "s_")).select("id", "group_id", (F.col("place_") + 1).alias("place"), F.col("s_.cid").alias("cid"), F.col("s_.d").alias("d"))


def best_two(points: DataFrame, centers: np.ndarray, distance: str | Distance = "Euclidean") -> DataFrame:
    """id, best, d_best, second, d_second over all centers."""
    two = points.select("id", F.slice(F.array_sort(ranked(F.col("v"), literal(centers), named(distance))), 1, 2).alias("t"))
    at = lambda i, f: F.get("t", F.lit(i))[f]
    return two.select("id", at(0, "cid").alias("best"), at(0, "d").alias("d_best"), at(1, "cid").alias("second"), at(1, "d").alias("d_second"))


def rotate(points: DataFrame, rotation: np.ndarray) -> DataFrame:
    """id, v: every vector times the rotation (rows of the matrix are the new axes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), lists(matrix(b.column(1), rotation.shape[1]) @ rotation.T)], ["id", "v"])

    return points.select("id", "v").mapInArrow(run, "id bigint, v array<double>")
