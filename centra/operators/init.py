"""Initializers: each gives k centers and an assignment of the points.

Random ones take a seed. Draws that need a number for each point mix the point's id in integers, so any engine can
repeat them. Ids are 0 to n - 1.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from centra.functions.distance import Distance, named, nearest
from centra.operators import assign as assignment
from centra.operators import lsh
from centra.operators.points import first_k, matrix
from centra.operators.update import group_mean, mean_matrix

Start = tuple[np.ndarray, DataFrame]


def cyclic(points: DataFrame, k: int) -> DataFrame:
    return points.withColumn("cid", F.pmod(F.col("id"), F.lit(k)).cast("bigint"))


def drawn(k: int, seed: int = 12345) -> Column:
    """A repeatable draw from 0 to k - 1 for each id."""
    return F.pmod(F.pmod(F.col("id") * F.lit(1103515245) + F.lit(seed), F.lit(2147483648)).bitwiseXOR(F.lit(seed)) % F.lit(1000003), F.lit(k)).cast("bigint")


def _zeros(points: DataFrame, k: int) -> np.ndarray:
    first = points.select(F.size("v")).first()
    if first is None:
        raise ValueError("there are no points")
    return np.zeros((k, first[0]))


def forgy(points: DataFrame, k: int, distance: str | Distance = "Euclidean", seed: int = 0) -> Start:
    """Means of the classes id mod k."""
    own = cyclic(points, k)
    return mean_matrix(own, _zeros(points, k))[0], own.select("id", "cid")


def forgy_random(points: DataFrame, k: int, distance: str | Distance = "Euclidean", seed: int = 12345) -> Start:
    """Means of classes drawn for each point."""
    own = points.withColumn("cid", drawn(k, seed))
    return mean_matrix(own, _zeros(points, k))[0], own.select("id", "cid")


def macqueen(points: DataFrame, k: int, distance: str | Distance = "Euclidean", seed: int = 0) -> Start:
    """The first k points, and each point with the nearest of them."""
    centers = first_k(points, k)
    return centers, assignment.assign(points, centers, distance).select("id", "cid")


def lazy(points: DataFrame, k: int, distance: str | Distance = "Euclidean", seed: int = 0) -> Start:
    """The first k points, and the classes id mod k."""
    return first_k(points, k), cyclic(points, k).select("id", "cid")


def uniforms(k: int, seed: int) -> list[float]:
    return [float(x) for x in np.random.default_rng(seed).random(k)]


def scan_pick(weighted: DataFrame, u: float, total: float | None = None) -> int:
    """The largest id whose exclusive prefix sum of w, by id, is at most u times the sum of all.

    Sums of ranges of SCAN ids come first (one row a range reaches the driver), then the rows of the one range
    that holds the position, so no task scans all points in order.
    """
    ranges = weighted.groupBy(F.floor(F.col("id") / SCAN).cast("bigint").alias("part")).agg(F.sum("w").alias("w")).orderBy("part").collect()
    total = sum(r[1] for r in ranges) if total is None else total
    position, before, part = u * total, 0.0, ranges[0][0]
    for r in ranges:
        if before <= position:
            part, start = r[0], before
        before += r[1]
    own = weighted.where((F.col("id") >= part * SCAN) & (F.col("id") < (part + 1) * SCAN)).select("id", "w").toArrow()
    ids, w = own["id"].to_numpy(), own["w"].to_numpy()
    order = np.argsort(ids, kind="stable")
    excl = start + np.concatenate([np.zeros(1), np.cumsum(w[order])[:-1]])
    return int(ids[order][excl <= position][-1])


#: Ids in a range of `scan_pick`.
SCAN = 20_000


def weights(points: DataFrame, centers: np.ndarray, distance: Distance, known: bool = False) -> DataFrame:
    """id, v, w: the distance to the nearest center, or the known w if that is less."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            w = nearest(matrix(b.column(1), centers.shape[1]), centers, distance)[1]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(np.minimum(w, b.column(2).to_numpy()) if known else w, pa.float64())], ["id", "v", "w"])

    return points.select("id", "v", *(["w"] if known else [])).mapInArrow(run, "id bigint, v array<double>, w double")


def kmeans_plus_plus(points: DataFrame, k: int, distance: str | Distance = "Euclidean", seed: int = 0, draws: list[float] | None = None) -> Start:
    """D2 sampling, one center after another.

    A round compares each point with the centers since the last REBUILD rounds, which are sent to the tasks as a matrix, and with the
    weight kept from before. That frame is computed from the points and all centers so far every time, so no plan grows with k.
    """
    draws = draws or uniforms(k, seed)
    n, metric = points.count(), named("Euclidean")
    vector = lambda i: points.where(F.col("id") == i).select("v").first()[0]
    centers = [vector(min(n - 1, int(draws[0] * n)))]
    kept = weights(points, np.array(centers, "f8"), metric).persist()
    since = 1
    for u in draws[1:k]:
        own = kept if len(centers) == since else weights(kept, np.array(centers[since:], "f8"), metric, True)
        centers.append(vector(scan_pick(own.select("id", "w"), u)))
        if len(centers) - since >= REBUILD:
            again = weights(points, np.array(centers, "f8"), metric).persist()
            again.count()
            kept.unpersist()
            kept, since = again, len(centers)
    kept.unpersist()
    found = np.array(centers, "f8")
    return found, assignment.assign(points, found, distance).select("id", "cid")


#: Rounds after which the weights are computed from the points again.
REBUILD = 32


def lsh_chunks(points: DataFrame, k: int, distance: str | Distance = "Euclidean", seed: int = 0, planes: np.ndarray | None = None, exact: bool = True) -> Start:
    """Points in the order of their hash are cut into k equal chunks; centers are the chunks' means."""
    n = points.count()
    if exact and n % k:
        raise ValueError(f"{n} points cannot be cut into {k} equal chunks")
    if planes is None:
        planes = lsh.hyperplanes(len(points.select("v").first()[0]), lsh.PLANES, seed)
    own = chunked(points, k, n, planes)
    return mean_matrix(own, np.zeros((k, planes.shape[1])))[0], own.select("id", "cid")


def chunked(points: DataFrame, k: int, n: int, planes: np.ndarray) -> DataFrame:
    """id, v, hash, cid."""
    placed = lsh.ranks(points.withColumn("hash", lsh.hash_of(F.col("v"), planes)), "hash", "id")
    return placed.withColumn("cid", F.floor(F.col("place") * k / n).cast("bigint")).drop("place")


def stratified(n: int, k: int, seed: int = 0) -> list[int]:
    """One id from each of k equal ranges."""
    rng = np.random.default_rng(seed)
    edges = [i * n // k for i in range(k + 1)]
    return [int(rng.integers(a, b)) for a, b in zip(edges, edges[1:], strict=False) if b > a]


INITIALIZERS: dict[str, Callable[..., Start]] = {"Forgy": forgy, "ForgyRandom": forgy_random, "MacQueen": macqueen, "Lazy": lazy, "LazyStart": lazy, "KmeansPlusPlus": kmeans_plus_plus, "LSH": lsh_chunks}


def initialize(points: DataFrame, k: int, method: str = "Lazy", distance: str | Distance = "Euclidean", seed: int = 0) -> Start:
    """Centers (k x d) and the assignment (id, cid)."""
    if k < 1:
        raise ValueError("k must be at least 1")
    if method not in INITIALIZERS:
        raise ValueError(f"unknown initializer {method!r}; known: {sorted(INITIALIZERS)}")
    return INITIALIZERS[method](points, k, distance=named(distance), seed=seed)


__all__ = ["INITIALIZERS", "Start", "group_mean", "initialize"]
