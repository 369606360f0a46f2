"""All runners by name, under one call."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from centra.operators import assign as assignment
from centra.operators.init import initialize
from centra.plans import quantized
from centra.plans.ball import ball
from centra.plans.lloyd import Policy, Result, StopRule, lloyd
from centra.plans.runlog import InitLog, RunLog
from centra.plans.yinyang import yinyang

POLICIES = {
    "Naive": Policy(StopRule("max"), keep_ties=True),
    "NaiveKmeans": Policy(StopRule("sum")),
    "NaiveKmeans2": Policy(StopRule("max"), msse_after=True),
    "YinyangSimp": Policy(StopRule("sum", sqrt=True)),
    "YinyangImproved": Policy(StopRule("max", sqrt=True)),
    "YinyangFaithful": Policy(StopRule("sum", strict=True)),
    "BallKmeans": Policy(StopRule("max"), msse_after=True),
    "Quantized": Policy(StopRule("max"), msse_after=True),
    "LSHQuantized": Policy(StopRule("sum", sqrt=True)),
    "PQ": Policy(StopRule("max"), msse_after=True),
}


def _noop(points: DataFrame, centers: np.ndarray, start: DataFrame | None, log: RunLog) -> Result:
    own = start if start is not None else points.select("id", F.pmod("id", F.lit(len(centers))).cast("bigint").alias("cid"))
    return Result(centers.copy(), own, log, [centers])


RUNNERS: dict[str, Callable[..., Result]] = {
    "Lazy": lambda p, c, s, pol, dist, iters, e, log, **o: _noop(p, c, s, log),
    "Naive": lambda p, c, s, pol, dist, iters, e, log, **o: lloyd(p, c, s, pol, dist, iters, e, log),
    "NaiveKmeans": lambda p, c, s, pol, dist, iters, e, log, **o: lloyd(p, c, s, pol, dist, iters, e, log),
    "NaiveKmeans2": lambda p, c, s, pol, dist, iters, e, log, **o: lloyd(p, c, s, pol, dist, iters, e, log),
    "YinyangSimp": lambda p, c, s, pol, dist, iters, e, log, **o: yinyang(p, c, pol, dist, iters, e, log, **o),
    "YinyangImproved": lambda p, c, s, pol, dist, iters, e, log, **o: yinyang(p, c, pol, dist, iters, e, log, **o),
    "YinyangFaithful": lambda p, c, s, pol, dist, iters, e, log, **o: yinyang(p, c, pol, dist, iters, e, log, **({"t": min(4, len(c)), "local": True} | o)),
    "BallKmeans": lambda p, c, s, pol, dist, iters, e, log, **o: ball(p, c, pol, dist, iters, e, log, **o),
    "Quantized": lambda p, c, s, pol, dist, iters, e, log, **o: quantized.cartesian(p, len(c), pol, iters, e, log, **o),
    "LSHQuantized": lambda p, c, s, pol, dist, iters, e, log, **o: quantized.lsh_code(p, c, pol, iters, e, log, **o),
    "PQ": lambda p, c, s, pol, dist, iters, e, log, **o: quantized.pq(p, c, pol, dist, iters, e, log, **o),
    "StandardQuantized": lambda p, c, s, pol, dist, iters, e, log, **o: quantized.pq(p, c, pol, dist, iters, e, log, **({"m": 4, "kstar": 64} | o)),
}


def cluster(points: DataFrame, centers: np.ndarray, runner: str = "NaiveKmeans", distance: str = "Euclidean", max_iter: int = 1000, epsilon: float = 0.0, start: DataFrame | None = None, init: str = "", **options) -> Result:
    """Centers, the assignment (id, cid) and the log of one run. `start` is the initializer's assignment."""
    if runner not in RUNNERS:
        raise ValueError(f"unknown runner {runner!r}; known: {sorted(RUNNERS)}")
    centers = np.asarray(centers, "f8")
    log = RunLog(points.count(), centers.shape[1], len(centers), runner, init, max_iter, epsilon)
    return RUNNERS[runner](points, centers, start, POLICIES.get(runner, POLICIES["PQ"]), distance, max_iter, epsilon, log, **options)


def fit(points: DataFrame, k: int, init: str = "MacQueen", runner: str = "Naive", distance: str = "Euclidean", max_iter: int = 1000, epsilon: float = 0.0, seed: int = 0, **options) -> Result:
    centers, start = initialize(points, k, init, distance, seed)
    return cluster(points, centers, runner, distance, max_iter, epsilon, start, init, **options)


def msse(points: DataFrame, centers: np.ndarray, assigned: DataFrame, distance: str = "Euclidean") -> float:
    """The mean distance of the points to the centers that they are assigned to."""
    from centra.functions.distance import named
    from centra.operators.points import centers_frame

    own = points.join(assigned.select("id", "cid"), "id").join(F.broadcast(centers_frame(points.sparkSession, centers)), "cid")
    return own.agg(F.avg(named(distance).column(F.col("v"), F.col("c")))).first()[0]


def init_log(points: DataFrame, k: int, method: str, distance: str = "Euclidean", seed: int = 0) -> tuple[InitLog, np.ndarray, DataFrame]:
    """Times an initializer and measures its result."""
    from time import perf_counter

    t = perf_counter()
    centers, start = initialize(points, k, method, distance, seed)
    start = start.persist()
    n = start.count()
    took = perf_counter() - t
    return InitLog(n, centers.shape[1], k, method, took, msse(points, centers, start, distance), [("total", took)]), centers, start


__all__ = ["POLICIES", "RUNNERS", "assignment", "cluster", "fit", "init_log", "msse"]
