"""The measuring modes: whole runs, two runs compared, initializers, assignment, update and grouping by themselves."""

from __future__ import annotations

from time import perf_counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from centra.operators import assign, update
from centra.operators.init import cyclic, initialize
from centra.operators.points import crop, first_k
from centra.plans.lloyd import Result
from centra.plans.runlog import InitLog
from centra.plans.runners import cluster, init_log


def full(points: DataFrame, k: int, init: str = "MacQueen", runner: str = "Naive", distance: str = "Euclidean", max_iter: int = 1000, epsilon: float = 0.0) -> Result:
    centers, start = initialize(points, k, init, distance)
    return cluster(points, centers, runner, distance, max_iter, epsilon, start, init)


def compare(points: DataFrame, k: int, runners: tuple[str, str] = ("NaiveKmeans2", "YinyangImproved"), max_iter: int = 10, epsilon: float = 0.0, distance: str = "Euclidean") -> dict:
    """Two runners from the same first-k start, each with its own copy of it: their results, and on how many points they differ."""
    centers, start = initialize(points, k, "Lazy", distance)
    a, b = (cluster(points, centers.copy(), r, distance, max_iter, epsilon, start, "Lazy") for r in runners)
    differ = a.assignment.join(b.assignment.withColumnRenamed("cid", "other"), "id").where("cid <> other").count()
    return {"results": (a, b), "differ": differ, "times": (a.log.total_time, b.log.total_time)}


def inits(points: DataFrame, k: int, methods: list[str], distance: str = "Euclidean") -> list[InitLog]:
    return [init_log(points, k, m, distance)[0] for m in methods]


def _seconds(frame: DataFrame) -> float:
    began = perf_counter()
    frame.write.format("noop").mode("overwrite").save()
    return perf_counter() - began


def assignment(points: DataFrame, k: int, n: int | None = None, distance: str = "Euclidean") -> dict[str, float]:
    """Seconds of one assignment to float centers, and to centers truncated to integers."""
    own = crop(points, n) if n else points
    centers = first_k(own, k)
    return {"float": _seconds(assign.assign(own, centers, distance)), "truncated": _seconds(assign.assign(own, np.trunc(centers), distance))}


def updates(points: DataFrame, k: int, sizes: list[int] | None = None) -> list[dict]:
    """Seconds of grouping and of the forms of the mean, for each size n."""
    rows = []
    for n in sizes or [points.count()]:
        own = cyclic(crop(points, n), k).persist()
        centers = np.zeros((k, len(own.first()["v"])))
        began = perf_counter()
        update.mean_matrix(own, centers)
        sums = perf_counter() - began
        rows.append({"n": n, "N": own.count(), "group": _seconds(update.group_points(own)), "add1": _seconds(update.group_mean(own, centers)), "add2": sums})
        own.unpersist()
    return rows


def updates_csv(rows: list[dict], d: int, k: int) -> str:
    lines = [f"d,{d}", f"k,{k}", "n, N, group, add1, add2"]
    return "\n".join([*lines, *(", ".join(str(r[c]) for c in ("n", "N", "group", "add1", "add2")) for r in rows)]) + "\n"


def grouping(points: DataFrame, k: int) -> dict[str, float]:
    """Seconds of grouping by lists and by sorted runs."""
    own = cyclic(points, k).persist()
    own.count()
    out = {"lists": _seconds(update.group_points(own)), "sorted": _seconds(update.sorted_runs(own.select("id", "cid")))}
    own.unpersist()
    return out


def sweep(points: DataFrame, ks: list[int], runners: list[str], init: str = "LSH", max_iter: int = 5) -> DataFrame:
    """(k, method, time, msse) over a matrix of runs."""
    rows = []
    for k in ks:
        for runner in runners:
            log = full(points, k, init, runner, max_iter=max_iter).log
            rows.append((k, runner, log.total_time, log.iterations[-1].msse if log.iterations else 0.0))
    return points.sparkSession.createDataFrame(rows, "k int, method string, time double, msse double").select("k", "method", F.col("time"), F.col("msse"))
