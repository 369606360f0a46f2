"""Lloyd iterations under the stop rules and measures of the plain runners.

An iteration is one job: every partition assigns its points to the broadcast centers and sums them by center; the
driver gets k rows. Points are neither shuffled nor rewritten. The squared error after the update follows from the
sums, so it takes no second pass.

Only the rule that keeps a point at its center in a tie needs a state of the points: their frame is made anew from the last one, and written
out every CUT_EVERY iterations. Nested any deeper, the plans of the frames take longer with every iteration, and a lost executor costs more of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from time import perf_counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from centra.durable import cut
from centra.functions.distance import Distance, named, nearest
from centra.operators import assign as assignment
from centra.operators.points import lists, matrix, sums
from centra.operators.update import means
from centra.plans.runlog import RunLog


#: Iterations after which a state that travels with the points is written out.
CUT_EVERY = 4


@dataclass(frozen=True)
class StopRule:
    """Movement of centers, summed or the greatest, squared or not, at most (or under) epsilon."""

    kind: str = "sum"
    sqrt: bool = False
    strict: bool = False

    def movement(self, new: np.ndarray, old: np.ndarray) -> np.ndarray:
        squared = ((new - old) ** 2).sum(1)
        return np.sqrt(squared) if self.sqrt else squared

    def stops(self, movement: np.ndarray, epsilon: float) -> bool:
        moved = float(movement.sum() if self.kind == "sum" else movement.max(initial=0.0))
        return moved < epsilon if self.strict else moved <= epsilon


@dataclass(frozen=True)
class Policy:
    stop: StopRule
    msse_after: bool = False
    keep_ties: bool = False


@dataclass
class Result:
    centers: np.ndarray
    assignment: DataFrame
    log: RunLog
    history: list[np.ndarray]

    @property
    def iteration_log(self) -> DataFrame:
        return self.log.iteration_frame(self.assignment.sparkSession)

    @property
    def run_log(self) -> DataFrame:
        return self.log.run_frame(self.assignment.sparkSession)


def _after(total: np.ndarray, count: np.ndarray, error: float, old: np.ndarray, new: np.ndarray, distance: Distance) -> float:
    """The summed distance to the new centers, from the sums of the members and the summed distance to the old ones."""
    if distance.name.lower() == "mips":
        return float(-(total * new).sum())
    return error - float((count[:, None] * (new - old) ** 2).sum())


def assign_and_sum(points: DataFrame, centers: np.ndarray, distance: Distance, parts: int | None) -> tuple[np.ndarray, np.ndarray, float]:
    """Sums, counts and the summed distance of the points by their nearest center."""
    k, d = centers.shape

    def partial(batches: Iterator[pa.RecordBatch]) -> np.ndarray | None:
        total = np.zeros((k, d + 2))
        for b in batches:
            x = matrix(b.column(0), d)
            best, dist = nearest(x, centers, distance)
            # Sorted by center, members are summed run by run.
            order = np.argsort(best, kind="stable")
            keys, at = np.unique(best[order], return_index=True)
            if len(keys):
                total[keys] += np.add.reduceat(np.column_stack([x, np.ones(len(x)), dist])[order], at, axis=0)
        return total

    total = sums(points.select("v"), partial, k, d + 2, parts)
    return total[:, :d], total[:, d], float(total[:, d + 1].sum())


def keep_tie_step(state: DataFrame, centers: np.ndarray, distance: Distance) -> DataFrame:
    """id, v, cid, d, moved: a point leaves its center only for a strictly nearer one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, own = matrix(b.column(1), centers.shape[1]), b.column(2).to_numpy()
            best, dist = nearest(x, centers, distance, own)
            yield pa.RecordBatch.from_arrays([b.column(0), lists(x), pa.array(best, pa.int64()), pa.array(dist, pa.float64()), pa.array(best != own, pa.bool_())], ["id", "v", "cid", "d", "moved"])

    return state.select("id", "v", "cid").mapInArrow(run, "id bigint, v array<double>, cid bigint, d double, moved boolean")


def state_sums(state: DataFrame, k: int, d: int, parts: int | None, *extra: str) -> np.ndarray:
    """By cid: the sum of v, the count, and the sums of the `extra` columns."""

    def partial(batches: Iterator[pa.RecordBatch]) -> np.ndarray | None:
        total = np.zeros((k, d + 1 + len(extra)))
        for b in batches:
            x, cid = matrix(b.column(0), d), b.column(1).to_numpy()
            columns = [np.asarray(b.column(2 + i).to_numpy(zero_copy_only=False), "f8") for i in range(len(extra))]
            np.add.at(total, cid, np.column_stack([x, np.ones(len(x)), *columns]))
        return total

    return sums(state.select("v", "cid", *extra), partial, k, d + 1 + len(extra), parts)


def partitions(points: DataFrame) -> int:
    """Of persisted points."""
    return points.rdd.getNumPartitions()


def lloyd(points: DataFrame, centers: np.ndarray, start: DataFrame | None, policy: Policy, distance: str | Distance, max_iter: int, epsilon: float, log: RunLog) -> Result:
    """At most max_iter assignment passes. The returned assignment is that of the last pass, made with the centers before the last update."""
    found = named(distance)
    k, d = centers.shape
    new, used, history = centers.copy(), None, [centers.copy()]
    log.start()
    held = points.select("id", "v").persist()
    n = held.count()
    parts = partitions(held)
    state = None
    if policy.keep_ties:
        begin = start if start is not None else points.select("id", F.pmod("id", F.lit(k)).cast("bigint").alias("cid"))
        state = held.join(begin.select("id", "cid"), "id").select("id", "v", "cid").persist()
    for i in range(max_iter):
        t0 = perf_counter()
        used, moved = new, 0
        if state is not None:
            step = keep_tie_step(state, used, found)
            step = cut(step) if (i + 1) % CUT_EVERY == 0 else step.persist()
            got = state_sums(step, k, d, parts, "d", "moved")
            state.unpersist()
            state = step
            total, count, error, moved = got[:, :d], got[:, d], float(got[:, d + 1].sum()), int(got[:, d + 2].sum())
        else:
            total, count, error = assign_and_sum(held, used, found, parts)
        t1 = perf_counter()
        new, _ = means(total, count, used)
        history.append(new)
        movement = policy.stop.movement(new, used)
        if policy.msse_after:
            error = _after(total, count, error, used, new, found)
        log.add(t1 - t0, perf_counter() - t1, error / max(1, n), n * k, moved, movement)
        if policy.stop.stops(movement, epsilon):
            break
    log.end()
    held.unpersist()
    if state is not None:
        return Result(new, state.select("id", "cid"), log, history)
    if used is None:
        return Result(new, start if start is not None else assignment.assign(points, new, found).select("id", "cid"), log, history)
    return Result(new, assignment.assign(points, used, found).select("id", "cid"), log, history)


def lloyd_matrix(x: np.ndarray, centers: np.ndarray, max_iter: int, epsilon: float) -> tuple[np.ndarray, np.ndarray]:
    """The same on a small matrix on the driver, for the grouping of centers."""
    found, stop = named("Euclidean"), StopRule("sum")
    best = np.arange(len(x)) % len(centers)
    for _ in range(max_iter):
        best, _ = nearest(x, centers, found)
        total = np.zeros_like(centers)
        np.add.at(total, best, x)
        new, _ = means(total, np.bincount(best, minlength=len(centers)).astype("f8"), centers)
        moved = stop.movement(new, centers)
        centers = new
        if stop.stops(moved, epsilon):
            break
    return centers, best
