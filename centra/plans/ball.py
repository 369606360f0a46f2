"""Ball k-means: exact Lloyd that compares a point only with centers near its own.

A cluster's radius is its farthest member's distance. A center at 2 radii or more from another's cannot be nearer to
any of that cluster's points, and one at twice a point's own distance not to that point. Distances are
plain, not squared, as the triangle inequality wants. A cluster that no center near it moved is left alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from time import perf_counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from centra.durable import cut
from centra.functions.distance import Distance, named, nearest
from centra.operators.points import lists, matrix
from centra.operators.update import means
from centra.plans.lloyd import CUT_EVERY, Policy, Result, partitions, state_sums
from centra.plans.runlog import RunLog
from centra.plans.yinyang import SLACK

STATE = "id bigint, v array<double>, cid bigint, d double, moved boolean, calls bigint"


def center_distances(centers: np.ndarray) -> np.ndarray:
    """k x k plain distances."""
    return np.concatenate([np.zeros((0, len(centers))), *(rows for _, rows in _blocks(centers))])


#: Differences of coordinates of one block of centers.
ENTRIES = 4_000_000


def _blocks(centers: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """First center and plain distances to all of a block of centers; differences, as a product could blur a bound."""
    step = max(1, ENTRIES // max(1, centers.size))
    for a in range(0, len(centers), step):
        yield a, np.sqrt(((centers[a : a + step, None, :] - centers[None, :, :]) ** 2).sum(-1))


def neighbors(between: np.ndarray, radius: np.ndarray) -> list[np.ndarray]:
    """For each center, the others within 2 radii of its cluster, nearest first."""
    out = []
    for i in range(len(between)):
        near = np.flatnonzero(between[i] <= 2 * radius[i] * (1 + SLACK))
        near = near[near != i]
        out.append(near[np.argsort(between[i][near], kind="stable")])
    return out


def near_centers(centers: np.ndarray, radius: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """For each center its neighbors, and their distances; all k x k distances are never held."""
    near, far = [], []
    for a, rows in _blocks(centers):
        for i, row in enumerate(rows, a):
            own = np.flatnonzero(row <= 2 * radius[i] * (1 + SLACK))
            own = own[own != i]
            own = own[np.argsort(row[own], kind="stable")]
            near.append(own)
            far.append(row[own])
    return near, far


def _batch(b: pa.RecordBatch, x: np.ndarray, best: np.ndarray, d: np.ndarray, moved: np.ndarray, calls: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([b.column(0), lists(x), pa.array(best, pa.int64()), pa.array(d, pa.float64()), pa.array(moved, pa.bool_()), pa.array(calls, pa.int64())], ["id", "v", "cid", "d", "moved", "calls"])


def begin(points: DataFrame, centers: np.ndarray, found: Distance) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = matrix(b.column(1), centers.shape[1])
            best, d = nearest(x, centers, found)
            yield _batch(b, x, best, d, np.ones(len(x), bool), np.full(len(x), len(centers)))

    return points.select("id", "v").mapInArrow(run, STATE)


def radii(state: DataFrame, centers: np.ndarray, found: Distance) -> np.ndarray:
    """The farthest member of each center, by partial maxima; k rows reach the driver."""
    k, d = centers.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = b.column(1).to_numpy()
            far = np.full(k, -1.0)
            np.maximum.at(far, own, np.sqrt(found.rows(matrix(b.column(0), d), centers[own])))
            at = np.flatnonzero(far >= 0)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(far[at], pa.float64())], ["cid", "r"])

    out = np.zeros(k)
    for cid, r in state.select("v", "cid").mapInArrow(run, "cid bigint, r double").groupBy("cid").agg(F.max("r")).collect():
        out[cid] = r
    return out


def step(state: DataFrame, centers: np.ndarray, near: list[np.ndarray], between: list[np.ndarray], still: np.ndarray, found: Distance) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, old = matrix(b.column(1), centers.shape[1]), b.column(2).to_numpy()
            best, calls = old.copy(), np.ones(len(x), "i8")
            squared = found.rows(x, centers[old])
            for i in np.unique(old).tolist():
                if still[i] or not len(near[i]):
                    continue
                rows = np.flatnonzero(old == i)
                # Beyond half the distance to the nearest other center, some may be nearer; only the first few can.
                own = np.sqrt(squared[rows])
                reach = np.searchsorted(between[i], 2 * own * (1 + SLACK) + 1e-300, side="right")
                rows, reach = rows[reach > 0], reach[reach > 0]
                if not len(rows):
                    continue
                candidates = np.sort(np.append(near[i][: reach.max()], i))
                best[rows], squared[rows] = _among(x[rows], centers, candidates, found)
                calls[rows] += len(candidates)
            yield _batch(b, x, best, squared, best != old, calls)

    return state.select("id", "v", "cid").mapInArrow(run, STATE)


def _among(x: np.ndarray, centers: np.ndarray, candidates: np.ndarray, found: Distance) -> tuple[np.ndarray, np.ndarray]:
    top, d = nearest(x, centers[candidates], found)
    return candidates[top], d


def ball(points: DataFrame, centers: np.ndarray, policy: Policy, distance: str | Distance, max_iter: int, epsilon: float, log: RunLog, truncate: bool = False) -> Result:
    """With `truncate`, distances are to centers truncated toward zero, as for integer data."""
    found = named(distance)
    if found.name.lower() == "mips":
        raise ValueError("bounds by the triangle inequality need a metric")
    k, d = centers.shape
    seen = np.trunc if truncate else np.asarray
    history, new, last, near = [centers.copy()], centers.copy(), seen(centers), None
    log.start()
    t0 = perf_counter()
    state = begin(points, last, found).persist()
    n = state.count()
    parts = partitions(state)
    for i in range(max(1, max_iter)):
        t1 = perf_counter()
        got = state_sums(state, k, d, parts, "d", "moved", "calls")
        old = new
        new, _ = means(got[:, :d], got[:, d], old)
        history.append(new)
        movement = policy.stop.movement(new, old)
        after = got[:, d + 1].sum() - float((got[:, d, None] * (new - old) ** 2).sum()) if not truncate else _error(state, seen(new), found)
        log.add(t1 - t0, perf_counter() - t1, after / max(1, n), got[:, d + 3].sum(), got[:, d + 2].sum(), movement)
        if policy.stop.stops(movement, epsilon) or i >= max_iter - 1:
            break
        t0 = perf_counter()
        now = seen(new)
        previous = near
        near, between = near_centers(now, radii(state, now, found))
        unmoved = (now == last).all(1)
        still = np.array([previous is not None and unmoved[j] and unmoved[near[j]].all() and np.array_equal(near[j], previous[j]) and got[j, d + 2] == 0 for j in range(k)])
        last = now
        following = step(state, now, near, between, still, found)
        following = cut(following) if (i + 1) % CUT_EVERY == 0 else following.persist()
        following.count()
        state.unpersist()
        state = following
    log.end()
    return Result(new, state.select("id", "cid"), log, history)


def _error(state: DataFrame, centers: np.ndarray, found: Distance) -> float:
    k, d = centers.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([found.rows(matrix(b.column(0), d), centers[b.column(1).to_numpy()]).sum()], pa.float64())], ["e"])

    return state.select("v", "cid").mapInArrow(run, "e double").agg(F.sum("e")).first()[0] or 0.0
