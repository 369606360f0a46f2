"""Yinyang k-means: exact Lloyd with bounds that spare most distances.

A point's state is its center, an upper bound to it and a lower bound to the other centers of each group of
centers. Bounds are plain distances (the triangle inequality needs the root). The state travels with the point in
a persisted frame; every CUT_EVERY iterations it is written out, so a lost executor costs a few iterations.
"""

from __future__ import annotations

from collections.abc import Iterator
from time import perf_counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from centra.durable import cut
from centra.functions.distance import Distance, named, nearest
from centra.operators.points import lists, matrix
from centra.operators.update import means
from centra.plans.lloyd import CUT_EVERY, Policy, Result, lloyd_matrix, partitions, state_sums
from centra.plans.runlog import RunLog

#: A bound is only trusted beyond this share, so that rounding never hides a tie.
SLACK = 1e-9
STATE = "id bigint, v array<double>, cid bigint, ub double, lb array<double>, moved boolean, calls bigint, sq double"


def group_count(k: int) -> int:
    return k if k <= 100 else k // 10 if k <= 500 else k // 20 if k <= 5000 else k // 100


def group_centers(centers: np.ndarray, t: int | None = None) -> np.ndarray:
    """The group of each center: the centers clustered into t groups; empty groups are left out."""
    t = t or group_count(len(centers))
    _, best = lloyd_matrix(centers, centers[:t].copy(), 5, 1e-4)
    return np.unique(best, return_inverse=True)[1]


def drift(delta: np.ndarray, groups: np.ndarray) -> np.ndarray:
    """The greatest movement in each group."""
    out = np.zeros(groups.max() + 1)
    np.maximum.at(out, groups, delta)
    return out


def bounds(x: np.ndarray, centers: np.ndarray, groups: np.ndarray, found: Distance) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest center, distance to it, and to the nearest other one of each group."""
    best, squared = nearest(x, centers, found)
    table = np.sqrt(np.maximum(found.table(x, centers), 0))
    table[np.arange(len(x)), best] = np.inf
    lb = np.stack([table[:, groups == g].min(1) for g in range(groups.max() + 1)], axis=1)
    return best, np.sqrt(squared), lb


def filtered(x: np.ndarray, best: np.ndarray, ub: np.ndarray, lb: np.ndarray, centers: np.ndarray, delta: np.ndarray, groups: np.ndarray, found: Distance, local: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """One assignment after the centers moved: new center, upper and lower bounds, and distances computed for each point."""
    n, t = lb.shape
    before = lb
    lb = np.maximum(0, lb - drift(delta, groups)[None, :])
    own = np.sqrt(found.rows(x, centers[best]))
    calls = np.ones(n, "i8")
    ub, old = own.copy(), best
    best = best.copy()
    need = (lb <= ub[:, None] * (1 + SLACK)) & (lb.min(1) <= ub * (1 + SLACK))[:, None]
    scanned = np.full((n, len(centers)), np.inf)
    stand_in = np.full((n, t), np.inf)
    for g in range(t):
        rows, members = np.flatnonzero(need[:, g]), np.flatnonzero(groups == g)
        if not len(rows):
            continue
        if local:
            # A center that cannot have come nearer than the point's own distance is not looked at; its bound stands in.
            floor = before[rows, g][:, None] - delta[members][None, :]
            skip = (floor > ub[rows][:, None] * (1 + SLACK)) & (members[None, :] != old[rows][:, None])
            stand_in[rows, g] = np.where(skip, floor, np.inf).min(1)
            for j, member in enumerate(members.tolist()):
                seen = rows[~skip[:, j]]
                scanned[seen, member] = np.sqrt(np.maximum(found.table(x[seen], centers[member : member + 1])[:, 0], 0))
                calls[seen] += 1
        else:
            scanned[np.ix_(rows, members)] = np.sqrt(np.maximum(found.table(x[rows], centers[members]), 0))
            calls[rows] += len(members)
    scanned[np.arange(n), old] = own
    top = scanned.argmin(1)
    least = scanned[np.arange(n), top]
    close = (scanned <= (least * (1 + SLACK) + 1e-12)[:, None]).sum(1) > 1
    if close.any():
        top[close], squared = nearest(x[close], centers, found)
        least[close] = np.sqrt(squared)
    moved = top != old
    least[moved & ~close] = np.sqrt(found.rows(x[moved & ~close], centers[top[moved & ~close]]))
    best, ub = top, least
    others = scanned
    others[np.arange(n), best] = np.inf
    for g in range(t):
        fresh = np.minimum(others[:, groups == g].min(1), stand_in[:, g])
        left = ~need[:, g] & moved & (groups[old] == g)
        lb[:, g] = np.where(need[:, g], fresh, np.where(left, np.minimum(lb[:, g], own), lb[:, g]))
    return best, ub, lb, calls


def _batch(b: pa.RecordBatch, x: np.ndarray, best: np.ndarray, ub: np.ndarray, lb: np.ndarray, moved: np.ndarray, calls: np.ndarray) -> pa.RecordBatch:
    columns = [b.column(0), lists(x), pa.array(best, pa.int64()), pa.array(ub, pa.float64()), lists(lb), pa.array(moved, pa.bool_()), pa.array(calls, pa.int64()), pa.array(ub**2, pa.float64())]
    return pa.RecordBatch.from_arrays(columns, ["id", "v", "cid", "ub", "lb", "moved", "calls", "sq"])


#: Entries of points x centers in one step of a worker.
ENTRIES = 2_000_000


def _pieces(b: pa.RecordBatch, k: int) -> Iterator[pa.RecordBatch]:
    step = max(1, ENTRIES // k)
    for at in range(0, b.num_rows, step):
        yield b.slice(at, step)


def begin(points: DataFrame, centers: np.ndarray, groups: np.ndarray, found: Distance) -> DataFrame:
    """The state after a full assignment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in _pieces(whole, len(centers)):
                x = matrix(b.column(1), centers.shape[1])
                best, ub, lb = bounds(x, centers, groups, found)
                yield _batch(b, x, best, ub, lb, np.ones(len(x), bool), np.full(len(x), len(centers)))

    return points.select("id", "v").mapInArrow(run, STATE)


def step(state: DataFrame, centers: np.ndarray, delta: np.ndarray, groups: np.ndarray, found: Distance, local: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in _pieces(whole, len(centers)):
                x, old = matrix(b.column(1), centers.shape[1]), b.column(2).to_numpy()
                best, ub, lb, calls = filtered(x, old, b.column(3).to_numpy(), matrix(b.column(4)), centers, delta, groups, found, local)
                yield _batch(b, x, best, ub, lb, best != old, calls)

    return state.select("id", "v", "cid", "ub", "lb").mapInArrow(run, STATE)


def yinyang(points: DataFrame, centers: np.ndarray, policy: Policy, distance: str | Distance, max_iter: int, epsilon: float, log: RunLog, t: int | None = None, local: bool = False) -> Result:
    found = named(distance)
    if found.name.lower() == "mips":
        raise ValueError("bounds by the triangle inequality need a metric")
    k, d = centers.shape
    history, new = [centers.copy()], centers.copy()
    log.start()
    if max_iter < 1:
        log.end()
        return Result(new, points.select("id").selectExpr("id", f"pmod(id, {k}) as cid"), log, history)
    t0 = perf_counter()
    groups = group_centers(centers, t)
    state = begin(points, centers, groups, found).persist()
    n = state.count()
    parts, setup = partitions(state), perf_counter() - t0
    for i in range(max_iter):
        t1 = perf_counter()
        got = state_sums(state, k, d, parts, "sq", "moved", "calls")
        old = new
        new, _ = means(got[:, :d], got[:, d], old)
        history.append(new)
        movement = policy.stop.movement(new, old)
        log.add(t1 - t0, perf_counter() - t1, got[:, d + 1].sum() / max(1, n), got[:, d + 3].sum(), got[:, d + 2].sum(), movement, setup if i == 0 else 0.0)
        if policy.stop.stops(movement, epsilon) or i == max_iter - 1:
            break
        t0 = perf_counter()
        following = step(state, new, np.sqrt(((new - old) ** 2).sum(1)), groups, found, local)
        following = cut(following) if (i + 1) % CUT_EVERY == 0 else following.persist()
        following.count()
        state.unpersist()
        state = following
    log.end()
    return Result(new, state.select("id", "cid"), log, history)
