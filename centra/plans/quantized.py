"""Runners that cluster codes or blocks of the vectors: cartesian, LSH codes, product quantization."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from time import perf_counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from centra.functions.distance import Distance, named, nearest
from centra.operators import lsh
from centra.operators.init import cyclic
from centra.operators.points import first_k, lists, matrix, sums
from centra.operators.update import mean_matrix, means
from centra.plans.ball import ball
from centra.plans.lloyd import Policy, Result, StopRule, lloyd, partitions
from centra.plans.runlog import RunLog
from centra.plans.yinyang import yinyang

BLOCKS, PLANES = 4, 256


def block(points: DataFrame, j: int, width: int) -> DataFrame:
    """id, v: the j-th block of `width` coordinates."""
    return points.select("id", F.slice("v", j * width + 1, width).alias("v"))


def width_of(points: DataFrame) -> int:
    return points.select(F.size("v")).first()[0]


def cartesian(points: DataFrame, k: int, policy: Policy, max_iter: int, epsilon: float, log: RunLog, blocks: int = BLOCKS, use_ball: bool = True) -> Result:
    """k* = k ** (1 / blocks) centers in each block; center i joins the blocks' centers by the digits of i to the base k*."""
    d, base = width_of(points), round(k ** (1 / blocks))
    if d % blocks:
        raise ValueError(f"{d} coordinates cannot be cut into {blocks} blocks")
    if base**blocks != k:
        raise ValueError(f"{k} is not a {blocks}th power")
    log.start()
    width, run = d // blocks, ball if use_ball else None
    parts: list[Result] = []
    for j in range(blocks):
        own = block(points, j, width)
        begin = first_k(own, base)
        inner = RunLog(log.n, width, base, "block", "Lazy", max_iter, epsilon)
        parts.append(run(own, begin, policy, "Euclidean", max_iter, epsilon, inner) if run else lloyd(own, begin, cyclic(own, base).select("id", "cid"), policy, "Euclidean", max_iter, epsilon, inner))
        log.iterations += inner.iterations
    digits = [[i // base**j % base for j in range(blocks)] for i in range(k)]
    centers = np.array([np.concatenate([parts[j].centers[x] for j, x in enumerate(row)]) for row in digits])
    named_ = [p.assignment.select("id", F.col("cid").alias(f"c{j}")) for j, p in enumerate(parts)]
    joined = reduce(lambda a, b: a.join(b, "id"), named_)
    log.end()
    return Result(centers, joined.select("id", sum((F.col(f"c{j}") * base**j for j in range(1, blocks)), F.col("c0")).alias("cid")), log, [centers])


def sides(x: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """Whether each vector lies on each plane's positive side. By a matrix product; where its rounding, which depends on the batch, could hide the sign, by the sum of products."""
    product = x @ planes.T
    loss = 1e-12 * np.sqrt((x**2).sum(1))[:, None] * np.sqrt((planes**2).sum(1))[None, :]
    i, j = np.nonzero(np.abs(product) <= loss)
    product[i, j] = (x[i] * planes[j]).sum(-1)
    return product > 0


def lsh_codes(points: DataFrame, planes: np.ndarray) -> DataFrame:
    """id, v: the sign bits packed to bytes, as numbers."""
    d = planes.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = matrix(b.column(1), d)
            yield pa.RecordBatch.from_arrays([b.column(0), lists(np.packbits(sides(x, planes), axis=1, bitorder="little").astype("f8"))], ["id", "v"])

    if len(planes) % 8:
        raise ValueError("the number of planes must be a multiple of 8")
    return points.select("id", "v").mapInArrow(run, "id bigint, v array<double>")


def lsh_code(points: DataFrame, centers: np.ndarray, policy: Policy, max_iter: int, epsilon: float, log: RunLog, planes: np.ndarray | None = None, seed: int = 0) -> Result:
    """Clusters the byte codes; the centers are then means of the vectors themselves, and the measure is their mean squared error."""
    planes = lsh.hyperplanes(centers.shape[1], PLANES, seed) if planes is None else planes
    codes = lsh_codes(points, planes)
    begin = np.packbits(sides(centers, planes), axis=1, bitorder="little").astype("f8")
    inner = RunLog(log.n, begin.shape[1], len(centers), "YinyangSimp", "", max_iter, epsilon)
    coded = yinyang(codes, begin, policy, "short", max_iter, epsilon, inner)
    log.start()
    own = points.join(coded.assignment, "id").select("id", "v", "cid")
    found, count = mean_matrix(own, centers)
    log.iterations += inner.iterations
    log.end()
    log.total_time += inner.total_time
    return Result(found, coded.assignment, log, [centers, found])


def codebook(points: DataFrame, m: int, kstar: int, iterations: int = 5) -> np.ndarray:
    """(m, kstar, d / m): the centers of each block, by Lloyd from the first kstar points."""
    d = width_of(points)
    if d % m:
        raise ValueError(f"{d} coordinates cannot be cut into {m} blocks")
    out = []
    for j in range(m):
        own = block(points, j, d // m)
        out.append(lloyd(own, first_k(own, kstar), None, Policy(StopRule("max"), True), "Euclidean", iterations, 0.0, RunLog(0, d // m, kstar, "block")).centers)
    return np.stack(out)


def encode(points: DataFrame, book: np.ndarray) -> DataFrame:
    """id, v, code: the nearest center of each block."""
    m, _, width = book.shape
    found = named("Euclidean")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = matrix(b.column(1), m * width)
            code = np.stack([nearest(x[:, j * width : (j + 1) * width], book[j], found)[0] for j in range(m)], axis=1)
            codes = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype="i4") * m, pa.int32()), pa.array(code.ravel().astype("i4"), pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), codes], ["id", "v", "code"])

    return points.select("id", "v").mapInArrow(run, "id bigint, v array<double>, code array<int>")


def code_table(centers: np.ndarray, book: np.ndarray, distance: Distance) -> np.ndarray:
    """(k, m, kstar): each center's block against each code."""
    m, _, width = book.shape
    return np.stack([distance.rows(centers[:, None, j * width : (j + 1) * width], book[j][None, :, :]) for j in range(m)], axis=1)


def pq_assign(coded: DataFrame, table: np.ndarray) -> DataFrame:
    """id, v, code, cid, d: the center with the least sum of table entries; the lowest wins a tie."""
    k, m, _ = table.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            code = matrix(b.column(2), m).astype("i8")
            best, least = np.zeros(len(code), "i8"), np.full(len(code), np.inf)
            for c in range(k):
                d = table[c, 0][code[:, 0]]
                for j in range(1, m):
                    d = d + table[c, j][code[:, j]]
                nearer = d < least
                best[nearer], least[nearer] = c, d[nearer]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(best, pa.int64()), pa.array(least, pa.float64())], ["id", "v", "code", "cid", "d"])

    return coded.select("id", "v", "code").mapInArrow(run, "id bigint, v array<double>, code array<int>, cid bigint, d double")


def pq(points: DataFrame, centers: np.ndarray, policy: Policy, distance: str | Distance, max_iter: int, epsilon: float, log: RunLog, m: int = 16, kstar: int = 256, book: np.ndarray | None = None) -> Result:
    """Assignment by codes, update by the vectors. The quantized error has a column of its own in the log; distance_calls are look-ups in the table of codes."""
    found = named(distance)
    k, d = centers.shape
    log.start()
    book = codebook(points, m, kstar) if book is None else book
    coded = encode(points, book).persist()
    n = coded.count()
    parts = partitions(coded)
    new, used, history = centers.copy(), centers, [centers.copy()]
    for _ in range(max_iter):
        t0 = perf_counter()
        used = new
        own = pq_assign(coded, code_table(used, book, found))

        def partial(batches: Iterator[pa.RecordBatch], against: np.ndarray = used) -> np.ndarray | None:
            total = np.zeros((k, d + 3))
            for b in batches:
                x, cid = matrix(b.column(0), d), b.column(1).to_numpy()
                np.add.at(total, cid, np.column_stack([x, np.ones(len(x)), b.column(2).to_numpy(), found.rows(x, against[cid])]))
            return total

        got = sums(own.select("v", "cid", "d"), partial, k, d + 3, parts)
        t1 = perf_counter()
        new, _ = means(got[:, :d], got[:, d], used)
        history.append(new)
        movement = policy.stop.movement(new, used)
        real = got[:, d + 2].sum() - float((got[:, d, None] * (new - used) ** 2).sum())
        log.add(t1 - t0, perf_counter() - t1, real / max(1, n), n * k, 0, movement, quantized=got[:, d + 1].sum() / max(1, n))
        if policy.stop.stops(movement, epsilon):
            break
    log.end()
    return Result(new, pq_assign(coded, code_table(used, book, found)).select("id", "cid"), log, history)
