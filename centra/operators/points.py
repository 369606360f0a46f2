"""Points as a DataFrame (id BIGINT, v ARRAY<DOUBLE>) and centers as a small matrix, and the way between Arrow batches and NumPy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def from_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    frame = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return frame.select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"))


def from_columns(frame: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Numeric columns of any table as points."""
    return frame.select(F.col(key).cast("bigint").alias("id"), F.array(*[F.col(c).cast("double") for c in columns]).alias("v"))


def matrix(column: pa.Array, width: int | None = None) -> np.ndarray:
    """A list column as an n x d matrix; all vectors must have one length."""
    n = len(column)
    if not n:
        return np.zeros((0, width or 0))
    flat = np.asarray(column.flatten(), "f8")
    if len(flat) % n or (width is not None and len(flat) != n * width) or column.null_count:
        raise ValueError("vectors must not be null and must all have the same length")
    return flat.reshape(n, -1)


def lists(x: np.ndarray) -> pa.Array:
    """The rows of a matrix as a list column."""
    n, d = x.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype="i4") * d, pa.int32()), pa.array(np.ascontiguousarray(x, "f8").ravel(), pa.float64()))


def literal(centers: np.ndarray) -> Column:
    """Centers as one constant ARRAY<ARRAY<DOUBLE>>, for expressions; for a few centers."""
    return F.array(*[F.array(*[F.lit(float(x)) for x in row]) for row in centers])


def first_k(points: DataFrame, k: int) -> np.ndarray:
    """The vectors with ids 0 to k-1, in the order of the id."""
    rows = points.where(F.col("id") < k).select("id", "v").collect()
    got = np.array([r[1] for r in sorted(rows, key=lambda r: r[0])], "f8")
    if len(got) != k:
        raise ValueError(f"{k} centers are asked for, but ids 0 to {k - 1} have {len(got)} points")
    return got


def crop(points: DataFrame, n: int) -> DataFrame:
    """The first n points by id; the filter reaches the scan."""
    return points.where(F.col("id") < n)


def centers_frame(spark: SparkSession, centers: np.ndarray) -> DataFrame:
    return spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(centers)], "cid bigint, c array<double>")


def cells(spark: SparkSession, centers: np.ndarray, digits: int = 6) -> DataFrame:
    """(cid, pos, value), rounded."""
    return centers_frame(spark, centers).select("cid", F.posexplode("c").alias("pos", "value")).select("cid", "pos", F.round("value", digits).alias("value"))


#: Bytes of partial sums up to which they go straight to the driver; beyond, executors add them up first.
TO_DRIVER = 64 << 20


def sums(frame: DataFrame, partial, k: int, width: int, parts: int | None = None, keys: str = "cid") -> np.ndarray:
    """Adds rows of `width` numbers for each of k keys over all partitions; `partial` turns a partition's batches into a (k, width) array.

    Each partition sends the keys that it has. Unless the number of partitions is known and all of it is small, they
    are dealt by key and added on the executors, so that the driver gets one row a key.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = partial(batches)
        if got is not None:
            at = np.flatnonzero(got.any(1))
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), lists(got[at])], [keys, "s"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for key, row in zip(b.column(0).to_pylist(), matrix(b.column(1), width), strict=True):
                total[key] = total[key] + row if key in total else row.copy()
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), lists(np.stack(list(total.values())))], [keys, "s"])

    schema = f"{keys} bigint, s array<double>"
    summed = frame.mapInArrow(run, schema)
    if parts is None or parts * k * width * 8 > TO_DRIVER:
        summed = summed.repartition(keys).mapInArrow(add, schema)
    out = np.zeros((k, width))
    got = summed.toArrow()
    for batch in got.to_batches():
        np.add.at(out, batch.column(0).to_numpy(), matrix(batch.column(1), width))
    return out
