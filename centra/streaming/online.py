"""Clustering a stream of points: assignment is a stateless map; centers follow by the incremental mean, batch by batch."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from centra.operators.assign import assigned
from centra.operators.update import mean_matrix


def assign_stream(points: DataFrame, centers: np.ndarray, distance: str = "Euclidean") -> DataFrame:
    """id, v, cid, d for a streaming (or any) frame of points; no state, so no watermark."""
    return assigned(points, centers, distance)


class Centers:
    """Centers and counts that a stream updates: c' = (c n + sum of the batch) / (n + its count).

    A batch is applied once: the last applied id is kept, so a batch that is run again after a failure is skipped. With `follow` both are
    written beside the stream's checkpoint before a batch ends, and read from there after a restart of the driver.
    """

    def __init__(self, centers: np.ndarray, counts: np.ndarray | None = None) -> None:
        self.centers = centers.astype("f8").copy()
        self.counts = np.zeros(len(centers)) if counts is None else counts.astype("f8").copy()
        self.applied = -1

    def update(self, batch: DataFrame, batch_id: int) -> None:
        if batch_id <= self.applied:
            return
        means, n = mean_matrix(assigned(batch, self.centers), self.centers)
        total = self.counts + n
        at = n > 0
        self.centers[at] = (self.centers[at] * self.counts[at, None] + means[at] * n[at, None]) / total[at, None]
        self.counts, self.applied = total, batch_id


    def save(self, spark: SparkSession, folder: str) -> None:
        rows = [(i, [float(x) for x in c], float(n)) for i, (c, n) in enumerate(zip(self.centers, self.counts, strict=True))]
        spark.createDataFrame(rows, "cid bigint, c array<double>, n double").coalesce(1).write.mode("overwrite").parquet(f"{folder}/batch={self.applied}")

    def load(self, spark: SparkSession, folder: str) -> None:
        """The state of the last batch whose table is whole, if there is any."""
        jvm = spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(folder)
        files = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if not files.exists(at):
            return
        batches = [p.getPath() for p in files.listStatus(at) if files.exists(jvm.org.apache.hadoop.fs.Path(p.getPath(), "_SUCCESS"))]
        if not batches:
            return
        last = max(int(p.getName().split("=")[1]) for p in batches)
        rows = sorted(spark.read.parquet(f"{folder}/batch={last}").collect())
        self.centers, self.counts, self.applied = np.array([r.c for r in rows], "f8"), np.array([r.n for r in rows]), last


def follow(points: DataFrame, state: Centers, checkpoint: str, after: Callable[[Centers], None] | None = None) -> StreamingQuery:
    """Updates the centers from a streaming frame until its available data is used."""

    folder = f"{checkpoint.rstrip('/')}/centers"
    state.load(points.sparkSession, folder)

    def each(batch: DataFrame, batch_id: int) -> None:
        if batch_id > state.applied:
            state.update(batch.select("id", "v"), batch_id)
            state.save(batch.sparkSession, folder)
        if after:
            after(state)

    return points.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, time: str, cid: str, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Members that arrive in each window, with late ones up to the watermark."""
    return events.withWatermark(time, late).groupBy(F.window(time, window), F.col(cid)).agg(F.count("*").alias("n"))
