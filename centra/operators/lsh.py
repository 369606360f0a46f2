"""Locality-sensitive hashing by random hyperplanes."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from centra.durable import cut
from centra.functions.distance import dot
from centra.operators.points import literal

PLANES = 32


def hyperplanes(d: int, n: int = PLANES, seed: int = 0) -> np.ndarray:
    return np.random.default_rng(seed).normal(size=(n, d))


def bits(v: Column, planes: np.ndarray) -> Column:
    """1 where the vector lies on the plane's positive side, else 0."""
    return F.transform(literal(planes), lambda p: (dot(v, p) > 0).cast("bigint"))


def hash_of(v: Column, planes: np.ndarray) -> Column:
    """Bit i stands for plane i; up to 62 planes."""
    return F.aggregate(F.transform(bits(v, planes), lambda b, i: F.when(b == 1, F.pow(F.lit(2.0), i).cast("bigint")).otherwise(F.lit(0))), F.lit(0).cast("bigint"), lambda a, b: a + b)


def bytes_of(v: Column, planes: np.ndarray) -> Column:
    """The bits packed: bit j of byte i is plane 8 i + j."""
    if len(planes) % 8:
        raise ValueError("the number of planes must be a multiple of 8")
    b = bits(v, planes)
    one = lambda i: F.aggregate(F.slice(b, 8 * i + 1, F.lit(8)), F.struct(F.lit(0).alias("s"), F.lit(1).alias("w")), lambda a, x: F.struct((a["s"] + a["w"] * x.cast("int")).alias("s"), (a["w"] * 2).alias("w")), lambda a: a["s"])
    return F.transform(F.sequence(F.lit(0), F.lit(len(planes) // 8 - 1)), one)


def ranks(hashed: DataFrame, *order: str) -> DataFrame:
    """The 0-based place of each row in the order, as `place`, without one task for all rows.

    Rows are range-partitioned and sorted; the sizes of the partitions before a row's own, a number for each
    partition, are added to its place within it.
    """
    # Written once: a second run could cut the partitions elsewhere.
    dealt = cut(hashed.repartitionByRange(*order).withColumn("part_", F.spark_partition_id()))
    local = dealt.withColumn("row_", F.row_number().over(Window.partitionBy("part_").orderBy(*order)))
    sizes = {r[0]: r[1] for r in dealt.groupBy("part_").count().collect()}
    before, total = {}, 0
    for part in sorted(sizes):
        before[part] = total
        total += sizes[part]
    if not before:
        return local.withColumn("place", F.lit(0).cast("bigint")).drop("part_", "row_")
    offsets = F.create_map(*[F.lit(x) for pair in before.items() for x in pair])
    return local.withColumn("place", offsets[F.col("part_")] + F.col("row_").cast("bigint") - 1).drop("part_", "row_")
