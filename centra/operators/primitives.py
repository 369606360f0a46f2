"""The dataflow primitives under the algorithms, as operators of their own."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from centra.durable import cut


def exclusive_scan(frame: DataFrame, order: str, value: str, out: str = "excl") -> DataFrame:
    """The sum of `value` over all rows before a row in `order`.

    Rows are range-partitioned and scanned within partitions; the sums of the partitions before, one number each, are
    added. No task sees all rows.
    """
    dealt = cut(frame.repartitionByRange(order).withColumn("part_", F.spark_partition_id()))
    sums = {r[0]: r[1] for r in dealt.groupBy("part_").agg(F.sum(value)).collect()}
    before, total = [], 0
    for part in sorted(sums):
        before += [F.lit(part), F.lit(total)]
        total += sums[part] or 0
    inner = F.coalesce(F.sum(value).over(Window.partitionBy("part_").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    if not before:
        return dealt.withColumn(out, inner).drop("part_")
    return dealt.withColumn(out, inner + F.create_map(*before)[F.col("part_")]).drop("part_")


def upper_bound(scanned: DataFrame, order: str, position: float, excl: str = "excl") -> DataFrame:
    """The last row, in `order`, whose prefix is at most the position."""
    return scanned.where(F.col(excl) <= position).agg(F.max(order).alias(order))


def histogram(frame: DataFrame, key: str) -> DataFrame:
    return frame.groupBy(key).agg(F.count("*").alias("n"))


def arg_min(frame: DataFrame, key: str, value: str, group: str | None = None) -> DataFrame:
    """The key of the least value, the lowest key in a tie."""
    best = F.min(F.struct(F.col(value), F.col(key)))[key].alias(key)
    return frame.groupBy(group).agg(best) if group else frame.agg(best)


def run_starts(frame: DataFrame, key: str, order: str) -> DataFrame:
    """Where runs of equal keys begin in the order of (key, order): the first row of each key, without sorting all rows in one task."""
    return frame.groupBy(key).agg(F.min(order).alias(order), F.count("*").alias("n"))


def integer_sort(frame: DataFrame, key: str, *rest: str) -> DataFrame:
    return frame.orderBy(key, *rest)
