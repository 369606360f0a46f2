"""Reports over run logs: pivots, averages and fits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pivot(logs: DataFrame, methods: list[str], values: tuple[str, ...] = ("time", "msse"), missing: float = -1.0) -> DataFrame:
    """(k, method, time, msse) to a row for each k, with time_<method> and msse_<method>."""
    columns = [F.coalesce(F.max(F.when(F.col("method") == m, F.col(v).cast("double"))), F.lit(missing)).alias(f"{v}_{m}") for v in values for m in methods]
    return logs.groupBy("k").agg(*columns)


def fits(logs: DataFrame, digits: int = 6) -> DataFrame:
    """For each method: time as a line over k, msse as a line over ln k."""
    x, lx = F.col("k").cast("double"), F.log(F.col("k").cast("double"))
    fit = lambda f, y, by, name: F.round(f(F.col(y), by), digits).alias(name)
    return logs.groupBy("method").agg(fit(F.regr_slope, "time", x, "time_slope"), fit(F.regr_intercept, "time", x, "time_intercept"), fit(F.regr_slope, "msse", lx, "msse_slope"), fit(F.regr_intercept, "msse", lx, "msse_intercept"))


def average_assign(iterations: DataFrame) -> DataFrame:
    return iterations.agg(F.avg("assign_time").alias("assign_time"))


def series(iterations: DataFrame, *columns: str) -> DataFrame:
    """A column over the iterations, to plot or to compare."""
    return iterations.select("iteration", *columns).orderBy("iteration")


def trend(iterations: DataFrame, column: str) -> DataFrame:
    """The line through a column over the iterations."""
    x = F.col("iteration").cast("double")
    return iterations.agg(F.regr_slope(column, x).alias("slope"), F.regr_intercept(column, x).alias("intercept"))
