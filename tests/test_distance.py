import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from centra.functions import distance as dist

CASES = [([1.0] * 10, [1.0] * 10, 0), ([1.0] * 10, [2.0] * 10, 10), ([1.0] * 10, [2.0 * i for i in range(10)], 970), ([0.5] * 10, [1.0] * 10, 2.5), ([17.0], [34.0], 289), ([], [], 0), ([3.0] * 10, [1.0] * 10, 40), ([3.0] * 10, [7.0] * 10, 160), ([3.0] * 10, [2.0 * i for i in range(10)], 690)]


@pytest.mark.parametrize("name", ["Euclidean", "fast", "short"])
def test_squared_l2(spark, name):
    rows = spark.createDataFrame([(a, b, float(d)) for a, b, d in CASES], "a array<double>, b array<double>, d double")
    for r in rows.withColumn("got", dist.named(name).column(F.col("a"), F.col("b"))).collect():
        assert r.got == r.d
        assert dist.named(name).rows(np.array(r.a), np.array(r.b)) == r.d


def test_every_width(spark):
    rows = spark.range(201).select("id", F.transform(F.sequence(F.lit(0), F.col("id")), lambda _: F.lit(1.0)).alias("a"))
    rows = rows.withColumn("b", F.transform("a", lambda x: x * 2))
    assert all(r.d == r.id + 1 for r in rows.select("id", dist.l2(F.col("a"), F.col("b")).alias("d")).collect())


def test_integers_and_mips(spark):
    row = spark.sql("SELECT array(200S, 3S) AS a, array(1.5D, 2.0D) AS b").select(dist.mips(F.col("a"), F.col("b")), dist.norm(F.col("b")), dist.l2_via_dot(F.col("a"), F.col("b"), dist.norm(F.col("b"))), dist.sqrt_l2(F.col("a"), F.col("a")), dist.hamming(F.lit(5), F.lit(6))).first()
    assert tuple(row) == (-306.0, 6.25, 6.25 - 612.0, 0.0, 2)


def test_strict_types():
    with pytest.raises(ValueError):
        dist.named("fast").check(T.ShortType(), T.DoubleType())
    dist.named("Euclidean").check(T.ShortType(), T.DoubleType())
    with pytest.raises(ValueError):
        dist.named("cosine")


def test_ties_go_to_the_lowest():
    x, c = np.array([[1e6 + 0.5, 0.0]]), np.array([[1e6 + 1, 0.0], [1e6, 0.0], [1e6, 0.0]])
    assert dist.nearest(x, c, dist.named())[0].tolist() == [0]
    assert dist.nearest(x, c, dist.named(), np.array([2]))[0].tolist() == [2]
