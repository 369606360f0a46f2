"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from centra.durable import cut

__all__ = ["SPACE", "bucket_of", "cut", "sample_of", "table"]

#: White space that separates words in most of the contracts: space and U+0009 to U+000D.
SPACE = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the input folder, read by Spark alone so that any store works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bucket_of(doc_id: str | Column, modulus: int) -> Column:
    """crc32 of the id written as text, modulo: the split that the contracts fix."""
    return F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")) % modulus


def sample_of(frame: DataFrame, key: str, limit: int) -> DataFrame:
    """At most `limit` rows of a frame with a unique key: those with the smallest hash of the key.

    Only (hash) values are ordered and one number comes back to the driver; the rows themselves are
    filtered where they lie.
    """
    hashed = F.xxhash64(F.col(key).cast("string"), F.lit("sample"))
    bound = frame.select(hashed.alias("h")).orderBy("h").limit(limit).agg(F.max("h"), F.count("h")).first()
    if bound[1] < limit:
        return frame
    return frame.where(hashed <= F.lit(bound[0]))
