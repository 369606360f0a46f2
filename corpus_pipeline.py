"""The corpus pipeline: each stage takes the documents that the one before it left.

Stages but the last return the columns of documents; n_chars follows the text. A stage is judged on its own
input.

Cases: null and empty texts are scored like each other, have no lines to lose, are copies of each other in the near-dedup,
which keeps one of them, hold no benchmark window and have no tokens. Texts of any length go through whole. Of near copies the
one with the smallest id stays, of rows that repeat an id and a text one. A row without an id is scored and
cleaned like others, and stays if no other of its group has an id. Empty tables give an empty result, an empty benchmark removes nothing, and without labels
every score is 0.5, so all stay. Columns other than those of documents are not carried along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from centra.llm import bpe, decontaminate, line_dedup, quality, simhash
from centra.llm.queries import TOKENIZER
from centra.llm.shared import bucket_of, cut, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"), bucket_of("doc_id", 5) != 0)
    return quality.scored(docs.select(*COLUMNS), model, "score__").where(F.col("score__") >= quality.THRESHOLD).drop("score__")


def drop_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the boilerplate lines of their sources."""
    clean = line_dedup.dedup_lines(docs.select(*COLUMNS))
    return clean.withColumn("n_chars", F.coalesce(F.length("text").cast("bigint"), F.col("n_chars"))).select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return simhash.dedup(docs.select(*COLUMNS))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of the benchmark."""
    return decontaminate.remove(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each document that is left."""
    return bpe.digests(docs, TOKENIZER)


STAGES = [
    ("quality classifier", keep_quality),
    ("line dedup", drop_boilerplate),
    ("SimHash near-dedup", drop_near_copies),
    ("benchmark decontamination", drop_contaminated),
    ("BPE encoding and decoding", tokenize),
]
#: The classifier, the fingerprints and the automata have no SQL; tests/llm decides each stage again by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage leaves is written to the shared checkpoint folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
