"""Line dedup by site-relative frequency, in DataFrame operations only.

A line that a large share of a host's pages hold is the host's boilerplate: for each host and line, the
pages that hold the line are divided by the pages of the host, and lines above RATIO, on MIN_PAGES pages
at least, are dropped from every page of that host. Lines are compared without white space around them;
blank lines stay, and so does the order of what is left.

What is shuffled is (host, 64-bit hash of the line), once a page, after partial counting; texts are not.
The lines to drop are few by construction: a host has at most (lines per page) / RATIO of them. They are
gathered into one array a host, which is broadcast if all hosts together have at most BROADCAST hashes
(8 bytes each) and joined on the host otherwise. Two lines of one host with the same hash would be
taken for one; at a billion lines a host that is expected less than once in ten million hosts.

All occurrences of such a line go, none is kept. On a host of up to MIN_PAGES / RATIO (37) pages any line on three pages
goes. Copies are pages like others: where one group of copies is over RATIO of its host's pages, all its
lines go from all of them, so that only blank lines of that text are left in the host.

Cases: a null text stays null and has no lines, but its page counts for the host. An empty text has one
blank line. Pages without a host (null) form one group. A line repeated in a page counts once for the
page and is dropped each time. Repeated rows count each. An empty table gives an empty result. A doc_id
that is no number is null in the report. Other columns are kept, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from centra.llm.shared import SPACE, cut

RATIO, MIN_PAGES = 0.08, 3
BROADCAST = 1_000_000


def _trimmed(line: Column) -> Column:
    return F.btrim(line, F.lit(SPACE))


def _lines(text: str) -> Column:
    return F.split(F.col(text), "\n", -1)


def boilerplate(docs: DataFrame, host: str, text: str, ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """host_, hash_, pages_ of the lines to drop."""
    pages = docs.groupBy(F.col(host).alias("host_")).agg(F.count("*").alias("total_"))
    hashes = F.array_distinct(F.transform(F.filter(_lines(text), lambda x: _trimmed(x) != ""), lambda x: F.xxhash64(_trimmed(x))))
    counted = docs.select(F.col(host).alias("host_"), F.explode(hashes).alias("hash_")).groupBy("host_", "hash_").agg(F.count("*").alias("pages_")).where(F.col("pages_") >= min_pages)
    # Hosts are few next to lines, and rows of a host were already summed: this joins counts, not pages.
    joined = counted.join(pages.withColumnRenamed("host_", "of_"), F.col("host_").eqNullSafe(F.col("of_")))
    return joined.where(F.col("pages_") > ratio * F.col("total_")).select("host_", "hash_", "pages_")


def dedup_lines(docs: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES, removed: str | None = None) -> DataFrame:
    """The documents without their hosts' boilerplate lines; `removed`, if named, gets the number of lines dropped."""
    # Written once, as its size decides how it is joined.
    drop = cut(boilerplate(docs, host, text, ratio, min_pages).groupBy("host_").agg(F.collect_set("hash_").alias("drop__"), F.count("*").alias("n__")))
    names = docs.columns
    drop = drop.withColumnRenamed("host_", "host__")
    n = drop.agg(F.sum("n__")).first()[0] or 0
    drop = drop.drop("n__")
    joined = docs.join(F.broadcast(drop) if n <= BROADCAST else drop, docs[host].eqNullSafe(drop["host__"]), "left")
    lines = F.split(docs[text], "\n", -1)
    kept = F.filter(lines, lambda x: (_trimmed(x) == "") | ~F.array_contains(F.col("drop__"), F.xxhash64(_trimmed(x))))
    clean = joined.select(*[docs[c] for c in names if c != text], docs[text].alias("old__"), F.when(F.col("drop__").isNull(), lines).otherwise(kept).alias("kept__"), F.size(lines).alias("size__"))
    extra = [F.coalesce(F.col("size__") - F.size("kept__"), F.lit(0)).cast("bigint").alias(removed)] if removed else []
    return clean.select(*[F.array_join("kept__", "\n").alias(c) if c == text else F.col(c) for c in names], *extra)


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_removed, text_sha256 of what is left (null for a null text)."""
    lines = F.when(F.col("text").isNull(), 0).otherwise(F.size(_lines("text"))).cast("bigint")
    chosen = docs.select(F.expr("try_cast(doc_id AS bigint)").alias("doc_id"), F.col("source"), F.col("text"), lines.alias("n_lines"))
    return dedup_lines(chosen, removed="n_removed").select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("text_sha256"))
