"""CSV tables as record files and back: the number of rows, then for each row its number of fields, and each field as a length and UTF-8 bytes; all numbers are little-endian int32."""

from __future__ import annotations

import csv
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def csv_to_records(path: str, out: str) -> int:
    with open(path, newline="", encoding="utf-8") as f:
        rows = list(csv.reader(f))
    with open(out, "wb") as f:
        f.write(struct.pack("<i", len(rows)))
        for row in rows:
            f.write(struct.pack("<i", len(row)))
            for value in row:
                raw = value.encode()
                f.write(struct.pack("<i", len(raw)) + raw)
    return len(rows)


def decode(raw: bytes) -> Iterator[list[str]]:
    n, at = struct.unpack_from("<i", raw)[0], 4
    for _ in range(n):
        fields, row = struct.unpack_from("<i", raw, at)[0], []
        at += 4
        for _ in range(fields):
            size = struct.unpack_from("<i", raw, at)[0]
            row.append(raw[at + 4 : at + 4 + size].decode())
            at += 4 + size
        yield row


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """row, fields of a record file; rows may differ in length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column(0).to_pylist():
                rows = list(decode(content))
                yield pa.RecordBatch.from_arrays([pa.array(range(len(rows)), pa.int64()), pa.array(rows, pa.list_(pa.string()))], ["row", "fields"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "row bigint, fields array<string>")


def records_to_csv(path: str, out: str) -> int:
    with open(path, "rb") as f, open(out, "w", newline="", encoding="utf-8") as g:
        rows = list(decode(f.read()))
        csv.writer(g, lineterminator="\n").writerows(rows)
    return len(rows)
