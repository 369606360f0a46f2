"""Vector files: fbin, u8bin and i8bin (n and d as little-endian int32, then the rows), fvecs and bvecs (d before each
row), and text embeddings (a key, a tab, comma-separated numbers).

Ids are places in the file.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = {"float": ("<f4", 4), "uint8": ("<u1", 1), "int8": ("<i1", 1)}
SUFFIXES = {".fbin": "float", ".u8bin": "uint8", ".i8bin": "int8"}
HEADER = 8


def _kind(kind: str) -> tuple[str, int]:
    if kind not in KINDS:
        raise ValueError(f"element type must be one of {sorted(KINDS)}, not {kind!r}")
    return KINDS[kind]


def _opened(path: str):
    """A file system and the path in it: local or shared paths, hdfs, s3, gs and what else Arrow knows, for files of any size."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))


def _head(path: str, size: int) -> tuple[bytes, int]:
    """The first bytes of a file, and its length."""
    files, name = _opened(path)
    with files.open_input_file(name) as f:
        return f.read_at(size, 0), f.size()


def header(spark: SparkSession, path: str) -> tuple[int, int]:
    """n and d."""
    return struct.unpack("<ii", _head(path, HEADER)[0])


def read_bin(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """id, v of a vector file with a header."""
    code, size = _kind(kind)
    n, d = header(spark, path)
    if n <= 0 or d <= 0:
        return spark.createDataFrame([], "id bigint, v array<double>")
    if _head(path, HEADER)[1] < HEADER + n * d * size:
        raise ValueError(f"the file is shorter than {n} x {d} of {kind}")
    return _ranged(spark, path, n, d, kind, HEADER, 0)


#: Bytes of the range of a file that one task reads, and of what it holds at once as doubles.
RANGE, HELD = 32 << 20, 4 << 20


def _ranged(spark: SparkSession, path: str, n: int, d: int, kind: str, skip: int, lead: int) -> DataFrame:
    """n records of `lead` bytes and a row, after `skip` bytes, in ranges, each read by a task of its own."""
    code, size = KINDS[kind]
    width = lead + d * size
    per = max(1, RANGE // width)
    parts = -(-n // per)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from centra.operators.points import lists

        files, name = _opened(path)
        for b in batches:
            for part in b.column(0).to_pylist():
                with files.open_input_file(name) as f:
                    step = max(1, HELD // (d * 8))
                    for at in range(part * per, min(n, (part + 1) * per), step):
                        rows = min(step, min(n, (part + 1) * per) - at)
                        raw = f.read_at(rows * width, skip + at * width)
                        if len(raw) < rows * width:
                            raise ValueError(f"the file is shorter than {n} x {d} of {kind}")
                        whole = np.frombuffer(raw, "u1").reshape(rows, width)
                        if lead and (np.ascontiguousarray(whole[:, :lead]).view("<i4") != d).any():
                            raise ValueError(f"not all vectors have {d} coordinates")
                        x = np.ascontiguousarray(whole[:, lead:]).view(code)
                        yield pa.RecordBatch.from_arrays([pa.array(np.arange(at, at + rows), pa.int64()), lists(x.astype("f8"))], ["id", "v"])

    return spark.range(0, parts, 1, parts).mapInArrow(run, "id bigint, v array<double>")


def read_vecs(spark: SparkSession, path: str, kind: str = "float") -> DataFrame:
    """id, v of an fvecs (float) or bvecs (uint8) file: records of d and the row, of one length."""
    _, size = _kind(kind)
    raw, length = _head(path, 4)
    if len(raw) < 4:
        return spark.createDataFrame([], "id bigint, v array<double>")
    d = struct.unpack("<i", raw)[0]
    if d <= 0 or length % (4 + d * size):
        raise ValueError(f"{length} bytes are no whole number of vectors of {d} x {kind}")
    return _ranged(spark, path, length // (4 + d * size), d, kind, 0, 4)


def read_vectors(spark: SparkSession, path: str, kind: str | None = None) -> DataFrame:
    """id, v; the format is told by the file's name, the element type by it too unless given."""
    if path.endswith((".fvecs", ".bvecs")):
        return read_vecs(spark, path, "float" if path.endswith(".fvecs") else "uint8")
    found = kind or next((k for s, k in SUFFIXES.items() if path.endswith(s)), None)
    if found is None:
        raise ValueError(f"the element type of {path} must be given")
    return read_bin(spark, path, found)


def write_bin(points: DataFrame, path: str, kind: str) -> tuple[int, int]:
    """A vector file in the order of the id: every task writes its rows at their place, into a path that all executors share."""
    from centra.operators.lsh import ranks

    code, size = _kind(kind)
    if "://" in path and not path.startswith("file://"):
        raise ValueError("places in a file can only be written in a shared path, not in an object store")
    name = path.removeprefix("file://").removeprefix("file:")
    n, d, least = points.agg(F.count("*"), F.max(F.size("v")), F.min(F.size("v"))).first()
    if d != least:
        raise ValueError("vectors must all have the same length")
    d = d or 0
    with open(name, "wb") as f:
        f.write(struct.pack("<ii", n, d))
        f.truncate(HEADER + n * d * size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from centra.operators.points import matrix

        with open(name, "r+b") as f:
            for b in batches:
                if not b.num_rows:
                    continue
                place, x = b.column(0).to_numpy(), matrix(b.column(1), d)
                order = np.argsort(place)
                place, x = place[order], x[order]
                raw = (x if code == "<f4" else np.trunc(x)).astype(code)
                for run_ in np.split(np.arange(len(place)), np.flatnonzero(np.diff(place) != 1) + 1):
                    f.seek(HEADER + int(place[run_[0]]) * d * size)
                    f.write(raw[run_].tobytes())
                yield pa.RecordBatch.from_arrays([pa.array([len(place)], pa.int64())], ["n"])

    if n:
        written = ranks(points.select("id", "v"), "id").select("place", "v").mapInArrow(run, "n bigint").agg(F.sum("n")).first()[0]
        if written != n:
            raise RuntimeError(f"{written} of {n} rows were written")
    return n, d


def vectors_to_csv(points: DataFrame, path: str) -> None:
    """id and coordinates, a column each, as CSV files with a header in a folder."""
    d = points.select(F.size("v")).first()[0]
    points.select("id", *[F.get("v", F.lit(j)).alias(f"x{j}") for j in range(d)]).write.mode("overwrite").option("header", True).csv(path)


def scatter(points: DataFrame, assigned: DataFrame, x: int = 0, y: int = 1) -> DataFrame:
    """id, x, y, cid: two coordinates of the points with their clusters, as a scatter plot takes them."""
    own = points.select("id", F.get("v", F.lit(x)).alias("x"), F.get("v", F.lit(y)).alias("y"))
    return own.join(assigned.select("id", "cid"), "id")


def read_text_embeddings(spark: SparkSession, path: str) -> DataFrame:
    """key, v of lines `key<TAB>x,x,...`; lines without a tab are left out."""
    lines = spark.read.text(path).where(F.instr("value", "\t") > 0)
    return lines.select(F.substring_index("value", "\t", 1).alias("key"), F.transform(F.split(F.substring_index("value", "\t", -1), ","), lambda x: F.trim(x).cast("double")).alias("v"))


def text_to_bin(spark: SparkSession, path: str, out: str) -> tuple[int, int]:
    """Text embeddings, in the order of the lines, to an fbin file."""
    from centra.operators.lsh import ranks

    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line")).where(F.instr("value", "\t") > 0)
    placed = ranks(lines, "file", "block", "line")
    return write_bin(placed.select(F.col("place").alias("id"), F.transform(F.split(F.substring_index("value", "\t", -1), ","), lambda x: F.trim(x).cast("double")).alias("v")), out, "float")
