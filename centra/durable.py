"""Ending a frame's lineage in storage that outlives executors."""

from __future__ import annotations

import tempfile
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession

#: Tables that each application has written.
_WRITTEN: dict[str, list[str]] = {}


def folder(session: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names, shared by the driver and all executors. Only a local master gets a temporary one where it is unset."""
    context = session.sparkContext
    named = session.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if named:
        return named
    set_before = context._jsc.sc().getCheckpointDir()
    if set_before.isEmpty():
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoint-"))
    return context._jsc.sc().getCheckpointDir().get()


def cut(frame: DataFrame) -> DataFrame:
    """Write the frame to a table in that folder, and read it from there.

    A table carries over neither the plan nor the constraints that were inferred for it, which in
    a loop grow with every round, and is smaller than the rows of a checkpoint. It stays until `clear`.
    """
    session = frame.sparkSession
    path = f"{folder(session).rstrip('/')}/tables/{uuid4().hex}"
    frame.write.parquet(path)
    _WRITTEN.setdefault(session.sparkContext.applicationId, []).append(path)
    return session.read.schema(frame.schema).parquet(path)


def clear(session: SparkSession) -> int:
    """Delete the tables that `cut` wrote in this application; what was read from them can't be used any more."""
    paths = _WRITTEN.pop(session.sparkContext.applicationId, [])
    jvm = session.sparkContext._jvm
    for p in paths:
        at = jvm.org.apache.hadoop.fs.Path(p)
        at.getFileSystem(session.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    return len(paths)
