"""Command line: python -m centra.cli -i FILE -k 10 -m 1000 -t float ..."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from centra.operators.init import INITIALIZERS
from centra.plans import bench
from centra.plans.runners import RUNNERS
from centra.sources.vector_files import KINDS, read_vectors


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="centra", description="k-means over a file of vectors")
    p.add_argument("mode", nargs="?", default="run", choices=["run", "compare", "init", "assign", "update", "group"])
    p.add_argument("-i", "--input", required=True)
    p.add_argument("-f", "--format", default="bin", choices=["bin", "vec"])
    p.add_argument("-t", "--type", default="uint8", choices=sorted(KINDS))
    p.add_argument("-k", type=int, default=10)
    p.add_argument("-m", "--max-iter", type=int, default=1000)
    p.add_argument("-n", type=int, default=0, help="use the first n points only")
    p.add_argument("-D", "--distance", default="Euclidean", choices=["Euclidean", "mips", "short", "fast"])
    p.add_argument("-c", "--init", default="MacQueen", choices=sorted(INITIALIZERS))
    p.add_argument("-r", "--runner", default="Naive", choices=sorted(RUNNERS))
    p.add_argument("--with", dest="other", default="YinyangImproved", choices=sorted(RUNNERS), help="the second runner of compare")
    p.add_argument("--epsilon", type=float, default=0.0)
    p.add_argument("--csv-folder", help="where the run's log is written")
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    if a.format == "vec" and not a.input.endswith((".fvecs", ".bvecs")):
        raise ValueError("vec files are told by their names, .fvecs or .bvecs")
    spark = spark or SparkSession.builder.appName("centra").getOrCreate()
    points = read_vectors(spark, a.input, None if a.format == "vec" else a.type)
    if a.n:
        points = points.where(f"id < {a.n}")
    if a.mode == "run":
        result = bench.full(points, a.k, a.init, a.runner, a.distance, a.max_iter, a.epsilon)
        print(result.log.summary())
        if a.csv_folder:
            print(result.log.write(a.csv_folder))
    elif a.mode == "compare":
        both = bench.compare(points, a.k, (a.runner, a.other), a.max_iter, a.epsilon, a.distance)
        print(f"{both['differ']} points differ; seconds {both['times'][0]:.3f} and {both['times'][1]:.3f}")
    elif a.mode == "init":
        print(bench.inits(points, a.k, [a.init], a.distance)[0].to_csv(), end="")
    elif a.mode == "assign":
        print(bench.assignment(points, a.k, None, a.distance))
    elif a.mode == "update":
        rows = bench.updates(points, a.k)
        print(bench.updates_csv(rows, len(points.first()["v"]), a.k), end="")
    else:
        print(bench.grouping(points, a.k))
    return 0


if __name__ == "__main__":
    sys.exit(main())
