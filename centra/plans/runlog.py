"""Run logs: records, their tables, and the two-section CSV."""

from __future__ import annotations

import csv
import io
import os
from dataclasses import asdict, dataclass, field
from datetime import date
from time import perf_counter

import numpy as np
from pyspark.sql import DataFrame, SparkSession


@dataclass
class Iteration:
    assign_time: float = 0.0
    update_time: float = 0.0
    setup_time: float = 0.0
    msse: float = 0.0
    distance_calls: int = 0
    center_reassignments: int = 0
    movement_min: float = 0.0
    movement_mean: float = 0.0
    movement_max: float = 0.0
    quantized_msse: float = 0.0


@dataclass
class RunLog:
    """One run: its setting, and a record for each iteration."""

    n: int
    d: int
    k: int
    runner: str
    init: str = ""
    max_iter: int = 0
    epsilon: float = 0.0
    iterations: list[Iteration] = field(default_factory=list)
    total_time: float = 0.0
    _began: float = 0.0

    def start(self) -> None:
        self._began = perf_counter()

    def end(self) -> None:
        self.total_time = perf_counter() - self._began

    def add(self, assign_time: float, update_time: float, msse: float, calls: int, reassigned: int, movement: np.ndarray, setup_time: float = 0.0, quantized: float = 0.0) -> None:
        m = movement if len(movement) else np.zeros(1)
        self.iterations.append(Iteration(assign_time, update_time, setup_time, float(msse), int(calls), int(reassigned), float(m.min()), float(m.mean()), float(m.max()), float(quantized)))

    def header(self) -> dict:
        total = lambda name: sum(getattr(i, name) for i in self.iterations)
        return {
            "n": self.n, "d": self.d, "k": self.k, "iterations": len(self.iterations), "max_iter": self.max_iter, "epsilon": self.epsilon,
            "total_time": self.total_time, "init": self.init, "runner": self.runner, "assign_time": total("assign_time"), "update_time": total("update_time"), "setup_time": total("setup_time"),
            "average_iteration_time": self.total_time / max(1, len(self.iterations)), "msse": self.iterations[-1].msse if self.iterations else 0.0,
        }

    def run_frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([self.header()])

    def iteration_frame(self, spark: SparkSession) -> DataFrame:
        kinds = "iteration int, assign_time double, update_time double, setup_time double, msse double, distance_calls bigint, center_reassignments bigint, movement_min double, movement_mean double, movement_max double, quantized_msse double"
        return spark.createDataFrame([(i, *asdict(x).values()) for i, x in enumerate(self.iterations)], kinds)

    def to_csv(self) -> str:
        """Names and values of the run, then names and a row for each iteration."""
        out = io.StringIO()
        w = csv.writer(out, lineterminator="\n")
        w.writerow(self.header().keys())
        w.writerow(self.header().values())
        w.writerow(["iteration", *asdict(Iteration())])
        w.writerows([i, *asdict(x).values()] for i, x in enumerate(self.iterations))
        return out.getvalue()

    def write(self, folder: str, on: date | None = None) -> str:
        path = os.path.join(folder, f"bench_{self.runner}_{self.n}_{self.d}_{self.k}_{(on or date.today()).strftime('%m_%d_%Y')}.csv")
        with open(path, "w", encoding="utf-8") as f:
            f.write(self.to_csv())
        return path

    def summary(self) -> str:
        h = self.header()
        return ", ".join(f"{k} {v:.6g}" if isinstance(v, float) else f"{k} {v}" for k, v in h.items())


@dataclass
class InitLog:
    n: int
    d: int
    k: int
    name: str
    time: float
    msse: float
    labeled: list[tuple[str, float]] = field(default_factory=list)

    def to_csv(self) -> str:
        out = io.StringIO()
        w = csv.writer(out, lineterminator="\n")
        w.writerow(["n", "d", "k", "init_name", "time", "msse"])
        w.writerow([self.n, self.d, self.k, self.name, self.time, self.msse])
        if self.labeled:
            w.writerow([label for label, _ in self.labeled])
            w.writerow([t for _, t in self.labeled])
        return out.getvalue()

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(self.n, self.d, self.k, self.name, self.time, self.msse)], "n bigint, d bigint, k bigint, init_name string, time double, msse double")


def parse_run(text: str) -> tuple[dict[str, str], list[dict[str, str]]]:
    """A run's CSV back to its header and its iterations, by the place of the columns' names."""
    rows = list(csv.reader(io.StringIO(text)))
    names = rows[2] if len(rows) > 2 else []
    return dict(zip(rows[0], rows[1], strict=False)), [dict(zip(names, r, strict=False)) for r in rows[3:]]


def parse_init(text: str) -> dict[str, str]:
    rows = list(csv.reader(io.StringIO(text)))
    return dict(zip(rows[0], rows[1], strict=False)) | (dict(zip(rows[2], rows[3], strict=False)) if len(rows) > 3 else {})
