"""Distances, each as a Column expression and as a NumPy kernel of the same meaning.

Names: ``Euclidean`` (and ``fast``, ``short``) is the *squared* L2 distance; ``mips`` the negative inner product.
``fast`` and ``short`` refuse operands of unequal element types when asked to be strict. Empty vectors are 0 apart.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from enum import Enum

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Metric(Enum):
    L2 = "l2"
    INNER_PRODUCT = "inner_product"
    FAST_L2 = "fast_l2"
    PQ = "pq"


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def l2(a: Column, b: Column) -> Column:
    """Squared L2, summed from the first element on."""
    return _sum(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))))


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def mips(a: Column, b: Column) -> Column:
    return -dot(a, b)


def norm(a: Column) -> Column:
    """The squared norm."""
    return _sum(F.transform(a, lambda x: x.cast("double") * x.cast("double")))


def l2_via_dot(a: Column, b: Column, norm_b: Column) -> Column:
    """norm_b - 2 a.b: orders b as l2 does, for a fixed a."""
    return norm_b - 2 * dot(a, b)


def sqrt_l2(a: Column, b: Column) -> Column:
    return F.sqrt(l2(a, b))


def pq_distance(table: Column, code: Column) -> Column:
    """The sum over blocks j of table[j][code[j]]."""
    return _sum(F.transform(code, lambda c, j: F.get(F.get(table, j), c).cast("double")))


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two integers."""
    return F.bit_count(a.bitwiseXOR(b))


def _np_l2(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """All squared distances by one matrix product; see `nearest` for what that may blur."""
    return np.maximum((x**2).sum(1)[:, None] - 2 * (x @ c.T) + (c**2).sum(1)[None, :], 0)


def _np_l2_rows(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return ((x - y) ** 2).sum(-1)


@dataclass(frozen=True)
class Distance:
    name: str
    column: Callable[[Column, Column], Column]
    table: Callable[[np.ndarray, np.ndarray], np.ndarray]
    rows: Callable[[np.ndarray, np.ndarray], np.ndarray]
    strict: bool = False

    def check(self, a: T.DataType, b: T.DataType) -> None:
        if self.strict and a != b:
            raise ValueError(f"{self.name} compares vectors of one element type, not {a.simpleString()} and {b.simpleString()}")


REGISTRY: dict[str, Distance] = {}


def register(distance: Distance) -> Distance:
    """Adds a distance, so that every initializer and runner can be given its name."""
    REGISTRY[distance.name.lower()] = distance
    return distance


register(Distance("Euclidean", l2, _np_l2, _np_l2_rows))
register(Distance("fast", l2, _np_l2, _np_l2_rows, True))
register(Distance("short", l2, _np_l2, _np_l2_rows, True))
register(Distance("mips", mips, lambda x, c: -(x @ c.T), lambda x, y: -(x * y).sum(-1)))


def named(name: str | Distance = "Euclidean") -> Distance:
    if isinstance(name, Distance):
        return name
    if name.lower() not in REGISTRY:
        raise ValueError(f"unknown distance {name!r}; known: {sorted(REGISTRY)}")
    return REGISTRY[name.lower()]


#: Entries of one table of distances in a worker.
ENTRIES = 4_000_000


def nearest(x: np.ndarray, centers: np.ndarray, distance: Distance, current: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Each row's nearest center and its distance; the lowest index wins a tie, or `current` if given and as near.

    The matrix product loses digits that a tie may hang on. Rows whose two best are closer than that loss are
    decided by differences, coordinate by coordinate.
    """
    best, dist = np.zeros(len(x), "i8"), np.zeros(len(x))
    step = max(1, ENTRIES // max(1, len(centers)))
    scale = (centers**2).sum(1).max() if centers.size else 0.0
    for a in range(0, len(x), step):
        rows = x[a : a + step]
        table = distance.table(rows, centers)
        top = table.argmin(1)
        if len(centers) > 1:
            least = table[np.arange(len(rows)), top]
            slack = 1e-12 * ((rows**2).sum(1) + scale + 1e-300)
            close = (table <= (least + slack)[:, None]).sum(1) > 1
            for i in np.flatnonzero(close):
                among = np.flatnonzero(table[i] <= least[i] + slack[i])
                exact = distance.rows(rows[i][None, :], centers[among])
                top[i] = among[exact.argmin()]
        near = distance.rows(rows, centers[top])
        if current is not None:
            own = distance.rows(rows, centers[current[a : a + step]])
            stay = own <= near
            top, near = np.where(stay, current[a : a + step], top), np.where(stay, own, near)
        best[a : a + step], dist[a : a + step] = top, near
    return best, dist
