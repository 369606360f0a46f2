"""DuckDB SQL for the clustering queries, built from a few parts: points, distances, assignment, means, and chains of them."""

from __future__ import annotations

import numpy as np

POINTS = "p AS MATERIALIZED (SELECT vec_id AS id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings)"


def d2(a: str, b: str) -> str:
    return f"coalesce(list_sum(list_transform(list_zip({a}, {b}), lambda t: (t[1] - t[2]) * (t[1] - t[2]))), 0)"


def dot(a: str, b: str) -> str:
    return f"coalesce(list_sum(list_transform(list_zip({a}, {b}), lambda t: t[1] * t[2])), 0)"


def first_k(k: int, points: str = "p", name: str = "c0") -> str:
    return f"{name} AS MATERIALIZED (SELECT id AS cid, v AS c FROM {points} WHERE id < {k})"


def assign(name: str, centers: str, points: str = "p", distance=d2) -> str:
    return f"{name} AS MATERIALIZED (SELECT id, any_value(v) AS v, arg_min(cid, struct_pack(d := d, cid := cid)) AS cid, min(d) AS d FROM (SELECT id, v, cid, {distance('v', 'c')} AS d FROM {points}, {centers}) GROUP BY id)"


def mean(name: str, assigned: str, old: str) -> str:
    means = f"SELECT cid, list(x ORDER BY pos) AS c FROM (SELECT cid, pos, avg(x) AS x FROM (SELECT cid, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM {assigned}) GROUP BY cid, pos) GROUP BY cid"
    return f"{name} AS MATERIALIZED (SELECT o.cid, coalesce(m.c, o.c) AS c FROM {old} o LEFT JOIN ({means}) m USING (cid))"


def chain(k: int, iterations: int, points: str = "p", prefix: str = "", start: bool = True) -> list[str]:
    """c0, then a0, c1, a1, c2 ...: a<i> is the assignment to c<i>."""
    out = [first_k(k, points, f"{prefix}c0")] if start else []
    for i in range(iterations):
        out += [assign(f"{prefix}a{i}", f"{prefix}c{i}", points), mean(f"{prefix}c{i + 1}", f"{prefix}a{i}", f"{prefix}c{i}")]
    return out


def query(parts: list[str], select: str, points: str = POINTS) -> str:
    return f"WITH {', '.join([points, *parts])} {select}"


def cells(centers: str, digits: int = 6) -> str:
    return f"SELECT cid, (pos - 1)::INTEGER AS pos, round(x, {digits}) AS value FROM (SELECT cid, unnest(c) AS x, generate_subscripts(c, 1) AS pos FROM {centers})"


def numbers(row) -> str:
    return "[" + ", ".join(repr(float(x)) for x in row) + "]"


def planes(name: str, matrix: np.ndarray) -> str:
    return f"{name} AS MATERIALIZED (SELECT * FROM (VALUES {', '.join(f'({i}, {numbers(row)})' for i, row in enumerate(matrix))}) t(i, w))"


def hashes(name: str, plane: str = "h", points: str = "p") -> str:
    return f"{name} AS MATERIALIZED (SELECT id, any_value(v) AS v, sum(CASE WHEN {dot('v', 'w')} > 0 THEN 1::BIGINT << i ELSE 0 END)::BIGINT AS hash FROM {points}, {plane} GROUP BY id)"


def bytes_(name: str, plane: str = "h", points: str = "p") -> str:
    return f"{name} AS MATERIALIZED (SELECT id, list(b ORDER BY byte) AS v FROM (SELECT id, i // 8 AS byte, sum(CASE WHEN {dot('v', 'w')} > 0 THEN 1 << (i % 8) ELSE 0 END)::DOUBLE AS b FROM {points}, {plane} GROUP BY id, i // 8) GROUP BY id)"
