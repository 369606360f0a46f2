"""All queries of the clustering engine by name, and the same results as SQL."""

from __future__ import annotations

import csv
import os
from collections.abc import Callable
from uuid import uuid4

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from centra.durable import folder
from centra.functions import distance as dist
from centra.operators import assign, init, lsh, primitives, update
from centra.operators.points import cells, first_k, from_columns, from_embeddings, literal
from centra.plans import oracle as sql
from centra.plans import quantized, report
from centra.plans.ball import center_distances, neighbors, radii
from centra.plans.lloyd import Result
from centra.plans.runlog import RunLog
from centra.plans.runners import POLICIES, cluster
from centra.plans.yinyang import begin, drift, group_centers
from centra.sources import record_files, vector_files

K, ITERATIONS, D = 10, 5, 64
DRAWS = [0.37, 0.61, 0.12, 0.83, 0.45]
PLANES = np.round(lsh.hyperplanes(D, 32, 7), 6)
ROTATION = np.round(np.linalg.qr(np.random.default_rng(11).normal(size=(D, D)))[0], 8)
#: Group of each of the K centers, for the queries by group.
GROUPS = [i % 3 for i in range(K)]

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(text: str | None = None, name: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        key = name or f.__name__
        _QUERIES[key] = f
        if text:
            _SQL[key] = text
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_embeddings(spark, sf_dir)


def _r(c, digits: int = 6):
    return F.round(c, digits)


# Distances: every point against the first K.


def _pairs(column, value: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        points = _points(spark, sf_dir)
        few = literal(first_k(points, K))
        each = points.select("id", F.posexplode(F.transform(few, lambda c: column(F.col("v"), c))).alias("c_", "d_"))
        return each.select("id", F.col("c_").cast("bigint").alias("cid"), (_r("d_") + 0.0).alias(value))  # no -0

    return run


_NORM = "coalesce(list_sum(list_transform({}, lambda x: x * x)), 0)"
for _name, _column, _text in (
    ("dist_l2_pairs", dist.l2, sql.d2("a.v", "b.c")),
    ("dist_fast_pairs", dist.named("fast").column, sql.d2("a.v", "b.c")),
    ("dist_short_pairs", dist.named("short").column, sql.d2("a.v", "b.c")),
    ("dist_mips_pairs", dist.mips, f"-{sql.dot('a.v', 'b.c')}"),
    ("dist_dot_pairs", dist.dot, sql.dot("a.v", "b.c")),
    ("dist_l2_via_dot", lambda a, b: dist.l2_via_dot(a, b, dist.norm(b)), f"{_NORM.format('b.c')} - 2 * {sql.dot('a.v', 'b.c')}"),
    ("dist_sqrt_pairs", dist.sqrt_l2, f"sqrt({sql.d2('a.v', 'b.c')})"),
):
    _SQL[_name] = sql.query([sql.first_k(K)], f"SELECT a.id, b.cid, round({_text}, 6) + 0.0 AS d FROM p a, c0 b")
    _QUERIES[_name] = _pairs(_column, "d")


@query(sql.query([], f"SELECT id, round({_NORM.format('v')}, 6) AS norm FROM p"))
def dist_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _points(spark, sf_dir).select("id", _r(dist.norm(F.col("v"))).alias("norm"))


@query("SELECT vec_id AS id, bit_count(xor(vec_id, vec_id * 7 + 3))::INTEGER AS bits FROM embeddings")
def dist_hamming(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _points(spark, sf_dir).select("id", dist.hamming(F.col("id"), F.col("id") * 7 + 3).alias("bits"))


# Initializers.


@query(f"SELECT vec_id AS id, vec_id % {K} AS cid FROM embeddings")
def init_lazy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return init.lazy(_points(spark, sf_dir), K)[1]


@query(sql.query([sql.first_k(K)], sql.cells("c0")))
def init_lazy_centers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cells(spark, init.lazy(_points(spark, sf_dir), K)[0])


def _class_means(cid: str) -> str:
    return sql.query([f"a AS (SELECT id, v, {cid} AS cid FROM p)", f"z AS (SELECT i AS cid, list_transform(range({D}), lambda x: 0.0::DOUBLE) AS c FROM range({K}) t(i))", sql.mean("m", "a", "z")], sql.cells("m"))


@query(_class_means(f"id % {K}"))
def init_forgy_centers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cells(spark, init.forgy(_points(spark, sf_dir), K)[0])


_DRAWN = f"(xor((id * 1103515245 + 12345) % 2147483648, 12345) % 1000003) % {K}"


@query(_class_means(_DRAWN))
def init_forgy_random_centers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cells(spark, init.forgy_random(_points(spark, sf_dir), K)[0])


@query(sql.query([], f"SELECT id, {_DRAWN} AS cid FROM p"))
def init_forgy_random(spark: SparkSession, sf_dir: str) -> DataFrame:
    return init.forgy_random(_points(spark, sf_dir), K)[1]


@query(sql.query([sql.first_k(K), sql.assign("a", "c0")], "SELECT id, cid FROM a"))
def init_macqueen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return init.macqueen(_points(spark, sf_dir), K)[1]


def _plus_plus_sql() -> str:
    parts = [f"f0 AS (SELECT id, v FROM p WHERE id = (SELECT least(count(*) - 1, floor({DRAWS[0]!r} * count(*)))::BIGINT FROM p))", "w0 AS MATERIALIZED (SELECT p.id, p.v, " + sql.d2("p.v", "f0.v") + " AS w FROM p, f0)"]
    for i, u in enumerate(DRAWS[1:], 1):
        parts += [
            f"s{i} AS MATERIALIZED (SELECT id, coalesce(sum(w) OVER (ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS e FROM w{i - 1})",
            f"f{i} AS MATERIALIZED (SELECT id, v FROM p WHERE id = (SELECT max(id) FROM s{i} WHERE e <= {u!r} * (SELECT sum(w) FROM w{i - 1})))",
            f"w{i} AS MATERIALIZED (SELECT q.id, q.v, least(q.w, {sql.d2('q.v', f'f{i}.v')}) AS w FROM w{i - 1} q, f{i})",
        ]
    parts.append("c AS (" + " UNION ALL ".join(f"SELECT {i}::BIGINT AS cid, v AS c FROM f{i}" for i in range(len(DRAWS))) + ")")
    return sql.query(parts, sql.cells("c"))


@query(_plus_plus_sql())
def init_kmeanspp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cells(spark, init.kmeans_plus_plus(_points(spark, sf_dir), len(DRAWS), draws=DRAWS)[0])


_HASHED = [sql.planes("h", PLANES), sql.hashes("x")]
_CHUNKED = [*_HASHED, f"a AS MATERIALIZED (SELECT id, v, hash, ((row_number() OVER (ORDER BY hash, id) - 1) * {K} // (SELECT count(*) FROM p))::BIGINT AS cid FROM x)"]


@query(sql.query(_CHUNKED, "SELECT id, hash, cid FROM a"))
def init_lsh(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = _points(spark, sf_dir)
    return init.chunked(points, K, points.count(), PLANES).select("id", "hash", "cid")


@query(sql.query([*_CHUNKED, "z AS (SELECT id AS cid, v AS c FROM p WHERE id < 10)", sql.mean("m", "a", "z")], sql.cells("m")))
def init_lsh_centers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cells(spark, init.lsh_chunks(_points(spark, sf_dir), K, planes=PLANES, exact=False)[0])  # like the SQL, for any number of points


@query(sql.query(_HASHED, "SELECT id, hash FROM x"))
def lsh_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _points(spark, sf_dir).select("id", lsh.hash_of(F.col("v"), PLANES).alias("hash"))


@query(sql.query([sql.planes("h", PLANES), sql.bytes_("x")], "SELECT id, (generate_subscripts(v, 1) - 1)::INTEGER AS pos, unnest(v)::INTEGER AS byte FROM x"))
def lsh_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _points(spark, sf_dir).select("id", F.posexplode(lsh.bytes_of(F.col("v"), PLANES)).alias("pos", "byte"))


@query(f"SELECT vec_id AS id, label FROM embeddings WHERE vec_id IN ({', '.join(map(str, init.stratified(500, 25, 3)))})")
def stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    frame = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return frame.where(F.col("vec_id").isin(init.stratified(frame.count(), 25, 3))).select(F.col("vec_id").alias("id"), "label")


# Assignment.

_FIRST = [sql.first_k(K), sql.assign("a", "c0")]


@query(sql.query(_FIRST, "SELECT id, cid, round(d, 6) AS d FROM a"))
def assign_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = _points(spark, sf_dir)
    return assign.by_expression(points, first_k(points, K)).select("id", "cid", _r("d").alias("d"))


@query(sql.query(_FIRST, "SELECT id, cid, round(d, 6) AS d FROM a"))
def assign_nearest_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = _points(spark, sf_dir)
    return assign.assign(points, first_k(points, K)).select("id", "cid", _r("d").alias("d"))


@query(sql.query([sql.first_k(K), sql.assign("a", "c0", distance=lambda a, b: f"-{sql.dot(a, b)}")], "SELECT id, cid, round(d, 6) AS d FROM a"))
def assign_mips(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = _points(spark, sf_dir)
    return assign.by_expression(points, first_k(points, K), "mips").select("id", "cid", _r("d").alias("d"))


_CUSTOMERS = "p AS MATERIALIZED (SELECT c_custkey - (SELECT min(c_custkey) FROM customer) AS id, [c_acctbal, c_nationkey::DOUBLE] AS v FROM customer)"


def _customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    frame = spark.read.parquet(f"{sf_dir}/customer.parquet")
    least = frame.agg(F.min("c_custkey")).first()[0]
    return from_columns(frame.withColumn("key", F.col("c_custkey") - least), "key", ["c_acctbal", "c_nationkey"])


@query(sql.query([sql.first_k(K), "t AS (SELECT cid, list_transform(c, lambda x: trunc(x)) AS c FROM c0)", sql.assign("a", "t")], "SELECT id, cid, round(d, 4) AS d FROM a", _CUSTOMERS))
def assign_truncated(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = _customers(spark, sf_dir)
    return assign.by_expression(points, first_k(points, K), center_type="int").select("id", "cid", _r("d", 4).alias("d"))


@query(
    sql.query(
        [sql.first_k(K), *[f"c{i} AS (SELECT * FROM c0 UNION ALL SELECT cid + {K}, c FROM c0)" for i in (1,)], sql.assign("a", "c1"), f"o AS (SELECT p.id, {sql.d2('v', 'c')} AS d FROM p JOIN c1 ON cid = p.id % {2 * K})"],
        f"SELECT a.id, CASE WHEN a.d < o.d THEN a.cid ELSE a.id % {2 * K} END AS cid FROM a JOIN o USING (id)",
    )
)
def assign_keep_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = _points(spark, sf_dir)
    first = first_k(points, K)
    return assign.keep_ties(init.cyclic(points, 2 * K), np.concatenate([first, first])).select("id", "cid")


_ALL = [sql.first_k(K), f"e AS MATERIALIZED (SELECT id, cid, cid % 3 AS group_id, {sql.d2('v', 'c')} AS d FROM p, c0)"]


@query(sql.query(_ALL, "SELECT id, group_id, place, cid, round(d, 6) AS d FROM (SELECT *, row_number() OVER (PARTITION BY id, group_id ORDER BY d, cid)::INTEGER AS place FROM e) WHERE place <= 2"))
def top2_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = _points(spark, sf_dir)
    return assign.top2_by_group(points, first_k(points, K), GROUPS).withColumn("d", _r("d"))


@query(
    sql.query(
        [*_ALL, "r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, cid) AS place FROM e)"],
        "SELECT a.id, a.cid AS best, round(a.d, 6) AS d_best, b.cid AS second, round(b.d, 6) AS d_second FROM r a JOIN r b ON a.id = b.id AND a.place = 1 AND b.place = 2",
    )
)
def best_two(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = _points(spark, sf_dir)
    return assign.best_two(points, first_k(points, K)).withColumns({"d_best": _r("d_best"), "d_second": _r("d_second")})


# Updates.


@query(sql.query([*_FIRST, sql.mean("m", "a", "c0")], sql.cells("m")))
def group_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = _points(spark, sf_dir)
    c = first_k(points, K)
    return update.group_mean(assign.by_expression(points, c), c).withColumn("value", _r("value"))


@query(sql.query([*_FIRST, sql.mean("m", "a", "c0")], sql.cells("m")))
def group_mean_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = _points(spark, sf_dir)
    c = first_k(points, K)
    return cells(spark, update.mean_matrix(assign.by_expression(points, c), c)[0])


@query(sql.query([sql.first_k(K), f"far AS (SELECT * FROM c0 UNION ALL SELECT {K}, list_transform(range({D}), lambda x: 99.0::DOUBLE))", sql.assign("a", "far"), sql.mean("m", "a", "far")], sql.cells("m")))
def group_mean_empty_keeps(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = _points(spark, sf_dir)
    c = np.vstack([first_k(points, K), np.full(D, 99.0)])
    return update.group_mean(assign.by_expression(points, c), c).withColumn("value", _r("value"))


def _moved(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    points = _points(spark, sf_dir)
    own = init.cyclic(points, K)
    c, n = update.mean_matrix(own, np.zeros((K, D)))
    near = assign.by_expression(points, first_k(points, K)).select("id", "cid")
    return own.withColumnRenamed("cid", "old_cid").join(near, "id"), c, n


@query(sql.query([*_FIRST, sql.mean("m", "a", "c0")], sql.cells("m")))
def incremental_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cells(spark, update.incremental_mean(*_moved(spark, sf_dir))[0])


@query(sql.query([*_FIRST, sql.mean("m", "a", "c0")], sql.cells("m")))
def incremental_mean_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return update.incremental_rows(*_moved(spark, sf_dir)).withColumn("value", _r("value"))


@query(sql.query(_FIRST, f"SELECT i AS cid, count(a.id) AS n FROM range({K + 2}) t(i) LEFT JOIN a ON a.cid = i GROUP BY i"))
def member_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = _points(spark, sf_dir)
    return update.member_count(assign.by_expression(points, first_k(points, K)), K + 2)


@query(sql.query(_FIRST, "SELECT cid, string_agg(id::VARCHAR, ',' ORDER BY id) AS ids FROM a GROUP BY cid"))
def group_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = _points(spark, sf_dir)
    return update.group_points(assign.by_expression(points, first_k(points, K))).select("cid", F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("ids"))


@query(sql.query(_FIRST, "SELECT cid, min(id) AS id, count(*) AS n FROM a GROUP BY cid"))
def sorted_group_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = _points(spark, sf_dir)
    return primitives.run_starts(update.sorted_runs(assign.by_expression(points, first_k(points, K))), "cid", "id")


# Primitives.


@query("SELECT o_orderkey, coalesce(sum(c) OVER (ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS excl FROM (SELECT o_orderkey, (o_totalprice * 100)::BIGINT AS c FROM orders)")
def exclusive_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    frame = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", F.round(F.col("o_totalprice") * 100).cast("bigint").alias("c"))
    return primitives.exclusive_scan(frame, "o_orderkey", "c").select("o_orderkey", "excl")


@query("SELECT max(o_orderkey) AS o_orderkey FROM (SELECT o_orderkey, sum(o_custkey) OVER (ORDER BY o_orderkey) - o_custkey AS excl FROM orders) WHERE excl <= 100000")
def scan_upper_bound(spark: SparkSession, sf_dir: str) -> DataFrame:
    frame = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey")
    return primitives.upper_bound(primitives.exclusive_scan(frame, "o_orderkey", "o_custkey"), "o_orderkey", 100000)


@query("SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey")
def histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return primitives.histogram(spark.read.parquet(f"{sf_dir}/orders.parquet"), "o_custkey")


@query("SELECT o_custkey, arg_min(o_orderkey, struct_pack(v := o_totalprice, k := o_orderkey)) AS o_orderkey FROM orders GROUP BY o_custkey")
def arg_min(spark: SparkSession, sf_dir: str) -> DataFrame:
    return primitives.arg_min(spark.read.parquet(f"{sf_dir}/orders.parquet"), "o_orderkey", "o_totalprice", "o_custkey")


@query("SELECT o_custkey, min(o_orderkey) AS o_orderkey, count(*) AS n FROM orders GROUP BY o_custkey")
def pack_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return primitives.run_starts(spark.read.parquet(f"{sf_dir}/orders.parquet"), "o_custkey", "o_orderkey")


# Runners.

_CHAIN = sql.chain(K, ITERATIONS)


def _run(spark: SparkSession, sf_dir: str, runner: str, max_iter: int = ITERATIONS, k: int = K, **options) -> Result:
    points = _points(spark, sf_dir)
    c, start = init.lazy(points, k)
    return cluster(points, c, runner, "Euclidean", max_iter, 0.0, start, "Lazy", **options)


for _name, _runner in (
    ("lloyd_5iter_assign", "NaiveKmeans"), ("naive_5iter_assign", "Naive"), ("lloyd2_5iter_assign", "NaiveKmeans2"), ("yinyang_simp_assign", "YinyangSimp"),
    ("yinyang_assign", "YinyangImproved"), ("yinyang_local_assign", "YinyangFaithful"), ("ball_assign", "BallKmeans"),
):
    query(sql.query(_CHAIN, f"SELECT id, cid FROM a{ITERATIONS - 1}"), _name)(lambda spark, sf_dir, runner=_runner: _run(spark, sf_dir, runner).assignment)


@query(sql.query(_CHAIN, f"SELECT i AS cid, count(id) AS n_points, coalesce(round(avg(d), 6), 0) AS msse FROM range({K}) t(i) LEFT JOIN a{ITERATIONS - 1} ON cid = i GROUP BY i"))
def lloyd_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: clusters after five iterations, with their sizes and mean squared distances."""
    points = _points(spark, sf_dir)
    run = _run(spark, sf_dir, "NaiveKmeans")
    own = assign.assign(points, run.history[-2])
    found = own.groupBy("cid").agg(F.count("*").alias("n_points"), F.avg("d").alias("m_"))
    return spark.range(K).select(F.col("id").alias("cid")).join(F.broadcast(found), "cid", "left").select("cid", F.coalesce("n_points", F.lit(0)).alias("n_points"), F.coalesce(_r("m_"), F.lit(0.0)).alias("msse"))


@query(sql.query(_CHAIN, sql.cells(f"c{ITERATIONS}")))
def lloyd_5iter_centers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cells(spark, _run(spark, sf_dir, "NaiveKmeans").centers)


def _log(run: Result, *columns: str) -> DataFrame:
    return run.iteration_log.select("iteration", *[_r(c).alias(c) for c in columns])


def _union(select) -> str:
    return " UNION ALL ".join(select(i) for i in range(ITERATIONS))


@query(sql.query(_CHAIN, _union(lambda i: f"SELECT {i} AS iteration, round(avg(d), 6) AS msse FROM a{i}")))
def lloyd_msse_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _log(_run(spark, sf_dir, "NaiveKmeans"), "msse")


@query(sql.query(_CHAIN, _union(lambda i: f"SELECT {i} AS iteration, round(avg(d), 6) AS msse FROM a{i}")))
def yinyang_msse_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _log(_run(spark, sf_dir, "YinyangImproved"), "msse")


@query(sql.query(_CHAIN, _union(lambda i: f"SELECT {i} AS iteration, round(avg({sql.d2('a.v', 'c.c')}), 6) AS msse FROM a{i} a JOIN c{i + 1} c USING (cid)")))
def lloyd_after_msse_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _log(_run(spark, sf_dir, "NaiveKmeans2"), "msse")


@query(sql.query(_CHAIN, _union(lambda i: f"SELECT {i} AS iteration, round(avg({sql.d2('a.v', 'c.c')}), 6) AS msse FROM a{i} a JOIN c{i + 1} c USING (cid)")))
def ball_msse_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _log(_run(spark, sf_dir, "BallKmeans"), "msse")


def _movement(root: str) -> str:
    one = lambda i: f"SELECT {i} AS iteration, {root}({sql.d2('o.c', 'c.c')}) AS m FROM c{i} o JOIN c{i + 1} c USING (cid)"
    return f"SELECT iteration, round(min(m), 6) AS movement_min, round(avg(m), 6) AS movement_mean, round(max(m), 6) AS movement_max FROM ({_union(one)}) GROUP BY iteration"


@query(sql.query(_CHAIN, _movement("")))
def lloyd_movement_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _log(_run(spark, sf_dir, "NaiveKmeans"), "movement_min", "movement_mean", "movement_max")


@query(sql.query(_CHAIN, _movement("sqrt")))
def yinyang_movement_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _log(_run(spark, sf_dir, "YinyangSimp"), "movement_min", "movement_mean", "movement_max")


@query(sql.query(_CHAIN, " UNION ALL ".join(f"SELECT {i} AS iteration, count(*) AS center_reassignments FROM a{i} x JOIN a{i - 1} y USING (id) WHERE x.cid <> y.cid" for i in range(1, ITERATIONS))))
def yinyang_reassignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, sf_dir, "YinyangSimp").iteration_log.where("iteration > 0").select("iteration", "center_reassignments")


@query(f"SELECT vec_id AS id, vec_id % {K} AS cid FROM embeddings")
def lazy_runner_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, sf_dir, "Lazy").assignment


# Pruning.

_G = [sql.first_k(K), "g AS MATERIALIZED (SELECT cid AS id, c AS v FROM c0)", *sql.chain(3, 5, "g", "g")]


@query(sql.query(_G, "SELECT id AS cid, dense_rank() OVER (ORDER BY cid)::BIGINT - 1 AS group_id FROM ga4"))
def yinyang_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = group_centers(first_k(_points(spark, sf_dir), K), 3)
    return spark.createDataFrame([(i, int(g)) for i, g in enumerate(groups)], "cid bigint, group_id bigint")


@query(sql.query([*_ALL, "b AS (SELECT id, arg_min(cid, struct_pack(d := d, cid := cid)) AS best, sqrt(min(d)) AS ub FROM e GROUP BY id)"], "SELECT b.id, best, round(ub, 6) AS ub, group_id, round(sqrt(min(d)), 6) AS lb FROM b JOIN e ON e.id = b.id AND e.cid <> best GROUP BY ALL"))
def yinyang_init_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = _points(spark, sf_dir)
    state = begin(points, first_k(points, K), np.array(GROUPS), dist.named())
    return state.select("id", F.col("cid").alias("best"), _r("ub").alias("ub"), F.posexplode("lb").alias("g_", "l_")).select("id", "best", "ub", F.col("g_").cast("bigint").alias("group_id"), _r("l_").alias("lb"))


@query(sql.query([*_FIRST, sql.mean("m", "a", "c0")], f"SELECT cid % 3 AS group_id, round(max(sqrt({sql.d2('m.c', 'o.c')})), 6) AS drift FROM m JOIN c0 o USING (cid) GROUP BY 1"))
def yinyang_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    run = _run(spark, sf_dir, "YinyangImproved", 1)
    out = drift(np.sqrt(((run.history[1] - run.history[0]) ** 2).sum(1)), np.array(GROUPS))
    return spark.createDataFrame([(i, float(x)) for i, x in enumerate(out)], "group_id bigint, drift double").withColumn("drift", _r("drift"))


@query(sql.query(_FIRST, "SELECT cid, round(max(sqrt(d)), 6) AS radius FROM a GROUP BY cid"))
def ball_radius(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = _points(spark, sf_dir)
    c = first_k(points, K)
    out = radii(assign.by_expression(points, c), c, dist.named())
    return spark.createDataFrame([(i, float(x)) for i, x in enumerate(out)], "cid bigint, radius double").withColumn("radius", _r("radius"))


@query(sql.query([sql.first_k(K)], f"SELECT a.cid AS a, b.cid AS b, round(sqrt({sql.d2('a.c', 'b.c')}), 6) AS d FROM c0 a, c0 b"))
def center_distance_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = center_distances(first_k(_points(spark, sf_dir), K))
    return spark.createDataFrame([(i, j, float(x)) for i, row in enumerate(table) for j, x in enumerate(row)], "a bigint, b bigint, d double").withColumn("d", _r("d"))


@query(sql.query([*_FIRST, "r AS (SELECT cid, 0.6 * max(sqrt(d)) AS radius FROM a GROUP BY cid)", f"n AS (SELECT x.cid AS cid, y.cid AS neighbor, sqrt({sql.d2('x.c', 'y.c')}) AS d, radius FROM c0 x JOIN r ON r.cid = x.cid, c0 y WHERE x.cid <> y.cid)"], "SELECT cid, (row_number() OVER (PARTITION BY cid ORDER BY d, neighbor))::INTEGER AS place, neighbor FROM n WHERE d < 2 * radius"))
def ball_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = _points(spark, sf_dir)
    c = first_k(points, K)
    near = neighbors(center_distances(c), 0.6 * radii(assign.by_expression(points, c), c, dist.named()))
    return spark.createDataFrame([(i, p + 1, int(j)) for i, row in enumerate(near) for p, j in enumerate(row)], "cid bigint, place int, neighbor bigint")


# Codes and blocks.


def _blocks(m: int) -> list[str]:
    w = D // m
    return [f"p{j} AS MATERIALIZED (SELECT id, v[{j * w + 1}:{(j + 1) * w}] AS v FROM p)" for j in range(m)]


_CARTESIAN = [*_blocks(4), *[part for j in range(4) for part in sql.chain(2, 3, f"p{j}", f"b{j}")]]


@query(sql.query(_CARTESIAN, "SELECT x.id, x.cid + 2 * y.cid + 4 * z.cid + 8 * w.cid AS cid FROM b0a2 x JOIN b1a2 y USING (id) JOIN b2a2 z USING (id) JOIN b3a2 w USING (id)"))
def cartesian_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = _points(spark, sf_dir)
    return quantized.cartesian(points, 16, POLICIES["Quantized"], 3, 0.0, RunLog(0, D, 16, "Quantized")).assignment


_CODED = [sql.planes("h", PLANES), sql.bytes_("x"), *sql.chain(K, 3, "x")]


@query(sql.query(_CODED, "SELECT id, cid FROM a2"))
def lsh_code_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, sf_dir, "LSHQuantized", 3, planes=PLANES).assignment


@query(sql.query([*_CODED, "q AS (SELECT p.id, p.v, a2.cid FROM p JOIN a2 USING (id))", "z AS (SELECT id AS cid, v AS c FROM p WHERE id < 10)", sql.mean("m", "q", "z")], sql.cells("m")))
def lsh_code_centers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cells(spark, _run(spark, sf_dir, "LSHQuantized", 3, planes=PLANES).centers)


M, KSTAR = 4, 8
_BOOK = [*_blocks(M), *[part for j in range(M) for part in sql.chain(KSTAR, 5, f"p{j}", f"b{j}")]]
_CODES = [*_BOOK, *[sql.assign(f"e{j}", f"b{j}c5", f"p{j}") for j in range(M)], "code AS MATERIALIZED (SELECT e0.id, [e0.cid, e1.cid, e2.cid, e3.cid] AS code FROM e0 JOIN e1 USING (id) JOIN e2 USING (id) JOIN e3 USING (id))"]


def _book(points: DataFrame) -> np.ndarray:
    return quantized.codebook(points, M, KSTAR)


@query(sql.query(_CODES, "SELECT id, (generate_subscripts(code, 1) - 1)::INTEGER AS block, unnest(code)::INTEGER AS code FROM code"))
def pq_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = _points(spark, sf_dir)
    return quantized.encode(points, _book(points)).select("id", F.posexplode("code").alias("block", "code"))


_W = D // M
_TABLE = "tab AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT c0.cid AS cid, {j} AS block, b.cid AS code, {sql.d2(f'c0.c[{j * _W + 1}:{(j + 1) * _W}]', 'b.c')} AS d FROM c0, b{j}c5 b" for j in range(M)) + ")"
_PQ = [*_CODES, sql.first_k(K), _TABLE, "pd AS (SELECT u.id, tab.cid, list_sum(list(d ORDER BY u.block)) AS d FROM (SELECT id, generate_subscripts(code, 1) - 1 AS block, unnest(code) AS code FROM code) u JOIN tab ON tab.block = u.block AND tab.code = u.code GROUP BY u.id, tab.cid)", "pa AS MATERIALIZED (SELECT id, arg_min(cid, struct_pack(d := d, cid := cid)) AS cid, min(d) AS d FROM pd GROUP BY id)"]


@query(sql.query(_PQ, "SELECT id, cid, round(d, 6) AS d FROM pa"))
def pq_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = _points(spark, sf_dir)
    book = _book(points)
    return quantized.pq_assign(quantized.encode(points, book), quantized.code_table(first_k(points, K), book, dist.named())).select("id", "cid", _r("d").alias("d"))


@query(sql.query(_PQ, "SELECT id, cid, round(d, 6) AS d FROM pa"))
def pq_assign_expression(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = _points(spark, sf_dir)
    book = _book(points)
    table = quantized.code_table(first_k(points, K), book, dist.named())
    tables = F.array(*[literal(t) for t in table])
    best = F.array_min(F.transform(tables, lambda t, i: F.struct(dist.pq_distance(t, F.col("code")).alias("d"), i.cast("bigint").alias("cid"))))
    return quantized.encode(points, book).select("id", best.alias("b")).select("id", F.col("b.cid").alias("cid"), _r("b.d").alias("d"))


@query(sql.query([*_PQ, "own AS (SELECT p.id, p.v, pa.cid, pa.d FROM p JOIN pa USING (id))", sql.mean("m", "own", "c0")], f"SELECT round(avg({sql.d2('own.v', 'm.c')}), 6) AS msse, round(avg(own.d), 6) AS quantized_msse FROM own JOIN m USING (cid)"))
def pq_msse(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = _run(spark, sf_dir, "PQ", 1, m=M, kstar=KSTAR).iteration_log
    return log.select(_r("msse").alias("msse"), _r("quantized_msse").alias("quantized_msse"))


_ROTATED = [sql.planes("r", ROTATION), f"y AS MATERIALIZED (SELECT id, list(x ORDER BY i) AS v FROM (SELECT id, i, {sql.dot('w', 'v')} AS x FROM p, r) GROUP BY id)"]


@query(
    sql.query(
        [*_ROTATED, *[f"y{j} AS MATERIALIZED (SELECT id, v[{j * _W + 1}:{(j + 1) * _W}] AS v FROM y)" for j in range(M)], *[sql.first_k(KSTAR, f"y{j}", f"k{j}") for j in range(M)], *[sql.assign(f"e{j}", f"k{j}", f"y{j}") for j in range(M)]],
        " UNION ALL ".join(f"SELECT id, {j} AS block, cid::INTEGER AS code FROM e{j}" for j in range(M)),
    )
)
def opq_rotate_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    rotated = assign.rotate(_points(spark, sf_dir), ROTATION)
    book = np.stack([first_k(quantized.block(rotated, j, _W), KSTAR) for j in range(M)])
    return quantized.encode(rotated, book).select("id", F.posexplode("code").alias("block", "code"))


# The same engine on columns of other tables.

_LINES = "p AS MATERIALIZED (SELECT row_number() OVER () AS id, [l_quantity / 50, l_discount * 10, l_tax * 10] AS v FROM lineitem)"
_SEEDS = np.round(np.random.default_rng(5).random((8, 3)), 6)
_SEEDED = "c0 AS MATERIALIZED (SELECT * FROM (VALUES " + ", ".join(f"({i}::BIGINT, {sql.numbers(r)})" for i, r in enumerate(_SEEDS)) + ") t(cid, c))"


@query(sql.query([_SEEDED, *sql.chain(8, 3, start=False)], sql.cells("c3", 5), _LINES))
def feature_kmeans_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    points = lines.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.array(F.col("l_quantity") / 50, F.col("l_discount") * 10, F.col("l_tax") * 10).alias("v"))
    return cells(spark, cluster(points, _SEEDS, "NaiveKmeans", "Euclidean", 3).centers, 5)


@query(sql.query(sql.chain(8, 3), "SELECT cid, count(*) AS n FROM a2 GROUP BY cid", _CUSTOMERS))
def feature_kmeans_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = _customers(spark, sf_dir)
    return cluster(points, first_k(points, 8), "YinyangSimp", "Euclidean", 3).assignment.groupBy("cid").agg(F.count("*").alias("n"))


# Reports over logs.

_LOGS = [(10, "naive", 18.7, 107022.0), (10, "yy", 2.9, 108030.0), (100, "naive", 6.3, 83087.5), (100, "yy", 3.2, 83100.6), (1000, "naive", 45.8, 66422.7), (1000, "yy", 10.2, 66423.5), (5000, "naive", 210.0, 57000.0)]
_LOG_ROWS = "l AS (SELECT * FROM (VALUES " + ", ".join(str(r) for r in _LOGS) + ") t(k, method, time, msse))"


def _logs(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(_LOGS, "k int, method string, time double, msse double")


@query(f"WITH {_LOG_ROWS} SELECT k, " + ", ".join(f"coalesce(max({v}::DOUBLE) FILTER (method = '{m}'), -1) AS {v}_{m}" for v in ("time", "msse") for m in ("naive", "yy")) + " FROM l GROUP BY k")
def log_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.pivot(_logs(spark), ["naive", "yy"])


@query(f"WITH {_LOG_ROWS} SELECT method, round(regr_slope(time, k), 6) AS time_slope, round(regr_intercept(time, k), 6) AS time_intercept, round(regr_slope(msse, ln(k)), 6) AS msse_slope, round(regr_intercept(msse, ln(k)), 6) AS msse_intercept FROM l GROUP BY method")
def log_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.fits(_logs(spark))


@query(sql.query([sql.first_k(K)], sql.cells("c0")))
def centers_of_start(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first-k centers as a table, cell by cell."""
    return cells(spark, first_k(_points(spark, sf_dir), K))


# Sources: a table written to a file and read back.

_CELLS = "SELECT id, pos - 1 AS pos, {} AS value FROM (SELECT vec_id AS id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings)"


def _file(spark: SparkSession, suffix: str) -> str:
    """A new path in the folder that all executors share."""
    at = f"{folder(spark).removeprefix('file://').removeprefix('file:')}/files"
    os.makedirs(at, exist_ok=True)
    return f"{at}/{uuid4().hex}{suffix}"


def _unnested(points: DataFrame) -> DataFrame:
    return points.select("id", F.posexplode("v").alias("pos", "value")).select("id", "pos", _r("value").alias("value"))


def _written(kind: str, suffix: str, scale):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        path = _file(spark, suffix)
        vector_files.write_bin(_points(spark, sf_dir).select("id", F.transform("v", scale).alias("v")), path, kind)
        return _unnested(vector_files.read_vectors(spark, path))

    return run


for _name, _kind, _suffix, _scale, _text in (
    ("source_fbin", "float", ".fbin", lambda x: x, "round(x, 6) + 0.0"),
    ("source_u8bin", "uint8", ".u8bin", lambda x: (x + 1) * 127, "trunc((x + 1) * 127) + 0.0"),
    ("source_i8bin", "int8", ".i8bin", lambda x: x * 127, "trunc(x * 127) + 0.0"),
):
    _SQL[_name] = _CELLS.format(_text)
    _QUERIES[_name] = _written(_kind, _suffix, _scale)


@query(_CELLS.format("round(x, 6) + 0.0"))
def source_text_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As lines of a key and numbers, to an fbin file in the order of the lines, and back."""
    path, out = _file(spark, ".txt"), _file(spark, ".fbin")
    lines = _points(spark, sf_dir).orderBy("id").select(F.concat_ws("\t", F.concat(F.lit("key"), F.col("id")), F.array_join(F.transform("v", lambda x: x.cast("string")), ",")).alias("value"))
    lines.coalesce(1).write.text(path)
    vector_files.text_to_bin(spark, path, out)
    return _unnested(vector_files.read_vectors(spark, out))


@query(_CELLS.format("round(x, 6) + 0.0"))
def sink_vectors_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _file(spark, ".csv")
    vector_files.vectors_to_csv(_points(spark, sf_dir), path)
    back = spark.read.option("header", True).csv(path)
    return _unnested(from_columns(back, "id", [c for c in back.columns if c != "id"]))


@query(f"SELECT vec_id AS id, round(embedding[1]::DOUBLE, 6) + 0.0 AS x, round(embedding[2]::DOUBLE, 6) + 0.0 AS y, vec_id % {K} AS cid FROM embeddings")
def sink_scatter(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = _points(spark, sf_dir)
    return vector_files.scatter(points, init.lazy(points, K)[1]).select("id", _r("x").alias("x"), _r("y").alias("y"), "cid")


@query("SELECT n_nationkey::BIGINT AS row, [n_nationkey::VARCHAR, n_name, n_regionkey::VARCHAR][f] AS field, f - 1 AS pos FROM nation, range(1, 4) t(f)")
def source_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A small CSV table as a record file, and back."""
    table, path = _file(spark, ".csv"), _file(spark, ".bin")
    with open(table, "w", newline="", encoding="utf-8") as f:
        csv.writer(f).writerows(map(tuple, spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", "n_name", "n_regionkey").orderBy("n_nationkey").collect()))
    record_files.csv_to_records(table, path)
    return record_files.read_records(spark, path).select("row", F.posexplode("fields").alias("pos", "field"))
