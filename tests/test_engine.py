import numpy as np
import pytest
from conftest import frame

from centra.functions.distance import named, nearest
from centra.operators import assign, init, lsh, primitives, update
from centra.plans import ball, quantized
from centra.plans.ball import center_distances, near_centers, neighbors
from centra.plans.lloyd import StopRule, lloyd_matrix
from centra.plans.quantized import sides
from centra.plans.runlog import RunLog, parse_init, parse_run
from centra.plans.runners import POLICIES, RUNNERS, cluster, fit, init_log, msse

EXACT = ["Naive", "NaiveKmeans", "NaiveKmeans2", "YinyangSimp", "YinyangImproved", "YinyangFaithful", "BallKmeans"]


def cids(assignment):
    return [r[1] for r in sorted(assignment.select("id", "cid").collect())]


def test_toy_starts(toy):
    c, a = init.lazy(toy, 2)
    assert c.tolist() == [[0, 0], [10, 10]] and cids(a) == [0, 1, 0, 1, 0, 1]
    c, a = init.forgy(toy, 2)
    assert np.allclose(c, [[1 / 3] * 2, [31 / 3] * 2]) and cids(a) == [0, 1, 0, 1, 0, 1]
    assert cids(init.macqueen(toy, 2)[1]) == [0, 1, 0, 1, 0, 1]


def test_toy_plus_plus_picks_id_3(toy):
    c, _ = init.kmeans_plus_plus(toy, 2, draws=[0.0, 0.5])
    assert c.tolist() == [[0, 0], [10, 11]]


def test_toy_hashes(toy):
    planes = np.eye(2)
    own = init.chunked(toy, 2, 6, planes)
    assert [r.hash for r in own.orderBy("id").collect()] == [0, 3, 2, 3, 1, 3]
    assert cids(own) == [0, 1, 0, 1, 0, 1]
    with pytest.raises(ValueError):
        init.lsh_chunks(toy, 4, planes=planes)
    with pytest.raises(ValueError):
        lsh.bytes_of(toy["v"], planes)


def test_toy_runs(toy):
    start = np.array([[0.0, 0.0], [10.0, 10.0]])
    r = cluster(toy, start, "NaiveKmeans", max_iter=1)
    log = r.log.iterations[0]
    assert np.isclose(log.msse, 4 / 6) and np.isclose(2 * log.movement_mean, 4 / 9) and np.allclose(r.centers, [[1 / 3] * 2, [31 / 3] * 2])
    assert np.isclose(cluster(toy, start, "NaiveKmeans2", max_iter=1).log.iterations[0].msse, 4 / 9)
    assert np.isclose(cluster(toy, start, "YinyangImproved", max_iter=1).log.iterations[0].movement_max, 0.4714045)
    assert cluster(toy, start, "NaiveKmeans").log.iterations[1].movement_max == 0
    assert cids(assign.by_expression(toy, start, "mips")) == [0, 1, 1, 1, 1, 1]
    assert np.isclose(msse(toy, start, r.assignment), 4 / 6)


def test_empty_cluster_keeps_its_center(toy):
    start = np.array([[0.0, 0.0], [10.0, 10.0], [99.0, 99.0]])
    for runner in EXACT:
        r = cluster(toy, start, runner, max_iter=3)
        assert r.centers[2].tolist() == [99, 99], runner
    n = update.member_count(assign.by_expression(toy, start), 3).orderBy("cid").collect()
    assert [x.n for x in n] == [3, 3, 0]


def test_neighbors_use_plain_distances(spark):
    c = np.array([[0.0], [10.0]])
    assert neighbors(center_distances(c), np.array([5.5, 0.0]))[0].tolist() == [1]
    points = frame(spark, [(0,), (10,), (5.5,), (10.5,)])
    assert cids(cluster(points, c, "BallKmeans", max_iter=1).assignment)[2] == 1


def test_exact_runners_agree_at_each_iteration(spark):
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(m, 1.0, (60, 5)) for m in range(6)] + [rng.integers(0, 3, (90, 5)).astype(float)])
    points, start = frame(spark, x), x[:12].copy()
    for n in (1, 2, 4, 12):
        base = cluster(points, start, "NaiveKmeans", max_iter=n)
        for runner in EXACT[1:]:
            got = cluster(points, start, runner, max_iter=n)
            assert cids(got.assignment) == cids(base.assignment), (runner, n)
            assert np.allclose(got.centers, base.centers), (runner, n)


@pytest.mark.parametrize("runner", EXACT)
def test_invariants_at_convergence(spark, runner):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 6))
    points = frame(spark, x)
    r = fit(points, 10, "Lazy", runner)
    own = np.array(cids(r.assignment))
    assert len(own) == 300 and own.min() >= 0 and own.max() < 10
    assert (nearest(x, r.centers, named())[0] == own).all()
    for j in range(10):
        if (own == j).any():
            assert np.abs(x[own == j].mean(0) - r.centers[j]).max() < 1e-6
    assert r.log.iterations[-1].msse <= r.log.iterations[0].msse


def test_pruning_spares_distances(spark):
    rng = np.random.default_rng(2)
    points = frame(spark, np.concatenate([rng.normal(8 * m, 1.0, (40, 4)) for m in range(10)]))
    start = init.kmeans_plus_plus(points, 10, seed=3)[0]
    for runner in ("YinyangSimp", "BallKmeans"):
        calls = [i.distance_calls for i in cluster(points, start, runner, max_iter=5).log.iterations]
        assert calls[-1] < calls[0] / 2, runner


@pytest.mark.parametrize("runner", ["Naive", "YinyangSimp", "BallKmeans", "NaiveKmeans"])
def test_iterations_take_flat_time(spark, runner):
    """No stop: as many iterations as are asked for, the last as quick as the first."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(200, 4))
    got = cluster(frame(spark, x), x[:8], runner, max_iter=24, epsilon=-1.0)
    took = [i.assign_time + i.update_time for i in got.log.iterations]
    assert len(took) == 24 and np.median(took[12:]) < 2 * np.median(took[:12]) + 0.3, took
    want, best = lloyd_matrix(x, x[:8].copy(), 24, -1.0)
    assert np.allclose(got.centers, want)


def test_kmeans_plus_plus_of_many_centers(spark, monkeypatch):
    """Across rebuilds, the same picks as by brute force."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 3))
    draws = [float(u) for u in rng.random(20)]
    monkeypatch.setattr(init, "REBUILD", 8)
    monkeypatch.setattr(init, "SCAN", 37)
    at = [int(draws[0] * 300)]
    for u in draws[1:]:
        w = ((x[:, None] - x[None, at]) ** 2).sum(-1).min(1)
        at.append(int(np.flatnonzero(np.concatenate([[0], np.cumsum(w)[:-1]]) <= u * w.sum())[-1]))
    assert np.array_equal(init.kmeans_plus_plus(frame(spark, x), 20, draws=draws)[0], x[at])


def test_signs_do_not_depend_on_the_batch():
    rng = np.random.default_rng(6)
    planes = rng.normal(size=(64, 32))
    x = rng.normal(size=(500, 32))
    x[::5] -= (x[::5] @ planes[0] / (planes[0] @ planes[0]))[:, None] * planes[0]  # next to a plane
    whole = sides(x, planes)
    assert all(np.array_equal(whole[a : a + n], sides(x[a : a + n], planes)) for n in (1, 7, 250) for a in range(0, 500, n))


def test_neighbors_by_blocks(monkeypatch):
    c = np.random.default_rng(7).normal(size=(50, 3))
    radius = np.random.default_rng(8).random(50)
    want = neighbors(np.sqrt(((c[:, None] - c[None]) ** 2).sum(-1)), radius)
    monkeypatch.setattr(ball, "ENTRIES", 400)
    near, far = near_centers(c, radius)
    assert all(np.array_equal(a, b) for a, b in zip(near, want, strict=True)) and all(np.allclose(f, np.sqrt(((c[i] - c[n]) ** 2).sum(-1))) for i, (n, f) in enumerate(zip(near, far, strict=True)))


def test_stop_rules():
    new, old = np.array([[3.0], [4.0]]), np.zeros((2, 1))
    assert StopRule("sum").stops(StopRule("sum").movement(new, old), 25)
    assert not StopRule("sum", strict=True).stops(StopRule("sum").movement(new, old), 25)
    assert StopRule("max", sqrt=True).stops(StopRule("max", sqrt=True).movement(new, old), 4)
    assert set(POLICIES) <= set(RUNNERS)


def test_updates_agree(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(100, 3))
    points = frame(spark, x)
    own = init.cyclic(points, 7)
    base, n = update.mean_matrix(own, np.zeros((7, 3)))
    cells = {(r.cid, r.pos): r.value for r in update.group_mean(own, np.zeros((7, 3))).collect()}
    assert all(np.isclose(cells[i, j], base[i, j]) for i in range(7) for j in range(3))
    moved = own.withColumnRenamed("cid", "old_cid").withColumn("cid", init.drawn(7))
    got, count = update.incremental_mean(moved, base, n)
    want, m = update.mean_matrix(moved, base)
    assert np.allclose(got, want) and (count == m).all()
    assert np.allclose(update.incremental_mean(moved, base, n, only_changed=False)[0], want)


def test_plus_plus_and_lazy_fill_k_groups(spark):
    x = np.random.default_rng(5).normal(size=(1000, 8))
    points = frame(spark, x)
    c, a = init.kmeans_plus_plus(points, 20, seed=9)
    own = np.array(cids(a))
    assert len(set(own)) == 20 and (nearest(x, c, named())[0] == own).all()
    assert len(set(cids(init.lazy(points, 100)[1]))) == 100


def test_init_quality_order(spark):
    points = frame(spark, np.concatenate([np.random.default_rng(6).normal(4 * m, 1.0, (50, 6)) for m in range(4)]))
    log = {m: init_log(points, 4, m)[0].msse for m in ("LSH", "Forgy", "Lazy")}
    assert log["LSH"] < log["Forgy"] < log["Lazy"]


def test_quantized_runners(spark):
    points = frame(spark, np.random.default_rng(7).normal(size=(200, 8)))
    start = init.lazy(points, 16)[0]
    r = cluster(points, start, "Quantized", max_iter=3)
    assert r.centers.shape == (16, 8) and max(cids(r.assignment)) < 16
    with pytest.raises(ValueError):
        cluster(points, start[:10], "Quantized")
    r = cluster(points, start, "PQ", max_iter=3, m=4, kstar=16)
    assert r.log.iterations[-1].msse <= r.log.iterations[0].msse
    r = cluster(points, start, "LSHQuantized", max_iter=2)
    assert r.centers.shape == (16, 8)
    assert cluster(points, start, "Lazy").centers.tolist() == start.tolist()
    assert cluster(points, start, "StandardQuantized", max_iter=1, kstar=8).centers.shape == (16, 8)
    book = quantized.codebook(points, 2, 4)
    assert book.shape == (2, 4, 4)


def test_bad_names_and_vectors(toy, spark):
    with pytest.raises(ValueError):
        cluster(toy, np.zeros((1, 2)), "None")
    with pytest.raises(ValueError):
        init.initialize(toy, 2, "None")
    ragged = spark.createDataFrame([(0, [1.0]), (1, [1.0, 2.0])], "id bigint, v array<double>")
    with pytest.raises(Exception, match="same length"):
        assign.assign(ragged, np.zeros((1, 2))).collect()


def test_logs_round_trip(tmp_path, toy):
    r = fit(toy, 2, "Lazy", "NaiveKmeans")
    head, rows = parse_run(r.log.to_csv())
    assert head["runner"] == "NaiveKmeans" and int(head["n"]) == 6 and len(rows) == len(r.log.iterations)
    assert open(r.log.write(str(tmp_path))).read() == r.log.to_csv()
    assert r.iteration_log.count() == len(rows) and r.run_log.count() == 1
    log, _, _ = init_log(toy, 2, "Lazy")
    assert parse_init(log.to_csv())["init_name"] == "Lazy"
    assert RunLog(1, 1, 1, "x").summary()


def test_scan_over_many_partitions(spark):
    frame_ = spark.range(1000).selectExpr("id", "id % 7 AS w").repartition(5)
    got = [r.excl for r in primitives.exclusive_scan(frame_, "id", "w").orderBy("id").collect()]
    assert got == np.concatenate([[0], np.cumsum(np.arange(1000) % 7)[:-1]]).tolist()
    assert init.scan_pick(frame_.selectExpr("id", "cast(w AS double) AS w"), 0.5) == max(i for i in range(1000) if got[i] <= 0.5 * sum(i % 7 for i in range(1000)))
