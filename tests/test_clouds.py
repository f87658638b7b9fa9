"""Distance joins, landmarks and preparation against plain NumPy, and in odd cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from topospark.functions.quantiles import quantiles, with_slots
from topospark.operators import knn, landmarks, metrics, prepare
from topospark.plans import pipeline
from topospark.sources import generators

CLOUD = "cloud_id int, point_id bigint, coords array<double>, intensity double"


def cloud(spark, x, cloud_id=1):
    return spark.createDataFrame([(cloud_id, i, [float(v) for v in p], float(i)) for i, p in enumerate(x)], CLOUD)


def test_nearest_over_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(knn, "BLOCK", 16)
    x = np.random.default_rng(1).integers(0, 6, (70, 2))  # many ties
    found = {r.point_id: [(n.dist, n.id) for n in r.neighbours] for r in knn.nearest(cloud(spark, x), cloud(spark, x), 5, exclude_self=True).collect()}
    gap = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    for i in range(70):
        assert found[i] == sorted((gap[i, j], j) for j in range(70) if j != i)[:5]


def test_lone_point_and_missing_targets(spark):
    one = cloud(spark, [(0, 0)])
    assert knn.kth_radius(one, 3).collect()[0].radius == 0.0
    assert knn.nearest(one, cloud(spark, [(1, 1)], cloud_id=2), 1).count() == 0
    assert knn.nearest(one.limit(0), one, 1).count() == 0


def test_greedy_in_blocks_picks_all_and_spreads(spark, monkeypatch):
    x = np.random.default_rng(2).random((120, 2))
    pts = cloud(spark, x).withColumnRenamed("intensity", "score")
    exact = landmarks.greedy(pts, 6, landmarks._weighted_maxmin, 0.0).count()
    monkeypatch.setattr(landmarks, "GREEDY_BLOCK", 40)
    rows = landmarks.greedy(pts, 6, landmarks._weighted_maxmin, 0.0).collect()
    assert exact == len(rows) == len({r.point_id for r in rows}) == 6
    assert sorted(r.rank for r in rows) == list(range(6))


@pytest.mark.parametrize("kernel", [landmarks._weighted_maxmin, landmarks._hybrid_maxmin])
def test_greedy_picks_do_not_depend_on_the_size_limit(spark, monkeypatch, kernel):
    rng = np.random.default_rng(3)
    pts = cloud(spark, np.round(rng.random((120, 2)), 1)).unionByName(cloud(spark, rng.random((90, 2)), 2)).unionByName(cloud(spark, rng.random((20, 2)), 3))
    pts = pts.withColumnRenamed("intensity", "score").withColumn("score", F.pmod("score", F.lit(7.0)) / 7)
    picks = lambda: sorted(map(tuple, landmarks.greedy(pts, 30, kernel, 0.3).collect()))
    exact = picks()
    monkeypatch.setattr(landmarks, "GREEDY_BLOCK", 40)
    monkeypatch.setattr(landmarks, "GREEDY_LEAD", 12)
    assert len(exact) == 80 and picks() == exact


@pytest.mark.parametrize("kernel", [landmarks._weighted_maxmin, landmarks._hybrid_maxmin])
@pytest.mark.parametrize("lead", [1, 7, 60])
def test_rounds_of_leading_rows_give_the_greedy_picks(kernel, lead):
    rng = np.random.default_rng(lead)
    for case in range(6):
        x = np.round(rng.random((200, 2)), 1 if case % 2 else 6)
        score = np.round(rng.random(200), 1) - (0.3 if case == 4 else 0.0)
        want = kernel(x, score, 40, 0.4)
        free, got = np.ones(200, dtype=bool), want[:1]
        while len(got) < 40:
            free[got] = False
            at = np.flatnonzero(free)
            gap = np.sqrt(((x[at, None] - x[got]) ** 2).sum(-1)).min(1)
            if kernel is landmarks._weighted_maxmin:
                views = {0: np.round(gap * score[at], landmarks.DIGITS)}
            else:
                blend = lambda f: 0.4 * score[at] + 0.6 * (gap / (gap.max() * f + 1e-12) if gap.max() > 1e-12 else 0 * gap)
                views = {i: blend(f) for i, f in enumerate(landmarks.SHRINK)} | {landmarks.WIDTHS: gap}
                views[0] = np.round(views[0], landmarks.DIGITS)
            orders = {i: np.lexsort((at, -v))[:lead] for i, v in views.items()}
            some = np.unique(np.concatenate(list(orders.values())))
            last = {i: (float(views[i][o[-1]]), int(np.searchsorted(some, o[-1]))) for i, o in orders.items() if len(o) == lead}
            new = landmarks._advance(x[at[some]], score[at[some]], gap[some], last, 40 - len(got), float(score.min()), kernel, 0.4)
            assert new
            got = got + [int(i) for i in at[some][new]]
        if case != 4:  # negative weights: a picked row's value stands for -1 in one task
            assert got == [int(i) for i in want]
        assert len(set(got)) == 40


def test_every_method_gives_m_distinct_points(spark):
    pts = generators.builtin(spark, "torus", 200, 7).cache()
    for method in ("random", "density", "hybrid", "quantum", "grid", "lidar"):
        rows = landmarks.select(pts, method, 12, 3, 3).collect()
        assert len(rows) == len({r.point_id for r in rows}) == 12, method
        assert sorted(r.rank for r in rows) == list(range(12))
    with pytest.raises(ValueError):
        landmarks.select(pts, "other", 3, 1, 3)


def test_more_landmarks_than_points_gives_all(spark):
    assert landmarks.random(cloud(spark, [(0, 0), (1, 1)]), 5, 1).count() == 2
    assert landmarks.hybrid(cloud(spark, [(0, 0), (1, 1), (2, 0)]), 5).count() == 3


def test_torus_satisfies_its_equation(spark):
    for r in generators.builtin(spark, "torus", 100, 1).collect():
        x, y, z = r.coords
        assert (np.hypot(x, y) - 2) ** 2 + z**2 == pytest.approx(0.36)
    with pytest.raises(ValueError):
        generators.builtin(spark, "cube", 1, 1)


def test_generators_and_volume(spark):
    for name in generators.BUILTIN:
        assert generators.builtin(spark, name, 20, 1).count() == 20
    voxels = generators.phantom(spark, 12, 3)
    assert voxels.count() == 12**3 and voxels.agg({"value": "min"}).first()[0] >= 0
    eye = np.eye(4).tolist()
    pts = prepare.volume_to_cloud(voxels, eye, 90, 100, 1)
    assert pts.count() == 100 and all(0 <= c <= 1 for r in pts.collect() for c in r.coords)
    rows = pipeline.volume_run(voxels, eye, ["random"], "fast", 6, 80, 0.1, 5).collect()
    assert len(rows) == 1 and rows[0].method == "random" and rows[0].m == 6


def test_flat_and_constant_clouds(spark):
    pts = spark.createDataFrame([(1, i, [1.0, float(i)], 5.0) for i in range(4)], CLOUD)
    assert [r.coords[0] for r in prepare.normalise_minmax(pts).collect()] == [0.0] * 4
    assert all(r.weight == 0.25 for r in prepare.with_weights(pts).collect())
    same = spark.createDataFrame([(1, i, [2.0, 2.0], 1.0) for i in range(3)], CLOUD)
    assert all(r.coords == [0.0, 0.0] for r in prepare.normalise_isotropic(same).collect())


def test_sampling_keeps_whole_rows_and_bounds(spark):
    pts = cloud(spark, np.random.default_rng(1).random((100, 2)))
    assert prepare.sample(pts, 30, 1).count() == 30
    assert prepare.thin(pts, 0.5, 1).count() == 50
    assert prepare.thin(pts, 0.1, 1).count() == 100  # fewer than 32 would stay
    assert prepare.weighted_sample(pts, 99, 1).where("point_id = 0").count() == 0  # no weight, so last
    assert prepare.weighted_sample(pts, 100, 1).count() == 100
    assert prepare.pad_or_sample(pts.where("point_id < 3"), 8, 1).count() == 8
    with pytest.raises(Exception, match="200 needed"):
        prepare.require_points(pts, 200).collect()


def test_ranks_among_many_equal_values(spark):
    rng = np.random.default_rng(5)
    values = {"even": np.full(1000, 1e-3), "tied": rng.integers(0, 4, 999).astype(float), "free": rng.random(500) ** 3, "few": np.array([2.0])}
    values = {c: v / v.sum() for c, v in values.items()}
    df = spark.createDataFrame([(c, float(x)) for c, v in values.items() for x in v], "cloud_id string, weight double")
    ranks = {r.cloud_id: r["rank"] for r in metrics.rank_reaching(df, "weight", 0.95).collect()}
    shares = {"low": 0.0, "mid": 0.37, "high": 0.95, "top": 1.0}
    found = {r.cloud_id: r for r in quantiles(df, "weight", shares, ["cloud_id"]).collect()}
    for c, v in values.items():
        assert ranks[c] == int(np.argmax(np.round(np.cumsum(np.sort(v)), 12) > 0.95)) + 1
        assert all(abs(found[c][n] - np.quantile(v, p)) < 1e-12 for n, p in shares.items())


def test_pruned_neighbours_equal_brute_force(spark, monkeypatch):
    from topospark.operators import knn

    monkeypatch.setattr(knn, "BLOCK", 40)
    rng = np.random.default_rng(3)
    # a crowd, a spread, copies on a lattice (ties), one stray; a small cloud; one with targets but few points
    x = np.concatenate([rng.standard_normal((300, 3)) * 0.01, rng.random((200, 3)) * 5, rng.integers(0, 3, (150, 3)) * 1.0, [[90.0, 0, 0]]])
    rows = [("big", i, v.tolist()) for i, v in enumerate(x)] + [("small", i, [float(i), 0.0, 0.0]) for i in range(5)] + [("big", 9999, None)]
    pts = spark.createDataFrame(rows, "cloud_id string, point_id bigint, coords array<double>")
    d2 = knn.squared_distances(x, x)
    for own in (True, False):
        got = {(r.cloud_id, r.point_id): [(n.dist, n.id) for n in r.neighbours] for r in knn.nearest(pts, pts, 6, exclude_self=own).collect()}
        for i in range(len(x)):
            true = sorted((float(np.sqrt(d2[i, j])), j) for j in range(len(x)) if not (own and i == j))[:6]
            assert got["big", i] == true
        assert len(got["small", 0]) == (4 if own else 5) and ("big", 9999) not in got
    few = spark.createDataFrame([("big", -1, [1000.0, 1000.0, 1000.0])], "cloud_id string, point_id bigint, coords array<double>")
    far = knn.nearest(few, pts, 3).first()
    assert np.allclose([n.dist for n in far.neighbours], sorted(np.sqrt(((x - 1000) ** 2).sum(1)))[:3], rtol=1e-12)


def test_stray_values_leave_no_bin_with_most_rows(spark):
    x = np.concatenate([np.random.default_rng(5).random(4000), [1e12, -1e12, 3e9]])
    df = spark.createDataFrame([(1, float(v)) for v in x] + [(2, None), (3, 4.0), (3, None)], "cloud_id int, weight double")
    rows = with_slots(df, "weight", ["cloud_id"]).collect()
    own = sorted((r.weight, r.slot) for r in rows if r.cloud_id == 1)
    slots = [s for _, s in own]
    assert len(rows) == 4006 and slots == sorted(slots)
    assert max(slots.count(s) for s in set(slots)) < 4003 / 16
    assert all(r.slot == 0 for r in rows if r.weight is None)
    found = quantiles(df, "weight", {"low": 0.1, "middle": 0.5}, ["cloud_id"]).where("cloud_id = 1").first()
    assert np.allclose([found.low, found.middle], np.quantile(x, [0.1, 0.5]))
