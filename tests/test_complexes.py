"""Complexes and diagrams on hand-computed clouds."""

import math

import numpy as np
import pytest

from topospark.operators import landmarks, metrics, persistence, witness

CLOUD = "cloud_id string, point_id bigint, coords array<double>, intensity double"
SHAPES = {
    "tri345": [(0, 0), (3, 0), (0, 4)],
    "square": [(0, 0), (1, 0), (1, 1), (0, 1)],
    "two_pairs": [(0, 0), (1, 0), (10, 0), (11, 0)],
}
BARS = {
    "tri345": [(0, 0, 3), (0, 0, 4), (0, 0, math.inf), (1, 4, 4)],
    "square": [(0, 0, 1)] * 3 + [(0, 0, math.inf)] + [(1, 1, 1)] * 3 + [(2, 1, math.inf)],
    "two_pairs": [(0, 0, 1)] * 2 + [(0, 0, 9), (0, 0, math.inf)] + [(1, 9, 9)] * 2 + [(1, 10, 10), (2, 10, math.inf)],
}


def cloud(spark, shapes):
    rows = [(name, i, [float(c) for c in p], 1.0) for name, ps in shapes.items() for i, p in enumerate(ps)]
    return spark.createDataFrame(rows, CLOUD)


def test_known_diagrams(spark):
    pts = cloud(spark, SHAPES)
    found = persistence.diagrams(witness.witness_complex(pts, pts, 4), "unpaired").collect()
    for name, bars in BARS.items():
        assert sorted((r.dim, r.birth, r.death) for r in found if r.cloud_id == name) == sorted(bars)


def test_endless_bars_of_all_positive(spark):
    rng = np.random.default_rng(3)
    pts = cloud(spark, {"full8": rng.random((8, 3)).tolist()})
    found = persistence.diagrams(witness.witness_complex(pts, pts, 8)).collect()
    count = lambda d, endless: sum(r.dim == d and math.isinf(r.death) == endless for r in found)
    assert [count(d, False) for d in range(3)] == [7, 21, 0]
    assert [count(d, True) for d in range(3)] == [8, 21, 35]


def test_euler_characteristic_and_tree_weights(spark):
    rng = np.random.default_rng(5)
    x = rng.random((10, 3))
    pts = cloud(spark, {"r": x.tolist()})
    simplices = witness.witness_complex(pts, pts, 10)
    dims = [r.dim for r in simplices.collect()]
    assert sum((-1) ** d for d in dims) == 10 - 45 + 120
    deaths = sorted(r.death for r in persistence.diagrams(simplices, "unpaired").collect() if r.dim == 0 and r.death < math.inf)
    gap = np.linalg.norm(x[:, None] - x[None], axis=2)
    inside, tree = {0}, []
    while len(inside) < 10:
        w, j = min((gap[i, j], j) for i in inside for j in range(10) if j not in inside)
        inside.add(j)
        tree.append(w)
    # a witness sees an edge at the larger of its two distances, and each point is a witness of its own edges
    assert np.allclose(deaths, sorted(tree))


def test_filtration_limit_equals_filter_afterwards(spark):
    rng = np.random.default_rng(6)
    pts = cloud(spark, {"a": rng.random((30, 2)).tolist()})
    marks = landmarks.random(pts, 8, 1)
    key = lambda r: (r.dim, r.v0, r.v1, r.v2, r.filtration)
    cut = {key(r) for r in witness.witness_complex(pts, marks, 4, max_filtration=0.3).collect()}
    assert cut == {key(r) for r in witness.witness_complex(pts, marks, 4).collect() if r.filtration <= 0.3}


def test_rips_reduction_of_a_circle(spark):
    angles = np.linspace(0, 2 * np.pi, 20, endpoint=False)
    pts = cloud(spark, {"ring": np.c_[np.cos(angles), np.sin(angles)].tolist()})
    bars = persistence.diagrams(persistence.rips_complex(pts, 50, 60, 1), "unpaired").collect()
    loops = [r for r in bars if r.dim == 1 and r.death - r.birth > 0.5]
    assert len(loops) == 1


def test_bottleneck_axioms():
    a = np.array([[0.0, 1.0], [0.0, 3.0], [0.2, np.inf]])
    b = np.array([[0.0, 1.1], [0.1, 2.8], [0.5, np.inf]])
    assert persistence.bottleneck(a, a) == 0
    assert persistence.bottleneck(a, b) == pytest.approx(0.3)
    assert persistence.bottleneck(a, b) == persistence.bottleneck(b, a)
    assert persistence.bottleneck(a[:2], a) == np.inf
    assert persistence.bottleneck(a[:2], a[:1]) == pytest.approx(1.5)
    assert persistence.bottleneck(np.zeros((0, 2)), np.zeros((0, 2))) == 0


def test_bottleneck_against_brute_force():
    from itertools import permutations

    rng = np.random.default_rng(2)
    for _ in range(20):
        a, b = (np.sort(rng.random((rng.integers(1, 4), 2)), axis=1) for _ in range(2))
        n, m = len(a), len(b)
        best = np.inf
        for order in permutations(range(n + m)):
            cost = 0.0
            for i, j in enumerate(order):
                if i < n and j < m:
                    cost = max(cost, np.abs(a[i] - b[j]).max())
                elif i < n:
                    cost = max(cost, (a[i, 1] - a[i, 0]) / 2)
                elif j < m:
                    cost = max(cost, (b[j, 1] - b[j, 0]) / 2)
            best = min(best, cost)
        assert persistence.bottleneck(a, b) == pytest.approx(best)


def test_diagram_statistics_fill_missing_dimensions(spark):
    bars = spark.createDataFrame([("a", 0, 0.0, 1.0), ("a", 0, 0.0, math.inf)], "cloud_id string, dim int, birth double, death double")
    rows = {r.dim: r for r in metrics.diagram_statistics(bars, bars, 1).collect()}
    assert rows[0]["count"] == 2 and rows[0].total_persistence == 1.0
    assert rows[1]["count"] == 0 and rows[1].max_persistence == 0.0


def test_feature_vector_has_51_slots(spark):
    rng = np.random.default_rng(8)
    pts = cloud(spark, {"a": rng.random((30, 3)).tolist(), "b": rng.random((25, 3)).tolist()})
    marks = landmarks.random(pts, 8, 1)
    bars = persistence.diagrams(witness.witness_complex(pts, marks, 8))
    rows = metrics.feature_vector(pts, marks, bars, 8, 8).collect()
    assert len(rows) == 2
    for r in rows:
        assert len(r.vector) == 51 and r.vector[36:39] == [7.0, 21.0, 0.0] and r.vector[50] == 8.0
