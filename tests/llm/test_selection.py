"""Top items, variety, splits and neighbours against brute force, and in odd cases."""

from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from topospark.llm import neighbours, related, topn, variety

T = datetime(2024, 1, 1)
FEATURES = "seq string, frame int, chunk_no int, h0_lifetimes array<float>, h1_lifetimes array<float>, h2_lifetimes array<float>, received_at timestamp, dim int, lifetime string"


def test_top_lifetimes(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        ("a", 1, 0, [1.0, 2.0, None, nan, inf, -1.0, 2.0], [], None, T, 9, "x"),
        ("a", 1, 0, [1.0, 2.0, None, nan, inf, -1.0, 2.0], [], None, T, 9, "x"),
        ("a", 1, 1, [9.0] * 3, [0.0], [3.0], T, 9, "x"),
        ("a", 1, 1, [5.0, 2.0], [0.0], [3.0], datetime(2024, 2, 1), 9, "x"),
        (None, None, None, [1.0], None, None, None, None, None),
    ]
    df = spark.createDataFrame(rows, FEATURES)
    got = topn.top_lifetimes(df, 3).select("seq", "dim", "chunk_no", "pos_no").collect()
    assert sorted(tuple(r) for r in got if r.seq) == [("a", 0, 0, 1), ("a", 0, 0, 6), ("a", 0, 1, 0), ("a", 1, 1, 0), ("a", 2, 1, 0)]
    assert [tuple(r) for r in got if r.seq is None] == [(None, 0, None, 0)]
    assert topn.top_lifetimes(df.limit(0)).count() == 0


def test_top_n_prunes_before_the_shuffle(spark):
    df = spark.range(100).select((F.col("id") % 3).alias("g"), F.col("id"))
    plan = topn.top_n(df, ["g"], [F.col("id").desc()], 2)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


SEQS = "seq string, drive_id string, operator_id string, parent_seq string, received_at timestamp, key string, label string"
PAIRS = "seq string, scan_t string, scan_t1 string, received_at timestamp"


def graph(spark, seqs, pairs=()):
    s = spark.createDataFrame([(*r, T, "x", "x") for r in seqs], SEQS)
    return s, spark.createDataFrame([(*r, T) for r in pairs], PAIRS)


def test_identifiers_and_relations(spark):
    seqs = [
        ("00", "drv-0007", None, None), ("01", " DRV_7 ", "unknown", None), ("02", None, "op 12", None), ("03", "n/a", "OP.00012", "-"),
        ("04", "", "?", " 03 "), ("05", "TBD", "none", "nowhere"), ("0", "-", "UNKNOWN", None), (None, "drv7", "op12", "00"), ("06", None, None, None),
    ]
    pairs = [("05", "abc1", "0000"), ("06", "ABC1", "ffff"), ("0", None, "0000"), ("07", "", "ffff"), ("06", "abc1", "abc1")]
    got = {tuple(r) for r in related.related_pairs(*graph(spark, seqs, pairs)).collect()}
    assert got == {("00", "01"), ("02", "03"), ("02", "04"), ("03", "04"), ("05", "06")}


@pytest.mark.parametrize("shape", ["star", "path", "random"])
def test_components_against_union_find(spark, shape):
    rng = np.random.default_rng(1)
    edges = {"star": [(0, i) for i in range(1, 60)], "path": [(i, i + 1) for i in range(40)], "random": [tuple(map(int, rng.integers(0, 80, 2))) for _ in range(60)]}[shape]
    parent = list(range(100))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[root(a)] = root(b)
    df = spark.createDataFrame([(f"{a:03}", f"{b:03}") for a, b in edges], "a string, b string")
    labels = {int(r.vertex): int(r.label) for r in related.contract(df).collect()}
    assert labels.keys() == {v for e in edges if e[0] != e[1] for v in e}
    assert all((labels[a] == labels[b]) == (root(a) == root(b)) for a in labels for b in labels)


def test_splits_keep_components_and_proportions(spark):
    rng = np.random.default_rng(4)
    seqs = [(f"{i:04}", f"d{i // 3}", None, None) for i in range(300)]
    pairs = [(f"{int(i):04}", None, None) for i in rng.integers(0, 300, 4000)] + [("0000", None, None)] * 200
    s, p = graph(spark, seqs, pairs)
    shares = {"train": 0.8, "validation": 0.1, "test": 0.1}
    rows = related.split_sequences(s, p, shares).collect()
    assert len(rows) == 300 and sum(r.n_pairs for r in rows) == len(pairs)
    by = {r.seq: r.split for r in rows}
    assert all(by[f"{i:04}"] == by[f"{i // 3 * 3:04}"] for i in range(300))
    total = {k: sum(r.n_pairs for r in rows if r.split == k) / len(pairs) for k in shares}
    assert all(abs(total[k] - shares[k]) < 0.03 for k in shares)
    assert related.assign_pairs(s, p, shares).count() == len(pairs)
    assert related.related_pairs(s.limit(0), p.limit(0)).count() == 0
    assert related.split_sequences(s.limit(0), p.limit(0), shares).count() == 0


POINTS = "cloud_id bigint, point_id bigint, coords array<double>, intensity double, ingested_at timestamp, dim string, cell string"


def points(spark, x, extra=()):
    rows = [(1, i, [float(v) for v in p], 1.0, T, "x", "x") for i, p in enumerate(x)]
    return spark.createDataFrame([*rows, *extra], POINTS)


def test_neighbours_with_copies_ties_and_bad_rows(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.integers(-3, 4, (300, 4)), np.zeros((40, 4))]).astype(float)
    bad = [(2, 900, None, 1.0, T, "x", "x"), (2, 901, [1.0], 1.0, T, "x", "x"), (2, 902, [1.0, None, 0.0, 0.0], 1.0, T, "x", "x"), (2, 903, [float("nan")] * 4, 1.0, T, "x", "x"), (2, None, [0.0] * 4, 1.0, T, "x", "x"), (1, 3, x[3].tolist(), None, None, "x", "x")]
    got = {}
    for r in neighbours.nearest_points(points(spark, x, bad), 4, 5, trees=6, budget=4000).collect():
        got.setdefault(r.id, []).append((r.d2, r.other))
    d2 = ((x[:, None] - x[None]) ** 2).sum(2)
    for i in range(len(x)):
        assert sorted(got[i]) == sorted((d2[i, j], j) for j in range(len(x)) if j != i)[:5]
    assert neighbours.close_pairs(points(spark, x[:0]), 4).count() == 0
    assert neighbours.nearest_points(points(spark, x[:1]), 4).count() == 0


def test_recall_of_the_forest(spark):
    rng = np.random.default_rng(2)
    x = (rng.standard_normal((3000, 24)) * np.linspace(2, 0.5, 24)).round(3)
    got = {(r.id, r.other) for r in neighbours.nearest_points(points(spark, x), 24).collect()}
    d2 = ((x[:400, None] - x[None]) ** 2).sum(2)
    d2[np.arange(400), np.arange(400)] = np.inf
    true = [(i, int(j)) for i in range(400) for j in np.argsort(d2[i])[:5]]
    assert sum(t in got for t in true) / len(true) >= 0.9


def test_neighbours_in_a_crowd(spark):
    """A crowd far tighter than the rest has prefixes of its own, beyond the candidates of one prefix length."""
    rng = np.random.default_rng(7)
    x = np.concatenate([rng.standard_normal((1500, 8)) * 3, 1 + rng.standard_normal((1500, 8)) * 1e-3])
    got = {(r.id, r.other) for r in neighbours.nearest_points(points(spark, x), 8, trees=10, budget=400).collect()}
    d2 = ((x[:, None] - x[None]) ** 2).sum(2)
    np.fill_diagonal(d2, np.inf)
    true = [(i, int(j)) for i in range(len(x)) for j in np.argsort(d2[i])[:5]]
    assert sum(t in got for t in true if t[0] >= 1500) >= 0.9 * 7500
    assert sum(t in got for t in true if t[0] < 1500) >= 0.9 * 7500


def test_depth_shared_by_all_trees():
    """Counts of two trees, by hand: lengths 5 and 3 hold one row each, length 2 fills the budget."""
    import pyarrow as pa

    packed = [[(5 << 16) | 1, (2 << 16) | 4], [(3 << 16) | 1, (2 << 16) | 5, (0 << 16) | 90], [(1 << 16) | 3]]
    table = pa.table({"id": pa.array([7, 7, 9]), "counts": pa.array(packed, pa.list_(pa.int32()))})
    found = neighbours.common_depth(table, budget=6, trees=2).to_pydict()
    assert found == {"id": [7, 9], "depth": [3, 0], "more": [4, 0]}


def test_varied_subset_covers_and_skips_repeats(spark):
    rng = np.random.default_rng(3)
    crowd = np.zeros((500, 3)) + rng.random((500, 3)) * 0.01
    far = np.array([[x, y, 0.0] for x in range(1, 6) for y in range(1, 6)]) * 2.0
    x = np.concatenate([crowd, far])
    bad = [(1, 9000, None, 1.0, T, "x", "x"), (1, 9001, [1.0, 2.0], 1.0, T, "x", "x"), (1, 9002, [0.0, 0.0, float("inf")], 1.0, T, "x", "x"), (1, 9003, [1.0, 1.0, 1.0], float("nan"), T, "x", "x"), (7, 9004, [1.0] * 3, 1.0, T, "x", "x"), (1, 2, crowd[2].tolist(), -5.0, datetime(2025, 1, 1), "x", "x")]
    clouds = spark.createDataFrame([(1, "a", 3, 40, T), (2, "b", 3, 5, T), (3, None, 3, None, None)], "cloud_id bigint, dataset string, dim int, m int, loaded_at timestamp")
    rows = variety.varied_subset(points(spark, x, bad), clouds).collect()
    assert len(rows) == len({r.point_id for r in rows}) == 40 and {r.cloud_id for r in rows} == {1}
    assert sum(r.point_id >= 500 for r in rows) >= 20
    few = points(spark, [(0, 0, 0)] * 10, bad[:1])
    assert variety.varied_subset(few, clouds).count() == 10
    assert variety.varied_subset(few.limit(0), clouds).count() == 0
    assert variety.varied_subset(few, clouds.limit(0)).count() == 0
