"""Sequences: scores, poses, graphs, streams, models."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from topospark.functions import rotations as R
from topospark.functions import stretches
from topospark.operators import graph, models, odometry, temporal
from topospark.plans import pipeline
from topospark.streaming import scores


def walk(spark, n=6, dim=51):
    rng = np.random.RandomState(0)
    return spark.createDataFrame([("s", i, i, rng.randn(dim).tolist()) for i in range(n)], "seq string, ts int, event_id int, vec array<double>")


def test_sheaf_scores_start_at_zero_and_stay_bounded(spark):
    rows = temporal.sheaf_score(walk(spark), ["ts"], window=4).orderBy("ts").collect()
    assert rows[0].sheaf_score == 0.0
    assert all(np.isfinite(r.sheaf_score) and 0 <= r.sheaf_score <= 2 for r in rows)


def test_stretches_change_no_window(spark, monkeypatch):
    rng = np.random.default_rng(3)
    data = [("hot" if i % 3 else None, None if i % 29 == 0 else int(rng.integers(0, 12)) ** 2, i, rng.standard_normal(3).tolist()) for i in range(120)]
    data += [("same", 5, i, rng.standard_normal(3).tolist()) for i in range(200, 209)] + [("one", 1, 300, [1.0, 2.0, 3.0])]
    rows = spark.createDataFrame(data, "seq string, ts int, event_id int, vec array<double>")
    order = ["ts", "event_id"]

    def results():
        out = temporal.variance_and_snr(temporal.cosine_score(temporal.sheaf_score(rows, order), order), order, 3)
        out = temporal.fallback(temporal.topological_signal(out, (1, 1), (2, 1)), order)
        return {r.event_id: r.asDict() for r in out.drop("vec").collect()}

    whole = results()
    monkeypatch.setattr(stretches, "STRETCH", 2)
    parts = results()
    assert whole.keys() == parts.keys() and len(parts) == len(data)
    for k, row in whole.items():
        assert row.keys() == parts[k].keys()
        for c, v in row.items():
            assert parts[k][c] == (pytest.approx(v, abs=1e-6) if isinstance(v, float) else v), (k, c)


def test_pairs_and_poses_over_many_stretches(spark, monkeypatch):
    frames = [f for f in range(60) if f % 7]
    eye = [1.0, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1]
    poses = spark.createDataFrame([("s", f, [float(x) for x in (*eye[:3], f, *eye[4:])]) for f in frames], "seq string, frame int, pose array<double>")
    for limit in (1 << 20, 4):
        monkeypatch.setattr(stretches, "STRETCH", limit)
        pairs = sorted((r.frame_t, r.frame_t1) for r in pipeline.pair_index(poses, 3).collect())
        assert pairs == [(a, b) for i, (a, b) in enumerate(zip(frames, frames[3:])) if i % 3 == 0]
        steps = sorted((r.frame, r.translation[0]) for r in odometry.relative_poses(poses, 2).collect())
        assert steps == [(a, float(b - a)) for a, b in zip(frames, frames[2:])]
        assert odometry.relative_error(poses, poses, 2).first().rpe_translation == 0.0


def test_trajectory_over_many_stretches(spark, monkeypatch):
    monkeypatch.setattr(odometry, "STRETCH", 4)
    rng = np.random.default_rng(1)
    q, t = rng.standard_normal((70, 4)), rng.standard_normal((70, 3))
    steps = spark.createDataFrame([("a", i, q[i].tolist(), t[i].tolist()) for i in range(70)], "seq string, frame int, q array<double>, t array<double>")
    steps = steps.select("seq", "frame", R.pose(R.quaternion_to_matrix(F.col("q")), F.col("t")).alias("step"))
    at = {r.frame: np.array(r.pose).reshape(4, 4) for r in odometry.trajectory(steps).collect()}
    total = np.eye(4)
    for r in steps.orderBy("frame").collect():
        total = total @ np.array(r.step).reshape(4, 4)
        assert np.allclose(at[r.frame], total)


def test_errors_of_equal_and_shifted_walks(spark):
    eye = [1.0, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1]
    moved = [*eye[:3], 3.0, *eye[4:7], 4.0, *eye[8:]]
    schema = "seq string, frame int, pose array<double>"
    a = spark.createDataFrame([("s", i, [float(x) for x in eye]) for i in range(3)], schema)
    b = spark.createDataFrame([("s", i, [float(x) for x in moved]) for i in range(3)], schema)
    assert odometry.absolute_error(a, b).first().ate == 5.0
    r = odometry.relative_error(a, b).first()
    assert r.rpe_translation == 0.0 and r.rpe_rotation == 0.0


def test_low_pass_keeps_a_constant_signal(spark):
    edges = spark.createDataFrame([("g", i, i + 1) for i in range(5)], "graph string, u int, v int")
    signal = spark.createDataFrame([("g", i, 2.0) for i in range(6)], "graph string, i int, value double")
    out = graph.low_pass(signal, graph.laplacian(edges), 0.2).collect()
    assert np.allclose([r.value for r in out], 2.0)
    total = graph.laplacian(edges).groupBy("i").agg(F.sum("value").alias("s"))
    assert all(abs(r.s) < 1e-12 for r in total.collect())


def test_stream_scores_equal_batch_scores(spark, tmp_path):
    pytest.importorskip("google.protobuf")
    rows = walk(spark, 8, 3)
    rows.write.parquet(str(tmp_path / "in"))
    scores.use_rocksdb(spark)
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    scores.run_to_parquet(scores.sheaf_stream(stream), str(tmp_path / "out"), str(tmp_path / "cp"))
    got = {r.event_id: r.sheaf_score for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {r.event_id: r.sheaf_score for r in temporal.sheaf_score(rows, ["ts"]).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_pose_gradients_and_training(spark):
    net = models.pose_network(6, (8,), 1)
    rng = np.random.default_rng(1)
    x, t, q = rng.random((5, 6)), rng.random((5, 3)), rng.standard_normal((5, 4))
    q /= np.linalg.norm(q, axis=1, keepdims=True)
    loss, grads = models.pose_gradients(net, x, t, q)
    for name in ("body_w0", "t_w0", "q_w0", "q_b0"):
        bumped = {k: v.copy() for k, v in net.items()}
        bumped[name].ravel()[1] += 1e-6
        assert (models.pose_gradients(bumped, x, t, q)[0] - loss) / 1e-6 == pytest.approx(grads[name].ravel()[1], abs=1e-3)
    rows = spark.createDataFrame([(x[i].tolist(), t[i].tolist(), q[i].tolist()) for i in range(5)], "x array<double>, t array<double>, q array<double>")
    trained, history = models.train_pose(rows, net, 6, 0.01)
    assert history[-1] < history[0]
    out = models.predict_poses(rows.withColumn("id", F.monotonically_increasing_id()), trained, ["id"]).collect()
    assert all(abs(np.linalg.norm(r.quaternion) - 1) < 1e-6 for r in out)


def test_student_ignores_the_order_of_points(spark):
    rng = np.random.default_rng(1)
    pts = spark.createDataFrame([("c", rng.random(3).tolist()) for _ in range(40)], "cloud_id string, coords array<double>")
    net = models.dense((3, 8, 16), 0, "point_") | models.dense((32, 128, 51), 1, "head_")
    a, b = models.student_descriptors(pts, net).first().vector, models.student_descriptors(pts.orderBy(F.rand(3)).repartition(5), net).first().vector
    assert len(a) == 51 and np.allclose(a, b)


def test_recurrent_state_goes_through_a_sequence(spark):
    net = models.recurrent(3, 4, 2, seed=1)
    rng = np.random.default_rng(0)
    x = rng.standard_normal((60, 3))
    rows = spark.createDataFrame([("a", i, v.tolist()) for i, v in enumerate(x)] + [("b", 5, [0.0] * 3), (None, 1, [1.0] * 3), (None, 2, [2.0] * 3)], "seq string, frame int, x array<double>")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    got = models.predict_sequences(rows, net).toPandas()
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    state, last = [(np.zeros(4), np.zeros(4))] * 2, []
    for v in x:
        for i in range(2):
            part = {"wx": net[f"wx{i}"], "wh": net[f"wh{i}"], "b": net[f"b{i}"]}
            state[i] = models.recurrent_step(part, v, *state[i])
            v = state[i][0]
        last.append(v)
    own = got[got.seq == "a"].sort_values("frame")
    assert own.frame.tolist() == list(range(59)) and len(got[got.seq == "b"]) == 0 and got.seq.isna().sum() == 1
    assert np.allclose(np.stack(own.translation.to_numpy()), np.diff(last, axis=0) @ net["t_w0"] + net["t_b0"])
    assert np.allclose(np.linalg.norm(np.stack(own["quaternion"].to_numpy()), axis=1), 1)


def test_students_pool_points_and_give_up_normal_form(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((40, 3))
    rows = spark.createDataFrame([(i % 2, i, v.tolist()) for i, v in enumerate(x)], "cloud_id int, point_id int, coords array<double>")
    for kind in ("lite", "large"):
        net = models.student_network(kind, 7)
        got = {r.cloud_id: r.vector for r in models.student_descriptors(rows, net, np.full(7, 5.0), np.full(7, 2.0)).collect()}
        for cloud in (0, 1):
            y, i = x[cloud::2], 0
            while f"point_w{i}" in net:
                y, i = np.maximum(y @ net[f"point_w{i}"] + net[f"point_b{i}"], 0), i + 1
            y, i = y.max(0), 0
            while f"head_w{i}" in net:
                y, i = (y if i == 0 else np.maximum(y, 0)) @ net[f"head_w{i}"] + net[f"head_b{i}"], i + 1
            assert np.allclose(got[cloud], y * 2 + 5)


def test_long_gaps_in_a_trajectory(spark):
    from topospark.operators import odometry

    step = np.eye(4)
    step[0, 3] = 1.0
    frames = [0, 1, 2, 5000, 5001, 12000]
    rows = spark.createDataFrame([("a", f, step.ravel().tolist()) for f in frames], "seq string, frame int, step array<double>")
    got = {r.frame: r.pose[3] for r in odometry.trajectory(rows).collect()}
    assert got == {f: i + 1.0 for i, f in enumerate(frames)}


def test_stretches_hold_as_many_rows_whatever_the_gaps(spark, monkeypatch):
    from topospark.functions import stretches

    monkeypatch.setattr(stretches, "STRETCH", 100)
    rows = spark.range(1000).select(F.lit("a").alias("seq"), F.when(F.col("id") == 999, 10**9).otherwise(F.col("id")).alias("frame"))
    held = stretches.cut(rows, "seq", ["frame"]).groupBy("__stretch").count().collect()
    assert len(held) == 10 and max(r["count"] for r in held) <= 110
