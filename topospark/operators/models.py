"""Pose and student networks: forward passes in Arrow batches, training by gradients summed over Spark."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

POSE_LAYERS = (102, 256, 512, 512, 256)
Weights = dict[str, np.ndarray]


def relu(x: np.ndarray) -> np.ndarray:
    return np.maximum(x, 0.0)


def dense(sizes: tuple[int, ...], seed: int, prefix: str = "") -> Weights:
    """Weights of a chain of layers, scaled to their inputs."""
    rng = np.random.default_rng(seed)
    held: Weights = {}
    for i, (a, b) in enumerate(zip(sizes[:-1], sizes[1:], strict=True)):
        held[f"{prefix}w{i}"] = rng.standard_normal((a, b)) * np.sqrt(2 / a)
        held[f"{prefix}b{i}"] = np.zeros(b)
    return held


def pose_network(inputs: int = 102, hidden: tuple[int, ...] = POSE_LAYERS[1:], seed: int = 0) -> Weights:
    """Weights of a network from two descriptors to a translation and a rotation."""
    net = dense((inputs, *hidden), seed, "body_")
    return net | dense((hidden[-1], 3), seed + 1, "t_") | dense((hidden[-1], 4), seed + 2, "q_")


def pose_forward(net: Weights, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Translations, unit quaternions and the activations of all layers."""
    layers = [x]
    while f"body_w{len(layers) - 1}" in net:
        i = len(layers) - 1
        layers.append(relu(layers[-1] @ net[f"body_w{i}"] + net[f"body_b{i}"]))
    raw = layers[-1] @ net["q_w0"] + net["q_b0"]
    return layers[-1] @ net["t_w0"] + net["t_b0"], raw / (np.linalg.norm(raw, axis=1, keepdims=True) + 1e-12), layers


def pose_gradients(net: Weights, x: np.ndarray, t: np.ndarray, q: np.ndarray) -> tuple[float, Weights]:
    """Summed loss and its gradients: squared error of the translation, and one less the squared inner product of the rotations."""
    pt, _, layers = pose_forward(net, x)
    raw = layers[-1] @ net["q_w0"] + net["q_b0"]
    length = np.linalg.norm(raw, axis=1, keepdims=True) + 1e-12
    pq = raw / length
    inner = (pq * q).sum(axis=1, keepdims=True)
    loss = float(((pt - t) ** 2).mean(axis=1).sum() + (1 - inner**2).sum())
    dt = 2 * (pt - t) / 3
    dq = -2 * inner * (q - inner * pq) / length
    grads: Weights = {"t_w0": layers[-1].T @ dt, "t_b0": dt.sum(0), "q_w0": layers[-1].T @ dq, "q_b0": dq.sum(0)}
    back = dt @ net["t_w0"].T + dq @ net["q_w0"].T
    for i in range(len(layers) - 2, -1, -1):
        back = back * (layers[i + 1] > 0)
        grads[f"body_w{i}"], grads[f"body_b{i}"] = layers[i].T @ back, back.sum(0)
        back = back @ net[f"body_w{i}"].T
    return loss, grads


def _flat(net: Weights) -> np.ndarray:
    return np.concatenate([net[k].ravel() for k in sorted(net)])


def _shaped(flat: np.ndarray, like: Weights) -> Weights:
    out, at = {}, 0
    for k in sorted(like):
        out[k] = flat[at : at + like[k].size].reshape(like[k].shape)
        at += like[k].size
    return out


def train_pose(rows: DataFrame, net: Weights, epochs: int = 10, rate: float = 1e-3, patience: int = 5) -> tuple[Weights, list[float]]:
    """Adam on the whole table ``(x, t, q)``; the rate halves when the loss stops falling.

    Each task sums the gradients of its rows; Spark sums the tasks entry by entry, so what reaches
    the driver is as large as the network, whatever the data.
    """
    net = {k: v.copy() for k, v in net.items()}
    m, v = np.zeros_like(_flat(net)), np.zeros_like(_flat(net))
    history: list[float] = []
    waited = 0
    for epoch in range(epochs):
        shared = rows.sparkSession.sparkContext.broadcast(net)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            total, loss, n = None, 0.0, 0
            for batch in batches:
                if not batch.num_rows:
                    continue
                x, t, q = (np.asarray(batch.column(i).flatten().to_numpy(zero_copy_only=False), dtype=float).reshape(batch.num_rows, -1) for i in range(3))
                one, grads = pose_gradients(shared.value, x, t, q)
                flat = _flat(grads)
                total, loss, n = (flat if total is None else total + flat), loss + one, n + batch.num_rows
            if total is not None:
                place = np.arange(len(total) + 2)
                yield pa.RecordBatch.from_arrays([pa.array(place), pa.array(np.concatenate([total, [loss, n]]))], ["i", "g"])

        sums = rows.select("x", "t", "q").mapInArrow(run, "i bigint, g double").groupBy("i").agg(F.sum("g").alias("g")).toPandas().sort_values("i")["g"].to_numpy()
        if not len(sums):
            return net, history
        grad, loss, n = sums[:-2] / sums[-1], sums[-2] / sums[-1], sums[-1]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        step = rate * (m / (1 - 0.9 ** (epoch + 1))) / (np.sqrt(v / (1 - 0.999 ** (epoch + 1))) + 1e-8)
        net = _shaped(_flat(net) - step, net)
        waited = 0 if not history or loss < min(history) else waited + 1
        if waited > patience:
            rate, waited = rate / 2, 0
        history.append(float(loss))
        shared.unpersist()
    return net, history


def predict_poses(rows: DataFrame, net: Weights, keys: list[str]) -> DataFrame:
    """``keys`` with ``translation`` and ``quaternion`` predicted from ``x``; the network is broadcast, its size is fixed."""
    shared = rows.sparkSession.sparkContext.broadcast(net)
    schema = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            x = np.stack(frame["x"].to_numpy()) if len(frame) else np.zeros((0, 1))
            t, q, _ = pose_forward(shared.value, x) if len(frame) else ([], [], [])
            yield frame[keys].assign(translation=list(t), quaternion=list(q))

    return rows.select(*keys, "x").mapInPandas(run, f"{schema}, translation array<double>, quaternion array<double>")


def recurrent_network(inputs: int, hidden: int = 64, seed: int = 0) -> Weights:
    """Weights of a gated recurrent network with heads for translation and rotation."""
    rng = np.random.default_rng(seed)
    scale = np.sqrt(1 / hidden)
    net = {"wx": rng.standard_normal((inputs, 4 * hidden)) * scale, "wh": rng.standard_normal((hidden, 4 * hidden)) * scale, "b": np.zeros(4 * hidden)}
    return net | dense((hidden, 3), seed + 1, "t_") | dense((hidden, 4), seed + 2, "q_")


def recurrent_step(net: Weights, x: np.ndarray, h: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One step of a long short-term memory."""
    n = len(h)
    gates = x @ net["wx"] + h @ net["wh"] + net["b"]
    i, f, o = (1 / (1 + np.exp(-gates[k * n : (k + 1) * n])) for k in (0, 1, 3))
    c = f * c + i * np.tanh(gates[2 * n : 3 * n])
    return o * np.tanh(c), c


def recurrent(inputs: int = 51, hidden: int = 256, layers: int = 2, seed: int = 0) -> Weights:
    """Weights of the recurrent pose network: layers of memory cells, then heads on the change of the last state."""
    rng = np.random.default_rng(seed)
    net: Weights = {}
    for layer in range(layers):
        wide = inputs if layer == 0 else hidden
        net |= {f"wx{layer}": rng.standard_normal((wide, 4 * hidden)) / np.sqrt(wide), f"wh{layer}": rng.standard_normal((hidden, 4 * hidden)) / np.sqrt(hidden), f"b{layer}": np.zeros(4 * hidden)}
    return net | dense((hidden, 3), seed + 1, "t_") | dense((hidden, 4), seed + 2, "q_")


def predict_sequences(rows: DataFrame, net: Weights) -> DataFrame:
    """``(seq, frame, translation, quaternion)``: the pose from each frame of ``(seq, frame, x)`` to the next, by the recurrent network.

    Rows stream through a task sequence by sequence in order, and the state goes on from batch to
    batch, so a sequence may be of any length. The last frame of a sequence has no pose; a null
    sequence is one of its own.
    """
    shared = rows.sparkSession.sparkContext.broadcast(net)
    kind = rows.schema["seq"].dataType.simpleString()
    layers = sum(k.startswith("wx") for k in net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        parts = [{"wx": net[f"wx{i}"], "wh": net[f"wh{i}"], "b": net[f"b{i}"]} for i in range(layers)]
        current, state, before, frame_before = object(), [], None, None
        for batch in batches:
            out: list[tuple] = []
            seqs, frames = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for seq, frame, x in zip(seqs, frames, batch.column(2).to_pylist(), strict=True):
                if seq != current:
                    current, before = seq, None
                    state = [(np.zeros(len(p["wh"])), np.zeros(len(p["wh"]))) for p in parts]
                x = np.asarray(x, dtype=float)
                for i, p in enumerate(parts):
                    state[i] = recurrent_step(p, x, *state[i])
                    x = state[i][0]
                if before is not None:
                    change = x - before
                    q = change @ net["q_w0"] + net["q_b0"]
                    out.append((seq, frame_before, (change @ net["t_w0"] + net["t_b0"]).tolist(), (q / (np.linalg.norm(q) + 1e-12)).tolist()))
                before, frame_before = x, frame
            if out:
                columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), [batch.schema.field(0).type, pa.int32(), pa.list_(pa.float64()), pa.list_(pa.float64())], strict=True)]
                yield pa.RecordBatch.from_arrays(columns, ["seq", "frame", "translation", "quaternion"])

    ordered = rows.select("seq", F.col("frame").cast("int").alias("frame"), "x").repartition("seq").sortWithinPartitions("seq", "frame")
    return ordered.mapInArrow(run, f"seq {kind}, frame int, translation array<double>, quaternion array<double>")


# Layers of the two student networks, of the points and of the pooled cloud.
STUDENTS = {"lite": ((3, 64, 128), (256, 128)), "large": ((3, 64, 128, 256), (512, 256, 128))}


def student_network(kind: str = "lite", outputs: int = 51, seed: int = 0, mean: bool = False) -> Weights:
    """Weights of a student network: points one by one, their maximum (with ``mean`` also their mean), then a descriptor."""
    if kind not in STUDENTS:
        raise ValueError(f"unknown student {kind!r}; there are {', '.join(STUDENTS)}")
    point, head = STUDENTS[kind]
    return dense(point, seed, "point_") | dense(((2 if mean else 1) * point[-1], *head, outputs), seed + 1, "head_")


def student_descriptors(points: DataFrame, net: Weights, mean: np.ndarray | None = None, scale: np.ndarray | None = None) -> DataFrame:
    """``(cloud_id, vector array<double>)`` of clouds by the student network, brought back from normal form by ``mean`` and ``scale``.

    Points pass the first layers in Arrow batches; maxima and sums by cloud are taken in each
    task and joined by Spark, so a cloud may be of any size.
    """
    shared = points.sparkSession.sparkContext.broadcast(net)
    kind = points.schema["cloud_id"].dataType.simpleString()
    width = net[f"point_b{sum(k.startswith('point_b') for k in net) - 1}"].size

    def pool(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if not len(frame):
                continue
            x, i = np.stack(frame["coords"].to_numpy()), 0
            while f"point_w{i}" in shared.value:
                x = relu(x @ shared.value[f"point_w{i}"] + shared.value[f"point_b{i}"])
                i += 1
            for cloud, rows in frame.reset_index(drop=True).groupby("cloud_id", dropna=False).groups.items():
                part = x[rows]
                yield pd.DataFrame({"cloud_id": [cloud] * width, "i": range(width), "high": part.max(0), "total": part.sum(0), "n": [len(rows)] * width})

    pooled = points.select("cloud_id", "coords").where("coords is not null").mapInPandas(pool, f"cloud_id {kind}, i int, high double, total double, n bigint")
    merged = pooled.groupBy("cloud_id", "i").agg(F.max("high").alias("high"), (F.sum("total") / F.sum("n")).alias("mean"))
    wide = merged.groupBy("cloud_id").agg(F.sort_array(F.collect_list(F.struct("i", "high", "mean"))).alias("f"))
    wide = wide.select("cloud_id", F.concat(F.col("f.high"), F.col("f.mean")).alias("x"))

    def head(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            x = np.stack(frame["x"].to_numpy()) if len(frame) else np.zeros((0, 2 * width))
            x = x[:, : len(shared.value["head_w0"])]  # a network that pools by the maximum takes the first half
            last = sum(key.startswith("head_w") for key in shared.value) - 1
            for i in range(last + 1):
                x = x @ shared.value[f"head_w{i}"] + shared.value[f"head_b{i}"]
                x = relu(x) if i < last else x
            x = x * (1.0 if scale is None else scale) + (0.0 if mean is None else mean)
            yield pd.DataFrame({"cloud_id": frame["cloud_id"], "vector": list(x)})

    return wide.mapInPandas(head, f"cloud_id {kind}, vector array<double>")
