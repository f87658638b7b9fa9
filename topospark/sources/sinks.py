"""Writers of results, clouds and models."""

from __future__ import annotations

import os

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_results(rows: DataFrame, path: str) -> None:
    """Result rows as one CSV file with its columns in alphabetical order; rows are as many as clouds times methods."""
    rows.select(*sorted(rows.columns)).coalesce(1).write.mode("overwrite").csv(path, header=True)


def combine(runs: dict[str, DataFrame]) -> DataFrame:
    """Rows of several runs under all their columns, labelled by run."""
    tables = [df.withColumn("batch_label", F.lit(label)) for label, df in runs.items()]
    whole = tables[0]
    for table in tables[1:]:
        whole = whole.unionByName(table, allowMissingColumns=True)
    return whole


def write_ply(points: DataFrame, path: str) -> None:
    """The points of a three-dimensional cloud as one ASCII PLY file, six decimals, in a folder.

    Header and body are rows of one table in one order, so they come out as one file.
    """
    n = points.count()
    head = ["ply", "format ascii 1.0", f"element vertex {n}", *(f"property float {a}" for a in "xyz"), "end_header"]
    header = points.sparkSession.createDataFrame([(i - len(head), line) for i, line in enumerate(head)], "part int, value string").select("part", F.lit(None).cast(points.schema["point_id"].dataType).alias("point_id"), "value")
    line = F.format_string("%.6f %.6f %.6f", *[F.element_at("coords", i) for i in (1, 2, 3)])
    body = points.select(F.lit(0).alias("part"), "point_id", line.alias("value"))
    header.unionByName(body).repartition(1).sortWithinPartitions("part", "point_id").select("value").write.mode("overwrite").text(path)


def write_points(points: DataFrame, path: str) -> None:
    """A cloud as parquet."""
    points.write.mode("overwrite").parquet(path)


def write_landmark_indices(landmarks: DataFrame, path: str) -> None:
    """The ids of one cloud's landmarks in rank order as a ``.npy`` file on the driver's disk; landmarks are bounded by their budget."""
    ids = [row.point_id for row in landmarks.orderBy("rank").select("point_id").collect()]
    np.save(path, np.array(ids, dtype=np.int64))


def write_weights(weights: dict[str, np.ndarray], path: str, latest: bool = False) -> None:
    """A model's arrays; ``latest`` writes beside the best."""
    os.makedirs(path, exist_ok=True)
    np.savez(os.path.join(path, "latest.npz" if latest else "best.npz"), **weights)


def read_weights(path: str, latest: bool = False) -> dict[str, np.ndarray]:
    """The arrays of a written model."""
    with np.load(os.path.join(path, "latest.npz" if latest else "best.npz")) as held:
        return {name: held[name] for name in held.files}


def write_diagnostics(rows: DataFrame, path: str) -> None:
    """Scores by frame as CSV, one folder a sequence."""
    columns = ["sheaf_score", "variance_score", "snr_score", "signal_strength", "topo_signal", "topo_density", "used_teacher"]
    rows.select("seq", *[c for c in ("frame", "event_id") if c in rows.columns], *columns).write.mode("overwrite").partitionBy("seq").csv(path, header=True)
