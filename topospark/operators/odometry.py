"""Poses of sequences: relative motion, trajectories and their errors."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from topospark.functions import rotations as R
from topospark.functions.stretches import looking_back
from topospark.session import cut_lineage

STRETCH = 512


def relative_poses(poses: DataFrame, stride: int = 1) -> DataFrame:
    """``(seq, frame, translation, quaternion)`` from each pose of ``(seq, frame, pose)`` to the one ``stride`` rows on."""
    rows = poses.select("seq", "frame", F.col("pose").alias("after"))
    back = lambda rows, w: rows.withColumn("from", F.lag("frame", stride).over(w)).withColumn("pose", F.lag("after", stride).over(w))
    rows = looking_back(rows, "seq", ["frame"], stride, back).where("pose is not null and after is not null")
    step = rows.withColumn("step", R.multiply_poses(R.inverse_pose(F.col("pose")), F.col("after")))
    return step.select("seq", F.col("from").alias("frame"), R.translation_of(F.col("step")).alias("translation"), R.matrix_to_quaternion(R.rotation_of(F.col("step"))).alias("quaternion"))


def trajectory(steps: DataFrame) -> DataFrame:
    """``(seq, frame, pose)``: the ordered products of the steps ``(seq, frame, step)`` up to each frame.

    Products associate, so each stretch of ``STRETCH`` frames is multiplied out on its own, then
    the products of whole stretches (one row for each), then both are joined: no task holds
    more of a sequence than a stretch, or a ``STRETCH``-th of it.
    """
    kind = steps.schema["seq"].dataType.simpleString()

    def products(order: str, keep: list[str]):
        def run(table: pa.Table) -> pa.Table:
            table = table.sort_by(order)
            m = table.column("step").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, 4, 4).copy()
            reach = 1
            while reach < len(m):  # doubling: each pass joins runs twice as long
                m[reach:] = m[:-reach] @ m[reach:]
                reach *= 2
            flat = pa.FixedSizeListArray.from_arrays(pa.array(m.ravel()), 16).cast(pa.list_(pa.float64()))
            return table.select(keep).append_column("step", flat)

        return run

    dealt = steps.select("seq", F.floor(F.col("frame") / STRETCH).cast("bigint").alias("stretch"), F.col("frame").cast("int").alias("frame"), "step")
    schema = f"seq {kind}, stretch bigint, frame int, step array<double>"
    local = cut_lineage(dealt.groupBy("seq", "stretch").applyInArrow(products("frame", ["seq", "stretch", "frame"]), schema))  # read below and by the last join
    whole = local.groupBy("seq", "stretch").agg(F.max_by("step", "frame").alias("step"))
    whole = whole.groupBy("seq").applyInArrow(products("stretch", ["seq", "stretch"]), f"seq {kind}, stretch bigint, step array<double>")
    along = Window.partitionBy("seq").orderBy("stretch")
    before = whole.select("seq", "stretch", F.lag("step").over(along).alias("before")).where("before is not null")
    rows = local.join(before, local.seq.eqNullSafe(before.seq) & (local.stretch == before.stretch), "left").select(local.seq, "frame", "step", "before")
    return rows.select("seq", "frame", F.when(F.col("before").isNull(), F.col("step")).otherwise(R.multiply_poses(F.col("before"), F.col("step"))).alias("pose"))


def absolute_error(predicted: DataFrame, truth: DataFrame) -> DataFrame:
    """``(seq, ate)``: root mean square distance of the positions, no alignment, over the frames both have."""
    rows = predicted.select("seq", "frame", F.col("pose").alias("p")).join(truth.select("seq", "frame", F.col("pose").alias("g")), ["seq", "frame"])
    gap = F.zip_with(R.translation_of(F.col("p")), R.translation_of(F.col("g")), lambda a, b: (a - b) * (a - b))
    return rows.groupBy("seq").agg(F.sqrt(F.avg(F.aggregate(gap, F.lit(0.0), lambda s, x: s + x))).alias("ate"))


def relative_error(predicted: DataFrame, truth: DataFrame, delta: int = 1) -> DataFrame:
    """``(seq, rpe_translation, rpe_rotation)``: root mean square error of the motion over ``delta`` frames, rotation in degrees."""
    rows = predicted.select("seq", "frame", F.col("pose").alias("p2")).join(truth.select("seq", "frame", F.col("pose").alias("g2")), ["seq", "frame"])
    back = lambda rows, w: rows.withColumn("p", F.lag("p2", delta).over(w)).withColumn("g", F.lag("g2", delta).over(w))
    rows = looking_back(rows, "seq", ["frame"], delta, back).where("p is not null and p2 is not null")
    rows = rows.withColumn("moved", R.multiply_poses(R.inverse_pose(F.col("p")), F.col("p2"))).withColumn("meant", R.multiply_poses(R.inverse_pose(F.col("g")), F.col("g2")))
    rows = rows.withColumn("error", R.multiply_poses(R.inverse_pose(F.col("meant")), F.col("moved")))
    shift = F.aggregate(F.transform(R.translation_of(F.col("error")), lambda x: x * x), F.lit(0.0), lambda s, x: s + x)
    turn = R.rotation_degrees(F.col("error"))
    return rows.groupBy("seq").agg(F.sqrt(F.avg(shift)).alias("rpe_translation"), F.sqrt(F.avg(turn * turn)).alias("rpe_rotation"))


def pose_loss(rows: DataFrame, w_t: float = 1.0, w_r: float = 1.0) -> DataFrame:
    """``(seq, translation_loss, rotation_loss, pose_loss)`` of rows (seq, t, q, t_true, q_true)."""
    gap = F.aggregate(F.zip_with("t", "t_true", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x) / F.size("t")
    rows = rows.groupBy("seq").agg(F.avg(gap).alias("translation_loss"), F.avg(R.geodesic_loss(F.col("q"), F.col("q_true"))).alias("rotation_loss"))
    return rows.withColumn("pose_loss", w_t * F.col("translation_loss") + w_r * F.col("rotation_loss"))


def overall(metrics: DataFrame, columns: list[str]) -> DataFrame:
    """Mean and deviation of per-sequence metrics over all sequences."""
    return metrics.agg(*[f(c).alias(f"{c}_{n}") for c in columns for f, n in ((F.avg, "mean"), (F.stddev_pop, "std"))])
