"""Scores along a sequence of descriptors, and graphs between frames.

A sequence is rows ``(seq, <order columns>, vec array<double>)``; the first order column is a
number or a time. Windows are frames of fixed length by sequence, or by stretch of a sequence
too long for one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from topospark.functions.stretches import looking_back, running_sum
from topospark.functions.vectors import combine, dot, draw_key, norm
from topospark.operators import knn


def unit(v: Column) -> Column:
    """A vector over its length; near zero it stays near zero."""
    length = norm(v) + 1e-8
    return F.transform(v, lambda x: x / length)


def _pair_score(before: Column, now: Column, alpha: float) -> Column:
    """How far the blend of two directions is from the later one."""
    blend = combine(before, now, alpha, 1 - alpha)
    cosine = dot(blend, now) / (norm(blend) * (norm(now) + 1e-8) + 1e-8)
    return 1 - F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine))


def sheaf_score(rows: DataFrame, order: list[str], window: int = 5, alpha: float = 0.8) -> DataFrame:
    """Adds ``sheaf_score``: the mean pair score over the last ``window`` descriptors, 0 at the first."""

    def add(rows: DataFrame, w: WindowSpec) -> DataFrame:
        paired = rows.withColumn("__u", unit(F.col("vec"))).withColumn("__p", F.lag("__u").over(w))
        scored = paired.withColumn("__s", F.when(F.col("__p").isNotNull(), _pair_score(F.col("__p"), F.col("__u"), alpha)))
        return scored.withColumn("sheaf_score", F.coalesce(F.avg("__s").over(w.rowsBetween(-(window - 2), 0)), F.lit(0.0))).drop("__u", "__p", "__s")

    return looking_back(rows, "seq", order, window - 1, add)


def cosine_score(rows: DataFrame, order: list[str]) -> DataFrame:
    """Adds ``cosine_score``: one less the cosine to the descriptor before, 0 at the first."""
    before = looking_back(rows, "seq", order, 1, lambda rows, w: rows.withColumn("__p", F.lag("vec").over(w)))
    cosine = dot("__p", "vec") / (norm("__p") * norm("vec") + 1e-12)
    score = F.when(F.col("__p").isNotNull(), 1 - F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine))).otherwise(0.0)
    return before.withColumn("cosine_score", score).drop("__p")


def variance_and_snr(rows: DataFrame, order: list[str], dim: int, window: int = 5) -> DataFrame:
    """Adds ``variance_score`` (mean deviation of the axes over the window) and ``snr_score`` (its log ratio to the mean step).

    The window holds the last ``window`` descriptors; at the first both are 0.
    """
    axes = range(1, dim + 1)

    def add(rows: DataFrame, w: WindowSpec) -> DataFrame:
        last, steps = w.rowsBetween(-(window - 1), 0), w.rowsBetween(-(window - 2), 0)
        rows = rows.withColumn("__n", F.count(F.lit(1)).over(last)).withColumn("__p", F.lag("vec").over(w))
        for i in axes:
            rows = rows.withColumn(f"__d{i}", F.abs(F.element_at("vec", i) - F.element_at("__p", i)))
        deviation = sum((F.stddev_pop(F.element_at("vec", i)).over(last) for i in axes), F.lit(0.0)) / dim
        step = sum((F.avg(f"__d{i}").over(steps) for i in axes), F.lit(0.0)) / dim
        return rows.withColumn("__s", deviation).withColumn("__t", step)

    rows = looking_back(rows, "seq", order, window - 1, add)
    rows = rows.withColumn("variance_score", F.when(F.col("__n") > 1, F.col("__s")).otherwise(0.0))
    snr = F.log10(F.col("__s") / (F.col("__t") + 1e-12) + 1e-12)
    return rows.withColumn("snr_score", F.when(F.col("__n") > 1, snr).otherwise(0.0)).drop("__n", "__p", "__s", "__t", *[f"__d{i}" for i in axes])


def topological_signal(rows: DataFrame, h1: tuple[int, int] = (12, 10), h2: tuple[int, int] = (24, 10)) -> DataFrame:
    """Adds ``signal_strength``, ``topo_signal`` and ``topo_density`` of feature vectors; ``h1`` and ``h2`` are (first slot, slots)."""
    def strongest(first: int, n: int) -> Column:
        lives = F.transform(F.slice("vec", first + 1, n), lambda x: F.greatest(F.lit(0.0), x))
        return F.aggregate(F.slice(F.sort_array(lives, asc=False), 1, 5), F.lit(0.0), lambda s, x: s + x)

    total = strongest(*h1) + strongest(*h2)
    length = norm("vec")
    return (
        rows.withColumn("signal_strength", F.log10(length + 1e-12))
        .withColumn("topo_signal", F.log10(total + 1e-12))
        .withColumn("topo_density", total / (length + 1e-12))
    )


def fallback(rows: DataFrame, order: list[str]) -> DataFrame:
    """Adds ``used_teacher`` (the descriptor is too weak or too inconsistent) and how often that was so in the sequence."""
    weak = (F.col("topo_density") < 0.002) | (F.col("sheaf_score") > 0.25) | (norm("vec") < 0.5)
    flagged = rows.withColumn("used_teacher", F.coalesce(weak, F.lit(False)).cast("int"))
    return running_sum(flagged, "seq", order, "used_teacher", "fallback_count")


def temporal_graph(points: DataFrame, m: int, k: int, seed: int) -> DataFrame:
    """Edges ``(seq, frame, u, v, dist)`` from each of ``m`` drawn points of a frame to its ``k`` nearest of the next.

    ``points`` are rows (seq, frame, point_id, coords); u and v are point ids.
    """
    rank = F.row_number().over(Window.partitionBy("seq", "frame").orderBy(draw_key("point_id", seed), "point_id"))
    some = points.withColumn("__r", rank).where(F.col("__r") <= m)
    cloud = lambda frame: F.concat_ws("\1", F.col("seq").cast("string"), frame.cast("string"))
    now = some.select(cloud(F.col("frame")).alias("cloud_id"), "point_id", "coords")
    after = some.select(cloud(F.col("frame") - 1).alias("cloud_id"), "point_id", "coords")
    edges = knn.ranked(knn.nearest_of_few(now, after, k))
    parts = F.split("cloud_id", "\1")
    seq = parts.getItem(0).cast(points.schema["seq"].dataType)
    return edges.select(seq.alias("seq"), parts.getItem(1).cast("int").alias("frame"), F.col("point_id").alias("u"), F.col("target_id").alias("v"), "dist")
