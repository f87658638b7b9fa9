"""Clouds before analysis: bounds, normalisation, intensities and sampling.

A cloud is rows ``(cloud_id, point_id, coords array<double>, intensity double)``; any number of
clouds share one table and one plan. A point with null coordinates has no bounds and stays null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from topospark.functions.quantiles import quantiles
from topospark.functions.vectors import as_vector, distance, draw, draw_key
from topospark.session import cut_lineage


def embeddings_to_cloud(df: DataFrame, cloud: str, point: str, vector: str, weight: str | None = None) -> DataFrame:
    """Rows of vectors as a cloud; weights default to 1."""
    intensity = F.col(weight).cast("double") if weight else F.lit(1.0)
    return df.select(F.col(cloud).alias("cloud_id"), F.col(point).alias("point_id"), as_vector(vector).alias("coords"), intensity.alias("intensity"))


def bounds(points: DataFrame) -> DataFrame:
    """``(cloud_id, bounds_min, bounds_max, diameter, n)`` of each cloud; partial aggregates per axis, no large group."""
    axes = points.select("cloud_id", F.posexplode("coords").alias("axis", "x"))
    axes = axes.groupBy("cloud_id", "axis").agg(F.min("x").alias("low"), F.max("x").alias("high"), F.count(F.lit(1)).alias("n"))
    box = axes.groupBy("cloud_id").agg(F.sort_array(F.collect_list(F.struct("axis", "low", "high"))).alias("box"), F.max("n").alias("n"))
    low, high = F.transform("box", lambda b: b["low"]), F.transform("box", lambda b: b["high"])
    return box.select("cloud_id", low.alias("bounds_min"), high.alias("bounds_max"), distance(low, high).alias("diameter"), "n")


def normalise_isotropic(points: DataFrame, center: bool = True, scale: bool = True) -> DataFrame:
    """Shifts each cloud to the middle of its box and divides by the diagonal, if that is positive."""
    rows = points.join(bounds(points).drop("n"), "cloud_id")
    middle = F.zip_with("bounds_min", "bounds_max", lambda a, b: (a + b) / 2)
    coords = F.zip_with("coords", middle, lambda x, c: x - c) if center else F.col("coords")
    if scale:
        by = F.when(F.col("diameter") > 0, F.col("diameter")).otherwise(F.lit(1.0))
        coords = F.transform(coords, lambda x: x / by)
    return rows.withColumn("coords", coords).drop("bounds_min", "bounds_max", "diameter")


def normalise_minmax(points: DataFrame) -> DataFrame:
    """Each axis of each cloud to [0, 1]; an axis without span divides by 1."""
    rows = points.join(bounds(points).select("cloud_id", "bounds_min", "bounds_max"), "cloud_id")
    span = F.zip_with("bounds_min", "bounds_max", lambda a, b: F.when(b > a, b - a).otherwise(F.lit(1.0)))
    shifted = F.zip_with("coords", "bounds_min", lambda x, a: x - a)
    return rows.withColumn("coords", F.zip_with(shifted, span, lambda x, s: x / s)).drop("bounds_min", "bounds_max")


def shift_intensity(points: DataFrame) -> DataFrame:
    """Intensities from just above 0 in each cloud."""
    low = points.groupBy("cloud_id").agg(F.min("intensity").alias("low"))
    return points.join(low, "cloud_id").withColumn("intensity", F.col("intensity") - F.col("low") + 1e-9).drop("low")


def soften_intensity(points: DataFrame, percentile: float) -> DataFrame:
    """Clips intensities to [0, percentile] of the cloud; unchanged for a percentile outside (0, 100) or a bound of 0 or less."""
    if not 0 < percentile < 100:
        return points
    top = quantiles(points, "intensity", {"top": percentile / 100}, ["cloud_id"])
    clipped = F.greatest(F.lit(0.0), F.least("intensity", "top"))
    return points.join(top, "cloud_id").withColumn("intensity", F.when(F.col("top") > 0, clipped).otherwise(F.col("intensity"))).drop("top")


def with_weights(points: DataFrame) -> DataFrame:
    """Adds ``weight``: intensities above the least of the cloud, summing to 1; equal weights where all are about 0."""
    sums = points.groupBy("cloud_id").agg(F.min("intensity").alias("low"), F.max("intensity").alias("high"), F.sum("intensity").alias("held"), F.count(F.lit(1)).alias("n"))
    flat = F.col("high") - F.col("low") <= 1e-8
    weight = F.when(flat, 1.0 / F.col("n")).otherwise((F.col("intensity") - F.col("low")) / (F.col("held") - F.col("n") * F.col("low")))
    return points.join(sums, "cloud_id").withColumn("weight", weight).drop("low", "high", "held", "n")


def intensity_mask(points: DataFrame, threshold: float | None = None, percentile: float = 97.5) -> DataFrame:
    """Points at or above a threshold, or else at or above a percentile of their cloud."""
    if threshold is not None:
        return points.where(F.col("intensity") >= threshold)
    cut = quantiles(points, "intensity", {"cut": percentile / 100}, ["cloud_id"])
    return points.join(cut, "cloud_id").where(F.col("intensity") >= F.col("cut")).drop("cut")


def first_by(points: DataFrame, order: list[Column], wanted: Column | int, most: int | None = None) -> DataFrame:
    """The first ``wanted`` points of each cloud. ``most`` bounds ``wanted``; given, Spark prunes before the shuffle."""
    rank = F.row_number().over(Window.partitionBy("cloud_id").orderBy(*order))
    ranked = points.withColumn("__rank", rank)
    if most is not None:
        ranked = ranked.where(F.col("__rank") <= most)
    return ranked.where(F.col("__rank") <= wanted).drop("__rank")


def sample(points: DataFrame, n: int, seed: int) -> DataFrame:
    """A uniform sample of at most ``n`` points of each cloud."""
    return first_by(points, [draw_key("point_id", seed), F.col("point_id")], n, n)


def thin(points: DataFrame, ratio: float, seed: int) -> DataFrame:
    """Keeps about ``ratio`` of each cloud; unchanged unless 0 < ratio < 1 and at least 32 but not all points would stay.

    A threshold on the random number is found by counting, so the cloud is not sorted in one task.
    """
    if not 0 < ratio < 1:
        return points
    drawn = points.withColumn("__u", draw_key("point_id", seed))
    slot = F.substring("__u", 1, 3)
    counts = drawn.groupBy("cloud_id", slot.alias("__slot")).agg(F.count(F.lit(1)).alias("__n"))  # at most 4096 slots a cloud
    w = Window.partitionBy("cloud_id")
    before = F.sum("__n").over(w.orderBy("__slot").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select("cloud_id", "__slot", F.coalesce(before, F.lit(0)).alias("__before"), F.sum("__n").over(w).alias("__all"))
    rank = F.col("__before") + F.row_number().over(Window.partitionBy("cloud_id", "__slot").orderBy("__u", "point_id"))
    target = F.floor(F.col("__all") * ratio)
    keep = F.when((target >= 32) & (target < F.col("__all")), rank <= target).otherwise(F.lit(True))
    rows = drawn.withColumn("__slot", slot).join(counts, ["cloud_id", "__slot"]).withColumn("__keep", keep)
    return rows.where("__keep").select(*points.columns)


def weighted_sample(points: DataFrame, n: int, seed: int) -> DataFrame:
    """At most ``n`` points of each cloud without replacement, with chances by intensity above the least; zero weights last."""
    rows = with_weights(points)
    order = F.when(F.col("weight") > 0, -F.ln(draw("point_id", seed)) / F.col("weight")).otherwise(F.lit(float("inf")))
    return first_by(rows, [F.round(order, 9), draw_key("point_id", seed), F.col("point_id")], n, n).drop("weight")


def landmark_budget(points: DataFrame, base: float, exponent: float, least: int, most: int) -> DataFrame:
    """``(cloud_id, n, m)``: the number of landmarks scaled to the size of the cloud, halves to even."""
    n = points.groupBy("cloud_id").agg(F.count(F.lit(1)).alias("n"))
    m = F.least(F.lit(most), F.greatest(F.lit(least), F.bround(base * F.pow(F.col("n").cast("double"), F.lit(exponent)), 0).cast("int")))
    return n.select("cloud_id", "n", m.alias("m"))


def pad_or_sample(points: DataFrame, n: int, seed: int) -> DataFrame:
    """Exactly ``n`` rows of each cloud: a sample, or with repeats where it has fewer (column ``copy`` from 0)."""
    counted = points.groupBy("cloud_id").agg(F.count(F.lit(1)).alias("__n"))
    rows = sample(points, n, seed).join(counted, "cloud_id")
    rank = F.row_number().over(Window.partitionBy("cloud_id").orderBy(draw_key("point_id", seed), "point_id"))
    copies = F.greatest(F.lit(1), F.floor((n - F.col("__rank")) / F.col("__n")).cast("int") + 1)
    return rows.withColumn("__rank", rank).withColumn("copy", F.explode(F.sequence(F.lit(0), copies - 1))).drop("__rank", "__n")


def require_points(points: DataFrame, least: int) -> DataFrame:
    """Fails when a cloud has fewer than ``least`` points."""
    n = points.groupBy("cloud_id").agg(F.count(F.lit(1)).alias("__n"))
    rows = points.join(n, "cloud_id")
    message = F.format_string(f"cloud %s has %d points, {least} needed", F.col("cloud_id").cast("string"), F.col("__n"))
    checked = rows.withColumn("__ok", F.assert_true(F.col("__n") >= least, message))
    return checked.where(F.col("__ok").isNull()).drop("__n", "__ok")


def voxels_to_world(voxels: DataFrame, affine: list[list[float]] | None = None) -> DataFrame:
    """Points of voxels ``(cloud_id, voxel_id, ijk or i, j, k, value)`` under a 4x4 affine; the value becomes the intensity.

    Without one the column ``affine`` (16 numbers by row) of each volume holds.
    """
    entry = lambda r, c: F.element_at("affine", 4 * r + c + 1) if affine is None else F.lit(float(affine[r][c]))
    place = lambda c: F.get("ijk", F.lit(c)) if "ijk" in voxels.columns else F.col("ijk"[c])
    at = [sum((entry(r, c) * place(c) for c in range(3)), entry(r, 3)) for r in range(3)]
    return voxels.select("cloud_id", F.col("voxel_id").alias("point_id"), F.array(*at).alias("coords"), F.col("value").alias("intensity"))


def volume_to_cloud(voxels: DataFrame, affine: list[list[float]] | None, percentile: float, max_points: int, seed: int, threshold: float | None = None) -> DataFrame:
    """A volume as a cloud: masked, placed in the world, each axis to [0, 1], sampled by intensity, shifted above 0."""
    placed = cut_lineage(voxels_to_world(voxels, affine))  # each step reads its input several times
    cloud = cut_lineage(intensity_mask(placed, threshold, percentile))
    return shift_intensity(cut_lineage(weighted_sample(normalise_minmax(cloud), max_points, seed)))
