"""Changed copies of clouds, density by voxels, stratified samples and losses for training descriptors."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from topospark.functions.quantiles import quantiles
from topospark.functions.vectors import dot, draw, draw_key, norm


def rotate_z(points: DataFrame, seed: int) -> DataFrame:
    """Each cloud turned around the vertical by a drawn angle."""
    angle = 2 * math.pi * draw(F.col("cloud_id"), seed)
    x, y, z = (F.element_at("coords", i) for i in (1, 2, 3))
    return points.withColumn("coords", F.array(x * F.cos(angle) - y * F.sin(angle), x * F.sin(angle) + y * F.cos(angle), z))


def jitter(points: DataFrame, sigma: float, seed: int) -> DataFrame:
    """Normal noise on every coordinate."""
    key = F.concat_ws(":", F.col("cloud_id").cast("string"), F.col("point_id").cast("string"))
    noise = lambda i: sigma * F.sqrt(-2 * F.ln(draw(F.concat(key, F.lit(":"), i.cast("string")), seed))) * F.cos(2 * math.pi * draw(F.concat(key, F.lit(":"), i.cast("string")), seed + 1))
    return points.withColumn("coords", F.transform("coords", lambda x, i: x + noise(i)))


def rescale(points: DataFrame, low: float, high: float, seed: int) -> DataFrame:
    """Each cloud larger or smaller by a drawn factor."""
    factor = low + (high - low) * draw(F.col("cloud_id"), seed)
    return points.withColumn("coords", F.transform("coords", lambda x: x * factor))


def drop_sectors(points: DataFrame, sectors: int, dropped: int, seed: int) -> DataFrame:
    """Without the points in ``dropped`` drawn sectors of the azimuth of each cloud."""
    turn = F.floor((F.atan2(F.element_at("coords", 2), F.element_at("coords", 1)) + math.pi) / (2 * math.pi / sectors))
    sector = F.least(F.lit(sectors - 1), turn).cast("int")
    drawn = F.transform(F.sequence(F.lit(0), F.lit(sectors - 1)), lambda s: F.struct(draw_key(F.concat_ws(":", F.col("cloud_id").cast("string"), s.cast("string")), seed).alias("u"), s.alias("s")))
    gone = F.transform(F.slice(F.array_sort(drawn), 1, dropped), lambda d: d["s"])
    return points.where(~F.array_contains(gone, sector))


def thin_by_range(points: DataFrame, full: float, seed: int) -> DataFrame:
    """Keeps all points up to the range ``full``, beyond it fewer with the square of the distance."""
    far = norm("coords")
    key = F.concat_ws(":", F.col("cloud_id").cast("string"), F.col("point_id").cast("string"))
    return points.where((far <= full) | (draw(key, seed) < (full / far) * (full / far)))


def thin_by_distance(points: DataFrame, least: float, reach: float, seed: int) -> DataFrame:
    """Keeps a point with a chance that falls with its distance from 1 to ``least``, on the scale of ``reach``."""
    key = F.concat_ws(":", F.col("cloud_id").cast("string"), F.col("point_id").cast("string"))
    return points.where(draw(key, seed) < least + (1 - least) * F.exp(-norm("coords") / reach))


def ground_noise(points: DataFrame, sigma: float, seed: int) -> DataFrame:
    """Normal noise on the height, the third coordinate, alone: uneven ground."""
    key = F.concat_ws(":", F.col("cloud_id").cast("string"), F.col("point_id").cast("string"))
    noise = sigma * F.sqrt(-2 * F.ln(draw(key, seed))) * F.cos(2 * math.pi * draw(key, seed + 1))
    return points.withColumn("coords", F.transform("coords", lambda x, i: F.when(i == 2, x + noise).otherwise(x)))


def voxel_density(points: DataFrame, cell: float) -> DataFrame:
    """Adds ``density``, the number of points in the same voxel of the cloud; counts are joined back, no group is gathered."""
    voxel = F.transform("coords", lambda x: F.floor(x / cell))
    rows = points.withColumn("__v", voxel)
    held = rows.groupBy("cloud_id", "__v").agg(F.count(F.lit(1)).alias("density"))
    return rows.join(held, ["cloud_id", "__v"]).drop("__v")


def hybrid_thinning(points: DataFrame, n: int, cell: float, seed: int) -> DataFrame:
    """At most ``n`` points of each cloud, drawn with chances inverse to the density of their voxel."""
    order = F.round(-F.ln(draw("point_id", seed)) * F.col("density"), 9)
    rank = F.row_number().over(Window.partitionBy("cloud_id").orderBy(order, draw_key("point_id", seed), "point_id"))
    return voxel_density(points, cell).withColumn("__r", rank).where(F.col("__r") <= n).drop("__r", "density")


def bins(df: DataFrame, column: str, n: int, name: str) -> DataFrame:
    """Adds ``name``, the quantile bin (from 0) of a column over the whole table; nulls stay null."""
    shares = {f"e{i}": i / n for i in range(1, n)}
    edges = quantiles(df.withColumn("__all", F.lit(0)), column, shares, ["__all"]).select(*shares).first()  # n - 1 numbers
    passed = sum(((F.col(column) > e).cast("int") for e in edges or []), F.lit(0))
    return df.withColumn(name, F.when(F.col(column).isNotNull(), passed))


def stratified_sample(df: DataFrame, first: str, second: str, key: list[str], seed: int, bins_first: int = 5, bins_second: int = 4, part: int = 20) -> DataFrame:
    """A ``part``-th of every stratum of two binned columns, at least one row of each.

    Rows have a drawn order; counts by stratum and the first digits of the draw tell where the
    wanted number is reached, so only rows with the same digits are ever sorted together.
    """
    rows = bins(bins(df, first, bins_first, "stratum_a"), second, bins_second, "stratum_b")
    rows = rows.withColumn("__u", draw_key(F.concat_ws(":", *[F.col(k).cast("string") for k in key]), seed))
    rows = rows.withColumn("__s", F.struct("stratum_a", "stratum_b")).withColumn("__slot", F.substring("__u", 1, 3))
    held = rows.groupBy("__s", "__slot").agg(F.count(F.lit(1)).alias("__n"))  # at most 4096 rows a stratum
    w = Window.partitionBy("__s")
    before = F.sum("__n").over(w.orderBy("__slot").rowsBetween(Window.unboundedPreceding, -1))
    held = held.select("__s", "__slot", F.coalesce(before, F.lit(0)).alias("__before"), F.sum("__n").over(w).alias("__all"))
    wanted = F.greatest(F.lit(1), F.floor(F.col("__all") / part))
    inside = F.row_number().over(Window.partitionBy("__s", "__slot").orderBy("__u", *key))
    near = rows.join(held.where(F.col("__before") < wanted), ["__s", "__slot"])
    return near.withColumn("__r", F.col("__before") + inside).where(F.col("__r") <= wanted).select(*df.columns, "stratum_a", "stratum_b")


def cosine_loss(student: Column, teacher: Column, weight: Column | None = None) -> Column:
    """One less the cosine of two descriptors; with a weight of each slot, of the weighted descriptors."""
    if weight is not None:
        student, teacher = (F.zip_with(v, weight, lambda x, w: x * F.sqrt(w)) for v in (student, teacher))
    return 1 - dot(student, teacher) / (norm(student) * norm(teacher) + 1e-12)


def cross_view_loss(first: DataFrame, second: DataFrame) -> DataFrame:
    """``(cloud_id, loss)`` between descriptors ``(cloud_id, vector)`` of two views of each cloud that has both."""
    both = first.select("cloud_id", F.col("vector").alias("a")).join(second.select("cloud_id", F.col("vector").alias("b")), "cloud_id")
    return both.select("cloud_id", cosine_loss(F.col("a"), F.col("b")).alias("loss"))
