"""Coverage, intensity and diagram statistics, and the fixed-length feature vector of a cloud."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from topospark.functions.quantiles import at_ranks, quantiles, spots, with_slots
from topospark.operators import knn, prepare
from topospark.session import cut_lineage

TOP = 10


def landmark_points(points: DataFrame, landmarks: DataFrame) -> DataFrame:
    """The rows of the points that were picked."""
    return points.join(landmarks.select("cloud_id", "point_id"), ["cloud_id", "point_id"], "left_semi")


def nearest_landmark(points: DataFrame, landmarks: DataFrame, landmark_bound: int | None = None) -> DataFrame:
    """``(cloud_id, point_id, landmark_id, dist)`` of the landmark nearest to each point."""
    return first_neighbour(knn.nearest(points, landmark_points(points, landmarks), 1, target_bound=landmark_bound))


def rank_reaching(values: DataFrame, value: str, share: float) -> DataFrame:
    """``(cloud_id, rank)``: where the running sum of the sorted values first exceeds ``share``; sums by bin come first."""
    rows = with_slots(values.select("cloud_id", value), value, ["cloud_id"])
    held = rows.groupBy("cloud_id", "slot").agg(F.sum(value).alias("held"), F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("cloud_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    held = held.withColumn("sum_before", F.coalesce(F.sum("held").over(before), F.lit(0.0))).withColumn("n_before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    crossing = held.where((F.round("sum_before", 12) <= share) & (F.round(F.col("sum_before") + F.col("held"), 12) > share))
    # equal values are one row; of n of them the first that carries the sum over the share is found by division
    alike = rows.join(crossing.drop("held", "n"), ["cloud_id", "slot"]).groupBy("cloud_id", "slot", "sum_before", "n_before", value).agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("cloud_id", "slot").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    part = F.coalesce(F.sum(F.col("n") * F.col(value)).over(earlier), F.lit(0.0))
    alike = alike.withColumn("base", F.col("sum_before") + part).withColumn("place", F.col("n_before") + F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    about = F.when(F.col(value) > 0, F.floor((share - F.col("base")) / F.col(value))).otherwise(F.lit(0))
    low = F.greatest(F.lit(1), F.least(about, F.col("n")))
    past = F.filter(F.sequence(low, F.least(F.col("n"), low + 2)), lambda j: F.round(F.col("base") + j * F.col(value), 12) > share)
    return alike.withColumn("j", F.get(past, 0)).where("j is not null").groupBy("cloud_id").agg(F.min(F.col("place") + F.col("j")).alias("rank"))


def first_neighbour(near: DataFrame) -> DataFrame:
    """The nearest landmark out of lists of nearest landmarks."""
    n = F.element_at("neighbours", 1)
    return near.select("cloud_id", "point_id", n["id"].alias("landmark_id"), n["dist"].alias("dist"))


def coverage(points: DataFrame, landmarks: DataFrame, radius: float | DataFrame, landmark_bound: int | None = None, near: DataFrame | None = None) -> DataFrame:
    """How well landmarks cover a cloud: mean and 95th percentile of distances, shares within a radius, plain and by intensity.

    ``coverage_weighted_p95`` pairs the sorted distances with the sorted weights by rank. A cloud
    without landmarks has no row. The radius is one number or a table ``(cloud_id, radius)``. Lists of nearest landmarks, where they are there, are used again.
    """
    dist = first_neighbour(near) if near is not None else nearest_landmark(points, landmarks, landmark_bound)
    rows = prepare.with_weights(points.select("cloud_id", "point_id", "intensity")).join(dist, ["cloud_id", "point_id"])
    rows = rows.join(radius, "cloud_id") if isinstance(radius, DataFrame) else rows.withColumn("radius", F.lit(float(radius)))
    rows = cut_lineage(rows.select("cloud_id", "dist", "weight", "radius"))  # read by every statistic
    inside = F.col("dist") <= F.col("radius")
    plain = cut_lineage(rows.groupBy("cloud_id").agg(
        F.count("dist").alias("n"),
        F.avg("dist").alias("coverage_mean"),
        F.sum(F.col("dist") * F.col("weight")).alias("coverage_weighted_mean"),
        F.avg(inside.cast("double")).alias("coverage_ratio"),
        F.sum(F.when(inside, F.col("weight")).otherwise(0.0)).alias("coverage_weighted_ratio"),
    ))
    # the ranks of the percentile, and of the weights, are looked up together
    ends = spots(plain.select("cloud_id", "n"), {"coverage_p95": 0.95}, ["cloud_id"])
    reached = rank_reaching(rows, "weight", 0.95).select("cloud_id", F.lit("coverage_weighted_p95").alias("name"), F.col("rank").cast("bigint").alias("rank"), F.lit(1.0).alias("part"))
    found = at_ranks(rows, "dist", ends.unionByName(reached), ["cloud_id"])
    ranked = found.groupBy("cloud_id").agg(*[F.sum(F.when(F.col("name") == name, F.col("part") * F.col("dist"))).alias(name) for name in ("coverage_p95", "coverage_weighted_p95")])
    return plain.drop("n").join(ranked, "cloud_id", "left")


def landmark_intensity(points: DataFrame, landmarks: DataFrame) -> DataFrame:
    """Mean, median and 90th percentile of the intensities at the landmarks."""
    return landmark_points(points, landmarks).groupBy("cloud_id").agg(
        F.avg("intensity").alias("landmark_intensity_mean"),
        F.percentile("intensity", 0.5).alias("landmark_intensity_median"),
        F.percentile("intensity", 0.9).alias("landmark_intensity_p90"),
    )


def hausdorff(points: DataFrame, landmarks: DataFrame) -> DataFrame:
    """The largest distance from a point to its nearest landmark."""
    return nearest_landmark(points, landmarks).groupBy("cloud_id").agg(F.max("dist").alias("hausdorff"))


def spread(points: DataFrame, landmarks: DataFrame, near: DataFrame | None = None) -> DataFrame:
    """Mean, standard deviation and 95th percentile of the distances, and the share of points that have one."""
    dist = first_neighbour(near) if near is not None else nearest_landmark(points, landmarks)
    plain = dist.groupBy("cloud_id").agg(
        F.avg("dist").alias("coverage_mean"), F.stddev_pop("dist").alias("coverage_std"),
        F.avg((F.col("dist") < float("inf")).cast("double")).alias("coverage_ratio"),
    )
    return plain.join(quantiles(dist, "dist", {"coverage_p95": 0.95}, ["cloud_id"]), "cloud_id")


def landmark_geometry(points: DataFrame, landmarks: DataFrame) -> DataFrame:
    """Density and spacing of the landmarks from the distance to the next one; zeros for fewer than two."""
    at = landmark_points(points, landmarks)
    gap = knn.nearest(at, at, 1, exclude_self=True).select("cloud_id", F.element_at("neighbours", 1)["dist"].alias("gap"))
    stats = gap.groupBy("cloud_id").agg(
        F.avg(1 / (F.col("gap") + 1e-12)).alias("density_mean"), F.stddev_pop(1 / (F.col("gap") + 1e-12)).alias("density_std"),
        F.avg("gap").alias("spacing_mean"), F.stddev_pop("gap").alias("spacing_std"),
    )
    return at.select("cloud_id").distinct().join(stats, "cloud_id", "left").fillna(0.0)


def witness_spread(points: DataFrame, landmarks: DataFrame, k: int, near: DataFrame | None = None) -> DataFrame:
    """Mean and standard deviation, over the points, of the mean distance to their ``k`` nearest landmarks."""
    near = near if near is not None else knn.nearest(points, landmark_points(points, landmarks), k)
    mean = F.aggregate("neighbours", F.lit(0.0), lambda s, n: s + n["dist"]) / F.size("neighbours")
    return near.select("cloud_id", mean.alias("mean")).groupBy("cloud_id").agg(F.avg("mean").alias("witness_mean"), F.stddev_pop("mean").alias("witness_std"))


def diagram_statistics(bars: DataFrame, clouds: DataFrame, max_dim: int) -> DataFrame:
    """Per cloud and dimension: bars in all, and over the finite lifetimes maximum, mean, deviation and total; zeros where there are none."""
    life = F.when(F.col("death") < float("inf"), F.greatest(F.lit(0.0), F.col("death") - F.col("birth")))
    stats = bars.withColumn("life", life).groupBy("cloud_id", "dim").agg(
        F.count(F.lit(1)).alias("count"), F.max("life").alias("max_persistence"), F.avg("life").alias("mean_persistence"),
        F.stddev_pop("life").alias("std_persistence"), F.sum("life").alias("total_persistence"),
    )
    grid = clouds.select("cloud_id").distinct().select("cloud_id", F.explode(F.sequence(F.lit(0), F.lit(max_dim))).alias("dim"))
    return grid.join(stats, ["cloud_id", "dim"], "left").fillna(0)


def summary(points: DataFrame, landmarks: DataFrame, bars: DataFrame, radius: float, max_dim: int) -> DataFrame:
    """``(cloud_id, summary map<string, double>)``: coverage, intensity and diagram statistics by name."""
    cover = coverage(points, landmarks, radius).withColumn("coverage_radius", F.lit(float(radius))).join(landmark_intensity(points, landmarks), "cloud_id")
    stats = diagram_statistics(bars, points, max_dim)
    names = ["count", "max_persistence", "mean_persistence", "std_persistence", "total_persistence"]
    entry = F.explode(F.array(*[F.struct(F.concat(F.lit("h"), F.col("dim"), F.lit(f"_{n}")).alias("key"), F.col(n).cast("double").alias("value")) for n in names]))
    per_dim = stats.select("cloud_id", entry.alias("e")).groupBy("cloud_id").agg(F.map_from_entries(F.sort_array(F.collect_list("e"))).alias("diagram"))
    columns = [c for c in cover.columns if c != "cloud_id"]
    flat = F.map_from_arrays(F.array(*map(F.lit, columns)), F.array(*[F.col(c).cast("double") for c in columns]))
    return cover.join(per_dim, "cloud_id").select("cloud_id", F.map_concat(flat, "diagram").alias("summary"))


def suite_radius(diameter: Column) -> Column:
    """The radius of coverage a suite takes where none is given: a part of the diameter before normalisation."""
    return F.when((diameter > 0) & (diameter < float("inf")), 0.08 * diameter).otherwise(0.08)


def to_vector(summaries: DataFrame, keys: list[str]) -> DataFrame:
    """A summary as a vector in the order of ``keys``, 0 where a key is missing."""
    return summaries.select("cloud_id", F.array(*[F.coalesce(F.element_at("summary", k), F.lit(0.0)).cast("float") for k in keys]).alias("vector"))


def lifetime_slots(bars: DataFrame, clouds: DataFrame) -> DataFrame:
    """``(cloud_id, dim, slots array<double>, finite)``: the ten longest finite lifetimes padded with 0, their mean and deviation over all."""
    life = F.greatest(F.lit(0.0), F.col("death") - F.col("birth"))
    finite = bars.where(F.col("death") < float("inf")).withColumn("life", life)
    stats = finite.groupBy("cloud_id", "dim").agg(F.avg("life").alias("mean"), F.stddev_pop("life").alias("std"), F.count(F.lit(1)).alias("finite"))
    rank = F.row_number().over(Window.partitionBy("cloud_id", "dim").orderBy(F.col("life").desc()))
    top = finite.withColumn("rank", rank).where(F.col("rank") <= TOP).groupBy("cloud_id", "dim").agg(F.sort_array(F.collect_list("life"), asc=False).alias("top"))
    grid = clouds.select("cloud_id").distinct().select("cloud_id", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("dim"))
    rows = grid.join(stats, ["cloud_id", "dim"], "left").join(top, ["cloud_id", "dim"], "left").fillna(0, ["mean", "std", "finite"])
    filled = F.slice(F.concat(F.coalesce("top", F.array().cast("array<double>")), F.array_repeat(F.lit(0.0), TOP)), 1, TOP)
    return rows.select("cloud_id", "dim", F.concat(filled, F.array("mean", "std")).alias("slots"), "finite")


def feature_vector(points: DataFrame, landmarks: DataFrame, bars: DataFrame, k: int, m: int, near: DataFrame | None = None) -> DataFrame:
    """``(cloud_id, vector array<float>)`` of 51 slots: lifetimes of three dimensions, counts of finite bars, coverage, geometry, witnesses, size.

    ``near``, the lists of ``k`` nearest landmarks that the complex was made of, is used again if given.
    """
    if near is None:
        near = cut_lineage(knn.nearest(points, landmark_points(points, landmarks), k, target_bound=m))
    slots = lifetime_slots(bars, points)
    by_dim = slots.groupBy("cloud_id").agg(
        F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("dim", "slots"))), lambda s: s["slots"])).alias("lives"),
        F.transform(F.sort_array(F.collect_list(F.struct("dim", "finite"))), lambda s: s["finite"].cast("double")).alias("counts"),
    )
    n = points.groupBy("cloud_id").agg(F.log10(F.count(F.lit(1)) + 1).alias("log_n"))
    rows = by_dim.join(spread(points, landmarks, near), "cloud_id").join(landmark_geometry(points, landmarks), "cloud_id").join(witness_spread(points, landmarks, k, near), "cloud_id").join(n, "cloud_id")
    tail = ["coverage_mean", "coverage_std", "coverage_p95", "coverage_ratio", "density_mean", "density_std", "spacing_mean", "spacing_std", "witness_mean", "witness_std", "log_n"]
    vector = F.concat("lives", "counts", F.array(*tail), F.array(F.lit(float(m))))
    return rows.select("cloud_id", F.transform(vector, lambda x: x.cast("float")).alias("vector"))


def adaptive_radius(diameter: Column) -> Column:
    """Radius of coverage for a cloud of a diameter."""
    return F.when(diameter == 0, 0.05).otherwise(F.least(F.lit(0.2), 0.05 * diameter))


def features_from_vector(vectors: DataFrame, vector: str = "vector") -> DataFrame:
    """A feature vector's slots by name again: lifetimes of each dimension as bars born at 0, counts, coverage, geometry, witnesses, size."""
    at = lambda i: F.element_at(vector, i + 1)
    lives = [F.filter(F.slice(vector, 12 * d + 1, TOP), lambda x: x > 0).alias(f"h{d}_lifetimes") for d in range(3)]
    names = ["betti_0", "betti_1", "betti_2", "coverage_mean", "coverage_std", "coverage_p95", "coverage_ratio", "density_mean", "density_std", "spacing_mean", "spacing_std", "witness_mean", "witness_std"]
    others = [c for c in vectors.columns if c != vector]
    return vectors.select(*others, *lives, *[at(36 + i).alias(n) for i, n in enumerate(names)], F.rint(F.pow(F.lit(10.0), at(49)) - 1).cast("bigint").alias("n_points"), at(50).cast("int").alias("n_landmarks"))
