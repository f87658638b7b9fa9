"""The experiment as one plan: clouds x methods to result rows."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topospark.functions.stretches import looking_back, running_sum
from topospark.operators import knn, landmarks, metrics, models, persistence, prepare, temporal, witness
from topospark.session import cut_lineage
from topospark.sources.sinks import combine

PRESETS = {
    "standard": {"mask": 97.5, "k": 8, "max_dim": 2, "softclip": None, "thin": None, "rips_points": 400},
    "fast": {"mask": 99.0, "k": 4, "max_dim": 1, "softclip": 99.5, "thin": 0.5, "rips_points": 0},
}
MODES = {"fast": {"max_dim": 1, "m": 128, "k": 64}, "regular": {"max_dim": 2, "m": 256, "k": 128}}
MODES["auto"] = MODES["fast"]
WIDTH = 51  # slots of a feature vector
OTHERS = 15  # nearest others that the density methods look at
MAX_WITNESSES = 10_000
BETWEEN = "\1"


def by_method(cloud: Column, method: Column) -> Column:
    """The key of a cloud under one of several methods."""
    return F.concat(cloud.cast("string"), F.lit(BETWEEN), method)


def run(
    points: DataFrame, methods: list[str], m: int, dim: int, k: int, max_dim: int, radius: float | DataFrame, seed: int, rips_points: int = 0, rips_percentile: float = 90.0,
    seed_step: int = 17, max_witnesses: int | None = MAX_WITNESSES, alpha: float = 0.5, selection_c: float = 8,
) -> DataFrame:
    """One row per cloud and method: the columns of a result file but for times.

    Every step after the selection of landmarks handles all clouds under all methods at once, as
    clouds of their own. Bottleneck distances to a Vietoris-Rips reference of ``rips_points``
    sampled points are null without one. The radius is one number or a table (cloud_id, radius).
    """
    points = cut_lineage(points.select("cloud_id", "point_id", "coords", "intensity"))  # read by every method and metric
    seeds = {method: seed + seed_step * (i + 1) for i, method in enumerate(methods)}
    near = cut_lineage(knn.nearest(points, points, OTHERS, exclude_self=True)) if {"density", "hybrid"} & set(methods) else None
    picks = [landmarks.select(points, name, m, own, dim, alpha, selection_c, near).withColumn("method", F.lit(name)) for name, own in seeds.items()]
    keyed = lambda df: df.withColumn("cloud_id", by_method(F.col("cloud_id"), F.col("method"))).drop("method")
    each = F.explode(F.array(*map(F.lit, methods))).alias("method")
    marks = cut_lineage(keyed(reduce(DataFrame.unionByName, picks)))
    copies = cut_lineage(keyed(points.select("*", each)))
    box = prepare.bounds(points).select("cloud_id", "diameter", F.col("n").alias("total_points"))
    box = cut_lineage(box.join(radius, "cloud_id") if isinstance(radius, DataFrame) else box.withColumn("radius", F.lit(float(radius))))
    runs = box.select(F.col("cloud_id").alias("dataset"), "diameter", "total_points", F.col("radius").alias("coverage_radius"), each)
    runs = runs.withColumn("cloud_id", by_method(F.col("dataset"), F.col("method")))
    lists = cut_lineage(knn.nearest(copies, metrics.landmark_points(copies, marks), k, target_bound=m))
    seen = lists
    if max_witnesses is not None and not box.where(F.col("total_points") > max_witnesses).isEmpty():
        some = prepare.sample(points, max_witnesses, witness.WITNESS_SEED).select("cloud_id", "point_id", each)
        seen = lists.join(keyed(some), ["cloud_id", "point_id"], "left_semi")
    bars = persistence.diagrams(witness.complex_of(seen, max_dim), "unpaired")
    row = runs.join(metrics.coverage(copies, marks, runs.select("cloud_id", F.col("coverage_radius").alias("radius")), m, lists), "cloud_id").join(metrics.landmark_intensity(copies, marks), "cloud_id")
    if rips_points:
        reference = persistence.diagrams(persistence.rips_complex(points, rips_points, rips_percentile, seed + 31, max_dim), "unpaired")
        row = row.join(bottleneck_columns(bars, keyed(reference.select("*", each)), max_dim), "cloud_id", "left")
    else:
        row = row.select("*", *[F.lit(None).cast("double").alias(f"bottleneck_b{d}") for d in range(max_dim + 1)])
    own = F.element_at(F.create_map(*[F.lit(x) for pair in seeds.items() for x in pair]), F.col("method"))
    table = row.drop("cloud_id").withColumn("seed", own).withColumn("m", F.lit(m))
    return table.select(*sorted(table.columns))


def suite(cases: list[dict], clouds: Callable[[dict], DataFrame]) -> DataFrame:
    """Rows of all cases of a suite, labelled by case; ``clouds`` gives the points of one, before normalisation.

    A case without a radius takes it from the diameter of the cloud before normalisation.
    """
    runs = {}
    for i, case in enumerate(cases, start=1):
        case = CASE | {k: v for k, v in case.items() if v is not None}
        raw = cut_lineage(clouds(case).select("cloud_id", "point_id", "coords", "intensity"))
        radius = prepare.bounds(raw).select("cloud_id", metrics.suite_radius(F.col("diameter")).alias("radius")) if case["coverage_radius"] is None else case["coverage_radius"]
        points = prepare.shift_intensity(prepare.normalise_minmax(raw))
        if case["max_points"]:
            points = prepare.weighted_sample(points, case["max_points"], case["seed"] + 17)
        methods = [x.strip() for x in case["methods"].split(",") if x.strip()]
        rows = run(
            points, methods, case["m"], case["dim"], case["k_witness"], case["max_dim"], radius, case["seed"], case["rips_points"], case["rips_percentile"],
            seed_step=101, alpha=case["hybrid_alpha"], selection_c=case["selection_c"],
        )
        if case["dataset_label"]:
            rows = rows.withColumn("dataset", F.lit(case["dataset_label"]))
        runs[case["output"] or f"pointcloud_case_{i}.csv"] = rows.withColumn("dataset", F.col("dataset").cast("string"))
    return combine(runs)


# What a case of a suite takes where it says nothing.
CASE = {
    "builtin": None, "input": None, "format": None, "samples": 5000, "max_points": 5000, "m": 400, "methods": "hybrid", "selection_c": 3, "hybrid_alpha": 0.4,
    "k_witness": 4, "max_dim": 1, "rips_points": 0, "rips_percentile": 80.0, "coverage_radius": None, "dataset_label": None, "seed": 0, "output": None, "dim": 3,
}


def bottleneck_columns(bars: DataFrame, reference: DataFrame, max_dim: int) -> DataFrame:
    """Distances of each dimension as columns; NaN where none, infinity where classes that never die differ in number."""
    distances = persistence.bottleneck_distances(bars, reference)
    return distances.groupBy("cloud_id").agg(*[F.max(F.when(F.col("dim") == d, F.col("bottleneck"))).alias(f"bottleneck_b{d}") for d in range(max_dim + 1)])


def volume_run(voxels: DataFrame, affine: list[list[float]] | None, methods: list[str], preset: str, m: int, max_points: int, radius: float, seed: int, rips_points: int | None = None) -> DataFrame:
    """The volume experiment under a preset: mask, place, sample, then soften and thin where the preset says so."""
    p = PRESETS[preset]
    points = prepare.volume_to_cloud(voxels, affine, p["mask"], max_points, seed)
    if p["softclip"]:
        points = cut_lineage(prepare.soften_intensity(points, p["softclip"]))
    if p["thin"]:
        points = prepare.thin(points, p["thin"], seed + 101)
    return run(points, methods, m, 3, p["k"], p["max_dim"], radius, seed, p["rips_points"] if rips_points is None else rips_points)


def diagnostics(points: DataFrame, m: int, k: int, dim: int, seed: int, window: int = 5, student: dict | None = None) -> DataFrame:
    """Frames ``(seq, frame, point_id, coords, intensity)`` to descriptors with their scores by frame.

    Each frame is a cloud of its own and all are described at once, by witness features or by a
    student network; where the student's descriptor is weak or inconsistent the witness features
    take its place (``used_teacher``), and scores are those of the descriptors so chosen.
    """
    frame = F.struct("seq", "frame")
    cloud = points.select(F.to_json(frame).alias("cloud_id"), "seq", "frame", "point_id", "coords", "intensity")
    cloud = cut_lineage(cloud)
    names = cloud.select("cloud_id", "seq", "frame").distinct()
    marks = cut_lineage(landmarks.select(cloud, "random", m, seed, dim))
    lists = cut_lineage(knn.nearest(cloud, metrics.landmark_points(cloud, marks), k, target_bound=m))
    bars = persistence.diagrams(witness.complex_of(lists))
    teacher = names.join(metrics.feature_vector(cloud, marks, bars, k, m, lists).withColumnRenamed("vector", "vec"), "cloud_id")
    score = lambda rows: temporal.topological_signal(temporal.variance_and_snr(temporal.sheaf_score(rows, ["frame"], window), ["frame"], WIDTH, window))
    if student is None:
        return temporal.fallback(score(cut_lineage(teacher.drop("cloud_id"))), ["frame"])
    own = names.join(models.student_descriptors(cloud, student).withColumnRenamed("vector", "vec"), "cloud_id")
    flags = temporal.fallback(score(cut_lineage(own)), ["frame"]).select("cloud_id", "used_teacher", "fallback_count")
    chosen = own.join(flags, "cloud_id").join(teacher.select("cloud_id", F.col("vec").alias("taught")), "cloud_id")
    chosen = chosen.withColumn("vec", F.when(F.col("used_teacher") == 1, F.col("taught").cast("array<double>")).otherwise(F.col("vec")))
    return score(cut_lineage(chosen.drop("cloud_id", "taught")))


def embedding_summaries(points: DataFrame, mode: str, method: str, dim: int, seed: int, radius: float | None = None) -> DataFrame:
    """Summaries of clouds of embeddings under a mode; the radius defaults to that of a normalised cloud's diameter, 1."""
    p = MODES[mode]
    cloud = cut_lineage(prepare.normalise_isotropic(points))
    marks = cut_lineage(landmarks.select(cloud, method, p["m"], seed, dim))
    bars = persistence.diagrams(witness.witness_complex(cloud, marks, min(p["k"], p["m"]), p["max_dim"], landmark_bound=p["m"]))
    return metrics.summary(cloud, marks, bars, 0.05 if radius is None else radius, p["max_dim"])


def pair_index(frames: DataFrame, stride: int = 1) -> DataFrame:
    """Pairs ``(seq, frame_t, frame_t1)`` of every ``stride``-th frame and the one ``stride`` frames on."""
    numbered = running_sum(frames.select("seq", "frame").withColumn("__one", F.lit(1)), "seq", ["frame"], "__one", "place")
    back = lambda rows, w: rows.withColumn("frame_t", F.lag("frame", stride).over(w)).withColumn("from", F.lag("place", stride).over(w) - 1)
    rows = looking_back(numbered, "seq", ["frame"], stride, back)
    return rows.where((F.col("from") % stride == 0) & F.col("frame").isNotNull()).select("seq", "frame_t", F.col("frame").alias("frame_t1"))
