"""Queries on stored descriptors, densities and changed copies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from topospark.operators import augment, metrics, models, prepare
from topospark.plans import pipeline, tables
from topospark.plans.clouds import r6
from topospark.plans.tables import EMBEDDINGS_SQL, EVENTS_SQL

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


@query(f"""WITH {EVENTS_SQL}, v AS (SELECT *, list_transform(coords, lambda x: floor(x / 500)) AS c FROM pts)
SELECT cloud_id, point_id, count(*) OVER (PARTITION BY cloud_id, c) AS density FROM v""")
def voxel_density(spark: SparkSession, folder: str) -> DataFrame:
    return augment.voxel_density(tables.events(spark, folder), 500).select("cloud_id", "point_id", "density")


@query(f"""WITH {EVENTS_SQL}, v AS (SELECT *, list_transform(coords, lambda x: floor(x / 500)) AS c FROM pts),
d AS (SELECT cloud_id, point_id, count(*) OVER (PARTITION BY cloud_id, c) AS n, md5('9:' || point_id) AS h FROM v)
SELECT cloud_id, point_id FROM d QUALIFY row_number() OVER (PARTITION BY cloud_id
  ORDER BY round(-ln((CAST('0x' || substr(h, 1, 8) AS UBIGINT) + 0.5::DOUBLE) / 4294967296.0::DOUBLE) * n, 9), h, point_id) <= 25""")
def hybrid_thinning(spark: SparkSession, folder: str) -> DataFrame:
    return augment.hybrid_thinning(tables.events(spark, folder), 25, 500, 9).select("cloud_id", "point_id")


@query("""WITH q AS (
  SELECT quantile_cont(betti_1, [0.2, 0.4, 0.6, 0.8]) AS a, quantile_cont(coverage_mean, [0.25, 0.5, 0.75]) AS b FROM tda_features),
rows_ AS (SELECT seq, frame, chunk_no, received_at, len(list_filter(a, lambda x: x < betti_1)) AS stratum_a, len(list_filter(b, lambda x: x < coverage_mean)) AS stratum_b FROM tda_features, q)
SELECT CASE WHEN betti_1 IS NOT NULL THEN CAST(stratum_a AS INTEGER) END AS stratum_a, CASE WHEN coverage_mean IS NOT NULL THEN CAST(stratum_b AS INTEGER) END AS stratum_b,
  greatest(1, count(*) // 20) AS n
FROM (SELECT betti_1, coverage_mean, len(list_filter(a, lambda x: x < betti_1)) AS stratum_a, len(list_filter(b, lambda x: x < coverage_mean)) AS stratum_b FROM tda_features, q) GROUP BY 1, 2""")
def stratified_sample(spark: SparkSession, folder: str) -> DataFrame:
    rows = augment.stratified_sample(tables.read(spark, folder, "tda_features"), "betti_1", "coverage_mean", ["seq", "frame", "chunk_no"], 3)
    return rows.groupBy("stratum_a", "stratum_b").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {EMBEDDINGS_SQL}, few AS (SELECT *, row_number() OVER (PARTITION BY cloud_id ORDER BY md5('8:' || point_id), point_id) AS r, count(*) OVER (PARTITION BY cloud_id) AS n FROM pts)
SELECT cloud_id, CAST(sum(CASE WHEN r <= 64 THEN greatest(1, CAST(floor((64 - r) / n) AS INTEGER) + 1) END) AS BIGINT) AS n FROM few GROUP BY cloud_id""")
def pad_or_sample(spark: SparkSession, folder: str) -> DataFrame:
    return prepare.pad_or_sample(tables.embeddings(spark, folder), 64, 8).groupBy("cloud_id").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {EMBEDDINGS_SQL}, mean AS (SELECT cloud_id, axis, avg(x) AS m FROM (SELECT cloud_id, unnest(coords) AS x, unnest(range(64)) AS axis FROM pts) GROUP BY ALL),
centre AS (SELECT cloud_id, list(m ORDER BY axis) AS c FROM mean GROUP BY cloud_id)
SELECT cloud_id, round(avg(1 - list_dot_product(coords, c) / (sqrt(list_dot_product(coords, coords)) * sqrt(list_dot_product(c, c)) + 1e-12)), 6) AS loss
FROM pts JOIN centre USING (cloud_id) GROUP BY cloud_id""")
def distillation_loss(spark: SparkSession, folder: str) -> DataFrame:
    """Cosine loss of every vector against the mean of its label."""
    pts = tables.embeddings(spark, folder)
    means = pts.select("cloud_id", F.posexplode("coords").alias("axis", "x")).groupBy("cloud_id", "axis").agg(F.avg("x").alias("m"))
    centre = means.groupBy("cloud_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("axis", "m"))), lambda s: s["m"]).alias("c"))
    return pts.join(centre, "cloud_id").groupBy("cloud_id").agg(F.round(F.avg(augment.cosine_loss(F.col("coords"), F.col("c"))), 6).alias("loss"))


@query(f"""WITH {EVENTS_SQL}, n AS (SELECT cloud_id, sum(x * x) AS s FROM (SELECT cloud_id, point_id, unnest(coords) AS x FROM pts) GROUP BY cloud_id)
SELECT cloud_id, round(s / 1e6, 4) AS energy FROM n""")
def rotated_energy(spark: SparkSession, folder: str) -> DataFrame:
    """Turning a cloud around the vertical keeps the sum of its squared lengths."""
    turned = augment.rotate_z(tables.events(spark, folder), 5)
    squares = F.aggregate("coords", F.lit(0.0), lambda s, x: s + x * x)
    return turned.groupBy("cloud_id").agg(F.round(F.sum(squares) / 1e6, 4).alias("energy"))


@query()
def vector_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    """The named features out of the vectors of all clouds."""
    from topospark.plans.complexes import tda_feature_vector

    found = metrics.features_from_vector(tda_feature_vector(spark, folder))
    return found.select("cloud_id", "n_points", "n_landmarks", "betti_0", "betti_1", "betti_2", r6("coverage_mean"))


DRAWN = "(CAST('0x' || substr(md5('{seed}:' || cloud_id || ':' || point_id), 1, 8) AS UBIGINT) + 0.5::DOUBLE) / 4294967296.0::DOUBLE"


@query(f"""WITH {EVENTS_SQL}
SELECT cloud_id, point_id, round(coords[3] + 0.05 * sqrt(-2 * ln({DRAWN.format(seed=4)})) * cos(2 * pi() * {DRAWN.format(seed=5)}), 6) AS height FROM pts""")
def ground_noise(spark: SparkSession, folder: str) -> DataFrame:
    rows = augment.ground_noise(tables.events(spark, folder), 0.05, 4)
    return rows.select("cloud_id", "point_id", F.round(F.element_at("coords", 3), 6).alias("height"))


@query(f"""WITH {EVENTS_SQL}
SELECT cloud_id, point_id FROM pts WHERE round({DRAWN.format(seed=6)} - 0.8 - 0.2 * exp(-sqrt(list_sum(list_transform(coords, lambda x: x * x))) / 40000), 12) < 0""")
def thin_by_distance(spark: SparkSession, folder: str) -> DataFrame:
    return augment.thin_by_distance(tables.events(spark, folder), 0.8, 40000, 6).select("cloud_id", "point_id")


@query(f"""WITH {EMBEDDINGS_SQL}, mean AS (SELECT cloud_id, point_id % 2 AS side, axis, avg(x) AS m FROM (SELECT cloud_id, point_id, unnest(coords) AS x, unnest(range(64)) AS axis FROM pts) GROUP BY ALL),
view AS (SELECT cloud_id, side, list(m ORDER BY axis) AS v FROM mean GROUP BY cloud_id, side)
SELECT a.cloud_id, round(1 - list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v)) + 1e-12), 6) AS loss
FROM view a JOIN view b ON a.cloud_id = b.cloud_id AND a.side = 0 AND b.side = 1""")
def cross_view(spark: SparkSession, folder: str) -> DataFrame:
    """The mean vectors of the even and the odd points of a cloud as its two views."""
    axes = tables.embeddings(spark, folder).select("cloud_id", (F.col("point_id") % 2).alias("side"), F.posexplode("coords").alias("axis", "x"))
    means = axes.groupBy("cloud_id", "side", "axis").agg(F.avg("x").alias("m")).groupBy("cloud_id", "side")
    views = means.agg(F.transform(F.sort_array(F.collect_list(F.struct("axis", "m"))), lambda a: a["m"]).alias("vector"))
    loss = augment.cross_view_loss(views.where("side = 0"), views.where("side = 1"))
    return loss.select("cloud_id", r6("loss"))


def _scans(spark: SparkSession, folder: str) -> DataFrame:
    df = tables.read(spark, folder, "cloud_points")
    whole = (F.size("coords") == 3) & F.forall("coords", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return df.where(whole).select("cloud_id", "point_id", "coords", F.lit(1.0).alias("intensity"))


@query()
def student_features(spark: SparkSession, folder: str) -> DataFrame:
    """Descriptors of all scans by an untrained student network."""
    return models.student_descriptors(_scans(spark, folder), models.student_network("lite")).select("cloud_id", F.transform("vector", lambda x: F.round(x, 6)).alias("vector"))


@query()
def recurrent_poses(spark: SparkSession, folder: str) -> DataFrame:
    """Poses along all sequences by an untrained recurrent network, from the numbers of each frame."""
    names = ["betti_0", "betti_1", "betti_2", "coverage_mean", "coverage_p95"]
    df = tables.read(spark, folder, "tda_features").where("seq is not null and frame is not null")
    frames = df.groupBy("seq", "frame").agg(F.array(*[F.coalesce(F.avg(F.nanvl(F.col(c).cast("double"), F.lit(0.0))), F.lit(0.0)) for c in names]).alias("x"))
    poses = models.predict_sequences(frames, models.recurrent(len(names), 16, 2))
    return poses.select("seq", "frame", F.transform("translation", lambda x: F.round(x, 6)).alias("translation"), F.transform("quaternion", lambda x: F.round(x, 6)).alias("quaternion"))


@query()
def frame_diagnostics(spark: SparkSession, folder: str) -> DataFrame:
    """Scans as the frames of one sequence a number of points: descriptors, scores and where the teacher steps in."""
    frames = _scans(spark, folder).select((F.col("cloud_id") % 4).cast("int").alias("seq"), F.col("cloud_id").cast("int").alias("frame"), "point_id", "coords", "intensity")
    rows = pipeline.diagnostics(frames, m=32, k=6, dim=3, seed=5, student=models.student_network("lite"))
    return rows.select("seq", "frame", "used_teacher", "fallback_count", *[F.round(c, 5).alias(c) for c in ("sheaf_score", "variance_score", "signal_strength", "topo_density")])
