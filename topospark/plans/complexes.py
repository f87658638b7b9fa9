"""Queries on complexes, diagrams and summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from topospark.operators import knn, landmarks, metrics, persistence, prepare, witness
from topospark.plans import pipeline, tables
from topospark.plans.clouds import LANDMARKS_SQL, NEAR_SQL, SEED, M, r6
from topospark.plans.clouds import ORACLE_SQL as CLOUD_ORACLES
from topospark.plans.tables import EMBEDDINGS_SQL
from topospark.session import cut_lineage

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
K = 8


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _complex(spark: SparkSession, folder: str, m: int = M, k: int = K, **options) -> DataFrame:
    pts = tables.embeddings(spark, folder)
    return witness.witness_complex(pts, landmarks.random(pts, m, SEED), k, landmark_bound=m, **options)


EDGES_SQL = f"""WITH {EMBEDDINGS_SQL}, {LANDMARKS_SQL}, {NEAR_SQL}, near AS (SELECT * FROM nn WHERE rank <= {K}),
edges AS (
  SELECT a.cloud_id, least(a.target_id, b.target_id) AS v0, greatest(a.target_id, b.target_id) AS v1, min(b.dist) AS f
  FROM near a JOIN near b ON a.cloud_id = b.cloud_id AND a.point_id = b.point_id AND a.rank < b.rank GROUP BY ALL)"""


@query(f"{EDGES_SQL} SELECT cloud_id, v0, v1, round(f, 6) AS filtration FROM edges")
def witness_edges(spark: SparkSession, folder: str) -> DataFrame:
    return _complex(spark, folder, max_dim=1).where("dim = 1").select("cloud_id", "v0", "v1", r6("filtration"))


@query(f"""WITH {EMBEDDINGS_SQL}, {LANDMARKS_SQL}, {NEAR_SQL}, near AS (SELECT * FROM nn WHERE rank <= {K}),
found AS (
  SELECT a.cloud_id, list_sort([a.target_id, b.target_id, c.target_id]) AS v, min(c.dist) AS f
  FROM near a JOIN near b ON a.cloud_id = b.cloud_id AND a.point_id = b.point_id AND a.rank < b.rank
  JOIN near c ON c.cloud_id = b.cloud_id AND c.point_id = b.point_id AND b.rank < c.rank GROUP BY ALL)
SELECT cloud_id, v[1] AS v0, v[2] AS v1, v[3] AS v2, round(f, 6) AS filtration FROM found""")
def witness_triangles(spark: SparkSession, folder: str) -> DataFrame:
    return _complex(spark, folder).where("dim = 2").select("cloud_id", "v0", "v1", "v2", r6("filtration"))


@query(f"{EDGES_SQL} SELECT cloud_id, v0, v1, round(f, 6) AS filtration FROM edges WHERE f <= 1.3")
def witness_filtration_cut(spark: SparkSession, folder: str) -> DataFrame:
    return _complex(spark, folder, max_dim=1, max_filtration=1.3).where("dim = 1").select("cloud_id", "v0", "v1", r6("filtration"))


@query(f"""{EDGES_SQL.replace("WITH ", "WITH RECURSIVE ", 1)}, ranked AS (SELECT cloud_id, point_id, rank FROM lm),
labelled AS (SELECT e.cloud_id, a.rank AS i, b.rank AS j, e.f, row_number() OVER (PARTITION BY e.cloud_id ORDER BY e.f, e.v0, e.v1) AS o FROM edges e JOIN ranked a ON a.cloud_id = e.cloud_id AND a.point_id = e.v0 JOIN ranked b ON b.cloud_id = e.cloud_id AND b.point_id = e.v1),
start AS (
  SELECT a.cloud_id, a.rank AS i, b.rank AS j, CASE WHEN a.rank = b.rank THEN 0 ELSE coalesce(min(l.o), 1000000000) END AS w
  FROM ranked a JOIN ranked b ON a.cloud_id = b.cloud_id
  LEFT JOIN labelled l ON l.cloud_id = a.cloud_id AND least(l.i, l.j) = least(a.rank, b.rank) AND greatest(l.i, l.j) = greatest(a.rank, b.rank) AND a.rank <> b.rank
  GROUP BY a.cloud_id, a.rank, b.rank),
paths AS (
  SELECT 0 AS k, * FROM start UNION ALL
  SELECT s.k + 1, s.cloud_id, s.i, s.j, least(s.w, greatest(x.w, y.w)) FROM paths s
  JOIN paths x ON x.cloud_id = s.cloud_id AND x.i = s.i AND x.j = s.k JOIN paths y ON y.cloud_id = s.cloud_id AND y.i = s.k AND y.j = s.j WHERE s.k < {M})
SELECT p.cloud_id, round(l.f, 6) AS death FROM paths p JOIN start s ON s.cloud_id = p.cloud_id AND s.i = p.i AND s.j = p.j
JOIN labelled l ON l.cloud_id = p.cloud_id AND l.o = p.w
WHERE p.k = {M} AND p.i < p.j AND p.w = s.w AND p.w < 1000000000""")
def persistence_h0(spark: SparkSession, folder: str) -> DataFrame:
    bars = persistence.diagrams(_complex(spark, folder, max_dim=1), "unpaired")
    return bars.where((F.col("dim") == 0) & (F.col("death") < float("inf"))).select("cloud_id", r6("death"))


@query("""SELECT label AS cloud_id, CAST(d AS INTEGER) AS dim, CAST([7, 21, 0][d + 1] AS BIGINT) AS finite, CAST([8, 21, 35][d + 1] AS BIGINT) AS endless
FROM (SELECT DISTINCT label FROM embeddings), range(3) t(d)""")
def persistence_counts(spark: SparkSession, folder: str) -> DataFrame:
    """With as many neighbours as landmarks the complex is full, and the counts do not depend on the data."""
    bars = persistence.diagrams(_complex(spark, folder, m=8, k=8))
    endless = F.col("death") == float("inf")
    return bars.groupBy("cloud_id", "dim").agg(F.sum((~endless).cast("bigint")).alias("finite"), F.sum(endless.cast("bigint")).alias("endless"))


@query()
def persistence_full(spark: SparkSession, folder: str) -> DataFrame:
    bars = persistence.diagrams(_complex(spark, folder), "unpaired")
    return bars.select("cloud_id", "dim", r6("birth"), F.when(F.col("death") < float("inf"), F.round("death", 6)).alias("death"))


@query()
def diagram_stats(spark: SparkSession, folder: str) -> DataFrame:
    pts = tables.embeddings(spark, folder)
    stats = metrics.diagram_statistics(persistence.diagrams(_complex(spark, folder)), pts, 2)
    return stats.select("cloud_id", "dim", "count", *[r6(c) for c in stats.columns[3:]])


def _vectors(spark: SparkSession, folder: str) -> DataFrame:
    pts = cut_lineage(tables.embeddings(spark, folder))
    marks = cut_lineage(landmarks.random(pts, M, SEED))
    near = cut_lineage(knn.nearest(pts, metrics.landmark_points(pts, marks), K, target_bound=M))
    return metrics.feature_vector(pts, marks, persistence.diagrams(witness.complex_of(near)), K, M, near)


@query()
def tda_feature_vector(spark: SparkSession, folder: str) -> DataFrame:
    return _vectors(spark, folder)


@query(f"""WITH geometry AS ({CLOUD_ORACLES["landmark_geometry"]}), witnesses AS ({CLOUD_ORACLES["witness_spread"]}), one AS ({CLOUD_ORACLES["nn1_coverage"]}),
cover AS (SELECT cloud_id, avg(dist) AS a, stddev_pop(dist) AS s, quantile_cont(dist, 0.95) AS p, count(*) AS n FROM one GROUP BY cloud_id)
SELECT cloud_id, round(a, 3) AS coverage_mean, round(s, 3) AS coverage_std, round(p, 3) AS coverage_p95, CAST(1 AS DOUBLE) AS coverage_ratio, round(density_mean, 3) AS density_mean, round(density_std, 3) AS density_std,
  round(spacing_mean, 3) AS spacing_mean, round(spacing_std, 3) AS spacing_std, round(witness_mean, 3) AS witness_mean, round(witness_std, 3) AS witness_std, round(log10(n + 1), 3) AS log_n, CAST({M} AS DOUBLE) AS m
FROM geometry JOIN witnesses USING (cloud_id) JOIN cover USING (cloud_id)""")
def feature_slots(spark: SparkSession, folder: str) -> DataFrame:
    """The slots of the feature vector behind the lifetimes and counts."""
    names = ["coverage_mean", "coverage_std", "coverage_p95", "coverage_ratio", "density_mean", "density_std", "spacing_mean", "spacing_std", "witness_mean", "witness_std", "log_n", "m"]
    return _vectors(spark, folder).select("cloud_id", *[F.round(F.element_at("vector", 40 + i).cast("double"), 3).alias(n) for i, n in enumerate(names)])


@query(f"""WITH lives AS ({ORACLE_SQL["persistence_h0"]})
SELECT cloud_id, count(*) AS finite, round(max(death), 4) AS max_persistence, round(avg(death), 4) AS mean_persistence, round(stddev_pop(death), 4) AS std_persistence, round(sum(death), 4) AS total_persistence
FROM lives GROUP BY cloud_id""")
def diagram_stats_h0(spark: SparkSession, folder: str) -> DataFrame:
    """Statistics of the classes of dimension 0 that die; the one that never does is no lifetime."""
    bars = persistence.diagrams(_complex(spark, folder, max_dim=1), "unpaired").where("dim = 0 and death < double('infinity')")
    bars = bars.withColumn("death", F.round("death", 6))
    stats = metrics.diagram_statistics(bars, tables.embeddings(spark, folder), 0)
    return stats.select("cloud_id", F.col("count").alias("finite"), *[F.round(c, 4).alias(c) for c in stats.columns[3:]])


@query()
def witness_summary(spark: SparkSession, folder: str) -> DataFrame:
    pts = cut_lineage(prepare.normalise_isotropic(tables.embeddings(spark, folder)))
    marks = cut_lineage(landmarks.random(pts, M, SEED))
    bars = persistence.diagrams(witness.witness_complex(pts, marks, K, 1, landmark_bound=M))
    summary = metrics.summary(pts, marks, bars, 0.2, 1)
    return summary.select("cloud_id", F.explode("summary").alias("key", "value")).select("cloud_id", "key", r6("value"))


SAMPLE_SQL = """some AS (SELECT * FROM pts QUALIFY row_number() OVER (PARTITION BY cloud_id ORDER BY md5('31:' || point_id), point_id) <= 40)"""
RIPS_SQL = f"""WITH {EMBEDDINGS_SQL}, {SAMPLE_SQL.replace("some", "few", 1)},
pairs AS (SELECT a.cloud_id, a.point_id AS a, b.point_id AS b, list_distance(a.coords, b.coords) AS d FROM few a JOIN few b ON a.cloud_id = b.cloud_id AND a.point_id < b.point_id),
cut AS (SELECT cloud_id, quantile_cont(d, 0.4) AS edge FROM pairs GROUP BY cloud_id)"""


@query(f"{RIPS_SQL} SELECT cloud_id, a, b, round(d, 6) AS dist FROM pairs JOIN cut USING (cloud_id) WHERE d <= edge")
def rips_edges(spark: SparkSession, folder: str) -> DataFrame:
    return persistence.rips_edges(tables.embeddings(spark, folder), 40, 40, 31).select("cloud_id", "a", "b", r6("dist"))


@query(f"{RIPS_SQL} SELECT cloud_id, round(edge, 6) AS max_edge FROM cut")
def rips_max_edge(spark: SparkSession, folder: str) -> DataFrame:
    edges = persistence.rips_edges(tables.embeddings(spark, folder), 40, 40, 31)
    return edges.groupBy("cloud_id").agg(F.round(F.max("max_edge"), 6).alias("max_edge"))


@query(f"""{RIPS_SQL}, e AS (SELECT p.cloud_id, a, b, d FROM pairs p JOIN cut USING (cloud_id) WHERE d <= edge)
SELECT x.cloud_id, count(*) AS triangles, round(avg(greatest(x.d, y.d, z.d)), 6) AS mean_filtration
FROM e x JOIN e y ON x.cloud_id = y.cloud_id AND x.b = y.a JOIN e z ON z.cloud_id = x.cloud_id AND z.a = x.a AND z.b = y.b GROUP BY x.cloud_id""")
def rips_triangles(spark: SparkSession, folder: str) -> DataFrame:
    found = persistence.rips_complex(tables.embeddings(spark, folder), 40, 40, 31).where("dim = 2")
    return found.groupBy("cloud_id").agg(F.count(F.lit(1)).alias("triangles"), F.round(F.avg("filtration"), 6).alias("mean_filtration"))


@query()
def bottleneck(spark: SparkSession, folder: str) -> DataFrame:
    reference = persistence.diagrams(persistence.rips_complex(tables.embeddings(spark, folder), 40, 40, 31, 1), "unpaired")
    found = persistence.diagrams(_complex(spark, folder, max_dim=1), "unpaired")
    distances = persistence.bottleneck_distances(found, reference)
    return distances.select("cloud_id", "dim", F.when(F.col("bottleneck") < float("inf"), F.round("bottleneck", 6)).alias("bottleneck"))


@query()
def benchmark_rows(spark: SparkSession, folder: str) -> DataFrame:
    return pipeline.run(tables.embeddings(spark, folder), ["random", "density", "hybrid"], m=64, dim=64, k=8, max_dim=1, radius=0.9, seed=42, rips_points=400)


def _scans(spark: SparkSession, folder: str) -> DataFrame:
    """The three-dimensional clouds of scans."""
    df = tables.read(spark, folder, "cloud_points")
    whole = (F.size("coords") == 3) & F.forall("coords", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    fair = F.when((F.col("intensity") >= 0) & (F.col("intensity") < float("inf")), F.col("intensity")).otherwise(0.0)
    return df.where(whole & F.col("point_id").isNotNull()).groupBy("cloud_id", "point_id").agg(F.min("coords").alias("coords"), F.min(fair).alias("intensity"))


@query(f"""WITH cover AS ({CLOUD_ORACLES["coverage_metrics"].replace("'17:'", "'59:'").replace("rank < 16", "rank < 64")}), bright AS ({CLOUD_ORACLES["landmark_intensity"].replace("'17:'", "'59:'").replace("rank < 16", "rank < 64")})
SELECT cloud_id AS dataset, 'random' AS method, cover.* EXCLUDE (cloud_id), bright.* EXCLUDE (cloud_id) FROM cover JOIN bright USING (cloud_id)""")
def benchmark_coverage(spark: SparkSession, folder: str) -> DataFrame:
    """The columns of result rows that SQL can work out, of one method."""
    rows = pipeline.run(tables.embeddings(spark, folder), ["random"], m=64, dim=64, k=4, max_dim=1, radius=0.9, seed=42)
    names = [c for c in rows.columns if (c.startswith("coverage_") and c != "coverage_radius") or c.startswith("landmark_")]
    return rows.select("dataset", "method", *[r6(c) for c in names])


@query()
def lidar_rows(spark: SparkSession, folder: str) -> DataFrame:
    """The suite on the clouds of scans, with the landmark methods made for them."""
    return pipeline.run(_scans(spark, folder), ["lidar", "quantum", "grid"], m=128, dim=3, k=8, max_dim=1, radius=1.0, seed=42, rips_points=200)


@query()
def suite_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Two cases of a suite over the same scans, with radii from their diameters."""
    cases = [{"methods": "hybrid", "m": 64, "max_points": 500, "output": "hybrid"}, {"methods": "grid,random", "m": 32, "max_dim": 2, "k_witness": 6, "output": "others"}]
    return pipeline.suite(cases, lambda case: _scans(spark, folder))


@query(f"""WITH {EMBEDDINGS_SQL}, {LANDMARKS_SQL}, drawn AS (
  SELECT * FROM pts QUALIFY row_number() OVER (PARTITION BY cloud_id ORDER BY md5('42:' || point_id), point_id) <= 20),
nn AS (
  SELECT p.cloud_id, p.point_id, l.point_id AS target_id, list_distance(p.coords, l.coords) AS dist,
    row_number() OVER (PARTITION BY p.cloud_id, p.point_id ORDER BY list_distance(p.coords, l.coords), l.point_id) AS place
  FROM drawn p JOIN lm l ON p.cloud_id = l.cloud_id QUALIFY place <= {K})
SELECT a.cloud_id, least(a.target_id, b.target_id) AS v0, greatest(a.target_id, b.target_id) AS v1, round(min(b.dist), 6) AS filtration
FROM nn a JOIN nn b ON a.cloud_id = b.cloud_id AND a.point_id = b.point_id AND a.place < b.place GROUP BY ALL""")
def witness_subsample(spark: SparkSession, folder: str) -> DataFrame:
    return _complex(spark, folder, max_dim=1, max_witnesses=20).where("dim = 1").select("cloud_id", "v0", "v1", r6("filtration"))


@query(f"""WITH {EMBEDDINGS_SQL}, axes AS (SELECT cloud_id, unnest(coords) AS x, unnest(range(len(coords))) AS axis FROM pts),
span AS (SELECT cloud_id, axis, max(x) - min(x) AS s FROM axes GROUP BY ALL)
SELECT cloud_id, round(CASE WHEN sum(s * s) > 0 THEN 0.08 * sqrt(sum(s * s)) ELSE 0.08 END, 6) AS radius FROM span GROUP BY cloud_id""")
def suite_radius(spark: SparkSession, folder: str) -> DataFrame:
    box = prepare.bounds(tables.embeddings(spark, folder))
    return box.select("cloud_id", F.round(metrics.suite_radius(F.col("diameter")), 6).alias("radius"))


AFFINE = [[1.0, 0, 0, 0], [0, 4.0, 0, 0], [0, 0, 5.0, 0]]


def _voxels(spark: SparkSession, folder: str) -> DataFrame:
    """Counts of order lines by quantity, discount and tax as a volume."""
    i, j, k = F.col("l_quantity").cast("int"), F.rint(F.col("l_discount") * 100).cast("int"), F.rint(F.col("l_tax") * 100).cast("int")
    voxels = tables.read(spark, folder, "lineitem").groupBy(F.array(i, j, k).alias("ijk")).agg(F.count(F.lit(1)).cast("double").alias("value"))
    at = lambda n: F.get("ijk", F.lit(n))
    return voxels.select(F.lit("lines").alias("cloud_id"), ((at(0) * 100 + at(1)) * 100 + at(2)).cast("bigint").alias("voxel_id"), "ijk", "value")


@query("""WITH v AS (SELECT CAST(l_quantity AS INTEGER) AS i, CAST(round(l_discount * 100) AS INTEGER) AS j, CAST(round(l_tax * 100) AS INTEGER) AS k, CAST(count(*) AS DOUBLE) AS value FROM lineitem GROUP BY ALL),
cut AS (SELECT quantile_cont(value, 0.9) AS c FROM v), kept AS (SELECT i, 4.0 * j AS y, 5.0 * k AS z, value, CAST((i * 100 + j) * 100 + k AS BIGINT) AS point_id FROM v, cut WHERE value >= c)
SELECT point_id, round((i - min(i) OVER ()) / greatest(max(i) OVER () - min(i) OVER (), 1e-300), 6) AS x, round((y - min(y) OVER ()) / (max(y) OVER () - min(y) OVER ()), 6) AS y,
  round((z - min(z) OVER ()) / (max(z) OVER () - min(z) OVER ()), 6) AS z, round(value - min(value) OVER () + 1e-9, 6) AS intensity FROM kept""")
def volume_cloud(spark: SparkSession, folder: str) -> DataFrame:
    """The volume masked, placed in the world and in the unit box; no more points than may stay, so all do."""
    cloud = prepare.volume_to_cloud(_voxels(spark, folder), AFFINE, 90.0, 100_000, 7)
    return cloud.select("point_id", *[F.round(F.element_at("coords", i + 1), 6).alias(a) for i, a in enumerate("xyz")], r6("intensity"))


@query()
def volume_rows(spark: SparkSession, folder: str) -> DataFrame:
    """The volume experiment under both presets."""
    voxels = _voxels(spark, folder)
    runs = [pipeline.volume_run(voxels, AFFINE, ["random"], preset, 48, 4000, 0.1, 7, rips_points=60).withColumn("preset", F.lit(preset)) for preset in ("standard", "fast")]
    return runs[0].unionByName(runs[1], allowMissingColumns=True)
