"""Queries that prepare clouds, join by distance and pick landmarks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from topospark.functions.vectors import distance
from topospark.operators import knn, landmarks, metrics, prepare
from topospark.plans import tables
from topospark.plans.tables import EMBEDDINGS_SQL, EVENTS_SQL, PARTS_SQL

M, SEED = 16, 17
QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

BOX_SQL = """axes AS (SELECT cloud_id, unnest(coords) AS x, unnest(range(len(coords))) AS axis FROM pts),
span AS (SELECT cloud_id, axis, min(x) AS low, max(x) AS high FROM axes GROUP BY ALL),
box AS (SELECT cloud_id, list(low ORDER BY axis) AS low, list(high ORDER BY axis) AS high, list_distance(list(low ORDER BY axis), list(high ORDER BY axis)) AS diameter FROM span GROUP BY cloud_id)"""
LANDMARKS_SQL = f"""lm AS (
  SELECT cloud_id, point_id, coords, intensity, row_number() OVER (PARTITION BY cloud_id ORDER BY md5('{SEED}:' || point_id), point_id) - 1 AS rank
  FROM pts QUALIFY rank < {M})"""
NEAR_SQL = """nn AS (
  SELECT p.cloud_id, p.point_id, l.point_id AS target_id, list_distance(p.coords, l.coords) AS dist,
    row_number() OVER (PARTITION BY p.cloud_id, p.point_id ORDER BY list_distance(p.coords, l.coords), l.point_id) AS rank
  FROM pts p JOIN lm l ON p.cloud_id = l.cloud_id)"""
SELF_SQL = """nn AS (
  SELECT p.cloud_id, p.point_id, l.point_id AS target_id, list_distance(p.coords, l.coords) AS dist,
    row_number() OVER (PARTITION BY p.cloud_id, p.point_id ORDER BY list_distance(p.coords, l.coords), l.point_id) AS rank
  FROM pts p JOIN pts l ON p.cloud_id = l.cloud_id AND p.point_id <> l.point_id)"""


def query(sql: str | None = None):
    """Registers a query, and its oracle if there is one."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def r6(c: str, alias: str | None = None):
    """A column rounded for comparison; no negative zero."""
    return (F.round(c, 6) + 0.0).alias(alias or c)


@query(f"WITH {EMBEDDINGS_SQL}, {BOX_SQL} SELECT cloud_id, round(diameter, 6) AS diameter, round(low[1], 6) AS low, round(high[64], 6) AS high FROM box")
def cloud_bounds(spark: SparkSession, folder: str) -> DataFrame:
    b = prepare.bounds(tables.embeddings(spark, folder))
    return b.select("cloud_id", r6("diameter"), F.round(F.element_at("bounds_min", 1), 6).alias("low"), F.round(F.element_at("bounds_max", 64), 6).alias("high"))


@query(f"""WITH {EMBEDDINGS_SQL}, {BOX_SQL}
SELECT cloud_id, point_id, round((coords[1] - (low[1] + high[1]) / 2) / diameter, 6) + 0 AS x,
  round((coords[64] - (low[64] + high[64]) / 2) / diameter, 6) + 0 AS y FROM pts JOIN box USING (cloud_id)""")
def cloud_normalise_iso(spark: SparkSession, folder: str) -> DataFrame:
    n = prepare.normalise_isotropic(tables.embeddings(spark, folder))
    return n.select("cloud_id", "point_id", (F.round(F.element_at("coords", 1), 6) + 0.0).alias("x"), (F.round(F.element_at("coords", 64), 6) + 0.0).alias("y"))


@query(f"""WITH {PARTS_SQL}, {BOX_SQL}
SELECT cloud_id, point_id, round((coords[1] - low[1]) / (high[1] - low[1]), 6) AS x, round((coords[2] - low[2]) / (high[2] - low[2]), 6) AS y
FROM pts JOIN box USING (cloud_id)""")
def cloud_normalise_minmax(spark: SparkSession, folder: str) -> DataFrame:
    n = prepare.normalise_minmax(tables.parts(spark, folder))
    return n.select("cloud_id", "point_id", F.round(F.element_at("coords", 1), 6).alias("x"), F.round(F.element_at("coords", 2), 6).alias("y"))


@query(f"WITH {EVENTS_SQL} SELECT cloud_id, point_id FROM pts QUALIFY intensity >= quantile_cont(intensity, 0.9) OVER (PARTITION BY cloud_id)")
def intensity_mask(spark: SparkSession, folder: str) -> DataFrame:
    return prepare.intensity_mask(tables.events(spark, folder), percentile=90).select("cloud_id", "point_id")


@query(f"""WITH {EVENTS_SQL}
SELECT cloud_id, point_id, round(greatest(0, least(intensity, quantile_cont(intensity, 0.95) OVER (PARTITION BY cloud_id))), 6) AS intensity FROM pts""")
def softclip(spark: SparkSession, folder: str) -> DataFrame:
    return prepare.soften_intensity(tables.events(spark, folder), 95).select("cloud_id", "point_id", r6("intensity"))


@query(f"WITH {EVENTS_SQL} SELECT cloud_id, point_id, round(intensity - min(intensity) OVER (PARTITION BY cloud_id) + 1e-9, 6) AS intensity FROM pts")
def intensity_shift(spark: SparkSession, folder: str) -> DataFrame:
    return prepare.shift_intensity(tables.events(spark, folder)).select("cloud_id", "point_id", r6("intensity"))


WEIGHTS_SQL = """low AS (SELECT *, intensity - min(intensity) OVER (PARTITION BY cloud_id) AS above, count(*) OVER (PARTITION BY cloud_id) AS n FROM pts),
weighted AS (SELECT cloud_id, point_id, CASE WHEN max(above) OVER w <= 1e-8 THEN 1.0 / n ELSE above / sum(above) OVER w END AS weight FROM low WINDOW w AS (PARTITION BY cloud_id))"""


@query(f"WITH {EVENTS_SQL}, {WEIGHTS_SQL} SELECT cloud_id, point_id, round(weight, 6) AS weight FROM weighted")
def weights_norm(spark: SparkSession, folder: str) -> DataFrame:
    return prepare.with_weights(tables.events(spark, folder)).select("cloud_id", "point_id", r6("weight"))


@query(f"""WITH {EVENTS_SQL}, ranked AS (
  SELECT cloud_id, point_id, row_number() OVER (PARTITION BY cloud_id ORDER BY md5('118:' || point_id), point_id) AS r, count(*) OVER (PARTITION BY cloud_id) AS n FROM pts)
SELECT cloud_id, point_id FROM ranked WHERE r <= CASE WHEN floor(n * 0.6) >= 32 AND floor(n * 0.6) < n THEN floor(n * 0.6) ELSE n END""")
def thin(spark: SparkSession, folder: str) -> DataFrame:
    return prepare.thin(tables.events(spark, folder), 0.6, SEED + 101).select("cloud_id", "point_id")


@query(f"WITH {EVENTS_SQL} SELECT cloud_id, point_id FROM pts QUALIFY row_number() OVER (PARTITION BY cloud_id ORDER BY md5('42:' || point_id), point_id) <= 40")
def prune(spark: SparkSession, folder: str) -> DataFrame:
    return prepare.sample(tables.events(spark, folder), 40, 42).select("cloud_id", "point_id")


@query(f"""WITH {EVENTS_SQL}, {WEIGHTS_SQL}, drawn AS (
  SELECT cloud_id, point_id, md5('5:' || point_id) AS h,
    CASE WHEN weight > 0 THEN round(-ln((CAST('0x' || substr(md5('5:' || point_id), 1, 8) AS UBIGINT) + 0.5::DOUBLE) / 4294967296.0::DOUBLE) / weight, 9) ELSE 'infinity'::DOUBLE END AS o
  FROM weighted)
SELECT cloud_id, point_id FROM drawn QUALIFY row_number() OVER (PARTITION BY cloud_id ORDER BY o, h, point_id) <= 20""")
def weighted_subsample(spark: SparkSession, folder: str) -> DataFrame:
    return prepare.weighted_sample(tables.events(spark, folder), 20, 5).select("cloud_id", "point_id")


@query(f"WITH {EMBEDDINGS_SQL} SELECT cloud_id, count(*) AS n, CAST(least(200, greatest(8, round_even(2.5 * pow(count(*), 0.5), 0))) AS INTEGER) AS m FROM pts GROUP BY cloud_id")
def auto_m(spark: SparkSession, folder: str) -> DataFrame:
    return prepare.landmark_budget(tables.embeddings(spark, folder), 2.5, 0.5, 8, 200)


def _landmarks(points: DataFrame, m: int = M) -> DataFrame:
    return landmarks.random(points, m, SEED)


@query(f"WITH {EMBEDDINGS_SQL}, {LANDMARKS_SQL} SELECT cloud_id, CAST(rank AS INTEGER) AS rank, point_id FROM lm")
def landmarks_random(spark: SparkSession, folder: str) -> DataFrame:
    return _landmarks(tables.embeddings(spark, folder))


@query(f"WITH {EMBEDDINGS_SQL}, {LANDMARKS_SQL}, {NEAR_SQL} SELECT cloud_id, point_id, CAST(rank AS INTEGER) AS rank, target_id, round(dist, 6) AS dist FROM nn WHERE rank <= 4")
def knn_landmarks(spark: SparkSession, folder: str) -> DataFrame:
    pts = tables.embeddings(spark, folder)
    near = knn.nearest(pts, metrics.landmark_points(pts, _landmarks(pts)), 4, target_bound=M)
    return knn.ranked(near).withColumn("dist", F.round("dist", 6))


@query(f"WITH {EMBEDDINGS_SQL}, {LANDMARKS_SQL}, {NEAR_SQL} SELECT cloud_id, point_id, target_id AS landmark_id, round(dist, 6) AS dist FROM nn WHERE rank = 1")
def nn1_coverage(spark: SparkSession, folder: str) -> DataFrame:
    pts = tables.embeddings(spark, folder)
    return metrics.nearest_landmark(pts, _landmarks(pts), M).withColumn("dist", F.round("dist", 6))


@query(f"WITH {EMBEDDINGS_SQL}, {SELF_SQL} SELECT cloud_id, point_id, round(dist, 6) AS radius FROM nn WHERE rank = 10")
def kth_radius(spark: SparkSession, folder: str) -> DataFrame:
    return knn.kth_radius(tables.embeddings(spark, folder), 10).withColumn("radius", F.round("radius", 6))


@query(f"WITH {EVENTS_SQL}, {SELF_SQL} SELECT cloud_id, point_id, round(ln(1 / (pow(dist + 1e-12, 3) + 1e-12)), 6) AS log_rho FROM nn WHERE rank = 5")
def density_proxy(spark: SparkSession, folder: str) -> DataFrame:
    rho = knn.density_proxy(knn.kth_radius(tables.events(spark, folder), 5), 3)
    return rho.select("cloud_id", "point_id", F.round(F.ln("rho"), 6).alias("log_rho"))


KNN_DENSITY_SQL = """raw AS (SELECT cloud_id, point_id, 1 / (avg(dist) + 1e-12) AS s FROM nn WHERE rank <= 10 GROUP BY ALL),
dens AS (SELECT cloud_id, point_id, (s - min(s) OVER w) / (max(s) OVER w - min(s) OVER w + 1e-12) AS s FROM raw WINDOW w AS (PARTITION BY cloud_id))"""


@query(f"WITH {EMBEDDINGS_SQL}, {SELF_SQL}, {KNN_DENSITY_SQL} SELECT cloud_id, point_id, round(s, 6) AS score FROM dens")
def knn_density(spark: SparkSession, folder: str) -> DataFrame:
    return knn.neighbour_density(tables.embeddings(spark, folder), 10).withColumn("score", F.round("score", 6))


@query(f"""WITH {EMBEDDINGS_SQL}, raw AS (
  SELECT p.cloud_id, p.point_id, sum(exp(-pow(list_distance(p.coords, l.coords), 2) / (2 * 0.25))) AS s FROM pts p JOIN pts l ON p.cloud_id = l.cloud_id GROUP BY ALL)
SELECT cloud_id, point_id, round((s - min(s) OVER w) / (max(s) OVER w - min(s) OVER w + 1e-12), 6) AS score FROM raw WINDOW w AS (PARTITION BY cloud_id)""")
def kde_density(spark: SparkSession, folder: str) -> DataFrame:
    return knn.kernel_density(tables.embeddings(spark, folder), 0.5).withColumn("score", F.round("score", 6))


def greedy_sql(base: str, scores: str, value: str, m: int) -> str:
    """Greedy picks as one recursive query over rows (cloud_id, point_id, coords, s)."""
    return f"""WITH RECURSIVE {base}, {scores}, st AS (
  SELECT 0 AS step, cloud_id, point_id, coords, s, list_distance(coords, first_value(coords) OVER w) AS d,
    row_number() OVER w = 1 AS now, row_number() OVER w = 1 AS taken
  FROM scored WINDOW w AS (PARTITION BY cloud_id ORDER BY round(s, 9) DESC, point_id)
  UNION ALL
  SELECT step + 1, cloud_id, point_id, coords, s, least(d, list_distance(coords, first_value(coords) OVER w)),
    row_number() OVER w = 1, taken OR row_number() OVER w = 1
  FROM (SELECT *, max(d) OVER (PARTITION BY cloud_id) AS widest FROM st WHERE step < {m - 1})
  WINDOW w AS (PARTITION BY cloud_id ORDER BY taken, round({value}, 9) DESC, point_id))
SELECT cloud_id, CAST(step AS INTEGER) AS rank, point_id FROM st WHERE now"""


@query(greedy_sql(EMBEDDINGS_SQL, f"{SELF_SQL}, {KNN_DENSITY_SQL}, scored AS (SELECT p.*, d.s FROM pts p JOIN dens d USING (cloud_id, point_id))",
                  "0.5 * s + 0.5 * CASE WHEN widest > 1e-12 THEN d / (widest + 1e-12) ELSE 0 END", 10))
def landmarks_hybrid(spark: SparkSession, folder: str) -> DataFrame:
    return landmarks.hybrid(tables.embeddings(spark, folder), 10)


@query(greedy_sql(EMBEDDINGS_SQL, f"""{SELF_SQL}, scored AS (
  SELECT p.*, pow(1 / (1 / (pow(n.dist + 1e-12, 4) + 1e-12) + 1e-12), 0.8) AS s FROM pts p JOIN nn n USING (cloud_id, point_id) WHERE n.rank = 15)""", "d * s", 10))
def landmarks_density(spark: SparkSession, folder: str) -> DataFrame:
    return landmarks.density(tables.embeddings(spark, folder), 10, 4)


WEIGHTED_SQL = greedy_sql(EMBEDDINGS_SQL, "scored AS (SELECT *, intensity AS s FROM pts)", "d * s", 12)


@query(WEIGHTED_SQL)
def weighted_maxmin(spark: SparkSession, folder: str) -> DataFrame:
    pts = tables.embeddings(spark, folder)
    return landmarks.weighted_maxmin(pts, pts.withColumnRenamed("intensity", "score"), 12)


@query(WEIGHTED_SQL)
def weighted_maxmin_rounds(spark: SparkSession, folder: str) -> DataFrame:
    """The same picks by the rounds that serve clouds beyond one task."""
    pts = tables.embeddings(spark, folder)
    return landmarks.weighted_maxmin(pts, pts.withColumnRenamed("intensity", "score"), 12, block=20, lead=16)


@query(f"""WITH {EVENTS_SQL} SELECT cloud_id, array_to_string(list_transform(coords, lambda x: CAST(CAST(floor(x / 50) AS BIGINT) AS VARCHAR)), ',') AS cell, count(*) AS n
FROM pts GROUP BY ALL""")
def spatial_hash(spark: SparkSession, folder: str) -> DataFrame:
    return landmarks.spatial_hash(tables.events(spark, folder), 50).groupBy("cloud_id", "cell").agg(F.count(F.lit(1)).alias("n"))


FILL_SQL = """ranked AS (
  SELECT cloud_id, point_id, row_number() OVER (PARTITION BY cloud_id ORDER BY o, md5('{seed}:' || point_id), point_id) AS r FROM (
    SELECT cloud_id, point_id, o FROM picks UNION ALL
    SELECT cloud_id, point_id, 1073741824 FROM pts p WHERE NOT EXISTS (SELECT 1 FROM picks q WHERE q.cloud_id = p.cloud_id AND q.point_id = p.point_id)))
SELECT cloud_id, CAST(r - 1 AS INTEGER) AS rank, point_id FROM ranked WHERE r <= 8"""


@query(f"""WITH {EVENTS_SQL}, {BOX_SQL}, wide AS (
  SELECT cloud_id, CASE WHEN max(high - low) > 0 THEN max(high - low) / 2 ELSE 1 END AS width FROM span GROUP BY cloud_id),
cells AS (
  SELECT p.cloud_id, array_to_string(list_transform(p.coords, lambda x: CAST(CAST(floor(x / width) AS BIGINT) AS VARCHAR)), ',') AS cell, count(*) AS held,
    arg_min(p.point_id, {{'a': md5('42:' || p.point_id), 'b': p.point_id}}) AS point_id
  FROM pts p JOIN wide USING (cloud_id) GROUP BY ALL),
weighed AS (
  SELECT *, 0.7::DOUBLE * (1 - held::DOUBLE / max(held) OVER w) + 0.3::DOUBLE / count(*) OVER w AS weight FROM cells WINDOW w AS (PARTITION BY cloud_id)),
drawn AS (
  SELECT *, row_number() OVER (PARTITION BY cloud_id ORDER BY
    round(-ln((CAST('0x' || substr(md5('43:' || cell), 1, 8) AS UBIGINT) + 0.5::DOUBLE) / 4294967296.0::DOUBLE) / round(weight, 12), 9), cell) AS o FROM weighed),
picks AS (SELECT cloud_id, point_id, o FROM drawn WHERE o <= 8),
{FILL_SQL.format(seed=44)}""")
def sparse_cell(spark: SparkSession, folder: str) -> DataFrame:
    return landmarks.sparse_cells(tables.events(spark, folder), 8)


def _grid_sql() -> str:
    levels = []
    for level in range(3):
        side = 2 ** (level + 1)
        levels.append(f"""SELECT cloud_id, point_id, place + {level * 8} AS o FROM (
  SELECT cloud_id, cell, arg_min(point_id, {{'a': md5('{42 + level}:' || point_id), 'b': point_id}}) AS point_id,
    row_number() OVER (PARTITION BY cloud_id ORDER BY md5('{42 + level}:' || cell), cell) AS place
  FROM (SELECT cloud_id, point_id, array_to_string(list_transform(u, lambda x: CAST(least({side - 1}, CAST(floor(x * {side}) AS BIGINT)) AS VARCHAR)), ',') AS cell FROM unit)
  GROUP BY cloud_id, cell) WHERE place <= 2""")
    return f"""WITH {EVENTS_SQL}, {BOX_SQL}, unit AS (
  SELECT cloud_id, point_id, list_transform(range(1, 4), lambda i: (coords[i] - low[i]) / CASE WHEN high[i] > low[i] THEN high[i] - low[i] ELSE 1 END) AS u
  FROM pts JOIN box USING (cloud_id)),
every AS ({" UNION ALL ".join(levels)}),
picks AS (SELECT cloud_id, point_id, min(o) AS o FROM every GROUP BY ALL),
{FILL_SQL.format(seed=45)}"""


@query(_grid_sql())
def grid_multires(spark: SparkSession, folder: str) -> DataFrame:
    return landmarks.multi_grid(tables.events(spark, folder), 8)


@query(f"""WITH {EVENTS_SQL}, ranges AS (SELECT *, sqrt(coords[1] * coords[1] + coords[2] * coords[2]) AS r FROM pts),
edges AS (SELECT cloud_id, quantile_cont(r, [0.0, 0.25, 0.5, 0.75, 1.0]) AS e FROM ranges GROUP BY cloud_id),
cells AS (
  SELECT cloud_id, point_id, greatest(0, least(15, CAST(floor((atan2(coords[2], coords[1]) + pi()) / (2 * pi() / 16)) AS INTEGER))) * 4
    + greatest(0, least(3, len(list_filter(e[1:4], lambda x: x <= r)) - 1)) AS cell
  FROM ranges JOIN edges USING (cloud_id)),
few AS (SELECT *, row_number() OVER (PARTITION BY cloud_id, cell ORDER BY md5('42:' || point_id), point_id) AS i FROM cells QUALIFY i <= 1),
picks AS (SELECT cloud_id, point_id, row_number() OVER (PARTITION BY cloud_id ORDER BY cell, i) AS o FROM few QUALIFY o <= 8),
{FILL_SQL.format(seed=43)}""")
def lidar_sectors(spark: SparkSession, folder: str) -> DataFrame:
    return landmarks.lidar_sectors(tables.events(spark, folder), 8)


COVERAGE_SQL = f"""WITH {EMBEDDINGS_SQL}, {LANDMARKS_SQL}, {NEAR_SQL}, {WEIGHTS_SQL},
near AS (SELECT n.cloud_id, n.point_id, n.dist, w.weight FROM nn n JOIN weighted w USING (cloud_id, point_id) WHERE n.rank = 1),
plain AS (
  SELECT cloud_id, avg(dist) AS a, quantile_cont(dist, 0.95) AS b, sum(dist * weight) AS c, avg(CASE WHEN dist <= 0.9 THEN 1.0 ELSE 0.0 END) AS d,
    sum(CASE WHEN dist <= 0.9 THEN weight ELSE 0 END) AS e FROM near GROUP BY cloud_id),
run AS (
  SELECT cloud_id, row_number() OVER w AS r, round(sum(weight) OVER w, 12) AS s FROM near WINDOW w AS (PARTITION BY cloud_id ORDER BY weight ROWS UNBOUNDED PRECEDING)),
hit AS (SELECT cloud_id, min(r) AS r FROM run WHERE s > 0.95 GROUP BY cloud_id),
dists AS (SELECT cloud_id, dist, row_number() OVER (PARTITION BY cloud_id ORDER BY dist) AS r FROM near)
SELECT p.cloud_id, round(a, 6) AS coverage_mean, round(b, 6) AS coverage_p95, round(c, 6) AS coverage_weighted_mean, round(d, 6) AS coverage_ratio,
  round(e, 6) AS coverage_weighted_ratio, round(x.dist, 6) AS coverage_weighted_p95
FROM plain p JOIN hit h USING (cloud_id) JOIN dists x ON x.cloud_id = h.cloud_id AND x.r = h.r"""


@query(COVERAGE_SQL)
def coverage_metrics(spark: SparkSession, folder: str) -> DataFrame:
    pts = tables.embeddings(spark, folder)
    c = metrics.coverage(pts, _landmarks(pts), 0.9, M)
    return c.select("cloud_id", *[r6(n) for n in c.columns if n != "cloud_id"])


@query(f"""WITH {EMBEDDINGS_SQL}, {LANDMARKS_SQL}
SELECT cloud_id, round(avg(intensity), 6) AS landmark_intensity_mean, round(quantile_cont(intensity, 0.5), 6) AS landmark_intensity_median,
  round(quantile_cont(intensity, 0.9), 6) AS landmark_intensity_p90 FROM lm GROUP BY cloud_id""")
def landmark_intensity(spark: SparkSession, folder: str) -> DataFrame:
    pts = tables.embeddings(spark, folder)
    c = metrics.landmark_intensity(pts, _landmarks(pts))
    return c.select("cloud_id", *[r6(n) for n in c.columns if n != "cloud_id"])


@query(f"WITH {EMBEDDINGS_SQL}, {LANDMARKS_SQL}, {NEAR_SQL} SELECT cloud_id, round(max(dist), 6) AS hausdorff FROM nn WHERE rank = 1 GROUP BY cloud_id")
def hausdorff(spark: SparkSession, folder: str) -> DataFrame:
    pts = tables.embeddings(spark, folder)
    return metrics.hausdorff(pts, _landmarks(pts)).select("cloud_id", r6("hausdorff"))


@query(f"""WITH {EMBEDDINGS_SQL}, {LANDMARKS_SQL}, gaps AS (
  SELECT a.cloud_id, a.point_id, min(list_distance(a.coords, b.coords)) AS g FROM lm a JOIN lm b ON a.cloud_id = b.cloud_id AND a.point_id <> b.point_id GROUP BY ALL)
SELECT cloud_id, round(avg(1 / (g + 1e-12)), 6) AS density_mean, round(stddev_pop(1 / (g + 1e-12)), 6) AS density_std, round(avg(g), 6) AS spacing_mean,
  round(stddev_pop(g), 6) AS spacing_std FROM gaps GROUP BY cloud_id""")
def landmark_geometry(spark: SparkSession, folder: str) -> DataFrame:
    pts = tables.embeddings(spark, folder)
    c = metrics.landmark_geometry(pts, _landmarks(pts))
    return c.select("cloud_id", *[r6(n) for n in c.columns if n != "cloud_id"])


@query(f"""WITH {EMBEDDINGS_SQL}, {LANDMARKS_SQL}, {NEAR_SQL}, means AS (SELECT cloud_id, point_id, avg(dist) AS a FROM nn WHERE rank <= 8 GROUP BY ALL)
SELECT cloud_id, round(avg(a), 6) AS witness_mean, round(stddev_pop(a), 6) AS witness_std FROM means GROUP BY cloud_id""")
def witness_spread(spark: SparkSession, folder: str) -> DataFrame:
    pts = tables.embeddings(spark, folder)
    c = metrics.witness_spread(pts, _landmarks(pts), 8)
    return c.select("cloud_id", r6("witness_mean"), r6("witness_std"))


@query(f"""WITH {PARTS_SQL}, near AS (
  SELECT a.point_id, b.point_id AS other, list_distance(a.coords, b.coords) AS d,
    row_number() OVER (PARTITION BY a.point_id ORDER BY list_distance(a.coords, b.coords), b.point_id) AS rank
  FROM (SELECT * FROM pts QUALIFY row_number() OVER (ORDER BY md5('17:' || point_id), point_id) <= 64) b, pts a)
SELECT point_id, CAST(rank AS INTEGER) AS rank, other, round(d, 6) AS dist FROM near WHERE rank <= 3""")
def knn_with_ties(spark: SparkSession, folder: str) -> DataFrame:
    """Parts repeat as points, so equal distances are common; ids decide between them."""
    pts = tables.parts(spark, folder)
    near = knn.ranked(knn.nearest(pts, metrics.landmark_points(pts, _landmarks(pts, 64)), 3, target_bound=64))
    return near.select("point_id", "rank", F.col("target_id").alias("other"), r6("dist"))


@query(f"WITH {EMBEDDINGS_SQL}, {SELF_SQL} SELECT cloud_id, round(avg(dist), 6) AS radius_mean, round(quantile_cont(dist, 0.5), 6) AS radius_median FROM nn WHERE rank = 10 GROUP BY cloud_id")
def radii_summary(spark: SparkSession, folder: str) -> DataFrame:
    return landmarks.radii_summary(tables.embeddings(spark, folder), 10).select("cloud_id", r6("radius_mean"), r6("radius_median"))
