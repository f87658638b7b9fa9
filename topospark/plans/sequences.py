"""Queries on sequences of descriptors and poses, and on graphs between frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from topospark.functions import rotations as R
from topospark.operators import graph, odometry, temporal
from topospark.plans import pipeline, tables
from topospark.plans.clouds import r6
from topospark.plans.tables import SEQUENCES_SQL, STEPS_SQL

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
ORDER = ["ts", "event_id"]


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


PAIRS_SQL = f"""{SEQUENCES_SQL}, units AS (SELECT *, sqrt(x * x + y * y + z * z) AS l FROM seqs),
turned AS (SELECT seq, ts, event_id, x / (l + 1e-8) AS x, y / (l + 1e-8) AS y, z / (l + 1e-8) AS z FROM units),
laid AS (SELECT *, lag(x) OVER w AS px, lag(y) OVER w AS py, lag(z) OVER w AS pz FROM turned WINDOW w AS (PARTITION BY seq ORDER BY ts, event_id)),
blend AS (SELECT *, 0.8 * px + 0.2 * x AS bx, 0.8 * py + 0.2 * y AS by_, 0.8 * pz + 0.2 * z AS bz FROM laid),
pair AS (
  SELECT seq, ts, event_id, CASE WHEN px IS NOT NULL THEN 1 - greatest(-1, least(1, (bx * x + by_ * y + bz * z)
    / (sqrt(bx * bx + by_ * by_ + bz * bz) * (sqrt(x * x + y * y + z * z) + 1e-8) + 1e-8))) END AS s FROM blend),
sheaf AS (SELECT seq, ts, event_id, coalesce(avg(s) OVER (PARTITION BY seq ORDER BY ts, event_id ROWS BETWEEN 3 PRECEDING AND CURRENT ROW), 0) AS sheaf_score FROM pair)"""


@query(f"WITH {PAIRS_SQL} SELECT seq, event_id, round(sheaf_score, 6) + 0 AS sheaf_score FROM sheaf")
def sheaf_score(spark: SparkSession, folder: str) -> DataFrame:
    return temporal.sheaf_score(tables.sequences(spark, folder), ORDER).select("seq", "event_id", r6("sheaf_score"))


@query(f"""WITH {SEQUENCES_SQL}, laid AS (SELECT *, lag(x) OVER w AS px, lag(y) OVER w AS py, lag(z) OVER w AS pz FROM seqs WINDOW w AS (PARTITION BY seq ORDER BY ts, event_id))
SELECT seq, event_id, round(CASE WHEN px IS NULL THEN 0 ELSE 1 - greatest(-1, least(1, (px * x + py * y + pz * z)
  / (sqrt(px * px + py * py + pz * pz) * sqrt(x * x + y * y + z * z) + 1e-12))) END, 6) + 0 AS cosine_score FROM laid""")
def cosine_score(spark: SparkSession, folder: str) -> DataFrame:
    return temporal.cosine_score(tables.sequences(spark, folder), ORDER).select("seq", "event_id", r6("cosine_score"))


SPREAD_SQL = f"""{SEQUENCES_SQL}, stepped AS (
  SELECT *, abs(x - lag(x) OVER w) AS dx, abs(y - lag(y) OVER w) AS dy, abs(z - lag(z) OVER w) AS dz FROM seqs WINDOW w AS (PARTITION BY seq ORDER BY ts, event_id)),
spread AS (
  SELECT seq, event_id, count(*) OVER a AS n, (stddev_pop(x) OVER a + stddev_pop(y) OVER a + stddev_pop(z) OVER a) / 3 AS s,
    (avg(dx) OVER b + avg(dy) OVER b + avg(dz) OVER b) / 3 AS t FROM stepped
  WINDOW a AS (PARTITION BY seq ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), b AS (PARTITION BY seq ORDER BY ts, event_id ROWS BETWEEN 3 PRECEDING AND CURRENT ROW))"""


@query(f"WITH {SPREAD_SQL} SELECT seq, event_id, round(CASE WHEN n > 1 THEN s ELSE 0 END, 6) AS variance_score FROM spread")
def variance_score(spark: SparkSession, folder: str) -> DataFrame:
    return temporal.variance_and_snr(tables.sequences(spark, folder), ORDER, 3).select("seq", "event_id", r6("variance_score"))


@query(f"WITH {SPREAD_SQL} SELECT seq, event_id, round(CASE WHEN n > 1 THEN log10(s / (t + 1e-12) + 1e-12) ELSE 0 END, 6) + 0 AS snr_score FROM spread")
def snr_score(spark: SparkSession, folder: str) -> DataFrame:
    return temporal.variance_and_snr(tables.sequences(spark, folder), ORDER, 3).select("seq", "event_id", r6("snr_score"))


TOPO_SQL = f"""{SEQUENCES_SQL}, topo AS (SELECT seq, ts, event_id, sqrt(x * x + y * y + z * z) AS l, greatest(0, y) + greatest(0, z) AS t FROM seqs)"""


@query(f"""WITH {TOPO_SQL} SELECT seq, event_id, round(log10(l + 1e-12), 6) + 0 AS signal_strength, round(log10(t + 1e-12), 6) + 0 AS topo_signal,
  round(t / (l + 1e-12), 6) AS topo_density FROM topo""")
def topo_density(spark: SparkSession, folder: str) -> DataFrame:
    rows = temporal.topological_signal(tables.sequences(spark, folder), (1, 1), (2, 1))
    return rows.select("seq", "event_id", r6("signal_strength"), r6("topo_signal"), r6("topo_density"))


@query(f"""WITH {PAIRS_SQL}, {TOPO_SQL.split("FROM events), ", 1)[1]}, flags AS (
  SELECT s.seq, s.ts, s.event_id, CAST(t / (l + 1e-12) < 0.002 OR sheaf_score > 0.25 OR l < 0.5 AS INTEGER) AS used_teacher
  FROM sheaf s JOIN topo t ON s.event_id = t.event_id AND s.seq = t.seq)
SELECT seq, event_id, used_teacher, CAST(sum(used_teacher) OVER (PARTITION BY seq ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS fallback_count FROM flags""")
def fallback_flag(spark: SparkSession, folder: str) -> DataFrame:
    rows = temporal.topological_signal(tables.sequences(spark, folder), (1, 1), (2, 1))
    return temporal.fallback(temporal.sheaf_score(rows, ORDER), ORDER).select("seq", "event_id", "used_teacher", "fallback_count")


def _frames(spark: SparkSession, folder: str) -> DataFrame:
    """Events of a user and day as the points of a frame."""
    rows = tables.read(spark, folder, "events")
    seconds = (F.hour("ts") * 3600 + F.minute("ts") * 60 + F.second("ts")).cast("double")
    return rows.select(F.col("user_id").alias("seq"), F.dayofyear("ts").alias("frame"), F.col("event_id").alias("point_id"), F.array(seconds, "value").alias("coords"))


GRAPH_SQL = """frames AS (
  SELECT user_id AS seq, CAST(dayofyear(ts) AS INTEGER) AS frame, event_id AS point_id, [CAST(hour(ts) * 3600 + minute(ts) * 60 + second(ts) AS DOUBLE), value] AS coords FROM events
  QUALIFY row_number() OVER (PARTITION BY user_id, dayofyear(ts) ORDER BY md5('7:' || event_id), event_id) <= 4),
linked AS (
  SELECT a.seq, a.frame, a.point_id AS u, b.point_id AS v, list_distance(a.coords, b.coords) AS dist,
    row_number() OVER (PARTITION BY a.seq, a.frame, a.point_id ORDER BY list_distance(a.coords, b.coords), b.point_id) AS r
  FROM frames a JOIN frames b ON a.seq = b.seq AND b.frame = a.frame + 1 QUALIFY r <= 2)"""


@query(f"WITH {GRAPH_SQL} SELECT seq, frame, u, v, round(dist, 6) AS dist FROM linked")
def temporal_graph(spark: SparkSession, folder: str) -> DataFrame:
    return temporal.temporal_graph(_frames(spark, folder), 4, 2, 7).withColumn("dist", F.round("dist", 6))


def _edges(spark: SparkSession, folder: str) -> DataFrame:
    rows = tables.read(spark, folder, "lineitem")
    return rows.select((F.col("l_orderkey") % 97).alias("graph"), (F.col("l_partkey") % 40).alias("u"), (F.col("l_suppkey") % 40).alias("v"))


EDGES_SQL = """edges AS (SELECT l_orderkey % 97 AS graph, l_partkey % 40 AS u, l_suppkey % 40 AS v FROM lineitem),
a AS (SELECT graph, u, v, CAST(count(*) AS DOUBLE) AS weight FROM edges GROUP BY ALL)"""


@query(f"WITH {EDGES_SQL} SELECT * FROM a")
def adjacency(spark: SparkSession, folder: str) -> DataFrame:
    return graph.adjacency(_edges(spark, folder))


@query(f"""WITH {EDGES_SQL}, h AS (SELECT graph, u AS i, v AS j, weight / 2 AS w FROM a UNION ALL SELECT graph, v, u, weight / 2 FROM a)
SELECT graph, i, j, sum(w) AS value FROM (SELECT graph, i, i AS j, w FROM h UNION ALL SELECT graph, i, j, -w FROM h) GROUP BY ALL HAVING sum(w) <> 0""")
def laplacian(spark: SparkSession, folder: str) -> DataFrame:
    return graph.laplacian(_edges(spark, folder))


@query(f"""WITH {EDGES_SQL}, ends AS (SELECT graph, u AS i FROM a UNION SELECT graph, v FROM a)
SELECT graph, i, round(sin(CAST(i AS DOUBLE)), 6) + 0 AS value FROM ends""")
def low_pass_whole(spark: SparkSession, folder: str) -> DataFrame:
    """With the whole spectrum kept a signal stays as it is."""
    edges = _edges(spark, folder)
    ends = edges.select("graph", F.col("u").alias("i")).unionByName(edges.select("graph", F.col("v").alias("i"))).distinct()
    signal = ends.withColumn("value", F.sin(F.col("i").cast("double")))
    return graph.low_pass(signal, graph.laplacian(edges), keep=1.0).select("graph", "i", (F.round("value", 6) + 0.0).alias("value"))


@query()
def low_pass(spark: SparkSession, folder: str) -> DataFrame:
    edges = _edges(spark, folder)
    ends = edges.select("graph", F.col("u").alias("i")).unionByName(edges.select("graph", F.col("v").alias("i"))).distinct()
    signal = ends.withColumn("value", F.sin(F.col("i").cast("double")))
    return graph.low_pass(signal, graph.laplacian(edges)).select("graph", "i", r6("value"))


def _poses(spark: SparkSession, folder: str) -> DataFrame:
    steps = tables.steps(spark, folder)
    return steps.select("seq", "frame", R.pose(R.quaternion_to_matrix(F.col("q")), F.col("t")).alias("step"))


UNIT_SQL = f"""{STEPS_SQL}, unit AS (
  SELECT seq, frame, t, q[1] / n AS w, q[2] / n AS x, q[3] / n AS y, q[4] / n AS z FROM (SELECT *, sqrt(list_sum(list_transform(q, lambda v: v * v))) AS n FROM steps))"""


@query(f"""WITH {UNIT_SQL} SELECT seq, frame, round(abs(w), 6) + 0 AS w, round(CASE WHEN w < 0 THEN -x ELSE x END, 6) + 0 AS x,
  round(CASE WHEN w < 0 THEN -y ELSE y END, 6) + 0 AS y, round(CASE WHEN w < 0 THEN -z ELSE z END, 6) + 0 AS z FROM unit""")
def quat_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    """Quaternion to matrix and back gives the unit quaternion, sign aside."""
    steps = tables.steps(spark, folder).withColumn("p", R.matrix_to_quaternion(R.quaternion_to_matrix(F.col("q"))))
    sign = F.when(F.element_at("p", 1) < 0, -1.0).otherwise(1.0)
    return steps.select("seq", "frame", *[(F.round(F.element_at("p", i + 1) * sign, 6) + 0.0).alias(c) for i, c in enumerate("wxyz")])


WALK_SQL = "RECURSIVE " + UNIT_SQL + """, placed AS (
  SELECT seq, frame, row_number() OVER (PARTITION BY seq ORDER BY frame) AS nr, t[1] AS a, t[2] AS b, t[3] AS c, w, x, y, z,
    sum(t[1]) OVER (PARTITION BY seq ORDER BY frame) AS sa, sum(t[2]) OVER (PARTITION BY seq ORDER BY frame) AS sb, sum(t[3]) OVER (PARTITION BY seq ORDER BY frame) AS sc FROM unit),
walk AS (
  SELECT seq, frame, nr, a AS px, b AS py, c AS pz, w, x, y, z, sa, sb, sc FROM placed WHERE nr = 1
  UNION ALL
  SELECT p.seq, p.frame, p.nr,
    o.px + p.a + 2 * (o.w * (o.y * p.c - o.z * p.b) + o.y * (o.x * p.b - o.y * p.a) - o.z * (o.z * p.a - o.x * p.c)),
    o.py + p.b + 2 * (o.w * (o.z * p.a - o.x * p.c) + o.z * (o.y * p.c - o.z * p.b) - o.x * (o.x * p.b - o.y * p.a)),
    o.pz + p.c + 2 * (o.w * (o.x * p.b - o.y * p.a) + o.x * (o.z * p.a - o.x * p.c) - o.y * (o.y * p.c - o.z * p.b)),
    o.w * p.w - o.x * p.x - o.y * p.y - o.z * p.z, o.w * p.x + o.x * p.w + o.y * p.z - o.z * p.y,
    o.w * p.y - o.x * p.z + o.y * p.w + o.z * p.x, o.w * p.z + o.x * p.y - o.y * p.x + o.z * p.w, p.sa, p.sb, p.sc
  FROM walk o JOIN placed p ON p.seq = o.seq AND p.nr = o.nr + 1)"""


@query(f"WITH {WALK_SQL} SELECT seq, frame, round(px, 4) + 0 AS x, round(py, 4) + 0 AS y, round(pz, 4) + 0 AS z FROM walk")
def trajectory(spark: SparkSession, folder: str) -> DataFrame:
    rows = odometry.trajectory(_poses(spark, folder))
    return rows.select("seq", "frame", *[(F.round(F.element_at("pose", 4 * i + 4), 4) + 0.0).alias(c) for i, c in enumerate("xyz")])


@query(f"""WITH {STEPS_SQL}, laid AS (SELECT *, lead(frame) OVER (PARTITION BY seq ORDER BY frame) AS after, row_number() OVER (PARTITION BY seq ORDER BY frame) - 1 AS place FROM steps)
SELECT seq, frame AS frame_t, after AS frame_t1 FROM laid WHERE after IS NOT NULL AND place % 1 = 0""")
def pair_index(spark: SparkSession, folder: str) -> DataFrame:
    return pipeline.pair_index(tables.steps(spark, folder))


@query(f"""WITH {UNIT_SQL} SELECT seq, frame, round(t[1] + 1e-9, 6) + 0 AS tx, round(t[2] + 1e-9, 6) + 0 AS ty, round(t[3] + 1e-9, 6) + 0 AS tz, round(abs(w), 6) AS qw
FROM unit QUALIFY row_number() OVER (PARTITION BY seq ORDER BY frame) > 1""")
def relative_pose(spark: SparkSession, folder: str) -> DataFrame:
    """The relative poses of an accumulated trajectory are its steps again."""
    walked = odometry.trajectory(_poses(spark, folder))
    back = odometry.relative_poses(walked.select("seq", "frame", "pose"))
    ahead = F.lead("frame").over(Window.partitionBy("seq").orderBy("frame"))
    frames = walked.select("seq", "frame", ahead.alias("next")).where("next is not null")
    rows = back.join(frames, ["seq", "frame"])
    return rows.select("seq", F.col("next").alias("frame"), *[(F.round(F.element_at("translation", i + 1) + 1e-9, 6) + 0.0).alias(f"t{c}") for i, c in enumerate("xyz")], F.round(F.abs(F.element_at("quaternion", 1)), 6).alias("qw"))


def _straight(spark: SparkSession, folder: str) -> DataFrame:
    """What a model without rotation would have walked."""
    steps = tables.steps(spark, folder)
    identity = F.array(*[F.lit(float(x)) for x in (1, 0, 0, 0, 1, 0, 0, 0, 1)])
    return odometry.trajectory(steps.select("seq", "frame", R.pose(identity, F.col("t")).alias("step")))


@query(f"WITH {WALK_SQL} SELECT seq, round(sqrt(avg(pow(px - sa, 2) + pow(py - sb, 2) + pow(pz - sc, 2))), 4) AS ate FROM walk GROUP BY seq")
def ate(spark: SparkSession, folder: str) -> DataFrame:
    found = odometry.absolute_error(_straight(spark, folder), odometry.trajectory(_poses(spark, folder)))
    return found.select("seq", F.round("ate", 4).alias("ate"))


@query(f"""WITH {UNIT_SQL}, later AS (SELECT * FROM unit QUALIFY row_number() OVER (PARTITION BY seq ORDER BY frame) > 1)
SELECT seq, round(sqrt(avg(pow(2 * degrees(acos(least(1, abs(w)))), 2))), 3) + 0 AS rpe_rotation,
  round(sqrt(avg(pow(t[1], 2) + pow(t[2], 2) + pow(t[3] - 1, 2))), 3) + 0 AS rpe_translation FROM later GROUP BY seq""")
def rpe(spark: SparkSession, folder: str) -> DataFrame:
    """Against a walk straight ahead by one a step, the errors are the angle of each step and how far its shift is from that."""
    identity, ahead = F.array(*[F.lit(float(x)) for x in (1, 0, 0, 0, 1, 0, 0, 0, 1)]), F.array(*[F.lit(float(x)) for x in (0, 0, 1)])
    truth = odometry.trajectory(tables.steps(spark, folder).select("seq", "frame", R.pose(identity, ahead).alias("step")))
    found = odometry.relative_error(odometry.trajectory(_poses(spark, folder)), truth)
    return found.select("seq", *[(F.round(c, 3) + 0.0).alias(c) for c in ("rpe_rotation", "rpe_translation")])


@query(f"""WITH {UNIT_SQL} SELECT seq, round(avg(pow(t[1], 2) + pow(t[2], 2) + pow(t[3] - 1, 2)) / 3, 6) AS translation_loss, round(avg(acos(least(1, abs(w)))), 6) AS rotation_loss,
  round(avg(pow(t[1], 2) + pow(t[2], 2) + pow(t[3] - 1, 2)) / 3 + 0.5 * avg(acos(least(1, abs(w)))), 6) AS pose_loss FROM unit GROUP BY seq""")
def geodesic_loss(spark: SparkSession, folder: str) -> DataFrame:
    """Loss of predicting one step straight ahead."""
    steps = tables.steps(spark, folder)
    length = F.sqrt(F.aggregate("q", F.lit(0.0), lambda s, x: s + x * x))
    ahead = F.array(*[F.lit(float(x)) for x in (0, 0, 1)])
    still = F.array(*[F.lit(float(x)) for x in (1, 0, 0, 0)])
    rows = steps.select("seq", F.col("t"), F.transform("q", lambda x: x / length).alias("q"), ahead.alias("t_true"), still.alias("q_true"))
    losses = odometry.pose_loss(rows, 1.0, 0.5)
    return losses.select("seq", r6("translation_loss"), r6("rotation_loss"), r6("pose_loss"))
