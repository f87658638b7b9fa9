"""The given tables as clouds and sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def embeddings(spark: SparkSession, folder: str) -> DataFrame:
    """One cloud per label; the intensity is the size of the first coordinate."""
    coords = F.col("embedding").cast("array<double>")
    df = read(spark, folder, "embeddings")
    return df.select(F.col("label").alias("cloud_id"), F.col("vec_id").alias("point_id"), coords.alias("coords"), F.abs(F.element_at(coords, 1)).alias("intensity"))


EMBEDDINGS_SQL = """pts AS (
  SELECT label AS cloud_id, vec_id AS point_id, CAST(embedding AS DOUBLE[]) AS coords, abs(CAST(embedding[1] AS DOUBLE)) AS intensity
  FROM embeddings)"""


def _event_columns() -> list:
    seconds = F.hour("ts") * 3600 + F.minute("ts") * 60 + F.second("ts")
    k = F.regexp_extract("props", '"k": *([0-9]+)', 1).cast("double")
    return [seconds.cast("double"), F.col("value"), F.coalesce(k, F.lit(0.0))]


def events(spark: SparkSession, folder: str) -> DataFrame:
    """One cloud per user: time of day, value and the number in the properties; the intensity is the value."""
    df = read(spark, folder, "events")
    return df.select(F.col("user_id").alias("cloud_id"), F.col("event_id").alias("point_id"), F.array(*_event_columns()).alias("coords"), F.col("value").alias("intensity"))


_EVENT_SQL = """[CAST(hour(ts) * 3600 + minute(ts) * 60 + second(ts) AS DOUBLE), value,
    coalesce(TRY_CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS DOUBLE), 0)]"""
EVENTS_SQL = f"pts AS (SELECT user_id AS cloud_id, event_id AS point_id, {_EVENT_SQL} AS coords, value AS intensity FROM events)"


def sequences(spark: SparkSession, folder: str) -> DataFrame:
    """Events of a user as a sequence of descriptors."""
    return as_sequences(read(spark, folder, "events"))


def as_sequences(events: DataFrame) -> DataFrame:
    """The descriptors of events, given whole or as a stream."""
    seconds, value, k = _event_columns()
    return events.select(F.col("user_id").alias("seq"), "ts", "event_id", F.array(seconds / 86400, value / 100, k / 10).alias("vec"))


SEQUENCES_SQL = """seqs AS (
  SELECT user_id AS seq, ts, event_id, CAST(hour(ts) * 3600 + minute(ts) * 60 + second(ts) AS DOUBLE) / 86400 AS x, value / 100 AS y,
    coalesce(TRY_CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS DOUBLE), 0) / 10 AS z
  FROM events)"""


def parts(spark: SparkSession, folder: str) -> DataFrame:
    """All parts as one plane cloud of size and price."""
    df = read(spark, folder, "part")
    return df.select(F.lit(0).alias("cloud_id"), F.col("p_partkey").alias("point_id"), F.array(F.col("p_size").cast("double"), "p_retailprice").alias("coords"), F.col("p_retailprice").alias("intensity"))


PARTS_SQL = """pts AS (
  SELECT 0 AS cloud_id, p_partkey AS point_id, [CAST(p_size AS DOUBLE), p_retailprice] AS coords, p_retailprice AS intensity FROM part)"""


def steps(spark: SparkSession, folder: str) -> DataFrame:
    """Motion from frame to frame: of each (seq, frame) the delivery received last, poses that are missing or not finite left out."""
    df = read(spark, folder, "frame_pairs")
    whole = lambda c, n: (F.size(c) == n) & F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    good = df.where(F.col("seq").isNotNull() & F.col("frame_t").isNotNull() & whole("translation", 3) & whole("rotation_quat", 4))
    good = good.where(F.aggregate("rotation_quat", F.lit(0.0), lambda s, x: s + x * x) > 0)
    last = F.max(F.struct(F.coalesce("received_at", F.lit("1970-01-01").cast(df.schema["received_at"].dataType)), "translation", "rotation_quat")).alias("last")
    return good.groupBy("seq", F.col("frame_t").alias("frame")).agg(last).select("seq", "frame", F.col("last.translation").alias("t"), F.col("last.rotation_quat").alias("q"))


STEPS_SQL = """steps AS (
  SELECT seq, frame_t AS frame, s.t AS t, s.q AS q FROM (
    SELECT seq, frame_t, max({'r': coalesce(received_at, TIMESTAMP '1970-01-01'), 't': translation, 'q': rotation_quat}) AS s
    FROM frame_pairs
    WHERE seq IS NOT NULL AND frame_t IS NOT NULL AND len(translation) = 3 AND len(rotation_quat) = 4
      AND len(list_filter(translation, lambda x: x IS NOT NULL AND isfinite(x))) = 3
      AND len(list_filter(rotation_quat, lambda x: x IS NOT NULL AND isfinite(x))) = 4
      AND list_sum(list_transform(rotation_quat, lambda x: x * x)) > 0
    GROUP BY seq, frame_t))"""
