"""Queries that take the events as a stream: scores kept in state, and windows by event time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from topospark.plans import tables
from topospark.plans.clouds import r6
from topospark.plans.sequences import PAIRS_SQL
from topospark.session import shared_folder
from topospark.streaming import scores

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _events(spark: SparkSession, folder: str) -> DataFrame:
    """The events as a stream; what arrives is what lies in the table's files (a pattern, as the table may be a file or a folder)."""
    schema = tables.read(spark, folder, "events").schema
    return spark.readStream.schema(schema).parquet(f"{folder}/events.parque[t]")


def _timed(spark: SparkSession, folder: str) -> DataFrame:
    """The events with their time as the instants that watermarks need."""
    return _events(spark, folder).withColumn("ts", F.col("ts").cast("timestamp"))


def _plain(rows: DataFrame) -> DataFrame:
    """Ends of windows as times without zone, as the table has them."""
    return rows.withColumn("start", F.col("start").cast("timestamp_ntz")).withColumn("end", F.col("end").cast("timestamp_ntz"))


def _finished(stream: DataFrame) -> DataFrame:
    """Runs a stream over all that is available and reads what it wrote."""
    folder = shared_folder(stream.sparkSession)
    scores.run_to_parquet(stream, f"{folder}/out", f"{folder}/state")
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/out")


@query(f"WITH {PAIRS_SQL} SELECT seq, event_id, round(sheaf_score, 6) + 0 AS sheaf_score, CAST(sum(CAST(sheaf_score > 0.25 AS INTEGER)) OVER (PARTITION BY seq ORDER BY ts, event_id) AS BIGINT) AS fallback_count FROM sheaf")
def stream_sheaf_score(spark: SparkSession, folder: str) -> DataFrame:
    scores.use_rocksdb(spark)
    found = _finished(scores.sheaf_stream(tables.as_sequences(_events(spark, folder))))
    return found.select("seq", "event_id", r6("sheaf_score"), "fallback_count")


# in append mode a window comes out once the watermark (the latest time less the lateness) has passed its end
CLOSED_SQL = "(SELECT max(ts) - INTERVAL 10 minute FROM events)"


@query(f"""WITH placed AS (SELECT time_bucket(INTERVAL 1 hour, ts) AS "start", event_type, value FROM events)
SELECT "start", "start" + INTERVAL 1 hour AS "end", event_type, count(*) AS n, round(avg(value), 6) AS mean FROM placed GROUP BY ALL HAVING "end" <= {CLOSED_SQL}""")
def stream_tumbling(spark: SparkSession, folder: str) -> DataFrame:
    return _plain(_finished(scores.windowed(_timed(spark, folder), "1 hour"))).withColumn("mean", F.round("mean", 6))


@query(f"""WITH slid AS (SELECT time_bucket(INTERVAL 15 minute, ts) - INTERVAL 15 minute * k AS "start", event_type, value FROM events, range(4) AS r(k))
SELECT "start", "start" + INTERVAL 1 hour AS "end", event_type, count(*) AS n, round(avg(value), 6) AS mean FROM slid GROUP BY ALL HAVING "end" <= {CLOSED_SQL}""")
def stream_sliding(spark: SparkSession, folder: str) -> DataFrame:
    return _plain(_finished(scores.windowed(_timed(spark, folder), "1 hour", "15 minutes"))).withColumn("mean", F.round("mean", 6))


@query(f"""WITH laid AS (SELECT user_id, ts, value, CAST(coalesce(ts - lag(ts) OVER w > INTERVAL 30 minute, true) AS INTEGER) AS opens FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
numbered AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts) AS nr FROM laid)
SELECT user_id, min(ts) AS "start", max(ts) + INTERVAL 30 minute AS "end", count(*) AS n, round(sum(value), 4) AS value FROM numbered GROUP BY user_id, nr
HAVING max(ts) + INTERVAL 30 minute <= {CLOSED_SQL}""")
def stream_sessions(spark: SparkSession, folder: str) -> DataFrame:
    return _plain(_finished(scores.sessions(_timed(spark, folder)))).withColumn("value", F.round("value", 4))
