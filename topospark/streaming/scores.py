"""Streams of descriptors: scores along each sequence, kept in state, and windows by event time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STATE = "vec array<double>"
COUNT = "n bigint"


def use_rocksdb(spark: SparkSession) -> None:
    """State in RocksDB, which the stateful operator needs."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def unit(v: np.ndarray) -> np.ndarray:
    return v / (np.linalg.norm(v) + 1e-8)


def pair_score(before: np.ndarray, now: np.ndarray, alpha: float) -> float:
    """As the batch score of two consecutive directions."""
    blend = alpha * before + (1 - alpha) * now
    cosine = blend @ now / (np.linalg.norm(blend) * (np.linalg.norm(now) + 1e-8) + 1e-8)
    return float(1 - np.clip(cosine, -1, 1))


class SheafProcessor(StatefulProcessor):
    """Keeps the last ``window`` descriptors of a sequence and how often it fell back."""

    def __init__(self, window: int, alpha: float, threshold: float) -> None:
        self.window, self.alpha, self.threshold = window, alpha, threshold

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getListState("held", STATE)
        self.fallen = handle.getValueState("fallen", COUNT)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        held = [np.asarray(v[0], dtype=float) for v in self.held.get()]
        fallen = int(self.fallen.get()[0]) if self.fallen.exists() else 0
        frame = pd.concat(list(rows)).sort_values(["ts", "event_id"], kind="stable")
        out = []
        for event_id, vec in zip(frame["event_id"], frame["vec"], strict=True):
            held = [*held, np.asarray(vec, dtype=float)][-self.window :]
            turned = [unit(v) for v in held]
            scores = [pair_score(a, b, self.alpha) for a, b in zip(turned[:-1], turned[1:], strict=True)]
            score = float(np.mean(scores)) if scores else 0.0
            fallen += score > self.threshold
            out.append((key[0], event_id, score, fallen))
        self.held.put([(v.tolist(),) for v in held])
        self.fallen.update((fallen,))
        yield pd.DataFrame(out, columns=["seq", "event_id", "sheaf_score", "fallback_count"])

    def close(self) -> None:
        pass


def sheaf_stream(stream: DataFrame, window: int = 5, alpha: float = 0.8, threshold: float = 0.25) -> DataFrame:
    """Scores of a stream ``(seq, ts, event_id, vec)`` as the batch operator gives them.

    State is at most ``window`` vectors a sequence. The rows of a sequence within one batch are put
    in order in one task; ``maxBytesPerTrigger`` of the source bounds a batch. Rows of a batch are put in order; rows that
    come after a later one of their sequence was scored are scored where they arrive.
    """
    kind = lambda c: stream.schema[c].dataType.simpleString()
    schema = f"seq {kind('seq')}, event_id {kind('event_id')}, sheaf_score double, fallback_count bigint"
    return stream.groupBy("seq").transformWithStateInPandas(SheafProcessor(window, alpha, threshold), schema, "Append", "None")


def windowed(stream: DataFrame, size: str = "1 hour", slide: str | None = None, lateness: str = "10 minutes") -> DataFrame:
    """Counts and means of ``value`` by event time in tumbling or sliding windows; rows later than the watermark are dropped."""
    window = F.window("ts", size, slide) if slide else F.window("ts", size)
    rows = stream.withWatermark("ts", lateness).groupBy(window.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"))
    return rows.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "event_type", "n", "mean")


def sessions(stream: DataFrame, gap: str = "30 minutes", lateness: str = "10 minutes") -> DataFrame:
    """Sessions of each user: stretches of events without a pause of ``gap``."""
    w = F.session_window("ts", gap)
    rows = stream.withWatermark("ts", lateness).groupBy(w.alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value"))
    return rows.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "value")


def run_to_parquet(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Takes all that is available into parquet files and ends; both folders must be shared by the executors."""
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()
