"""Queries on drifting result files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from topospark.operators import drift

LOADED = ("brainweb_t1_standard", "pointcloud_suite_summary")


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    read = lambda name: spark.read.parquet(f"{folder}/{name}.parquet")
    return drift.changes(read("result_files"), read("result_lines"))


def p1_unified(spark: SparkSession, folder: str) -> DataFrame:
    read = lambda name: spark.read.parquet(f"{folder}/{name}.parquet")
    return drift.unify(read("result_files"), read("result_lines"), {name: read(name) for name in LOADED})


QUERIES = {"p1_found": p1_found, "p1_unified": p1_unified}
ORACLE_SQL: dict[str, str] = {}
