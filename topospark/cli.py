"""Command line: landmarks of a cloud, or result rows of a suite, of volumes, or of the cases of a file."""

from __future__ import annotations

import argparse

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from topospark.operators import landmarks, prepare
from topospark.plans import pipeline
from topospark.sources import generators, readers, sinks


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="topospark", description=__doc__)
    p.add_argument("action", choices=["landmarks", "suite", "volume", "cases"])
    source = p.add_mutually_exclusive_group()
    source.add_argument("--input", help="a cloud or volume file or folder, or the JSON file of cases")
    source.add_argument("--builtin", choices=sorted(generators.BUILTIN))
    source.add_argument("--synthetic", action="store_true", help="the phantom in place of a volume")
    p.add_argument("--format", help="npy, csv, ply or velodyne; by the ending if left out")
    p.add_argument("--samples", type=int, default=5000)
    p.add_argument("--max-points", type=int, default=0)
    p.add_argument("--methods", default="hybrid", help="comma-separated")
    p.add_argument("--m", type=int, default=400)
    p.add_argument("--k", type=int, default=4)
    p.add_argument("--dim", type=int, default=3)
    p.add_argument("--max-dim", type=int, default=1)
    p.add_argument("--coverage-radius", type=float, help="by the diameter before normalisation if left out")
    p.add_argument("--rips-points", type=int, default=0)
    p.add_argument("--rips-percentile", type=float, default=80.0)
    p.add_argument("--selection-c", type=float, default=3)
    p.add_argument("--hybrid-alpha", type=float, default=0.4)
    p.add_argument("--dataset-label")
    p.add_argument("--preset", choices=sorted(pipeline.PRESETS), default="standard")
    p.add_argument("--seed", type=int, default=42)
    p.add_argument("--output", required=True)
    return p


def clouds(spark: SparkSession, case: dict) -> DataFrame:
    """The points a case of a suite names."""
    if not case["input"]:
        return generators.builtin(spark, case["builtin"] or "swiss_roll", case["samples"], case["seed"])
    points = readers.read_cloud(spark, case["input"], case["format"], case["dim"])
    name = F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?$", 1) if "path" in points.columns else F.concat_ws("/", "seq", "frame")
    return points.withColumn("cloud_id", name)


def main(arguments: list[str] | None = None) -> None:
    args = parser().parse_args(arguments)
    if args.m < 1 or not 0 <= args.hybrid_alpha <= 1:
        raise SystemExit("m must be at least 1, and hybrid-alpha lie in [0, 1]")
    spark = SparkSession.builder.getOrCreate()
    case = {k: v for k, v in vars(args).items() if k in pipeline.CASE} | {"k_witness": args.k, "output": "run"}
    if args.action == "cases":
        cases = [row.asDict() for row in readers.read_cases(spark, args.input).collect()]  # a list written by hand
        sinks.write_results(pipeline.suite(cases, lambda c: clouds(spark, c)), args.output)
    elif args.action == "volume":
        voxels = generators.phantom(spark, 64, args.seed) if args.synthetic or not args.input else readers.read_volumes(spark, args.input).withColumnRenamed("path", "cloud_id")
        affine = None if "affine" in voxels.columns else np.eye(4).tolist()
        methods = [m.strip() for m in args.methods.split(",") if m.strip()]
        rows = pipeline.volume_run(voxels, affine, methods, args.preset, args.m, args.max_points or 50_000, args.coverage_radius or 0.03, args.seed, args.rips_points)
        sinks.write_results(rows.withColumn("dataset", F.lit(args.dataset_label)) if args.dataset_label else rows, args.output)
    elif args.action == "suite":
        sinks.write_results(pipeline.suite([case], lambda c: clouds(spark, c)), args.output)
    else:
        points = prepare.shift_intensity(prepare.normalise_minmax(clouds(spark, pipeline.CASE | case).select("cloud_id", "point_id", "coords", "intensity")))
        if args.max_points:
            points = prepare.weighted_sample(points, args.max_points, args.seed + 17)
        for method in [m.strip() for m in args.methods.split(",") if m.strip()]:
            picks = landmarks.select(points, method, args.m, args.seed, args.dim, args.hybrid_alpha, args.selection_c)
            picks.write.mode("overwrite").parquet(f"{args.output}/{method}")


if __name__ == "__main__":
    main()
