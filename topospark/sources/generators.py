"""Built-in clouds and volumes, generated by Spark from a row number and a seed."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from topospark.functions.vectors import draw


def _u(seed: int, stream: int) -> Column:
    """Uniform numbers of a row, the same on every run and partitioning."""
    return draw("id", seed * 100 + stream)


def _normal(seed: int, stream: int) -> Column:
    return F.sqrt(-2 * F.ln(_u(seed, stream))) * F.cos(2 * math.pi * _u(seed, stream + 50))


def swiss_roll(seed: int) -> tuple[list[Column], Column]:
    t = 1.5 * math.pi * (1 + 2 * _u(seed, 1))
    noise = [0.05 * _normal(seed, i) for i in (3, 4, 5)]
    return [t * F.cos(t) + noise[0], 21 * _u(seed, 2) + noise[1], t * F.sin(t) + noise[2]], t


def s_curve(seed: int) -> tuple[list[Column], Column]:
    t = 3 * math.pi * (_u(seed, 1) - 0.5)
    noise = [0.03 * _normal(seed, i) for i in (3, 4, 5)]
    return [F.sin(t) + noise[0], 2 * _u(seed, 2) + noise[1], F.signum(t) * (F.cos(t) - 1) + noise[2]], t


def moons(seed: int) -> tuple[list[Column], Column]:
    t, upper = math.pi * _u(seed, 1), F.col("id") % 2 == 0
    x = F.when(upper, F.cos(t)).otherwise(1 - F.cos(t)) + 0.06 * _normal(seed, 3)
    y = F.when(upper, F.sin(t)).otherwise(0.5 - F.sin(t)) + 0.06 * _normal(seed, 4)
    return [x, y, F.lit(0.0)], upper.cast("double") + 1


def blobs(seed: int) -> tuple[list[Column], Column]:
    group = (F.col("id") % 4).cast("int")
    centre = lambda axis: 20 * draw(group, seed * 100 + 90 + axis) - 10
    return [centre(a) + 0.5 * _normal(seed, 3 + a) for a in range(3)], group.cast("double") + 1


def torus(seed: int, wide: float = 2.0, thin: float = 0.6) -> tuple[list[Column], Column]:
    a, b = 2 * math.pi * _u(seed, 1), 2 * math.pi * _u(seed, 2)
    ring = wide + thin * F.cos(b)
    return [ring * F.cos(a), ring * F.sin(a), thin * F.sin(b)], F.cos(b) + 2


def sphere(seed: int) -> tuple[list[Column], Column]:
    z, a = 2 * _u(seed, 1) - 1, 2 * math.pi * _u(seed, 2)
    flat = F.sqrt(1 - z * z)
    return [flat * F.cos(a), flat * F.sin(a), z], z + 2


def cylinder(seed: int) -> tuple[list[Column], Column]:
    r, a, z = F.sqrt(_u(seed, 1)), 2 * math.pi * _u(seed, 2), 2 * _u(seed, 3) - 1
    return [r * F.cos(a), r * F.sin(a), z], r + 1


BUILTIN = {f.__name__: f for f in (swiss_roll, s_curve, moons, blobs, torus, sphere, cylinder)}


def builtin(spark: SparkSession, name: str, n: int, seed: int) -> DataFrame:
    """``n`` points of a built-in shape: (cloud_id, point_id, coords, intensity)."""
    if name not in BUILTIN:
        raise ValueError(f"no built-in cloud {name!r}; there are {', '.join(BUILTIN)}")
    coords, intensity = BUILTIN[name](seed)
    return spark.range(n).select(F.lit(name).alias("cloud_id"), F.col("id").alias("point_id"), F.array(*coords).alias("coords"), intensity.alias("intensity"))


def phantom(spark: SparkSession, size: int, seed: int) -> DataFrame:
    """Voxels ``(cloud_id, voxel_id, i, j, k, value)`` of a head-like volume: two bodies, a lesion, noise, a taper; never negative."""
    rows = spark.range(size**3).select("id", *[F.floor(F.col("id") / size ** (2 - a)).cast("int").alias(f"q{a}") for a in range(3)])
    axis = lambda a: (F.col(f"q{a}") % size) / max(1, size - 1) * 2 - 1
    x, y, z = (axis(a) for a in range(3))
    bump = lambda cx, cy, cz, s: F.exp(-((x - cx) ** 2 + (y - cy) ** 2 + (z - cz) ** 2) / (2 * s * s))
    body = bump(-0.25, 0.0, 0.0, 0.3) + 0.8 * bump(0.3, 0.1, -0.1, 0.25) + 0.6 * bump(0.1, -0.3, 0.3, 0.08) + 0.05 * _normal(seed, 1)
    taper = F.exp(-((x * x + y * y + z * z) ** 2))
    return rows.select(F.lit("phantom").alias("cloud_id"), F.col("id").alias("voxel_id"), *[(F.col(f"q{a}") % size).alias(c) for a, c in enumerate("ijk")], F.greatest(F.lit(0.0), body * taper).alias("value"))
