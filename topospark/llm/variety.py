"""Choosing a varied subset: nested grids served round-robin, in SQL throughout."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from topospark.llm.topn import top_n, top_n_ranked
from topospark.session import cut_lineage

STEPS = 8  # parts of the way from one power of two to the next
POWERS = 9  # powers of two tried in a pass; more passes follow for clouds where they are not enough
BROADCAST_CLOUDS = 10_000
LAST_LEVEL = 1 << 40  # beyond, bins are finer than a double tells apart


def wanted_of(clouds: DataFrame) -> DataFrame:
    """``(cloud_id, dim, m)`` of each cloud; of one described several times the latest row with a positive ``m`` counts."""
    rows = clouds.select("cloud_id", "dim", "m", "loaded_at").where("cloud_id is not null and m > 0 and dim > 0")
    return top_n(rows, ["cloud_id"], [F.col("loaded_at").desc_nulls_last(), F.col("m").desc()], 1).drop("loaded_at")


def valid_points(points: DataFrame, wanted: DataFrame) -> DataFrame:
    """Deliveries of points of wanted clouds with all coordinates present and finite; an intensity that is null, not finite or negative is read as null."""
    rows = points.select("cloud_id", "point_id", "coords", F.col("intensity").cast("double").alias("intensity"), "ingested_at").where("coords is not null and point_id is not null")
    rows = rows.where(F.forall("coords", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    rows = few(rows, wanted).where(F.size("coords") == F.col("dim"))
    fair = (F.col("intensity") >= 0) & (F.col("intensity") < float("inf"))
    return rows.withColumn("intensity", F.when(fair, F.col("intensity"))).drop("dim")


def attributes(rows: DataFrame) -> DataFrame:
    """Adds ``units``, all attributes of a point in [0, 1) of their range in the cloud, and ``spot``, ``spot_too``, by which equal coordinates are told.

    The intensity (its logarithm; -1 if unknown) comes first, then the coordinates by falling spread.
    """
    rows = rows.withColumn("values", F.concat(F.array(F.log1p("intensity")), "coords"))
    axes = rows.select("cloud_id", F.posexplode("values").alias("axis", "x")).groupBy("cloud_id", "axis")
    axes = axes.agg(F.stddev_pop("x").alias("s"), F.min("x").alias("low"), F.max("x").alias("high"))
    order = F.struct((F.col("axis") > 0).alias("later"), (-F.col("s")).alias("s"), "axis", "low", (F.col("high") - F.col("low")).alias("span"))
    axes = axes.groupBy("cloud_id").agg(F.sort_array(F.collect_list(order)).alias("axes"))  # one entry an attribute
    unit = lambda x, a: F.when(x.isNull(), -1.0).when(a["span"] > 0, F.least((x - a["low"]) / a["span"], F.lit(1 - 1e-9))).otherwise(0.0)
    units = F.transform("axes", lambda a: unit(F.get("values", a["axis"]), a))
    spot = [F.xxhash64("coords").alias("spot"), F.xxhash64(F.lit(1), "coords").alias("spot_too")]
    return few(rows, axes).select("cloud_id", "point_id", "m", "ingested_at", *spot, units.alias("units"))


def bins(level: Column) -> Column:
    """Bins of the attributes at a level of the ladder of grids, for a cloud of ``dim`` coordinates; from the first uncut one on they are left out.

    A level more gives one bin more to one attribute, in turn.
    """
    n = F.col("dim") + 1
    cut = F.sequence(F.lit(0).cast("bigint"), F.least(level, n).cast("bigint") - 1)
    return F.when(level > 0, F.transform(cut, lambda i: 1 + F.floor((level + n - 1 - i) / n))).otherwise(F.array().cast("array<bigint>"))


def with_cells(rows: DataFrame, wanted: DataFrame, levels: list[Column]) -> DataFrame:
    """Adds ``cells``, the cell of a point at each of the levels."""
    grids = wanted.select("cloud_id", F.array(*[bins(x) for x in levels]).alias("grids"))
    cell = lambda grid: F.xxhash64(F.zip_with(F.slice("units", 1, F.size(grid)), grid, lambda u, b: F.floor(u * b)))
    return few(rows, grids).withColumn("cells", F.transform("grids", cell)).drop("grids")


def finest_levels(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted`` with ``level``: the finest level tried at which no more than about ``m`` cells of the cloud are filled.

    Powers of two are tried first, then the levels from the last that fits to the next, in
    ``STEPS`` parts. The cells of several levels are counted in one pass, without a row a level.
    """

    def count(rows: DataFrame, wanted: DataFrame, levels: list[Column]) -> DataFrame:
        placed = cut_lineage(with_cells(rows, wanted, levels).select("cloud_id", "spot", "cells"))
        distinct = lambda c: F.approx_count_distinct(c, 0.02)
        held = placed.groupBy("cloud_id").agg(distinct("spot").alias("spots"), F.array(*[distinct(F.get("cells", F.lit(i))) for i in range(len(levels))]).alias("held"))
        held = held.join(wanted.select("cloud_id", "m", F.array(*[x.cast("bigint") for x in levels]).alias("levels")), "cloud_id")
        fits = F.transform("levels", lambda x, i: F.when(F.get("held", i) <= F.col("m"), x).otherwise(0))
        last = F.element_at("held", -1)
        return cut_lineage(held.select("cloud_id", F.array_max(fits).alias("level"), ((last <= F.col("m")) & (last < 0.9 * F.col("spots"))).alias("open")))

    left, tried, first = rows, [], 1
    while True:
        seen = count(left, wanted, [F.lit(first << i) for i in range(POWERS)])
        tried.append(seen.select("cloud_id", "level"))
        first <<= POWERS
        if first > LAST_LEVEL or seen.where("open").isEmpty():
            break
        left = left.join(seen.where("open").select("cloud_id"), "cloud_id", "left_semi")
    power = reduce(DataFrame.unionByName, tried).groupBy("cloud_id").agg(F.max("level").alias("power"))
    known = cut_lineage(wanted.join(power, "cloud_id"))
    between = count(rows, known, [F.col("power") + F.floor(F.col("power") * i / STEPS) for i in range(1, STEPS)])
    return known.join(between, "cloud_id").select("cloud_id", "dim", "m", F.greatest("power", "level").alias("level"))


def few(rows: DataFrame, clouds: DataFrame) -> DataFrame:
    """``rows`` joined with one row a cloud, which is broadcast if it is counted to be small; else both sides meet by cloud."""
    clouds = cut_lineage(clouds)
    return rows.join(F.broadcast(clouds) if clouds.count() <= BROADCAST_CLOUDS else clouds, "cloud_id")


def varied_subset(points: DataFrame, clouds: DataFrame) -> DataFrame:
    """``m`` points of each cloud (all, if it has fewer): columns cloud_id, point_id, cell, rank, position.

    A grid over all attributes, the intensity and every coordinate, takes one bin more of one
    attribute from level to level. Each cloud is served from the finest level with no more than
    about ``m`` filled cells: points are ranked within their cell, order is by rank and then cell,
    and the first ``m`` stay, so that every cell is served before any is served twice. The order
    within a cell is made in the same way from a grid of twice the level, there from one of four
    times (at least one cut of every attribute), and there copies of a place come after new
    places; hashed order decides between what is left. Of a point delivered again the earliest
    delivery counts; ranges and levels are taken over all deliveries, which have the same
    coordinates. Clouds without valid points give none.
    """
    wanted = cut_lineage(wanted_of(clouds))
    most = int(wanted.agg(F.max("m")).first()[0] or 0)  # no rank beyond it is ever needed
    rows = cut_lineage(attributes(valid_points(points, wanted)))
    level, n = F.col("level"), F.col("dim") + 1
    finer = F.greatest(2 * level, F.floor(n / 2)), F.greatest(4 * level, n)
    rows = with_cells(rows, cut_lineage(finest_levels(rows, wanted)), [level, *finer])
    rows = rows.select("cloud_id", "point_id", "m", "ingested_at", "spot", "spot_too", *[F.get("cells", F.lit(i)).alias(f"cell{i}") for i in range(3)])
    rows = top_n(rows, ["cloud_id", "point_id"], [F.col("ingested_at").asc_nulls_last(), F.xxhash64("spot", "cell2")], 1).drop("ingested_at")
    mixed = [F.xxhash64("point_id"), F.col("point_id")]
    rows = top_n_ranked(rows, ["cloud_id", "spot", "spot_too"], [F.col("point_id")], most, "rank").where("rank <= m").drop("spot", "spot_too")
    for grid in ("cell2", "cell1", "cell0"):
        rows = rows.withColumnRenamed("rank", "inner")
        rows = top_n_ranked(rows, ["cloud_id", grid], [F.col("inner"), *mixed], most, "rank").where("rank <= m").drop("inner")
    rows = cut_lineage(rows.select("cloud_id", "point_id", "m", F.col("cell0").alias("cell"), "rank"))
    # a rank holds at most one point a cell, so places are found rank by rank and no cloud is sorted whole
    held = rows.groupBy("cloud_id", "rank").agg(F.count(F.lit(1)).alias("held"))
    lower = Window.partitionBy("cloud_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    held = held.select("cloud_id", "rank", F.coalesce(F.sum("held").over(lower), F.lit(0)).alias("lower"))
    placed = rows.join(held, ["cloud_id", "rank"]).where("lower < m")
    within = F.row_number().over(Window.partitionBy("cloud_id", "rank").orderBy("cell"))
    placed = placed.withColumn("position", (F.col("lower") + within).cast("int"))
    return placed.where(F.col("position") <= F.col("m")).select("cloud_id", "point_id", "cell", "rank", "position")
