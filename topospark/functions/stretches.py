"""Windows over long groups: a group is cut into stretches of its order, each with the rows it must look back on."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

STRETCH = 1 << 20
EDGES = 1024  # the most stretches of a group


def cut(rows: DataFrame, key: str, order: list[str]) -> DataFrame | None:
    """``rows`` with ``__stretch``, growing with the first order column; None if no group is over ``STRETCH`` rows.

    Edges are approximate quantiles of the group, so stretches hold about as many rows each
    whatever the distances along the order; rows equal in the first order column stay together.
    Nulls of the order column belong to the first stretch, as they sort first.
    """
    if rows.groupBy(key).count().where(F.col("count") > STRETCH).isEmpty():
        return None
    at = F.col(order[0]).cast("double")
    parts = F.least(F.lit(EDGES), F.ceil(F.count(F.lit(1)) / STRETCH)).cast("int").alias("__parts")
    quantiles = F.percentile_approx(at, [i / EDGES for i in range(1, EDGES)], 10_000).alias("__q")
    edges = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.col("__parts") - 1)), lambda j: F.get("__q", F.floor(j * EDGES / F.col("__parts")).cast("int") - 1))
    cuts = rows.groupBy(F.col(key).alias("__key")).agg(parts, quantiles).select("__key", F.when(F.col("__parts") > 1, edges).otherwise(F.array().cast("array<double>")).alias("__edges"))
    placed = rows.join(cuts, F.col(key).eqNullSafe(F.col("__key")))
    place = F.size(F.filter("__edges", lambda e: e <= at))
    return placed.withColumn("__stretch", F.when(at.isNotNull(), place).otherwise(0).cast("bigint")).drop("__key", "__edges")


def with_rows_before(placed: DataFrame, key: str, order: list[str], reach: int) -> DataFrame:
    """Adds to each stretch the last ``reach`` rows before it, with ``__own`` false.

    They come from the last ``reach`` rows of the stretches before, which Spark's group limit
    finds before the shuffle; at most ``reach`` stretches can need a row, as none is empty.
    """
    sizes = placed.groupBy(F.col(key).alias("__key"), F.col("__stretch").alias("__s")).agg(F.count(F.lit(1)).alias("__n"))
    along = Window.partitionBy("__key").orderBy("__s")
    sizes = sizes.withColumn("__before", F.coalesce(F.sum("__n").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    later = F.collect_list(F.struct(F.col("__s").alias("s"), F.col("__before").alias("b"))).over(along.rowsBetween(1, reach))
    sizes = sizes.select("__key", "__s", (F.col("__before") + F.col("__n")).alias("__end"), later.alias("__later"))
    from_end = F.row_number().over(Window.partitionBy(key, "__stretch").orderBy(*[F.col(c).desc_nulls_last() for c in order]))
    tails = placed.withColumn("__r", from_end).where(F.col("__r") <= reach)
    tails = tails.join(sizes, F.col(key).eqNullSafe(F.col("__key")) & (F.col("__stretch") == F.col("__s")))
    needed = F.filter("__later", lambda x: x["b"] - F.col("__end") + F.col("__r") <= reach)
    tails = tails.withColumn("__stretch", F.explode(F.transform(needed, lambda x: x["s"]))).drop("__key", "__s", "__end", "__later", "__r")
    return placed.withColumn("__own", F.lit(True)).unionByName(tails.withColumn("__own", F.lit(False)))


def looking_back(rows: DataFrame, key: str, order: list[str], reach: int, add: Callable[[DataFrame, WindowSpec], DataFrame]) -> DataFrame:
    """``add(rows, window)`` for an ``add`` whose values depend on a row and the ``reach`` rows before it.

    No task sorts more than one stretch of a group, however large the group is.
    """
    placed = cut(rows, key, order)
    if placed is None:
        return add(rows, Window.partitionBy(key).orderBy(*order))
    return add(with_rows_before(placed, key, order, reach), Window.partitionBy(key, "__stretch").orderBy(*order)).where("__own").drop("__own", "__stretch")


def running_sum(rows: DataFrame, key: str, order: list[str], value: str, name: str) -> DataFrame:
    """Adds ``name``: the sum of ``value`` from the first row of the group to this one, by stretches and within them."""
    to_here = lambda w: F.sum(value).over(w.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    placed = cut(rows, key, order)
    if placed is None:
        return rows.withColumn(name, to_here(Window.partitionBy(key)))
    sums = placed.groupBy(F.col(key).alias("__key"), F.col("__stretch").alias("__s")).agg(F.sum(value).alias("__sum"))
    before = F.sum("__sum").over(Window.partitionBy("__key").orderBy("__s").rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.select("__key", "__s", F.coalesce(before, F.lit(0)).alias("__before"))
    joined = placed.join(sums, F.col(key).eqNullSafe(F.col("__key")) & (F.col("__stretch") == F.col("__s")))
    total = to_here(Window.partitionBy(key, "__stretch")) + F.col("__before")
    return joined.withColumn(name, total).drop("__stretch", "__key", "__s", "__before")
