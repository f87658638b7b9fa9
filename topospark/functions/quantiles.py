"""Exact quantiles by group without gathering a group: counts by bin first, then only the bins that matter."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PIECES = 32  # stretches of about equally many rows in a group
STEPS = 128  # equally wide bins of a stretch


def with_slots(values: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """Adds ``slot``, an order-preserving bin of a value within its group.

    Stretches end at approximate quantiles, so stray values far from the rest leave no bin with
    more than about one in ``PIECES`` of the rows of a group, copies of one value aside. Null lies in
    the first bin, NaN in the last stretch.
    """
    shares = [i / PIECES for i in range(1, PIECES)]
    span = values.groupBy(*keys).agg(
        F.min(value).cast("double").alias("__low"), F.max(value).cast("double").alias("__high"), F.percentile_approx(F.col(value).cast("double"), shares, 1000).alias("__cuts")
    )
    span = span.select(*keys, F.concat(F.array("__low"), "__cuts", F.array("__high")).alias("__edges"))
    passed = F.size(F.filter(F.slice("__edges", 2, PIECES - 1), lambda e: e <= F.col(value)))
    at = values.join(span, keys).withColumn("__piece", F.greatest(F.lit(0), passed))
    low, high = F.get("__edges", F.col("__piece")), F.get("__edges", F.col("__piece") + 1)
    unit = F.when(high > low, (F.col(value) - low) / (high - low)).otherwise(F.lit(0.0))
    step = F.greatest(F.lit(0), F.least(F.lit(STEPS - 1), F.floor(unit * STEPS)))
    return at.withColumn("slot", (F.col("__piece") * STEPS + F.coalesce(step, F.lit(0))).cast("int")).drop("__edges", "__piece")


def at_ranks(values: DataFrame, value: str, ranks: DataFrame, keys: list[str]) -> DataFrame:
    """``ranks`` (keys, rank from 1, and other columns) with the value at each rank of its group."""
    rows = with_slots(values.select(*keys, value), value, keys)
    before = Window.partitionBy(*keys).orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    held = rows.groupBy(*keys, "slot").agg(F.count(F.lit(1)).alias("n")).withColumn("n_before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    wanted = held.join(ranks, keys).where((F.col("n_before") < F.col("rank")) & (F.col("rank") <= F.col("n_before") + F.col("n"))).drop("n")
    bins = wanted.select(*keys, "slot", "n_before").distinct()
    # equal values are one row, however many there are
    alike = rows.join(bins, [*keys, "slot"]).groupBy(*keys, "slot", "n_before", value).agg(F.count(F.lit(1)).alias("n"))
    up_to = F.sum("n").over(Window.partitionBy(*keys, "slot").orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    held_to = alike.withColumn("last", F.col("n_before") + up_to).select(*keys, "slot", value, (F.col("last") - F.col("n")).alias("before"), "last")
    return wanted.drop("n_before").join(held_to, [*keys, "slot"]).where((F.col("before") < F.col("rank")) & (F.col("rank") <= F.col("last"))).drop("slot", "before", "last")


def spots(counts: DataFrame, shares: dict[str, float], keys: list[str]) -> DataFrame:
    """``(keys, name, rank, part)``: the ranks between which each share of ``n`` rows lies, and the part of each."""
    wanted = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), (F.lit(float(p)) * (F.col("n") - 1)).alias("at")) for name, p in shares.items()]))
    at = counts.select(*keys, wanted.alias("w")).select(*keys, "w.name", "w.at")
    beyond = F.col("at") - F.floor("at")
    end = lambda place, part: F.struct((place + 1).cast("bigint").alias("rank"), part.alias("part"))
    ends = F.explode(F.array(end(F.floor("at"), 1 - beyond), end(F.ceil("at"), beyond)))
    return at.select(*keys, "name", ends.alias("e")).select(*keys, "name", "e.rank", "e.part")


def quantiles(values: DataFrame, value: str, shares: dict[str, float], keys: list[str]) -> DataFrame:
    """(keys, one column a share): quantiles with linear interpolation; null and NaN values do not count."""
    rows = values.where(F.col(value).isNotNull() & ~F.isnan(value)).withColumn("__v", F.col(value).cast("double")).select(*keys, "__v")
    n = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    found = at_ranks(rows, "__v", spots(n, shares, keys), keys)
    return found.groupBy(*keys).agg(*[F.sum(F.when(F.col("name") == name, F.col("part") * F.col("__v"))).alias(name) for name in shares])
