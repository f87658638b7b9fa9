"""The N highest-scoring items of every group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_n(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each group under ``order``.

    The rank filter lets Spark prune to ``n`` rows per group in every task before the shuffle,
    and again after it, so a group of millions of rows never meets in one task. ``order`` should
    end in an identifier to make ties definite. Null keys form a group; no rows give none.
    """
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__rank", rank).where(F.col("__rank") <= n).drop("__rank")


def top_n_ranked(df: DataFrame, keys: list[str], order: list, n: int, rank: str) -> DataFrame:
    """As ``top_n``, with the rank kept in a column."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(rank) <= n)


def latest_delivery(df: DataFrame, keys: list[str], at: str, content: list[str]) -> DataFrame:
    """One row per key, the one received last; null times come first, equal times go by content."""
    order = [F.col(at).desc_nulls_last(), F.xxhash64(*content)]
    return top_n(df, keys, order, 1)


def top_lifetimes(features: DataFrame, n: int = 10) -> DataFrame:
    """Places of the ``n`` longest lifetimes of every (seq, frame, dim): columns chunk_no, pos_no and lifetime besides.

    Null, NaN, infinite and negative items do not count, nor do null or empty arrays; of equal
    lifetimes the smaller (chunk_no, pos_no) is first. Only the latest delivery of a chunk counts,
    a repeat counts once. Null keys are keys of their own. Other columns are not read.
    """
    arrays = ["h0_lifetimes", "h1_lifetimes", "h2_lifetimes"]
    chunks = latest_delivery(
        features.select("seq", "frame", "chunk_no", "received_at", *arrays), ["seq", "frame", "chunk_no"], "received_at", arrays
    )
    dims = F.array(*[F.struct(F.lit(d).alias("dim"), F.col(a).alias("lifetimes")) for d, a in enumerate(arrays)])
    places = (
        chunks.select("seq", "frame", "chunk_no", F.inline(dims))
        .select("seq", "frame", "dim", "chunk_no", F.posexplode("lifetimes").alias("pos_no", "lifetime"))
        .where((F.col("lifetime") >= 0) & (F.col("lifetime") < float("inf")))
    )
    order = [F.col("lifetime").desc(), F.col("chunk_no").asc_nulls_first(), F.col("pos_no").asc()]
    return top_n(places, ["seq", "frame", "dim"], order, n)
