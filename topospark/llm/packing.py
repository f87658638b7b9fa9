"""Filling containers of fixed capacity under a controlled mixture of sources.

Rows are spread over shards of a bounded number of tokens by a hash of their content id, so
no source, however large, meets in one task. Within a shard a deficit round-robin over the
source queues opens one container after another: each container credits every source its
share of the capacity, the source furthest behind gives its largest item that still fits.
Credit carries from container to container, and from shard to shard: what the shards before
have given of each source is known from sums, before anything is packed. The mixture holds along
the way; a single container holds few items, so its own mixture is only as near as they allow.
"""

from __future__ import annotations

import heapq
from bisect import bisect_right

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SHARD_TOKENS = 1 << 22
BUCKETS = 4096


def cut_oversized(sizes: DataFrame, capacity: int) -> DataFrame:
    """One row per item: a text over the capacity gives full items and one remainder, any other itself."""
    n = F.col("n_tokens")
    starts = F.sequence(F.lit(0).cast("bigint"), n - 1, F.lit(capacity).cast("bigint"))
    items = sizes.where(n > 0).select("*", F.posexplode(starts).alias("piece_no", "token_start"))
    return items.withColumn("size", F.least(n - F.col("token_start"), F.lit(capacity)).cast("int")).drop("n_tokens")


def fill(items: pd.DataFrame, capacity: int) -> pd.DataFrame:
    """Containers for the items of one shard (index from 0): container and offset of each row."""
    queues: dict = {}
    frame = items.sort_values(["size", "key", "piece_no"], kind="stable")
    for source, own in frame.groupby("source", sort=True):
        queues[source] = (own["size"].tolist(), own.index.tolist())
    share = {s: float(items.at[q[1][0], "share"]) for s, q in queues.items()}
    credit = {s: float(items.at[q[1][0], "carried"]) for s, q in queues.items()}
    place, at = np.zeros(len(items), dtype=np.int64), np.zeros(len(items), dtype=np.int32)
    number = 0
    while queues:
        room, used = capacity, 0
        for s in queues:
            credit[s] += share[s] * capacity
        waiting = [(-credit[s], s) for s in queues]
        heapq.heapify(waiting)
        while waiting and room:
            _, s = heapq.heappop(waiting)
            sizes, rows = queues[s]
            i = bisect_right(sizes, room) - 1
            if i < 0:
                continue  # nothing of this source fits the rest of this container
            size, row = sizes.pop(i), rows.pop(i)
            place[row], at[row] = number, used
            used, room, credit[s] = used + size, room - size, credit[s] - size
            if sizes:
                heapq.heappush(waiting, (-credit[s], s))
            else:
                del queues[s]
        number += 1
    return pd.DataFrame({"container_no": place, "at": at})


def sums_before(rows: DataFrame, keys: list[str], order: str, value: str, name: str) -> DataFrame:
    """Adds ``name``, the sum of ``value`` over the rows of the same keys with a smaller ``order`` (whole numbers from 0).

    Sums of at most ``BUCKETS`` runs of the order come first, so no window holds more rows than
    that of one key, or more than one run.
    """
    size = rows.agg(F.ceil((F.max(order) + 1) / BUCKETS).cast("bigint").alias("size")).first().size or 1  # one number
    rows = rows.withColumn("__run", F.floor(F.col(order) / size))
    earlier = lambda by, along: F.coalesce(F.sum(value if along == order else "__held").over(Window.partitionBy(*by).orderBy(along).rangeBetween(Window.unboundedPreceding, -1)), F.lit(0))
    held = rows.groupBy(*keys, "__run").agg(F.sum(value).alias("__held")).withColumn("__lower", earlier(keys, "__run")).drop("__held")
    inside = rows.withColumn("__inside", earlier([*keys, "__run"], order))
    return inside.join(held.hint("merge"), [*keys, "__run"]).withColumn(name, F.col("__lower") + F.col("__inside")).drop("__run", "__lower", "__inside")


def pack(
    sizes: DataFrame,
    capacity: int = 2048,
    id_column: str = "doc_id",
    source_column: str = "source",
    shard_tokens: int = SHARD_TOKENS,
    shares: dict[str | None, float] | None = None,
) -> DataFrame:
    """Places rows of ``(id, source, n_tokens)`` into containers of ``capacity`` tokens.

    Result: id, source, ``piece_no``, ``token_start``, ``n_tokens`` (of the piece),
    ``container_id`` and ``offset`` within it. Only an item over the capacity is divided, into
    full pieces and one remainder. A row of no tokens takes no room: one row with null container
    and offset. A null source is a source of its own; rows that repeat are each placed. The
    shares of the mixture are ``shares`` (a source it does not name has 0 and comes where
    nothing else fits or is left), by default those of the sources in all tokens. All items are
    placed whatever the shares, so a source that is used up leaves its part to the others.
    """
    base = sizes.select(
        F.col(id_column).alias("key"), F.col(source_column).cast("string").alias("source"), F.coalesce("n_tokens", F.lit(0)).cast("bigint").alias("n_tokens")
    )
    total = base.agg(F.sum("n_tokens").alias("total")).first().total or 0  # one number
    if shares is None:
        mixture = base.where("n_tokens > 0").groupBy("source").agg((F.sum("n_tokens") / F.lit(max(1, total))).alias("share"))
        mixture = mixture.select(F.coalesce("source", F.lit("\0")).alias("source"), "share")
    else:
        whole = sum(shares.values())
        mixture = base.sparkSession.createDataFrame([("\0" if k is None else k, v / whole) for k, v in shares.items()], "source string, share double")
    items = cut_oversized(base, capacity).withColumn("source", F.coalesce("source", F.lit("\0")))
    shard = F.pmod(F.abs(F.xxhash64("key", "piece_no", "size")), F.lit(max(1, -(-total // shard_tokens))))
    items = items.join(mixture, "source", "left").fillna(0.0, ["share"]).withColumn("shard", shard)
    given = items.groupBy("shard", "source", "share").agg(F.sum("size").alias("given"))
    own = sums_before(given, ["source"], "shard", "given", "own_before")
    before = given.groupBy("shard").agg(F.sum("given").alias("given"))
    before = sums_before(before.withColumn("all", F.lit(0)), ["all"], "shard", "given", "all_before").select("shard", "all_before")
    carried = own.join(before.hint("merge"), "shard").select("shard", "source", (F.col("share") * F.col("all_before") - F.col("own_before")).alias("carried"))
    # grows with the shards, so it is never broadcast
    ready = items.join(carried.hint("merge"), ["shard", "source"]).select("shard", "key", "source", "piece_no", "token_start", "size", "share", "carried")
    key_type = base.schema["key"].dataType.simpleString()

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.reset_index(drop=True)
        return pd.concat([group[["shard", "key", "source", "piece_no", "token_start", "size"]], fill(group, capacity)], axis=1)

    schema = f"shard bigint, key {key_type}, source string, piece_no int, token_start bigint, size int, container_no bigint, at int"
    placed = ready.groupBy("shard").applyInPandas(run, schema)
    named = placed.select(
        F.col("key").alias(id_column),
        F.when(F.col("source") != "\0", F.col("source")).alias(source_column),
        "piece_no", "token_start", F.col("size").alias("n_tokens"),
        F.shiftleft("shard", 32).bitwiseOR(F.col("container_no")).alias("container_id"), F.col("at").alias("offset"),
    )
    empty = base.where("n_tokens <= 0").select(
        F.col("key").alias(id_column), F.col("source").alias(source_column),
        F.lit(0).alias("piece_no"), F.lit(0).cast("bigint").alias("token_start"), F.lit(0).alias("n_tokens"),
        F.lit(None).cast("bigint").alias("container_id"), F.lit(None).cast("int").alias("offset"),
    )
    return named.unionByName(empty)
