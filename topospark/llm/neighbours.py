"""Most similar vectors for every vector: a forest of hash-prefix trees as sorted arrays.

In every tree a point has a long hash string: the bits of its places along some orthogonal
directions, interleaved from the most significant down, so that a common prefix means a common
cell, the longer the smaller. A tree is an array sorted by the string, range-partitioned over
the cluster. Every point descends to its longest prefix in each tree, and all trees then ascend
together, one prefix length at a time, until the prefixes reached hold enough candidates:

1. each tree counts, for every point, how many others share each prefix length with it;
2. the counts of all trees, added up, give the prefix length at which the point has enough;
3. each tree compares the point with those that share at least that prefix, and the best stay.

Strings are shipped alone in step 1; only step 3 ships vectors, once a tree: a candidate's
vector by a join would cost far more, as there are hundreds of candidates a point and tree.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topospark.llm.topn import top_n_ranked
from topospark.operators import knn
from topospark.session import cut_lineage

TREES = 24
BUDGET = 8192  # candidates of a point over all trees, at which the ascent ends
NEAR = {"trees": 12, "budget": 1024}  # enough where only close neighbours count
DIRECTIONS = 16
SAMPLE = 20_000  # rows whose projections set the places of the bits; all rows are indexed
CELLS = 4096
ROWS = 16_384
FOLD = 16
SEED = 20240101


def valid_vectors(points: DataFrame, dim: int, id_column: str = "point_id", vector_column: str = "coords") -> DataFrame:
    """``(id, vector)`` of rows with exactly ``dim`` present and finite items; repeated deliveries of an id count once.

    Of an id delivered with different vectors the smallest vector stays; a null id is dropped.
    """
    rows = points.select(F.col(id_column).alias("id"), F.col(vector_column).cast("array<double>").alias("vector"))
    rows = rows.where(F.col("id").isNotNull() & (F.size("vector") == dim))
    rows = rows.where(F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    return rows.groupBy("id").agg(F.min("vector").alias("vector"))


class Hashes:
    """Directions and value ranges of all trees; strings of rows as whole 64-bit words whose order is that of the strings."""

    def __init__(self, sample: np.ndarray, dim: int, trees: int, rows: int, budget: int) -> None:
        rng = np.random.default_rng(SEED)
        self.wide = min(DIRECTIONS, dim)
        self.directions = [np.linalg.qr(rng.standard_normal((dim, dim)))[0][:, : self.wide] for _ in range(trees)]
        # the share of the sample below each of CELLS equal steps of a direction's range; between two steps it is linear
        self.ranges, self.below = [], []
        for d in self.directions:
            z = sample @ d if len(sample) else np.zeros((1, self.wide))
            low, high = z.min(axis=0), z.max(axis=0)
            step = np.where(high > low, (high - low) / CELLS, 1.0)
            edges = low + step * np.arange(CELLS + 1)[:, None]
            self.ranges.append((low, step))
            self.below.append(np.stack([np.searchsorted(np.sort(z[:, i]), edges[:, i]) / len(z) for i in range(self.wide)]))
        # strings grow with the rows, so that a cell of the whole string holds less than a budget of them
        size = math.log2(max(2, rows))
        self.bits = min(16, max(8, math.ceil(size - math.log2(budget)) + 3, math.ceil((size + 8) / self.wide)))
        self.words = -(-self.wide * self.bits // 64)

    def strings(self, x: np.ndarray, tree: int) -> np.ndarray:
        """Words of the rows of ``x``, one column a word, the first the most significant."""
        low, step = self.ranges[tree]
        at = np.clip((x @ self.directions[tree] - low) / step, 0, CELLS - 1e-6)
        cell = at.astype(np.int32)
        level = np.empty(at.shape, dtype=np.uint16)
        top = (1 << self.bits) - 1
        for d, below in enumerate(self.below[tree]):
            c = cell[:, d]
            unit = below[c] + (at[:, d] - c) * np.diff(below)[c]
            level[:, d] = np.minimum(unit * (top + 1), top)
        bit = np.zeros((len(x), self.words * 64), dtype=np.uint8)
        for b in range(self.bits):
            bit[:, b * self.wide : (b + 1) * self.wide] = (level >> np.uint16(self.bits - 1 - b)) & np.uint16(1)
        words = np.packbits(bit, axis=1).view(">u8").astype(np.uint64)
        return (words ^ np.uint64(1 << 63)).view(np.int64)


def prefix_with_previous(words: list[np.ndarray]) -> np.ndarray:
    """Length of the prefix each row shares with the row before; -1 for the first."""
    n = len(words[0])
    length = np.full(n, -1, dtype=np.int16)
    if n < 2:
        return length
    shared, open_ = np.zeros(n - 1, dtype=np.int16), np.ones(n - 1, dtype=bool)
    for w in words:
        differ = (w[1:] ^ w[:-1]).view(np.uint64)
        high = (differ >> np.uint64(32)).astype(np.float64)
        low = (differ & np.uint64(0xFFFFFFFF)).astype(np.float64)
        same = 64 - np.where(high > 0, np.frexp(high)[1] + 32, np.frexp(low)[1])
        shared += np.where(open_, same, 0).astype(np.int16)
        open_ &= same == 64
    length[1:] = shared
    return length


def count_by_prefix(previous: np.ndarray, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and packed ``length << 16 | rows first met at that length`` of each row, up to ``budget`` rows a tree."""
    n, deepest = len(previous), int(previous.max(initial=0))
    held = np.ones((deepest + 2, n), dtype=np.uint16)
    rows = np.arange(n)
    for length in range(deepest + 1):
        run = np.cumsum(previous[rows] < length)
        size = np.bincount(run)[run]
        held[length, rows] = np.minimum(size, budget)
        rows = rows[size > 1]
    first = held[:-1] - held[1:]
    row, length = np.nonzero(first.T)
    offsets = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=n))])
    return offsets, (length.astype(np.int32) << 16) | first[length, row].astype(np.int32)


def common_depth(counts: pa.Table, budget: int, trees: int) -> pa.RecordBatch:
    """``(id, depth, more)``: all trees ascend together, from the longest prefix of any to the length that fills the budget.

    A prefix of ``depth`` bits is the last at which they hold less than the budget; one bit
    shorter each tree may give ``more`` to each side, twice its part of what is missing.
    """
    ids = counts.column("id").to_numpy()
    lists = counts.column("counts").combine_chunks()
    packed = lists.flatten().to_numpy()
    point = np.searchsorted(ids, ids)  # ids are in order
    point = np.repeat(point, lists.value_lengths().to_numpy())
    order = np.argsort((point.astype(np.int64) << 32) - packed, kind="stable")
    point, length, met = point[order], packed[order] >> 16, packed[order] & 65_535
    total = np.cumsum(met)
    begin = np.searchsorted(point, point)
    total -= np.where(begin > 0, total[begin - 1], 0)
    distinct = np.unique(ids)
    first = np.searchsorted(ids, distinct)
    depth, more = np.zeros(len(distinct), dtype=np.int32), np.zeros(len(distinct), dtype=np.int32)
    full = np.flatnonzero((total >= budget) & (total - met < budget))  # at most one a point
    row = np.searchsorted(first, point[full])
    # what the longer prefixes hold: the total before the first entry of this length
    start = np.searchsorted((point << 16) - length, (point[full] << 16) - length[full])
    longer = np.where(start > begin[full], total[start - 1], 0)
    depth[row], more[row] = length[full] + 1, -(-2 * (budget - longer) // trees)
    return pa.RecordBatch.from_arrays([pa.array(distinct), pa.array(depth), pa.array(more)], ["id", "depth", "more"])


def whole_points(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of rows in order of ``id``, no id in two of them."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        ids = batch.column("id").to_numpy()
        if held and len(ids) and ids[-1] != held[0].column("id")[0].as_py():
            whole = int(np.searchsorted(ids, ids[-1]))  # the last point may go on in the next batch
            yield pa.Table.from_batches([*held, batch.slice(0, whole)])
            held, batch = [], batch.slice(whole)
        held.append(batch)
    if held:
        yield pa.Table.from_batches(held)


def best_of_trees(matches: pa.Table, k: int) -> pa.RecordBatch:
    """The ``k`` nearest of each point over all trees, equal distances by id."""
    ids = matches.column("id").to_numpy()
    lists = matches.column("neighbours").combine_chunks()
    d2, other = (f.to_numpy() for f in lists.flatten().flatten())
    owner = np.repeat(np.searchsorted(ids, ids), lists.value_lengths().to_numpy())
    order = np.lexsort((other, d2, owner))
    owner, d2, other = owner[order], d2[order], other[order]
    new = np.append(True, (owner[1:] != owner[:-1]) | (d2[1:] != d2[:-1]) | (other[1:] != other[:-1])) if len(owner) else np.zeros(0, dtype=bool)
    owner, d2, other = owner[new], d2[new], other[new]
    kept = np.arange(len(owner)) - np.searchsorted(owner, owner) < k
    owner, d2, other = owner[kept], d2[kept], other[kept]
    distinct, first = np.unique(owner, return_index=True)
    offsets = pa.array(np.append(first, len(owner)).astype(np.int32))
    items = pa.StructArray.from_arrays([pa.array(d2), pa.array(other)], ["d2", "id"])
    return pa.RecordBatch.from_arrays([pa.array(ids[distinct]), pa.ListArray.from_arrays(offsets, items)], ["id", "neighbours"])


def reach_of(previous: np.ndarray, depth: np.ndarray, more: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the rows that share a prefix of ``depth``, and of up to ``more`` to each side that share one less."""
    n = len(previous)
    low, high = np.zeros(n, dtype=np.int64), np.full(n, n, dtype=np.int64)
    for d in np.unique(depth).tolist():
        rows = np.flatnonzero(depth == d)
        for length, widen in ((d, None), (d - 1, more[rows])):
            ends = np.append(np.flatnonzero(previous < max(length, 0)), n)
            at = np.searchsorted(ends, rows, side="right")
            if widen is None:
                low[rows], high[rows] = ends[at - 1], ends[at]
            else:
                low[rows], high[rows] = np.maximum(ends[at - 1], low[rows] - widen), np.minimum(ends[at], high[rows] + widen)
    return low, high


def nearest_within(x: np.ndarray, ids: np.ndarray, rows: range, low: np.ndarray, high: np.ndarray, k: int, most: float) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` nearest of each row among those in its bounds: ids and exact squared distances, equal ones by id.

    Products in single precision find what may be near enough, with room for their rounding;
    only that is measured exactly.
    """
    names = np.full((len(rows), k), np.iinfo(np.int64).max)
    near = np.full((len(rows), k), np.inf)
    single = x.astype(np.float32)
    squares = np.einsum("ij,ij->i", single, single)
    begin = rows.start
    while begin < rows.stop:
        end = min(rows.stop, begin + max(64, min(512, int(high[begin] - low[begin]) // 2)))
        own = np.arange(begin, end)
        a, b = int(low[own].min()), int(high[own].max())
        columns = -(-(b - a) // FOLD)
        d2 = np.full((len(own), columns * FOLD), np.inf, dtype=np.float32)
        d2[:, : b - a] = squares[own, None] + squares[None, a:b] - 2 * (single[own] @ single[a:b].T)
        at = np.arange(a, a + columns * FOLD)
        d2[(at < low[own, None]) | (at >= high[own, None])] = np.inf
        d2[own - begin, own - a] = np.inf
        slack = 4e-6 * (squares[own] + squares[a:b].max())
        # each column of the folded table holds a different neighbour, so its k-th minimum bounds the k-th distance
        least = d2.reshape(len(own), FOLD, columns).min(axis=1)
        bound = np.partition(least, k - 1, axis=1)[:, k - 1] if columns >= k else np.full(len(own), np.inf, dtype=np.float32)
        bound = np.minimum(bound, np.float32(min(most, 3e38))) + 2 * slack
        row, column = np.nonzero(d2 <= bound[:, None])
        gap = x[begin + row] - x[a + column]
        exact = np.einsum("ij,ij->i", gap, gap)
        kept = exact <= most
        row, exact, other = row[kept], exact[kept], ids[a + column[kept]]
        order = np.lexsort((other, exact, row))
        row = row[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        best = place < k
        row, order, place = row[best] + begin - rows.start, order[best], place[best]
        names[row, place], near[row, place] = other[order], exact[order]
        begin = end
    return names, near


def stretches(batches: Iterator[pa.RecordBatch], context: int) -> Iterator[tuple[pa.Table, range]]:
    """Rows of one tree in order, with up to ``context`` rows before and after those of the range."""
    held: list[pa.RecordBatch] = []
    tree, ready = None, 0

    def whole() -> pa.Table:
        return pa.Table.from_batches(held).combine_chunks()

    for batch in batches:
        trees = batch.column(0).to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(trees)) + 1).tolist(), len(trees)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if a == b:
                continue
            if trees[a] != tree:
                if held:
                    table = whole()
                    yield table, range(ready, table.num_rows)
                held, tree, ready = [], trees[a], 0
            held.append(batch.slice(a, b - a))
            n = sum(h.num_rows for h in held)
            if n - ready >= ROWS + 2 * context:
                table = whole()
                yield table, range(ready, n - context)
                keep = max(0, n - 2 * context)
                held, ready = table.slice(keep).combine_chunks().to_batches(), n - context - keep
    if held:
        table = whole()
        yield table, range(ready, table.num_rows)


def nearest(vectors: DataFrame, dim: int, k: int = 5, max_distance: float | None = None, trees: int = TREES, budget: int = BUDGET) -> DataFrame:
    """``(id, neighbours array<struct<d2 double, id bigint>>)`` of distinct vectors ``(id, vector)``, by the forest.

    A point is compared with all that share its prefix at the length where the trees together
    hold ``budget`` candidates (at most 65,535); of the nodes one bit shorter, which hold more,
    each tree gives its part of what is missing, nearest in the array first. Value ranges of the directions
    come from a sample of at most ``SAMPLE`` rows; every row is indexed in every tree. Distances
    that overflow count as none. ``vectors`` is read several times and should be a written table.
    """
    spark = vectors.sparkSession
    budget = min(budget, 65_535)
    single = F.min(F.forall("vector", lambda x: x.cast("float").cast("double") == x).cast("int"))
    size = vectors.agg(F.count(F.lit(1)).alias("n"), single.alias("single")).first()
    sample = vectors.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("vector").collect()  # the documented bound
    hashes = Hashes(np.array([r.vector for r in sample], dtype=np.float64).reshape(-1, dim), dim, trees, size.n, budget)
    item = "float" if size.single else "double"  # half the shuffle, where nothing is lost
    most = np.inf if max_distance is None else max_distance**2
    words = [f"w{i}" for i in range(hashes.words)]
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    shared = spark.sparkContext.broadcast(hashes)  # trees x directions x cells, whatever the rows

    def matrix(column: pa.Array) -> np.ndarray:
        return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(-1, dim)

    def sorted_trees(rows: DataFrame, keep: list[str]) -> DataFrame:
        def plant(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    x = matrix(batch.column("vector"))
                    for t in range(trees):
                        found = shared.value.strings(x, t)
                        columns = [pa.array(np.full(len(x), t, dtype=np.int32)), *[pa.array(np.ascontiguousarray(w)) for w in found.T]]
                        yield pa.RecordBatch.from_arrays([*columns, *[batch.column(c) for c in keep]], ["tree", *words, *keep])

        columns = ["tree int", *[f"{w} bigint" for w in words], *[f"{c} {rows.schema[c].dataType.simpleString()}" for c in keep]]
        order = ["tree", *words, "id"]  # the id divides a string that many rows share
        return rows.mapInArrow(plant, ", ".join(columns)).repartitionByRange(parts, *order).sortWithinPartitions(*order)

    def descend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, rows in stretches(batches, budget):
            previous = prefix_with_previous([table.column(w).to_numpy() for w in words])
            offsets, counts = count_by_prefix(previous, budget)
            offsets = offsets[rows.start : rows.stop + 1]
            counts = counts[offsets[0] : offsets[-1]]
            lists = pa.ListArray.from_arrays(pa.array((offsets - offsets[0]).astype(np.int32)), pa.array(counts))
            yield pa.RecordBatch.from_arrays([table.column("id").slice(rows.start, len(rows)).combine_chunks(), lists], ["id", "counts"])

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_points(batches):
            yield common_depth(table, budget, trees)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_points(batches):
            yield best_of_trees(table, k)

    def ascend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, rows in stretches(batches, budget):
            previous = prefix_with_previous([table.column(w).to_numpy() for w in words])
            ids, x = table.column("id").to_numpy(), matrix(table.column("vector").combine_chunks())
            low, high = reach_of(previous, table.column("depth").to_numpy(), table.column("more").to_numpy())
            with np.errstate(over="ignore", invalid="ignore"):
                other, d2 = nearest_within(x, ids, rows, low, high, k, most)
            good = np.isfinite(d2)
            count = good.sum(axis=1)
            has = count > 0
            offsets = np.concatenate([[0], np.cumsum(count[has])]).astype(np.int32)
            items = pa.StructArray.from_arrays([pa.array(d2[good]), pa.array(other[good])], ["d2", "id"])
            yield pa.RecordBatch.from_arrays([pa.array(ids[rows.start : rows.stop][has]), pa.ListArray.from_arrays(pa.array(offsets), items)], ["id", "neighbours"])

    rows = vectors.select(F.col("id").cast("bigint"), F.col("vector").cast(f"array<{item}>").alias("vector"))
    counted = sorted_trees(rows, ["id"]).mapInArrow(descend, "id bigint, counts array<int>")
    # at most one number a tree and length of each point
    depths = counted.repartition(parts, "id").sortWithinPartitions("id").mapInArrow(settle, "id bigint, depth int, more int")
    placed = sorted_trees(cut_lineage(rows.join(depths, "id")), ["id", "depth", "more", "vector"])
    matches = placed.mapInArrow(ascend, "id bigint, neighbours array<struct<d2: double, id: bigint>>")
    # one row a tree and point, so no group is large
    return matches.repartition(parts, "id").sortWithinPartitions("id").mapInArrow(merge, "id bigint, neighbours array<struct<d2: double, id: bigint>>")


def nearest_points(points: DataFrame, dim: int, k: int = 5, max_distance: float | None = None, **index: int) -> DataFrame:
    """``(id, d2, other)``: the ``k`` nearest other points of every point, equal distances to the smaller id.

    ``d2`` is the squared Euclidean distance. Exact copies are one entry of the index; among
    themselves they are at distance 0, nearest first by id, and a place with more than ``k``
    copies needs no search. Points without a neighbour (a lone point, or none within
    ``max_distance``) have no rows; points that are not valid vectors have none either.
    """
    # a hash before the vector, as a short key to sort by
    vectors = cut_lineage(valid_vectors(points, dim).withColumn("spot", F.xxhash64("vector")))
    copies = top_n_ranked(vectors, ["spot", "vector"], [F.col("id").asc()], k + 1, "copy")
    places = copies.groupBy("spot", "vector").agg(F.min("id").alias("place"), F.sort_array(F.collect_list("id")).alias("ids"))  # at most k + 1 ids
    places = cut_lineage(places)  # every step of the forest reads them
    found = nearest(places.select(F.col("place").alias("id"), "vector"), dim, k, max_distance, **index)
    pool = found.select(F.col("id").alias("place"), F.explode("neighbours").alias("n")).select("place", F.col("n.d2").alias("d2"), F.col("n.id").alias("there"))
    at = places.select(F.col("place").alias("there"), F.col("ids").alias("there_ids"))
    pool = pool.join(at, "there").select("place", F.explode(F.transform("there_ids", lambda i: F.struct(F.col("d2"), i.alias("id")))).alias("n"))
    pool = pool.groupBy("place").agg(F.slice(F.array_sort(F.collect_list("n")), 1, k).alias("around"))  # at most k * (k + 1)
    own = F.transform("ids", lambda i: F.struct(F.lit(0.0).alias("d2"), i.alias("id")))
    near = places.join(pool, "place", "left").select("spot", "vector", F.concat(own, F.coalesce("around", F.array().cast("array<struct<d2:double,id:bigint>>"))).alias("near"))
    rows = vectors.join(near, ["spot", "vector"]).select("id", F.explode(F.slice(F.filter("near", lambda n: n["id"] != F.col("id")), 1, k)).alias("n"))
    return rows.select("id", F.col("n.d2").alias("d2"), F.col("n.id").alias("other"))


def close_pairs(points: DataFrame, dim: int, k: int = 5, max_distance: float = 1.0, **index: int) -> DataFrame:
    """``(point_a, point_b)``, smaller first, each once: one is among the other's ``k`` nearest and not further than ``max_distance``."""
    rows = nearest_points(points, dim, k, max_distance, **(NEAR | index))
    ends = rows.select(F.least("id", "other").alias("point_a"), F.greatest("id", "other").alias("point_b"))
    return ends.distinct()


def recall(points: DataFrame, dim: int, k: int = 5, every: int = 20, **index: int) -> DataFrame:
    """One row ``(queries, neighbours, found)``: of the ``k`` true neighbours of each point whose id is divisible by ``every``, those that ``nearest_points`` gives.

    The truth is brute force of the queries against all points, block by block. Of equally distant
    neighbours the smaller ids are the true ones.
    """
    vectors = valid_vectors(points, dim).select(F.lit(0).alias("cloud_id"), F.col("id").alias("point_id"), F.col("vector").alias("coords"))
    vectors = cut_lineage(vectors)
    exact = knn.ranked(knn.nearest(vectors.where(F.col("point_id") % every == 0), vectors, k, exclude_self=True))
    true = exact.select(F.col("point_id").alias("id"), F.col("target_id").alias("other"))
    given = nearest_points(points, dim, k, **index).where(F.col("id") % every == 0).select("id", "other", F.lit(1).alias("hit"))
    both = true.join(given, ["id", "other"], "left")
    return both.agg(F.count_distinct("id").alias("queries"), F.count(F.lit(1)).alias("neighbours"), F.count("hit").alias("found"))
