"""Distance joins: nearest landmarks, nearest neighbours, density.

Points and targets of a cloud meet in blocks of about ``BLOCK`` rows, so a cloud of any size is
spread over many tasks and neither side is broadcast. Blocks of a large cloud are cells of a grid.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from topospark.functions.vectors import distance
from topospark.session import cut_lineage

BLOCK = 8192
AXES = 3  # axes of the grid over a large cloud
EDGES = 256  # quantiles of an axis of which its edges are taken
CHUNK = 1 << 22  # distances held at once


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks()
    values = flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    return values.reshape(len(flat), -1) if len(flat) else values.reshape(0, 0)


def _sides(left: DataFrame, right: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides under names of their own, also where they come from one table."""
    return tuple(df.select(*[F.col(c).alias(f"{side}_{c}") for c in df.columns]) for side, df in (("l", left), ("r", right)))


def _meet(left: DataFrame, right: DataFrame):
    """Blocks of points with blocks of targets."""
    block = lambda side: [f"{side}_{c}" for c in ("cloud_id", "pb", "tb")]
    return left.groupBy(*block("l")).cogroup(right.groupBy(*block("r")))


def squared_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances by direct differences, summed in the order of the axes."""
    out = np.zeros((len(a), len(b)))
    for axis in range(a.shape[1]):
        gap = a[:, axis, None] - b[None, :, axis]
        out += gap * gap
    return out


def k_smallest(d2: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` smallest of each row, equal ones by id."""
    k = min(k, d2.shape[1])
    if d2.shape[1] > 4 * k:
        edge = np.partition(d2, k - 1, axis=1)[:, k - 1]
        rows = [np.flatnonzero(d2[i] <= edge[i]) for i in range(len(d2))]
        return np.stack([c[np.lexsort((ids[c], d2[i, c]))[:k]] for i, c in enumerate(rows)]) if rows else np.zeros((0, k), dtype=int)
    return np.lexsort((np.broadcast_to(ids, d2.shape), d2), axis=1)[:, :k]


def _grids(t: DataFrame, sizes: DataFrame) -> DataFrame:
    """``(cloud_id, grid)``: for the axes of widest spread the edges of equally filled bins, so that a cell holds about a block of targets."""
    axes = t.select("cloud_id", F.posexplode("at").alias("axis", "x")).groupBy("cloud_id", "axis")
    axes = axes.agg(F.stddev_pop("x").alias("s"), F.percentile_approx("x", [i / EDGES for i in range(1, EDGES)], 10_000).alias("q"))
    widest = F.row_number().over(Window.partitionBy("cloud_id").orderBy(F.col("s").desc(), "axis"))
    axes = axes.withColumn("r", widest).where(F.col("r") <= AXES).groupBy("cloud_id").agg(F.collect_list(F.struct("axis", "q")).alias("axes"))
    side = F.least(F.lit(EDGES), F.ceil(F.pow(F.col("t_n") / BLOCK, 1 / F.size("axes")))).cast("int")
    grid = axes.join(sizes.select("cloud_id", "t_n"), "cloud_id").withColumn("side", side)
    inner = lambda q: F.when(F.col("side") > 1, F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.col("side") - 1)), lambda j: F.get(q, F.floor(j * EDGES / F.col("side")).cast("int") - 1))).otherwise(F.array().cast("array<double>"))
    return grid.select("cloud_id", F.transform("axes", lambda a: F.struct(a["axis"].alias("axis"), inner(a["q"]).alias("edges"))).alias("grid"))


def _pruned(p: DataFrame, t: DataFrame, sizes: DataFrame, k: int, exclude_self: bool) -> tuple[DataFrame, DataFrame]:
    """Points and targets of large clouds under the blocks ``(cloud_id, pb, tb)`` in which a neighbour can lie.

    Targets lie in the cells of a grid, a crowded cell in several blocks. The ``k``-th distance
    within a block of a point's own cell bounds what can be nearer; the point goes to the cells
    whose box comes within that bound and to no others, so its copies do not grow with the
    number of blocks where neighbours are near.
    """
    grids = cut_lineage(_grids(t, sizes))
    bin_of = lambda g, x: F.size(F.filter(g["edges"], lambda e: e <= x))
    cell_of = lambda c: F.transform("grid", lambda g: bin_of(g, F.element_at(c, g["axis"] + 1)))
    p = cut_lineage(p.join(grids, "cloud_id").withColumn("cell", cell_of("coords")))
    t = cut_lineage(t.join(grids, "cloud_id").withColumn("cell", cell_of("at")).drop("grid"))
    held = p.groupBy("cloud_id", "cell").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("p_parts"))
    ends = t.select("cloud_id", "cell", "target_id", F.posexplode("at").alias("axis", "x")).groupBy("cloud_id", "cell", "axis")
    ends = ends.agg(F.min("x").alias("low"), F.max("x").alias("high"), F.count(F.lit(1)).alias("n"))
    cells = ends.groupBy("cloud_id", "cell").agg(F.sort_array(F.collect_list(F.struct("axis", "low", "high"))).alias("box"), F.ceil(F.max("n") / BLOCK).cast("int").alias("t_parts"))
    cells = cut_lineage(cells.join(held, ["cloud_id", "cell"], "left").fillna(1, ["p_parts"]))
    part = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    name = lambda tb: F.concat_ws(",", F.transform("cell", lambda i: i.cast("string")), tb.cast("string"))
    parts_of = cells.select("cloud_id", "cell", "t_parts", "p_parts")
    # first bound: one block of the own cell
    mine = p.join(parts_of, ["cloud_id", "cell"]).select("cloud_id", "point_id", "coords", part("point_id", "p_parts").alias("pb"), name(part("point_id", "t_parts")).alias("tb"))
    blocks = cut_lineage(t.join(parts_of, ["cloud_id", "cell"]).select("cloud_id", "target_id", "at", "p_parts", name(part("target_id", "t_parts")).alias("tb")))
    right = blocks.withColumn("pb", F.explode(F.sequence(F.lit(0), F.col("p_parts") - 1))).drop("p_parts")
    first = _blocks(mine, right, k, exclude_self).where(F.size("neighbours") >= k)
    bound = first.select("cloud_id", "point_id", F.element_at("neighbours", k)["dist"].alias("bound"))
    p = cut_lineage(p.join(bound, ["cloud_id", "point_id"], "left"))
    # a cell with fewer than k targets gives no bound; k drawn targets of the cloud always do
    if not p.where("bound is null").isEmpty():
        place = F.row_number().over(Window.partitionBy("cloud_id").orderBy(F.xxhash64("target_id"), "target_id"))
        drawn = t.withColumn("r", place).where(F.col("r") <= k + 1).select("cloud_id", F.col("target_id").alias("point_id"), F.col("at").alias("coords"))
        far = nearest_of_few(p.where("bound is null").select("cloud_id", "point_id", "coords"), drawn, k + 1)
        far = far.select("cloud_id", "point_id", F.array_max(F.transform("neighbours", lambda n: n["dist"])).alias("far"))
        p = p.join(far, ["cloud_id", "point_id"], "left").withColumn("bound", F.coalesce("bound", "far")).drop("far")
    reach = F.col("bound") * (1 + 1e-9)
    span = lambda i: F.sequence(bin_of(F.get("grid", F.lit(i)), at(i) - reach), bin_of(F.get("grid", F.lit(i)), at(i) + reach))
    at = lambda i: F.element_at("coords", F.get("grid", F.lit(i))["axis"] + 1)
    combined = F.transform(span(0), lambda a: F.array(a))
    widths = p.select(F.max(F.size("grid"))).first()[0] or 0  # one number
    for i in range(1, widths):
        wider = lambda base, i=i: F.flatten(F.transform(base, lambda c: F.transform(span(i), lambda b: F.concat(c, F.array(b)))))
        combined = F.when(F.size("grid") > i, wider(combined)).otherwise(combined)
    visits = p.withColumn("cell", F.explode(combined)).select("cloud_id", "point_id", "coords", "bound", "cell").join(cells, ["cloud_id", "cell"])
    gap = lambda x, b: F.greatest(b["low"] - x, x - b["high"], F.lit(0.0))
    apart = F.sqrt(F.aggregate(F.zip_with("coords", "box", gap), F.lit(0.0), lambda s, g: s + g * g))
    visits = visits.where(apart <= reach).withColumn("tb", F.explode(F.sequence(F.lit(0), F.col("t_parts") - 1)))
    left = visits.select("cloud_id", "point_id", "coords", part("point_id", "p_parts").alias("pb"), name(F.col("tb")).alias("tb"))
    return left, right


def nearest(points: DataFrame, targets: DataFrame, k: int, exclude_self: bool = False, target_bound: int | None = None) -> DataFrame:
    """``(cloud_id, point_id, neighbours array<struct<dist, id>>)``: the ``k`` nearest targets of each point of its cloud.

    Neighbours are in order of (distance, id); with ``exclude_self`` a target with the point's own
    id does not count. A point whose cloud has no targets has no row. The targets of a cloud of up
    to ``BLOCK`` are one block and nothing is merged; those of a larger cloud lie in a grid and a
    point meets only the cells in which a neighbour can lie, with the same result. ``target_bound``,
    where it is known, saves the counting.
    """
    p = points.select("cloud_id", "point_id", "coords").where("coords is not null")
    t = targets.select("cloud_id", F.col("point_id").alias("target_id"), F.col("coords").alias("at")).where("at is not null")
    sizes = None
    if target_bound is None or target_bound > BLOCK:
        sizes = cut_lineage(t.groupBy("cloud_id").agg(F.count(F.lit(1)).alias("t_n")))
        if sizes.where(F.col("t_n") > BLOCK).isEmpty():
            sizes = None
    small_p, small_t = p, t
    if sizes is not None:
        large = sizes.where(F.col("t_n") > BLOCK)
        small_p, small_t = (df.join(large, "cloud_id", "left_anti") for df in (p, t))
        left, right = _pruned(p.join(large, "cloud_id", "left_semi"), t.join(large, "cloud_id", "left_semi"), large, k, exclude_self)
        found = _blocks(left, right, k, exclude_self)
        merged = found.groupBy("cloud_id", "point_id").agg(F.slice(F.array_sort(F.flatten(F.collect_list("neighbours"))), 1, k).alias("neighbours"))
    p_blocks = small_p.groupBy("cloud_id").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("p_blocks"))
    left = small_p.join(p_blocks, "cloud_id").select("cloud_id", "point_id", "coords", F.pmod(F.xxhash64("point_id"), F.col("p_blocks")).cast("int").alias("pb"), F.lit("").alias("tb"))
    right = small_t.join(p_blocks, "cloud_id").withColumn("pb", F.explode(F.sequence(F.lit(0), F.col("p_blocks") - 1))).select("cloud_id", "target_id", "at", "pb", F.lit("").alias("tb"))
    rows = _blocks(left, right, k, exclude_self)
    return (rows if sizes is None else rows.unionByName(merged)).where(F.size("neighbours") > 0)


def _blocks(left: DataFrame, right: DataFrame, k: int, exclude_self: bool) -> DataFrame:
    """The ``k`` nearest targets of each point within every block ``(cloud_id, pb, tb)``."""
    points, targets = left, right
    left, right = _sides(left, right)
    schema = f"cloud_id {points.schema['cloud_id'].dataType.simpleString()}, point_id {points.schema['point_id'].dataType.simpleString()}, neighbours array<struct<dist: double, id: {targets.schema['target_id'].dataType.simpleString()}>>"

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        x, y = _matrix(a.column("l_coords")), _matrix(b.column("r_at"))
        ids, own = b.column("r_target_id").to_numpy(), a.column("l_point_id").to_numpy()
        offsets, dists, found = [0], [], []
        if len(x) and len(y):
            step = max(1, CHUNK // len(y))
            for low in range(0, len(x), step):
                d2 = squared_distances(x[low : low + step], y)
                if exclude_self:
                    d2[own[low : low + step, None] == ids[None, :]] = np.inf
                at = k_smallest(d2, ids, k)
                near = np.take_along_axis(d2, at, 1)
                good = np.isfinite(near)
                dists.append(np.sqrt(near[good]))
                found.append(ids[at][good])
                offsets.extend((offsets[-1] + np.cumsum(good.sum(axis=1))).tolist())
        else:
            a = a.slice(0, 0)
        flat = np.concatenate(dists) if dists else np.zeros(0)
        names = np.concatenate(found) if found else ids[:0]
        items = pa.StructArray.from_arrays([pa.array(flat), pa.array(names)], ["dist", "id"])
        lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), items)
        return pa.table({"cloud_id": a.column("l_cloud_id"), "point_id": a.column("l_point_id"), "neighbours": lists})

    return _meet(left, right).applyInArrow(run, schema)


def nearest_of_few(points: DataFrame, targets: DataFrame, k: int) -> DataFrame:
    """As ``nearest``, for clouds of a handful of targets each (their number must be bounded): all in SQL.

    The targets of a cloud travel as one list, so many tiny clouds cost no Python call each.
    """
    entry = F.struct(F.col("point_id").alias("id"), F.col("coords").alias("at"))
    few = targets.where("coords is not null").groupBy("cloud_id").agg(F.collect_list(entry).alias("targets"))
    rows = points.select("cloud_id", "point_id", "coords").where("coords is not null").join(few, "cloud_id")
    near = F.transform("targets", lambda t: F.struct(distance("coords", t["at"]).alias("dist"), t["id"].alias("id")))
    return rows.select("cloud_id", "point_id", F.slice(F.array_sort(near), 1, k).alias("neighbours"))


def ranked(neighbours: DataFrame) -> DataFrame:
    """One row per neighbour: (cloud_id, point_id, rank from 1, target_id, dist)."""
    rows = neighbours.select("cloud_id", "point_id", F.posexplode("neighbours").alias("pos", "n"))
    return rows.select("cloud_id", "point_id", (F.col("pos") + 1).alias("rank"), F.col("n.id").alias("target_id"), F.col("n.dist").alias("dist"))


def nearest_others(points: DataFrame, k: int, near: DataFrame | None = None) -> DataFrame:
    """The ``k`` nearest other points of each point; lists of at least as many, where they are there, are cut."""
    if near is None:
        return nearest(points, points, k, exclude_self=True)
    return near.withColumn("neighbours", F.slice("neighbours", 1, k))


def kth_radius(points: DataFrame, k: int = 10, near: DataFrame | None = None) -> DataFrame:
    """``(cloud_id, point_id, radius)``: distance to the k-th nearest other point, or the farthest there is; 0 for a lone point."""
    near = nearest_others(points, k, near)
    radius = F.element_at("neighbours", -1)["dist"]
    own = points.select("cloud_id", "point_id")
    return own.join(near, ["cloud_id", "point_id"], "left").select("cloud_id", "point_id", F.coalesce(radius, F.lit(0.0)).alias("radius"))


def density_proxy(radii: DataFrame, dim: int) -> DataFrame:
    """Adds ``rho``, the density a radius stands for in ``dim`` dimensions."""
    return radii.withColumn("rho", 1.0 / (F.pow(F.col("radius") + 1e-12, F.lit(float(dim))) + 1e-12))


def to_unit(scores: DataFrame, score: str = "score") -> DataFrame:
    """A score to [0, 1] within each cloud."""
    span = scores.groupBy("cloud_id").agg(F.min(score).alias("low"), F.max(score).alias("high"))
    return scores.join(span, "cloud_id").withColumn(score, (F.col(score) - F.col("low")) / (F.col("high") - F.col("low") + 1e-12)).drop("low", "high")


def neighbour_density(points: DataFrame, k: int = 10, near: DataFrame | None = None) -> DataFrame:
    """``(cloud_id, point_id, score)``: inverse mean distance of the k nearest others, to [0, 1] within the cloud."""
    near = nearest_others(points, k, near)
    mean = F.aggregate("neighbours", F.lit(0.0), lambda s, n: s + n["dist"]) / F.size("neighbours")
    return to_unit(near.select("cloud_id", "point_id", (1.0 / (mean + 1e-12)).alias("score")))


def kernel_density(points: DataFrame, bandwidth: float) -> DataFrame:
    """``(cloud_id, point_id, score)``: sum of Gaussians over the cloud, to [0, 1] within it; summed block by block."""
    p = points.select("cloud_id", "point_id", "coords").where("coords is not null")
    sizes = p.groupBy("cloud_id").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    blocks = p.join(sizes, "cloud_id").withColumn("own", F.pmod(F.xxhash64("point_id"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    left = blocks.withColumn("tb", other).select("cloud_id", F.col("own").alias("pb"), "tb", "point_id", "coords")
    right = blocks.withColumn("pb", other).select("cloud_id", "pb", F.col("own").alias("tb"), "coords")
    schema = f"cloud_id {points.schema['cloud_id'].dataType.simpleString()}, point_id {points.schema['point_id'].dataType.simpleString()}, score double"

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        x, y = _matrix(a.column("l_coords")), _matrix(b.column("r_coords"))
        score = np.zeros(len(x))
        step = max(1, CHUNK // max(1, len(y)))
        for low in range(0, len(x), step):
            score[low : low + step] = np.exp(-squared_distances(x[low : low + step], y) / (2 * bandwidth**2)).sum(axis=1)
        return pa.table({"cloud_id": a.column("l_cloud_id"), "point_id": a.column("l_point_id"), "score": pa.array(score)})

    left, right = _sides(left, right)
    parts = _meet(left, right).applyInArrow(run, schema)
    return to_unit(parts.groupBy("cloud_id", "point_id").agg(F.sum("score").alias("score")))
