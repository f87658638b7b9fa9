"""Landmark selection: ordered picks ``(cloud_id, rank, point_id)`` from each cloud."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from topospark.functions.quantiles import quantiles
from topospark.functions.vectors import distance, draw, draw_key
from topospark.operators import knn, prepare
from topospark.session import cut_lineage

GREEDY_BLOCK = 20_000
GREEDY_LEAD = 1024  # rows of each view among which a round picks in a large cloud
SHRINK = (1.0, 0.9, 0.8, 0.7, 0.6)  # parts of the widest gap at which blends are seen
WIDTHS = len(SHRINK)  # the view of the gaps
LATE = 1 << 30  # drawn points come after all picks
DIGITS = 9  # scores are rounded before they are compared, so that the last bit never decides


def number(picks: DataFrame, order: list[Column], m: int) -> DataFrame:
    """The first ``m`` of each cloud with their rank from 0."""
    rank = F.row_number().over(Window.partitionBy("cloud_id").orderBy(*order))
    return picks.withColumn("rank", rank).where(F.col("rank") <= m).select("cloud_id", (F.col("rank") - 1).alias("rank"), "point_id")


def random(points: DataFrame, m: int, seed: int) -> DataFrame:
    """A uniform sample in drawn order."""
    return number(points, [draw_key("point_id", seed), F.col("point_id")], m)


def _weighted_maxmin(x: np.ndarray, score: np.ndarray, m: int, alpha: float) -> list[int]:
    """Farthest points under weights: start at the largest weight, then the largest distance times weight."""
    picks = [int(np.argmax(np.round(score, DIGITS)))]
    gap = np.sqrt(knn.squared_distances(x, x[picks])[:, 0])
    free = np.ones(len(x), dtype=bool)
    free[picks] = False
    while len(picks) < min(m, len(x)):
        value = np.where(free, np.round(gap * score, DIGITS), -1.0)
        best = int(np.argmax(value))
        picks.append(best)
        free[best] = False
        gap = np.minimum(gap, np.sqrt(knn.squared_distances(x, x[best : best + 1])[:, 0]))
    return picks


def _hybrid_maxmin(x: np.ndarray, score: np.ndarray, m: int, alpha: float) -> list[int]:
    """Trades density against distance: start at the densest, then the largest blend of both."""
    picks = [int(np.argmax(np.round(score, DIGITS)))]
    gap = np.sqrt(knn.squared_distances(x, x[picks])[:, 0])
    free = np.ones(len(x), dtype=bool)
    free[picks] = False
    while len(picks) < min(m, len(x)):
        widest = gap.max()
        reach = gap / (widest + 1e-12) if widest > 1e-12 else np.zeros(len(x))
        value = np.where(free, np.round(alpha * score + (1 - alpha) * reach, DIGITS), -np.inf)
        best = int(np.argmax(value))
        picks.append(best)
        free[best] = False
        gap = np.minimum(gap, np.sqrt(knn.squared_distances(x, x[best : best + 1])[:, 0]))
    return picks


def _rounded(value: Column) -> Column:
    """As NumPy rounds."""
    return F.rint(value * 10.0**DIGITS) / 10.0**DIGITS


def _views(kernel: Callable, alpha: float) -> Column:
    """Array of ``(view, v)``, the orders in which a round looks for its leading rows, from ``score``, ``gap`` and ``widest``.

    View 0 is the value of the kernel now. A blend depends on the widest gap as well, which falls
    with the picks, so it is also seen at smaller widths (``SHRINK``), and the gaps themselves are a view.
    """
    view = lambda i, v: F.struct(F.lit(i).alias("view"), v.alias("v"))
    if kernel is _weighted_maxmin:
        return F.array(view(0, _rounded(F.col("gap") * F.col("score"))))
    if kernel is not _hybrid_maxmin:
        raise ValueError("a kernel without a value for clouds over one task")
    reach = lambda f: F.when(F.col("widest") > 1e-12, F.col("gap") / (F.col("widest") * f + F.lit(1e-12))).otherwise(0.0)
    blend = lambda f: F.lit(alpha) * F.col("score") + F.lit(1 - alpha) * reach(f)
    return F.array(view(0, _rounded(blend(SHRINK[0]))), *[view(i, blend(f)) for i, f in enumerate(SHRINK) if i], view(WIDTHS, F.col("gap")))


def _advance(x: np.ndarray, score: np.ndarray, gap: np.ndarray, last: dict[int, tuple[float, int]], left: int, lowest: float, kernel: Callable, alpha: float) -> list[int]:
    """The next picks among the leading rows of a cloud, as long as no other row can come first.

    ``last`` holds the value and place of the last leading row of each view. Gaps only fall, so no
    other row exceeds it; the first pick leads view 0 and is always right.
    """
    picks: list[int] = []
    free = np.ones(len(x), dtype=bool)
    began = gap.max()

    def is_next(best: int, value: float, widest: float) -> bool:
        if not last:
            return True
        bound, place = last[0]
        if kernel is _weighted_maxmin:
            return value > max(bound, 0.0) if lowest < 0 else (value, -best) >= (bound, -place)
        if widest < last[WIDTHS][0]:
            return False
        if widest == began or began <= 1e-12:
            return (value, -best) >= (bound, -place)
        # the largest value of the others is convex in the inverse of the width
        widths = [1 / (began * f + 1e-12) for f in SHRINK]
        now = 1 / (widest + 1e-12)
        return now <= widths[-1] and value > np.interp(now, widths, [last[i][0] for i in range(len(SHRINK))]) + 2 * 10.0**-DIGITS

    while len(picks) < left and free.any():
        widest = gap.max()
        if kernel is _weighted_maxmin:
            value = gap * score
        else:
            value = alpha * score + (1 - alpha) * (gap / (widest + 1e-12) if widest > 1e-12 else np.zeros(len(x)))
        value = np.where(free, np.round(value, DIGITS), -np.inf)
        best = int(np.argmax(value))
        if picks and not is_next(best, float(value[best]), float(widest)):
            break
        picks.append(best)
        free[best] = False
        gap = np.minimum(gap, np.sqrt(knn.squared_distances(x, x[best : best + 1])[:, 0]))
    return picks


def _in_rounds(rows: DataFrame, m: int, kernel: Callable, alpha: float, lead: int) -> DataFrame:
    """The picks of a kernel for clouds of any size, several a pass over their rows.

    A free row keeps its distance to the picks so far (``gap``). A round finds the ``lead``
    leading rows of each view, picks among them in one task a cloud, and measures the rest anew.
    Ties, repeated rows and blends may leave a round with a single pick, never with a wrong one.
    """
    kind = lambda c: rows.schema[c].dataType.simpleString()
    schema = f"cloud_id {kind('cloud_id')}, rank int, point_id {kind('point_id')}, coords {kind('coords')}"

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("point_id")
        last = {e["view"]: (e["v"], i) for i, ends in enumerate(table.column("ends").to_pylist()) for e in ends}
        x, score, gap = knn._matrix(table.column("coords")), table.column("score").to_numpy(), table.column("gap").to_numpy()
        taken = table.column("taken")[0].as_py()
        picks = _advance(x, score, gap, last, m - taken, table.column("lowest")[0].as_py() or 0.0, kernel, alpha)
        return table.take(pa.array(picks, pa.int64())).select(["cloud_id", "point_id", "coords"]).add_column(1, "rank", pa.array(range(taken, taken + len(picks)), pa.int32()))

    first = F.min_by("coords", F.struct(F.lit(0.0) - _rounded(F.col("score")), "point_id"))
    first_id = F.min_by("point_id", F.struct(F.lit(0.0) - _rounded(F.col("score")), "point_id"))
    new = cut_lineage(rows.groupBy("cloud_id").agg(F.lit(0).alias("rank"), first_id.alias("point_id"), first.alias("coords")))
    picks = new
    state = rows.withColumn("gap", F.lit(float("inf")))
    order = F.row_number().over(Window.partitionBy("cloud_id", "view").orderBy(F.desc("v"), "point_id"))
    while not new.isEmpty():
        recent = new.groupBy("cloud_id").agg(F.collect_list(F.struct("point_id", "coords")).alias("recent"), (F.max("rank") + 1).alias("taken")).where(F.col("taken") < m)
        nearer = F.array_min(F.transform("recent", lambda r: distance("coords", r["coords"])))
        free = state.drop("taken").join(recent, "cloud_id").where(~F.array_contains(F.col("recent.point_id"), F.col("point_id")))
        state = cut_lineage(free.select("cloud_id", "point_id", "coords", "score", F.least("gap", nearer).alias("gap"), "taken"))
        widths = state.groupBy("cloud_id").agg(F.max("gap").alias("widest"), F.min("score").alias("lowest"))
        seen = state.join(widths, "cloud_id").select("cloud_id", "point_id", F.inline(_views(kernel, alpha)))
        some = seen.withColumn("place", order).where(F.col("place") <= lead)
        ends = F.collect_list(F.when(F.col("place") == lead, F.struct("view", "v")))
        leading = some.groupBy("cloud_id", "point_id").agg(ends.alias("ends")).join(state, ["cloud_id", "point_id"]).join(widths.drop("widest"), "cloud_id")
        new = cut_lineage(leading.groupBy("cloud_id").applyInArrow(run, schema))
        picks = cut_lineage(picks.unionByName(new))
    return picks.where(F.col("rank") < m).select("cloud_id", "rank", "point_id")


def greedy(scored: DataFrame, m: int, kernel: Callable, alpha: float, block: int | None = None, lead: int | None = None) -> DataFrame:
    """Greedy picks from rows ``(cloud_id, point_id, coords, score)``; ties go to the smallest id.

    A cloud of up to ``block`` points is served in one task, a larger one in rounds over its rows
    that give several picks each, from ``lead`` leading rows; the picks are the same for any of both.
    """
    block, lead = block or GREEDY_BLOCK, lead or GREEDY_LEAD
    rows = scored.select("cloud_id", "point_id", "coords", F.col("score").cast("double").alias("score"))
    kind = lambda c: rows.schema[c].dataType.simpleString()
    schema = f"cloud_id {kind('cloud_id')}, rank int, point_id {kind('point_id')}"

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("point_id")
        x = knn._matrix(table.column("coords"))
        picks = kernel(x, table.column("score").to_numpy(), m, alpha)
        return table.take(pa.array(picks)).select(["cloud_id", "point_id"]).add_column(1, "rank", pa.array(range(len(picks)), pa.int32()))

    sizes = rows.groupBy("cloud_id").agg(F.count(F.lit(1)).alias("held"))
    if (sizes.agg(F.max("held")).first()[0] or 0) <= block:
        return rows.groupBy("cloud_id").applyInArrow(run, schema)
    sizes = cut_lineage(sizes)
    small = rows.join(sizes.where(F.col("held") <= block), "cloud_id", "left_semi")
    large = rows.join(sizes.where(F.col("held") > block), "cloud_id", "left_semi")
    return small.groupBy("cloud_id").applyInArrow(run, schema).unionByName(_in_rounds(large, m, kernel, alpha, lead))


def weighted_maxmin(points: DataFrame, weights: DataFrame, m: int, block: int | None = None, lead: int | None = None) -> DataFrame:
    """Farthest-point picks under a weight column ``score`` of ``weights``."""
    return greedy(points.join(weights.select("cloud_id", "point_id", "score"), ["cloud_id", "point_id"]), m, _weighted_maxmin, 0.0, block, lead)


def density(points: DataFrame, m: int, dim: int, c: float = 8, k: int = 15, alpha: float = 0.8, seed: int = 42, near: DataFrame | None = None) -> DataFrame:
    """Density-weighted farthest points from candidates drawn by importance; sparse places weigh more.

    A cloud of n points has ``ceil(c * m * ln n)`` candidates; where that covers the cloud, all of
    it takes part and nothing is random.
    """
    rho = knn.density_proxy(knn.kth_radius(points, k, near), dim)
    scored = points.join(rho.withColumn("score", F.pow(1.0 / (F.col("rho") + 1e-12), F.lit(alpha))).drop("radius", "rho"), ["cloud_id", "point_id"])
    n = points.groupBy("cloud_id").agg(F.count(F.lit(1)).alias("n"))
    budget = F.ceil(F.lit(c * m) * F.greatest(F.lit(1.0), F.ln(F.greatest(F.lit(2), F.col("n")).cast("double"))))
    order = F.when(F.col("score") > 0, -F.ln(draw("point_id", seed)) / F.col("score")).otherwise(F.lit(float("inf")))
    most = n.agg(F.max(F.least(budget, F.col("n")))).first()[0] or 0
    rank = F.row_number().over(Window.partitionBy("cloud_id").orderBy(F.round(order, DIGITS), draw_key("point_id", seed), "point_id"))
    chosen = scored.withColumn("place", rank).where(F.col("place") <= int(most)).join(n, "cloud_id").where(F.col("place") <= budget)
    return greedy(chosen, m, _weighted_maxmin, alpha)


def hybrid(points: DataFrame, m: int, alpha: float = 0.5, k: int = 10, bandwidth: float | None = None, near: DataFrame | None = None) -> DataFrame:
    """Blend of density (by neighbours, or by a kernel of ``bandwidth``) and distance."""
    scores = knn.kernel_density(points, bandwidth) if bandwidth else knn.neighbour_density(points, k, near)
    return greedy(points.join(scores, ["cloud_id", "point_id"]), m, _hybrid_maxmin, alpha)


def spatial_hash(points: DataFrame, cell: float | Column) -> DataFrame:
    """Adds ``cell``, the text of ``floor(x / cell)`` on each axis."""
    width = F.lit(float(cell)) if not isinstance(cell, Column) else cell
    floors = F.transform("coords", lambda x: F.floor(x / width).cast("string"))
    return points.withColumn("cell", F.array_join(floors, ","))


def _fill(points: DataFrame, picks: DataFrame, m: int, seed: int) -> DataFrame:
    """Picks ``(cloud_id, point_id, order)`` topped up with drawn points to ``m``, ranked.

    Of the first ``2 * m`` drawn points at most ``m`` are picks already, so no more are ever
    needed and the points are pruned before the shuffle.
    """
    order = F.row_number().over(Window.partitionBy("cloud_id").orderBy(draw_key("point_id", seed), "point_id"))
    rest = points.select("cloud_id", "point_id").withColumn("order", order).where(F.col("order") <= 2 * m)
    both = picks.select("cloud_id", "point_id", F.col("order").cast("int").alias("order")).unionByName(rest.withColumn("order", F.col("order") + LATE))
    once = both.groupBy("cloud_id", "point_id").agg(F.min("order").alias("order"))  # a pick that is drawn as well
    return number(once, [F.col("order"), draw_key("point_id", seed), F.col("point_id")], m)


def sparse_cells(points: DataFrame, m: int, alpha: float = 0.7, seed: int = 42) -> DataFrame:
    """One drawn point from each of ``m`` grid cells, cells drawn with a bias to sparse ones; topped up at random."""
    box = prepare.bounds(points)
    extent = F.array_max(F.zip_with("bounds_min", "bounds_max", lambda a, b: b - a))
    side = max(2, math.ceil(round(m ** (1 / 3), 9)))
    width = F.when(extent > 0, extent / side).otherwise(F.lit(1.0))
    rows = spatial_hash(points.join(box.select("cloud_id", width.alias("width")), "cloud_id"), F.col("width")).drop("width")
    key = F.struct(draw_key("point_id", seed), "point_id")
    cells = rows.groupBy("cloud_id", "cell").agg(F.count(F.lit(1)).alias("held"), F.min_by("point_id", key).alias("point_id"))
    every = cells.groupBy("cloud_id").agg(F.max("held").alias("most"), F.count(F.lit(1)).alias("cells"))
    weight = alpha * (1 - F.col("held") / F.col("most")) + (1 - alpha) / F.col("cells")
    order = F.round(-F.ln(draw("cell", seed + 1)) / F.round(weight, 12), DIGITS)
    drawn = F.row_number().over(Window.partitionBy("cloud_id").orderBy(order, "cell"))
    picks = cells.join(every, "cloud_id").withColumn("order", drawn).where(F.col("order") <= m)
    return _fill(rows, picks.select("cloud_id", "point_id", "order"), m, seed + 2)


def multi_grid(points: DataFrame, m: int, levels: int = 3, seed: int = 42) -> DataFrame:
    """Drawn points from drawn cells of grids of 2, 4, 8, ... cells an axis, an equal part from each; topped up at random."""
    unit = prepare.normalise_minmax(points.select("cloud_id", "point_id", "coords", "intensity"))
    picks: DataFrame | None = None
    for level in range(levels):
        side = 2 ** (level + 1)
        floors = F.transform("coords", lambda x: F.least(F.lit(side - 1), F.floor(x * side)).cast("string"))
        cells = unit.withColumn("cell", F.array_join(floors, ",")).groupBy("cloud_id", "cell").agg(F.min_by("point_id", F.struct(draw_key("point_id", seed + level), "point_id")).alias("point_id"))
        place = F.row_number().over(Window.partitionBy("cloud_id").orderBy(draw_key("cell", seed + level), "cell"))
        own = cells.withColumn("place", place).where(F.col("place") <= m // levels).select("cloud_id", "point_id", (F.col("place") + level * m).alias("order"))
        picks = own if picks is None else picks.unionByName(own)
    picks = picks.groupBy("cloud_id", "point_id").agg(F.min("order").alias("order"))
    return _fill(points, picks, m, seed + levels)


def sectors(points: DataFrame, sectors: int = 16, rings: int = 4) -> DataFrame:
    """Adds ``cell``, sector of the azimuth times rings plus ring of the range; ring edges are percentiles of the range."""
    x, y = F.element_at("coords", 1), F.element_at("coords", 2)
    rows = points.withColumn("range", F.sqrt(x * x + y * y))
    shares = {f"e{i}": i / rings for i in range(rings + 1)}
    edges = quantiles(rows, "range", shares, ["cloud_id"]).select("cloud_id", F.array(*shares).alias("edges"))
    turn = F.floor((F.atan2(y, x) + math.pi) / (2 * math.pi / sectors)).cast("int")
    sector = F.greatest(F.lit(0), F.least(F.lit(sectors - 1), turn))
    passed = F.size(F.filter(F.slice("edges", 1, rings), lambda e: e <= F.col("range")))
    ring = F.greatest(F.lit(0), F.least(F.lit(rings - 1), passed - 1))
    return rows.join(edges, "cloud_id").withColumn("cell", sector * rings + ring).drop("range", "edges")


def lidar_sectors(points: DataFrame, m: int, n_sectors: int = 16, n_rings: int = 4, seed: int = 42, spread: bool = False) -> DataFrame:
    """Drawn points from azimuth sectors and range rings, cells in order until ``m`` are picked; topped up at random.

    With ``spread`` the cells come in drawn order, so that few landmarks still look all around.
    """
    each = max(1, m // (n_sectors * n_rings))
    rows = sectors(points, n_sectors, n_rings)
    inner = F.row_number().over(Window.partitionBy("cloud_id", "cell").orderBy(draw_key("point_id", seed), "point_id"))
    some = rows.withColumn("inner", inner).where(F.col("inner") <= each)
    cell_order = draw_key("cell", seed) if spread else F.col("cell")
    order = F.row_number().over(Window.partitionBy("cloud_id").orderBy(cell_order, "cell", "inner"))
    picks = some.withColumn("order", order).where(F.col("order") <= m)
    return _fill(points, picks.select("cloud_id", "point_id", "order"), m, seed + 1)


def radii_summary(points: DataFrame, k: int = 10) -> DataFrame:
    """``(cloud_id, radius_mean, radius_median)`` of the distances to the k-th nearest other point."""
    radii = cut_lineage(knn.kth_radius(points, k))
    mean = radii.groupBy("cloud_id").agg(F.avg("radius").alias("radius_mean"))
    return mean.join(quantiles(radii, "radius", {"radius_median": 0.5}, ["cloud_id"]), "cloud_id")


def select(points: DataFrame, method: str, m: int, seed: int, dim: int, alpha: float = 0.5, c: float = 8, near: DataFrame | None = None) -> DataFrame:
    """Landmarks by the name of a method; a cloud of at most ``m`` points gives all of them.

    ``near``, lists of at least 15 nearest others, saves the methods that need such lists their own.
    """
    if m < 1:
        raise ValueError("m must be at least 1")
    if not 0 <= alpha <= 1:
        raise ValueError("alpha must lie in [0, 1]")
    methods: dict[str, Callable[[], DataFrame]] = {
        "random": lambda: random(points, m, seed),
        "density": lambda: density(points, m, dim, c=c, seed=seed, near=near),
        "hybrid": lambda: hybrid(points, m, alpha, near=near),
        "quantum": lambda: sparse_cells(points, m, seed=seed),
        "grid": lambda: multi_grid(points, m, seed=seed),
        "lidar": lambda: lidar_sectors(points, m, seed=seed),
    }
    if method not in methods:
        raise ValueError(f"unknown landmark method {method!r}; there are {', '.join(methods)}")
    return methods[method]()
