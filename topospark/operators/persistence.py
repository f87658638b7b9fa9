"""Persistence diagrams of filtered complexes, Vietoris-Rips references, diagram distances."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topospark.operators import knn, prepare


def _reduce(dim: np.ndarray, vertices: list[tuple], value: np.ndarray, all_positive: bool) -> list[tuple[int, float, float]]:
    """Bars (dim, birth, death) of one complex closed under faces, over the field of two elements.

    Components are merged by union-find; triangles are reduced as bit sets over the edges that
    close a loop, each by the pivot it shares with an earlier one.
    """
    order = np.lexsort((dim, value))
    bars: list[tuple[int, float, float]] = []
    parent: dict = {}
    born: dict = {}
    edge_at: dict[tuple, int] = {}
    loops: list[float] = []
    pivots: dict[int, int] = {}
    open_loops: set[int] = set()

    def root(v):
        while parent[v] != v:
            parent[v] = parent[parent[v]]
            v = parent[v]
        return v

    for i in order.tolist():
        v, f = vertices[i], float(value[i])
        if dim[i] == 0:
            parent[v[0]], born[v[0]] = v[0], f
            if all_positive:
                bars.append((0, f, np.inf))
        elif dim[i] == 1:
            a, b = root(v[0]), root(v[1])
            if a == b:
                edge_at[v] = len(loops)
                open_loops.add(len(loops))
                loops.append(f)
                if all_positive:
                    bars.append((1, f, np.inf))
            else:
                if born[a] > born[b]:
                    a, b = b, a
                parent[b] = a
                bars.append((0, born[b], f))
        else:
            column = 0
            for face in ((v[0], v[1]), (v[0], v[2]), (v[1], v[2])):
                if (at := edge_at.get(face)) is not None:
                    column ^= 1 << at
            while column and (low := column.bit_length() - 1) in pivots:
                column ^= pivots[low]
            if column:
                pivots[low] = column
                open_loops.discard(low)
                bars.append((1, loops[low], f))
            else:
                bars.append((2, f, np.inf))
    if not all_positive:
        bars += [(0, born[v], np.inf) for v in parent if parent[v] == v]
        bars += [(1, loops[i], np.inf) for i in open_loops]
    return bars


def diagrams(simplices: DataFrame, essential: str = "all_positive") -> DataFrame:
    """Bars ``(cloud_id, dim, birth, death)`` of every cloud's complex.

    ``essential="all_positive"`` gives every simplex that opens a class an unending bar, also if
    the class dies later; ``"unpaired"`` only those that never die. The youngest edge of a cycle
    always closes a loop, so bit sets over such edges have the same pivots as over all. The rows
    of one cloud are bounded by its landmarks, not by its points.
    """
    if essential not in ("all_positive", "unpaired"):
        raise ValueError("essential is all_positive or unpaired")
    kind = simplices.schema["cloud_id"].dataType.simpleString()

    def run(key: tuple, table: pa.Table) -> pa.Table:
        dim = table.column("dim").to_numpy()
        corners = [table.column(f"v{i}").to_pylist() for i in range(3)]
        vertices = [tuple(v for v in c if v is not None) for c in zip(*corners, strict=True)]
        bars = _reduce(dim, vertices, table.column("filtration").to_numpy(), essential == "all_positive")
        d, b, e = zip(*bars, strict=True) if bars else ((), (), ())
        cloud = pa.array([key[0].as_py()] * len(bars), table.schema.field("cloud_id").type)
        return pa.table({"cloud_id": cloud, "dim": pa.array(d, pa.int32()), "birth": pa.array(b, pa.float64()), "death": pa.array(e, pa.float64())})

    return simplices.groupBy("cloud_id").applyInArrow(run, f"cloud_id {kind}, dim int, birth double, death double")


def rips_edges(points: DataFrame, sample_size: int, percentile: float, seed: int) -> DataFrame:
    """Pairs ``(cloud_id, a, b, dist, max_edge)``, a < b, of a sample of each cloud, up to a percentile of all its distances.

    The sample is the bound of the group: at most ``sample_size`` points of a cloud meet.
    """
    some = prepare.sample(points.select("cloud_id", "point_id", "coords").where("coords is not null"), sample_size, seed)
    kind = lambda c: points.schema[c].dataType.simpleString()

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("point_id")
        x, ids = knn._matrix(table.column("coords")), table.column("point_id").to_numpy()
        a, b = np.triu_indices(len(x), 1)
        dist = np.sqrt(knn.squared_distances(x, x))[a, b]
        edge = float(np.percentile(dist, percentile)) if len(dist) else 0.0
        keep = dist <= edge
        cloud = table.column("cloud_id").combine_chunks().take(pa.array(np.zeros(int(keep.sum()), dtype=np.int64)))
        return pa.table({"cloud_id": cloud, "a": ids[a[keep]], "b": ids[b[keep]], "dist": dist[keep], "max_edge": np.full(int(keep.sum()), edge)})

    return some.groupBy("cloud_id").applyInArrow(run, f"cloud_id {kind('cloud_id')}, a {kind('point_id')}, b {kind('point_id')}, dist double, max_edge double")


def rips_complex(points: DataFrame, sample_size: int, percentile: float, seed: int, max_dim: int = 2) -> DataFrame:
    """The Vietoris-Rips complex of a sample, as ``witness_complex`` gives one; triangles join edges on shared ends."""
    edges = rips_edges(points, sample_size, percentile, seed)
    some = prepare.sample(points.select("cloud_id", "point_id", "coords").where("coords is not null"), sample_size, seed)
    none = F.lit(None).cast(points.schema["point_id"].dataType)
    simplices = some.select("cloud_id", F.lit(0).alias("dim"), F.col("point_id").alias("v0"), none.alias("v1"), none.alias("v2"), F.lit(0.0).alias("filtration"))
    if max_dim >= 1:
        simplices = simplices.unionByName(edges.select("cloud_id", F.lit(1).alias("dim"), F.col("a").alias("v0"), F.col("b").alias("v1"), none.alias("v2"), F.col("dist").alias("filtration")))
    if max_dim >= 2:
        e = lambda a, b, d: edges.select("cloud_id", F.col("a").alias(a), F.col("b").alias(b), F.col("dist").alias(d))
        corners = e("v0", "v1", "d01").join(e("v1", "v2", "d12"), ["cloud_id", "v1"]).join(e("v0", "v2", "d02"), ["cloud_id", "v0", "v2"])
        simplices = simplices.unionByName(corners.select("cloud_id", F.lit(2).alias("dim"), "v0", "v1", "v2", F.greatest("d01", "d12", "d02").alias("filtration")))
    return simplices


def bottleneck(a: np.ndarray, b: np.ndarray) -> float:
    """Exact bottleneck distance of two diagrams: the least of the candidate costs under which all can be matched."""
    fa, fb = a[np.isfinite(a[:, 1])], b[np.isfinite(b[:, 1])]
    ea, eb = np.sort(a[~np.isfinite(a[:, 1]), 0]), np.sort(b[~np.isfinite(b[:, 1]), 0])
    if len(ea) != len(eb):
        return np.inf
    endless = float(np.abs(ea - eb).max(initial=0.0))
    n, m = len(fa), len(fb)
    if n + m == 0:
        return endless
    cost = np.maximum(np.abs(fa[:, None, 0] - fb[None, :, 0]), np.abs(fa[:, None, 1] - fb[None, :, 1]))
    own_a, own_b = (fa[:, 1] - fa[:, 0]) / 2, (fb[:, 1] - fb[:, 0]) / 2
    values = np.unique(np.concatenate([cost.ravel(), own_a, own_b, [0.0]]))

    def fits(limit: float) -> bool:
        # every point with a long life needs a partner of the other side; two one-sided matchings combine into one
        near = cost <= limit
        return _covers(near, np.flatnonzero(own_a > limit)) and _covers(near.T, np.flatnonzero(own_b > limit))

    low, high = 0, len(values) - 1
    while low < high:
        middle = (low + high) // 2
        if fits(values[middle]):
            high = middle
        else:
            low = middle + 1
    return max(endless, float(values[low]))


def _covers(near: np.ndarray, rows: np.ndarray) -> bool:
    """Whether the given rows can be matched to distinct columns."""
    partner: dict[int, int] = {}

    def augment(start: int) -> bool:
        stack, seen, via = [start], set(), {}
        while stack:
            row = stack.pop()
            for column in np.flatnonzero(near[row]).tolist():
                if column in seen:
                    continue
                seen.add(column)
                via[column] = row
                if column not in partner:
                    while True:
                        owner = via[column]
                        previous = next((c for c, r in partner.items() if r == owner), None)
                        partner[column] = owner
                        if owner == start:
                            return True
                        column = previous
                stack.append(partner[column])
        return False

    return all(augment(int(r)) for r in rows)


def bottleneck_distances(a: DataFrame, b: DataFrame) -> DataFrame:
    """``(cloud_id, dim, bottleneck)`` between the diagrams of two tables; a diagram missing on one side is empty."""
    kind = a.schema["cloud_id"].dataType.simpleString()

    def run(key: tuple, x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        value = bottleneck(x[["birth", "death"]].to_numpy(float), y[["birth", "death"]].to_numpy(float))
        return pd.DataFrame({"cloud_id": [key[0]], "dim": [key[1]], "bottleneck": [value]})

    return a.groupBy("cloud_id", "dim").cogroup(b.groupBy("cloud_id", "dim")).applyInPandas(run, f"cloud_id {kind}, dim int, bottleneck double")
