"""Witness complexes as grouped aggregates over nearest-landmark lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topospark.operators import knn, prepare

WITNESS_SEED = 42  # the same witnesses whatever the seed of a run


def witness_complex(points: DataFrame, landmarks: DataFrame, k: int = 8, max_dim: int = 2, max_filtration: float | None = None, landmark_bound: int | None = None, max_witnesses: int | None = None) -> DataFrame:
    """Simplices ``(cloud_id, dim, v0, v1, v2, filtration)`` with v0 < v1 < v2, null beyond the dimension.

    A simplex is there if some witness has all its vertices among its ``k`` nearest landmarks;
    it enters at the least, over those witnesses, of the largest distance to a vertex. Vertices
    enter at 0. Lists are in order of distance, so the largest distance is that of the last
    vertex; minima are taken map-side before the only shuffle, a filtration limit before them.
    With ``max_witnesses`` at most so many drawn points of a cloud are witnesses; a landmark that
    none of them sees is no vertex.
    """
    at = points.join(landmarks.select("cloud_id", "point_id"), ["cloud_id", "point_id"], "left_semi")
    witnesses = points if max_witnesses is None else prepare.sample(points, max_witnesses, WITNESS_SEED)
    near = knn.nearest(witnesses, at, k, target_bound=landmark_bound)
    return complex_of(near, max_dim, max_filtration)


def complex_of(near: DataFrame, max_dim: int = 2, max_filtration: float | None = None) -> DataFrame:
    """The complex of nearest-landmark lists ``(cloud_id, neighbours)``."""
    nb = F.col("neighbours")
    none = F.lit(None).cast(near.schema["neighbours"].dataType.elementType["id"].dataType)
    before = lambda j: F.slice(nb, 1, j)  # noqa: E731  (the first j, for a place j from 0)

    def simplex(dim, ids, dist):
        v = F.array_sort(F.array(*ids))
        at = [F.get(v, F.lit(i)) if i < len(ids) else none for i in range(3)]
        return F.struct(F.lit(dim).alias("dim"), *[a.alias(f"v{i}") for i, a in enumerate(at)], dist.alias("filtration"))

    parts = [F.transform(nb, lambda y: simplex(0, [y["id"]], F.lit(0.0)))]
    if max_dim >= 1:
        parts.append(F.flatten(F.transform(nb, lambda y, j: F.transform(before(j), lambda x: simplex(1, [x["id"], y["id"]], y["dist"])))))
    if max_dim >= 2:
        parts.append(F.flatten(F.flatten(F.transform(nb, lambda z, j: F.transform(before(j), lambda y, i: F.transform(before(i), lambda x: simplex(2, [x["id"], y["id"], z["id"]], z["dist"])))))))
    rows = near.select("cloud_id", F.inline(F.concat(*parts)))
    if max_filtration is not None:
        rows = rows.where(F.col("filtration") <= max_filtration)
    return rows.groupBy("cloud_id", "dim", "v0", "v1", "v2").agg(F.min("filtration").alias("filtration"))
