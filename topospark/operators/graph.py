"""Adjacency, Laplacians and spectral smoothing of edge lists."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def adjacency(edges: DataFrame) -> DataFrame:
    """``(graph, u, v, weight)``: how often each directed edge occurs."""
    return edges.groupBy("graph", "u", "v").agg(F.count(F.lit(1)).cast("double").alias("weight"))


def laplacian(edges: DataFrame) -> DataFrame:
    """Entries ``(graph, i, j, value)`` of D - (A + A') / 2, zero entries left out."""
    a = adjacency(edges)
    half = F.col("weight") / 2
    both = a.select("graph", F.col("u").alias("i"), F.col("v").alias("j"), half.alias("w")).unionByName(a.select("graph", F.col("v").alias("i"), F.col("u").alias("j"), half.alias("w")))
    degrees = both.select("graph", "i", F.col("i").alias("j"), F.col("w").alias("value"))
    return degrees.unionByName(both.select("graph", "i", "j", (-F.col("w")).alias("value"))).groupBy("graph", "i", "j").agg(F.sum("value").alias("value")).where("value <> 0")


def low_pass(signals: DataFrame, entries: DataFrame, keep: float = 0.2) -> DataFrame:
    """``(graph, i, value)``: signals ``(graph, i, value)`` on the part of the spectrum with the lowest frequencies.

    One graph is one small dense problem (its vertices are landmarks); graphs run side by side.
    """
    kind = lambda c: signals.schema[c].dataType.simpleString()

    def run(key: tuple, s: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        s = s.sort_values("i").reset_index(drop=True)
        place = {v: n for n, v in enumerate(s["i"])}
        matrix = np.zeros((len(s), len(s)))
        for i, j, value in zip(e["i"], e["j"], e["value"], strict=True):
            if i in place and j in place:
                matrix[place[i], place[j]] += value
        basis = np.linalg.eigh(matrix)[1][:, : max(1, int(np.ceil(keep * len(s))))] if len(s) else np.zeros((0, 0))
        return pd.DataFrame({"graph": [key[0]] * len(s), "i": s["i"], "value": basis @ (basis.T @ s["value"].to_numpy())})

    return signals.groupBy("graph").cogroup(entries.groupBy("graph")).applyInPandas(run, f"graph {kind('graph')}, i {kind('i')}, value double")
