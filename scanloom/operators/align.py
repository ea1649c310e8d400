"""Time warps: applying them, choosing a central series, and finding them."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .joins import _around
from .series import normalised, resample


def warp(rows: DataFrame, t: str, anchors: DataFrame, on: Sequence[str], inverse: bool = False, out: str = "warped") -> DataFrame:
    """``rows`` with t mapped through the anchors (on, t_src, t_dst), linear in between.

    Before the first anchor times are shifted by its difference; at and after the last the last target is returned.
    """
    src, dst = ("t_dst", "t_src") if inverse else ("t_src", "t_dst")
    near = _around(rows, t, anchors, src, F.col(dst), on)
    a, b = F.col("_prev"), F.col("_next")
    span = b["t"] - a["t"]
    inside = a["v"] + (b["v"] - a["v"]) * (F.col(t) - a["t"]) / F.when(span > 0, span)
    value = F.when(a.isNull(), F.col(t) + b["v"] - b["t"]).when(b.isNull(), a["v"]).otherwise(F.coalesce(inside, a["v"]))
    return near.withColumn(out, value).drop("_prev", "_next")


def central_series(series: DataFrame, n: int = 64) -> DataFrame:
    """(channel, score): for each series, resampled to n points and normalised, the sum of its dot products with the others."""
    even = normalised(resample(series, ["channel"], n), ["channel"]).select("channel", "k", "y")
    # The sum over the others' dot products is the dot product with the others' sum: no join of pairs.
    whole = even.groupBy("k").agg(F.sum("y").alias("s"))
    return even.join(whole, "k").groupBy("channel").agg(F.sum(F.col("y") * (F.col("s") - F.col("y"))).alias("score"))


def warp_path(a: np.ndarray, b: np.ndarray, segments: int = 8, slack: int = 4) -> list[tuple[int, int]]:
    """Correlation-optimised warping: end points of equal segments of ``a`` and where each goes in ``b``, by dynamic programming.

    A segment may be longer or shorter by up to ``slack``; its score is minus the sum of squared differences after stretching.
    """
    edges = np.linspace(0, len(a) - 1, segments + 1).round().astype(int)
    best = {0: (0.0, [0])}
    for s in range(segments):
        now: dict[int, tuple[float, list[int]]] = {}
        want, left = edges[s + 1] - edges[s], segments - s - 1
        part = a[edges[s] : edges[s + 1] + 1]
        for start, (score, path) in best.items():
            for size in range(max(1, want - slack), want + slack + 1):
                end = start + size
                if end > len(b) - 1 or (not left and end != len(b) - 1):
                    continue
                stretched = np.interp(np.linspace(start, end, len(part)), np.arange(len(b)), b)
                total = score - float(((part - stretched) ** 2).sum()) - 1e-9 * abs(size - want)
                if end not in now or total > now[end][0]:
                    now[end] = (total, [*path, end])
        best = now
    if len(b) - 1 not in best:
        return [(0, 0), (len(a) - 1, len(b) - 1)]
    return list(zip(edges.tolist(), best[len(b) - 1][1], strict=True))


def find_warps(series: DataFrame, reference: str, n: int = 64, segments: int = 8, slack: int = 4) -> DataFrame:
    """(channel, i, t_src, t_dst): anchors from each series to the reference one. A series is n numbers here, so a group is small."""
    even = normalised(resample(series, ["channel"], n), ["channel"])
    ref = even.where(F.col("channel") == reference).select("k", F.col("t").alias("rt"), F.col("y").alias("ry"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("k")
        path = warp_path(pdf["y"].to_numpy(), pdf["ry"].to_numpy(), segments, slack)
        t, rt = pdf["t"].to_numpy(), pdf["rt"].to_numpy()
        return pd.DataFrame({"channel": pdf["channel"].iloc[0], "i": range(len(path)), "t_src": [t[i] for i, _ in path], "t_dst": [rt[j] for _, j in path]})

    return even.join(ref, "k").groupBy("channel").applyInPandas(run, "channel string, i int, t_src double, t_dst double")
