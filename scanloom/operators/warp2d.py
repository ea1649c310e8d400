"""Time warps from whole spectra: correlation-optimised warping over sparse scores of pairs of scans.

Two scans are alike by the points that they share: pairs of points within ``ppm`` add the geometric mean of their intensities, each scan's intensities scaled to a sum of 1. Only
scans whose numbers differ by the skew limit or less are compared, so the scores of a run and its reference are a sparse band. The geometric mean is a product of roots, so
pairs of points aren't made: a reference point is met by the sum of the roots within its tolerance, from running sums over the scan's sorted points. Work is cut by
bands of scans and slices of m/z. A run's band of scores is then one task's work: segments of equal length are stretched or shrunk, and a dynamic programme finds the
ends that gather the highest score.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import stored


#: Rows of a band of scans and a slice of m/z, about.
ROWS_PER_GROUP = 250_000


def _gathered(points: DataFrame, on: list[str]) -> DataFrame:
    """(on, mz, root, total): the sums of intensities and of their roots at each m/z of a scan; null where no point has both."""
    good = (F.col("mz") > 0) & (F.col("intensity") > 0)
    return points.groupBy(*on, "mz").agg(F.sum(F.when(good, F.sqrt("intensity"))).alias("root"), F.sum(F.when(good, F.col("intensity"))).alias("total"))


def scan_scores(points: DataFrame, reference: DataFrame, skew: int, ppm: float) -> DataFrame:
    """(run, i, j, score) of scans i of a run and j of the reference, |i - j| <= ``skew``, that share points. Points: (run, idx, mz, intensity), the reference's without run."""
    return _scores(stored(_gathered(points, ["run", "idx"])), stored(_gathered(reference, ["idx"])), skew, ppm)


def _scores(points: DataFrame, reference: DataFrame, skew: int, ppm: float) -> DataFrame:
    """``scan_scores`` of gathered points, which are read more than once."""
    good = (F.col("idx").isNotNull() & F.col("root").isNotNull(), F.abs("mz") < F.lit(float("inf")))
    mine, theirs = points.where(good[0]), reference.where(good[0])
    wide, kind = 2 * skew + 1, points.schema["run"].dataType.simpleString()
    band = lambda c: F.floor(c / F.lit(wide)).cast("long")
    known = mine.where(good[1]).agg(F.count("*").alias("n"), F.count_distinct(band(F.col("idx"))).alias("bands"), F.percentile_approx("mz", [k / 1000 for k in range(1, 1000)], 10_000).alias("at")).first()
    slices = min(-(-known["n"] // (ROWS_PER_GROUP * max(known["bands"], 1))), 1000)
    cuts: list[float] = []
    for k in range(1, slices):
        cut = known["at"][max(k * 1000 // slices - 1, 0)]
        if not cuts or cut > cuts[-1] * (1 + 8 * ppm / 1e6):
            cuts.append(cut)
    part = lambda c: reduce(add, [(c >= F.lit(x)).cast("int") for x in cuts], F.lit(0))
    each = lambda lo, hi: F.explode(F.sequence(lo, hi))
    idx, mz, off = F.col("idx").cast("long"), F.col("mz"), F.col("mz") * (ppm / 1e6 * (1 + 1e-9) + 1e-12)
    a = mine.where(good[1]).select("run", idx.alias("idx"), mz.cast("double").alias("mz"), "root", F.lit(False).alias("ref"), band(idx).alias("band"), part(mz).alias("slice"))
    b = theirs.where(good[1]).select(F.lit(None).cast(kind).alias("run"), idx.alias("idx"), mz.cast("double").alias("mz"), "root", F.lit(True).alias("ref"))
    b = b.withColumn("band", each(band(F.col("idx") - skew), band(F.col("idx") + skew))).withColumn("slice", each(part(mz - off), part(mz + off)))

    def met(table: pa.Table) -> pa.Table:
        ref = table.column("ref").to_numpy().astype(bool)
        runs = table.column("run").combine_chunks().dictionary_encode("encode")
        columns = runs.indices.to_numpy(), *(table.column(c).to_numpy() for c in ("idx", "mz", "root"))
        order = np.lexsort((columns[2], columns[1], columns[0], ref))
        cut = len(ref) - int(ref.sum())
        (code, i, m1, r1), (_, j, m2, r2) = ([c[rows] for c in columns] for rows in (order[:cut], order[cut:]))
        first = np.flatnonzero(np.append(True, np.diff(j) != 0)) if len(j) else np.zeros(0, int)
        start = np.flatnonzero(np.append(True, (np.diff(code) != 0) | (np.diff(i) != 0))) if cut else np.zeros(0, int)
        reach = m2 * ppm / 1e6
        low, high = m2 - reach - 1e-15 * m2, (m2 + reach) * (1 + 1e-15)
        out: list[list[np.ndarray]] = [[np.zeros(0, int)] * 3 + [np.zeros(0)]]
        for s, e in zip(start.tolist(), np.append(start[1:], cut).tolist(), strict=False):
            x, sums = m1[s:e], np.append(0.0, np.cumsum(r1[s:e]))
            k, stop = np.searchsorted(j[first], [i[s] - skew, i[s] + skew + 1])
            if k == stop:
                continue
            f, t = first[k], first[stop] if stop < len(first) else len(j)
            y, d = m2[f:t], reach[f:t]
            lo, hi = np.searchsorted(x, low[f:t], "left"), np.searchsorted(x, high[f:t], "right")
            # The search was a little too wide; the difference decides.
            while (far := (lo < hi) & (y - x[np.minimum(lo, e - s - 1)] > d)).any():
                lo += far
            while (far := (lo < hi) & (x[hi - 1] - y > d)).any():
                hi -= far
            starts = first[k:stop] - f
            some = np.add.reduceat(hi - lo, starts) > 0
            score = np.add.reduceat((sums[hi] - sums[lo]) * r2[f:t], starts)[some]
            out.append([np.full(len(score), code[s]), np.full(len(score), i[s]), j[first[k:stop]][some], score])
        code, i, j, score = (np.concatenate(c) for c in zip(*out, strict=True))
        return pa.table({"run": runs.dictionary.take(pa.array(code)), "i": pa.array(i, pa.int64()), "j": pa.array(j, pa.int64()), "score": pa.array(score)})

    tasks = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pairs = a.unionByName(b).repartition(tasks, "band", "slice").groupBy("band", "slice").applyInArrow(met, f"run {kind}, i long, j long, score double")
    own = mine.groupBy("run", F.col("idx").cast("long").alias("i")).agg(F.sum("total").alias("t1"))
    other = theirs.groupBy(F.col("idx").cast("long").alias("j")).agg(F.sum("total").alias("t2"))
    both = pairs.groupBy("run", "i", "j").agg(F.sum("score").alias("score")).join(other, "j").alias("p").join(own.alias("o"), F.col("p.run").eqNullSafe(F.col("o.run")) & (F.col("p.i") == F.col("o.i")))
    return both.select("p.run", "p.i", "p.j", (F.col("score") / (F.sqrt("t1") * F.sqrt("t2"))).alias("score"))


def best_ends(score: dict[tuple[int, int], float], first: int, last: int, low: int, high: int, segment: int, stretch: float, skew: int, penalty: float = 0.0) -> list[tuple[int, int]]:
    """(i, j) of the segments' ends: scans first to last of the run go to scans low to high of the reference.

    A segment of n scans may become one of n (1 - stretch) to n (1 + stretch), and no end may be moved by more than ``skew``; a change of length costs
    ``penalty`` times the square of its share. Inside a segment places are linear, rounded half up. Of
    equal scores the smaller last end wins, segment by segment from the last.
    """
    ends = [*range(first, last, segment), last] if last > first else [first]
    best: dict[int, tuple[float, int | None]] = {j: (score.get((first, j), 0.0), None) for j in range(max(low, first - skew), min(high, first + skew) + 1)}
    trail = [best]
    for a, b in zip(ends, ends[1:]):
        n, now = b - a, {}
        sizes = range(max(0, int(np.ceil(n * (1 - stretch)))), int(np.floor(n * (1 + stretch))) + 1)
        steps = np.arange(1, n + 1)
        places = {size: np.floor(steps * size / n + 0.5).astype(int) for size in sizes}
        for j, (gathered, _) in best.items():
            for size in sizes:
                end = j + size
                if end > high or abs(end - b) > skew:
                    continue
                total = gathered - penalty * (size / n - 1) ** 2 + sum(score.get((a + int(s), j + int(p)), 0.0) for s, p in zip(steps, places[size]))
                if end not in now or (-total, j) < (-now[end][0], now[end][1]):
                    now[end] = (total, j)
        if not now:
            return [(first, low), (last, high)]  # the limits leave no way
        trail.append(now)
        best = now
    j = min(best, key=lambda e: (-best[e][0], e))
    path = []
    for i, at in zip(reversed(ends), reversed(trail)):
        path.append((i, j))
        j = at[j][1]
    return path[::-1]


def find_warps_2d(points: DataFrame, reference_run, segment: int = 50, stretch: float = 0.51, skew: int = 100, ppm: float = 20.0, penalty: float = 0.0) -> DataFrame:
    """(run, k, i, j): anchors from the scans i of each run to the scans j of the reference run, in order; the reference's own are the identity.

    ``points``: (run, idx, mz, intensity). A run none of whose scans shares a point with the reference is mapped as it lies.
    """
    kept = stored(_gathered(points.where("run is not null and idx is not null"), ["run", "idx"]))
    reference = kept.where(F.col("run") == F.lit(reference_run))
    span = reference.agg(F.min("idx").alias("low"), F.max("idx").alias("high")).first()
    kind = points.schema["run"].dataType.simpleString()
    if span["low"] is None:
        return points.sparkSession.createDataFrame([], f"run {kind}, k int, i long, j long")
    low, high = int(span["low"]), int(span["high"])
    scores = _scores(kept, reference.drop("run"), skew, ppm)
    # The run's own span comes first, as a row without a score.
    spans = kept.groupBy("run").agg(F.min("idx").alias("i"), F.max("idx").alias("j")).withColumn("score", F.lit(-1.0))
    rows = spans.select("run", F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), "score").unionByName(scores.select("run", F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), "score"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run, ends, score, kinds = None, None, {}, None

        def solved() -> pa.RecordBatch:
            path = best_ends(score, *ends, low, high, segment, stretch, skew, penalty)
            arrays = [pa.array([run] * len(path), kinds), pa.array(range(len(path)), pa.int32()), pa.array([i for i, _ in path], pa.int64()), pa.array([j for _, j in path], pa.int64())]
            return pa.RecordBatch.from_arrays(arrays, names=["run", "k", "i", "j"])

        for batch in batches:
            kinds = batch.schema.field(0).type
            for r, i, j, s in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if s < 0:
                    if ends is not None:
                        yield solved()
                    run, ends, score = r, (i, j), {}
                else:
                    score[i, j] = s
        if ends is not None:
            yield solved()

    return rows.repartition("run").sortWithinPartitions("run", "score").mapInArrow(work, f"run {kind}, k int, i long, j long")
