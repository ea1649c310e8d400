"""Ordered series (key columns, i, t, y): extrema, areas, interpolation, moving windows, smoothing, peaks.

All but the recursive detectors are windows over (key) ordered by i. A key is one series of one run; its rows must fit a task's sort, not its memory.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import stored
from .joins import interpolate, interval_join
from .spectra import spaced_top_k


def _order(on: Sequence[str], by: str = "i"):
    return Window.partitionBy(*on).orderBy(by)


def extrema(series: DataFrame, on: Sequence[str]) -> DataFrame:
    """(on, i, t, y, kind): kind 1 for local maxima, -1 for local minima.

    Equal neighbours are one run, reported at its right end. Inner runs compare with both sides, the last one with its left; the first only if it has
    one point, with its right. A constant series has none.
    """
    w = _order(on)
    # Right ends of runs: a next value that is equal goes on with the run, nulls don't. They stay in order, so the whole takes one sort and no aggregate.
    ends = series.withColumns({"_n": F.row_number().over(w), "_more": F.coalesce(F.lead("y").over(w) == F.col("y"), F.lit(False))}).where("not _more")
    n = F.col("_n") - F.coalesce(F.lag("_n").over(w), F.lit(0))
    left, right = F.signum(F.col("y") - F.lag("y").over(w)), F.signum(F.col("y") - F.lead("y").over(w))
    kind = F.when(left.isNull() & right.isNull(), 0).when(left.isNull(), F.when(n == 1, right).otherwise(0)).when(right.isNull(), left).otherwise(F.when(left == right, left).otherwise(0))
    return ends.withColumn("kind", kind.cast("int")).where("kind <> 0").select(*on, "i", "t", "y", "kind")


def centroid3(series: DataFrame, on: Sequence[str]) -> DataFrame:
    """(on, i, t, y): at each local maximum the intensity-weighted mean t of it and its neighbours; ends as they are."""
    w = _order(on)
    near = series.withColumns({"t0": F.lag("t").over(w), "y0": F.lag("y").over(w), "t2": F.lead("t").over(w), "y2": F.lead("y").over(w)})
    tops = extrema(series, on).where("kind = 1").select(*on, "i")
    total = F.col("y0") + F.col("y") + F.col("y2")
    mean = (F.col("t0") * F.col("y0") + F.col("t") * F.col("y") + F.col("t2") * F.col("y2")) / F.when(total > 1e-5, total)
    return near.join(tops, [*on, "i"]).select(*on, "i", F.coalesce(mean, F.col("t")).alias("t"), "y")


def area(series: DataFrame, ranges: DataFrame, on: Sequence[str], negative: str = "keep") -> DataFrame:
    """(on, area) of each series over its [t0, t1], trapezoids with interpolated ends clamped to the data.

    ``ranges``: (on, t0, t1), swapped if reversed. ``negative``: keep, clamp (total at 0 or more) or drop (pieces below the axis, segments
    split where they cross it). Ranges apart from the data, and of no width, have area 0.
    """
    ends = series.groupBy(*on).agg(F.min("t").alias("a"), F.max("t").alias("b"))
    r = ranges.join(ends, list(on)).select(*on, F.greatest(F.least("t0", "t1"), "a").alias("lo"), F.least(F.greatest("t0", "t1"), "b").alias("hi"))
    inner = series.join(r, list(on)).where(F.col("t").between(F.col("lo"), F.col("hi"))).select(*on, "t", "y", F.lit(1).alias("k"))
    edges = r.where("lo < hi").select(*on, F.explode(F.array(F.struct(F.col("lo").alias("t"), F.lit(0).alias("k")), F.struct(F.col("hi").alias("t"), F.lit(2).alias("k")))).alias("e")).select(*on, "e.*")
    edges = interpolate(edges, "t", series, "t", "y", on, True, "y").select(*on, "t", "y", "k")
    w = Window.partitionBy(*on).orderBy("t", "k")
    line = inner.unionByName(edges).withColumns({"t_": F.lag("t").over(w), "y_": F.lag("y").over(w)})
    dt, a, b = F.col("t") - F.col("t_"), F.col("y_"), F.col("y")
    piece = dt * (a + b) / 2
    if negative == "drop":
        cross = (a < 0) != (b < 0)
        top = F.greatest(a, b)
        piece = F.when(cross, dt * top * top / F.nullif(F.abs(a - b), F.lit(0.0)) / 2).otherwise(F.greatest(piece, F.lit(0.0)))
    sums = line.groupBy(*on).agg(F.coalesce(F.sum(piece), F.lit(0.0)).alias("area"))
    out = r.select(*on, "lo", "hi").join(sums, list(on), "left").withColumn("area", F.when(F.col("lo") < F.col("hi"), F.coalesce("area", F.lit(0.0))).otherwise(0.0))
    return out.select(*on, (F.greatest(F.col("area"), F.lit(0.0)) if negative == "clamp" else F.col("area")).alias("area"))


def resample(series: DataFrame, on: Sequence[str], n: int) -> DataFrame:
    """(on, k, t, y): n equally spaced points of each series from its first to its last t."""
    ends = series.groupBy(*on).agg(F.min("t").alias("a"), F.max("t").alias("b"))
    grid = ends.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("t", F.col("a") + (F.col("b") - F.col("a")) * F.col("k") / max(n - 1, 1)).select(*on, "k", "t")
    return interpolate(grid, "t", series, "t", "y", on, True, "y").select(*on, "k", "t", "y")


def interp_grid(series: DataFrame, on: Sequence[str], start: float, step: float, n: int) -> DataFrame:
    """(on, k, t, y) at start + k * step, 0 outside the data."""
    grid = series.select(*on).distinct().withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("t", F.lit(start) + F.col("k") * step)
    return interpolate(grid, "t", series, "t", "y", on, False, "y").select(*on, "k", "t", "y")


def moving(series: DataFrame, on: Sequence[str], half: int, how: str) -> DataFrame:
    """(on, i, t, y): ``avg`` or upper ``median`` of exactly 2 * half + 1 points; at the ends the window is shifted inward, not cut."""
    n = F.count("*").over(Window.partitionBy(*on))
    # A frame twice as wide holds the shifted window; its part is taken by position.
    w = _order(on).rowsBetween(-2 * half, 2 * half)
    rows = series.withColumn("_n", n).withColumn("_w", F.collect_list(F.struct("i", "y")).over(w))
    lo = F.least(F.greatest(F.col("i") - 1 - half, F.lit(0)), F.greatest(F.col("_n") - 1 - 2 * half, F.lit(0)))
    hi = F.least(F.col("_n") - 1, lo + 2 * half)
    ys = F.transform(F.filter("_w", lambda p: (p["i"] - 1).between(lo, hi)), lambda p: p["y"])
    if how == "avg":
        value = F.aggregate(ys, F.lit(0.0), lambda s, y: s + y) / F.size(ys)
    else:
        value = F.element_at(F.array_sort(ys), F.floor(F.size(ys) / 2).cast("int") + 1)
    return rows.select(*on, "i", "t", value.alias("y"))


def convolve(series: DataFrame, on: Sequence[str], kernel: Sequence[float], copy_end: bool = False) -> DataFrame:
    """(on, i, t, y): same-length convolution with an odd kernel; beyond the ends 0 or the end's value."""
    if len(kernel) % 2 == 0:
        raise ValueError("the kernel must be odd")
    half, w = len(kernel) // 2, _order(on)
    whole = Window.partitionBy(*on).orderBy("i").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    first, last = (F.first("y").over(whole), F.last("y").over(whole)) if copy_end else (F.lit(0.0), F.lit(0.0))
    total: Column = F.lit(0.0)
    for k, c in enumerate(kernel):
        d = half - k
        y = F.lead("y", d).over(w) if d > 0 else F.lag("y", -d).over(w) if d < 0 else F.col("y")
        total = total + c * F.coalesce(y, last if d > 0 else first)
    return series.select(*on, "i", "t", total.alias("y"))


def gaussian_kernel(sigma: float) -> list[float]:
    """Normalised, with half-width floor(3 sigma + 1)."""
    half = int(3 * sigma + 1)
    k = np.exp(-0.5 * (np.arange(-half, half + 1) / sigma) ** 2)
    return (k / k.sum()).tolist()


def smooth_centroids(series: DataFrame, on: Sequence[str], sigma: float, radius: float, k: int) -> DataFrame:
    """(on, t, y): centroids of the smoothed series, the strongest first: one that lies nearer than ``radius`` to a stronger one is merged into it, and at most
    ``k`` of each key are left. ``on`` names single scans, whose centroids are one array; ``sigma`` counts points.
    """
    tops = centroid3(convolve(series, on, gaussian_kernel(sigma), True), on)
    lists = tops.groupBy(*on).agg(F.collect_list(F.struct(F.col("t").alias("x"), "y")).alias("_p"))
    return lists.select(*on, F.explode(spaced_top_k(F.col("_p"), k, radius)).alias("p")).select(*on, F.col("p.x").alias("t"), "p.y")


def islands(points: DataFrame, on: Sequence[str], x: str, gap: float, least: int = 1) -> DataFrame:
    """(on, island, lo, hi, n): runs of x whose neighbours are at most ``gap`` apart, with ``least`` members or more."""
    w = Window.partitionBy(*on).orderBy(x)
    new = F.coalesce((F.col(x) - F.lag(x).over(w) > gap).cast("int"), F.lit(0))
    marked = points.withColumn("_new", new).withColumn("island", F.sum("_new").over(w))
    return marked.groupBy(*on, "island").agg(F.min(x).alias("lo"), F.max(x).alias("hi"), F.count("*").alias("n")).where(F.col("n") >= least)


def every_kth(series: DataFrame, k: int) -> DataFrame:
    return series.where((F.col("i") - 1) % k == 0)


def subtract_baseline(series: DataFrame, base: DataFrame, on: Sequence[str]) -> DataFrame:
    """(on, i, t, y) minus the base series interpolated at t."""
    return interpolate(series, "t", base, "t", "y", on, True, "_b").withColumn("y", F.col("y") - F.col("_b")).select(*on, "i", "t", "y")


def normalised(series: DataFrame, on: Sequence[str]) -> DataFrame:
    """y over the series' largest y."""
    top = F.max("y").over(Window.partitionBy(*on))
    return series.withColumn("y", F.coalesce(F.col("y") / F.when(top != 0, top), F.lit(0.0)))


def nearest_extremum_to_middle(series: DataFrame, on: Sequence[str], kind: int) -> DataFrame:
    """(on, i, t, y): the local extremum closest to the middle index, the middle point where there is none."""
    n = series.groupBy(*on).agg(F.count("*").alias("n"))
    mid = F.expr("n div 2 + 1")
    best = extrema(series, on).where(F.col("kind") == kind).join(n, list(on)).groupBy(*on).agg(F.min_by("i", F.struct(F.abs(F.col("i") - mid), F.col("i"))).alias("b"))
    return series.join(n, list(on)).join(best, list(on), "left").where(F.col("i") == F.coalesce("b", mid)).select(*on, "i", "t", "y")


# Recursive detectors: sequential by nature, so each series passes through one task, sorted, as a stream with a state of fixed size.


def streamed(rows: DataFrame, key: str, names: Sequence[str], state: Callable, schema: str) -> DataFrame:
    """``state()`` makes a new state for each key: a function from a row of ``names``, in order of the first of them, to the output rows after the key."""
    kind = rows.schema[key].dataType.simpleString()
    fields = [f.split() for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, see = None, None
        types = [pa.int32() if t == "int" else pa.float64() for _, t in fields]
        for b in batches:
            out = []
            for k, *row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if see is None or k != at:
                    at, see = k, state()
                out += [(k, *r) for r in see(*row)]
            columns = list(zip(*out, strict=True)) if out else [[]] * (len(types) + 1)
            arrays = [pa.array(c, t) for c, t in zip(columns, [b.schema.field(0).type, *types], strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, names=[key, *(f for f, _ in fields)])

    ordered = rows.select(key, *names).repartition(key).sortWithinPartitions(key, names[0])
    return ordered.mapInArrow(run, f"{key} {kind}, {schema}")


class _Turns:
    """Where a series turns down for good: its highest point while it rises, its lowest value while it falls."""

    def __init__(self) -> None:
        self.high: tuple | None = None  # while it rises
        self.low: float | None = None  # while it falls

    def __call__(self, i: int, t: float, y: float, v: float, least: float, selectivity: float, last: bool) -> list:
        out = []
        if self.high is None:
            self.low = min(least if self.low is None else self.low, v)
            if v - self.low > selectivity:
                self.high = i, t, y, v
        elif v > self.high[3]:
            self.high = i, t, y, v
        elif self.high[3] - v > selectivity:
            out, self.high, self.low = [self.high[:3]], None, v
        return [*out, self.high[:3]] if last and self.high else out


def peaks(series: DataFrame, key: str, selectivity: float | Column, kind: int = 1) -> DataFrame:
    """(key, i, t, y) of the peaks of each series (``kind`` -1: of its valleys): the maxima with a prominence above ``selectivity``.

    From a peak down to the least value before the next point that is higher, the series falls by more than ``selectivity``, to the left as to the right. Where no
    higher point comes, the series counts as falling to the least of its extrema beyond that end: so a series that ends high has a peak there. Of equal maxima
    without such a fall between them the first is the peak. ``selectivity`` may be a column of the series, one value for each key.

    These are the points where a series turns down after a rise, turns of ``selectivity`` or less left out, so one pass with one number of state finds them.
    """
    values = series.groupBy(key).agg(F.max(selectivity).alias("sel")) if isinstance(selectivity, Column) else None
    return _turns(stored(extrema(series, [key])), key, float(selectivity) if values is None else values, kind)


def _turns(e: DataFrame, key: str, selectivity: float | DataFrame, kind: int) -> DataFrame:
    """``peaks`` from the series' extrema, which are read twice; the selectivity one number, or (key, sel)."""
    e = e.withColumn("v", F.col("y") * kind)
    ends = e.groupBy(key).agg(F.min("v").alias("least"), F.max("i").alias("_end"))
    ends = ends.join(selectivity, key) if isinstance(selectivity, DataFrame) else ends.withColumn("sel", F.lit(selectivity))
    rows = e.join(ends, key).withColumn("last", F.col("i") == F.col("_end"))
    return streamed(rows, key, ("i", "t", "y", "v", "least", "sel", "last"), _Turns, "i int, t double, y double")


def peak_intervals(series: DataFrame, key: str, share: float, least_points: int = 3) -> DataFrame:
    """(key, first, last, apex): intervals of positions that cover each series in order and meet at their ends only.

    A peak's interval reaches from the valley before it to the valley after it, or to the series' end; peaks and valleys are those of ``share`` of the largest absolute
    value. Of peaks between the same valleys the highest stays (the first of equals). What is left between intervals, and before and after them, is filled by
    intervals with a null apex. A series of fewer than ``least_points`` points, and one without a peak, is one interval, with a null apex.
    """
    scale = series.groupBy(key).agg(F.max(F.abs("y")).alias("_top"), F.min("i").alias("_a"), F.max("i").alias("_b"), F.count("*").alias("_n"))
    long = stored(series.join(scale, key).where(F.col("_n") >= least_points).withColumn("_sel", F.col("_top") * share).select(key, "i", "t", "y", "_sel"))
    e, sel = stored(extrema(long, [key])), long.groupBy(key).agg(F.max("_sel").alias("sel"))
    tops = _turns(e, key, sel, 1).select(key, "i", "y")
    turns = tops.unionByName(_turns(e, key, sel, -1).select(key, "i", F.lit(None).cast("double").alias("y"))).join(scale.select(key, "_a", "_b"), key)
    valley = F.when(F.col("y").isNull(), F.col("i"))
    before, after = Window.partitionBy(key).orderBy("i").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(key).orderBy(F.desc("i")).rowsBetween(Window.unboundedPreceding, -1)
    bound = turns.withColumns({"first": F.coalesce(F.last(valley, True).over(before), "_a"), "last": F.coalesce(F.last(valley, True).over(after), "_b")}).where("y is not null")
    found = bound.groupBy(key, "first", "last").agg(F.min_by("i", F.struct(-F.col("y"), F.col("i"))).alias("apex"))
    # Markers of no length at both ends, so that gaps there are gaps between neighbours as well.
    ends = scale.select(key, F.explode(F.array(F.col("_a"), F.col("_b"))).alias("first")).withColumns({"last": F.col("first"), "apex": F.lit(None).cast("int"), "end": F.lit(True)})
    line = found.withColumn("end", F.lit(False)).unionByName(ends.withColumn("apex", F.col("apex").cast(found.schema["apex"].dataType)))
    w = Window.partitionBy(key).orderBy("first", "last")
    gap = line.withColumn("_was", F.lag("last").over(w)).where("_was < first").select(key, F.col("_was").alias("first"), F.col("first").alias("last"), F.lit(None).cast(found.schema["apex"].dataType).alias("apex"))
    alone = scale.where("_a = _b").select(key, F.col("_a").alias("first"), F.col("_b").alias("last"), F.lit(None).cast(found.schema["apex"].dataType).alias("apex"))
    return found.unionByName(gap).unionByName(alone)


def peak_intervals_nested(series: DataFrame, key: str, share: float, least_points: int = 3, depth: int = 4) -> DataFrame:
    """``peak_intervals`` again inside each interval, on its own scale, up to ``depth`` times or until none is cut any more. (key, first, last, apex)."""
    names = series.schema[key].dataType
    now = stored(peak_intervals(series, key, share, least_points))
    done: list[DataFrame] = []
    for _ in range(depth):
        part = interval_join(series, "i", now.select(F.col(key), "first", "last"), "first", "last", 64.0, [key])
        piece = part.select(F.struct(F.col(key).alias("k"), F.col("first").alias("f"), F.col("last").alias("l")).cast("string").alias("_piece"), F.col(key).alias("_key"), "first", "last", "i", "t", "y")
        whole = piece.select("_piece", "_key", F.col("first").alias("_f"), F.col("last").alias("_l")).distinct()
        cut = peak_intervals(piece.select("_piece", "i", "t", "y"), "_piece", share, least_points).join(whole, "_piece")
        cut = stored(cut.withColumn("_same", (F.col("first") == F.col("_f")) & (F.col("last") == F.col("_l"))))
        more = cut.where("not _same").select(F.col("_key").cast(names).alias(key), "first", "last", "apex")
        kept = cut.where("_same").select(F.col("_key").cast(names).alias(key), "first", "last").join(now, [key, "first", "last"])
        done.append(kept.select(key, "first", "last", "apex"))
        now = stored(more)
        if now.isEmpty():
            break
    out = now
    for d in done:
        out = out.unionByName(d)
    return out


def nth_maximum(series: DataFrame, key: str, k: int) -> DataFrame:
    """(key, value): the k-th largest local maximum from 0, the smallest if there are fewer, 0 if there is none."""
    return _nth(series.select(key).distinct(), extrema(series, [key]), key, k)


def _nth(keys: DataFrame, e: DataFrame, key: str, k: int) -> DataFrame:
    # The bound stands on the rank itself, so each task keeps k + 1 rows of a key before they are shuffled.
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("y")))
    found = e.where("kind = 1").withColumn("_r", rank).where(F.col("_r") <= k + 1).groupBy(key).agg(F.min("y").alias("value"))
    return keys.join(found, key, "left").select(key, F.coalesce("value", F.lit(0.0)).alias("value"))


def peaks_relative(series: DataFrame, key: str, share: float, k: int = 0) -> DataFrame:
    """``peaks`` with ``share`` of the k-th largest maximum as selectivity.

    Extrema are found and stored once: no task holds more sorts of a series at a time than that takes.
    """
    e = stored(extrema(series, [key]))
    return _turns(e, key, _nth(e.select(key).distinct(), e, key, k).select(key, (F.col("value") * share).alias("sel")), 1)


def zscore_flags(series: DataFrame, key: str, lag: int, threshold: float, influence: float) -> DataFrame:
    """(key, i, flag) of the flagged points of each series: +1 above, -1 below the mean of the window by more than ``threshold`` deviations.

    The window holds ``lag`` filtered values and ends one point before the last one (for the first tested point, the ``lag`` points before it). The filtered value of
    a flagged point is ``influence`` of it and the rest of the last filtered one.
    """

    def state() -> Callable:
        held: deque = deque(maxlen=lag + 1)

        def see(i: int, y: float) -> list:
            if len(held) < lag:
                held.append(y)
                return []
            window = np.fromiter(held, float)[:lag]
            mean, flag = window.mean(), 0
            if abs(y - mean) > threshold * window.std():
                flag = 1 if y > mean else -1
            held.append(influence * y + (1 - influence) * held[-1] if flag else y)
            return [(i, flag)] if flag else []

        return see

    return streamed(series, key, ("i", "y"), state, "i int, flag int")


def flag_intervals(series: DataFrame, flags: DataFrame, key: str) -> DataFrame:
    """(key, first, last): from each +1 flag that follows an unflagged point, or one below, to the last point before the next unflagged one.

    A -1 neither starts nor ends an interval; one that is open at the series' end is dropped.
    """
    w = Window.partitionBy(key).orderBy("i")
    rows = series.select(key, "i").join(flags, [key, "i"], "left").withColumn("flag", F.coalesce("flag", F.lit(0)))
    marks = rows.where("flag <> -1").withColumns({"_was": F.coalesce(F.lag("flag").over(w), F.lit(0))}).where("flag <> _was")
    ends = marks.withColumn("last", F.lead("i").over(w) - 1)
    return ends.where("flag = 1 and last is not null").select(key, F.col("i").alias("first"), "last")
