"""Chromatograms: totals, base peaks, extracted ions, prefix sums over scans."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .joins import asof_backward, asof_nearest, interval_join


def per_scan(scans: DataFrame, points: DataFrame, how: str, level: int = 1) -> DataFrame:
    """(run, scan, rt, intensity) with the ``sum`` or ``max`` of each scan; 0 for scans without points."""
    by = points.groupBy("scan").agg((F.sum if how == "sum" else F.max)("intensity").alias("intensity"))
    return scans.where(F.col("level") == level).join(by, "scan", "left").select("run", "scan", "rt", F.coalesce("intensity", F.lit(0.0)).alias("intensity"))


def tic(scans: DataFrame, points: DataFrame, level: int = 1) -> DataFrame:
    """Total intensity of each scan."""
    return per_scan(scans, points, "sum", level)


def bpc(scans: DataFrame, points: DataFrame, level: int = 1) -> DataFrame:
    """Largest intensity of each scan."""
    return per_scan(scans, points, "max", level)


def xic(scans: DataFrame, points: DataFrame, windows: DataFrame, level: int = 1, tile: float = 30.0, step: float = 8.0) -> DataFrame:
    """(window_id, run, scan, rt, intensity): for every scan in a window's closed time range the sum of intensities in its closed m/z range.

    Windows (window_id, mz_start, mz_end, time_start, time_end) have null for unbounded; empty scans give 0. Points meet
    windows by m/z tile, so the plan is one equi-join, one partial aggregation and the completion from the scans.
    """
    dim = scans.where(F.col("level") == level).select("run", "scan", "rt")
    ends = dim.agg(F.min("rt").alias("_a"), F.max("rt").alias("_b"))  # one row: bounds for unbounded windows
    w = windows.crossJoin(F.broadcast(ends)).select(
        "window_id",
        F.greatest(F.coalesce("time_start", "_a"), F.col("_a")).alias("t0"),
        F.least(F.coalesce("time_end", "_b"), F.col("_b")).alias("t1"),
        "mz_start",
        "mz_end",
    )
    wanted = interval_join(dim, "rt", w, "t0", "t1", step).select("window_id", "run", "scan", "rt", "mz_start", "mz_end")
    # Bounded windows meet points by m/z tile; those open at an end meet the points of their scans.
    bounded = w.where("mz_start is not null and mz_end is not null")
    hits = interval_join(points.join(dim, "scan"), "mz", bounded, "mz_start", "mz_end", tile).where(F.col("rt").between(F.col("t0"), F.col("t1")))
    open_ = wanted.where("mz_start is null or mz_end is null").join(points, "scan")
    open_ = open_.where(F.coalesce(F.col("mz") >= F.col("mz_start"), F.lit(True)) & F.coalesce(F.col("mz") <= F.col("mz_end"), F.lit(True)))
    some = hits.select("window_id", "scan", "intensity").unionByName(open_.select("window_id", "scan", "intensity"))
    sums = some.groupBy("window_id", "scan").agg(F.sum("intensity").alias("s"))
    return wanted.join(sums, ["window_id", "scan"], "left").select("window_id", "run", "scan", "rt", F.coalesce("s", F.lit(0.0)).alias("intensity"))


def scan_index(scans: DataFrame, level: int = 1) -> DataFrame:
    """(run, scan, rt, idx) in order of time."""
    order = Window.partitionBy("run").orderBy("rt", "scan")
    return scans.where(F.col("level") == level).withColumn("idx", F.row_number().over(order)).select("run", "scan", "rt", "idx")


def xic_snapped(scans: DataFrame, points: DataFrame, windows: DataFrame, level: int = 1, tile: float = 30.0) -> DataFrame:
    """As ``xic`` for (window_id, run, mz_start, mz_end, time_start, time_end), but both times are snapped to the nearest scans first."""
    dim = scan_index(scans, level)
    ends = asof_nearest(asof_nearest(windows, "time_start", dim, "rt", "idx", ["run"], "i0"), "time_end", dim, "rt", "idx", ["run"], "i1")
    wanted = interval_join(dim, "idx", ends.select("window_id", "run", "i0", "i1"), "i0", "i1", 64, ["run"])
    hits = interval_join(points.join(dim, "scan"), "mz", ends, "mz_start", "mz_end", tile, ["run"]).where(F.col("idx").between(F.col("i0"), F.col("i1")))
    sums = hits.groupBy("window_id", "scan").agg(F.sum("intensity").alias("s"))
    return wanted.join(sums, ["window_id", "scan"], "left").select("window_id", "run", "scan", "rt", F.coalesce("s", F.lit(0.0)).alias("intensity"))


def with_tiles(points: DataFrame, index: DataFrame, width: float = 30.0, height: int = 64) -> DataFrame:
    """Points with half-open tile columns, for partitioned and sorted writes."""
    return points.join(index.select("run", "scan", "rt", "idx"), "scan").withColumns({"tile_x": F.floor(F.col("mz") / width).cast("int"), "tile_y": F.expr(f"cast((idx - 1) div {height} as int)")})


def xic_tiled(tiled: DataFrame, index: DataFrame, windows: DataFrame, width: float = 30.0, height: int = 64, step: float = 8.0) -> DataFrame:
    """``xic`` over the tiled layout: windows become tiles, tiles are joined, the residual is exact."""
    span = interval_join(index, "rt", windows.select("window_id", "time_start", "time_end"), "time_start", "time_end", step)
    rows = span.groupBy("window_id", "run").agg(F.min("idx").alias("a"), F.max("idx").alias("b"))
    rect = rows.join(windows, "window_id").where("mz_start <= mz_end").withColumn("tile_x", F.explode(F.sequence(F.floor(F.col("mz_start") / width).cast("int"), F.floor(F.col("mz_end") / width).cast("int"))))
    rect = rect.withColumn("tile_y", F.explode(F.expr(f"sequence(cast((a - 1) div {height} as int), cast((b - 1) div {height} as int))")))
    exact = F.col("mz").between(F.col("mz_start"), F.col("mz_end")) & F.col("idx").between(F.col("a"), F.col("b"))
    sums = tiled.join(rect, ["run", "tile_x", "tile_y"]).where(exact).groupBy("window_id", "scan").agg(F.sum("intensity").alias("s"))
    return span.join(sums, ["window_id", "scan"], "left").select("window_id", "run", "scan", "rt", F.coalesce("s", F.lit(0.0)).alias("intensity"))


def prefix_sums(binned: DataFrame) -> DataFrame:
    """(run, bin, idx, prefix) from (run, bin, idx, y): running sums of each bin over the scans; the reusable cache."""
    line = Window.partitionBy("run", "bin").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    by = binned.groupBy("run", "bin", "idx").agg(F.sum("y").alias("y"))
    return by.withColumn("prefix", F.sum("y").over(line)).select("run", "bin", "idx", "prefix")


def range_sum(prefix: DataFrame, ranges: DataFrame) -> DataFrame:
    """(range_id, run, bin, y): sum over scans i0 to i1, both included, as a difference of two prefixes.

    ``ranges``: (range_id, run, i0, i1). Bins are sparse, so each prefix is the last one at or before the
    index: two as-of lookups for each range and bin of its run.
    """
    ends = F.explode(F.array(F.struct(F.col("i1").cast("long").alias("at"), F.lit(1.0).alias("sign")), F.struct((F.col("i0") - 1).cast("long").alias("at"), F.lit(-1.0).alias("sign"))))
    bins = prefix.select("run", "bin").distinct()
    asked = ranges.withColumn("e", ends).join(bins, "run").select("range_id", "run", "bin", "e.*")
    found = asof_backward(asked, "at", prefix.withColumn("idx", F.col("idx").cast("long")), "idx", "prefix", ["run", "bin"], "p")
    return found.groupBy("range_id", "run", "bin").agg(F.sum(F.col("sign") * F.coalesce("p", F.lit(0.0))).alias("y"))


def scan_bounds(scans: DataFrame) -> DataFrame:
    """(total, first, last); an empty run has 0, 0, -1."""
    a = scans.agg(F.count("*").alias("total"), F.min("scan").alias("first"), F.max("scan").alias("last"))
    return a.select("total", F.coalesce("first", F.lit(0)).alias("first"), F.coalesce("last", F.lit(-1)).alias("last"))


def time_domain(scans: DataFrame) -> DataFrame:
    """(run, t0, t1): times of the first and last scan by number."""
    return scans.groupBy("run").agg(F.min_by("rt", "scan").alias("t0"), F.max_by("rt", "scan").alias("t1"))


def best_level(scans: DataFrame) -> DataFrame:
    """(run, level): 1, or 2 where the run has no scan of level 1."""
    return scans.groupBy("run").agg(F.when(F.count_if(F.col("level") == 1) > 0, 1).otherwise(2).alias("level"))


def mz_domain(scans: DataFrame, points: DataFrame, level: int = 1, most: int = 30) -> DataFrame:
    """(run, lo, hi) of m/z over up to about ``most`` scans, every n // most-th; 200 to 2000 where there are no points."""
    dim = scan_index(scans, level)
    n = F.count("*").over(Window.partitionBy("run"))
    some = dim.withColumn("step", F.greatest(F.lit(1), F.floor(n / most))).where("(idx - 1) % step = 0")
    return some.join(points, "scan", "left").groupBy("run").agg(F.coalesce(F.min("mz"), F.lit(200.0)).alias("lo"), F.coalesce(F.max("mz"), F.lit(2000.0)).alias("hi"))


def random_scans(scans: DataFrame, share: float, seed: int = 0) -> DataFrame:
    """A seeded sample of scans with replacement, about ``share`` of them."""
    return scans.sample(True, share, seed)


def interpolated_grid(points: DataFrame, step: float = 0.005) -> DataFrame:
    """(run, idx, bin, y): each scan's profile at the multiples of ``step`` between its points, linear; a grid point at a scan's last m/z isn't in it.

    ``points``: (run, idx, mz, intensity); more columns, of the scan, are kept. Each pair of neighbouring points gives the grid points between them, so a scan is never held whole.
    """
    more = [c for c in points.columns if c not in ("run", "idx", "mz", "intensity")]
    w = Window.partitionBy("run", "idx").orderBy("mz", "intensity")
    pairs = points.select("run", "idx", *more, F.col("mz").alias("x0"), F.col("intensity").alias("y0"), F.lead("mz").over(w).alias("x1"), F.lead("intensity").over(w).alias("y1"))
    first, end = F.ceil(F.col("x0") / step), F.ceil(F.col("x1") / step)
    rows = pairs.where(end > first).withColumn("bin", F.explode(F.sequence(first, end - 1)))
    return rows.select("run", "idx", *more, "bin", (F.col("y0") + (F.col("y1") - F.col("y0")) * (F.col("bin") * step - F.col("x0")) / (F.col("x1") - F.col("x0"))).alias("y"))


def checkpoint_scans(index: DataFrame, count: int = 100) -> DataFrame:
    """(run, at): the scans whose prefix sums are kept, every n // count-th and the last of a run of n."""
    by = index.groupBy("run").agg(F.max("idx").alias("n"))
    every = F.greatest(F.lit(1), F.floor(F.col("n") / count)).cast("int")
    return by.select("run", F.explode(F.array_distinct(F.concat(F.sequence(every, F.col("n"), every), F.array("n")))).alias("at"))


def with_checkpoint(index: DataFrame, kept: DataFrame) -> DataFrame:
    """``index`` (run, idx, ...) with ``at``, the first kept scan at or after each."""
    return asof_backward(index.withColumn("_i", -F.col("idx")), "_i", kept.select("run", (-F.col("at")).alias("_a"), "at"), "_a", "at", ["run"], "at").drop("_i")


def checkpoints(grid: DataFrame, kept: DataFrame) -> DataFrame:
    """(run, bin, at, prefix): sums of each bin over the scans up to each kept one. Rows are first summed by stretch between kept scans, so the running sums go over
    at most as many rows a bin as scans are kept. A grid with the column ``at`` of ``with_checkpoint`` is summed where it is made; without, its rows are looked up."""
    stretch = grid if "at" in grid.columns else with_checkpoint(grid, kept)
    sums = stretch.groupBy("run", "bin", "at").agg(F.sum("y").alias("y"))
    line = Window.partitionBy("run", "bin").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    return sums.withColumn("prefix", F.sum("y").over(line)).select("run", "bin", "at", "prefix")


def range_sum_checkpointed(grid: DataFrame | Callable[[DataFrame], DataFrame], kept: DataFrame, prefixes: DataFrame, ranges: DataFrame, index: DataFrame | None = None) -> DataFrame:
    """(range_id, run, bin, y): sums over scans i0 to i1, both included, as P(i1) - P(i0 - 1). Each P is the nearest kept prefix, the later one on ties, plus
    or less the scans between; only those scans' rows are read. With ``index``, ``grid`` is a function that makes the grid of some of its scans, and no others' is made."""
    ends = F.explode(F.array(F.struct(F.col("i1").alias("e"), F.lit(1.0).alias("sign")), F.struct((F.col("i0") - 1).alias("e"), F.lit(-1.0).alias("sign"))))
    last = kept.groupBy("run").agg(F.max("at").alias("_n"))
    asked = ranges.withColumn("p", ends).join(last, "run").select("range_id", "run", F.least(F.col("p.e"), F.col("_n")).alias("e"), "p.sign").where("e > 0")
    near = asof_nearest(asked, "e", kept.withColumn("v", F.col("at")), "at", "v", ["run"], "at")
    bins = prefixes.select("run", "bin").distinct()
    whole = asof_backward(near.join(bins, "run"), "at", prefixes, "at", "prefix", ["run", "bin"], "p")
    whole = whole.select("range_id", "run", "bin", (F.col("sign") * F.coalesce("p", F.lit(0.0))).alias("y"))
    # Scans after the kept one are added, those after the end are taken off.
    gap = near.select("range_id", "run", (F.least("e", "at") + 1).alias("lo"), F.greatest("e", "at").alias("hi"), (F.col("sign") * F.signum(F.col("e") - F.col("at"))).alias("f"))
    if index is not None:
        grid = grid(interval_join(index, "idx", gap.select("run", "lo", "hi"), "lo", "hi", 64, ["run"]).select(*index.columns).distinct())
    between = interval_join(grid, "idx", gap, "lo", "hi", 64, ["run"]).select("range_id", "run", "bin", (F.col("f") * F.col("y")).alias("y"))
    return whole.unionByName(between).groupBy("range_id", "run", "bin").agg(F.sum("y").alias("y"))
