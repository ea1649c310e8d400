"""Two-dimensional bins and tiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import stored
from .graph import connected_components
from .joins import band_join

def raster(points: DataFrame, x: str, y: str, value: str, step_x: float, step_y: float) -> DataFrame:
    """(bx, bt, v): sums on a grid."""
    return points.groupBy(F.floor(F.col(x) / step_x).cast("long").alias("bx"), F.floor(F.col(y) / step_y).cast("long").alias("bt")).agg(F.sum(value).alias("v"))


def tile_max(cells: DataFrame, width: int, height: int) -> DataFrame:
    """(tx, ty, bx, bt, v): the largest cell of each tile; the larger bx, then bt, of equals."""
    best = F.max(F.struct("v", "bx", "bt")).alias("m")
    return cells.groupBy(F.expr(f"bx div {width}").alias("tx"), F.expr(f"bt div {height}").alias("ty")).agg(best).select("tx", "ty", "m.bx", "m.bt", "m.v")


def half(cells: DataFrame) -> DataFrame:
    """The next level of a pyramid: means of 2 x 2 cells, missing ones counting as 0."""
    return cells.groupBy(F.expr("bx div 2").alias("bx"), F.expr("bt div 2").alias("bt")).agg((F.sum("v") / 4).alias("v"))


def pyramid(cells: DataFrame, levels: int) -> dict[int, DataFrame]:
    out = {1: cells}
    for k in range(2, levels + 1):
        out[k] = half(out[k - 1])
    return out


def local_max_2d(cells: DataFrame, radius: int = 1) -> DataFrame:
    """Cells strictly above all others within ``radius``; missing cells count as 0. Each cell is sent to those around it."""
    d = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(-radius, radius + 1) for j in range(-radius, radius + 1) if i or j]))
    sent = cells.select(F.col("bx"), F.col("bt"), "v", d.alias("d")).select((F.col("bx") + F.col("d.i")).alias("bx"), (F.col("bt") + F.col("d.j")).alias("bt"), F.col("v").alias("o"))
    near = sent.groupBy("bx", "bt").agg(F.max("o").alias("o"))
    return cells.join(near, ["bx", "bt"], "left").where(F.col("v") > F.greatest(F.coalesce("o", F.lit(0.0)), F.lit(0.0))).select("bx", "bt", "v")


def with_partner(maxima: DataFrame, shift: int, tolerance: float) -> DataFrame:
    """Maxima with another one ``shift`` columns to either side in the same row, its value within ``tolerance`` of theirs."""
    other = maxima.select(F.explode(F.array(F.col("bx") - shift, F.col("bx") + shift)).alias("bx"), "bt", F.col("v").alias("o"))
    return maxima.join(other, ["bx", "bt"]).where(F.abs(F.col("v") - F.col("o")) <= tolerance).select("bx", "bt", "v").distinct()


def peak_extents(cells: DataFrame, maxima: DataFrame, share: float) -> DataFrame:
    """(bx, bt, v, x0, x1, t0, t1) of each maximum: how far the values fall away from it without a gap or a rise, in its row and its column, and stay at ``share`` of it or more.

    A row is cut into stretches that rise all the way, seen from either side; a maximum is the end of one of each. So a window over rows and one over columns
    answer for all maxima at once, and no tile has an edge.
    """

    def falls(line: str, along: str, back: bool, name: str) -> DataFrame:
        order = F.desc(along) if back else F.asc(along)
        w = Window.partitionBy(line).orderBy(order)
        rises = (F.abs(F.col(along) - F.lag(along).over(w)) == 1) & (F.lag("v").over(w) < F.col("v"))
        cut = cells.withColumn("_new", F.coalesce((~rises).cast("int"), F.lit(1))).withColumn("_s", F.sum("_new").over(w))
        whole = Window.partitionBy(line, "_s").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        top = cut.withColumns({"_top": F.last("v").over(whole), "_at": F.last(along).over(whole)}).where(F.col("v") >= F.col("_top") * share)
        far = (F.max if back else F.min)(along).alias(name)
        return top.groupBy(line, F.col("_at").alias(along)).agg(far)

    out = maxima.select("bx", "bt", "v")
    for line, along, back, name in (("bt", "bx", False, "x0"), ("bt", "bx", True, "x1"), ("bx", "bt", False, "t0"), ("bx", "bt", True, "t1")):
        out = out.join(falls(line, along, back, name), ["bx", "bt"], "left").withColumn(name, F.coalesce(name, along))
    return out


def spacing_chains(peaks: DataFrame, spacing: float, charges: int, width: float, reach: float) -> DataFrame:
    """(id, charge, chain, size) of each peak (id, x, t): chains of peaks ``spacing`` / charge apart, the ladders of isotopes.

    For each charge from 1 on, two peaks are linked if each is the other's nearest at that distance (x within ``width`` of it, t within ``reach``; nearest by x, then t,
    then id). A peak belongs to the longest of its chains, of equals to that of the smaller charge. ``chain`` is the smallest id of it, ``size`` the number of its peaks that belong
    to it; a peak without links is its own chain, with charge 0. Ids are non-negative.
    """
    p = stored(peaks.select("id", F.col("x").cast("double").alias("x"), F.col("t").cast("double").alias("t")))
    z = F.explode(F.sequence(F.lit(1), F.lit(charges))).alias("z")
    low = p.select("id", "x", "t", z).withColumn("target", F.col("x") + F.lit(float(spacing)) / F.col("z"))
    high = p.select(F.col("id").alias("o"), F.col("x").alias("ox"), F.col("t").alias("ot"))
    pairs = band_join(low, "target", high, "ox", F.lit(width), max(width, 1e-9)).where(F.abs(F.col("t") - F.col("ot")) <= reach)
    by = F.struct(F.abs(F.col("ox") - F.col("target")), F.abs(F.col("ot") - F.col("t")))
    pairs = stored(pairs.select("id", "o", "z", by.alias("by")))
    after = pairs.groupBy("id", "z").agg(F.min_by("o", F.struct("by", "o")).alias("o"))
    before = pairs.groupBy("o", "z").agg(F.min_by("id", F.struct("by", "id")).alias("id"))
    links = stored(after.join(before, ["id", "o", "z"]))
    node = lambda c: F.col(c) * (charges + 1) + F.col("z")
    found = stored(connected_components(links.select(node("id").alias("u"), node("o").alias("v"))).select("id", "component"))
    sizes = found.groupBy("component").agg(F.count("*").alias("n"))
    every = found.join(sizes, "component").select(F.expr(f"id div {charges + 1}").alias("id"), (F.col("id") % (charges + 1)).cast("int").alias("charge"), "component", "n")
    mine = every.groupBy("id").agg(F.min_by(F.struct("charge", "component"), F.struct(-F.col("n"), F.col("charge"))).alias("m")).select("id", "m.*")
    left = stored(p.select("id").join(mine, "id", "left").select("id", F.coalesce("charge", F.lit(0)).alias("charge"), F.coalesce("component", -1 - F.col("id")).alias("component")))
    size = left.groupBy("component").agg(F.min("id").alias("chain"), F.count("*").alias("size"))
    return left.join(size, "component").select("id", "charge", "chain", "size")


def in_area(cells: DataFrame, x0: int, x1: int, y0: int, y1: int) -> DataFrame:
    """(least, most) over a rectangle."""
    return cells.where(F.col("bx").between(x0, x1) & F.col("bt").between(y0, y1)).agg(F.min("v").alias("least"), F.max("v").alias("most"))


def hills(points: DataFrame, on: list[str], mz_gap: float, scan_gap: int = 2) -> DataFrame:
    """Points (on, idx, mz, intensity) with a hill number: bins of ``mz_gap``, cut where more than one scan in between is empty."""
    binned = points.withColumn("bin", F.floor(F.col("mz") / mz_gap).cast("long"))
    w = Window.partitionBy(*on, "bin").orderBy("idx", "mz")
    new = F.coalesce((F.col("idx") - F.lag("idx").over(w) > scan_gap).cast("int"), F.lit(0))
    return binned.withColumn("_new", new).withColumn("hill", F.sum("_new").over(w)).drop("_new")


def slice_of(cells: DataFrame, axis: str, index: int) -> DataFrame:
    """The row of cells at one m/z (``bx``) or time (``bt``) of a raster."""
    return cells.where(F.col(axis) == index)


def accumulated(grid: DataFrame, other: DataFrame, on: list[str], factor: float = 1.0) -> DataFrame:
    """(on, bin, y): the grid plus ``factor`` times another of the same step; cells that one lacks count as 0."""
    both = grid.select(*on, "bin", "y").unionByName(other.select(*on, "bin", (F.col("y") * factor).alias("y")))
    return both.groupBy(*on, "bin").agg(F.sum("y").alias("y"))


def zoom_level(world: Column, pixels: Column) -> Column:
    """The level of the pyramid whose cells are the largest that aren't larger than a pixel: floor(log2(world / pixels)), 0 at least."""
    return F.floor(F.log2(F.greatest(F.lit(1.0), world / pixels))).cast("int")
