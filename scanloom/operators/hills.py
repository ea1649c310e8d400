"""Hills of points over scans, and features as ladders of hills: the strongest is taken first, with all that belongs to it.

Both steps are greedy selections in order of intensity, done in blocks (``greedy``); no edge of a block changes a result.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.chem import C13_GAP, PROTON
from ..storage import stored
from .greedy import Hill, Ladder, greedy


def grow_hills(points: DataFrame, width: float = 0.025, gap: int = 2, rows_per_block: int = 20_000) -> DataFrame:
    """(id, seed) of every point of (id, run, idx, mz, intensity): the most intense free point is a seed and takes the free points within ``width`` of its m/z, scan by
    scan in both directions, as long as at most ``gap`` - 1 scans in a row have none; then the next one. Of equal intensities the smaller id comes first.

    ``idx`` numbers the scans of a run. Ids are unique numbers. Points with a null value are left out.
    """
    whole = points.where("run is not null and idx is not null and mz is not null and intensity is not null")
    named = whole.select("id", F.col("run").alias("part"), F.col("mz").alias("x"), F.lit(0.0).alias("y"), "idx", (-F.col("intensity")).alias("falling"))
    return greedy(named, ["falling", "id"], width, 1.0, partial(Hill, width, gap), rows_per_block)


def describe_hills(points: DataFrame, grown: DataFrame) -> DataFrame:
    """(run, hill, first, last, apex, mz, peak, intensity, n): scans, m/z as the mean weighted by intensity, the apex's scan and intensity, the sum and number of points."""
    members = points.join(grown, "id")
    top = F.max_by("idx", F.struct("intensity", -F.col("id"))).alias("apex")
    total = F.sum("intensity")
    mean = F.coalesce(F.sum(F.col("mz") * F.col("intensity")) / F.when(total != 0, total), F.avg("mz"))
    return members.groupBy("run", F.col("seed").alias("hill")).agg(
        F.min("idx").alias("first"), F.max("idx").alias("last"), top, mean.alias("mz"), F.max("intensity").alias("peak"), total.alias("intensity"), F.count("*").alias("n")
    )


def hill_ladders(hills: DataFrame, width: float = 0.025, scans: float = 5.0, charges: int = 10, most: int = 8, rows_per_block: int = 20_000) -> DataFrame:
    """(hill, seed): in order of falling intensity, a free hill takes the free hills on the longest isotope ladder through it, of the charges from 1 on: apexes within
    ``scans`` of its own, m/z within ``width`` of its own plus or minus whole steps of the isotopes' distance over the charge, ``most`` steps in each direction.
    """
    named = hills.select(F.col("hill").alias("id"), F.col("run").alias("part"), F.col("mz").alias("x"), F.col("apex").cast("double").alias("y"), "intensity", (-F.col("intensity")).alias("falling"))
    rule = partial(Ladder, C13_GAP, charges, width, scans, most)
    return greedy(named, ["falling", "id"], most * C13_GAP + width, scans, rule, rows_per_block).select(F.col("id").alias("hill"), "seed")


def hill_features(hills: DataFrame, ladders: DataFrame, width: float = 0.025, charges: int = 10) -> DataFrame:
    """(run, feature, charge, mz, mass, hills, first, last, apex, intensity): one row a ladder, its lowest m/z as the mono-isotope.

    The charge is that whose steps fit the ladder's neighbours best; 0, and a null mass, for a single hill.
    """
    members = hills.join(ladders, "hill")
    w = Window.partitionBy("run", "seed").orderBy("mz")  # a ladder has at most twice ``most`` hills and one
    step = members.withColumn("_step", F.col("mz") - F.lag("mz").over(w))
    top = F.max_by("apex", F.struct("intensity", -F.col("hill"))).alias("apex")
    rows = step.groupBy("run", F.col("seed").alias("feature")).agg(
        F.avg("_step").alias("_step"), F.min("mz").alias("mz"), F.count("*").alias("hills"), F.min("first").alias("first"), F.max("last").alias("last"), top, F.sum("intensity").alias("intensity")
    )
    charge = F.when(F.col("_step").isNull(), 0).otherwise(F.least(F.lit(charges), F.greatest(F.lit(1), F.round(C13_GAP / F.col("_step"))))).cast("int")
    mass = F.when(F.col("charge") > 0, F.col("mz") * F.col("charge") - F.col("charge") * PROTON)
    return rows.withColumn("charge", charge).withColumn("mass", mass).select("run", "feature", "charge", "mz", "mass", "hills", "first", "last", "apex", "intensity")


def find_features(points: DataFrame, width: float = 0.025, gap: int = 2, scans: float = 5.0, charges: int = 10, most: int = 8, rows_per_block: int = 20_000) -> DataFrame:
    """Features of runs of points (id, run, idx, mz, intensity): hills, their ladders, one row a feature."""
    kept = stored(points)
    hills = stored(describe_hills(kept, grow_hills(kept, width, gap, rows_per_block)))
    return hill_features(hills, hill_ladders(hills, width, scans, charges, most, rows_per_block), width, charges)


def hill_layer(points: DataFrame, grown: DataFrame, width: float, height: int) -> DataFrame:
    """(run, tx, ty, hill, bucket, cells): for each tile and hill a bitmap of the tile's points that belong to it; a point's bit is its rank in the tile by scan, m/z
    and id, in buckets of as many points as a bitmap holds.

    ``width``: m/z of a tile; ``height``: its scans.
    """
    tile = points.withColumns({"tx": F.floor(F.col("mz") / width).cast("long"), "ty": F.floor(F.col("idx") / height).cast("long")})
    placed = tile.withColumn("place", F.row_number().over(Window.partitionBy("run", "tx", "ty").orderBy("idx", "mz", "id")))
    members = placed.withColumn("bucket", F.bitmap_bucket_number("place")).join(grown, "id")
    return members.groupBy("run", "tx", "ty", F.col("seed").alias("hill"), "bucket").agg(F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("cells"))


def merged_layer(layer: DataFrame) -> DataFrame:
    """(run, tx, ty, bucket, cells, n): the union of the hills' bitmaps of each tile, and its size: the selection of all that belongs to any of them."""
    return layer.groupBy("run", "tx", "ty", "bucket").agg(F.bitmap_or_agg("cells").alias("cells")).withColumn("n", F.bitmap_count("cells"))
