"""Which scans are centroided, and how: a policy of options, formats and single scans, then one plan for each way."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .series import centroid3

NONE, CUSTOM, VENDOR = "none", "custom", "vendor"


def centroiding(scans: DataFrame, option: str = "auto", custom_formats: Sequence[str] = ()) -> DataFrame:
    """``scans`` (scan, profile, format, override, ...) with ``centroiding``: none for scans that are centroids already; else what the scan's own ``override`` says, or
    the option: custom, vendor, or auto, which is custom for the listed formats and vendor for the others. An unknown option or override counts as auto; a null
    ``profile`` as no profile.
    """
    auto = F.when(F.col("format").isin(*custom_formats), CUSTOM).otherwise(VENDOR)
    asked = F.coalesce(F.lower("override"), F.lit(option.lower()))
    return scans.withColumn("centroiding", F.when(~F.coalesce("profile", F.lit(False)), NONE).when(asked.isin(CUSTOM, VENDOR), asked).otherwise(auto))


def centroids(points: DataFrame, scans: DataFrame, vendor: DataFrame | None = None) -> DataFrame:
    """(scan, mz, intensity) of all scans of ``centroiding()``: points as they are, local maxima with weighted places, or those of ``vendor`` (scan, mz, intensity).

    Without a vendor's table, and for scans that it lacks, the points of a scan stay as they are. A custom scan of equal intensities has no maximum and no centroid.
    """
    way = scans.select("scan", "centroiding")
    rows = points.select("scan", "mz", "intensity")
    place = F.row_number().over(Window.partitionBy("scan").orderBy("mz", "intensity"))
    lines = rows.join(way.where(F.col("centroiding") == CUSTOM), "scan").select("scan", place.alias("i"), F.col("mz").alias("t"), F.col("intensity").alias("y"))
    custom = centroid3(lines, ["scan"]).select("scan", F.col("t").alias("mz"), F.col("y").alias("intensity"))
    theirs = way.where(F.col("centroiding") == VENDOR).select("scan")
    plain = way.where(F.col("centroiding") == NONE).select("scan")
    if vendor is None:
        plain = plain.unionByName(theirs)
        return custom.unionByName(rows.join(plain, "scan", "left_semi"))
    known = vendor.select("scan").distinct()
    plain = plain.unionByName(theirs.join(known, "scan", "left_anti"))
    given = vendor.select("scan", "mz", "intensity").join(theirs, "scan", "left_semi")
    return custom.unionByName(rows.join(plain, "scan", "left_semi")).unionByName(given)
