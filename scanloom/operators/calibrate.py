"""Lock-mass calibration."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .joins import _around, interpolate, interval_join
from .series import moving


def lockmass_points(points: DataFrame, masses: DataFrame, ppm: float) -> DataFrame:
    """(scan, mass, mz, intensity, error): the strongest point within ppm of each lock mass of each scan; blank if none.

    ``points``: (scan, mz, intensity); ``masses``: (mass), a short list by its meaning.
    """
    w = masses.select("mass", (F.col("mass") * (1 - ppm / 1e6)).alias("lo"), (F.col("mass") * (1 + ppm / 1e6)).alias("hi"))
    hit = interval_join(points, "mz", w, "lo", "hi", 1.0).groupBy("scan", "mass").agg(F.max_by(F.struct("mz", "intensity"), F.struct("intensity", -F.col("mz"))).alias("p"))
    grid = points.select("scan").distinct().withColumn("mass", F.explode(F.array(*[F.lit(r["mass"]) for r in masses.collect()])))
    return grid.join(hit, ["scan", "mass"], "left").select("scan", "mass", "p.mz", "p.intensity", (F.col("p.mz") - F.col("mass")).alias("error"))


def calibrate(points: DataFrame, coefficients: DataFrame, on: list[str]) -> DataFrame:
    """Points (on, t, mz, ...) with mz less c0 + c1 mz + c2 mz^2, coefficients (on, t, c0, c1, c2) interpolated in t, the ends' outside.

    Coefficients are looked up once for each time, of which all points of a scan share one, so points aren't sorted by time.
    """
    keys = [*on, "t"]
    times = _around(points.select(*keys).distinct(), "t", coefficients, "t", F.struct("c0", "c1", "c2"), on).select(*[F.col(c).alias(f"_k_{c}") for c in keys], "_prev", "_next")
    same = F.lit(True)
    for c in keys:
        same = same & F.col(c).eqNullSafe(F.col(f"_k_{c}"))
    near = points.join(times, same).drop(*[f"_k_{c}" for c in keys])
    a, b = F.col("_prev"), F.col("_next")
    share = F.when(b["t"] > a["t"], (F.col("t") - a["t"]) / F.when(b["t"] > a["t"], b["t"] - a["t"])).otherwise(0.0)
    c0, c1, c2 = (F.coalesce(a["v"][c], b["v"][c]) + (F.coalesce(b["v"][c], a["v"][c]) - F.coalesce(a["v"][c], b["v"][c])) * F.coalesce(share, F.lit(0.0)) for c in ("c0", "c1", "c2"))
    return near.withColumn("mz", F.col("mz") - (c0 + c1 * F.col("mz") + c2 * F.col("mz") * F.col("mz"))).drop("_prev", "_next")


def calibrate_ppm(points: DataFrame, errors: DataFrame, lock: float, on: list[str]) -> DataFrame:
    """Points (on, t, mz, ...) with mz (1 - c0 / lock), for one lock mass with its errors (on, t, c0) interpolated in t, the ends' outside."""
    return interpolate(points, "t", errors, "t", "c0", on, True, "_c").withColumn("mz", F.col("mz") * (1 - F.col("_c") / lock)).drop("_c")


def fit(points: DataFrame, mass: float, ppm: float, on: list[str], median_half: int = 2, average_half: int = 2, share: float = 0.6, least: int = 5) -> DataFrame:
    """(on, t, c0): smoothed errors of one lock mass over time, where more than ``share`` of the scans, and more than ``least``, hit it.

    ``points``: (on, t, mz, intensity) with one t a scan.
    """
    near = points.where(F.abs(F.col("mz") - mass) <= mass * ppm / 1e6)
    hit = near.groupBy(*on, "t").agg((F.max_by("mz", F.struct("intensity", -F.col("mz"))) - mass).alias("y"))
    scans, hits = points.groupBy(*on).agg(F.count_distinct("t").alias("_n")), hit.groupBy(*on).agg(F.count("*").alias("_h"))
    good = scans.join(hits, on).where((F.col("_h") > share * F.col("_n")) & (F.col("_h") > least)).select(*on)
    from pyspark.sql import Window

    errors = hit.join(good, on).withColumn("i", F.row_number().over(Window.partitionBy(*on).orderBy("t")))
    return moving(moving(errors, on, median_half, "median"), on, average_half, "avg").select(*on, "t", F.col("y").alias("c0"))


def calibration_functions(base_peaks: DataFrame, scale: float = 10.0, share: float = 0.6, least: int = 10, fewest_points: int = 4) -> DataFrame:
    """(function, mz): functions that look like a lock mass: of their scans with ``fewest_points`` points or more there are ``least`` or more, and more than ``share`` of them have
    their base peak in one bucket of trunc(mz * scale). ``base_peaks``: (function, scan, n, mz).
    """
    by = base_peaks.where(F.col("n") >= fewest_points).groupBy("function", F.expr(f"cast(mz * {scale} as long)").alias("bucket")).agg(F.count("*").alias("c"))
    top = by.groupBy("function").agg(F.sum("c").alias("n"), F.max("c").alias("most"), F.min_by("bucket", F.struct(-F.col("c"), F.col("bucket"))).alias("bucket"))
    return top.where((F.col("n") >= least) & (F.col("most") > share * F.col("n"))).select("function", (F.col("bucket") / scale).alias("mz"))
