"""From the points of several samples to one list of peptides.

Features of each run, identifications that match them, times warped to the central run, groups over the runs, one row a group. Each step's result is a stored table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import stored
from . import align, cluster, hills
from .features import peptide_list
from .joins import best_within


def match_identifications(features: DataFrame, identifications: DataFrame, ppm: float, least_score: float) -> DataFrame:
    """(feature, sequence, score, intensity) of each feature: of the identifications of its run with a mass within ``ppm`` (closed), a time from its start to its end
    and a score above ``least_score``, the most intense; of equals the better score, then the first sequence. Features without one aren't in it.

    ``features``: (run, feature, mass, start, end); ``identifications``: (run, mass, rt, score, intensity, sequence).
    """
    reach = F.col("mass") * ppm / 1e6
    f = features.where("mass is not null").select("run", "feature", F.col("start").cast("double").alias("_from"), F.col("end").cast("double").alias("_to"), (F.col("mass") - reach).alias("_lo"), (F.col("mass") + reach).alias("_hi"))
    f = f.where("_from is not null and _to is not null")
    asked = identifications.where(F.col("score") > least_score).select("run", "mass", F.col("rt").cast("double").alias("rt"), "sequence", "score", "intensity")
    best = best_within(f, "feature", asked, "mass", [-F.col("intensity"), -F.col("score"), F.col("sequence")], 1.0, ["run"], "rt")
    return best.select("feature", "sequence", "score", "intensity")


def warped_apexes(features: DataFrame, totals: DataFrame, n: int = 64, segments: int = 8, slack: int = 4) -> DataFrame:
    """``features`` (run, apex, ...) with ``warped``, the apex's time on the scale of the central run.

    ``totals``: (run, t, y), the chromatogram by which runs are aligned; the central run is the one most like all others. A run without points to align keeps its times.
    """
    name = F.col("run").cast("string").alias("channel")
    series = stored(totals.select(name, F.row_number().over(Window.partitionBy("run").orderBy("t")).alias("i"), F.col("t").cast("double").alias("t"), F.col("y").cast("double").alias("y")))
    central = align.central_series(series, n).orderBy(F.desc("score"), "channel").first()
    if central is None:
        return features.withColumn("warped", F.col("apex").cast("double"))
    anchors = stored(align.find_warps(series, central["channel"], n, segments, slack))
    named = features.withColumn("channel", F.col("run").cast("string")).withColumn("apex", F.col("apex").cast("double"))
    moved = align.warp(named, "apex", anchors, ["channel"])
    return moved.withColumn("warped", F.coalesce("warped", "apex")).drop("channel")


def peptides(
    points: DataFrame, identifications: DataFrame, width: float = 0.025, gap: int = 2, scans: float = 5.0, charges: int = 10, ppm: float = 20.0, least_score: float = 0.0,
    eps_mass: float = 0.05, eps_time: float = 5.0, eps_intensity: float = 3.0, segments: int = 8, slack: int = 4, rows_per_block: int = 20_000,
) -> tuple[DataFrame, DataFrame]:
    """The list of peptides, and (group, sample, feature, start, end, intensity) of their features in each sample.

    ``points``: (id, run, idx, mz, intensity), a run a sample, times its scans' numbers. ``identifications``: (run, mass, rt, score, intensity, sequence). Features of charge 0 are
    left out. Features of different runs are grouped by mass, warped apex and the logarithm of their intensity; a group's peptide is that of its most intense
    identification.
    """
    kept = stored(points)
    found = hills.find_features(kept, width, gap, scans, charges, rows_per_block=rows_per_block).where("charge > 0")
    found = stored(found.select("run", "feature", "charge", "mass", F.col("first").alias("start"), F.col("last").alias("end"), "apex", "intensity"))
    known = stored(match_identifications(found, identifications, ppm, least_score))
    totals = kept.groupBy("run", F.col("idx").alias("t")).agg(F.sum("intensity").alias("y"))
    warped = stored(warped_apexes(found, totals, segments=segments, slack=slack))
    samples = warped.select(F.col("feature").alias("id"), F.col("run").alias("sample"), "mass", F.col("warped").alias("apex"), F.log(F.greatest(F.col("intensity"), F.lit(1e-300))).alias("intensity"))
    groups = stored(cluster.neighbour_groups(samples, eps_mass, eps_time, eps_intensity, rows_per_block).withColumnRenamed("id", "feature"))
    members = stored(warped.join(groups, "feature").select(F.col("group").alias("master"), F.col("run").alias("sample"), "feature", "start", "end", "intensity", "mass", "charge"))
    table = cluster.consolidate(members.select("master", "sample", "feature", "start", "end", "intensity")).withColumnRenamed("master", "group")
    top = F.max_by("mass", F.struct("intensity", -F.col("feature"))).alias("mass")
    charges_of = F.array_join(F.array_sort(F.collect_set("charge")), ",").alias("charges")  # at most as many as there are charges
    masters = members.groupBy(F.col("master").alias("feature")).agg(top, F.min("start").alias("start"), F.max("end").alias("end"), charges_of)
    named = known.join(members.select("feature", "master"), "feature").groupBy(F.col("master").alias("feature")).agg(
        F.min_by("sequence", F.struct(-F.col("intensity"), -F.col("score"), F.col("sequence"))).alias("sequence")
    )
    return peptide_list(masters, named), table
