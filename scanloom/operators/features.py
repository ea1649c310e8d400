"""Feature finding: charge clusters of scans, and features over scans."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.averagine import envelope
from ..functions.chem import C13_GAP, PROTON
from ..storage import stored
from .cluster import collate, dbscan

MOST = 1000


def scan_clusters(mz: np.ndarray, intensity: np.ndarray, tolerance: float, charges: int, least_correlation: float) -> list[tuple]:
    """(mz, intensity, charge, mass, isotopes, correlation) of one scan, strongest first; each takes its points away.

    The charge is the one whose isotope comb gathers most; isotopes are compared with the averagine envelope of the mass, at every shift.
    """
    mz, y, out = mz, intensity.astype(float).copy(), []
    for i in np.argsort(-intensity, kind="stable"):
        if y[i] <= 0:
            continue
        best: tuple = (0.0, 0, [], 0)
        for z in range(1, charges + 1):
            comb = [int(i)]
            for step in (-1, 1):
                for k in range(1, 6):
                    near = np.flatnonzero(np.abs(mz - (mz[i] + step * k * C13_GAP / z)) <= tolerance / z)
                    near = near[y[near] > 0]
                    if not len(near):
                        break
                    comb.insert(0 if step < 0 else len(comb), int(near[np.argmax(y[near])]))
            score = float(y[comb].sum()) * len(comb)
            if len(comb) > 1 and score > best[0]:
                best = (score, z, comb, comb.index(int(i)))
        _, z, comb, top = best
        if z:
            # The mono-isotope is the point at or below the strongest from which the envelope fits best.
            fits = []
            for first in range(top + 1):
                mass = (mz[comb[first]] - PROTON) * z
                theory = envelope(mass, len(comb) - first)
                got = y[comb[first:]]
                fits.append((float(np.dot(got, theory) / (np.linalg.norm(got) * np.linalg.norm(theory))) if len(got) > 1 else 0.0, -first, float(mass)))
            c, first, mass = max(fits)
            comb = comb[-first:]
            if c >= least_correlation:
                out.append((float(mz[comb[0]]), float(y[i]), z, mass, len(comb), c))
                y[comb] = 0
        y[i] = 0
    return out


def above_noise(mz: np.ndarray, intensity: np.ndarray, deviations: float, gap: float, share: float = 0.8) -> tuple[np.ndarray, np.ndarray]:
    """The points of a scan that stand at or above its noise floor, the upper median plus so many deviations of the lowest ``share`` of its intensities,
    or are chained to one that does by gaps of at most ``gap``."""
    low = np.sort(intensity)[: max(1, int(np.ceil(len(intensity) * share)))]
    floor = low[len(low) // 2] + deviations * low.std()
    order = np.argsort(mz, kind="stable")
    island = np.concatenate([[0], np.cumsum(np.diff(mz[order]) > gap)])
    tops = np.full(island[-1] + 1, -np.inf)
    np.maximum.at(tops, island, intensity[order])
    keep = np.zeros(len(mz), bool)
    keep[order] = tops[island] >= floor
    return mz[keep], intensity[keep]


def with_close_points(points: pa.ListArray, reach: float) -> np.ndarray:
    """Places of the lists (mz, ...) that hold two points with m/z at most ``reach`` apart."""
    mz, sizes = points.flatten().field("mz").to_numpy(zero_copy_only=False), np.diff(points.offsets.to_numpy())
    scan = np.repeat(np.arange(len(points)), sizes)
    order = np.lexsort((mz, scan))
    near = (np.diff(mz[order]) <= reach) & (np.diff(scan[order]) == 0)
    return np.unique(scan[order[1:][near]])


def charge_clusters(points: DataFrame, tolerance: float = 0.02, charges: int = 6, least_correlation: float = 0.6, deviations: float | None = None, gap: float = 0.02, most: int = MOST) -> DataFrame:
    """(run, scan, rt, mz, intensity, charge, mass, isotopes, correlation) of (run, scan, rt, mz, intensity).

    The unit is the scan: the points of one scan are one array of at most ``most`` points, the most intense; that many is a feature of the method. With
    ``deviations``, only points above the scan's noise, and what hangs together with them, are taken further.
    """
    best = F.slice(F.sort_array(F.collect_list(F.struct("intensity", "mz")), False), 1, most).alias("p")
    scans = points.groupBy("run", "scan", "rt").agg(best)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            # Without two points within a step of the comb, a scan has no cluster; nearly all sparse scans are like that, so they are told apart all at once.
            if tolerance < C13_GAP:
                b = b.take(pa.array(with_close_points(b.column(3), (C13_GAP + tolerance) * (1 + 1e-9) + 1e-9)))
            for r, s, t, p in zip(*(b.column(i) for i in range(4)), strict=True):
                v = p.values
                mz, y = v.field("mz").to_numpy(), v.field("intensity").to_numpy()
                if deviations is not None and len(y):
                    mz, y = above_noise(mz, y, deviations, gap)
                rows += [(r.as_py(), s.as_py(), t.as_py(), *c) for c in scan_clusters(mz, y, tolerance, charges, least_correlation)]
            types = [b.schema.field(0).type, pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.int32(), pa.float64(), pa.int32(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], t) for i, t in enumerate(types)], names=["run", "scan", "rt", "mz", "intensity", "charge", "mass", "isotopes", "correlation"])

    kind = points.schema["run"].dataType.simpleString()
    return scans.mapInArrow(run, f"run {kind}, scan long, rt double, mz double, intensity double, charge int, mass double, isotopes int, correlation double")


def features(clusters: DataFrame, eps: float = 5.01, least: int = 3, mass_scale: float = 50.0) -> DataFrame:
    """Features of the charge clusters (id, idx, rt, mass, intensity, charge): density clusters in (scan index, scaled mass), summarised."""
    labels = dbscan(clusters.withColumn("_m", F.col("mass") * mass_scale), "id", "idx", "_m", eps, least)
    return collate(clusters.join(labels, "id"))


def find(points: DataFrame, eps: float = 5.01, least: int = 3, mass_scale: float = 50.0, least_mass: float = 0.0, **how) -> DataFrame:
    """Features of whole runs: scans are capped and cut at their noise, charge clusters of ``least_mass`` or more are found, clusters of each run are joined over its scans by
    density, and summarised. ``points``: (run, scan, rt, mz, intensity), run a number. Clusters are written once, with the ids that they are joined by.
    """
    order = F.dense_rank().over(Window.partitionBy("run").orderBy("rt", "scan"))
    index = points.select("run", "scan", "rt").distinct().withColumn("idx", order).select("run", "scan", "idx")
    found = charge_clusters(points, **how).where(F.col("mass") >= least_mass).join(index, ["run", "scan"])
    found = stored(found.withColumn("id", F.monotonically_increasing_id()))
    # Runs lie so far apart on the first axis that their clusters never meet.
    apart = found.withColumn("idx", F.col("idx") + F.col("run").cast("double") * 1e7)
    return features(apart, eps, least, mass_scale)


def admitted(features: DataFrame, least_mass: float, most_mass: float, least_width: float) -> DataFrame:
    """Features (mass, start, end, ...) with a mass above the least and up to the most, and wide enough in time."""
    return features.where((F.col("mass") > least_mass) & (F.col("mass") <= most_mass) & (F.col("end") - F.col("start") >= least_width))


def clusters_admitted(clusters: DataFrame, cutoff: float, least_mass: float) -> DataFrame:
    """Charge clusters (correlation, mass, ...) that correlate better than the cutoff and are heavy enough."""
    return clusters.where((F.col("correlation") > cutoff) & (F.col("mass") >= least_mass))


def peptide_list(features: DataFrame, sequences: DataFrame) -> DataFrame:
    """The list of peptides to look for, in its fixed order of columns, from (feature, mass, start, end, charges) and the known (feature, sequence).

    A feature without a sequence is named UNKNOWN_ and its number; of several sequences of one feature the first by text counts.
    """
    known = sequences.groupBy("feature").agg(F.min("sequence").alias("sequence"))
    name = F.coalesce("sequence", F.concat(F.lit("UNKNOWN_"), F.col("feature").cast("string")))
    out = features.join(known, "feature", "left")
    return out.select("feature", name.alias("Sequence"), F.col("mass").alias("UnchargedMass"), F.col("start").alias("StartTime"), F.col("end").alias("EndTime"), F.col("charges").alias("ChargeList"))
