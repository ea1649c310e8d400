"""Overlapping isotope envelopes of a scan, solved together.

Every point may be the mono-isotope of an ion of any charge; its candidate envelope stands at the points nearest to where the isotopes of its mass must be. Envelopes that
share points can't be judged one by one: the strongest takes what belongs to the others. So a scan is explained by matching pursuit: the candidate that takes most off what is left
is added, the amplitudes of all that were added are solved again as non-negative least squares, and so on until nothing takes off ``least_gain`` of the scan's
square sum. Isotopes without a point count as points of intensity 0.

A scan is the unit of work, with all its points. What is left of a point never exceeds its intensity, so no candidate ever takes off more than it would from the whole scan: those that
can't reach ``least_gain`` are known at once, and the rest are about charges times isotopes over ``least_gain`` at the most, however many points a scan has. Their gains are kept, and after each step
only those are made anew whose points have changed. Envelopes are a table of fixed size that is broadcast, those of greater masses are made as they come. Amplitudes are solved by
coordinates, and a new envelope only moves those that share points with it, and those near these in turn: the others aren't gone through again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.averagine import STEP, envelope, unit_envelopes
from ..functions.chem import C13_GAP, PROTON


#: Candidates that are made together.
CANDIDATES_AT_ONCE = 1 << 16


def envelope_table(most_mass: float, isotopes: int) -> np.ndarray:
    """Unit vectors of the first isotopes' fractions, a row for each multiple of the table's step."""
    rows = np.array([envelope(k * STEP, isotopes) for k in range(int(most_mass // STEP) + 2)])
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def _shapes(mass: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Unit vectors of the masses, linear between multiples of the step; those beyond the table are made here, in the same way."""
    place = np.maximum(mass, 0) / STEP
    within = place <= len(table) - 1
    low = np.minimum(np.where(within, place, 0).astype(int), len(table) - 2)
    share = np.clip(np.where(within, place, 0) - low, 0, 1)[:, None]
    shape = (1 - share) * table[low] + share * table[low + 1]
    if not within.all():
        below = np.floor(place[~within])
        share = (place[~within] - below)[:, None]
        shape[~within] = (1 - share) * unit_envelopes(below * STEP, table.shape[1]) + share * unit_envelopes((below + 1) * STEP, table.shape[1])
    return shape / np.linalg.norm(shape, axis=1, keepdims=True)


def _candidates(mz: np.ndarray, mono: np.ndarray, z: int, table: np.ndarray, tolerance: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n, k = len(mz), table.shape[1]
    want = mz[mono][:, None] + np.arange(k) * C13_GAP / z
    right = np.clip(np.searchsorted(mz, want), 0, n - 1)
    left = np.maximum(right - 1, 0)
    near = np.where(np.abs(mz[left] - want) <= np.abs(mz[right] - want), left, right)
    at = np.where(np.abs(mz[near] - want) <= tolerance, near, -1)
    at[:, 0] = mono
    mass = (mz[mono] - PROTON) * z
    good = (at[:, 1] >= 0) & np.isfinite(mass)
    return mono[good], at[good], _shapes(mass[good], table)


def candidates(mz: np.ndarray, table: np.ndarray, charges: int, tolerance: float, y: np.ndarray | None = None, floor: float = 0.0) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(mono point, charge, points of the isotopes or -1, envelope) of every candidate whose first two isotopes have a point; ``mz`` ascends.

    With intensities, only of those that take more than ``floor`` off the square sum of the whole scan: they are made in stretches, so the others are never held together.
    """
    parts = []
    for z in range(1, charges + 1):
        for start in range(0, len(mz), CANDIDATES_AT_ONCE):
            mono, at, shape = _candidates(mz, np.arange(start, min(start + CANDIDATES_AT_ONCE, len(mz))), z, table, tolerance)
            if y is not None:
                fit = (y[np.maximum(at, 0)] * np.where(at >= 0, shape, 0.0)).sum(axis=1)
                some = fit**2 > floor
                mono, at, shape = mono[some], at[some], shape[some]
            parts.append((mono, np.full(len(mono), z), at, shape))
    return tuple(np.concatenate(c) for c in zip(*parts, strict=True))


def descend(near: list[list[tuple[int, float]]], to: list[float], weight: list[float], x: list[float], waiting: bytearray, rounds: int = 200) -> None:
    """Coordinate descent for non-negative least squares, in place: rounds in order, until none moves by more than 1e-9 of the largest.

    ``near[j]``: the others that share points with j, and their inner products. Only those ``waiting`` are looked at; one that moves lets those near it wait,
    as nothing has changed for the rest. Moves too small to matter are left at that, so who waits at the end goes on the next time.
    """
    for _ in range(rounds):
        top = max(x, default=0.0)
        most, j = 0.0, waiting.find(1)
        while j >= 0:
            waiting[j] = 0
            pull = to[j]
            for i, g in near[j]:
                pull -= g * x[i]
            now = max(0.0, pull / weight[j])
            move = abs(now - x[j])
            if move > 1e-13 * top:
                for i, _g in near[j]:
                    waiting[i] = 1
            x[j], most = now, max(most, move)
            j = waiting.find(1, j + 1)
        if most <= 1e-9 * max(max(x, default=0.0), 1e-300):
            break


def non_negative(a: np.ndarray, y: np.ndarray, missed: np.ndarray, start: np.ndarray, rounds: int = 200) -> np.ndarray:
    """x >= 0 that minimises |a x - y|^2 + sum(missed * x^2), one coordinate after the other."""
    gram, x = a.T @ a, [float(v) for v in start]
    near = [[(int(i), float(g[i])) for i in np.flatnonzero(g) if i != j] for j, g in enumerate(gram)]
    descend(near, (a.T @ y).tolist(), (np.diag(gram) + missed).tolist(), x, bytearray(b"\1" * len(x)), rounds)
    return np.array(x)


def _column(places: np.ndarray, inside: np.ndarray) -> dict[int, float]:
    """The values of an envelope by point: isotopes that fall on one point are added up, those without a point have none."""
    column: dict[int, float] = {}
    for p, v in zip(places.tolist(), inside.tolist(), strict=True):
        if v:
            column[p] = column.get(p, 0.0) + v
    return column


def explain(mz: np.ndarray, y: np.ndarray, table: np.ndarray, charges: int, tolerance: float, least_gain: float) -> list[tuple]:
    """(mz, charge, mass, amplitude, isotopes, score, shared) of the envelopes of a scan, by falling amplitude. ``score``: cosine of the envelope and what the others leave at its
    isotopes; ``shared``: the part of its points' intensity that others explain."""
    order = np.argsort(mz, kind="stable")
    mz, y = mz[order], y[order].astype(float)
    floor = least_gain * float(y @ y)
    mono, z, at, shape = candidates(mz, table, charges, tolerance, y, floor) if y.any() else (np.zeros(0),) * 4
    if not len(mono):
        return []
    hit = at >= 0
    missed = (shape**2 * ~hit).sum(axis=1)
    # Points under none of these candidates aren't looked at again.
    used, at[hit] = np.unique(at[hit], return_inverse=True)
    mz, mono, y = mz[used], np.searchsorted(used, mono), y[used]
    inside, places = np.where(hit, shape, 0.0), np.maximum(at, 0)
    # The candidates at each point, one stretch a point.
    over = np.nonzero(hit)[0][np.argsort(at[hit], kind="stable")]
    stretch = np.append(0, np.cumsum(np.bincount(at[hit], minlength=len(y))))
    taken, left, whole = [], y.copy(), np.zeros(len(y))
    free = np.ones(len(mono), bool)

    def gains(c: np.ndarray) -> np.ndarray:
        fit = (left[places[c]] * inside[c]).sum(axis=1)
        return np.where(free[c] & (fit > 0), fit**2, 0.0)  # envelopes are unit vectors, missed isotopes included

    gain = gains(np.arange(len(mono)))
    # Envelopes stand at a few points each: who shares points with whom is kept as lists, and what a new one changes spreads along them.
    owners: list[list[tuple[int, float]]] = [[] for _ in y]
    near: list[list[tuple[int, float]]] = []
    to: list[float] = []
    weight: list[float] = []
    x: list[float] = []
    waiting = bytearray()
    while free.any():
        best = int(gain.argmax())
        if gain[best] <= floor:
            break
        column, shared = _column(places[best], inside[best]), {}
        for p, v in column.items():
            for i, w in owners[p]:
                shared[i] = shared.get(i, 0.0) + v * w
            owners[p].append((len(taken), v))
        for i, g in shared.items():
            near[i].append((len(taken), g))
        near.append(list(shared.items()))
        to.append(sum(v * float(y[p]) for p, v in column.items()))
        weight.append(sum(v * v for v in column.values()) + float(missed[best]))
        x.append(0.0)
        waiting.append(1)
        taken.append(best)
        free[best] = False
        descend(near, to, weight, x, waiting)
        before, whole = whole, np.bincount(places[taken].ravel(), (inside[taken] * np.array(x)[:, None]).ravel(), len(y))
        left, gain[best] = y - whole, 0.0
        touched = [over[stretch[p] : stretch[p + 1]] for p in np.flatnonzero(whole != before)]
        if touched:
            touched = np.unique(np.concatenate(touched))
            gain[touched] = gains(touched)
    out = []
    for j, c in enumerate(taken):
        if x[j] <= 0:
            continue
        points, column = at[c][hit[c]], _column(places[c], inside[c])
        others = np.maximum(whole[points] - np.array([column.get(p, 0.0) for p in points.tolist()]) * x[j], 0)
        rest = np.zeros(len(shape[c]))
        rest[hit[c]] = np.maximum(y[points] - others, 0)
        norm = float(np.linalg.norm(rest))
        shared_part = float(others.sum() / max(whole[points].sum(), 1e-300))
        out.append((float(mz[mono[c]]), int(z[c]), float((mz[mono[c]] - PROTON) * z[c]), float(x[j] * inside[c].sum()), int(hit[c].sum()), float(rest @ shape[c]) / norm if norm else 0.0, shared_part))
    return sorted(out, key=lambda r: (-r[3], r[0], r[1]))


def isotope_overlaps(points: DataFrame, tolerance: float = 0.02, charges: int = 6, isotopes: int = 8, least_gain: float = 1e-4, least_score: float = 0.0, most_mass: float = 50_000.0) -> DataFrame:
    """(run, scan, mz, charge, mass, intensity, isotopes, score, shared) of the envelopes that together explain each scan of (run, scan, mz, intensity).

    Envelopes of masses up to ``most_mass`` are sent along as a table. Points with a null value, or without intensity, are left out.
    """
    some = points.where("mz is not null and intensity > 0").select("run", "scan", F.col("mz").cast("double").alias("mz"), F.col("intensity").cast("double").alias("intensity"))
    # Few bytes, much work: adaptive execution would put all scans in a few tasks. It keeps a stated number, if the key isn't what they are grouped by already.
    tasks = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = some.repartition(tasks, F.xxhash64("run", "scan")).sortWithinPartitions("run", "scan", "mz", "intensity")
    shared = points.sparkSession.sparkContext.broadcast(envelope_table(most_mass, isotopes))
    names = ["run", "scan", "mz", "charge", "mass", "intensity", "isotopes", "score", "shared"]

    def differs(c: pa.Array) -> np.ndarray:
        """Whether a value differs from the one before it, nulls being equal."""
        a, b = c[1:], c[:-1]
        return (pc.fill_null(pc.not_equal(a, b), False).to_numpy(zero_copy_only=False)) | (a.is_null().to_numpy(zero_copy_only=False) != b.is_null().to_numpy(zero_copy_only=False))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        key, types = None, None

        def solved() -> list[tuple]:
            mz, y = (np.concatenate([h.column(k).to_numpy() for h in held]) for k in (2, 3))
            held.clear()
            return [(*key, *e) for e in explain(mz, y, shared.value, charges, tolerance, least_gain) if e[5] >= least_score]

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], t) for i, t in enumerate(types)], names=names)

        for b in batches:
            types = [b.schema.field(0).type, b.schema.field(1).type, pa.float64(), pa.int32(), pa.float64(), pa.float64(), pa.int32(), pa.float64(), pa.float64()]
            cuts, rows = (np.flatnonzero(differs(b.column(0)) | differs(b.column(1))) + 1).tolist() if len(b) else [], []
            for start, end in zip([0, *cuts], [*cuts, len(b)], strict=True) if len(b) else []:
                mine = b.column(0)[start].as_py(), b.column(1)[start].as_py()
                if held and mine != key:
                    rows += solved()
                key = mine
                held.append(b.slice(start, end - start))
            yield batch(rows)
        if held:
            yield batch(solved())

    run_kind, scan_kind = (points.schema[c].dataType.simpleString() for c in ("run", "scan"))
    return dealt.mapInArrow(run, f"run {run_kind}, scan {scan_kind}, mz double, charge int, mass double, intensity double, isotopes int, score double, shared double")
