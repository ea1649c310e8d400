"""Isotope envelopes of the averagine model: the mean composition of a residue, scaled to a mass."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Atoms of each element in a mean residue of 111.1254 Da, and abundances of the isotopes by added neutrons.
RESIDUE_MASS = 111.1254
ATOMS = {"C": 4.9384, "H": 7.7583, "N": 1.3577, "O": 1.4773, "S": 0.0417}
ABUNDANCES = {"C": (0.9893, 0.0107), "H": (0.999885, 0.000115), "N": (0.99636, 0.00364), "O": (0.99757, 0.00038, 0.00205), "S": (0.9499, 0.0075, 0.0425, 0.0, 0.0001)}

STEP = 50.0


@lru_cache(maxsize=4096)
def _at(step: int, n: int) -> np.ndarray:
    """Fractions of the first n isotopes at a multiple of STEP: the generating functions of the elements raised to their counts, as logarithms of transforms."""
    size = 1 << max(6, int(np.ceil(np.log2(max(4 * n, 4 * step * STEP / 1500)))))
    total = np.zeros(size // 2 + 1, complex)
    for e, atoms in ATOMS.items():
        count = atoms * step * STEP / RESIDUE_MASS
        total += np.log(np.fft.rfft(np.array(ABUNDANCES[e]), size)) * count
    return np.maximum(np.fft.irfft(np.exp(total), size), 0)[:n]


def envelope(mass: float, n: int) -> np.ndarray:
    """Fractions of the first n isotopes of a mass, linear between the table's masses; (1, 0, ...) at 0."""
    low = int(max(mass, 0.0) // STEP)
    share = max(mass, 0.0) / STEP - low
    return (1 - share) * _at(low, n) + share * _at(low + 1, n)


def unit_envelopes(masses: np.ndarray, n: int) -> np.ndarray:
    """Unit vectors of the first n fractions of each mass, however great: ratios to the first fraction, which itself may be too small for a number.

    With c the coefficients of x (log g)' of the generating function g, k g_k = c_1 g_(k-1) + ... + c_k g_0.
    """
    slope = np.zeros(n)
    for e, atoms in ATOMS.items():
        p = np.zeros(max(n, len(ABUNDANCES[e])))
        p[: len(ABUNDANCES[e])] = ABUNDANCES[e]
        c = np.zeros(n)
        for k in range(1, n):
            c[k] = (k * p[k] - sum(p[j] * c[k - j] for j in range(1, k))) / p[0]
        slope += c * atoms / RESIDUE_MASS
    g = np.zeros((len(masses), n))
    g[:, 0] = 1.0
    for k in range(1, n):
        g[:, k] = sum(slope[j] * masses * g[:, k - j] for j in range(1, k + 1)) / k
        g /= np.maximum(g[:, k : k + 1], 1.0)  # scaled on the way, so that none is too large
    return g / np.linalg.norm(g, axis=1, keepdims=True)


def with_fractions(rows: DataFrame, mass: Column, n: int, most_mass: float = 100_000.0, out: str = "fractions") -> DataFrame:
    """``rows`` with the fractions of the first n isotopes of a mass, linear between the table's masses; null for a null mass, and beyond ``most_mass``.

    The table has one row a step, so its size is fixed, and it is broadcast.
    """
    spark = rows.sparkSession
    steps = [(k, _at(k, n).tolist(), _at(k + 1, n).tolist()) for k in range(int(most_mass // STEP) + 1)]
    table = F.broadcast(spark.createDataFrame(steps, "_step long, _low array<double>, _high array<double>"))
    m = F.greatest(mass.cast("double"), F.lit(0.0))
    share = m / STEP - F.floor(m / STEP)
    mixed = F.zip_with("_low", "_high", lambda a, b: a + (b - a) * F.col("_share"))
    placed = rows.withColumn("_step", F.when(mass.isNotNull(), F.floor(m / STEP).cast("long"))).withColumn("_share", share)
    return placed.join(table, "_step", "left").withColumn(out, mixed).drop("_step", "_share", "_low", "_high")
