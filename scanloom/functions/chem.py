"""Masses, tolerances and sequences as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Monoisotopic masses of particles, water and amino-acid residues, in Dalton.
PROTON = 1.00727646688
HYDROGEN = 1.00782503207
WATER = 18.0105646863
C13_GAP = 1.0033548378
DEAMIDATION = 0.9840155848
RESIDUES = {
    "A": 71.03711, "C": 103.00919, "D": 115.02694, "E": 129.04259, "F": 147.06841, "G": 57.02146, "H": 137.05891,
    "I": 113.08406, "K": 128.09496, "L": 113.08406, "M": 131.04049, "N": 114.04293, "P": 97.05276, "Q": 128.05858,
    "R": 156.10111, "S": 87.03203, "T": 101.04768, "V": 99.06841, "W": 186.07931, "Y": 163.06333,
}


_LETTERS = "".join(RESIDUES)


def mz_of(mass: Column, z: Column) -> Column:
    return (mass + z * PROTON) / z


def mass_of(mz: Column, z: Column) -> Column:
    return mz * z - z * PROTON


def ppm_tolerance(mass: Column, ppm: float) -> Column:
    return mass * ppm / 1e6


def within_ppm(a: Column, b: Column, ppm: float) -> Column:
    return F.abs(a - b) <= F.greatest(a, b) * ppm / 1e6


def round_to(v: Column, p: float) -> Column:
    return F.round(v * p) / p


def mz_bin(mz: Column, per_unit: int = 500) -> Column:
    return F.floor(mz * per_unit).cast("long")


def isotope_window(mass: Column, z: Column, ppm: float, isotope: int) -> tuple[Column, Column]:
    """m/z bounds of the n-th isotope; a negative number means the deamidated form."""
    centre = mz_of(mass + (isotope * C13_GAP if isotope >= 0 else DEAMIDATION), z)
    return centre * (1 - ppm / 1e6), centre * (1 + ppm / 1e6)


def isotope_comb(mz: Column, z: Column, n: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: mz + k * C13_GAP / z)


def clean(sequence: Column) -> Column:
    return F.upper(F.regexp_replace(sequence, f"[^{_LETTERS}{_LETTERS.lower()}]", ""))


def residue_masses(sequence: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in RESIDUES.items() for x in pair])
    return F.transform(F.filter(F.split(sequence, ""), lambda c: c != ""), lambda c: F.coalesce(F.element_at(table, c), F.lit(0.0)))


def peptide_mass(sequence: Column) -> Column:
    return F.aggregate(residue_masses(sequence), F.lit(WATER), lambda s, m: s + m)


def digest(sequence: Column, after: str = "KR") -> Column:
    """Parts that end with one of the residues; the tail is kept."""
    return F.filter(F.split(sequence, f"(?<=[{after}])"), lambda p: p != "")


def fragments(sequence: Column) -> Column:
    """Sorted masses of b and y ions of charge 1, with their weights 0.25 and 0.75."""
    m = residue_masses(sequence)

    def prefix(k: Column) -> Column:
        return F.aggregate(F.slice(m, F.lit(1), k), F.lit(0.0), lambda s, x: s + x)

    whole = F.aggregate(m, F.lit(0.0), lambda s, x: s + x)
    n = F.size(m)
    ladder = F.when(n < 2, F.array().cast("array<struct<mass:double,weight:double>>")).otherwise(
        F.flatten(F.transform(F.sequence(F.lit(1), n - 1), lambda k: F.array(F.struct((prefix(k) + PROTON).alias("mass"), F.lit(0.25).alias("weight")), F.struct((whole - prefix(k) + WATER + PROTON).alias("mass"), F.lit(0.75).alias("weight")))))
    )
    return F.array_sort(ladder)


def modification_mass(text: Column) -> Column:
    """The mass in 'name/mass)'; 0 if there is none."""
    last = F.regexp_replace(F.element_at(F.split(text, "/"), -1), r"\)$", "")
    return F.coalesce(last.try_cast("double"), F.lit(0.0))


def format_value(v: Column, kind: str, digits: int = 2) -> Column:
    """As a report shows it: decimal, scientific, percent, integer or plain."""
    fmt = {"decimal": f"%.{digits}f", "scientific": f"%.{digits}e", "percent": f"%.{digits}f"}
    if kind == "integer":
        return F.format_string("%d", F.round(v).cast("long"))
    return F.format_string(fmt[kind], v * 100 if kind == "percent" else v) if kind in fmt else v.cast("string")


def charge_by_comb(points: Column, mz: Column, most: int = 10, tolerance: float = 0.01, teeth: int = 3) -> Column:
    """Charge 1 to ``most`` whose isotope spacing gathers most: summed intensity at the teeth on both sides times the number of teeth met; 0 if none.

    ``points``: array of (x, y).
    """

    def score(z: Column) -> Column:
        at = F.transform(F.filter(F.sequence(F.lit(-teeth), F.lit(teeth)), lambda k: k != 0), lambda k: mz + k * C13_GAP / z)
        got = F.transform(at, lambda c: F.aggregate(F.filter(points, lambda p: F.abs(p["x"] - c) <= tolerance), F.lit(0.0), lambda s, p: s + p["y"]))
        return F.aggregate(got, F.lit(0.0), lambda s, v: s + v) * F.size(F.filter(got, lambda v: v > 0))

    scored = F.transform(F.sequence(F.lit(1), F.lit(most)), lambda z: F.struct(score(z).alias("s"), (-z).alias("z")))
    best = F.array_max(scored)
    return F.when(best["s"] > 0, -best["z"]).otherwise(0)
