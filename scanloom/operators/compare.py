"""Comparison of two runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .joins import band_join, interpolate


def both(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.join(b.select(key).distinct(), key, "left_semi")


def only(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Rows of ``a`` whose key isn't in ``b``."""
    return a.join(b.select(key).distinct(), key, "left_anti")


def profile_difference(a: DataFrame, b: DataFrame, on: list[str], x: str, y: str, relative: float = 0.1) -> DataFrame:
    """Points of ``a`` that differ from ``b`` interpolated at their x by more than ``relative``, or stand outside of it."""
    ends = b.groupBy(*on).agg(F.min(x).alias("_lo"), F.max(x).alias("_hi"))
    seen = interpolate(a, x, b, x, y, on, True, "other").join(ends, on, "left")
    out = F.coalesce(~F.col(x).between(F.col("_lo"), F.col("_hi")), F.lit(True))
    far = F.abs(F.col(y) - F.col("other")) > relative * F.abs(F.col(y))
    return seen.where(out | far).select(*a.columns, F.when(out, None).otherwise(F.col("other")).alias("other"))


def aligned_cosine(a: DataFrame, b: DataFrame, on: Sequence[str], x: str, y: str) -> DataFrame:
    """(on, s): cosine similarity of two point lists (on, x, y) of each key, aligned on equal x; what one lacks is 0. 0 for a norm of 0."""
    left, right = a.select(*on, x, F.col(y).alias("_a")), b.select(*on, x, F.col(y).alias("_b"))
    both = left.join(right, [*on, x], "full")
    p, q = F.coalesce("_a", F.lit(0.0)), F.coalesce("_b", F.lit(0.0))
    sums = both.groupBy(*on).agg(F.sum(p * q).alias("d"), (F.sqrt(F.sum(p * p)) * F.sqrt(F.sum(q * q))).alias("n"))
    return sums.select(*on, F.when(F.col("n") > 0, F.col("d") / F.when(F.col("n") > 0, F.col("n"))).otherwise(0.0).alias("s"))


def difference_by_index(a: DataFrame, b: DataFrame, on: Sequence[str], x: str, y: str, dx: float = 0.1, share: float = 0.1) -> DataFrame:
    """(on, i, xa, ya, xb, yb): centroids of the same place in order of x that lie more than ``dx`` apart or whose heights differ by more than ``share`` of the first; places
    that only one list has."""
    w = Window.partitionBy(*on).orderBy(x, y)
    left, right = (df.select(*on, F.row_number().over(w).alias("i"), F.col(x).alias(f"x{s}"), F.col(y).alias(f"y{s}")) for df, s in ((a, "a"), (b, "b")))
    both = left.join(right, [*on, "i"], "full")
    far = (F.abs(F.col("xa") - F.col("xb")) > dx) | (F.abs(F.col("ya") - F.col("yb")) > share * F.abs(F.col("ya")))
    return both.where(F.col("xa").isNull() | F.col("xb").isNull() | far)


def only_by_coordinate(a: DataFrame, b: DataFrame, on: Sequence[str], x: str, dx: float = 0.1) -> DataFrame:
    """Rows of ``a`` without a row of ``b`` within ``dx`` in x."""
    near = band_join(a.select(*on, x).distinct(), x, b.select(*on, F.col(x).alias("_o")).distinct(), "_o", F.lit(dx), dx, on).select(*on, x).distinct()
    return a.join(near, [*on, x], "left_anti")
