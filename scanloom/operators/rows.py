"""Row trees and keyed tables: columns by header, matching, union, replacement, near-duplicates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def columns_by_header(df: DataFrame, headers: Sequence[str], default: str = "") -> DataFrame:
    """The columns in the order of the headers; one that is missing is filled with the default."""
    return df.select(*[F.col(h) if h in df.columns else F.lit(default).alias(h) for h in dict.fromkeys(headers)])


def with_columns_once(df: DataFrame, defaults: dict[str, object], front: bool = False) -> DataFrame:
    """``df`` with the columns that it lacks, each with its default, at the end or in front."""
    new = [F.lit(v).alias(k) for k, v in defaults.items() if k not in df.columns]
    return df.select(*new, "*") if front else df.select("*", *new)


def with_literals(df: DataFrame, values: dict[str, object]) -> DataFrame:
    """``df`` with all rows of the named columns set to the values."""
    return df.withColumns({k: F.lit(v) for k, v in values.items()})


def matching(df: DataFrame, example: dict[str, object]) -> DataFrame:
    """Rows that have the example's values; null matches null."""
    for k, v in example.items():
        df = df.where(F.col(k).eqNullSafe(F.lit(v)))
    return df


def first_in_order(df: DataFrame, order: Sequence[str | Column], example: dict[str, object]) -> DataFrame:
    """The first matching row in the order of a tree walk, or none."""
    return matching(df, example).orderBy(*order).limit(1)


def appended(*lists: DataFrame) -> DataFrame:
    """The rows of all lists under the header of the first."""
    out = lists[0]
    for df in lists[1:]:
        out = out.unionByName(df.select(*[c for c in out.columns if c in df.columns]), allowMissingColumns=True)
    return out


def replaced(old: DataFrame, new: DataFrame, key: Sequence[str]) -> DataFrame:
    """Insert or update: rows of ``new``, and those of ``old`` whose key isn't among them."""
    return new.select(old.columns).unionByName(old.join(new.select(*key).distinct(), list(key), "left_anti"))


def without_near_duplicates(points: DataFrame, on: Sequence[str], x: str, ties: Sequence[str] = (), fudge: float = 1e-15) -> DataFrame:
    """Rows of each group without those whose x is within ``fudge`` of the one before."""
    w = Window.partitionBy(*on).orderBy(x, *ties)
    return points.withColumn("_gap", F.col(x) - F.lag(x).over(w)).where(F.col("_gap").isNull() | (F.col("_gap") > fudge)).drop("_gap")


def first_row_per_group(df: DataFrame, group: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One whole row of each group, the first by ``order``; a query that leaves the choice open gets this one."""
    rest = [c for c in df.columns if c not in group]
    return df.groupBy(*group).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(*group, "_r.*")
