"""Hierarchical roll-ups of report columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dash_if_different(c: str, ignore_empty: bool = False) -> Column:
    """The common value, '--' if there are several; null and empty are values unless ignored."""
    x = F.when(F.col(c).isNotNull() & (F.col(c) != ""), F.col(c)) if ignore_empty else F.coalesce(F.col(c), F.lit(""))
    return F.when(F.count_distinct(x) > 1, "--").otherwise(F.coalesce(F.max(x), F.lit("")))


def total(c: str, digits: int = 2) -> Column:
    return F.format_string(f"%.{digits}f", F.coalesce(F.sum(F.col(c).cast("double")), F.lit(0.0)))


def value_range(c: str, digits: int = 2) -> Column:
    """'min - max', or the value if both are equal; nulls left out."""
    lo, hi = F.min(F.col(c).cast("double")), F.max(F.col(c).cast("double"))
    fmt = f"%.{digits}f"
    return F.when(lo.isNull(), "").when(lo == hi, F.format_string(fmt, lo)).otherwise(F.concat(F.format_string(fmt, lo), F.lit(" - "), F.format_string(fmt, hi)))


def value_list(c: str, order: str, distinct: bool = True) -> Column:
    """Values in the order of ``order``, '; ' between them, empties dropped."""
    x = F.transform(F.array_sort(F.collect_list(F.when(F.col(c).isNotNull() & (F.col(c) != ""), F.struct(F.col(order).alias("o"), F.col(c).alias("v"))))), lambda s: s["v"])
    return F.array_join(F.array_distinct(x) if distinct else x, "; ")


def with_count(original: Column, n: Column) -> Column:
    return F.concat(original, F.lit(" ("), n.cast("string"), F.lit(")"))


def roll_up(rows: DataFrame, levels: Sequence[str], columns: dict[str, Column]) -> DataFrame:
    """One row for each node of the tree over ``levels`` (null below a node's own level), columns aggregated over all its leaves."""
    depth = sum((F.lit(1) - F.grouping(c) for c in levels), F.lit(0)).cast("int")
    return rows.rollup(*levels).agg(depth.alias("depth"), *[v.alias(k) for k, v in columns.items()])


def roll_up_lists(rows: DataFrame, levels: Sequence[str], column: str, order: str) -> DataFrame:
    """(levels, depth, column): as ``roll_up`` with ``value_list``. A node gathers its distinct values, each with the first place it stands at, not its leaves."""
    sets = [list(levels[:k]) for k in range(len(levels) + 1)]
    depth = sum((F.lit(1) - F.grouping(c) for c in levels), F.lit(0)).cast("int")
    firsts = rows.groupingSets([[*(F.col(c) for c in s), F.col(column)] for s in sets], *(F.col(c) for c in levels), F.col(column)).agg(depth.alias("depth"), F.min(order).alias("_first"))
    return firsts.groupBy(*levels, "depth").agg(value_list(column, "_first").alias(column))


def roll_up_children(rows: DataFrame, levels: Sequence[str], column: str, order: str) -> dict[int, DataFrame]:
    """For each depth, lists of the immediate children's summaries: computed bottom-up, each level from the one below."""
    out, now = {}, rows
    for depth in range(len(levels) - 1, -1, -1):
        now = now.groupBy(*levels[: depth + 1]).agg(value_list(column, order).alias(column), F.min(order).alias(order))
        out[depth] = now
    return out


def leaves(tree: DataFrame) -> DataFrame:
    """Nodes of (node_id, parent_id, ...) that are nobody's parent."""
    return tree.join(tree.select(F.col("parent_id").alias("node_id")).where("node_id is not null").distinct(), "node_id", "left_anti")
