"""Connected components of a distributed list of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import stored


def connected_components(links: DataFrame, rounds: int = 100) -> DataFrame:
    """(id, component) of all ids in (u, v), component the smallest id reachable.

    Contraction: in each round every node hooks onto the neighbour that comes first in an order drawn anew for the round, paths are cut short by
    following pointers twice more, and the links are written again between the nodes hooked onto. In a random order about a third of
    a path's nodes are hooked onto, so links shrink by a constant factor a round, long chains included. The rounds' maps are
    then composed from the last to the first. Each step is a partial aggregation or a join that can be split at a hot key, and every result is
    a stored table, so a lost executor costs a retry and plans and size estimates don't grow. It is an error if links are left
    after ``rounds``.
    """
    edges = stored(links.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
    maps: list[DataFrame] = []
    for k in range(rounds):
        if edges.isEmpty():
            break
        place = lambda c: F.struct(F.xxhash64(F.col(c), F.lit(k)).alias("h"), F.col(c).alias("x"))  # noqa: B023, E731
        both = edges.select("u", place("v").alias("p")).union(edges.select(F.col("v").alias("u"), place("u").alias("p")))
        first = both.groupBy("u").agg(F.min("p").alias("p"))
        hooks = stored(first.select(F.col("u").alias("id"), F.least("p", place("u"))["x"].alias("to")))
        up = hooks.select(F.col("id").alias("_i"), F.col("to").alias("_t"))
        for _ in range(2):
            hooks = hooks.join(up, F.col("to") == F.col("_i")).select("id", F.col("_t").alias("to"))
        hooks = stored(hooks)
        maps.append(hooks)
        a, b = (hooks.select(F.col("id").alias(i), F.col("to").alias(t)) for i, t in (("_a", "_x"), ("_b", "_y")))
        moved = edges.join(a, F.col("u") == F.col("_a")).join(b, F.col("v") == F.col("_b")).where("_x <> _y")
        edges = stored(moved.select(F.least("_x", "_y").alias("u"), F.greatest("_x", "_y").alias("v")).distinct())
    else:
        raise RuntimeError("components did not settle")
    if not maps:
        return edges.select(F.col("u").alias("id"), F.col("v").alias("component"))  # no links
    out = maps.pop()
    while maps:
        after = out.select(F.col("id").alias("_i"), F.col("to").alias("_t"))
        out = stored(maps.pop().join(after, F.col("to") == F.col("_i"), "left").select("id", F.coalesce("_t", "to").alias("to")))
    least = stored(out.groupBy("to").agg(F.min("id").alias("component")).withColumnRenamed("to", "_t"))
    return out.join(least, F.col("to") == F.col("_t")).select("id", "component")
