"""Delta-mass distributions from modification sites."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def delta_masses(sites: DataFrame, granularity: float = 100.0, pruning: float = 1e-5) -> DataFrame:
    """(protein, delta, fraction) of each protein's sites together, from (protein, site, delta, fraction).

    Each site also has its wild type, with the fraction that is left; a site whose fractions exceed 1 is an error. A protein's sites are folded one
    by one, in order; a step drops what is below ``pruning`` and merges by rounded mass, so a distribution stays as short as its mass
    range. Proteins are dealt to tasks by key and pass as a sorted stream; a task holds one site and one distribution.
    """
    by = sites.select("protein", "site", F.round(F.col("delta") * granularity).cast("long").alias("bin"), "fraction")
    by = by.groupBy("protein", "site", "bin").agg(F.sum("fraction").alias("fraction")).repartition("protein").sortWithinPartitions("protein", "site", "bin")
    kind = by.schema["protein"].dataType.simpleString()

    def fold(now: dict[int, float], options: list[tuple[int, float]]) -> dict[int, float]:
        rest = 1 - sum(f for _, f in options)
        if rest < -1e-12:
            raise ValueError("the fractions of a site exceed 1")
        out: dict[int, float] = {}
        for x, f in now.items():
            for y, g in ((0, rest), *options):
                if f * g >= pruning:
                    out[x + y] = out.get(x + y, 0.0) + f * g
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        protein, site, now, options, types = None, None, None, [], None
        for b in batches:
            types, out = b.schema.field(0).type, []
            for p, s, x, f in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if now is not None and (p, s) != (protein, site):
                    now, options = fold(now, options), []
                    if p != protein:
                        out += [(protein, x_, f_) for x_, f_ in sorted(now.items())]
                        now = {0: 1.0}
                protein, site, now = p, s, now or {0: 1.0}
                options.append((x, f))
            yield batch(out, types)
        if now is not None:
            yield batch([(protein, x, f) for x, f in sorted(fold(now, options).items())], types)

    def batch(out: list, kind_: pa.DataType) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((kind_, pa.int64(), pa.float64()))], names=["protein", "bin", "fraction"])

    return by.mapInArrow(run, f"protein {kind}, bin long, fraction double").select("protein", (F.col("bin") / granularity).alias("delta"), "fraction")


def positions(rows: DataFrame) -> DataFrame:
    """(protein, position, mod, fraction) from (protein, positions '1,2', mods 'a;b', percent): paired, summed, percent over 100."""
    pairs = F.explode(F.arrays_zip(F.split("positions", ",").alias("p"), F.split("mods", ";").alias("m")))
    parts = rows.select("protein", "percent", pairs.alias("z")).select("protein", F.col("z.p").cast("int").alias("position"), F.trim("z.m").alias("mod"), "percent")
    return parts.where("position is not null and mod is not null").groupBy("protein", "position", "mod").agg((F.sum("percent") / 100).alias("fraction"))


def replicate(rows: DataFrame, count: str) -> DataFrame:
    """Each row ``count`` times, with its number from 0 as ``chain``."""
    return rows.where(F.col(count) > 0).withColumn("chain", F.explode(F.sequence(F.lit(0), F.col(count) - 1)))
