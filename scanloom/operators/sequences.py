"""Ladders of peptides, as rows: a peptide of any length is summed by a window, not by nested arrays. Their totals are made where the peptides are."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.chem import PROTON, RESIDUES, WATER

#: Residues, and padding, that ``ladder_totals`` sums together.
CELLS_AT_ONCE = 1 << 20


def ladder(peptides: DataFrame, on: Sequence[str], sequence: str = "seq", modifications: DataFrame | None = None) -> DataFrame:
    """(on, ion, k, mass, weight): the n - 1 b ions (weight 0.25) and the n y ions (0.75, the last is the whole peptide) of charge 1.

    ``modifications``: (on, position from 1, delta), added to the residue there. An empty or null sequence has no ions.
    """
    table = F.create_map(*[F.lit(x) for pair in RESIDUES.items() for x in pair])
    letters = F.filter(F.split(sequence, ""), lambda c: c != "")
    rows = peptides.select(*on, F.posexplode(letters).alias("i", "c")).select(*on, "i", F.coalesce(F.element_at(table, F.col("c")), F.lit(0.0)).alias("m"))
    if modifications is not None:
        extra = modifications.groupBy(*on, (F.col("position") - 1).alias("i")).agg(F.sum("delta").alias("d"))
        rows = rows.join(extra, [*on, "i"], "left").withColumn("m", F.col("m") + F.coalesce("d", F.lit(0.0))).drop("d")
    line = Window.partitionBy(*on).orderBy("i")
    whole = Window.partitionBy(*on)
    sums = rows.withColumns({"b": F.sum("m").over(line.rowsBetween(Window.unboundedPreceding, 0)), "all": F.sum("m").over(whole), "n": F.count("*").over(whole)})
    ion = lambda name, k, mass, weight: F.struct(F.lit(name).alias("ion"), k.cast("int").alias("k"), mass.alias("mass"), F.lit(weight).alias("weight"))
    k = F.col("i") + 1
    y = ion("y", F.col("n") - F.col("i"), F.col("all") - (F.col("b") - F.col("m")) + WATER + PROTON, 0.75)
    both = F.when(k < F.col("n"), F.array(ion("b", k, F.col("b") + PROTON, 0.25), y)).otherwise(F.array(y))
    return sums.select(*on, F.explode(both).alias("f")).select(*on, "f.*")


def _totals(masses: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Columns (mass, weighted, least, most) of ladders: a row of ``masses`` is a peptide's residues, 0 after its end."""
    k = np.arange(masses.shape[1])
    pre = np.cumsum(masses, axis=1)
    inside, before_last = k < lengths[:, None], k < lengths[:, None] - 1
    b, y = pre + PROTON, pre[:, -1:] - (pre - masses) + WATER + PROTON
    b_sum, y_sum = np.where(before_last, b, 0.0).sum(axis=1), np.where(inside, y, 0.0).sum(axis=1)
    least = np.minimum(np.where(before_last, b, np.inf).min(axis=1), np.where(inside, y, np.inf).min(axis=1))
    most = np.maximum(np.where(before_last, b, -np.inf).max(axis=1), np.where(inside, y, -np.inf).max(axis=1))
    return np.stack([b_sum + y_sum, 0.25 * b_sum + 0.75 * y_sum, least, most])


def ladder_totals(peptides: DataFrame, on: Sequence[str], sequence: str = "seq") -> DataFrame:
    """(on, n, mass, weighted, least, most): number of ions of each peptide's ``ladder``, sums of their masses, plain and by weight, the least and the largest mass.

    A row is a peptide; those without ions aren't in it. Nothing is shuffled: peptides of about one length are summed together as arrays.
    """
    kinds = {c: peptides.schema[c].dataType.simpleString() for c in on}
    table = np.zeros(128)
    for r, m in RESIDUES.items():
        table[ord(r)] = m

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column(len(on)).to_pylist()
            lengths = np.array([len(w) for w in words], np.int64)
            codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
            flat = np.where(codes < 128, table[np.minimum(codes, 127)], 0.0)
            starts = np.cumsum(lengths) - lengths
            out = np.zeros((4, len(words)))
            order = np.argsort(lengths, kind="stable")
            at = 0
            while at < len(order):
                # Up to half as long again as the first one, so padding is bounded.
                end = int(np.searchsorted(lengths[order], 1.5 * lengths[order[at]] + 4, "right"))
                wide = int(lengths[order[end - 1]])
                rows = order[at : min(end, at + max(1, CELLS_AT_ONCE // wide))]
                wide = int(lengths[rows[-1]])
                place = starts[rows][:, None] + np.arange(wide)
                inside = np.arange(wide) < lengths[rows][:, None]
                out[:, rows] = _totals(np.where(inside, flat[np.minimum(place, len(flat) - 1)], 0.0), lengths[rows])
                at += len(rows)
            arrays = [*(batch.column(k) for k in range(len(on))), pa.array(2 * lengths - 1), *(pa.array(v) for v in out)]
            yield pa.RecordBatch.from_arrays(arrays, names=[*on, "n", "mass", "weighted", "least", "most"])

    some = peptides.where(F.length(sequence) > 0).select(*on, F.col(sequence).alias("_seq"))
    keys = ", ".join(f"{c} {k}" for c, k in kinds.items())
    return some.mapInArrow(run, f"{keys}, n long, mass double, weighted double, least double, most double")
