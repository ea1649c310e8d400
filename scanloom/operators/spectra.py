"""Points of scans: slices, top-k, decimation, statistics, similarity."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sum_in_range(points: Column, a: Column, b: Column, inclusive: bool = True) -> Column:
    """Sum of y of an array of (x, y) in [a, b] or (a, b)."""
    return F.aggregate(in_range(points, a, b, inclusive), F.lit(0.0), lambda s, p: s + p["y"])


def in_range(points: Column, a: Column, b: Column, inclusive: bool = True) -> Column:
    return F.filter(points, (lambda p: p["x"].between(a, b)) if inclusive else (lambda p: (p["x"] > a) & (p["x"] < b)))


def max_in_range(points: Column, a: Column, b: Column) -> Column:
    """Largest y in [a, b], at least 0."""
    return F.greatest(F.coalesce(F.array_max(F.transform(in_range(points, a, b), lambda p: p["y"])), F.lit(0.0)), F.lit(0.0))


def closest_index(points: Column, x: Column) -> Column:
    """0-based index of the point nearest in x, the first of equals; -1 for none."""
    gaps = F.transform(points, lambda p: F.abs(p["x"] - x))
    return F.when(F.size(points) == 0, -1).otherwise(F.array_position(gaps, F.array_min(gaps)) - 1).cast("int")


def index_at_or_below(points: Column, x: Column) -> Column:
    """0-based index of the last point at or left of x; -1 left of the data, -2 right of it or without points."""
    xs = F.transform(points, lambda p: p["x"])
    return F.when((F.size(points) == 0) | (x > F.array_max(xs)), -2).otherwise(F.size(F.filter(points, lambda p: p["x"] <= x)) - 1).cast("int")


def sum_by_index(points: Column, a: Column, b: Column) -> Column:
    """Sum of y from the last point at or left of a, or the first point, to the last one at or left of b: one point left of a may be in it."""
    before = lambda x: F.size(F.filter(points, lambda p: p["x"] <= x))
    first = F.greatest(before(a), F.lit(1))
    return F.aggregate(F.slice(points, first, F.greatest(before(b) - first + 1, F.lit(0))), F.lit(0.0), lambda s, p: s + p["y"])


def positive(points: DataFrame, least: float = 1e-20) -> DataFrame:
    """Points with an intensity above ``least``."""
    return points.where(F.col("intensity") > least)


def spaced_top_k(points: Column, k: int, spacing: float) -> Column:
    """The k most intense of an array of (x, y), none nearer than ``spacing`` to a stronger one that was taken; in order of intensity, then x."""
    order = F.array_sort(F.transform(points, lambda p: F.struct((-p["y"]).alias("o"), p["x"].alias("x"))))
    none = F.array().cast("array<struct<o:double,x:double>>")
    taken = F.aggregate(order, none, lambda a, p: F.when((F.size(a) < k) & ~F.exists(a, lambda q: F.abs(q["x"] - p["x"]) < spacing), F.concat(a, F.array(p))).otherwise(a))
    return F.transform(taken, lambda p: F.struct(p["x"].alias("x"), (-p["o"]).alias("y")))


def alike(a: Column, b: Column, fudge: float) -> Column:
    """Whether two arrays have one length and differ by ``fudge`` at most at each place."""
    return F.when(F.size(a) != F.size(b), False).otherwise(F.forall(F.zip_with(a, b, lambda x, y: F.abs(x - y) <= fudge), lambda ok: ok))


def nth_element(points: DataFrame, on: Sequence[str], share: float) -> DataFrame:
    """(on, value): element floor(n * share), from 0, of the sorted intensities of each group, found by counts of equal values: no group is held in one array."""
    counts = points.groupBy(*on, "intensity").agg(F.count("*").alias("c"))
    w = Window.partitionBy(*on)
    upto = counts.withColumns({"_upto": F.sum("c").over(w.orderBy("intensity").rowsBetween(Window.unboundedPreceding, 0)), "_n": F.sum("c").over(w)})
    return upto.where(F.col("_upto") > F.floor(F.col("_n") * share)).groupBy(*on).agg(F.min("intensity").alias("value"))


def nearest_within(points: DataFrame, targets: DataFrame, ppm: float) -> DataFrame:
    """(scan, mass, mz, intensity): of each scan the point nearest to each target mass, if it lies within ppm; the smaller m/z of equals."""
    from .joins import interval_join

    w = targets.select("mass", (F.col("mass") * (1 - ppm / 1e6)).alias("lo"), (F.col("mass") * (1 + ppm / 1e6)).alias("hi"))
    near = F.min_by(F.struct("mz", "intensity"), F.struct(F.abs(F.col("mz") - F.col("mass")), F.col("mz"), -F.col("intensity"))).alias("p")
    return interval_join(points, "mz", w, "lo", "hi", 1.0).groupBy("scan", "mass").agg(near).select("scan", "mass", "p.*")


def scaled(points: Column, sx: float, sy: float, dx: float = 0.0, dy: float = 0.0) -> Column:
    return F.transform(points, lambda p: F.struct((p["x"] * sx + dx).alias("x"), (p["y"] * sy + dy).alias("y")))


def as_arrays(points: DataFrame, scan: str = "scan") -> DataFrame:
    """(scan, points): one row a scan, points sorted by x."""
    return points.groupBy(scan).agg(F.array_sort(F.collect_list(F.struct(F.col("mz").alias("x"), F.col("intensity").alias("y")))).alias("points"))


def top_k(points: DataFrame, on: Sequence[str], k: int, ties: Sequence[str]) -> DataFrame:
    """The k most intense points of each group; ties by the given columns."""
    rank = F.row_number().over(Window.partitionBy(*on).orderBy(F.desc("intensity"), *ties))
    return points.withColumn("rank", rank).where(F.col("rank") <= k)


def decimate(points: DataFrame, on: Sequence[str], scale: float) -> DataFrame:
    """(on, bucket, mz, intensity): the most intense point of each integer bucket of mz * scale, the smallest mz of equals."""
    best = F.max_by(F.struct("mz", "intensity"), F.struct("intensity", -F.col("mz"))).alias("p")
    return points.groupBy(*on, F.floor(F.col("mz") * scale).cast("long").alias("bucket")).agg(best).select(*on, "bucket", "p.*")


def upper_median(values: Column) -> Column:
    """Element floor(n / 2), from 0, of the sorted values."""
    s = F.sort_array(F.collect_list(values))
    return F.element_at(s, F.floor(F.size(s) / 2).cast("int") + 1)


def statistics(points: DataFrame, on: Sequence[str]) -> DataFrame:
    """(on, n, lo, hi, step, mean, spread, median) of the intensities and m/z of each group."""
    n = F.count("*")
    return points.groupBy(*on).agg(
        n.alias("n"),
        F.min("mz").alias("lo"),
        F.max("mz").alias("hi"),
        ((F.max("mz") - F.min("mz")) / F.when(n > 1, n - 1)).alias("step"),
        F.avg("intensity").alias("mean"),
        F.stddev_pop("intensity").alias("spread"),
        upper_median(F.col("intensity")).alias("median"),
    )


def noise_floor(points: DataFrame, on: Sequence[str], k: float = 3.0, share: float = 0.8) -> DataFrame:
    """(on, floor): upper median plus k deviations of the lowest ``share`` of the intensities of each group, from counts of equal values: no group is held in one array."""
    counts = points.where("intensity is not null").groupBy(*on, "intensity").agg(F.count("*").alias("c"))
    w = Window.partitionBy(*on)
    upto = counts.withColumns({"_upto": F.sum("c").over(w.orderBy("intensity").rowsBetween(Window.unboundedPreceding, 0)), "_n": F.sum("c").over(w)})
    kept = F.least(F.col("c"), F.ceil(F.col("_n") * share) - (F.col("_upto") - F.col("c")))
    low = upto.withColumn("_low", kept).where("_low > 0").withColumn("_size", F.ceil(F.col("_n") * share))
    mean = F.sum(F.col("_low") * F.col("intensity")).over(w) / F.col("_size")
    off = F.col("intensity") - F.col("_mean")
    median = F.min(F.when(F.col("_upto") > F.floor(F.col("_size") / 2), F.col("intensity")))
    deviation = F.sqrt(F.sum(F.col("_low") * off * off) / F.max("_size"))
    return low.withColumn("_mean", mean).groupBy(*on).agg((median + k * deviation).alias("floor"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0)))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity of arrays; 0 if lengths differ or a norm is 0."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (norm > 0), dot(a, b) / F.when(norm > 0, norm)).otherwise(0.0)


def pearson(a: Column, b: Column) -> Column:
    """Correlation of arrays of one length; 0 if a spread is 0."""
    return cosine(centred(a), centred(b))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of the value, which is computed once, not for each element of an array that ``body`` goes through."""
    return F.transform(F.array(value), body)[0]


def unit(a: Column) -> Column:
    """The vector over its norm, in doubles; zeros for a norm of 0."""
    return _let(F.sqrt(dot(a, a)), lambda norm: F.transform(a, lambda x: F.when(norm > 0, x.cast("double") / norm).otherwise(0.0)))


def centred(a: Column) -> Column:
    """The vector less its mean, in doubles."""
    return _let(F.aggregate(a, F.lit(0.0), lambda s, v: s + v.cast("double")) / F.size(a), lambda mean: F.transform(a, lambda v: v.cast("double") - mean))


def unit_rows(v: np.ndarray) -> np.ndarray:
    """``unit`` of each row."""
    norm = np.sqrt((v * v).sum(axis=1, keepdims=True))
    with np.errstate(invalid="ignore"):
        return np.divide(v, norm, out=np.zeros_like(v), where=~(norm <= 0))


def centred_unit_rows(v: np.ndarray) -> np.ndarray:
    """``unit`` of ``centred`` of each row."""
    with np.errstate(invalid="ignore"):
        return unit_rows(v - v.sum(axis=1, keepdims=True) / v.shape[1])


#: Pairs of a record batch.
PAIRS_AT_ONCE = 1 << 18


def against_all(queries: DataFrame, rows: DataFrame, block: int = 1900, prepared: Callable[[np.ndarray], np.ndarray] | None = None, digits: int | None = None) -> DataFrame:
    """(a, b, s): dot products of every query (id, v) with every row (id, v) but itself; 0 where lengths differ or a vector is null, null where a vector holds a null.

    Queries and rows are dealt to blocks of about ``block`` vectors, and each block of queries meets each of rows in one task's matrix product. What is sent is vectors times
    blocks, as they are; the pairs aren't shuffled. ``prepared`` is applied to the vectors in the tasks, one a row, in doubles; ``digits``: s is rounded to so many, halves away from 0.
    Rows of two blocks come in order of s, so that values equal after rounding stand together and files encode them by dictionary and runs.
    """
    kind = rows.schema["id"].dataType.simpleString()
    mine, theirs = (max(1, -(-df.count() // block)) for df in (queries, rows))
    tasks = min(20_000, mine * theirs)

    def dealt(df: DataFrame, own: str, n: int, other: str, m: int) -> DataFrame:
        # Names of each side's own: of columns that both sides have, the plan may drop one.
        keyed = df.select(F.col("id").alias(f"id{own}"), F.col("v").alias(f"v{own}"), F.pmod(F.xxhash64("id"), F.lit(n)).alias(own))
        keyed = keyed.withColumn(other, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(m - 1).cast("long"))))
        return keyed.repartition(tasks, "_q", "_r").groupBy("_q", "_r")

    def by_length(t: pa.Table) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        """Places and matrix of the vectors of each length; nulls inside are NaN."""
        v = t.column("v").combine_chunks()
        sizes = pc.list_value_length(v).to_numpy(zero_copy_only=False)
        out = {}
        for n in np.unique(sizes[sizes > 0]).astype(int):
            at = np.flatnonzero(sizes == n)
            matrix = v.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(at), n)
            out[n] = at, matrix if prepared is None else prepared(matrix)
        return out

    def met(q: pa.Table, r: pa.Table) -> pa.Table:
        q, r = (t.select([0, 1]).rename_columns(["id", "v"]) for t in (q, r))
        s = np.zeros((len(q), len(r)))
        others = by_length(r)
        for n, (at, a) in by_length(q).items():
            if n in others:
                to, b = others[n]
                s[np.ix_(at, to)] = a @ b.T
        holed = [np.array([v is not None and None in v for v in t.column("v").to_pylist()], bool) if t.column("v").combine_chunks().flatten().null_count else np.zeros(len(t), bool) for t in (q, r)]
        sizes = [np.nan_to_num(pc.list_value_length(t.column("v")).to_numpy().astype(float), nan=-1) for t in (q, r)]
        if digits is not None:
            s = np.copysign(np.floor(np.abs(s) * 10.0**digits + 0.5) / 10.0**digits, s) + 0.0  # no negative zeros
        # Of equal ids, and null ones, no pairs are made.
        ids = [t.column("id") for t in (q, r)]
        codes = pa.chunked_array([c for i in ids for c in i.chunks], ids[0].type).combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
        codes = np.nan_to_num(codes.astype(float), nan=-1)
        mine, theirs = codes[: len(q), None], codes[None, len(q) :]
        pairs = np.flatnonzero(((mine != theirs) & (mine >= 0) & (theirs >= 0)).ravel())
        pairs = pairs[np.argsort(s.ravel()[pairs])]
        a, b = np.divmod(pairs, max(len(r), 1))
        none = None
        if holed[0].any() or holed[1].any():
            none = ((holed[0][:, None] | holed[1][None, :]) & (sizes[0][:, None] == sizes[1][None, :])).ravel()[pairs]
        values = [i.combine_chunks().take(pa.array(x)) for i, x in zip(ids, (a, b), strict=True)]
        out = pa.RecordBatch.from_arrays([*values, pa.array(s.ravel()[pairs], pa.float64(), mask=none)], names=["a", "b", "s"])
        return pa.Table.from_batches([out.slice(k, PAIRS_AT_ONCE) for k in range(0, len(out), PAIRS_AT_ONCE)], out.schema)

    return dealt(queries, "_q", mine, "_r", theirs).cogroup(dealt(rows, "_r", theirs, "_q", mine)).applyInArrow(met, f"a {kind}, b {kind}, s double")


def masked(binned: DataFrame, on: Sequence[str], listed: DataFrame, tolerance: float) -> DataFrame:
    """(on, bin, x, y): values within ``tolerance`` of a listed x replaced by the last value before the zone."""
    from .joins import band_join

    zone = band_join(binned.select(*on, "bin", "x"), "x", listed.withColumnRenamed("x", "lx"), "lx", F.lit(tolerance), tolerance).select(*on, "bin").distinct().withColumn("_in", F.lit(True))
    seen = binned.join(zone, [*on, "bin"], "left").withColumn("_free", F.when(F.col("_in").isNull(), F.col("y")))
    w = Window.partitionBy(*on).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    return seen.select(*on, "bin", "x", F.coalesce(F.last("_free", True).over(w), F.lit(0.0)).alias("y"))
