"""As-of, band and interval joins, all as equi-joins or windows.

Catalyst plans a pure range predicate as a nested loop. Here the narrow side is exploded into buckets of a chosen width, the join is
on the bucket, and the exact predicate stays as residual.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def bucket(x: Column, width: float) -> Column:
    return F.floor(x / F.lit(float(width))).cast("long")


def interval_join(points: DataFrame, x: str, intervals: DataFrame, lo: str, hi: str, width: float, on: Sequence[str] = ()) -> DataFrame:
    """Every point with every closed interval [lo, hi] that holds it, within equal ``on`` columns.

    Each point has one bucket, so no pair comes twice. Null bounds hold nothing.
    """
    wide = intervals.where(F.col(lo) <= F.col(hi)).withColumn("_bucket", F.explode(F.sequence(bucket(F.col(lo), width), bucket(F.col(hi), width))))
    keyed = points.withColumn("_bucket", bucket(F.col(x), width))
    return keyed.join(wide, [*on, "_bucket"]).where(F.col(x).between(F.col(lo), F.col(hi))).drop("_bucket")


def overlapping_pairs(intervals: DataFrame, id_col: str, lo: str, hi: str, width: float, on: Sequence[str] = ()) -> DataFrame:
    """(on, a, b, a_lo, a_hi, b_lo, b_hi) of all pairs a < b of closed intervals that share a point. A pair meets in the bucket of its first common point only."""
    wide = intervals.where(F.col(lo) <= F.col(hi)).withColumn("_bucket", F.explode(F.sequence(bucket(F.col(lo), width), bucket(F.col(hi), width))))
    a, b = (wide.select(*on, "_bucket", F.col(id_col).alias(n), F.col(lo).alias(f"{n}_lo"), F.col(hi).alias(f"{n}_hi")) for n in "ab")
    first = F.greatest("a_lo", "b_lo")
    return a.join(b, [*on, "_bucket"]).where((F.col("a") < F.col("b")) & (first <= F.least("a_hi", "b_hi")) & (F.col("_bucket") == bucket(first, width))).drop("_bucket")


#: Pairs that one task of ``all_pairs`` makes.
PAIRS_PER_TASK = 1_000_000


def all_pairs(rows: DataFrame, id_col: str, on: Sequence[str]) -> DataFrame:
    """(on, a_*, b_*) of all pairs of rows with equal ``on`` and a's id below b's.

    As many as there are, so the work is quadratic in a group; a task holds a slice of one group against the whole of it, and slices are dealt by number, so one
    group is many tasks and nothing is held but the rows.
    """
    sizes = rows.groupBy(*on).agg(F.count("*").cast("double").alias("n"))
    pairs = sizes.agg(F.sum(F.col("n") * F.col("n"))).first()[0] or 0.0
    tasks = max(1, min(20_000, int(pairs // PAIRS_PER_TASK)))
    slices = max(1, min(tasks, int((sizes.agg(F.max("n")).first()[0] or 0) ** 2 // PAIRS_PER_TASK)))
    a = rows.select(*on, *[F.col(c).alias(f"a_{c}") for c in rows.columns if c not in on])
    b = rows.select(*on, *[F.col(c).alias(f"b_{c}") for c in rows.columns if c not in on])
    a = a.withColumn("_slice", F.pmod(F.xxhash64(f"a_{id_col}"), F.lit(slices)))
    b = b.withColumn("_slice", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(slices - 1).cast("long"))))
    a, b = (df.repartition(tasks, *on, "_slice") for df in (a, b))
    return a.join(b, [*on, "_slice"]).where(F.col(f"a_{id_col}") < F.col(f"b_{id_col}")).drop("_slice")


def band_join(left: DataFrame, a: str, right: DataFrame, b: str, tolerance: Column, most: float, on: Sequence[str] = (), closed: bool = True) -> DataFrame:
    """Pairs with |a - b| within ``tolerance`` (an expression of both sides, at most ``most``)."""
    near = F.explode(F.array(*[bucket(F.col(a), most) + F.lit(d) for d in (-1, 0, 1)]))
    pairs = left.withColumn("_bucket", near).join(right.withColumn("_bucket", bucket(F.col(b), most)), [*on, "_bucket"]).drop("_bucket")
    gap = F.abs(F.col(a) - F.col(b))
    return pairs.where(gap <= tolerance if closed else gap < tolerance)


#: Right rows of a bucket of ``best_within``, about, and pairs that it looks at together.
ROWS_PER_BAND = 50_000
PAIRS_AT_ONCE = 1 << 20


def best_within(left: DataFrame, key: str, right: DataFrame, x: str, order: Sequence[Column], width: float, on: Sequence[str] = (), y: str | None = None) -> DataFrame:
    """(key, right columns): for each ``key`` the right row that comes first by ``order`` (ascending, nulls first) of those with ``on`` equal, x in the closed [_lo, _hi] and, with
    ``y``, y in the closed [_from, _to] of a left row. Keys without one aren't in it. With a column ``_at`` in ``left``, x counts if |_at - x| <= _reach, and _lo and _hi only guide.

    Rows meet in buckets of x, at least ``width`` wide; inside one, a bucket's rows are sorted, and a left row's stretch is answered by a table of minima, with y by strips of it. So
    pairs are neither shuffled nor, but for those in strips at the ends of a y range, made.
    """
    kept, names = [c for c in right.columns if c not in on], [f"_o{i}" for i in range(len(order))]
    right = right.where(F.abs(x) < float("inf")).select("*", *[o.alias(n) for o, n in zip(order, names, strict=True)])
    size = right.agg(F.min(x).cast("double").alias("a"), F.max(x).cast("double").alias("b"), F.count("*").alias("n")).first()
    groups = max(1, right.select(*on).distinct().count()) if on else 1
    width = max(width, ((size["b"] or 0.0) - (size["a"] or 0.0)) / max(1, size["n"] // groups // ROWS_PER_BAND))
    asked = left.where("_lo <= _hi").where((F.col("_lo") > float("-inf")) & (F.col("_hi") < float("inf"))).withColumn("_bucket", F.explode(F.sequence(bucket(F.col("_lo"), width), bucket(F.col("_hi"), width))))
    placed = right.withColumn("_bucket", bucket(F.col(x), width))
    fields = {f.name: f.dataType.simpleString() for f in right.schema.fields} | {key: left.schema[key].dataType.simpleString()}
    out = [key, *dict.fromkeys([*kept, *names])]

    def ranks(t: pa.Table) -> np.ndarray:
        keys = []
        for n in names:
            c = t.column(n).combine_chunks()
            if pa.types.is_string(c.type):
                d = c.dictionary_encode()
                c = pc.take(pa.array(np.argsort(np.argsort(np.array([v.encode("utf-8", "surrogatepass") for v in d.dictionary.to_pylist()], object))), pa.int64()), d.indices)
            keys += [pc.is_valid(c).to_numpy(zero_copy_only=False), pc.fill_null(c, 0).to_numpy(zero_copy_only=False)]
        rank = np.empty(len(t), np.int64)
        rank[np.lexsort(keys[::-1])] = np.arange(len(t))
        return rank

    def ends(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        lo, hi = t.column("_lo").to_numpy(), t.column("_hi").to_numpy()
        if "_at" in t.column_names:  # the last places that the predicate, as it is rounded, lets through
            at, reach = t.column("_at").to_numpy(), t.column("_reach").to_numpy()
            for e, away in ((lo := lo.copy(), -np.inf), (hi := hi.copy(), np.inf)):
                while (ok := np.abs(at - e) <= reach).any():
                    e[ok] = np.nextafter(e[ok], away)
                while (bad := ~(np.abs(at - e) <= reach) & (e != at)).any():
                    e[bad] = np.nextafter(e[bad], -away)
        return lo, hi

    def met(q: pa.Table, r: pa.Table) -> pa.Table:
        n = len(r)
        best = np.full(len(q), n, np.int64)
        if n and len(q):
            rank, xs = ranks(r), r.column(x).to_numpy().astype(float)
            by_rank = np.argsort(rank)
            lo, hi = ends(q)
            if y is None:
                strips, first, last = np.zeros(n, np.int64), None, None
            else:
                ys = pc.fill_null(r.column(y), float("nan")).to_numpy().astype(float)
                first, last = (q.column(c).to_numpy().astype(float) for c in ("_from", "_to"))
                high = max(float(np.nanmedian(last - first)) / 4, 1e-9) if len(first) else 1.0
                strips = np.where(np.isnan(ys), np.inf, np.floor(ys / high))
            order_ = np.lexsort((xs, strips))
            for part in np.split(order_, np.flatnonzero(np.diff(strips[order_])) + 1):
                if y is not None and np.isinf(strips[part[0]]):
                    continue
                seg, got = xs[part], rank[part]
                some = np.arange(len(q)) if y is None else np.flatnonzero((first <= (top := ys[part].max())) & (last >= (low := ys[part].min())))
                a, b = np.searchsorted(seg, lo[some], "left"), np.searchsorted(seg, hi[some], "right")
                some, a, b = some[b > a], a[b > a], b[b > a]
                whole = np.ones(len(some), bool) if y is None else (first[some] <= low) & (last[some] >= top)
                table, at, k = [got], 0, 1
                while 2 * k <= len(got):
                    table.append(np.minimum(table[-1][:-k], table[-1][k:]))
                    k *= 2
                level = np.log2(np.maximum(b - a, 1)).astype(np.int64)
                level -= (1 << level) > b - a
                for v in np.unique(level[whole]):
                    w = whole & (level == v)
                    best[some[w]] = np.minimum(best[some[w]], np.minimum(table[v][a[w]], table[v][b[w] - (1 << int(v))]))
                some, a, count = some[~whole], a[~whole], (b - a)[~whole]
                total = np.cumsum(count)
                while at < len(some):
                    end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + PAIRS_AT_ONCE, "right")))
                    c = count[at:end]
                    starts = np.cumsum(c) - c
                    place = np.repeat(a[at:end] - starts, c) + np.arange(c.sum())
                    who, yy = np.repeat(some[at:end], c), ys[part[place]]
                    hit = np.where((yy >= first[who]) & (yy <= last[who]), got[place], n)
                    best[some[at:end]] = np.minimum(best[some[at:end]], np.minimum.reduceat(hit, starts))
                    at = end
        found = np.flatnonzero(best < n)
        rows = r.take(pa.array(by_rank[best[found]])) if len(found) else r.slice(0, 0)
        return pa.table([q.column(key).take(pa.array(found)) if c == key else rows.column(c) for c in out], names=out)

    groups_ = [*on, "_bucket"]
    found = asked.groupBy(*groups_).cogroup(placed.groupBy(*groups_)).applyInArrow(met, ", ".join(f"`{c}` {fields[c]}" for c in out))
    return found.groupBy(key).agg(F.min_by(F.struct(*kept), F.struct(*names)).alias("b")).select(key, "b.*")


#: Inputs whose size is estimated beyond this are solved in buckets of time, of about so many rows; smaller ones in one window a key. Results are the same.
BUCKETS_FROM_BYTES = 256 << 20
ROWS_PER_BUCKET = 500_000


def _estimated_bytes(df: DataFrame) -> int:
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def _around(left: DataFrame, lt: str, right: DataFrame, rt: str, value: Column, on: Sequence[str]) -> DataFrame:
    """``left`` with the right value at or before (``_prev``) and at or after (``_next``) its time, as structs (t, v).

    A key's time is cut into buckets where the inputs are large, so that one key is many tasks' work: each bucket is solved by itself, with two rows more, the last right
    row before it and the first one after it. Those are carried along a table of one row a bucket.
    """
    names = left.columns
    l = left.select(*on, F.col(lt).alias("_t"), F.lit(1).alias("_side"), F.struct(*names).alias("_row"), F.lit(None).cast("void").alias("_r"))
    r = right.select(*on, F.col(rt).alias("_t"), F.lit(0).alias("_side"), F.lit(None).cast(l.schema["_row"].dataType).alias("_row"), F.struct(F.col(rt).alias("t"), value.alias("v")).alias("_r"))
    both = l.withColumn("_r", F.lit(None).cast(r.schema["_r"].dataType)).unionByName(r)
    keys = list(on)
    if _estimated_bytes(both) > BUCKETS_FROM_BYTES:
        both, keys = _in_buckets(both, on), [*on, "_b"]
    back = Window.partitionBy(*keys).orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(*keys).orderBy(F.desc("_t"), "_side").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("_prev", F.last("_r", True).over(back)).withColumn("_next", F.last("_r", True).over(ahead))
    return found.where("_side = 1").select("_row.*", "_prev", "_next")


def _in_buckets(both: DataFrame, on: Sequence[str]) -> DataFrame:
    """The rows with a bucket ``_b``, and for each bucket the right rows next to it on both sides."""
    size = both.agg(F.min("_t").cast("double").alias("a"), F.max("_t").cast("double").alias("b"), F.count("*").alias("n")).first()
    width = ((size["b"] or 0.0) - (size["a"] or 0.0)) / max(1, size["n"] // ROWS_PER_BUCKET) or 1.0
    place = F.floor((F.col("_t").cast("double") - (size["a"] or 0.0)) / width).cast("long")
    rows = both.withColumn("_b", F.coalesce(place, F.lit(-1).cast("long")))  # a null time comes before all
    at = F.when(F.col("_side") == 0, F.col("_t"))
    ends = rows.groupBy(*on, "_b").agg(F.min_by("_r", at).alias("_first"), F.max_by("_r", at).alias("_last"))
    w = Window.partitionBy(*on).orderBy("_b")
    carried = ends.select(
        *on, "_b",
        F.last("_last", True).over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("_before"),
        F.first("_first", True).over(w.rowsBetween(1, Window.unboundedFollowing)).alias("_after"),
    )
    more = carried.select(*on, "_b", F.explode(F.array_compact(F.array("_before", "_after"))).alias("_r"))
    return rows.unionByName(more.select(*on, F.col("_r.t").alias("_t"), F.lit(0).alias("_side"), F.lit(None).cast(both.schema["_row"].dataType).alias("_row"), "_r", "_b"))


def asof_backward(left: DataFrame, lt: str, right: DataFrame, rt: str, value: str, on: Sequence[str] = (), out: str = "match") -> DataFrame:
    """``left`` with the value of the latest right row at or before its time; of equal times the largest value. Null if none."""
    best = right.groupBy(*on, rt).agg(F.max(value).alias(value))
    return _around(left, lt, best, rt, F.col(value), on).withColumn(out, F.col("_prev.v")).drop("_prev", "_next")


def asof_nearest(left: DataFrame, lt: str, right: DataFrame, rt: str, value: str, on: Sequence[str] = (), out: str = "match") -> DataFrame:
    """``left`` with the value of the right row nearest in time; the later one on ties, the largest value of equal times, the ends outside."""
    best = right.groupBy(*on, rt).agg(F.max(value).alias(value))
    near = _around(left, lt, best, rt, F.col(value), on)
    later = F.col("_prev").isNull() | (F.col("_next.t") - F.col(lt) <= F.col(lt) - F.col("_prev.t"))
    return near.withColumn(out, F.when(later & F.col("_next").isNotNull(), F.col("_next.v")).otherwise(F.col("_prev.v"))).drop("_prev", "_next")


def interpolate(left: DataFrame, lx: str, right: DataFrame, rx: str, y: str, on: Sequence[str] = (), boundary: bool = False, out: str = "value") -> DataFrame:
    """``left`` with the right series interpolated linearly at its x. Outside: 0, or the end's value with ``boundary``."""
    near = _around(left, lx, right, rx, F.col(y), on)
    span = F.col("_next.t") - F.col("_prev.t")
    inside = F.when(span > 0, F.col("_prev.v") + (F.col("_next.v") - F.col("_prev.v")) * (F.col(lx) - F.col("_prev.t")) / F.when(span > 0, span)).otherwise(F.col("_prev.v"))
    edge = F.coalesce("_prev.v", "_next.v") if boundary else F.lit(0.0)
    return near.withColumn(out, F.when(F.col("_prev").isNotNull() & F.col("_next").isNotNull(), inside).otherwise(edge)).drop("_prev", "_next")


def overlap_ratio(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """Intersection over union of two intervals; negative, by the gap, where they are apart."""
    return (F.least(e1, e2) - F.greatest(s1, s2)) / F.nullif(F.greatest(e1, e2) - F.least(s1, s2), F.lit(0.0))
