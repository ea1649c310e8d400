"""Points of scans, statistics and similarity."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import calibrate, compare, spectra
from ..sources.tables import POINTS_SQL, SCANS_SQL, points, read, scans
from .registry import query


def _lines(spark, d):
    return read(spark, d, "lineitem").select(F.col("l_orderkey").alias("scan"), (F.col("l_extendedprice") / 100).alias("mz"), F.col("l_quantity").alias("intensity"), "l_linenumber", "l_partkey", "l_suppkey", "l_tax")


@query("""WITH r AS (SELECT l_orderkey AS scan, l_extendedprice / 100 AS mz, l_quantity AS intensity, l_linenumber, l_partkey,
CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_extendedprice / 100, l_linenumber, l_partkey, l_suppkey, l_tax) AS INTEGER) AS rank FROM lineitem)
SELECT scan, round(mz, 6) AS mz, intensity, rank FROM r WHERE rank <= 2""")
def topk_per_scan(spark, d):
    top = spectra.top_k(_lines(spark, d), ["scan"], 2, ["mz", "l_linenumber", "l_partkey", "l_suppkey", "l_tax"])
    return top.select("scan", F.round("mz", 6).alias("mz"), "intensity", "rank")


@query(f"""WITH {SCANS_SQL}, {POINTS_SQL} SELECT s.run, CAST(floor(p.mz * 2) AS BIGINT) AS bucket, round(arg_min(p.mz, (-p.intensity, p.mz)), 6) AS mz, max(p.intensity) AS intensity
FROM points p JOIN scans s ON s.scan = p.scan GROUP BY ALL""")
def decimate_max_per_bucket(spark, d):
    return spectra.decimate(points(spark, d).join(scans(spark, d).select("run", "scan"), "scan"), ["run"], 2.0).withColumn("mz", F.round("mz", 6))


@query(f"""WITH {POINTS_SQL} SELECT scan, count(*) AS n, round(min(mz), 6) AS lo, round(max(mz), 6) AS hi, round(CASE WHEN count(*) > 1 THEN (max(mz) - min(mz)) / (count(*) - 1) END, 9) AS step,
round(avg(intensity), 9) AS mean, round(stddev_pop(intensity), 9) AS spread, list_sort(list(intensity))[CAST(floor(count(*) / 2) AS BIGINT) + 1] AS median FROM points GROUP BY scan""")
def stats_upper_median(spark, d):
    return spectra.statistics(points(spark, d), ["scan"]).withColumns({c: F.round(c, 6 if c in ("lo", "hi") else 9) for c in ("lo", "hi", "step", "mean", "spread")})


@query(f"""WITH {SCANS_SQL}, {POINTS_SQL}, r AS (SELECT s.run, s.level, p.intensity, row_number() OVER (PARTITION BY s.run, s.level ORDER BY p.intensity) AS r, count(*) OVER (PARTITION BY s.run, s.level) AS n FROM points p JOIN scans s ON s.scan = p.scan)
SELECT run, level, round(list_sort(list(intensity))[CAST(floor(count(*) / 2) AS BIGINT) + 1] + 3 * stddev_pop(intensity), 6) AS floor FROM r WHERE r <= ceil(n * 0.8) GROUP BY run, level""")
def noise_floor(spark, d):
    return spectra.noise_floor(points(spark, d).join(scans(spark, d), "scan"), ["run", "level"]).withColumn("floor", F.round("floor", 6))


@query(f"""WITH {POINTS_SQL} SELECT scan, round(coalesce(sum(intensity) FILTER (mz BETWEEN 100 AND 400), 0), 6) AS closed, round(coalesce(sum(intensity) FILTER (mz > 100 AND mz < 400), 0), 6) AS opened,
greatest(coalesce(max(intensity) FILTER (mz BETWEEN 100 AND 400), 0), 0) AS most FROM points GROUP BY scan""")
def range_aggregates(spark, d):
    p = F.col("points")
    a, b = F.lit(100.0), F.lit(400.0)
    return spectra.as_arrays(points(spark, d)).select("scan", F.round(spectra.sum_in_range(p, a, b), 6).alias("closed"), F.round(spectra.sum_in_range(p, a, b, False), 6).alias("opened"), spectra.max_in_range(p, a, b).alias("most"))


@query(f"""WITH {POINTS_SQL}, r AS (SELECT scan, mz, CAST(row_number() OVER (PARTITION BY scan ORDER BY mz, intensity) - 1 AS INTEGER) AS i FROM points) SELECT scan, arg_min(i, (abs(mz - 300.0), i)) AS i FROM r GROUP BY scan""")
def closest_point(spark, d):
    return spectra.as_arrays(points(spark, d)).select("scan", spectra.closest_index(F.col("points"), F.lit(300.0)).alias("i"))


@query(f"WITH {POINTS_SQL} SELECT scan, round(sum(mz * 2 + 1), 4) AS x, round(sum(intensity * 0.5), 4) AS y FROM points GROUP BY scan")
def scale_translate(spark, d):
    p = F.explode(spectra.scaled(F.col("points"), 2.0, 0.5, 1.0)).alias("p")
    return spectra.as_arrays(points(spark, d)).select("scan", p).groupBy("scan").agg(F.round(F.sum("p.x"), 4).alias("x"), F.round(F.sum("p.y"), 4).alias("y"))


MASKED = [(120.0,), (300.0,), (301.0,), (450.5,)]


@query(f"""WITH {SCANS_SQL}, {POINTS_SQL}, b AS (SELECT s.run, CAST(floor(p.mz) AS BIGINT) AS bin, sum(p.intensity) AS y FROM points p JOIN scans s USING (scan) GROUP BY ALL),
z AS (SELECT b.*, CASE WHEN EXISTS (SELECT 1 FROM (VALUES (120.0), (300.0), (301.0), (450.5)) l(x) WHERE abs(b.bin - l.x) <= 3) THEN NULL ELSE y END AS free FROM b)
SELECT run, bin, round(coalesce(last_value(free IGNORE NULLS) OVER (PARTITION BY run ORDER BY bin ROWS UNBOUNDED PRECEDING), 0), 6) AS y FROM z""")
def stop_list_mask(spark, d):
    b = points(spark, d).join(scans(spark, d), "scan").groupBy("run", F.floor("mz").cast("long").alias("bin")).agg(F.sum("intensity").alias("y")).withColumn("x", F.col("bin").cast("double"))
    return spectra.masked(b, ["run"], spark.createDataFrame(MASKED, "x double"), 3.0).select("run", "bin", F.round("y", 6).alias("y"))


def _pair_sql(f: str) -> str:
    return f"""WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)
SELECT a.vec_id AS a, b.vec_id AS b, round({f}, 5) AS s FROM e a JOIN e b ON a.vec_id % 20 = 0 AND b.vec_id <> a.vec_id"""


def _pairs(spark, d, f):
    # The queries are a stated set, every twentieth vector; each meets all others.
    e = read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return spectra.against_all(e.where("id % 20 = 0"), e, prepared=f, digits=5)


@query(_pair_sql("list_cosine_similarity(a.v, b.v)"))
def pairwise_cosine(spark, d):
    return _pairs(spark, d, spectra.unit_rows)


@query(_pair_sql("(list_dot_product(a.v, b.v) - list_sum(a.v) * list_sum(b.v) / len(a.v)) / sqrt((list_dot_product(a.v, a.v) - list_sum(a.v) * list_sum(a.v) / len(a.v)) * (list_dot_product(b.v, b.v) - list_sum(b.v) * list_sum(b.v) / len(b.v)))"))
def pairwise_pearson(spark, d):
    return _pairs(spark, d, spectra.centred_unit_rows)


LOCKS = [(150.0,), (333.3,), (512.25,)]
_LOCK = """m(mass) AS (VALUES (150.0::DOUBLE), (333.3::DOUBLE), (512.25::DOUBLE)), g AS (SELECT DISTINCT scan, mass FROM points CROSS JOIN m)"""


@query(f"""WITH {POINTS_SQL}, {_LOCK}
SELECT g.scan, g.mass, round(arg_min(p.mz, (-p.intensity, p.mz)), 6) AS mz, max(p.intensity) AS intensity, round(arg_min(p.mz, (-p.intensity, p.mz)) - g.mass, 6) AS error
FROM g LEFT JOIN points p ON p.scan = g.scan AND p.mz BETWEEN g.mass * (1 - 20000 / 1e6) AND g.mass * (1 + 20000 / 1e6) GROUP BY g.scan, g.mass""")
def lockmass_points(spark, d):
    out = calibrate.lockmass_points(points(spark, d), spark.createDataFrame(LOCKS, "mass double"), 20000.0)
    return out.withColumns({"mz": F.round("mz", 6), "error": F.round("error", 6)})


COEFFICIENTS = [(r, t, 0.01 * (t / 100), 1e-5, 1e-9 * r) for r in range(1992, 1999) for t in (50.0, 150.0, 300.0)]


@query(f"""WITH {SCANS_SQL}, {POINTS_SQL}, c(run, t, c0, c1, c2) AS (VALUES {", ".join(f"({r}, {t}::DOUBLE, {a!r}::DOUBLE, {b!r}::DOUBLE, {c!r}::DOUBLE)" for r, t, a, b, c in COEFFICIENTS)}),
q AS (SELECT s.run, s.scan, s.rt AS t, p.mz, p.intensity FROM points p JOIN scans s USING (scan)),
a AS (SELECT q.*, c.t AS ta, c.c0 AS a0, c.c1 AS a1, c.c2 AS a2 FROM q ASOF LEFT JOIN c ON q.run = c.run AND q.t >= c.t),
b AS (SELECT a.*, c.t AS tb, c.c0 AS b0, c.c1 AS b1, c.c2 AS b2 FROM a ASOF LEFT JOIN c ON a.run = c.run AND a.t <= c.t),
w AS (SELECT *, CASE WHEN tb > ta THEN (t - ta) / (tb - ta) ELSE 0 END AS f FROM b)
SELECT run, scan, count(*) AS n, round(sum(mz - (coalesce(a0, b0) + (coalesce(b0, a0) - coalesce(a0, b0)) * f + (coalesce(a1, b1) + (coalesce(b1, a1) - coalesce(a1, b1)) * f) * mz + (coalesce(a2, b2) + (coalesce(b2, a2) - coalesce(a2, b2)) * f) * mz * mz)), 4) AS mz FROM w GROUP BY run, scan""")
def calibrate_poly(spark, d):
    p = points(spark, d).join(scans(spark, d).select("run", "scan", F.col("rt").alias("t")), "scan")
    out = calibrate.calibrate(p, spark.createDataFrame(COEFFICIENTS, "run int, t double, c0 double, c1 double, c2 double"), ["run"])
    return out.groupBy("run", "scan").agg(F.count("*").alias("n"), F.round(F.sum("mz"), 4).alias("mz"))


def _shifted(values: str) -> str:
    """Five values around place i, from 0; at the ends the window is shifted inward."""
    first = f"greatest(0, least(i - 2, len({values}) - 5))"
    return f"{values}[{first} + 1:{first} + 5]"


@query(f"""WITH {SCANS_SQL}, {POINTS_SQL}, q AS (SELECT s.run, s.rt AS t, p.mz, p.intensity FROM points p JOIN scans s USING (scan)), n AS (SELECT run, count(DISTINCT t) AS n FROM q GROUP BY run),
h AS (SELECT run, t, arg_min(mz, (-intensity, mz)) - 300 AS y FROM q WHERE abs(mz - 300) <= 90 GROUP BY run, t), g AS (SELECT run, count(*) AS h FROM h GROUP BY run),
l AS (SELECT run, list(t ORDER BY t) AS ts, list(y ORDER BY t) AS ys FROM h JOIN g USING (run) JOIN n USING (run) WHERE g.h > 0.5 * n.n AND g.h > 5 GROUP BY run),
m AS (SELECT run, ts, list_transform(range(len(ys)), lambda i: list_sort({_shifted("ys")})[CAST(floor(least(5, len(ys)) / 2) AS BIGINT) + 1]) AS ms FROM l),
v AS (SELECT run, ts, list_transform(range(len(ms)), lambda i: list_avg({_shifted("ms")})) AS cs FROM m)
SELECT run, unnest(ts) AS t, round(unnest(cs), 6) AS c0 FROM v""")
def calibration_fit(spark, d):
    p = points(spark, d).join(scans(spark, d).select("run", F.col("rt").alias("t"), "scan"), "scan")
    return calibrate.fit(p, 300.0, 300000.0, ["run"], share=0.5).withColumn("c0", F.round("c0", 6))


def _runs(spark, d):
    # Two runs keyed by customer: the orders of two halves of the statuses.
    o = read(spark, d, "orders")
    return o.where("o_orderstatus = 'O'").select(F.col("o_custkey").alias("k")).distinct(), o.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("k")).distinct()


_RUNS = "a AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'O'), b AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'F')"


@query(f"WITH {_RUNS} SELECT k FROM a INTERSECT SELECT k FROM b")
def run_compare_both(spark, d):
    return compare.both(*_runs(spark, d), "k")


@query(f"WITH {_RUNS} SELECT k FROM a EXCEPT SELECT k FROM b")
def run_compare_left(spark, d):
    return compare.only(*_runs(spark, d), "k")


@query(f"WITH {_RUNS} SELECT k FROM b EXCEPT SELECT k FROM a")
def run_compare_right(spark, d):
    a, b = _runs(spark, d)
    return compare.only(b, a, "k")


_PROFILE = f"{SCANS_SQL}, {POINTS_SQL}, f AS (SELECT s.run, floor(p.mz) AS x, sum(p.intensity) AS y FROM points p JOIN scans s USING (scan) WHERE s.level = 1 GROUP BY ALL), g AS (SELECT s.run, floor(p.mz / 3) * 3 AS x, sum(p.intensity) / 3 AS y FROM points p JOIN scans s USING (scan) WHERE s.level = 2 GROUP BY ALL)"


@query(f"""WITH {_PROFILE}, e AS (SELECT run, min(x) AS lo, max(x) AS hi FROM g GROUP BY run),
p AS (SELECT f.*, g.x AS xa, g.y AS ya FROM f ASOF LEFT JOIN g ON f.run = g.run AND f.x >= g.x),
n AS (SELECT p.*, g.x AS xb, g.y AS yb FROM p ASOF LEFT JOIN g ON p.run = g.run AND p.x <= g.x),
v AS (SELECT n.run, n.x, n.y, e.lo IS NULL OR NOT (x BETWEEN lo AND hi) AS out, CASE WHEN xb > xa THEN ya + (yb - ya) * (x - xa) / (xb - xa) ELSE coalesce(ya, yb) END AS other FROM n LEFT JOIN e ON e.run = n.run)
SELECT run, x, round(y, 6) AS y, round(CASE WHEN NOT out THEN other END, 6) AS other FROM v WHERE out OR abs(y - other) > 0.1 * abs(y)""")
def profile_difference(spark, d):
    p = points(spark, d).join(scans(spark, d), "scan")
    f = p.where("level = 1").groupBy("run", F.floor("mz").cast("double").alias("x")).agg(F.sum("intensity").alias("y"))
    g = p.where("level = 2").groupBy("run", (F.floor(F.col("mz") / 3) * 3).cast("double").alias("x")).agg((F.sum("intensity") / 3).alias("y"))
    return compare.profile_difference(f, g, ["run"], "x", "y").withColumns({"y": F.round("y", 6), "other": F.round("other", 6)})
