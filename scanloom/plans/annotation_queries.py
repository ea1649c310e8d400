"""Annotations, lists of points, tables with keys and admissions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.averagine import with_fractions
from ..operators import calibrate, chrom, compare, features, isotopes, rows, spectra, tiles
from ..sources.tables import POINTS_SQL, SCANS_SQL, points, read, scans
from .chrom_queries import _CELLS, _cells, _rounded
from .registry import query
from .report_queries import _FEATURES, _features
from .spectra_queries import _LOCK, LOCKS

_ARRAYS = "p AS (SELECT scan, list_sort(list({'x': mz, 'y': intensity})) AS points FROM points GROUP BY scan)"


def _point_arrays(spark, d):
    return spectra.as_arrays(points(spark, d))


@query("SELECT o_orderkey AS scan, CASE WHEN o_orderstatus = 'O' THEN '' ELSE o_orderpriority END AS fragmentation FROM orders")
def fragmentation_type(spark, d):
    s = scans(spark, d).join(read(spark, d, "orders").select(F.col("o_orderkey").alias("scan"), F.col("o_orderpriority").alias("kind")), "scan")
    return s.select("scan", F.when(F.col("level") < 2, "").otherwise(F.col("kind")).alias("fragmentation"))


@query(f"WITH {SCANS_SQL} SELECT run, scan, rt FROM scans WHERE level = 1")
def scans_at_level(spark, d):
    return scans(spark, d).where("level = 1").select("run", "scan", "rt")


@query(f"WITH {POINTS_SQL} SELECT scan, CAST(CASE WHEN max(mz) < 300 THEN -2 ELSE count(*) FILTER (mz <= 300) - 1 END AS INTEGER) AS i FROM points GROUP BY scan")
def index_at_or_below(spark, d):
    return _point_arrays(spark, d).select("scan", spectra.index_at_or_below(F.col("points"), F.lit(300.0)).alias("i"))


@query(f"WITH {POINTS_SQL} SELECT scan, round(mz, 6) AS mz, intensity - 25 AS intensity FROM points WHERE intensity - 25 > 1e-20")
def positive_points(spark, d):
    return spectra.positive(points(spark, d).withColumn("intensity", F.col("intensity") - 25)).withColumn("mz", F.round("mz", 6))


@query(f"""WITH {POINTS_SQL}, r AS (SELECT scan, mz, intensity, row_number() OVER (PARTITION BY scan ORDER BY mz, intensity) AS i, count(*) FILTER (mz <= 100) OVER (PARTITION BY scan) AS a, count(*) FILTER (mz <= 400) OVER (PARTITION BY scan) AS b FROM points)
SELECT scan, round(coalesce(sum(intensity) FILTER (i BETWEEN greatest(a, 1) AND b), 0), 6) AS y FROM r GROUP BY scan""")
def sum_by_index(spark, d):
    return _point_arrays(spark, d).select("scan", F.round(spectra.sum_by_index(F.col("points"), F.lit(100.0), F.lit(400.0)), 6).alias("y"))


@query(f"""WITH RECURSIVE {POINTS_SQL}, r AS (SELECT scan, mz AS x, intensity AS y, row_number() OVER (PARTITION BY scan ORDER BY intensity DESC, mz) AS k FROM points),
m(scan, k, x, y, kept, took) AS (SELECT scan, 0, NULL::DOUBLE, NULL::DOUBLE, []::DOUBLE[], false FROM r WHERE k = 1 UNION ALL
SELECT r.scan, r.k, r.x, r.y, CASE WHEN ok THEN list_append(m.kept, r.x) ELSE m.kept END, ok FROM m JOIN r ON r.scan = m.scan AND r.k = m.k + 1, LATERAL (SELECT len(m.kept) < 3 AND coalesce(list_min(list_transform(m.kept, lambda q: abs(q - r.x))), 1e9) >= 60 AS ok) o)
SELECT scan, round(x, 6) AS mz, y AS intensity FROM m WHERE took""")
def spaced_top_k(spark, d):
    top = F.explode(spectra.spaced_top_k(F.col("points"), 3, 60.0)).alias("p")
    return _point_arrays(spark, d).select("scan", top).select("scan", F.round("p.x", 6).alias("mz"), F.col("p.y").alias("intensity"))


@query(f"""WITH {SCANS_SQL}, {POINTS_SQL}, b AS (SELECT s.run, s.level, CAST(floor(p.mz) AS BIGINT) AS x, sum(p.intensity) AS y FROM points p JOIN scans s USING (scan) GROUP BY ALL)
SELECT run, round(coalesce(sum(a.y * c.y), 0) / nullif(sqrt(sum(a.y * a.y)) * sqrt(sum(c.y * c.y)), 0), 6) AS s FROM (SELECT * FROM b WHERE level = 1) a FULL JOIN (SELECT * FROM b WHERE level = 2) c USING (run, x) GROUP BY run""")
def aligned_cosine(spark, d):
    b = points(spark, d).join(scans(spark, d), "scan").groupBy("run", "level", F.floor("mz").cast("long").alias("x")).agg(F.sum("intensity").alias("y"))
    out = compare.aligned_cosine(b.where("level = 1"), b.where("level = 2"), ["run"], "x", "y")
    return out.withColumn("s", F.round("s", 6))


def _levels(spark, d):
    b = points(spark, d).join(scans(spark, d), "scan").groupBy("run", "level", (F.floor(F.col("mz") / 7) * 7).cast("double").alias("x")).agg(F.sum("intensity").alias("y"))
    return b.where("level = 1").select("run", "x", "y"), b.where("level = 2").select("run", (F.col("x") + F.when(F.col("x") % 3 == 0, 0.05).otherwise(0.2)).alias("x"), "y")


_LEVELS = f"""{SCANS_SQL}, {POINTS_SQL}, b AS (SELECT s.run, s.level, floor(p.mz / 7) * 7 AS x, sum(p.intensity) AS y FROM points p JOIN scans s USING (scan) GROUP BY ALL),
l AS (SELECT run, x, y FROM b WHERE level = 1), r AS (SELECT run, x + CASE WHEN x % 3 = 0 THEN 0.05::DOUBLE ELSE 0.2::DOUBLE END AS x, y FROM b WHERE level = 2)"""


@query(f"""WITH {_LEVELS}, a AS (SELECT *, CAST(row_number() OVER (PARTITION BY run ORDER BY x) AS INTEGER) AS i FROM l), c AS (SELECT *, CAST(row_number() OVER (PARTITION BY run ORDER BY x) AS INTEGER) AS i FROM r)
SELECT run, i, a.x AS xa, round(a.y, 6) AS ya, c.x AS xb, round(c.y, 6) AS yb FROM a FULL JOIN c USING (run, i) WHERE a.x IS NULL OR c.x IS NULL OR abs(a.x - c.x) > 0.1 OR abs(a.y - c.y) > 0.1 * abs(a.y)""")
def centroids_by_index(spark, d):
    return compare.difference_by_index(*_levels(spark, d), ["run"], "x", "y").withColumns({"ya": F.round("ya", 6), "yb": F.round("yb", 6)})


@query(f"WITH {_LEVELS} SELECT run, x, round(y, 6) AS y FROM l WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.run = l.run AND abs(r.x - l.x) <= 0.1)")
def centroids_by_coordinate(spark, d):
    return _rounded(compare.only_by_coordinate(*_levels(spark, d), ["run"], "x"), "y")


@query(f"""WITH {POINTS_SQL}, {_LOCK}, h AS (SELECT p.scan, m.mass, p.mz, p.intensity, row_number() OVER (PARTITION BY p.scan, m.mass ORDER BY abs(p.mz - m.mass), p.mz, -p.intensity) AS k
FROM points p JOIN m ON p.mz BETWEEN m.mass * (1 - 20000 / 1e6) AND m.mass * (1 + 20000 / 1e6)) SELECT scan, mass, round(mz, 6) AS mz, intensity FROM h WHERE k = 1""")
def nearest_isotope(spark, d):
    return spectra.nearest_within(points(spark, d), spark.createDataFrame(LOCKS, "mass double"), 20000.0).withColumn("mz", F.round("mz", 6))


@query(f"""WITH {POINTS_SQL}, a AS (SELECT scan, list(intensity ORDER BY mz, intensity) AS v FROM points GROUP BY scan)
SELECT a.scan, coalesce(len(a.v) = len(b.v) AND list_max(list_transform(list_zip(a.v, b.v), lambda z: abs(z[1] - z[2]))) <= 20, false) AS same FROM a JOIN a b ON b.scan = a.scan + 1""")
def alike_series(spark, d):
    a = _point_arrays(spark, d).select("scan", F.transform("points", lambda p: p["y"]).alias("v"))
    b = a.select((F.col("scan") - 1).alias("scan"), F.col("v").alias("w"))
    return a.join(b, "scan").select("scan", spectra.alike(F.col("v"), F.col("w"), 20.0).alias("same"))


@query(f"""WITH {SCANS_SQL}, {POINTS_SQL}, r AS (SELECT s.run, p.intensity, row_number() OVER (PARTITION BY s.run ORDER BY p.intensity) AS k, count(*) OVER (PARTITION BY s.run) AS n FROM points p JOIN scans s USING (scan))
SELECT run, intensity AS value FROM r WHERE k = floor(n * 0.9) + 1""")
def noise_percentile(spark, d):
    return spectra.nth_element(points(spark, d).join(scans(spark, d), "scan"), ["run"], 0.9)


@query(f"""WITH {SCANS_SQL}, {POINTS_SQL} SELECT p.scan, s.run, s.rt, round(p.mz, 6) AS mz, p.intensity FROM points p JOIN scans s ON s.scan = p.scan WHERE s.level = 1""")
def peaks_of_spectra(spark, d):
    p, s = points(spark, d), scans(spark, d).where("level = 1")
    return p.join(s, "scan").select("scan", "run", "rt", F.round("mz", 6).alias("mz"), "intensity")


@query(f"""WITH {SCANS_SQL}, {POINTS_SQL} SELECT p.scan, s.run, round(p.mz, 6) AS mz, p.intensity FROM points p LEFT JOIN (SELECT * FROM scans WHERE level = 1) s ON s.scan = p.scan""")
def peaks_with_or_without_spectra(spark, d):
    return points(spark, d).join(scans(spark, d).where("level = 1"), "scan", "left").select("scan", "run", F.round("mz", 6).alias("mz"), "intensity")


@query("""SELECT l_orderkey, l_linenumber, l_partkey, o_custkey, c_mktsegment FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey""")
def search_results(spark, d):
    hits, queries_, summary = read(spark, d, "lineitem"), read(spark, d, "orders"), read(spark, d, "customer")
    out = hits.join(queries_, F.col("l_orderkey") == F.col("o_orderkey")).join(summary, F.col("o_custkey") == F.col("c_custkey"))
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "o_custkey", "c_mktsegment")


@query(f"WITH {SCANS_SQL} SELECT s.scan, s.run, s.rt * 1440 AS minutes, l.l_discount AS score FROM scans s JOIN lineitem l ON l.l_orderkey = s.scan WHERE l.l_discount < 0.005")
def annotations_by_score(spark, d):
    processed = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("scan"), F.col("l_discount").alias("score")).where("score < 0.005")
    return scans(spark, d).join(processed, "scan").select("scan", "run", (F.col("rt") * 1440).alias("minutes"), "score")


@query("SELECT l_orderkey, p_partkey, p_name AS sequence, round(l_extendedprice / 100 - 0.5, 6) AS mz_start, round(l_extendedprice / 100 + 0.5, 6) AS mz_end, s_name AS sample FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey")
def peptide_windows(spark, d):
    lines = read(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", (F.col("l_extendedprice") / 100).alias("mz"))
    out = lines.join(read(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey")).join(read(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    return out.select("l_orderkey", "p_partkey", F.col("p_name").alias("sequence"), F.round(F.col("mz") - 0.5, 6).alias("mz_start"), F.round(F.col("mz") + 0.5, 6).alias("mz_end"), F.col("s_name").alias("sample"))


_WIDE = f"{_FEATURES}, w AS (SELECT id AS feature, mass, apex - intensity / 100 AS start, apex + intensity / 100 AS stop, CAST(id % 5 + 1 AS VARCHAR) AS charges FROM f)"


def _wide(spark, d):
    apart = F.col("intensity") / 100
    return _features(spark, d).select(F.col("id").alias("feature"), "mass", (F.col("apex") - apart).alias("start"), (F.col("apex") + apart).alias("end"), (F.col("id") % 5 + 1).cast("string").alias("charges"))


@query(f"WITH {_WIDE} SELECT feature, mass FROM w WHERE mass > 100 AND mass <= 600 AND stop - start >= 0.9")
def features_admitted(spark, d):
    return features.admitted(_wide(spark, d), 100.0, 600.0, 0.9).select("feature", "mass")


@query(f"WITH {_FEATURES} SELECT id, mass FROM f WHERE intensity / 200 > 0.4 AND mass >= 300")
def clusters_admitted(spark, d):
    c = _features(spark, d).withColumn("correlation", F.col("intensity") / 200)
    return features.clusters_admitted(c, 0.4, 300.0).select("id", "mass")


@query(f"""WITH {_WIDE}, q AS (SELECT p_partkey * 3 AS feature, min(p_name) AS sequence FROM part GROUP BY 1)
SELECT w.feature, coalesce(q.sequence, 'UNKNOWN_' || w.feature) AS "Sequence", mass AS "UnchargedMass", start AS "StartTime", stop AS "EndTime", charges AS "ChargeList" FROM w LEFT JOIN q USING (feature)""")
def peptide_list(spark, d):
    known = read(spark, d, "part").select((F.col("p_partkey") * 3).alias("feature"), F.col("p_name").alias("sequence"))
    return features.peptide_list(_wide(spark, d), known)


@query(f"""WITH {SCANS_SQL}, {POINTS_SQL}, b AS (SELECT CAST(s.run AS INTEGER) AS function, p.scan, count(*) AS n, arg_min(p.mz, (-p.intensity, p.mz)) AS mz FROM points p JOIN scans s USING (scan) GROUP BY ALL),
k AS (SELECT function, CAST(trunc(mz * 0.001) AS BIGINT) AS bucket, count(*) AS c FROM b WHERE n >= 4 GROUP BY ALL), t AS (SELECT function, sum(c) AS n, max(c) AS most, arg_min(bucket, (-c, bucket)) AS bucket FROM k GROUP BY function)
SELECT function, bucket / 0.001 AS mz FROM t WHERE n >= 10 AND most > 0.6 * n""")
def calibration_functions(spark, d):
    top = F.max_by("mz", F.struct("intensity", -F.col("mz")))
    b = points(spark, d).join(scans(spark, d), "scan").groupBy(F.col("run").alias("function"), "scan").agg(F.count("*").alias("n"), top.alias("mz"))
    return calibrate.calibration_functions(b, 0.001)


@query(f"""WITH {_CELLS}, t AS (SELECT bx, bt, round(v, 6) AS v FROM c WHERE bt = 3) SELECT * FROM t""")
def raster_slice(spark, d):
    return _rounded(tiles.slice_of(_cells(spark, d), "bt", 3), "v")


@query(f"""WITH {_CELLS}, g AS (SELECT bx, sum(v) AS y FROM c GROUP BY bx), o AS (SELECT bx + 1 AS bx, sum(v) AS y FROM c WHERE bt < 20 GROUP BY 1)
SELECT bx AS bin, round(coalesce(g.y, 0) - coalesce(o.y, 0), 6) AS y FROM g FULL JOIN o USING (bx)""")
def grid_difference(spark, d):
    c = _cells(spark, d)
    g, o = c.groupBy(F.col("bx").alias("bin")).agg(F.sum("v").alias("y")), c.where("bt < 20").groupBy((F.col("bx") + 1).alias("bin")).agg(F.sum("v").alias("y"))
    return _rounded(tiles.accumulated(g, o, [], -1.0), "y")


@query("""SELECT p_partkey, CAST(floor(log2(greatest(1, p_retailprice / (p_size * 4)))) AS INTEGER) AS level FROM part""")
def zoom_level(spark, d):
    return read(spark, d, "part").select("p_partkey", tiles.zoom_level(F.col("p_retailprice"), F.col("p_size") * 4).alias("level"))


@query("SELECT o_custkey, arg_min(o_orderkey, o_orderkey) AS o_orderkey, arg_min(o_orderstatus, o_orderkey) AS o_orderstatus FROM orders GROUP BY o_custkey")
def first_row_per_group(spark, d):
    return rows.first_row_per_group(read(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderstatus"), ["o_custkey"], ["o_orderkey"])


@query(f"""WITH {SCANS_SQL}, {POINTS_SQL} SELECT CAST(floor(p.mz / 30) AS INTEGER) AS tile_x, count(*) AS parts, min(p.scan) AS first, max(p.scan) AS last, count(DISTINCT p.scan) AS scans FROM points p GROUP BY 1""")
def tile_counts(spark, d):
    by = points(spark, d).groupBy(F.floor(F.col("mz") / 30).cast("int").alias("tile_x"))
    return by.agg(F.count("*").alias("parts"), F.min("scan").alias("first"), F.max("scan").alias("last"), F.count_distinct("scan").alias("scans"))


@query("SELECT n_nationkey AS k, 'new ' || n_name AS v FROM nation WHERE n_nationkey % 3 = 0 UNION ALL SELECT n_nationkey, n_name FROM nation WHERE n_nationkey % 3 <> 0 UNION ALL SELECT 1000 + r_regionkey, r_name FROM region")
def upsert(spark, d):
    n = read(spark, d, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("v"))
    new = rows.appended(n.where("k % 3 = 0").withColumn("v", F.concat(F.lit("new "), F.col("v"))), read(spark, d, "region").select((F.col("r_regionkey") + 1000).alias("k"), F.col("r_name").alias("v")))
    return rows.replaced(n, new, ["k"])


@query(f"""WITH {SCANS_SQL}, {POINTS_SQL}, q AS (SELECT s.run, p.mz, p.scan, p.mz - lag(p.mz) OVER (PARTITION BY s.run ORDER BY p.mz, p.scan, p.intensity) AS gap FROM points p JOIN scans s USING (scan))
SELECT run, count(*) AS n, round(sum(mz), 1) AS mz FROM q WHERE gap IS NULL OR gap > 0.01 GROUP BY run""")
def near_distinct(spark, d):
    p = points(spark, d).join(scans(spark, d).select("run", "scan"), "scan")
    return rows.without_near_duplicates(p, ["run"], "mz", ["scan", "intensity"], 0.01).groupBy("run").agg(F.count("*").alias("n"), F.round(F.sum("mz"), 1).alias("mz"))


@query("SELECT c_name, '' AS comment, c_mktsegment, 'x' AS mark FROM customer WHERE c_mktsegment = 'BUILDING' AND c_nationkey = 3")
def rows_by_example(spark, d):
    some = rows.matching(read(spark, d, "customer"), {"c_mktsegment": "BUILDING", "c_nationkey": 3})
    return rows.with_literals(rows.with_columns_once(rows.columns_by_header(some, ["c_name", "comment", "c_mktsegment"]), {"mark": ""}), {"mark": "x"})


@query("SELECT r_name, n_name, c_custkey FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey WHERE c_mktsegment = 'MACHINERY' ORDER BY r_name, n_name, c_custkey LIMIT 1")
def first_in_tree(spark, d):
    from .report_queries import _tree

    return rows.first_in_order(_tree(spark, d), ["r_name", "n_name", "c_custkey"], {"c_mktsegment": "MACHINERY"}).select("r_name", "n_name", "c_custkey")


@query()
def averagine(spark, d):
    """The first six isotope fractions of every part's price, as a mass; tested by closed forms."""
    parts = with_fractions(read(spark, d, "part").select("p_partkey", "p_retailprice"), F.col("p_retailprice"), 6)
    return parts.select("p_partkey", F.transform("fractions", lambda x: F.round(x, 9)).alias("fractions"))


@query()
def isotope_overlaps(spark, d):
    """Envelopes of the points of each day of a run."""
    p = points(spark, d).join(scans(spark, d), "scan").groupBy("run", F.col("rt").cast("int").alias("scan"), F.round("mz", 2).alias("mz")).agg(F.sum("intensity").alias("intensity"))
    return isotopes.isotope_overlaps(p, tolerance=0.15, charges=4, isotopes=6, least_gain=1e-3)


@query()
def random_scans(spark, d):
    """A sample of scans with replacement: the sampling is the feature."""
    return chrom.random_scans(scans(spark, d), 0.01)
