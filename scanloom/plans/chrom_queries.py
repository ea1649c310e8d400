"""Chromatograms, as-of lookups and tiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import chrom, joins, tiles, warp2d, workflow
from ..operators import hills as hills_of
from ..operators.greedy import ranked
from ..sources.tables import POINTS_SQL, SCANS_SQL, points, read, scans
from ..storage import stored
from .registry import query

#: (window_id, mz_start, mz_end, time_start, time_end); null is unbounded. One is empty, one reversed, one has equal ends.
WINDOWS = [
    (1, 10.0, 60.0, 0.0, 30.0), (2, 100.0, 130.0, 50.0, 90.0), (3, 500.0, 500.5, 100.0, 140.0), (4, None, None, 10.0, 12.0), (5, 200.0, None, 20.0, 25.0),
    (6, 300.0, 290.0, 0.0, 20.0), (7, 150.0, 160.0, 400.0, 500.0), (8, 50.0, 900.0, None, 3.0), (9, 90.0, 95.0, 364.0, None), (10, 333.33, 333.33, 0.0, 366.0),
]
BOUNDED = [(i, a, b, c, d) for i, a, b, c, d in WINDOWS if None not in (a, b, c, d) and a <= b]
SCHEMA = "window_id int, mz_start double, mz_end double, time_start double, time_end double"


def _values(rows) -> str:
    return ", ".join("(" + ", ".join("CAST(NULL AS DOUBLE)" if x is None else str(x) if isinstance(x, int) else f"CAST({x} AS DOUBLE)" for x in r) + ")" for r in rows)


def _windows_sql(rows) -> str:
    return f"windows(window_id, mz_start, mz_end, time_start, time_end) AS (VALUES {_values(rows)})"


def _trace_sql(agg: str) -> str:
    return f"""WITH {SCANS_SQL}, {POINTS_SQL}
SELECT s.run, s.scan, s.rt, round(coalesce({agg}(p.intensity), 0), 6) AS intensity
FROM scans s LEFT JOIN points p ON p.scan = s.scan WHERE s.level = 1 GROUP BY s.run, s.scan, s.rt"""


def _rounded(df, c="intensity"):
    return df.withColumn(c, F.round(c, 6))


@query(_trace_sql("sum"))
def tic(spark, d):
    return _rounded(chrom.tic(scans(spark, d), points(spark, d)))


@query(_trace_sql("max"))
def bpc(spark, d):
    return _rounded(chrom.bpc(scans(spark, d), points(spark, d)))


def _xic_sql(rows) -> str:
    return f"""WITH {SCANS_SQL}, {POINTS_SQL}, {_windows_sql(rows)}
SELECT w.window_id, s.run, s.scan, s.rt, round(coalesce(sum(p.intensity), 0), 6) AS intensity
FROM windows w JOIN scans s ON s.level = 1 AND s.rt >= coalesce(w.time_start, s.rt) AND s.rt <= coalesce(w.time_end, s.rt)
LEFT JOIN points p ON p.scan = s.scan AND p.mz >= coalesce(w.mz_start, p.mz) AND p.mz <= coalesce(w.mz_end, p.mz)
GROUP BY w.window_id, s.run, s.scan, s.rt"""


@query(_xic_sql(WINDOWS))
def xic_windows(spark, d):
    return _rounded(chrom.xic(scans(spark, d), points(spark, d), spark.createDataFrame(WINDOWS, SCHEMA)))


@query(_xic_sql(BOUNDED))
def xic_tiled(spark, d):
    index = chrom.scan_index(scans(spark, d))
    return _rounded(chrom.xic_tiled(chrom.with_tiles(points(spark, d), index), index, spark.createDataFrame(BOUNDED, SCHEMA)))


SNAPPED = [(i, run, a, b, c + 0.4, d + 0.5) for i, (k, a, b, c, d) in enumerate(BOUNDED) for run in (1992, 1995)]
INDEX_SQL = "idx AS (SELECT run, scan, rt, CAST(row_number() OVER (PARTITION BY run ORDER BY rt, scan) AS INTEGER) AS idx FROM scans WHERE level = 1)"


@query(f"""WITH {SCANS_SQL}, {POINTS_SQL}, {INDEX_SQL},
windows(window_id, run, mz_start, mz_end, time_start, time_end) AS (VALUES {_values(SNAPPED)}),
last AS (SELECT run, rt, max(idx) AS idx FROM idx GROUP BY run, rt),
a AS (SELECT w.window_id, arg_min(l.idx, (abs(l.rt - w.time_start), -l.rt)) AS i0 FROM windows w JOIN last l USING (run) GROUP BY w.window_id),
b AS (SELECT w.window_id, arg_min(l.idx, (abs(l.rt - w.time_end), -l.rt)) AS i1 FROM windows w JOIN last l USING (run) GROUP BY w.window_id)
SELECT w.window_id, i.run, i.scan, i.rt, round(coalesce(sum(p.intensity), 0), 6) AS intensity
FROM windows w JOIN a USING (window_id) JOIN b USING (window_id) JOIN idx i ON i.run = w.run AND i.idx BETWEEN a.i0 AND b.i1
LEFT JOIN points p ON p.scan = i.scan AND p.mz BETWEEN w.mz_start AND w.mz_end GROUP BY ALL""")
def xic_windows_snapped(spark, d):
    w = spark.createDataFrame(SNAPPED, SCHEMA.replace("window_id int,", "window_id int, run int,"))
    return _rounded(chrom.xic_snapped(scans(spark, d), points(spark, d), w))


RANGES = [(1, 1992, 1, 40), (2, 1992, 41, 90), (3, 1994, 10, 10), (4, 1996, 5, 100000)]


@query(f"""WITH {SCANS_SQL}, {POINTS_SQL}, {INDEX_SQL}, r(range_id, run, i0, i1) AS (VALUES {_values(RANGES)})
SELECT r.range_id, r.run, CAST(floor(p.mz) AS BIGINT) AS bin, round(sum(CASE WHEN i.idx BETWEEN r.i0 AND r.i1 THEN p.intensity ELSE 0 END), 6) AS y
FROM r JOIN idx i ON i.run = r.run JOIN points p ON p.scan = i.scan GROUP BY ALL""")
def range_sum_prefix(spark, d):
    binned = points(spark, d).join(chrom.scan_index(scans(spark, d)), "scan").select("run", F.floor("mz").cast("long").alias("bin"), "idx", F.col("intensity").alias("y"))
    return _rounded(chrom.range_sum(chrom.prefix_sums(binned), spark.createDataFrame(RANGES, "range_id int, run int, i0 int, i1 int")), "y")


@query(f"""WITH {SCANS_SQL}, {POINTS_SQL}, {INDEX_SQL}, r(range_id, run, i0, i1) AS (VALUES {_values(RANGES)}),
q AS (SELECT i.run, i.idx, p.mz AS x0, p.intensity AS y0, lead(p.mz) OVER w AS x1, lead(p.intensity) OVER w AS y1 FROM points p JOIN idx i ON i.scan = p.scan WINDOW w AS (PARTITION BY i.run, i.idx ORDER BY p.mz, p.intensity)),
u AS (SELECT *, unnest(range(CAST(ceil(x0 / 5.0) AS BIGINT), CAST(ceil(x1 / 5.0) AS BIGINT))) AS bin FROM q WHERE x1 IS NOT NULL), g AS (SELECT run, idx, bin, y0 + (y1 - y0) * (bin * 5.0 - x0) / (x1 - x0) AS y FROM u)
SELECT r.range_id, g.run, g.bin, round(sum(CASE WHEN g.idx BETWEEN r.i0 AND r.i1 THEN g.y ELSE 0 END), 4) AS y FROM r JOIN g ON g.run = r.run GROUP BY ALL""")
def range_sum_checkpointed(spark, d):
    index = stored(chrom.scan_index(scans(spark, d)).select("run", "scan", "idx"))
    kept = chrom.checkpoint_scans(index)
    grid = lambda some: chrom.interpolated_grid(points(spark, d).join(some, "scan").drop("scan"), 5.0)
    prefixes = stored(chrom.checkpoints(grid(chrom.with_checkpoint(index, kept)), kept))
    out = chrom.range_sum_checkpointed(grid, kept, prefixes, spark.createDataFrame(RANGES, "range_id int, run int, i0 int, i1 int"), index)
    return out.withColumn("y", F.round("y", 4) + 0.0)


@query("SELECT count(*) AS total, min(o_orderkey) AS first, max(o_orderkey) AS last FROM orders")
def scan_bounds(spark, d):
    return chrom.scan_bounds(scans(spark, d))


@query(f"WITH {SCANS_SQL} SELECT run, arg_min(rt, scan) AS t0, arg_max(rt, scan) AS t1 FROM scans GROUP BY run")
def time_domain(spark, d):
    return chrom.time_domain(scans(spark, d))


@query(f"WITH {SCANS_SQL} SELECT run, CASE WHEN count(*) FILTER (level = 1) > 0 THEN 1 ELSE 2 END AS level FROM scans GROUP BY run")
def best_level(spark, d):
    return chrom.best_level(scans(spark, d))


@query(f"""WITH {SCANS_SQL}, {POINTS_SQL}, {INDEX_SQL}, n AS (SELECT run, count(*) AS n FROM idx GROUP BY run)
SELECT i.run, coalesce(min(p.mz), 200) AS lo, coalesce(max(p.mz), 2000) AS hi FROM idx i JOIN n USING (run) LEFT JOIN points p ON p.scan = i.scan
WHERE (i.idx - 1) % greatest(1, CAST(floor(n.n / 30) AS BIGINT)) = 0 GROUP BY i.run""")
def mz_domain(spark, d):
    return chrom.mz_domain(scans(spark, d), points(spark, d))


_TIMES = "q AS (SELECT event_id, CAST(1992 + event_id % 7 AS INTEGER) AS run, CAST(event_id % 3700 AS DOUBLE) / 10 AS t FROM events)"


def _times(spark, d):
    return read(spark, d, "events").select("event_id", (1992 + F.col("event_id") % 7).cast("int").alias("run"), ((F.col("event_id") % 3700).cast("double") / 10).alias("t"))


@query(f"""WITH {SCANS_SQL}, {_TIMES}, l AS (SELECT run, rt, max(scan) AS scan FROM scans WHERE level = 1 GROUP BY run, rt)
SELECT q.event_id, q.run, q.t, l.scan FROM q ASOF LEFT JOIN l ON q.run = l.run AND q.t >= l.rt""")
def scan_at_or_before(spark, d):
    return joins.asof_backward(_times(spark, d), "t", scans(spark, d).where("level = 1"), "rt", "scan", ["run"], "scan")


@query(f"""WITH {SCANS_SQL}, {_TIMES}, l AS (SELECT run, rt, max(scan) AS scan FROM scans WHERE level = 1 GROUP BY run, rt),
a AS (SELECT q.*, l.scan AS s0, l.rt AS t0 FROM q ASOF LEFT JOIN l ON q.run = l.run AND q.t >= l.rt),
b AS (SELECT a.*, l.scan AS s1, l.rt AS t1 FROM a ASOF LEFT JOIN l ON a.run = l.run AND a.t <= l.rt)
SELECT event_id, run, t, CASE WHEN s1 IS NOT NULL AND (s0 IS NULL OR t1 - t <= t - t0) THEN s1 ELSE s0 END AS scan FROM b""")
def scan_nearest(spark, d):
    return joins.asof_nearest(_times(spark, d), "t", scans(spark, d).where("level = 1"), "rt", "scan", ["run"], "scan")


@query("""WITH hit AS (SELECT p_partkey, l_orderkey, l_linenumber, l_extendedprice, l_quantity,
row_number() OVER (PARTITION BY p_partkey ORDER BY l_quantity DESC, l_extendedprice, l_orderkey, l_linenumber) AS rn
FROM part JOIN lineitem ON abs(p_retailprice * 10 - l_extendedprice) <= p_retailprice * 10 * 100 / 1e6)
SELECT p_partkey, l_orderkey, l_linenumber, round(l_extendedprice, 6) AS l_extendedprice, l_quantity FROM hit WHERE rn = 1""")
def band_match_top1(spark, d):
    mass, reach = F.col("p_retailprice") * 10, F.col("p_retailprice") * 10 * 100 / 1e6
    a = read(spark, d, "part").select("p_partkey", mass.alias("_at"), reach.alias("_reach"), (mass - reach).alias("_lo"), (mass + reach).alias("_hi"))
    b = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity")
    order = [F.coalesce(-F.col("l_quantity"), F.lit(float("inf"))), F.col("l_extendedprice"), F.col("l_orderkey"), F.col("l_linenumber")]
    best = joins.best_within(a, "p_partkey", b, "l_extendedprice", order, 5.0)
    return best.select("p_partkey", "l_orderkey", "l_linenumber", F.round("l_extendedprice", 6).alias("l_extendedprice"), "l_quantity")


_CELLS = f"{SCANS_SQL}, {POINTS_SQL}, c AS (SELECT CAST(floor(p.mz / 5) AS BIGINT) AS bx, CAST(floor(s.rt / 4) AS BIGINT) AS bt, sum(p.intensity) AS v FROM points p JOIN scans s ON s.scan = p.scan WHERE s.level = 1 GROUP BY 1, 2)"


def _cells(spark, d):
    return tiles.raster(points(spark, d).join(scans(spark, d).where("level = 1"), "scan"), "mz", "rt", "intensity", 5.0, 4.0)


@query(f"WITH {_CELLS}, m AS (SELECT bx // 8 AS tx, bt // 8 AS ty, max((v, bx, bt)) AS m FROM c GROUP BY 1, 2) SELECT tx, ty, m[2] AS bx, m[3] AS bt, round(m[1], 6) AS v FROM m".replace("max((v, bx, bt))", "max({'v': v, 'bx': bx, 'bt': bt})").replace("m[2]", "m.bx").replace("m[3]", "m.bt").replace("m[1]", "m.v"))
def tile_max(spark, d):
    return _rounded(tiles.tile_max(_cells(spark, d), 8, 8), "v")


@query(f"WITH {_CELLS} SELECT bx // 4 AS bx, bt // 4 AS bt, round(sum(v) / 16, 6) AS v FROM c GROUP BY 1, 2")
def tile_box2x2(spark, d):
    return _rounded(tiles.pyramid(_cells(spark, d), 3)[3], "v")


_LOCAL = "m AS (SELECT a.bx, a.bt, a.v FROM c a WHERE a.v > 0 AND NOT EXISTS (SELECT 1 FROM c b WHERE b.bx BETWEEN a.bx - 1 AND a.bx + 1 AND b.bt BETWEEN a.bt - 1 AND a.bt + 1 AND (b.bx <> a.bx OR b.bt <> a.bt) AND b.v >= a.v))"


@query(f"WITH {_CELLS}, {_LOCAL} SELECT bx, bt, round(v, 6) AS v FROM m")
def local_max_2d(spark, d):
    return _rounded(tiles.local_max_2d(_cells(spark, d)), "v")


@query(f"WITH {_CELLS}, {_LOCAL} SELECT DISTINCT a.bx, a.bt, round(a.v, 6) AS v FROM m a JOIN m b ON a.bt = b.bt AND abs(a.bx - b.bx) = 4 AND abs(a.v - b.v) <= 40")
def maxima_with_partner(spark, d):
    return _rounded(tiles.with_partner(tiles.local_max_2d(_cells(spark, d)), 4, 40.0), "v")


@query(f"WITH {_CELLS} SELECT min(v) AS least, max(v) AS most FROM c WHERE bx BETWEEN 10 AND 50 AND bt BETWEEN 5 AND 60")
def area_min_max(spark, d):
    return tiles.in_area(_cells(spark, d), 10, 50, 5, 60)


@query(f"""WITH {SCANS_SQL}, {POINTS_SQL}, {INDEX_SQL}, b AS (SELECT run, CAST(floor(p.mz / 2.0) AS BIGINT) AS bin, idx, p.mz, p.intensity FROM points p JOIN idx USING (scan)),
n AS (SELECT *, CASE WHEN idx - lag(idx) OVER (PARTITION BY run, bin ORDER BY idx, mz) > 2 THEN 1 ELSE 0 END AS new FROM b),
h AS (SELECT *, sum(new) OVER (PARTITION BY run, bin ORDER BY idx, mz ROWS UNBOUNDED PRECEDING) AS hill FROM n)
SELECT run, bin, CAST(hill AS BIGINT) AS hill, min(idx) AS first, max(idx) AS last, count(*) AS n, round(sum(intensity), 6) AS intensity FROM h GROUP BY ALL""")
def hills(spark, d):
    p = points(spark, d).join(chrom.scan_index(scans(spark, d)), "scan").select("run", "idx", "mz", "intensity")
    by = tiles.hills(p, ["run"], 2.0).groupBy("run", "bin", "hill")
    return by.agg(F.min("idx").alias("first"), F.max("idx").alias("last"), F.count("*").alias("n"), F.round(F.sum("intensity"), 6).alias("intensity"))


_EXTENTS = """c0 AS MATERIALIZED (SELECT * FROM c), mx AS MATERIALIZED (SELECT * FROM m),
x AS (SELECT bx, bt, v, v AS now, bx AS pos FROM mx UNION ALL SELECT x.bx, x.bt, x.v, c0.v, c0.bx FROM x JOIN c0 ON c0.bt = x.bt AND c0.bx = x.pos - 1 AND c0.v < x.now AND c0.v >= x.v * 0.3 WHERE x.pos <= x.bx),
y AS (SELECT bx, bt, v, v AS now, bx AS pos FROM mx UNION ALL SELECT y.bx, y.bt, y.v, c0.v, c0.bx FROM y JOIN c0 ON c0.bt = y.bt AND c0.bx = y.pos + 1 AND c0.v < y.now AND c0.v >= y.v * 0.3),
p AS (SELECT bx, bt, v, v AS now, bt AS pos FROM mx UNION ALL SELECT p.bx, p.bt, p.v, c0.v, c0.bt FROM p JOIN c0 ON c0.bx = p.bx AND c0.bt = p.pos - 1 AND c0.v < p.now AND c0.v >= p.v * 0.3),
q AS (SELECT bx, bt, v, v AS now, bt AS pos FROM mx UNION ALL SELECT q.bx, q.bt, q.v, c0.v, c0.bt FROM q JOIN c0 ON c0.bx = q.bx AND c0.bt = q.pos + 1 AND c0.v < q.now AND c0.v >= q.v * 0.3)"""


@query(f"""WITH RECURSIVE {_CELLS}, {_LOCAL}, {_EXTENTS} SELECT mx.bx, mx.bt, round(mx.v, 6) AS v, (SELECT min(pos) FROM x WHERE x.bx = mx.bx AND x.bt = mx.bt) AS x0, (SELECT max(pos) FROM y WHERE y.bx = mx.bx AND y.bt = mx.bt) AS x1,
(SELECT min(pos) FROM p WHERE p.bx = mx.bx AND p.bt = mx.bt) AS t0, (SELECT max(pos) FROM q WHERE q.bx = mx.bx AND q.bt = mx.bt) AS t1 FROM mx""")
def peak_extents(spark, d):
    cells = _cells(spark, d)
    return _rounded(tiles.peak_extents(cells, tiles.local_max_2d(cells), 0.3), "v")


@query(f"""WITH RECURSIVE {_CELLS}, {_LOCAL}, k AS MATERIALIZED (SELECT row_number() OVER (ORDER BY bx, bt) AS id, bx, bt FROM m),
n AS MATERIALIZED (SELECT a.id, b.id AS o, z, (abs(b.bx - (a.bx + 8.0::DOUBLE / z)), abs(b.bt - a.bt)) AS d FROM k a, (SELECT unnest([1, 2, 3]) AS z), k b WHERE abs(b.bx - (a.bx + 8.0::DOUBLE / z)) <= 0.5 AND abs(b.bt - a.bt) <= 2),
l AS MATERIALIZED (SELECT id, o, z FROM n QUALIFY row_number() OVER (PARTITION BY id, z ORDER BY d, o) = 1 AND row_number() OVER (PARTITION BY o, z ORDER BY d, id) = 1),
e AS MATERIALIZED (SELECT id, o, z FROM l UNION SELECT o, id, z FROM l), r AS (SELECT id, z, id AS reach FROM e UNION SELECT r.id, r.z, e.o FROM r JOIN e ON e.id = r.reach AND e.z = r.z),
w AS (SELECT id, z, min(reach) AS first, count(*) AS n FROM r GROUP BY id, z), b AS (SELECT id, z, first FROM w QUALIFY row_number() OVER (PARTITION BY id ORDER BY n DESC, z) = 1),
g AS (SELECT k.id, bx, bt, coalesce(z, 0) AS z, coalesce(first, -k.id) AS first FROM k LEFT JOIN b USING (id))
SELECT bx, bt, CAST(z AS INTEGER) AS charge, min(id) OVER (PARTITION BY z, first) AS chain, count(*) OVER (PARTITION BY z, first) AS size FROM g""")
def isotope_chains(spark, d):
    peaks = stored(ranked(tiles.local_max_2d(_cells(spark, d)).select("bx", "bt"), ["bx", "bt"], "id"))
    chains = tiles.spacing_chains(peaks.select("id", F.col("bx").alias("x"), F.col("bt").alias("t")), 8.0, 3, 0.5, 2.0)
    return peaks.join(chains, "id").select("bx", "bt", "charge", "chain", "size")


def _numbered(spark, d):
    """Points of days, equal ones put together, numbered by run, day and m/z."""
    p = points(spark, d).join(scans(spark, d), "scan").groupBy("run", F.col("rt").cast("int").alias("idx"), "mz").agg(F.sum("intensity").alias("intensity"))
    return stored(ranked(p, ["run", "idx", "mz"], "id"))


@query()
def hill_features(spark, d):
    return hills_of.find_features(_numbered(spark, d), 0.2, 8, 20.0, 4, 6)


@query()
def hill_layers(spark, d):
    p = _numbered(spark, d)
    return hills_of.merged_layer(hills_of.hill_layer(p, hills_of.grow_hills(p, 0.2, 8), 40.0, 30)).select("run", "tx", "ty", "n")


@query()
def multi_sample_peptides(spark, d):
    """Each run a sample, each part an identification: its name as the sequence, its number as score."""
    k = F.col("p_partkey")
    known = read(spark, d, "part").select((F.lit(1992) + k % 7).cast("int").alias("run"), F.col("p_retailprice").alias("mass"), (k % 366).alias("rt"), (k % 100).cast("double").alias("score"), F.col("p_size").cast("double").alias("intensity"), F.col("p_name").alias("sequence"))
    return workflow.peptides(_numbered(spark, d), known, 0.2, 8, 20.0, 4, 300.0, 10.0, 0.5, 20.0, 5.0)[0]


_MATCHES = """WITH f AS (SELECT event_id AS id, user_id % 5 AS sample, CAST(event_id * 7919 % 40009 AS DOUBLE) / 50 AS mass, CAST(event_id * 104729 % 30011 AS DOUBLE) / 100 AS apex FROM events), k AS (SELECT user_id % 5 AS run, CAST(event_id * 7919 % 40009 AS DOUBLE) / 50 + 0.01 AS mass, CAST(event_id * 104729 % 30011 AS DOUBLE) / 100 AS rt, CAST(event_id % 100 AS DOUBLE) AS score, value AS intensity, 'P' || CAST(event_id % 977 AS VARCHAR) AS sequence FROM events)
SELECT f.id AS feature, k.sequence, k.score, round(k.intensity, 6) AS intensity FROM f JOIN k ON k.run = f.sample AND k.mass BETWEEN f.mass - f.mass * 2000 / 1e6 AND f.mass + f.mass * 2000 / 1e6 AND k.rt BETWEEN f.apex - 10 AND f.apex + 10 AND k.score > 20
QUALIFY row_number() OVER (PARTITION BY f.id ORDER BY k.intensity DESC, k.score DESC, k.sequence) = 1"""


@query(_MATCHES)
def identifications_matched(spark, d):
    e = read(spark, d, "events")
    mass, apex = (F.col("event_id") * 7919 % 40009).cast("double") / 50, (F.col("event_id") * 104729 % 30011).cast("double") / 100
    found = e.select((F.col("user_id") % 5).alias("run"), F.col("event_id").alias("feature"), mass.alias("mass"), (apex - 10).alias("start"), (apex + 10).alias("end"))
    known = e.select((F.col("user_id") % 5).alias("run"), (mass + 0.01).alias("mass"), apex.alias("rt"), (F.col("event_id") % 100).cast("double").alias("score"), F.col("value").alias("intensity"), F.concat(F.lit("P"), (F.col("event_id") % 977).cast("string")).alias("sequence"))
    return workflow.match_identifications(found, known, 2000.0, 20.0).withColumn("intensity", F.round("intensity", 6))


@query()
def warp_anchors_2d(spark, d):
    """Each run against that of 1995, by the spectra of its days."""
    p = points(spark, d).join(scans(spark, d), "scan").select("run", F.col("rt").cast("int").alias("idx"), "mz", "intensity")
    return warp2d.find_warps_2d(p, 1995, segment=30, skew=10, ppm=500.0, penalty=0.1)
