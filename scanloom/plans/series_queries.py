"""Ordered series of events."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import align, series as S
from ..operators import centroids as C
from ..sources.tables import POINTS_SQL, SERIES_SQL, points, read, series
from .registry import query

ON = ["channel"]

_EXTREMA = f"""WITH {SERIES_SQL}, n AS (SELECT *, CASE WHEN y <> lag(y) OVER w THEN 1 WHEN lag(y) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM series WINDOW w AS (PARTITION BY channel ORDER BY i)),
r AS (SELECT *, sum(new) OVER (PARTITION BY channel ORDER BY i ROWS UNBOUNDED PRECEDING) AS run FROM n),
g AS (SELECT channel, run, max(i) AS i, arg_max(t, i) AS t, arg_max(y, i) AS y, count(*) AS n FROM r GROUP BY channel, run),
k AS (SELECT *, sign(y - lag(y) OVER w) AS a, sign(y - lead(y) OVER w) AS b FROM g WINDOW w AS (PARTITION BY channel ORDER BY run)),
x AS (SELECT *, CASE WHEN a IS NULL AND b IS NULL THEN 0 WHEN a IS NULL THEN CASE WHEN n = 1 THEN b ELSE 0 END WHEN b IS NULL THEN a WHEN a = b THEN a ELSE 0 END AS kind FROM k)"""


@query(_EXTREMA + " SELECT channel, i, t, y FROM x WHERE kind = 1")
def local_maxima(spark, d):
    return S.extrema(series(spark, d), ON).where("kind = 1").drop("kind")


@query(_EXTREMA + " SELECT channel, i, t, y FROM x WHERE kind = -1")
def local_minima(spark, d):
    return S.extrema(series(spark, d), ON).where("kind = -1").drop("kind")


@query(_EXTREMA + """, m AS (SELECT channel, count(*) // 2 + 1 AS mid FROM series GROUP BY channel)
SELECT x.channel, arg_min(x.i, abs(x.i - m.mid) * 1000000 + x.i) AS i, arg_min(x.t, abs(x.i - m.mid) * 1000000 + x.i) AS t, arg_min(x.y, abs(x.i - m.mid) * 1000000 + x.i) AS y FROM x JOIN m USING (channel) WHERE kind = -1 GROUP BY x.channel""")
def middle_split(spark, d):
    return S.nearest_extremum_to_middle(series(spark, d), ON, -1)


@query(_EXTREMA + """, c AS (SELECT *, lag(t) OVER w AS t0, lag(y) OVER w AS y0, lead(t) OVER w AS t2, lead(y) OVER w AS y2 FROM series WINDOW w AS (PARTITION BY channel ORDER BY i))
SELECT c.channel, c.i, round(coalesce(CASE WHEN y0 + c.y + y2 > 1e-5 THEN (t0 * y0 + c.t * c.y + t2 * y2) / (y0 + c.y + y2) END, c.t), 3) AS t, c.y FROM c JOIN x ON c.channel = x.channel AND c.i = x.i WHERE x.kind = 1""")
def centroid3(spark, d):
    return S.centroid3(series(spark, d), ON).withColumn("t", F.round("t", 3))


def _span(spark, d):
    return series(spark, d).groupBy("channel").agg((F.min("t") + 1000.5).alias("t0"), (F.max("t") - 2000.25).alias("t1"))


_AT = """e AS (SELECT channel, min(t) + 1000.5 AS lo, max(t) - 2000.25 AS hi FROM series GROUP BY channel),
q AS (SELECT channel, lo AS t FROM e UNION ALL SELECT channel, hi FROM e),
p AS (SELECT q.channel, q.t, s.t AS ta, s.y AS ya FROM q ASOF JOIN series s ON q.channel = s.channel AND q.t >= s.t),
n AS (SELECT p.*, s.t AS tb, s.y AS yb FROM p ASOF JOIN series s ON p.channel = s.channel AND p.t <= s.t),
v AS (SELECT channel, t, CASE WHEN tb > ta THEN ya + (yb - ya) * (t - ta) / (tb - ta) ELSE ya END AS y FROM n),
line AS (SELECT s.channel, s.t, s.y FROM series s JOIN e ON s.channel = e.channel AND s.t BETWEEN e.lo AND e.hi UNION ALL SELECT * FROM v)"""


@query(f"WITH {SERIES_SQL}, {_AT}, g AS (SELECT *, lag(t) OVER w AS t_, lag(y) OVER w AS y_ FROM line WINDOW w AS (PARTITION BY channel ORDER BY t)) SELECT channel, round(sum((t - t_) * (y + y_) / 2), 2) AS area FROM g GROUP BY channel")
def area_trapezoid(spark, d):
    return S.area(series(spark, d), _span(spark, d), ON).withColumn("area", F.round("area", 2))


@query(f"""WITH {SERIES_SQL}, k AS (SELECT channel, t, y - 20 AS y FROM series), e AS (SELECT channel, min(t) AS lo, max(t) AS hi FROM k GROUP BY channel),
g AS (SELECT channel, t, y, lag(t) OVER w AS t_, lag(y) OVER w AS y_ FROM k WINDOW w AS (PARTITION BY channel ORDER BY t))
SELECT channel, round(sum(CASE WHEN (y < 0) <> (y_ < 0) THEN (t - t_) * greatest(y, y_) * greatest(y, y_) / abs(y - y_) / 2 ELSE greatest((t - t_) * (y + y_) / 2, 0) END), 2) AS area FROM g WHERE t_ IS NOT NULL GROUP BY channel""")
def area_above_axis(spark, d):
    s = series(spark, d).withColumn("y", F.col("y") - 20)
    return S.area(s, s.groupBy("channel").agg(F.min("t").alias("t0"), F.max("t").alias("t1")), ON, "drop").withColumn("area", F.round("area", 2))


@query(f"""WITH {SERIES_SQL}, e AS (SELECT channel, min(t) AS a, max(t) AS b FROM series GROUP BY channel), k AS (SELECT CAST(range AS INTEGER) AS k FROM range(50)),
q AS (SELECT channel, k, a + (b - a) * k / 49 AS t FROM e CROSS JOIN k),
p AS (SELECT q.*, s.t AS ta, s.y AS ya FROM q ASOF LEFT JOIN series s ON q.channel = s.channel AND q.t >= s.t),
n AS (SELECT p.*, s.t AS tb, s.y AS yb FROM p ASOF LEFT JOIN series s ON p.channel = s.channel AND p.t <= s.t)
SELECT channel, k, round(t, 3) AS t, round(CASE WHEN tb IS NULL THEN ya WHEN ta IS NULL THEN yb WHEN tb > ta THEN ya + (yb - ya) * (t - ta) / (tb - ta) ELSE ya END, 4) AS y FROM n""")
def resample_n(spark, d):
    return S.resample(series(spark, d), ON, 50).withColumns({"t": F.round("t", 3), "y": F.round("y", 4)})


@query(f"""WITH {SERIES_SQL}, k AS (SELECT CAST(range AS INTEGER) AS k FROM range(100)), o AS (SELECT floor(min(t)) AS a FROM series),
q AS (SELECT channel, k, a - 5000 + k * 3600.0 AS t FROM (SELECT DISTINCT channel FROM series) CROSS JOIN k CROSS JOIN o),
p AS (SELECT q.*, s.t AS ta, s.y AS ya FROM q ASOF LEFT JOIN series s ON q.channel = s.channel AND q.t >= s.t),
n AS (SELECT p.*, s.t AS tb, s.y AS yb FROM p ASOF LEFT JOIN series s ON p.channel = s.channel AND p.t <= s.t)
SELECT channel, k, t, round(CASE WHEN tb IS NULL OR ta IS NULL THEN 0 WHEN tb > ta THEN ya + (yb - ya) * (t - ta) / (tb - ta) ELSE ya END, 4) AS y FROM n""")
def interp_grid(spark, d):
    s = series(spark, d)
    first = s.agg(F.floor(F.min("t")).cast("double")).first()[0]
    return S.interp_grid(s, ON, first - 5000, 3600.0, 100).withColumn("y", F.round("y", 4))


def _moving(value: str) -> str:
    return f"""WITH {SERIES_SQL}, n AS (SELECT channel, count(*) AS n FROM series GROUP BY channel),
w AS (SELECT s.*, least(greatest(i - 1 - 3, 0), greatest(n - 1 - 6, 0)) AS lo, n FROM series s JOIN n USING (channel))
SELECT w.channel, w.i, w.t, {value} AS y FROM w JOIN series b ON b.channel = w.channel AND b.i - 1 BETWEEN w.lo AND least(w.n - 1, w.lo + 6) GROUP BY w.channel, w.i, w.t"""


@query(_moving("list_sort(list(b.y))[CAST(floor(count(*) / 2) AS BIGINT) + 1]"))
def moving_median(spark, d):
    return S.moving(series(spark, d), ON, 3, "median")


@query(_moving("round(avg(b.y), 6)"))
def moving_avg(spark, d):
    return S.moving(series(spark, d), ON, 3, "avg").withColumn("y", F.round("y", 6))


@query(f"""WITH {SERIES_SQL} SELECT channel, i, t, round(0.25 * coalesce(lag(y) OVER w, 0) + 0.5 * y + 0.25 * coalesce(lead(y) OVER w, 0), 6) AS y FROM series WINDOW w AS (PARTITION BY channel ORDER BY i)""")
def convolve_zero(spark, d):
    return S.convolve(series(spark, d), ON, [0.25, 0.5, 0.25]).withColumn("y", F.round("y", 6))


def _gauss_sql() -> str:
    k = S.gaussian_kernel(1.0)
    h = len(k) // 2
    terms = " + ".join(f"{c!r} * coalesce({'lead' if h - j > 0 else 'lag'}(y, {abs(h - j)}) OVER w, {'l' if h - j > 0 else 'f'})" for j, c in enumerate(k))
    return f"WITH {SERIES_SQL}, e AS (SELECT *, first_value(y) OVER v AS f, last_value(y) OVER v AS l FROM series WINDOW v AS (PARTITION BY channel ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) SELECT channel, i, t, round({terms}, 6) AS y FROM e WINDOW w AS (PARTITION BY channel ORDER BY i)"


@query(_gauss_sql())
def gaussian_smooth(spark, d):
    return S.convolve(series(spark, d), ON, S.gaussian_kernel(1.0), True).withColumn("y", F.round("y", 6))


@query(f"WITH {SERIES_SQL} SELECT channel, i, t, y FROM series WHERE (i - 1) % 7 = 0")
def subsample(spark, d):
    return S.every_kth(series(spark, d), 7)


@query(f"""WITH {SERIES_SQL}, n AS (SELECT *, CASE WHEN t - lag(t) OVER w > 1200 THEN 1 ELSE 0 END AS new FROM series WINDOW w AS (PARTITION BY channel ORDER BY t)),
g AS (SELECT *, sum(new) OVER (PARTITION BY channel ORDER BY t ROWS UNBOUNDED PRECEDING) AS island FROM n)
SELECT channel, CAST(island AS BIGINT) AS island, min(t) AS lo, max(t) AS hi, count(*) AS n FROM g GROUP BY channel, island HAVING count(*) >= 3""")
def islands_1d(spark, d):
    return S.islands(series(spark, d), ON, "t", 1200.0, 3)


@query(f"WITH {SERIES_SQL} SELECT channel, i, round(sum(y) OVER (PARTITION BY channel ORDER BY i ROWS UNBOUNDED PRECEDING), 4) AS y FROM series")
def running_sum(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("channel").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    return series(spark, d).select("channel", "i", F.round(F.sum("y").over(w), 4).alias("y"))


def _prominent(name: str, sel: str, sign: int, channels: str = "") -> str:
    """Extrema with the least value on both sides, up to the next one that is higher; the ends count as the least of all."""
    v = f"({sign} * y)"
    return f"""{name}_e AS (SELECT channel, i, t, y, {v} AS v, min({v}) OVER (PARTITION BY channel) AS least FROM x WHERE kind <> 0),
{name}_h AS (SELECT a.channel, a.i, a.t, a.y, a.v, a.least, max(CASE WHEN b.i < a.i AND b.v >= a.v THEN b.i END) AS l, min(CASE WHEN b.i > a.i AND b.v > a.v THEN b.i END) AS r FROM {name}_e a JOIN {name}_e b USING (channel) GROUP BY ALL),
{name}_p AS (SELECT a.channel, a.i, a.t, a.y, a.v, CASE WHEN a.l IS NULL THEN a.least ELSE min(CASE WHEN b.i > a.l AND b.i < a.i THEN b.v END) END AS lo, CASE WHEN a.r IS NULL THEN a.least ELSE min(CASE WHEN b.i < a.r AND b.i > a.i THEN b.v END) END AS hi
  FROM {name}_h a JOIN {name}_e b USING (channel) GROUP BY a.channel, a.i, a.t, a.y, a.v, a.l, a.r, a.least),
{name} AS (SELECT {name}_p.* FROM {name}_p {channels} WHERE v - lo > {sel} AND v - hi > {sel})"""


def _peaks_sql(selectivity: str, more: str = "", channels: str = "") -> str:
    return f"{_EXTREMA}{more}, {_prominent('p', selectivity, 1, channels)} SELECT channel, i, t, y FROM p"


@query(_peaks_sql("60.0"))
def peaks_selectivity(spark, d):
    return S.peaks(series(spark, d), "channel", 60.0)


@query(_peaks_sql("w.value * 0.25", ", w AS (SELECT channel, min(y) AS value FROM (SELECT channel, y, row_number() OVER (PARTITION BY channel ORDER BY y DESC) AS q FROM x WHERE kind = 1) WHERE q <= 4 GROUP BY channel)", "JOIN w USING (channel)"))
def peaks_relative(spark, d):
    return S.peaks_relative(series(spark, d), "channel", 0.25, 3)


@query(f"""{_EXTREMA}, w AS (SELECT channel, 0.3 * max(abs(y)) AS sel, min(i) AS a, max(i) AS b FROM series GROUP BY channel), {_prominent('p', 'w.sel', 1, 'JOIN w USING (channel)')}, {_prominent('q', 'w.sel', -1, 'JOIN w USING (channel)')},
bo AS (SELECT p.channel, p.i, p.y, coalesce((SELECT max(q.i) FROM q WHERE q.channel = p.channel AND q.i < p.i), a) AS first, coalesce((SELECT min(q.i) FROM q WHERE q.channel = p.channel AND q.i > p.i), b) AS last FROM p JOIN w USING (channel)),
iv AS (SELECT channel, first, last, arg_min(i, (-y, i)) AS apex FROM bo GROUP BY ALL),
mk AS (SELECT channel, first, last FROM iv UNION ALL SELECT channel, a, a FROM w UNION ALL SELECT channel, b, b FROM w),
gp AS (SELECT channel, lag(last) OVER (PARTITION BY channel ORDER BY first, last) AS first, first AS last FROM mk)
SELECT channel, first, last, apex FROM iv UNION ALL SELECT channel, first, last, NULL FROM gp WHERE first < last""")
def peak_intervals(spark, d):
    return S.peak_intervals(series(spark, d), "channel", 0.3)


_ZSCORE = f"""WITH RECURSIVE {SERIES_SQL}, m(channel, i, held, flag) AS (SELECT channel, 30, list(y ORDER BY i), 0 FROM series WHERE i <= 30 GROUP BY channel UNION ALL
SELECT s.channel, s.i, list_append(m.held[-30:], CASE WHEN abs(s.y - w.mean) > 3.0 * w.dev THEN 0.1 * s.y + (1 - 0.1) * m.held[-1] ELSE s.y END),
CASE WHEN abs(s.y - w.mean) > 3.0 * w.dev THEN CASE WHEN s.y > w.mean THEN 1 ELSE -1 END ELSE 0 END
FROM m JOIN series s ON s.channel = m.channel AND s.i = m.i + 1, LATERAL (SELECT list_avg(m.held[1:30]) AS mean, list_stddev_pop(m.held[1:30]) AS dev) w), flags AS (SELECT channel, i, flag FROM m WHERE flag <> 0)"""


@query(f"{_ZSCORE} SELECT channel, i, flag FROM flags")
def zscore_flags(spark, d):
    return S.zscore_flags(series(spark, d), "channel", 30, 3.0, 0.1)


@query(f"""{_ZSCORE}, v AS (SELECT s.channel, s.i, coalesce(f.flag, 0) AS flag FROM series s LEFT JOIN flags f ON f.channel = s.channel AND f.i = s.i),
c AS (SELECT *, coalesce(lag(flag) OVER (PARTITION BY channel ORDER BY i), 0) AS was FROM v WHERE flag <> -1), k AS (SELECT *, lead(i) OVER (PARTITION BY channel ORDER BY i) - 1 AS stop FROM c WHERE flag <> was)
SELECT channel, i AS first, stop AS last FROM k WHERE flag = 1 AND stop IS NOT NULL""")
def zscore_intervals(spark, d):
    s = series(spark, d)
    return S.flag_intervals(s, S.zscore_flags(s, "channel", 30, 3.0, 0.1), "channel")


ANCHORS = [
    ("click", 0.1, 0.0), ("click", 0.5, 0.7), ("click", 0.9, 1.0), ("view", 0.2, 0.3), ("view", 0.6, 0.6), ("error", 0.0, 0.1), ("error", 0.4, 0.3), ("error", 5.0, 6.0),
    ("purchase", 0.3, 0.3), ("purchase", 0.8, 0.9), ("signup", 0.05, 0.2), ("signup", 0.7, 0.75), ("signup", 0.95, 0.8),
]


def _anchors_sql() -> str:
    return "anchors(channel, a, b) AS (VALUES " + ", ".join(f"('{c}', CAST({a} AS DOUBLE), CAST({b} AS DOUBLE))" for c, a, b in ANCHORS) + ")"


@query(f"""WITH {SERIES_SQL}, {_anchors_sql()}, u AS (SELECT channel, i, CAST(i AS DOUBLE) / 2000 AS t FROM series),
p AS (SELECT u.*, a.a AS ta, a.b AS va FROM u ASOF LEFT JOIN anchors a ON u.channel = a.channel AND u.t >= a.a),
n AS (SELECT p.*, a.a AS tb, a.b AS vb FROM p ASOF LEFT JOIN anchors a ON p.channel = a.channel AND p.t <= a.a)
SELECT channel, i, t, round(CASE WHEN ta IS NULL THEN t + vb - tb WHEN tb IS NULL THEN va WHEN tb > ta THEN va + (vb - va) * (t - ta) / (tb - ta) ELSE va END, 6) AS warped FROM n""")
def warp_times(spark, d):
    rows = series(spark, d).select("channel", "i", (F.col("i").cast("double") / 2000).alias("t"))
    a = spark.createDataFrame(ANCHORS, "channel string, t_src double, t_dst double")
    return align.warp(rows, "t", a, ON).withColumn("warped", F.round("warped", 6))


@query(f"""WITH {SERIES_SQL}, b AS (SELECT channel, i % 50 AS k, sum(y) AS y FROM series GROUP BY ALL), n AS (SELECT channel, k, y / max(y) OVER (PARTITION BY channel) AS y FROM b)
SELECT a.channel, round(sum(a.y * o.y), 4) AS score FROM n a JOIN n o ON a.k = o.k AND a.channel <> o.channel GROUP BY a.channel""")
def central_series(spark, d):
    b = S.normalised(series(spark, d).groupBy("channel", (F.col("i") % 50).alias("k")).agg(F.sum("y").alias("y")), ON)
    whole = b.groupBy("k").agg(F.sum("y").alias("s"))
    return b.join(whole, "k").groupBy("channel").agg(F.round(F.sum(F.col("y") * (F.col("s") - F.col("y"))), 4).alias("score"))


@query()
def warp_anchors(spark, d):
    s = series(spark, d)
    return align.find_warps(s, s.agg(F.min("channel")).first()[0])


@query()
def smooth_centroids(spark, d):
    s = series(spark, d).withColumn("hour", F.floor(F.col("t") / 86400).cast("long"))
    from pyspark.sql import Window

    s = s.withColumn("i", F.row_number().over(Window.partitionBy("channel", "hour").orderBy("i")))
    return S.smooth_centroids(s, ["channel", "hour"], 1.5, 1800.0, 1000)


_POLICY = """o AS (SELECT o_orderkey AS scan, CASE WHEN o_orderkey % 3 = 0 THEN 'none' WHEN o_orderkey % 17 = 0 THEN 'custom' WHEN o_orderkey % 19 = 0 THEN 'vendor' WHEN o_orderpriority IN ('1-URGENT', '5-LOW') THEN 'custom' ELSE 'vendor' END AS centroiding FROM orders)"""
_BY_SCAN = f"{POINTS_SQL}, {_POLICY}, series AS (SELECT scan, CAST(row_number() OVER (PARTITION BY scan ORDER BY mz, intensity) AS INTEGER) AS i, mz AS t, intensity AS y FROM points)"


@query(_EXTREMA.replace(SERIES_SQL, _BY_SCAN).replace("channel", "scan") + """, u AS (SELECT *, lag(t) OVER w AS t0, lag(y) OVER w AS y0, lead(t) OVER w AS t2, lead(y) OVER w AS y2 FROM series WINDOW w AS (PARTITION BY scan ORDER BY i)),
cu AS (SELECT u.scan, coalesce((t0 * y0 + u.t * u.y + t2 * y2) / CASE WHEN y0 + u.y + y2 > 1e-5 THEN y0 + u.y + y2 END, u.t) AS mz, u.y AS intensity FROM u JOIN x ON x.scan = u.scan AND x.i = u.i AND x.kind = 1 JOIN o ON o.scan = u.scan WHERE centroiding = 'custom'),
ve AS (SELECT p.scan, mz + 1 AS mz, intensity / 2 AS intensity FROM points p JOIN o ON o.scan = p.scan WHERE centroiding = 'vendor' AND p.scan % 5 <> 0),
pl AS (SELECT p.* FROM points p JOIN o ON o.scan = p.scan WHERE centroiding = 'none' OR (centroiding = 'vendor' AND p.scan % 5 = 0)),
al AS (SELECT * FROM cu UNION ALL SELECT * FROM ve UNION ALL SELECT * FROM pl)
SELECT scan, any_value(centroiding) AS centroiding, count(*) AS n, round(sum(mz) + 1.23e-5::DOUBLE, 4) AS mz, round(sum(intensity), 4) AS intensity FROM al JOIN o USING (scan) GROUP BY scan""")
def centroiding_policy(spark, d):
    k = F.col("o_orderkey")
    override = F.when(k % 17 == 0, "custom").when(k % 19 == 0, "vendor")
    scans = read(spark, d, "orders").select(k.alias("scan"), (k % 3 != 0).alias("profile"), F.col("o_orderpriority").alias("format"), override.alias("override"))
    policy = C.centroiding(scans, "auto", ["1-URGENT", "5-LOW"])
    p = points(spark, d)
    vendor = p.where("scan % 5 <> 0").select("scan", (F.col("mz") + 1).alias("mz"), (F.col("intensity") / 2).alias("intensity"))
    found = C.centroids(p, policy, vendor).join(policy.select("scan", "centroiding"), "scan")
    return found.groupBy("scan").agg(F.first("centroiding").alias("centroiding"), F.count("*").alias("n"), F.round(F.sum("mz") + 1.23e-5, 4).alias("mz"), F.round(F.sum("intensity"), 4).alias("intensity"))  # off the ties of rounding
