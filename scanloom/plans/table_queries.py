"""Metadata, sources, sinks and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import files
from ..sources.tables import read
from ..streaming import traces
from .registry import query


@query("SELECT DISTINCT o_orderpriority AS key, count(*) OVER (PARTITION BY o_orderpriority) AS value FROM orders")
def key_values(spark, d):
    return read(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("key")).agg(F.count("*").alias("value"))


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' THEN '' WHEN contains(o_orderpriority, 'URGENT') THEN 'urgent' WHEN contains(o_orderpriority, 'LOW') THEN 'low' ELSE 'other' END AS mode FROM orders")
def mode_from_text(spark, d):
    p = F.col("o_orderpriority")
    mode = F.when(F.col("o_orderstatus") == "O", "").when(p.contains("URGENT"), "urgent").when(p.contains("LOW"), "low").otherwise("other")
    return read(spark, d, "orders").select("o_orderkey", mode.alias("mode"))


@query("SELECT event_type, CAST(epoch_us(date_trunc('hour', ts)) // 1000000 AS BIGINT) AS hour, count(*) AS n, round(sum(value), 4) AS intensity FROM events GROUP BY ALL")
def stream_tic(spark, d):
    return traces.collected(traces.stream_tic(traces.event_stream(spark, d)), spark)


@query("""WITH n AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts)),
g AS (SELECT *, sum(new) OVER (PARTITION BY event_type ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM n)
SELECT event_type, epoch_us(min(ts)) AS start, count(*) AS n, round(sum(value), 4) AS intensity FROM g GROUP BY event_type, k""")
def gap_sessions(spark, d):
    s = read(spark, d, "events").groupBy("event_type", F.session_window("ts", "30 minutes").alias("w")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("intensity"))
    return s.select("event_type", F.unix_micros("w.start").alias("start"), "n", "intensity")


_MODS = """WITH RECURSIVE d AS (SELECT DISTINCT p_brand AS title, p_retailprice AS m FROM part),
r AS (SELECT title, min(m) AS first, 0 AS part FROM d GROUP BY title UNION ALL SELECT r.title, min(d.m), r.part + 1 FROM r JOIN d ON d.title = r.title AND d.m - r.first >= 0.35 GROUP BY r.title, r.part),
g AS (SELECT *, row_number() OVER (ORDER BY lower(title), title, first) AS grp FROM r)"""


@query(f"""{_MODS} SELECT p_partkey, title || '#' || CAST(g.part AS VARCHAR) AS key, grp AS "group" FROM part ASOF JOIN g ON g.title = p_brand AND p_retailprice >= g.first""")
def modification_groups(spark, d):
    mods = read(spark, d, "part").select("p_partkey", F.col("p_brand").alias("title"), F.col("p_retailprice").alias("mono_mass"))
    return files.modification_groups(mods, 0.35).select("p_partkey", "key", "group")


@query(f"""{_MODS}, q AS (SELECT l_orderkey, l_linenumber, l_extendedprice, 'Brand#' || CAST(l_suppkey % 30 AS VARCHAR) AS title, l_extendedprice / l_quantity AS m FROM lineitem),
a AS (SELECT DISTINCT title, m FROM q), b AS (SELECT a.title, a.m, arg_min(grp, (abs(a.m - first), grp)) AS grp FROM a JOIN g ON g.title = a.title AND abs(a.m - g.first) < 0.35 GROUP BY ALL)
SELECT l_orderkey, l_linenumber, l_extendedprice, b.grp AS "group" FROM q LEFT JOIN b ON b.title = q.title AND b.m = q.m""")
def modification_lookup(spark, d):
    mods = read(spark, d, "part").select(F.col("p_brand").alias("title"), F.col("p_retailprice").alias("mono_mass"))
    asked = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", F.concat(F.lit("Brand#"), (F.col("l_suppkey") % 30).cast("string")).alias("title"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("mono_mass"))
    return files.modification_lookup(asked, files.modification_groups(mods, 0.35), 0.35).select("l_orderkey", "l_linenumber", "l_extendedprice", "group")
