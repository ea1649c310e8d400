"""Runs, scans, points and series over the star-schema tables.

A run is a year of orders, a scan an order: its retention time is the day of the year, its level 1 for open orders and 2 for others. The points
of a scan are its line items, with price / 100 as m/z and quantity as intensity. A channel of a series is an event type.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    # Times carry no zone in the files; they are UTC here.
    return df.withColumns({c: df[c].cast("timestamp") for c, t in df.dtypes if t == "timestamp_ntz"})


def scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(run, scan, level, rt)."""
    return read(spark, sf_dir, "orders").select(
        F.year("o_orderdate").alias("run"),
        F.col("o_orderkey").alias("scan"),
        F.when(F.col("o_orderstatus") == "O", 1).otherwise(2).alias("level"),
        (F.dayofyear("o_orderdate") - 1).cast("double").alias("rt"),
    )


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(scan, mz, intensity)."""
    return read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("scan"), (F.col("l_extendedprice") / 100).alias("mz"), F.col("l_quantity").alias("intensity"))


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(channel, i, t, y): t in seconds, i the position in the channel."""
    from pyspark.sql import Window

    e = read(spark, sf_dir, "events").select(F.col("event_type").alias("channel"), (F.unix_micros("ts") / 1e6).alias("t"), F.col("value").alias("y"), "event_id")
    return e.withColumn("i", F.row_number().over(Window.partitionBy("channel").orderBy("t", "event_id"))).select("channel", "i", "t", "y")


#: The same as SQL, for the oracles.
SCANS_SQL = "scans AS (SELECT CAST(year(o_orderdate) AS INTEGER) AS run, o_orderkey AS scan, CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 2 END AS level, CAST(dayofyear(o_orderdate) - 1 AS DOUBLE) AS rt FROM orders)"
POINTS_SQL = "points AS (SELECT l_orderkey AS scan, l_extendedprice / 100 AS mz, l_quantity AS intensity FROM lineitem)"
SERIES_SQL = "series AS (SELECT event_type AS channel, CAST(row_number() OVER (PARTITION BY event_type ORDER BY epoch_us(ts), event_id) AS INTEGER) AS i, epoch_us(ts) / 1e6 AS t, value AS y FROM events)"
