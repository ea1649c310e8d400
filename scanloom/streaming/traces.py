"""Traces over a stream of events: totals by hour with a watermark, and running totals with state."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import read
from ..storage import shared_folder


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table, a file or a folder of files, as a stream of files (a pattern, as a single file can't be watched)."""
    stream = spark.readStream.schema(spark.read.parquet(f"{sf_dir}/events.parquet").schema).option("maxFilesPerTrigger", 16).parquet(f"{sf_dir}/events.parque[t]")
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def stream_tic(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """(event_type, hour, n, intensity) by hour; rows later than ``delay`` behind the newest are dropped by the watermark."""
    by = events.withWatermark("ts", delay).groupBy("event_type", F.window("ts", "1 hour").alias("w"))
    return by.agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("intensity")).select("event_type", (F.unix_micros("w.start") / 1_000_000).cast("long").alias("hour"), "n", "intensity")


def running_totals(events: DataFrame) -> DataFrame:
    """(event_type, n, total) so far, after each batch: a custom state for each type."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        n, total = state.get if state.exists else (0, 0.0)
        for b in batches:
            n, total = n + len(b), total + float(b["value"].sum())
        state.update((n, total))
        yield pd.DataFrame({"event_type": [key[0]], "n": [n], "total": [total]})

    return events.groupBy("event_type").applyInPandasWithState(step, "event_type string, n long, total double", "n long, total double", "update", "NoTimeout")


def collected(stream: DataFrame, spark: SparkSession, mode: str = "complete") -> DataFrame:
    """What a finite stream has written when it is through: a table in the shared folder. Each batch of a "complete" stream replaces the last one, others are added."""
    folder = f"{shared_folder(spark)}/trace-{uuid.uuid4().hex}"

    spark.createDataFrame([], stream.schema).write.parquet(f"{folder}/rows")

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite" if mode == "complete" else "append").parquet(f"{folder}/rows")

    q = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows")
