"""What counts as a word, and small helpers that several operators share."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import shared_folder, stored  # noqa: F401

#: A word is a run of anything but blank, tab, line feed, vertical tab, form feed and carriage return.
WORD = r"[^\x20\x09-\x0D]+"
WORDS = re.compile(WORD)
_P = np.uint64(0x9E3779B97F4A7C15)


def word_count(text: Column) -> Column:
    """Number of words, 0 for null; built-in functions only."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sliced(batches, rows: int = 500):
    """The same rows in small batches, so that what a task unpacks at once stays small whatever the session's batch size."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def small_batches(spark: SparkSession) -> None:
    """Bounds the session's Arrow batches to 1,000 rows and 8 MB where nothing else was chosen: with long texts the default of 10,000 rows takes hundreds of MB in each task."""
    for key, default, value in (("maxRecordsPerBatch", "10000", "1000"), ("maxBytesPerBatch", f"{64 << 20}b", "8m")):
        if spark.conf.get(f"spark.sql.execution.arrow.{key}") == default:
            spark.conf.set(f"spark.sql.execution.arrow.{key}", value)


def trim() -> None:
    """At a task's end: memory that Arrow and the C library keep for later goes back, as workers live on and run the tasks of other operators."""
    import ctypes

    pa.default_memory_pool().release_unused()
    give_back = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if give_back:
        give_back(0)


#: Bits of the filter that keeps texts which nobody asks for from being sent. A fixed size: beyond it, it only lets more through.
FILTER = 1 << 24


def _cell_of(ids: np.ndarray) -> np.ndarray:
    return ((ids.astype(np.uint64) * _P) >> np.uint64(40)).astype(np.int64)


def wanted_filter(ids: DataFrame) -> np.ndarray:
    """A bit array of FILTER bits with those of the ids set."""

    def bits_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells_ = [_cell_of(b.column(0).to_numpy()) for b in batches]
        some = np.unique(np.concatenate(cells_)) if cells_ else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(some)], names=["cell"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, np.ndarray] = {}
        for b in batches:
            cell = b.column(0).to_numpy()
            for k in np.unique(cell >> 16):
                parts.setdefault(int(k), np.zeros(1 << 16, bool))[cell[cell >> 16 == k] & 0xFFFF] = True
        yield pa.RecordBatch.from_arrays([pa.array(list(parts), pa.int64()), pa.array([np.packbits(v).tobytes() for v in parts.values()], pa.binary())], names=["part", "bits"])

    cells_ = ids.mapInArrow(bits_of, "cell long").repartition(F.shiftright("cell", 16))
    out = np.zeros(FILTER, bool)
    for r in cells_.mapInArrow(pack, "part long, bits binary").collect():  # FILTER / 8 bytes at most
        out[r["part"] << 16 : (r["part"] + 1) << 16] = np.unpackbits(np.frombuffer(r["bits"], np.uint8)).astype(bool)
    return np.packbits(out)


def release(spark: SparkSession, *tables: DataFrame) -> None:
    """Delete stored tables that nothing reads any more, and let Spark drop the shuffle files of finished steps.

    Spark drops them when the driver's objects are collected, which on a driver with room to spare may be long after.
    """
    import gc
    import time

    jvm = spark.sparkContext._jvm
    for t in tables:
        for file in {f.rsplit("/", 1)[0] for f in t.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(file)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    for _ in range(2):  # listeners hold a step's plan for a moment after its end
        gc.collect()
        jvm.System.gc()
        time.sleep(1)
