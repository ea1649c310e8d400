"""Runs by path: a registry of readers in order, the first that knows a path opens it.

A reader knows a path by its name or by what lies in it, and gives the run's tables without reading them. A run that is open is not opened again. Paths are compared in their
canonical form. New formats are added with ``register``, before the ones that are there if they are to come first.
"""

from __future__ import annotations

import posixpath
import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import Run, decode_blobs, load, read_csv


@dataclass(frozen=True)
class Reader:
    """``knows`` is asked with the session and a canonical path, ``opens`` gives the run."""

    name: str
    knows: Callable[[SparkSession, str], bool]
    opens: Callable[[SparkSession, str], Run]


def canonical(path: str) -> str:
    """A path without doubled or trailing separators and steps up, its scheme as it is; back slashes of a path without a scheme count as separators."""
    scheme, rest = re.match(r"([A-Za-z][A-Za-z0-9+.-]+:/*)?(.*)", path, re.DOTALL).groups()
    rest = rest if scheme else rest.replace("\\", "/")
    clean = posixpath.normpath(rest) if rest else ""
    return (re.sub(":/*$", lambda m: m[0], scheme) if scheme else "") + (clean if clean != "." or not scheme else "")


def _files(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder of any store that Spark reads; empty if it isn't one."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    store = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return [s.getPath().getName() for s in store.listStatus(where)] if store.exists(where) else []


def _folder(spark: SparkSession, path: str) -> bool:
    return {"scans", "points"} <= set(_files(spark, path))


def _blobs(spark: SparkSession, path: str) -> bool:
    return {"scans.parquet", "peaks.parquet"} <= set(_files(spark, path))


def _text(spark: SparkSession, path: str) -> bool:
    return path.lower().endswith((".csv", ".csv.gz"))


def _open_blobs(spark: SparkSession, path: str) -> Run:
    points = decode_blobs(spark.read.parquet(f"{path}/peaks.parquet"))
    return Run(spark.read.parquet(f"{path}/scans.parquet"), points.select("scan", "mz", "intensity"))


def _open_text(spark: SparkSession, path: str) -> Run:
    """One row a point: run, scan, level, rt, mz, intensity; scans without points have a row with a null m/z."""
    rows = read_csv(spark, path).select(*(F.col(c).cast(t).alias(c) for c, t in (("run", "int"), ("scan", "long"), ("level", "int"), ("rt", "double"), ("mz", "double"), ("intensity", "double"))))
    return Run(rows.select("run", "scan", "level", "rt").distinct(), rows.where("mz is not null").select("scan", "mz", "intensity"))


READERS = [Reader("folder", _folder, load), Reader("blobs", _blobs, _open_blobs), Reader("text", _text, _open_text)]
_open: dict[tuple[str, str], tuple[str, Run]] = {}


def register(reader: Reader, first: bool = False) -> None:
    """Adds a reader, in place of one of the same name."""
    READERS[:] = [r for r in READERS if r.name != reader.name]
    READERS.insert(0 if first else len(READERS), reader)


def open_run(spark: SparkSession, path: str, name: str | None = None) -> Run:
    """The run at a path, by the first reader that knows it, or by the named one. An unknown path is a ValueError that lists the readers asked."""
    where = canonical(path)
    key = (spark.sparkContext.applicationId, where)
    if key in _open and name in (None, _open[key][0]):
        return _open[key][1]
    for reader in READERS:
        if reader.name == name or (name is None and reader.knows(spark, where)):
            _open[key] = reader.name, reader.opens(spark, where)
            return _open[key][1]
    raise ValueError(f"no reader for {where}; asked: {', '.join(r.name for r in READERS)}")


def close_run(spark: SparkSession, path: str) -> None:
    """Forgets a run, so that it is opened anew."""
    _open.pop((spark.sparkContext.applicationId, canonical(path)), None)


def open_runs(spark: SparkSession, paths: list[str]) -> Run:
    """Several runs as one; a scan's number must be its own among them."""
    runs = [open_run(spark, p) for p in paths]
    scans, points = runs[0].scans, runs[0].points

    def both(a: DataFrame, b: DataFrame) -> DataFrame:
        return a.unionByName(b, allowMissingColumns=True)

    for r in runs[1:]:
        scans, points = both(scans, r.scans), both(points, r.points)
    return Run(scans, points)
