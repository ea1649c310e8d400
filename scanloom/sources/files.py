"""Reading and writing runs, plots, reports and catalogues."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.chem import C13_GAP, PROTON
from ..operators.greedy import ranked
from ..operators.joins import band_join
from ..operators.series import streamed
from ..storage import stored


# Delimited text


def read_csv(spark: SparkSession, path: str, header: bool = True, sep: str = ",", quote: str = '"') -> DataFrame:
    """All columns as text. Records end at CR, LF or CRLF outside of quotes, white space after an end is skipped, a doubled quote is one."""
    df = spark.read.option("multiLine", True).option("header", header).option("sep", sep).option("quote", quote).option("escape", quote).option("emptyValue", "").csv(path)
    first = df.columns[0]
    return df.withColumn(first, F.ltrim(F.col(f"`{first}`")))


def csv_field(c: Column, sep: str = ",", quote: str = '"') -> Column:
    """A field as text, quoted only if it holds the separator, a line end or a quote."""
    t = F.coalesce(c.cast("string"), F.lit(""))
    needs = t.contains(sep) | t.contains(quote) | t.contains("\n") | t.contains("\r")
    return F.when(needs, F.concat(F.lit(quote), F.replace(t, F.lit(quote), F.lit(quote * 2)), F.lit(quote))).otherwise(t)


def write_csv(df: DataFrame, path: str, sep: str = ",") -> None:
    """Part files of records that end with CRLF, each with the header first."""
    lines = df.select(F.concat_ws(sep, *[csv_field(F.col(f"`{c}`"), sep) for c in df.columns]).alias("value"))
    head = sep.join(c if not set(c) & {sep, '"', "\n", "\r"} else '"' + c.replace('"', '""') + '"' for c in df.columns)

    def with_head(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.array([head])], names=["value"])
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0)], names=["value"])

    lines.mapInArrow(with_head, "value string").write.option("lineSep", "\r\n").text(path)


def read_xy(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """(x, y) of a plot in text; lines that aren't two numbers are left out."""
    parts = F.split(F.trim("value"), f"[{sep}\\s]+")
    xy = spark.read.text(path).select(F.get(parts, F.lit(0)).try_cast("double").alias("x"), F.get(parts, F.lit(1)).try_cast("double").alias("y"))
    return xy.where("x is not null and y is not null")


def write_xy(points: DataFrame, path: str) -> None:
    points.select("x", "y").write.csv(path)


def dump_points(points: DataFrame, index: DataFrame, path: str) -> None:
    """Index of the scan, m/z and intensity with 15 decimals, as text."""
    rows = points.join(index, "scan").select((F.col("idx") - 1).cast("string"), F.format_string("%.15f", "mz"), F.format_string("%.15f", "intensity"))
    rows.select(F.concat_ws(",", *rows.columns).alias("value")).write.text(path)


# Runs


@dataclass
class Run:
    """The tables of a set of runs."""

    scans: DataFrame
    points: DataFrame


def checked(points: DataFrame) -> DataFrame:
    """(scan, valid, comment): scans with a value that isn't a number, or an m/z below the one before in ``i``, are invalid."""
    from pyspark.sql import Window

    back = F.col("mz") < F.lag("mz").over(Window.partitionBy("scan").orderBy("i"))
    bad = F.isnan("mz") | F.isnan("intensity") | F.col("mz").isNull() | F.col("intensity").isNull()
    flags = points.select("scan", bad.alias("bad"), F.coalesce(back, F.lit(False)).alias("back")).groupBy("scan").agg(F.bool_or("bad").alias("bad"), F.bool_or("back").alias("back"))
    comment = F.when(F.col("bad"), "not a number").when(F.col("back"), "m/z not ascending").otherwise("")
    return flags.select("scan", (comment == "").alias("valid"), comment.alias("comment"))


def write_runs(scans: DataFrame, points: DataFrame, folder: str, mode: str = "errorifexists") -> None:
    """Runs as Parquet: scans with their intensity sum, and points in files by run, sorted by scan and m/z. A scan that fails the
    check is kept as an invalid row without points."""
    state = checked(points)
    sums = points.groupBy("scan").agg(F.sum("intensity").alias("intensity_sum"), F.count("*").alias("n_points"))
    dim = scans.join(state, "scan", "left").join(sums, "scan", "left")
    dim = dim.withColumns({"valid": F.coalesce("valid", F.lit(True)), "comment": F.coalesce("comment", F.lit("")), "n_points": F.coalesce("n_points", F.lit(0)), "intensity_sum": F.coalesce("intensity_sum", F.lit(0.0))})
    dim.write.mode(mode).partitionBy("run").parquet(f"{folder}/scans")
    good = points.join(scans.select("scan", "run"), "scan").join(state.where("valid").select("scan"), "scan", "left_semi")
    good.repartition("run", F.expr("scan div 4096")).sortWithinPartitions("run", "scan", "mz").write.mode(mode).partitionBy("run").parquet(f"{folder}/points")


def load(spark: SparkSession, folder: str) -> Run:
    """Runs that write_runs has written; filters on run reach the files' folders."""
    return Run(spark.read.parquet(f"{folder}/scans"), spark.read.parquet(f"{folder}/points"))


def decode_blobs(rows: DataFrame, wide_y: bool = False) -> DataFrame:
    """(scan, i, mz, intensity) from (scan, mz binary of doubles, intensity binary of floats, or doubles)."""
    kind = np.float64 if wide_y else np.float32

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for scan, x, y in zip(*(c.to_pylist() for c in b.columns), strict=True):
                mz, v = np.frombuffer(x or b"", np.float64), np.frombuffer(y or b"", kind).astype(np.float64)
                n = min(len(mz), len(v))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, scan, np.int64)), pa.array(np.arange(n, dtype=np.int32)), pa.array(mz[:n]), pa.array(v[:n])], names=["scan", "i", "mz", "intensity"])

    return rows.select(F.col("scan").cast("long"), "mz", "intensity").mapInArrow(run, "scan long, i int, mz double, intensity double")


# Trees and catalogues

MODIFICATION = T.StructType(
    [
        T.StructField("_title", T.StringType()),
        T.StructField("_full_name", T.StringType()),
        T.StructField("specificity", T.ArrayType(T.StructType([T.StructField("_site", T.StringType()), T.StructField("_position", T.StringType()), T.StructField("_classification", T.StringType())]))),
        T.StructField("delta", T.StructType([T.StructField("_mono_mass", T.DoubleType()), T.StructField("_avge_mass", T.DoubleType()), T.StructField("_composition", T.StringType())])),
    ]
)


def read_modifications(spark: SparkSession, path: str, row: str = "mod") -> DataFrame:
    """(title, full_name, mono_mass, composition, sites) of an XML catalogue of modifications."""
    df = spark.read.format("xml").option("rowTag", row).schema(MODIFICATION).load(path)
    sites = F.array_sort(F.array_distinct(F.transform("specificity", lambda s: s["_site"])))
    return df.select(F.col("_title").alias("title"), F.col("_full_name").alias("full_name"), F.col("delta._mono_mass").alias("mono_mass"), F.col("delta._composition").alias("composition"), sites.alias("sites"))


def modification_groups(mods: DataFrame, eps: float = 1e-4) -> DataFrame:
    """``mods`` with (part, key, group): in order of mass, a modification joins the group of its title whose first mass is less than ``eps`` below, or opens the next one.

    Each is compared with the group's first member only, so a group spans less than ``eps``. Titles count as written. ``part`` numbers the groups of a title from 0, ``key``
    is title#part, ``group`` numbers all groups from 1, by title in lower case, title and mass. Those without a title or a mass are in no group: null.
    """
    masses = mods.where("title is not null and mono_mass is not null").select("title", "mono_mass").distinct()

    def state():
        first, part = None, -1

        def see(mass: float) -> list:
            nonlocal first, part
            if first is None or mass - first >= eps:
                first, part = mass, part + 1
            return [(mass, first, part)]

        return see

    placed = stored(streamed(masses, "title", ["mono_mass"], state, "mono_mass double, first double, part int"))
    groups = placed.select(F.lower("title").alias("_lower"), "title", "first", "part").distinct()
    numbers = ranked(groups, ["_lower", "title", "first"], "group").select("title", "part", "group")
    known = placed.join(numbers, ["title", "part"]).select("title", "mono_mass", "part", "group")
    return mods.join(known, ["title", "mono_mass"], "left").withColumn("key", F.concat_ws("#", "title", F.col("part").cast("string")))


def modification_lookup(asked: DataFrame, groups: DataFrame, eps: float = 1e-4) -> DataFrame:
    """``asked`` (title, mono_mass, ...) with the group of the same title whose first mass is less than ``eps`` away, the nearest one, then the first; null if none.

    ``groups``: the result of ``modification_groups``. The join is on title and cells of mass.
    """
    firsts = groups.where("group is not null").groupBy("title", "group").agg(F.min("mono_mass").alias("_first"))
    rows = asked.withColumn("_row", F.monotonically_increasing_id())
    near = band_join(rows.where("title is not null and mono_mass is not null"), "mono_mass", firsts, "_first", F.lit(eps), eps, ["title"], closed=False)
    best = near.groupBy("_row").agg(F.min_by("group", F.struct(F.abs(F.col("mono_mass") - F.col("_first")), F.col("group"))).alias("group"))
    return rows.join(best, "_row", "left").drop("_row")


def write_tree(rows: DataFrame, path: str) -> None:
    """A report tree (path array, values) as JSON lines."""
    rows.write.json(path)


def read_tree(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


# Synthetic runs


def synthetic(spark: SparkSession, peptides: int, n_scans: int, minutes: float = 5.0, seed: int = 666, noise: int = 20) -> Run:
    """A seeded run of peptides: charges 1 to 3, isotope envelopes, a peak in time, and uniform noise. All columns are hashes of ids."""

    def unit(*c: Column) -> Column:
        return F.pmod(F.xxhash64(F.lit(seed), *c), F.lit(1_000_003)).cast("double") / 1_000_003

    dim = spark.range(n_scans).select(F.lit(1).alias("run"), F.col("id").cast("int").alias("scan"), F.lit(1).alias("level"), (F.col("id") * minutes / n_scans).alias("rt"))
    p = spark.range(peptides).select("id", (800 + 2200 * unit(F.col("id"), F.lit("m"))).alias("mass"), (minutes * (0.1 + 0.8 * unit(F.col("id"), F.lit("t")))).alias("centre"), (1e4 * (1 + 9 * unit(F.col("id"), F.lit("h")))).alias("height"))
    ions = p.withColumn("z", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3)))).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(4))))
    lam = F.col("mass") * 0.00055
    ions = ions.select("centre", ((F.col("mass") + F.col("z") * PROTON + F.col("k") * C13_GAP) / F.col("z")).alias("mz"), (F.col("height") * F.pow(lam, F.col("k")) * F.exp(-lam) / F.factorial("k") / F.col("z")).alias("h"))
    width = minutes / 60
    # Each ion is sent to the scans of its peak by their numbers.
    at = F.explode(F.sequence(F.greatest(F.lit(0), F.ceil((F.col("centre") - 3 * width) * n_scans / minutes)), F.least(F.lit(n_scans - 1), F.floor((F.col("centre") + 3 * width) * n_scans / minutes))))
    signal = ions.withColumn("scan", at).select(F.col("scan").cast("int").alias("scan"), "mz", (F.col("h") * F.exp(-0.5 * F.pow((F.col("scan") * minutes / n_scans - F.col("centre")) / width, 2))).alias("intensity"))
    hiss = dim.select("scan", F.explode(F.sequence(F.lit(1), F.lit(noise))).alias("j")).select("scan", (300 + 1700 * unit(F.col("scan"), F.col("j"), F.lit("x"))).alias("mz"), (50 * unit(F.col("scan"), F.col("j"), F.lit("y"))).alias("intensity"))
    return Run(dim, signal.where("intensity > 1").unionByName(hiss))


def fingerprint(content: Column, samples: int = 10, width: int = 65_536) -> Column:
    """SHA-1 of a binary column if it is small, else of its size and equally spaced samples."""
    n = F.octet_length(content)
    step = F.floor(n / samples).cast("int")
    some = F.concat(n.cast("string").cast("binary"), *[F.substring(content, F.lit(i) * step + 1, F.lit(width)) for i in range(samples)])
    return F.when(n <= samples * width, F.sha1(content)).otherwise(F.sha1(some))


def write_calibration(coefficients: DataFrame, path: str) -> None:
    """One row a run, its coefficients (t, c0, c1, c2) in order of time."""
    series = F.array_sort(F.collect_list(F.struct("t", "c0", "c1", "c2"))).alias("coefficients")
    coefficients.groupBy("run").agg(series).write.mode("overwrite").parquet(path)


def read_calibration(spark: SparkSession, path: str) -> DataFrame:
    """(run, t, c0, c1, c2)."""
    return spark.read.parquet(path).select("run", F.explode("coefficients").alias("c")).select("run", "c.*")


def write_scans(points: DataFrame, first: int, last: int, path: str) -> None:
    """The points (scan, mz, intensity) of the scans from ``first`` to ``last`` as text, a folder a scan, named by its number with eight digits."""
    some = points.where(F.col("scan").between(first, last)).withColumn("name", F.lpad(F.col("scan").cast("string"), 8, "0"))
    rows = some.repartition("name").sortWithinPartitions("name", "mz")
    rows.select("name", "mz", "intensity").write.mode("overwrite").option("header", True).partitionBy("name").csv(path)
