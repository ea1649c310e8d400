"""Signal operators: closed forms, boundary cases and brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from scanloom.functions import chem
from scanloom.operators import align, calibrate, chrom, cluster, compare, convolve, features, joins, report, sequences, series, spectra, tiles


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


@pytest.fixture(scope="module")
def run(spark):
    scans = spark.createDataFrame([(1, 10, 1, 0.0), (1, 11, 1, 1.0), (1, 12, 2, 1.5), (1, 13, 1, 2.0), (1, 14, 1, 3.0)], "run int, scan int, level int, rt double")
    points = spark.createDataFrame([(10, 100.0, 5.0), (10, 130.0, 7.0), (11, 100.0, 1.0), (12, 100.0, 9.0), (13, 99.99, 4.0), (13, 130.01, 2.0)], "scan int, mz double, intensity double")
    return scans, points


def test_traces_fill_empty_scans(run):
    assert rows(chrom.tic(*run), "scan", "intensity") == [(10, 12.0), (11, 1.0), (13, 6.0), (14, 0.0)]
    assert rows(chrom.bpc(*run), "scan", "intensity") == [(10, 7.0), (11, 1.0), (13, 4.0), (14, 0.0)]


WINDOW = "window_id int, mz_start double, mz_end double, time_start double, time_end double"


def test_xic_bounds_are_closed_and_empty_scans_zero(spark, run):
    w = spark.createDataFrame([(1, 100.0, 130.0, 0.0, 3.0), (2, 130.0, 100.0, 0.0, 3.0), (3, None, None, 2.0, None), (4, 100.0, 100.0, 9.0, 10.0), (5, 120.0, None, None, 0.0)], WINDOW)
    got = rows(chrom.xic(*run, w), "window_id", "scan", "intensity")
    assert [x for x in got if x[0] == 1] == [(1, 10, 12.0), (1, 11, 1.0), (1, 13, 0.0), (1, 14, 0.0)]
    assert [x[2] for x in got if x[0] == 2] == [0.0] * 4
    assert [x for x in got if x[0] in (3, 4, 5)] == [(3, 13, 6.0), (3, 14, 0.0), (5, 10, 7.0)]


def test_tiled_equals_untiled_and_prefix_equals_direct(spark):
    rng = random.Random(0)
    scans = spark.createDataFrame([(r, r * 1000 + i, 1, i * 0.1) for r in (1, 2) for i in range(200)], "run int, scan int, level int, rt double")
    points = spark.createDataFrame([(rng.choice([1, 2]) * 1000 + rng.randrange(200), rng.uniform(0, 400), float(rng.randrange(100))) for _ in range(4000)], "scan int, mz double, intensity double")
    w = spark.createDataFrame([(k, (a := rng.uniform(0, 350)), a + rng.uniform(0, 60), (t := rng.uniform(0, 15)), t + rng.uniform(0, 6)) for k in range(20)], WINDOW)
    index = chrom.scan_index(scans)
    a = rows(chrom.xic(scans, points, w), "window_id", "scan", "intensity")
    assert a == rows(chrom.xic_tiled(chrom.with_tiles(points, index), index, w), "window_id", "scan", "intensity")
    binned = points.join(index, "scan").select("run", F.floor(F.col("mz") / 50).alias("bin"), "idx", F.col("intensity").alias("y"))
    got = rows(chrom.range_sum(chrom.prefix_sums(binned), spark.createDataFrame([(1, 1, 20, 70)], "range_id int, run int, i0 int, i1 int")), "bin", "y")
    want = rows(binned.where("run = 1").groupBy("bin").agg(F.sum(F.when(F.col("idx").between(20, 70), F.col("y")).otherwise(0.0)).alias("y")), "bin", "y")
    assert [x for x in got] == want


def test_snapped_window_takes_the_nearest_scans(spark, run):
    w = spark.createDataFrame([(1, 1, 0.0, 500.0, 0.6, 2.4)], WINDOW.replace("window_id int,", "window_id int, run int,"))
    assert rows(chrom.xic_snapped(*run, w), "scan", "intensity") == [(11, 1.0), (13, 6.0)]


def test_empty_run(spark, run):
    none = run[0].where("run = 9")
    assert tuple(chrom.scan_bounds(none).first()) == (0, 0, -1)
    assert chrom.tic(none, run[1]).count() == 0
    assert rows(chrom.time_domain(run[0]), "t0", "t1") == [(0.0, 3.0)]
    assert rows(chrom.best_level(run[0].where("level = 2")), "level") == [(2,)]


def test_asof_ties_and_ends(spark):
    right = spark.createDataFrame([(1.0, 5), (1.0, 8), (3.0, 2), (7.0, 4)], "t double, v int")
    left = spark.createDataFrame([(0.0,), (1.0,), (2.0,), (4.9,), (5.0,), (9.0,)], "x double")
    assert rows(joins.asof_nearest(left, "x", right, "t", "v"), "x", "match") == [(0.0, 8), (1.0, 8), (2.0, 2), (4.9, 2), (5.0, 4), (9.0, 4)]
    assert [r["match"] for r in joins.asof_backward(left, "x", right, "t", "v").orderBy("x").collect()] == [None, 8, 8, 2, 2, 4]


def test_band_and_interval_join_bounds(spark):
    a = spark.createDataFrame([(1, 10.0), (2, 10.5)], "i int, a double")
    b = spark.createDataFrame([(1, 10.5), (2, 11.0), (3, 9.5)], "j int, b double")
    assert rows(joins.band_join(a, "a", b, "b", F.lit(0.5), 0.5), "i", "j") == [(1, 1), (1, 3), (2, 1), (2, 2)]
    assert rows(joins.band_join(a, "a", b, "b", F.lit(0.5), 0.5, closed=False), "i", "j") == [(2, 1)]
    iv = spark.createDataFrame([(1, 9.5, 10.5), (2, 11.0, 10.0), (3, None, 20.0)], "k int, lo double, hi double")
    assert rows(joins.interval_join(b, "b", iv, "lo", "hi", 0.3), "j", "k") == [(1, 1), (3, 1)]


def line(spark, *ys, key="c"):
    return spark.createDataFrame([(key, i + 1, float(i), float(y)) for i, y in enumerate(ys)], "channel string, i int, t double, y double")


@pytest.mark.parametrize(
    ("ys", "tops", "lows"),
    [
        ([1, 3, 1], [2], [1, 3]),
        ([3, 3, 1, 2], [4], [3]),  # a leading plateau never counts
        ([1, 2, 2], [3], [1]),  # a trailing one does, at its right end
        ([1, 2, 2, 1], [3], [1, 4]),
        ([2, 2, 2], [], []),
        ([5], [], []),
    ],
)
def test_extrema(spark, ys, tops, lows):
    got = series.extrema(line(spark, *ys), ["channel"]).collect()
    assert sorted(r["i"] for r in got if r["kind"] == 1) == tops and sorted(r["i"] for r in got if r["kind"] == -1) == lows


@pytest.mark.parametrize(("t0", "t1", "how", "want"), [(0, 3, "keep", 3.0), (3, 0, "keep", 3.0), (0.5, 1.0, "keep", 0.75), (-5, 1, "keep", 1.0), (5, 9, "keep", 0.0), (1, 1, "keep", 0.0)])
def test_area(spark, t0, t1, how, want):
    s = line(spark, 0, 2, 0, 2)
    r = spark.createDataFrame([("c", float(t0), float(t1))], "channel string, t0 double, t1 double")
    assert abs(series.area(s, r, ["channel"], how).first()["area"] - want) < 1e-12


def test_area_below_the_axis(spark):
    s = line(spark, 1, -1, -1)
    r = spark.createDataFrame([("c", 0.0, 2.0)], "channel string, t0 double, t1 double")
    assert [round(series.area(s, r, ["channel"], how).first()["area"], 9) for how in ("keep", "clamp", "drop")] == [-1.0, 0.0, 0.25]


def test_interpolation_edges(spark):
    s = spark.createDataFrame([("c", 1.0, 10.0), ("c", 3.0, 30.0)], "channel string, t double, y double")
    q = spark.createDataFrame([("c", x) for x in (0.0, 1.0, 2.0, 3.0, 4.0)], "channel string, x double")
    assert [r["value"] for r in joins.interpolate(q, "x", s, "t", "y", ["channel"]).orderBy("x").collect()] == [0.0, 10.0, 20.0, 30.0, 0.0]
    assert [r["value"] for r in joins.interpolate(q, "x", s, "t", "y", ["channel"], True).orderBy("x").collect()] == [10.0, 10.0, 20.0, 30.0, 30.0]


def test_moving_windows_shift_inward(spark):
    got = [r["y"] for r in series.moving(line(spark, 9, 1, 5, 3, 7), ["channel"], 1, "median").orderBy("i").collect()]
    assert got == [5.0, 5.0, 3.0, 5.0, 5.0]
    assert [r["y"] for r in series.moving(line(spark, 1, 2), ["channel"], 3, "avg").orderBy("i").collect()] == [1.5, 1.5]


def test_convolution(spark):
    s = line(spark, 1, 0, 0, 4)
    assert [r["y"] for r in series.convolve(s, ["channel"], [1.0, 2.0, 3.0]).orderBy("i").collect()] == np.convolve([1, 0, 0, 4], [1, 2, 3], "same").tolist()
    assert [r["y"] for r in series.convolve(s, ["channel"], [0.25, 0.5, 0.25], True).orderBy("i").collect()] == [0.75, 0.25, 1.0, 3.0]
    with pytest.raises(ValueError):
        series.convolve(s, ["channel"], [1.0, 1.0])
    assert abs(sum(series.gaussian_kernel(1.5)) - 1) < 1e-12


def test_islands_and_resampling(spark):
    s = spark.createDataFrame([("c", x) for x in (1.0, 1.5, 2.0, 5.0, 5.1, 9.0)], "channel string, t double")
    assert rows(series.islands(s, ["channel"], "t", 0.5, 2), "lo", "hi", "n") == [(1.0, 2.0, 3), (5.0, 5.1, 2)]
    assert [r["y"] for r in series.resample(line(spark, 0, 10, 20), ["channel"], 5).orderBy("k").collect()] == [0, 5, 10, 15, 20]


def _line(spark, *lines):
    rows_ = [(c, i, float(i), float(v)) for c, y in zip("abcdefg", lines) for i, v in enumerate(y)]
    return spark.createDataFrame(rows_, "channel string, i int, t double, y double")


def test_peaks_and_zscore(spark):
    y = [0, 1, 5, 1, 2, 1, 6, 0, 3, 2.5, 3, 0.0]
    s = _line(spark, y, [0, 5], [0, 5, 4], [3, 3], [9, 1, 2])
    assert rows(series.peaks(s, "channel", 2.0), "channel", "i") == [("a", 2), ("a", 6), ("a", 8), ("b", 1), ("c", 1), ("e", 0)]
    assert rows(series.peaks(s, "channel", 4.5), "channel", "i") == [("a", 6), ("b", 1), ("c", 1), ("e", 0)]
    assert rows(series.peaks(_line(spark, y), "channel", 2.0, -1), "i") == [(0,), (3,), (7,), (11,)]
    assert rows(series.nth_maximum(s, "channel", 1), "channel", "value") == [("a", 5.0), ("b", 5.0), ("c", 5.0), ("d", 0.0), ("e", 2.0)]
    assert rows(series.peaks_relative(s.where("channel = 'a'"), "channel", 0.5, 0), "i") == [(2,), (6,)]
    flat = _line(spark, np.r_[np.tile([1.0, 1.1], 20), 9.0, 9.0, np.tile([1.0, 1.1], 5)], np.r_[np.tile([1.0, 1.1], 20), 9.0], [1.0])
    flags = series.zscore_flags(flat, "channel", 10, 4.0, 0.0)
    assert rows(flags, "channel", "i", "flag") == [("a", 40, 1), ("a", 41, 1), ("b", 40, 1)]
    assert rows(series.flag_intervals(flat, flags, "channel"), "channel", "first", "last") == [("a", 40, 41)]


def test_ladder_and_delta_masses(spark):
    m, w, p = chem.RESIDUES, chem.WATER, chem.PROTON
    peptides = spark.createDataFrame([(1, "GAK"), (2, "R"), (3, ""), (4, None)], "id int, seq string")
    mods = spark.createDataFrame([(1, 2, 16.0)], "id int, position int, delta double")
    got = rows(sequences.ladder(peptides, ["id"], modifications=mods), "id", "ion", "k", "mass")
    g, a, k = m["G"], m["A"] + 16, m["K"]
    want = [(1, "b", 1, g + p), (1, "b", 2, g + a + p), (1, "y", 1, k + w + p), (1, "y", 2, a + k + w + p), (1, "y", 3, g + a + k + w + p), (2, "y", 1, m["R"] + w + p)]
    assert [r[:3] for r in got] == [r[:3] for r in want] and all(abs(x[3] - y[3]) < 1e-9 for x, y in zip(got, want))
    sites = spark.createDataFrame([("p", 1, 16.0, 0.3), ("p", 2, 16.0, 0.1), ("q", 1, 1.0, 0.5)], "protein string, site int, delta double, fraction double")
    got = [(a, d, round(f, 9)) for a, d, f in rows(convolve.delta_masses(sites), "protein", "delta", "fraction")]
    assert got == [("p", 0.0, 0.63), ("p", 16.0, 0.34), ("p", 32.0, 0.03), ("q", 0.0, 0.5), ("q", 1.0, 0.5)]
    with pytest.raises(Exception, match="exceed 1"):
        convolve.delta_masses(spark.createDataFrame([("p", 1, 16.0, 1.3)], sites.schema)).collect()


def test_against_all_in_blocks(spark):
    """Blocks of any size give the same pairs, also for vectors of other lengths, null ones and ones with nulls, and vectors aren't sent once for each block of 256."""
    v = [[1.0, 2.0], [3.0, -1.0], [0.5], None, [], [1.0, None], [2.0, 2.0]]
    df = spark.createDataFrame(list(enumerate(v)), "id long, v array<double>")
    dot = lambda a, b: 0.0 if a is None or b is None or len(a) != len(b) else None if None in a + b else sum(x * y for x, y in zip(a, b))
    want = sorted((i, j, dot(v[i], v[j])) for i in (0, 2, 3, 5) for j in range(len(v)) if i != j)
    for block in (1, 3, 1024):
        out = spectra.against_all(df.where("id in (0, 2, 3, 5)"), df, block)
        assert sorted(tuple(r) for r in out.select("a", "b", "s").collect()) == want
    assert "FlatMapCoGroupsInArrow" in out._jdf.queryExecution().executedPlan().toString()


def test_against_all_rounds_and_orders(spark):
    """Vectors prepared in the tasks as the column functions would, halves away from 0, no negative zeros, no pairs of null or equal ids."""
    v = [[1.0, 2.0], [3.0, -1.0], [-0.4, 0.0], None, [], [1.0, None], [0.0, 0.0], [7.0, 7.0], [float("nan"), 1.0]]
    df = spark.createDataFrame([*enumerate(v), (None, [1.0, 1.0]), (0, [0.5, 0.25])], "id long, v array<double>")
    for numpy, column in ((spectra.unit_rows, spectra.unit), (spectra.centred_unit_rows, lambda c: spectra._let(spectra.centred(c), spectra.unit))):
        whole = df.select("id", F.when((F.size("v") > 0) & ~F.exists("v", F.isnull), column(F.col("v"))).otherwise(F.col("v")).alias("v"))
        want = sorted(map(str, spectra.against_all(whole.where("id % 2 = 0"), whole).withColumn("s", F.round("s", 5)).collect()))
        got = spectra.against_all(df.where("id % 2 = 0"), df, 2, numpy, 5)
        assert sorted(map(str, got.collect())) == want
    one = spark.createDataFrame([(0, [1.0])], "id long, v array<double>")
    some = spark.createDataFrame([(k, [x]) for k, x in enumerate([2.5, -2.5, 0.5, -0.2, 3.0], 1)], "id long, v array<double>")
    assert [str(r["s"]) for r in spectra.against_all(one, some, digits=0).collect()] == ["-3.0", "0.0", "1.0", "3.0", "3.0"]


def test_pairs_of_vectors_are_small_files(spark, tmp_path):
    """Values equal after rounding stand together, so that the three columns are codes: 7.6 bytes a pair in order of the vectors."""
    from scanloom.plans import spectra_queries

    v = np.random.default_rng(2).normal(size=(4000, 64))
    spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<float>").coalesce(1).write.parquet(str(tmp_path / "embeddings.parquet"))
    for q in (spectra_queries.pairwise_cosine, spectra_queries.pairwise_pearson):
        out = tmp_path / q.__name__
        q(spark, str(tmp_path)).write.parquet(str(out))
        assert spark.read.parquet(str(out)).count() == 200 * 3999
        assert sum(f.stat().st_size for f in out.glob("*.parquet")) < 5 * 200 * 3999


def test_best_within_makes_no_pairs(spark):
    """The first of all in reach, as by comparing all pairs; one of 3,000 right rows in reach of each of 300 left ones, and no join is left in the plan."""
    rng = np.random.default_rng(5)
    known = [(int(i % 2), float(rng.integers(0, 400)) / 8, float(rng.integers(0, 60)), None if i % 97 == 0 else float(rng.integers(0, 9)), f"s{rng.integers(0, 50)}") for i in range(3000)]
    found = [(i, i % 2, m := float(rng.integers(0, 400)) / 8, m / 50, t := float(rng.integers(0, 60)), t + float(rng.integers(0, 20))) for i in range(300)] + [(300, 0, float("nan"), 1.0, 0.0, 9.0), (301, 0, None, 1.0, 0.0, 9.0)]
    left = spark.createDataFrame(found, "id int, run int, _at double, _reach double, _from double, _to double").withColumns({"_lo": F.col("_at") - F.col("_reach"), "_hi": F.col("_at") + F.col("_reach")})
    right = spark.createDataFrame(known, "run int, x double, y double, z double, s string")
    rank = lambda r: (r[3] is not None, -(r[3] or 0.0), r[4])
    for y in ("y", None):
        out = joins.best_within(left, "id", right, "x", [-F.col("z"), F.col("s")], 1.0, ["run"], y)
        want = []
        for i, run, m, d, a, b in found[:300]:
            near = [r for r in known if r[0] == run and abs(m - r[1]) <= d and (y is None or a <= r[2] <= b)]
            want += [(i, *min(map(rank, near)))] if near else []
        assert [(r["id"], r["z"] is not None, -(r["z"] or 0.0), r["s"]) for r in out.orderBy("id").collect()] == want
        assert "Join" not in out._jdf.queryExecution().executedPlan().toString()
    assert 0 < len(want) <= 300


def test_spectra(spark):
    p = spark.createDataFrame([(1, 10.0, 5.0), (1, 20.0, 5.0), (1, 30.0, 1.0), (2, 5.0, -3.0)], "scan int, mz double, intensity double")
    a = spectra.as_arrays(p).select("scan", spectra.sum_in_range(F.col("points"), F.lit(10.0), F.lit(20.0)).alias("s"), spectra.sum_in_range(F.col("points"), F.lit(10.0), F.lit(30.0), False).alias("o"), spectra.max_in_range(F.col("points"), F.lit(0.0), F.lit(9.0)).alias("m"), spectra.closest_index(F.col("points"), F.lit(15.0)).alias("i"))
    assert rows(a, "scan", "s", "o", "m", "i") == [(1, 10.0, 5.0, 0.0, 0), (2, 0.0, 0.0, 0.0, 0)]
    assert rows(spectra.decimate(p, ["scan"], 0.04), "scan", "bucket", "mz") == [(1, 0, 10.0), (1, 1, 30.0), (2, 0, 5.0)]
    v = spark.createDataFrame([([1.0, 2.0], [2.0, 4.0], [1.0]), ([0.0, 0.0], [1.0, 1.0], [1.0])], "a array<double>, b array<double>, c array<double>")
    assert [[round(x, 9) for x in r] for r in v.select(spectra.cosine(F.col("a"), F.col("b")), spectra.cosine(F.col("a"), F.col("c")), spectra.pearson(F.col("a"), F.col("b"))).collect()] == [[1.0, 0.0, 1.0], [0.0, 0.0, 0.0]]
    assert spectra.statistics(spark.createDataFrame([(1, 1.0, float(x)) for x in (4, 1, 3, 2)], "scan int, mz double, intensity double"), ["scan"]).first()["median"] == 3.0


def test_dbscan_against_brute_force(spark):
    rng = random.Random(4)
    pts = [(i, rng.choice([0, 20, 50]) + rng.gauss(0, 2), rng.choice([0, 20]) + rng.gauss(0, 2)) for i in range(150)] + [(900, 200.0, 200.0)]
    near = {i: [j for j, u, v in pts if (x - u) ** 2 + (y - v) ** 2 < 1.5**2] for i, x, y in pts}
    core = {i for i in near if len(near[i]) >= 4}
    label = {i: i for i in core}
    for _ in pts:
        label = {i: min(label[j] for j in near[i] if j in core) for i in core}
    want = {i: label[i] if i in core else min((label[j] for j in near[i] if j in core), default=-1) for i in near}
    got = dict(rows(cluster.dbscan(spark.createDataFrame(pts, "id long, x double, y double"), "id", "x", "y", 1.5, 4), "id", "label"))
    assert got == want


def test_dbscan_of_dense_cells(spark):
    """Cells that are core without pairs, two of them linked by their outermost points or only by others, and a null coordinate."""
    rng = random.Random(8)
    pts = [(i, rng.gauss(0, 0.3), rng.gauss(0, 0.3)) for i in range(300)] + [(1000 + i, 1.2 + rng.random() * 0.3, rng.random() * 3) for i in range(200)] + [(2000 + i, 4.0, 4.0) for i in range(3)]
    near = {i: [j for j, u, v in pts if (x - u) ** 2 + (y - v) ** 2 < 0.5**2] for i, x, y in pts}
    core = {i for i in near if len(near[i]) >= 5}
    label, changed = {i: i for i in core}, True
    while changed:
        now = {i: min(label[j] for j in near[i] if j in core) for i in core}
        changed, label = now != label, now
    want = {i: label[i] if i in core else min((label[j] for j in near[i] if j in core), default=-1) for i in near} | {9999: -1}
    df = spark.createDataFrame([*pts, (9999, None, 1.0)], "id long, x double, y double")
    assert dict(rows(cluster.dbscan(df, "id", "x", "y", 0.5, 5), "id", "label")) == want


def test_greedy_groups_against_the_loop(spark):
    rng = random.Random(6)
    f = [(i, rng.choice([300.0, 300.01, 300.02, 500.0, 799.999]) * (1 + rng.gauss(0, 8e-6)), rng.uniform(0, 3)) for i in range(300)]
    seed: dict = {}
    order = sorted(f, key=lambda x: (x[2], x[0]))
    for i, m, t in order:
        if i not in seed:
            for j, n, u in order:
                if j not in seed and u >= t and u - t <= 0.08 and abs(n - m) <= m * 15 / 1e6:
                    seed[j] = i
    got = dict(rows(cluster.greedy_groups(spark.createDataFrame(f, "id long, mass double, rt double"), 15.0, 0.08), "id", "seed"))
    # equal times: those before the seed in order aren't taken
    assert got == seed


def test_group_tolerances(spark):
    def same(mass, rt):
        return cluster.greedy_groups(spark.createDataFrame([(1, 1000.0, 1.0), (2, mass, rt)], "id long, mass double, rt double"), 15.0, 0.08).select("seed").distinct().count() == 1

    assert same(1000.015, 1.0) and not same(1000.051, 1.0) and same(1000.0, 1.0799999) and not same(1000.0, 1.0801)


def test_consolidate_and_collate(spark):
    m = spark.createDataFrame([(1, 1, 7, 1.0, 2.0, 5.0), (1, 1, 8, 0.5, 1.5, 9.0), (1, 2, 9, 0.0, 1.0, 1.0)], "master int, sample int, feature int, start double, end double, intensity double")
    assert rows(cluster.consolidate(m), "sample", "feature", "start", "end") == [(1, 8, 0.5, 2.0), (2, 9, 0.0, 1.0)]
    c = spark.createDataFrame([(0, 1.0, 100.0, 5.0, 2), (0, 2.0, 100.1, 9.0, 3), (0, 3.0, 100.2, 4.0, 2), (-1, 0.0, 1.0, 99.0, 1)], "label int, rt double, mass double, intensity double, charge int")
    assert [tuple(r) for r in cluster.collate(c).collect()] == [(1, 1.0, 3.0, 2.0, 100.1, 3, 9.0, "3,2")]


def test_roll_up(spark):
    t = spark.createDataFrame([("a", "x", 1.0, "m", 1), ("a", "x", 2.0, "m", 2), ("a", "y", 2.0, "n", 3), ("b", "z", None, "", 4)], "g string, h string, v double, s string, o int")
    got = report.roll_up(t, ["g", "h"], {"r": report.value_range("v"), "l": report.value_list("s", "o"), "d": report.dash_if_different("s"), "e": report.dash_if_different("s", True), "s": report.total("v", 1)})
    by = {(r["g"], r["h"]): r for r in got.collect()}
    assert by["a", "x"]["r"] == "1.00 - 2.00" and by["a", "y"]["r"] == "2.00" and by["b", "z"]["r"] == ""
    assert by[None, None]["l"] == "m; n" and by[None, None]["d"] == "--" and by["a", "x"]["d"] == "m" and by["a", None]["s"] == "5.0"
    assert by[None, None]["e"] == "--" and by["b", None]["e"] == "" and by[None, None]["depth"] == 0 and by["a", "x"]["depth"] == 2
    assert report.roll_up_children(t, ["g", "h"], "s", "o")[0].where("g = 'a'").first()["s"] == "m; n"


def test_tiles(spark):
    c = spark.createDataFrame([(0, 0, 5.0), (1, 0, 5.0), (0, 1, 1.0), (5, 5, 3.0), (4, 5, 2.0)], "bx long, bt long, v double")
    assert rows(tiles.tile_max(c, 4, 4), "tx", "ty", "bx", "v") == [(0, 0, 1, 5.0), (1, 1, 5, 3.0)]
    assert rows(tiles.local_max_2d(c), "bx", "bt") == [(5, 5)]
    assert rows(tiles.half(c), "bx", "bt", "v") == [(0, 0, 2.75), (2, 2, 1.25)]
    assert tiles.with_partner(tiles.local_max_2d(spark.createDataFrame([(0, 0, 5.0), (3, 0, 5.5)], "bx long, bt long, v double")), 3, 1.0).count() == 2


def test_warp_edges_and_inverse(spark):
    a = spark.createDataFrame([("c", 1.0, 2.0), ("c", 3.0, 6.0)], "channel string, t_src double, t_dst double")
    q = spark.createDataFrame([("c", x) for x in (0.0, 1.0, 2.0, 3.0, 9.0)], "channel string, t double")
    assert [r["warped"] for r in align.warp(q, "t", a, ["channel"]).orderBy("t").collect()] == [1.0, 2.0, 4.0, 6.0, 6.0]
    back = align.warp(align.warp(q.where("t between 1 and 3"), "t", a, ["channel"]), "warped", a, ["channel"], True, "back")
    assert all(abs(r["t"] - r["back"]) < 1e-12 for r in back.collect())


def test_warp_path_finds_a_shift():
    t = np.arange(64)
    peak = lambda c: np.exp(-0.5 * ((t - c) / 3) ** 2)
    a, b = peak(20) + peak(44), peak(23) + peak(44)
    path = align.warp_path(a, b, 8, 4)
    moved = np.interp(np.interp(t, *zip(*path)), t, b)
    assert ((a - moved) ** 2).sum() < 0.2 * ((a - b) ** 2).sum() and path[0] == (0, 0) and path[-1] == (63, 63)


def test_calibration(spark):
    p = spark.createDataFrame([("r", float(t), 500.0 + 0.001 * t, 10.0) for t in range(40)], "run string, t double, mz double, intensity double")
    c = calibrate.fit(p, 500.0, 200.0, ["run"])
    out = calibrate.calibrate(p, c.withColumns({"c1": F.lit(0.0), "c2": F.lit(0.0)}), ["run"])
    assert max(abs(r["mz"] - 500) for r in out.where("t between 5 and 34").collect()) < 1e-9
    assert calibrate.fit(p.where("t < 5"), 500.0, 200.0, ["run"]).count() == 0
    l = calibrate.lockmass_points(spark.createDataFrame([(1, 500.001, 3.0), (1, 499.999, 5.0), (2, 400.0, 1.0)], "scan int, mz double, intensity double"), spark.createDataFrame([(500.0,)], "mass double"), 10.0)
    assert rows(l.where("scan = 1"), "mz", "intensity") == [(499.999, 5.0)] and l.where("scan = 2").first()["mz"] is None


def test_chemistry(spark):
    d = spark.createDataFrame([("pep-TIDEk r",)], "s string").select(chem.clean(F.col("s")).alias("s"))
    r = d.select("s", chem.peptide_mass(F.col("s")).alias("m"), chem.digest(F.col("s")).alias("d"), chem.fragments(F.substring("s", 1, 3)).alias("f")).first()
    assert r["s"] == "PEPTIDEKR" and r["d"] == ["PEPTIDEK", "R"] and len(r["f"]) == 4 and [x["mass"] for x in r["f"]] == sorted(x["mass"] for x in r["f"])
    assert math.isclose(r["m"], 799.35997 + 128.09496 + 156.10111, abs_tol=1e-3)
    m = spark.createDataFrame([(1000.0, 2)], "m double, z int").select(chem.mass_of(chem.mz_of(F.col("m"), F.col("z")), F.col("z")).alias("b"), chem.modification_mass(F.lit("Oxidation/15.99)")).alias("o"), chem.modification_mass(F.lit("none")).alias("n")).first()
    assert math.isclose(m["b"], 1000.0) and m["o"] == 15.99 and m["n"] == 0.0
    comb = spark.createDataFrame([([(500.0 + k * chem.C13_GAP / 3, 10.0 - k) for k in range(4)],)], "p array<struct<x:double,y:double>>")
    assert comb.select(chem.charge_by_comb(F.col("p"), F.lit(500.0))).first()[0] == 3


def test_scan_clusters_find_planted_charges():
    mz, y = [], []
    for mass, z, top in ((1500.0, 2, 1000.0), (2400.0, 3, 600.0)):
        k = np.arange(5)
        env = np.exp(k * np.log(mass * 0.00055) - np.cumsum(np.log(np.maximum(k, 1))))
        mz += list((mass + z * chem.PROTON) / z + k * chem.C13_GAP / z)
        y += list(top * env / env.max())
    o = np.argsort(mz)
    found = features.scan_clusters(np.array(mz)[o], np.array(y)[o], 0.02, 6, 0.6)
    assert {c[2] for c in found[:2]} == {2, 3}


def test_compare(spark):
    a, b = spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(2,), (3,)], "k int")
    assert rows(compare.both(a, b, "k"), "k") == [(2,)] and rows(compare.only(a, b, "k"), "k") == [(1,)]


def test_ladder_totals_are_those_of_the_ladder_without_a_shuffle(spark):
    rng = np.random.default_rng(9)
    words = ["", None, "K", "B", "AéG", *("".join(rng.choice(list("ACDEFGHIKLMNPQRSTVWY"), n)) for n in [1, 2, 3, 7, 7, 40, 41, 3000, *rng.integers(1, 60, 200)])]
    peptides = spark.createDataFrame(list(enumerate(words)), "id long, seq string")
    f = sequences.ladder(peptides, ["id"]).groupBy("id")
    m, w = F.col("mass"), F.col("weight")
    want = {r["id"]: r for r in f.agg(F.count("*").alias("n"), F.sum(m).alias("mass"), F.sum(m * w).alias("weighted"), F.min(m).alias("least"), F.max(m).alias("most")).collect()}
    totals = sequences.ladder_totals(peptides, ["id"])
    assert "Exchange" not in totals._jdf.queryExecution().toString()
    got = {r["id"]: r for r in totals.collect()}
    assert got.keys() == want.keys()
    assert all(got[k]["n"] == r["n"] and np.allclose(list(got[k])[2:], list(r)[2:], rtol=1e-12, atol=0) for k, r in want.items())
