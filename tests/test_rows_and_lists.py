"""Row tables, lists of points, envelopes: boundary cases and closed forms."""

import numpy as np
from pyspark.sql import functions as F

from scanloom.functions.averagine import envelope
from scanloom.operators import calibrate, chrom, compare, features, rows, series, spectra, tiles
from scanloom.sources import files


def got(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str)


def test_envelopes():
    for mass in (0.0, 500.0, 1234.5, 9000.0, 60_000.0):
        n = 40 if mass < 20_000 else 120
        assert abs(envelope(mass, n).sum() - 1) < 1e-6
    assert envelope(0.0, 3).tolist() == [1, 0, 0]
    # The second isotope overtakes the first near 1,800 Da, and the mean rises by about 0.062 % of the mass.
    assert envelope(1500.0, 5).argmax() == 0 and envelope(2200.0, 5).argmax() == 1
    assert abs((envelope(10_000.0, 60) * np.arange(60)).sum() - 6.2) < 0.3


def test_indexes_and_spacing(spark):
    p = spark.createDataFrame([(1, [(1.0, 5.0), (2.0, 9.0), (2.5, 8.0), (4.0, 7.0)]), (2, [])], "scan int, points array<struct<x:double,y:double>>")
    at = lambda x: spectra.index_at_or_below(F.col("points"), F.lit(x))
    assert [tuple(r) for r in p.where("scan = 1").select(at(0.5), at(1.0), at(3.0), at(4.0), at(4.1)).collect()] == [(-1, 0, 2, 3, -2)]
    assert p.where("scan = 2").select(at(1.0)).first()[0] == -2
    s = lambda a, b: spectra.sum_by_index(F.col("points"), F.lit(a), F.lit(b))
    assert [tuple(r) for r in p.where("scan = 1").select(s(1.5, 2.2), s(0.0, 1.0), s(0.0, 0.5), s(9.0, 9.0)).collect()] == [(14.0, 5.0, 0.0, 7.0)]
    top = lambda k, d: F.transform(spectra.spaced_top_k(F.col("points"), k, d), lambda q: q["x"])
    assert [tuple(r) for r in p.orderBy("scan").select(top(3, 1.0), top(2, 0.0), top(0, 1.0)).collect()] == [([2.0, 4.0, 1.0], [2.0, 2.5], []), ([], [], [])]


def test_rows(spark):
    old, new = spark.createDataFrame([(1, "a"), (2, "b"), (None, "n")], "k int, v string"), spark.createDataFrame([(2, "B"), (3, "C")], "k int, v string")
    assert got(rows.replaced(old, new, ["k"]), "k", "v") == [(1, "a"), (2, "B"), (3, "C"), (None, "n")]
    assert got(rows.matching(old, {"k": None}), "v") == [("n",)] and rows.matching(old, {"k": 9}).count() == 0
    assert rows.columns_by_header(old, ["v", "w", "v"]).columns == ["v", "w"] and rows.with_columns_once(old, {"k": 0, "z": 1}, True).columns == ["z", "k", "v"]
    assert got(rows.appended(old.where("k = 1"), new.select("v")), "k", "v") == [(1, "a"), (None, "B"), (None, "C")]
    assert got(rows.first_row_per_group(new.union(new).withColumn("g", F.lit(1)), ["g"], ["k"]), "g", "k", "v") == [(1, 2, "B")]
    assert rows.first_in_order(old, ["v"], {"k": 7}).count() == 0
    near = spark.createDataFrame([(1, 1.0), (1, 1.0 + 1e-16), (1, 1.1), (2, 1.0)], "g int, x double")
    assert got(rows.without_near_duplicates(near, ["g"], "x"), "g", "x") == [(1, 1.0), (1, 1.1), (2, 1.0)]


def test_lists_compared(spark):
    kind = "k int, x double, y double"
    a, b = spark.createDataFrame([(1, 1.0, 2.0), (1, 2.0, 2.0), (2, 1.0, 1.0)], kind), spark.createDataFrame([(1, 1.05, 2.0), (3, 1.0, 1.0)], kind)
    assert got(compare.difference_by_index(a, b, ["k"], "x", "y"), "k", "i", "xa", "xb") == [(1, 2, 2.0, None), (2, 1, 1.0, None), (3, 1, None, 1.0)]
    assert got(compare.only_by_coordinate(a, b, ["k"], "x"), "k", "x") == [(1, 2.0), (2, 1.0)]
    assert got(compare.aligned_cosine(a, a, ["k"], "x", "y").withColumn("s", F.round("s", 9)), "k", "s") == [(1, 1.0), (2, 1.0)]
    assert got(compare.aligned_cosine(a, b, ["k"], "x", "y"), "k", "s") == [(1, 0.0), (2, 0.0), (3, 0.0)]
    v = spark.createDataFrame([([1.0, 2.0], [1.05, 2.0], [1.0])], "a array<double>, b array<double>, c array<double>")
    assert tuple(v.select(spectra.alike(F.col("a"), F.col("b"), 0.1), spectra.alike(F.col("a"), F.col("b"), 0.01), spectra.alike(F.col("a"), F.col("c"), 9.0)).first()) == (True, False, False)


def test_levels_grids_and_functions(spark):
    p = spark.createDataFrame([(1, float(i)) for i in (4, 1, 3, 2, 2)] + [(2, 7.0)], "g int, intensity double")
    assert got(spectra.nth_element(p, ["g"], 0.5), "g", "value") == [(1, 2.0), (2, 7.0)] and got(spectra.nth_element(p, ["g"], 0.99), "g", "value") == [(1, 4.0), (2, 7.0)]
    g, o = spark.createDataFrame([(1, 5.0)], "bin int, y double"), spark.createDataFrame([(1, 2.0), (2, 1.0)], "bin int, y double")
    assert got(tiles.accumulated(g, o, [], -1.0), "bin", "y") == [(1, 3.0), (2, -1.0)]
    assert tuple(spark.range(1).select(*[tiles.zoom_level(F.lit(float(w)), F.lit(100.0)) for w in (10, 100, 399, 400)]).first()) == (0, 0, 1, 2)
    peaks = spark.createDataFrame([(1, s, 9, 556.2771) for s in range(10)] + [(2, s, 9, 100.0 + s) for s in range(20)] + [(3, s, 3, 556.2) for s in range(20)], "function int, scan int, n int, mz double")
    assert got(calibrate.calibration_functions(peaks), "function", "mz") == [(1, 556.2)]


def test_noise_and_calibration(spark):
    mz, y = np.array([1.0, 1.01, 5.0, 9.0, 12.0]), np.array([100.0, 1.0, 1.0, 1.2, 1.1])
    kept, _ = features.above_noise(mz, y, 3.0, 0.02)
    assert kept.tolist() == [1.0, 1.01]
    points = spark.createDataFrame([(1, 0.0, 100.0), (1, 5.0, 100.0), (1, 20.0, 200.0)], "run int, t double, mz double")
    errors = spark.createDataFrame([(1, 0.0, 0.1), (1, 10.0, 0.3)], "run int, t double, c0 double")
    assert [round(r[0], 6) for r in got(calibrate.calibrate_ppm(points, errors, 100.0, ["run"]), "mz")] == [199.4, 99.8, 99.9]


def test_smooth_centroids(spark):
    y = [0, 0, 1, 4, 9, 4, 1, 0, 0, 1, 3, 1, 0, 0, 0, 0, 0, 2, 8, 2, 0.0]
    s = spark.createDataFrame([(1, i, float(i), float(v)) for i, v in enumerate(y, 1)], "k int, i int, t double, y double")
    kernel = series.gaussian_kernel(1.0)
    smooth = np.convolve(np.pad(y, 4, "edge"), kernel, "valid")
    tops = [i for i in range(1, len(y) - 1) if smooth[i - 1] < smooth[i] > smooth[i + 1]]
    want = sorted(((sum((i + 1 + d) * smooth[i + d] for d in (-1, 0, 1)) / smooth[i - 1 : i + 2].sum()), smooth[i]) for i in tops)
    out = [(t, y_) for t, y_ in got(series.smooth_centroids(s, ["k"], 1.0, 0.0, 10), "t", "y")]
    assert len(tops) == 3 and np.allclose(sorted(out), want)
    near = series.smooth_centroids(s, ["k"], 1.0, 7.0, 10).count()
    assert near == 2 and series.smooth_centroids(s, ["k"], 1.0, 0.0, 1).count() == 1


def test_checkpointed_range_sums(spark):
    rng = np.random.default_rng(3)
    points = [(1, i, float(m), float(rng.integers(1, 9))) for i in range(1, 41) for m in np.sort(rng.uniform(0, 20, rng.integers(0, 5)))]
    df = spark.createDataFrame(points, "run int, idx int, mz double, intensity double")
    index = spark.createDataFrame([(1, i) for i in range(1, 41)], "run int, idx int")
    grid = chrom.interpolated_grid(df, 0.5)
    kept = chrom.checkpoint_scans(index, 6)
    assert sorted(r["at"] for r in kept.collect()) == [6, 12, 18, 24, 30, 36, 40]
    ranges = [(1, 1, 1, 40), (2, 1, 7, 9), (3, 1, 6, 6), (4, 1, 13, 33), (5, 1, 39, 999)]
    out = chrom.range_sum_checkpointed(grid, kept, chrom.checkpoints(grid, kept), spark.createDataFrame(ranges, "range_id int, run int, i0 int, i1 int"))
    want: dict = {}
    cells = [tuple(r) for r in grid.select("idx", "bin", "y").collect()]
    for k, _, a, b in ranges:
        for i, x, v in cells:
            want[k, x] = want.get((k, x), 0.0) + (v if a <= i <= b else 0.0)
    have = {(r["range_id"], r["bin"]): r["y"] for r in out.collect()}
    assert have.keys() == want.keys() and all(abs(have[k] - want[k]) < 1e-9 for k in want)


def test_checkpointed_range_sums_make_only_the_scans_between(spark):
    rng = np.random.default_rng(4)
    points = [(i, float(m), float(rng.integers(1, 9))) for i in range(1, 41) for m in np.sort(rng.uniform(0, 20, 4))]
    df = spark.createDataFrame(points, "scan int, mz double, intensity double")
    index = spark.createDataFrame([(1, i, i) for i in range(1, 41)], "run int, scan int, idx int")
    made = []

    def grid(some):
        made.append({r["idx"] for r in some.select("idx").collect()})
        return chrom.interpolated_grid(df.join(some, "scan").drop("scan"), 0.5)

    kept = chrom.checkpoint_scans(index, 6)
    ranges = spark.createDataFrame([(1, 1, 1, 40), (2, 1, 8, 9), (3, 1, 13, 32)], "range_id int, run int, i0 int, i1 int")
    prefixes = chrom.checkpoints(grid(chrom.with_checkpoint(index, kept)), kept)
    values = lambda out: {(r["range_id"], r["bin"]): round(r["y"], 9) for r in out.collect()}
    got = values(chrom.range_sum_checkpointed(grid, kept, prefixes, ranges, index))
    whole = chrom.interpolated_grid(df.join(index, "scan").select("run", "idx", "mz", "intensity"), 0.5)
    assert got == values(chrom.range_sum_checkpointed(whole, kept, chrom.checkpoints(whole, kept), ranges))
    assert made == [set(range(1, 41)), {7, 10, 11, 12, 31, 32}]


def test_calibrations_and_scans_on_disk(spark, tmp_path):
    c = spark.createDataFrame([(1, 2.0, 0.1, 0.0, 0.0), (1, 1.0, 0.2, 0.0, 0.0), (2, 1.0, 0.3, 0.0, 0.0)], "run int, t double, c0 double, c1 double, c2 double")
    files.write_calibration(c, f"{tmp_path}/calibration")
    assert got(files.read_calibration(spark, f"{tmp_path}/calibration"), "run", "t", "c0") == got(c, "run", "t", "c0")
    files.write_scans(spark.createDataFrame([(7, 2.0, 1.0), (7, 1.0, 5.0), (9, 1.0, 1.0)], "scan int, mz double, intensity double"), 1, 8, f"{tmp_path}/scans")
    assert [p.name for p in (tmp_path / "scans").iterdir() if p.is_dir()] == ["name=00000007"]
