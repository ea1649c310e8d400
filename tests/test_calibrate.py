"""Calibration by interpolated coefficients."""

from scanloom.operators import calibrate


def test_coefficients_are_looked_up_once_a_time(spark):
    """Points of one time share its coefficients; they are joined to the times, not sorted among them. Null times, runs without coefficients and the ends outside are as before."""
    points = spark.createDataFrame([(1, t, m) for t in (0.0, 5.0, 7.5, 20.0, None) for m in (100.0, 100.0, 200.0)] + [(2, 5.0, 100.0), (None, 5.0, 100.0)], "run int, t double, mz double")
    known = spark.createDataFrame([(1, 5.0, 1.0, 0.0, 0.0), (1, 10.0, 3.0, 0.01, 0.0)], "run int, t double, c0 double, c1 double, c2 double")
    out = calibrate.calibrate(points, known, ["run"])
    assert out.columns == points.columns
    got = sorted((r["t"], r["mz"]) for r in out.where("run = 1 and t is not null").collect())
    at = {0.0: (1.0, 0.0), 5.0: (1.0, 0.0), 7.5: (2.0, 0.005), 20.0: (3.0, 0.01)}
    want = sorted((t, m - (a + b * m)) for t, (a, b) in at.items() for m in (100.0, 100.0, 200.0))
    assert all(x[0] == y[0] and abs(x[1] - y[1]) < 1e-9 for x, y in zip(got, want, strict=True))
    assert out.count() == points.count()
    assert "Join" in out._jdf.queryExecution().optimizedPlan().toString()
