"""Charge clusters of scans."""

import numpy as np
import pyarrow as pa

from scanloom.operators import features


def test_scans_without_close_points_are_not_searched(spark):
    """Of many sparse scans only those with two points within a step of a comb are gone through; clusters are those of all."""
    rng = np.random.default_rng(3)
    rows_ = [(1, s, 0.0, float(m), float(y)) for s in range(400) for m, y in zip(np.r_[rng.random(3) * 900 + 50, [300.0, 300.0 + rng.random() * 3] if s % 5 == 0 else []], rng.integers(1, 9, 5))]
    df = spark.createDataFrame(rows_, "run int, scan long, rt double, mz double, intensity double")
    got = sorted((r["scan"], r["mz"], r["charge"], r["isotopes"]) for r in features.charge_clusters(df, tolerance=0.5).collect())
    want = []
    for s in range(400):
        top = sorted(((y, m) for _, t, _, m, y in rows_ if t == s), reverse=True)
        want += [(s, c[0], c[2], c[4]) for c in features.scan_clusters(np.array([m for _, m in top]), np.array([y for y, _ in top]), 0.5, 6, 0.6)]
    assert got == sorted(want) and len(got) > 10
    lists = pa.array([[{"mz": m} for m in v] for v in ([1.0, 500.0], [7.0, 2.0, 6.5], [], [3.0], [4.0, 4.0])])
    assert features.with_close_points(lists, 1.0).tolist() == [1, 4] and features.with_close_points(lists[1:3], 1.0).tolist() == [0]
