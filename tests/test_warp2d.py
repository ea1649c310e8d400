"""Warps over spectra: a planted warp, and the dynamic programme against plain recursion."""

import random
from functools import cache

import numpy as np

from scanloom.operators import warp2d


def gather(score, a, b, j, size):
    return sum(score.get((a + s, j + int(np.floor(s * size / (b - a) + 0.5))), 0.0) for s in range(1, b - a + 1))


def test_best_score_equals_recursion():
    rng = random.Random(3)
    for _ in range(40):
        last, high, segment, skew = rng.randint(4, 14), rng.randint(4, 14), rng.randint(2, 4), rng.randint(2, 4)
        score = {(i, j): rng.random() for i in range(last + 1) for j in range(high + 1) if rng.random() < 0.4 and abs(i - j) <= skew}
        ends = [*range(0, last, segment), last]

        @cache
        def most(k, j):
            if k == len(ends) - 1:
                return 0.0
            a, b = ends[k], ends[k + 1]
            found = [gather(score, a, b, j, size) + most(k + 1, j + size) for size in range(int(np.ceil((b - a) * 0.49)), int((b - a) * 1.51) + 1) if j + size <= high and abs(j + size - b) <= skew]
            return max(found, default=float("-inf"))

        want = max((score.get((0, j), 0.0) + most(0, j) for j in range(min(high, skew) + 1)), default=float("-inf"))
        path = warp2d.best_ends(score, 0, last, 0, high, segment, 0.51, skew)
        if want == float("-inf"):
            assert path == [(0, 0), (last, high)]
            continue
        assert [i for i, _ in path] == ends and all(abs(i - j) <= skew for i, j in path)
        got = score.get((0, path[0][1]), 0.0) + sum(gather(score, a, b, j, e - j) for (a, j), (b, e) in zip(path, path[1:]))
        assert abs(got - want) < 1e-9


def test_scores_against_loops(spark):
    rng = random.Random(5)
    rows = [(rng.randrange(2), rng.randrange(30), rng.choice([500.0, 500.004, 500.2, 700.0]) + rng.uniform(0, 0.01), float(rng.randint(0, 5))) for _ in range(250)]
    df = spark.createDataFrame(rows, "run int, idx int, mz double, intensity double").repartition(3)
    got = {(r["run"], r["i"], r["j"]): r["score"] for r in warp2d.scan_scores(df, df.where("run = 0").drop("run"), 4, 10.0).collect()}
    want: dict = {}
    total: dict = {}
    for r, i, _, y in rows:
        total[r, i] = total.get((r, i), 0.0) + y
    for r, i, m, y in rows:
        for r2, j, m2, y2 in rows:
            if r2 == 0 and y and y2 and abs(i - j) <= 4 and abs(m - m2) <= m2 * 10 / 1e6:
                want[r, i, j] = want.get((r, i, j), 0.0) + (y / total[r, i] * y2 / total[0, j]) ** 0.5
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_scores_in_slices_without_pairs_of_points(spark, monkeypatch):
    """Many equal and close points, work cut small: the same as by loops, and no join makes the pairs of points."""
    monkeypatch.setattr(warp2d, "ROWS_PER_GROUP", 5)
    rng = random.Random(6)
    rows = [(rng.choice(["a", "b", None]), rng.randrange(-9, 25), 100.0 + rng.randrange(400) / 1000, float(rng.randint(-1, 5))) for _ in range(600)]
    rows += [("b", 3, m, 2.0) for m in (0.0, -1.0, 1e-9, 1e9)] + [("a", 3, None, 1.0), ("a", 4, 1e9, None), ("a", 2, 1e9 * (1 + 9e-6), 1.0), ("b", None, 100.0, 1.0)]
    df = spark.createDataFrame(rows, "run string, idx int, mz double, intensity double").repartition(3)
    scores = warp2d.scan_scores(df, df.where("run = 'a'").drop("run"), 3, 10.0)
    got = {(r["run"], r["i"], r["j"]): r["score"] for r in scores.collect()}
    ok = [r for r in rows if None not in r[1:] and r[2] > 0 and r[3] > 0]
    want: dict = {}
    total: dict = {}
    for r, i, _, y in ok:
        total[r, i] = total.get((r, i), 0.0) + y
    for r, i, m, y in ok:
        for r2, j, m2, y2 in ok:
            if r2 == "a" and abs(i - j) <= 3 and abs(m - m2) <= m2 * 10.0 / 1e6:
                want[r, i, j] = want.get((r, i, j), 0.0) + (y / total[r, i] * y2 / total["a", j]) ** 0.5
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    plan = scores._jdf.queryExecution().optimizedPlan().toString()
    assert "cell" not in plan and not any("Join" in line and "mz" in line for line in plan.splitlines())
    assert warp2d.scan_scores(df, df.where("run = 'none'").drop("run"), 3, 10.0).collect() == []


def test_planted_warp_is_found(spark):
    rng = random.Random(9)
    base = [[(rng.uniform(300, 900), rng.uniform(10, 100)) for _ in range(12)] for _ in range(120)]
    rows = [(1, i, m, y) for i, s in enumerate(base) for m, y in s]

    def moved(i):  # the second run is late by up to six scans in the middle
        return i + round(6 * np.sin(np.pi * i / 119))

    seen = {moved(i): s for i, s in enumerate(base)}
    rows += [(2, i, m * (1 + rng.uniform(-5, 5) / 1e6), y * rng.uniform(0.7, 1.3)) for i, s in seen.items() for m, y in s]
    rows += [(3, 5, 2000.0, 1.0), (3, 60, 2000.0, 1.0)]
    df = spark.createDataFrame([*rows, (None, 1, 5.0, 1.0)], "run int, idx int, mz double, intensity double").repartition(4)
    got: dict = {}
    for r in warp2d.find_warps_2d(df, 1, segment=10, stretch=0.51, skew=10, ppm=20.0).collect():
        got.setdefault(r["run"], []).append((r["k"], r["i"], r["j"]))
    assert all(i == j for _, i, j in got[1])
    ends = sorted(got[2])
    at = np.interp([moved(i) for i in range(120)], [i for _, i, _ in ends], [j for _, _, j in ends])
    assert np.abs(at - np.arange(120)).mean() < 1.0
    assert sorted(got) == [1, 2, 3]
    assert warp2d.find_warps_2d(df, 99).collect() == []
