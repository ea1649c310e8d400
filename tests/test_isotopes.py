"""Overlapping isotope envelopes: planted ions, and least squares by plain algebra."""

import numpy as np

from scanloom.functions.averagine import envelope
from scanloom.functions.chem import C13_GAP, PROTON
from scanloom.operators import isotopes


def ion(mz, z, height, n=6):
    return [(mz + k * C13_GAP / z, float(height * f)) for k, f in enumerate(envelope((mz - PROTON) * z, n))]


def scan(ions, rng, noise=30):
    """Points of all ions; isotopes that fall on one place are one point."""
    sums: dict = {}
    for mz, z, height in ions:
        for x, y in ion(mz, z, height):
            place = next((p for p in sums if abs(p - x) < 0.004), x)
            sums[place] = sums.get(place, 0.0) + y
    return [*sums.items(), *((float(rng.uniform(300, 1200)), float(rng.uniform(0, 2))) for _ in range(noise))]


def test_planted_overlaps_are_told_apart(spark):
    rng = np.random.default_rng(3)
    truth, rows = {}, []
    for s in range(120):
        z, other = rng.choice([1, 2, 3, 4], 2)
        mz = float(rng.uniform(400, 900))
        # the second ion begins on an isotope of the first one, so that they share a point at least
        step = int(rng.integers(1, 3))
        ions = [(mz, int(z), float(rng.uniform(800, 1500))), (mz + step * C13_GAP / int(z), int(other), float(rng.uniform(800, 1500)))]
        if z == other:
            ions = ions[:1]
        truth[s] = ions
        rows += [(1, s, x, y) for x, y in scan(ions, rng)]
    got: dict = {}
    for r in isotopes.isotope_overlaps(spark.createDataFrame(rows, "run int, scan int, mz double, intensity double").repartition(4), least_gain=5e-3).collect():
        got.setdefault(r["scan"], []).append(r)
    found = total = right = 0
    for s, ions in truth.items():
        for mz, z, height in ions:
            total += 1
            mine = [r for r in got[s] if r["charge"] == z and abs(r["mz"] - mz) < 0.01]
            found += bool(mine)
            right += bool(mine) and abs(mine[0]["intensity"] / (height * envelope((mz - PROTON) * z, 8).sum()) - 1) < 0.15
    extra = sum(len(v) for v in got.values()) - found
    assert found >= 0.95 * total and right >= 0.9 * total and extra <= 0.15 * total, (found, right, extra, total)
    assert any(r["shared"] > 0.1 for v in got.values() for r in v)


def test_non_negative_least_squares():
    rng = np.random.default_rng(1)
    for _ in range(30):
        a, truth = rng.random((12, 4)), np.maximum(rng.normal(size=4), 0)
        y, missed = a @ truth, np.zeros(4)
        assert np.allclose(isotopes.non_negative(a, y, missed, np.zeros(4), 20_000), truth, atol=1e-4)
        y = rng.normal(size=12)
        x = isotopes.non_negative(a, y, missed, np.zeros(4), 20_000)
        slope = a.T @ (a @ x - y)  # at the optimum: 0 where x > 0, else not negative
        assert (x >= 0).all() and np.abs(slope[x > 0]).max(initial=0) < 1e-5 and (slope[x == 0] > -1e-6).all()


def test_only_what_a_new_envelope_reaches_is_solved_again():
    # Three pairs that share points; the first two are settled (at values that a second look would change), the last one has a new member.
    near = [[(j ^ 1, 0.5)] for j in range(6)]
    x, waiting = [1.0, 1.0, 2.0, 2.0, 3.0, 0.0], bytearray([0, 0, 0, 0, 0, 1])
    isotopes.descend(near, [9.0] * 4 + [3.0, 3.0], [1.0] * 6, x, waiting)
    assert x[:4] == [1.0, 1.0, 2.0, 2.0] and np.allclose(x[4:], [2.0, 2.0])


def test_many_overlaps_equal_plain_least_squares():
    rng = np.random.default_rng(8)
    mz, y = np.sort(rng.uniform(10, 200, 300)), rng.uniform(1, 60, 300)
    table = isotopes.envelope_table(2_000.0, 6)
    got = isotopes.explain(mz, y, table, 4, 0.15, 1e-4)
    mono, z, at, shape = isotopes.candidates(mz, table, 4, 0.15)
    where = {(float(mz[m]), int(c)): k for k, (m, c) in enumerate(zip(mono, z))}
    a, missed = np.zeros((len(mz), len(got))), np.zeros(len(got))
    for j, r in enumerate(got):
        k = where[r[0], r[1]]
        np.add.at(a[:, j], at[k][at[k] >= 0], shape[k][at[k] >= 0])
        missed[j] = (shape[k][at[k] < 0] ** 2).sum()
    x = isotopes.non_negative(a, y, missed, np.zeros(len(got)), 20_000)
    have = [r[3] / shape[where[r[0], r[1]]][at[where[r[0], r[1]]] >= 0].sum() for r in got]
    assert len(got) > 80 and np.allclose(have, x, atol=1e-4)


def test_no_point_of_a_long_scan_is_left_out(spark):
    """Two ions below 12,000 more intense points without a partner, more than one Arrow batch: none is too many, and each scan is whole."""
    ions = [(2000.9, 2, 150.0), (9000.9, 1, 180.0)]
    rows = [(r, 7, 100.0 + 2.3 * k, 100.0) for r in (1, 2) for k in range(12_000)] + [(r, 7, x, y) for r in (1, 2) for i in ions for x, y in ion(*i, n=8)]
    assert max(r[3] for r in rows[24_000:]) < 100.0
    out = isotopes.isotope_overlaps(spark.createDataFrame(rows, "run int, scan int, mz double, intensity double").repartition(3), least_gain=1e-5).collect()
    assert {(r["run"], round(r["mz"], 3), r["charge"]) for r in out if r["score"] > 0.99} == {(r, mz, z) for r in (1, 2) for mz, z, _ in ions}


def test_masses_beyond_the_table():
    """Envelopes of greater masses than the table's are made as they come, as the table would have them."""
    mz, y = (np.array(v) for v in zip(*ion(1500.0, 3, 500.0, n=8)))
    short, long = (isotopes.explain(mz, y, isotopes.envelope_table(m, 8), 4, 0.02, 1e-4) for m in (1_000.0, 50_000.0))
    assert short[0][:2] == (1500.0, 3) and len(short) == len(long)
    assert np.allclose(short, long, atol=1e-6)
    from scanloom.functions.averagine import unit_envelopes

    whole = np.array([envelope(m, 8) for m in (1_000.0, 4_500.0, 20_000.0)])
    assert np.allclose(unit_envelopes(np.array([1_000.0, 4_500.0, 20_000.0]), 8), whole / np.linalg.norm(whole, axis=1, keepdims=True), atol=1e-10)
    assert np.isfinite(unit_envelopes(np.array([1e6, 1e15]), 8)).all()


def test_candidates_in_stretches(monkeypatch):
    """Those that can't gain enough are left out from the start: the same envelopes as with all of them, whatever the stretches."""
    rng = np.random.default_rng(4)
    mz, y = np.sort(rng.uniform(10, 200, 300)), rng.uniform(1, 60, 300)
    table = isotopes.envelope_table(2_000.0, 6)
    want = isotopes.explain(mz, y, table, 4, 0.15, 1e-3)
    everything = isotopes.candidates(mz, table, 4, 0.15)
    monkeypatch.setattr(isotopes, "CANDIDATES_AT_ONCE", 7)
    assert len(want) > 20 and isotopes.explain(mz, y, table, 4, 0.15, 1e-3) == want
    assert all((a == b).all() for a, b in zip(isotopes.candidates(mz, table, 4, 0.15), everything, strict=True))
    assert len(isotopes.candidates(mz, table, 4, 0.15, y, 1e-3 * float(y @ y))[0]) < len(everything[0])
    monkeypatch.setattr(isotopes, "candidates", lambda mz, table, charges, tolerance, y, floor: tuple(c.copy() for c in everything))
    assert isotopes.explain(mz, y, table, 4, 0.15, 1e-3) == want


def test_scans_are_dealt_to_all_tasks(spark):
    """Adaptive execution would put scans of few bytes in one task."""
    from pyspark.sql import functions as F

    rows = [(1, s, 500.0 + k * C13_GAP, 9.0 - k) for s in range(200) for k in range(3)]
    out = isotopes.isotope_overlaps(spark.createDataFrame(rows, "run int, scan int, mz double, intensity double"))
    assert out.select(F.spark_partition_id().alias("p")).distinct().count() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_odd_scans(spark):
    rows = [(1, 1, None, 5.0), (1, 1, 400.0, 0.0), (1, 2, 400.0, 7.0), (None, 3, 500.0, 5.0), (None, 3, 500.0 + C13_GAP, 2.0), (1, 4, 500.0, None)]
    df = spark.createDataFrame(rows, "run int, scan int, mz double, intensity double")
    assert [(r["run"], r["scan"], r["charge"]) for r in isotopes.isotope_overlaps(df).collect()] == [(None, 3, 1)]
    assert isotopes.isotope_overlaps(df.limit(0)).collect() == []


def test_fractions_from_the_table(spark):
    from pyspark.sql import functions as F

    from scanloom.functions.averagine import with_fractions

    masses = [None, -5.0, 0.0, 49.9, 50.0, 1234.5, 99_999.0, 2e5]
    df = with_fractions(spark.createDataFrame([(i, m) for i, m in enumerate(masses)], "i int, m double"), F.col("m"), 5)
    for r in df.collect():
        if r["m"] is None or r["m"] > 1e5:
            assert r["fractions"] is None
        else:
            assert np.allclose(r["fractions"], envelope(r["m"], 5), atol=1e-12)
