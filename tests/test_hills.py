"""Hills and ladders against plain loops, over blocks far smaller than the data."""

import random

import pytest

from scanloom.functions.chem import C13_GAP
from scanloom.operators import hills

POINTS = "id long, run int, idx int, mz double, intensity double"


def hills_by_loop(rows, width, gap):
    free, out = {r[0]: r for r in rows}, {}
    for i, run, idx, mz, _ in sorted(rows, key=lambda r: (-r[4], r[0])):
        if i not in free:
            continue
        near = [r for r in free.values() if r[1] == run and abs(r[3] - mz) <= width]
        scans = sorted({r[2] for r in near})
        lo = hi = scans.index(idx)
        while lo and scans[lo] - scans[lo - 1] <= gap:
            lo -= 1
        while hi + 1 < len(scans) and scans[hi + 1] - scans[hi] <= gap:
            hi += 1
        for r in near:
            if scans[lo] <= r[2] <= scans[hi]:
                out[r[0]] = i
                del free[r[0]]
    return out


def ladders_by_loop(rows, width, reach, charges, most):
    """rows: (hill, run, apex, mz, intensity)."""
    order = sorted(rows, key=lambda r: (-r[4], r[0]))
    place = {r[0]: k for k, r in enumerate(order)}
    free, out = {r[0]: r for r in rows}, {}
    for h, run, apex, mz, _ in order:
        if h not in free:
            continue
        best = None
        for z in range(1, charges + 1):
            taken = []
            for sign in (1, -1):
                for k in range(1, most + 1):
                    at = mz + sign * k * C13_GAP / z
                    n = [r for r in free.values() if r[0] != h and r[1] == run and at - width <= r[3] <= at + width and abs(r[2] - apex) <= reach]
                    if not n:
                        break
                    taken.append(min(n, key=lambda r: (abs(r[3] - at), abs(r[2] - apex), place[r[0]])))  # noqa: B023
            key = (-len(taken), -sum(r[4] for r in taken), z)
            if best is None or key < best[0]:
                best = key, taken
        for r in [free[h], *best[1]]:
            out[r[0]] = h
            free.pop(r[0], None)
    return out


@pytest.mark.parametrize(("width", "span", "scans"), [(0.5, 60.0, 40), (0.05, 30.0, 200), (2.0, 6.0, 15)])
def test_hills(spark, width, span, scans):
    rng = random.Random(span)
    rows = [(i, rng.randrange(2), rng.randrange(scans), rng.choice([rng.uniform(0, span), float(rng.randrange(int(span)))]), float(rng.randrange(200))) for i in rng.sample(range(9000), 900)]
    df = spark.createDataFrame(rows, POINTS).repartition(3)
    got = {r["id"]: r["seed"] for r in hills.grow_hills(df, width, 2, rows_per_block=60).collect()}
    assert got == hills_by_loop(rows, width, 2)


def test_ladders(spark):
    rng = random.Random(7)
    rows, n = [], 0
    for _ in range(90):
        z, mz, apex, height = rng.choice([1, 1, 2, 3, 4]), rng.uniform(400, 520), rng.randrange(60), rng.uniform(10, 1000)
        for k in range(rng.randint(1, 5)):
            rows.append((n, 1, apex + rng.randint(-1, 1), mz + k * C13_GAP / z + rng.uniform(-0.01, 0.01), height * 0.7**k))
            n += 1
    df = spark.createDataFrame(rows, "hill long, run int, apex int, mz double, intensity double").repartition(3)
    got = {r["hill"]: r["seed"] for r in hills.hill_ladders(df, 0.02, 3.0, 5, 4, rows_per_block=30).collect()}
    assert got == ladders_by_loop(rows, 0.02, 3.0, 5, 4)


def test_features_are_found(spark):
    rows, n = [], 0
    for mz, z, at in ((500.0, 2, 20), (700.0, 3, 30), (900.0, 1, 12)):
        for k in range(4):
            for s in range(-4, 5):
                if not (k == 1 and s == 2):  # one empty scan
                    rows.append((n, 1, at + s, mz + k * C13_GAP / z, 1000.0 * 0.6**k * (5 - abs(s))))
                    n += 1
    got = hills.find_features(spark.createDataFrame([*rows, (n, 1, 3, None, 5.0)], POINTS), 0.02, 2, 3.0, 5, 6).collect()
    assert sorted((round(r["mz"], 2), r["charge"], r["hills"], r["first"], r["last"], r["apex"]) for r in got) == [(500.0, 2, 4, 16, 24, 20), (700.0, 3, 4, 26, 34, 30), (900.0, 1, 4, 8, 16, 12)]
    alone = hills.find_features(spark.createDataFrame([(1, 1, 5, 700.0, 9.0)], POINTS)).first()
    assert alone["charge"] == 0 and alone["mass"] is None
    assert hills.find_features(spark.createDataFrame([], POINTS)).collect() == []


def test_layers_are_sets(spark):
    rng = random.Random(2)
    rows = [(i, 1, rng.randrange(50), rng.uniform(0, 20), float(rng.randrange(90))) for i in range(400)]
    df = spark.createDataFrame(rows, POINTS)
    grown = hills.grow_hills(df, 0.5, 2)
    layer = hills.hill_layer(df, grown.where("seed % 2 = 0"), 4.0, 10)
    merged = {(r["tx"], r["ty"]): r["n"] for r in hills.merged_layer(layer).collect()}
    seeds = {r["id"]: r["seed"] for r in grown.collect()}
    want = {}
    for i, _, idx, mz, _ in rows:
        if seeds[i] % 2 == 0:
            want[int(mz // 4), idx // 10] = want.get((int(mz // 4), idx // 10), 0) + 1
    assert merged == want


def test_doubt_in_a_crowd_is_not_spread_point_by_point():
    # many points within reach of each other, all in doubt in the end: each is looked at by steps that skip what is settled
    import numpy as np

    from scanloom.operators.greedy import Hill, settle_block

    rng = np.random.default_rng(3)
    n = 4000
    rule = Hill(0.2, 8, {"x": rng.uniform(0, 1.0, n), "idx": rng.integers(0, 366, n)})
    calls, plain = [], rule.reach
    rule.reach = lambda v, taken: calls.append(v) or plain(v, taken)
    doubt = np.zeros(n, bool)
    doubt[:40] = True
    assert settle_block(rule, doubt, np.zeros(n, bool)) == []
    assert doubt.all() and len(calls) < 40
