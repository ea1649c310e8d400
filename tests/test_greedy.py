"""Greedy grouping against plain loops, over blocks far smaller than the data."""

import random

import pytest

from scanloom.operators import cluster
from scanloom.operators.greedy import ranked


def groups_by_loop(rows, em, ea, ei):
    group, n = {}, 0
    by = {r[0]: r for r in rows}
    for i in sorted(by):
        if i in group:
            continue
        n += 1
        group[i] = n
        _, s, m, a, v = by[i]
        if None in by[i]:
            continue
        best = {}
        for o, so, mo, ao, vo in rows:
            if None in (so, mo, ao, vo) or o in group or so == s or abs(mo - m) >= em or abs(ao - a) >= ea or abs(vo - v) >= ei:
                continue
            best[so] = min(best.get(so, (9e9,)), (abs(mo - m), abs(ao - a), abs(vo - v), o))
        for _, _, _, o in best.values():
            group[o] = n
    return group


def features(rng, n, mass, apex):
    ids = rng.sample(range(10 * n), n)
    return [(i, rng.randrange(5), rng.choice([rng.uniform(0, mass), float(rng.randrange(int(mass)))]), rng.choice([rng.uniform(0, apex), float(rng.randrange(int(apex)))]), rng.uniform(0, 50)) for i in ids]


@pytest.mark.parametrize(("mass", "apex"), [(300.0, 200.0), (6.0, 2000.0), (2000.0, 9.0), (40.0, 40.0)])
def test_neighbour_groups(spark, mass, apex):
    rng = random.Random(mass)
    rows = features(rng, 900, mass, apex) + [(10_000 + i, 1, None, 3.0, 1.0) for i in range(3)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "id long, sample long, mass double, apex double, intensity double").repartition(3)
    got = {r["id"]: r["group"] for r in cluster.neighbour_groups(df, 2.5, 10.0, 30.0, rows_per_block=40).collect()}
    assert got == groups_by_loop(rows, 2.5, 10.0, 30.0)


def test_neighbour_groups_ids_in_a_row(spark):
    # every feature competes with the next one: a chain through all blocks
    rows = [(i, i % 3, i * 1.0, 0.0, 0.0) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, sample long, mass double, apex double, intensity double")
    got = {r["id"]: r["group"] for r in cluster.neighbour_groups(df, 2.5, 10.0, 30.0, rows_per_block=60).collect()}
    assert got == groups_by_loop(rows, 2.5, 10.0, 30.0)
    assert cluster.neighbour_groups(df.limit(0), 2.5, 10.0, 30.0).collect() == []


@pytest.mark.parametrize("spread", [3.0, 300.0])
def test_greedy_groups(spark, spread):
    rng = random.Random(spread)
    rows = [(i, rng.choice([0.0, 500.0 + rng.uniform(0, spread), 500.0 + rng.randrange(int(spread))]), float(rng.randrange(400)) / rng.choice([1, 3])) for i in range(700)]
    got = {r["id"]: r["seed"] for r in cluster.greedy_groups(spark.createDataFrame(rows, "id long, mass double, rt double").repartition(3), 200.0, 6.0, rows_per_block=50).collect()}
    want, seeds = {}, []
    for i, m, t in sorted(rows, key=lambda r: (r[2], r[0])):
        near = [s for s, sm, st in seeds if abs(m - sm) <= sm * 200 / 1e6 and t - st <= 6.0]
        want[i] = near[0] if near else i
        if not near:
            seeds.append((i, m, t))
    assert got == want


def test_ranked(spark):
    df = spark.createDataFrame([(i * 7 % 101, i) for i in range(101)], "a long, b long").repartition(5)
    assert sorted((r["n"], r["a"]) for r in ranked(df, ["a"], "n").collect()) == [(k + 1, k) for k in range(101)]


def test_doubt_spreads_by_the_nearest_only():
    """A dense block with doubt at its left edge: a seed in doubt casts doubt on the nearest row of each sample, not on all in its reach, so the rest is settled at once."""
    import numpy as np

    from scanloom.operators.greedy import NearestOfEachSample, settle_block

    rng = np.random.default_rng(1)
    n = 6000
    c = {"x": rng.uniform(0, 30, n), "y": rng.uniform(0, 60, n), "z": rng.uniform(0, 40, n), "sample": rng.integers(0, 5, n)}
    doubt = c["x"] < 2.5
    found = settle_block(NearestOfEachSample((2.5, 10.0, 30.0), c, doubt), doubt, np.zeros(n, bool))
    assert sum(1 + len(chosen) for _, chosen, _ in found) > 0.6 * n


def test_a_far_value_does_not_put_the_rest_in_one_block(spark, tmp_path):
    from scanloom.operators.greedy import AllWithin, greedy

    def rule(columns, doubt):
        (tmp_path / f"{len(columns['x'])}-{columns['id'].min()}").touch()
        return AllWithin(100.0, 20.0, columns)

    rng = random.Random(5)
    rows = [(0, -1e9, 3.0, 0.0)] + [(i, rng.uniform(0, 1000.0), rng.uniform(0, 300.0), 1000.0) for i in range(1, 2000)]
    assert greedy(spark.createDataFrame(rows, "id long, x double, y double, z double").repartition(3), ["y", "id"], 1.0, 20.0, rule, 100).count() == 2000
    assert max(int(p.name.split("-")[0]) for p in tmp_path.iterdir()) < 500


def _block(rng, n, mass, apex, samples, step):
    import numpy as np

    x, y, z = rng.uniform(0, mass, n), rng.uniform(0, apex, n), rng.exponential(50, n)
    if step:
        x, y, z = np.round(x / step) * step, np.round(y / step) * step, np.round(z / 5) * 5
    return {"x": x, "y": y, "z": z, "sample": rng.integers(0, samples, n)}


def test_rows_that_look_for_theirs_together_equal_a_loop(monkeypatch):
    """A block with rows in doubt, many rows at once: the groups, and what is in doubt at the end, of one row after the other."""
    import numpy as np

    from scanloom.operators import greedy

    monkeypatch.setattr(greedy.NearestOfEachSample, "pairs_at_once", 64)
    rng, eps = np.random.default_rng(5), (2.5, 10.0, 30.0)
    for k in range(60):
        n = int(rng.integers(1, 90))
        c = _block(rng, n, float(rng.uniform(3, 30)), float(rng.uniform(1, 60)), int(rng.integers(1, 7)), (0, 1.0, 0.5)[k % 3])
        doubt = c["x"] < 2.0 * (k % 4)
        mine, taken, want = doubt.copy(), np.zeros(n, bool), []
        for v in range(n):
            if taken[v]:
                continue
            d = [np.abs(c[a] - c[a][v]) for a in "xyz"]
            near = np.flatnonzero(~taken & (c["sample"] != c["sample"][v]) & (d[0] < eps[0]) & (d[1] < eps[1]) & (d[2] < eps[2]))
            free, sure = {}, {}
            for r in sorted(near, key=lambda r: (d[0][r], d[1][r], d[2][r], r)):
                free.setdefault(c["sample"][r], int(r))
                if not doubt[r]:
                    sure.setdefault(c["sample"][r], int(r))
            if not doubt[v] and free == sure:
                taken[[v, *free.values()]] = True
                want.append((v, sorted(free.values())))
            else:
                doubt[[v, *sure.values()]] = True
        got = greedy.settle_block(greedy.NearestOfEachSample(eps, c, mine), mine, np.zeros(n, bool))
        assert [(v, sorted(chosen.tolist())) for v, chosen, _ in got] == want and (mine == doubt).all()


def test_late_rows_do_not_look_at_more():
    """One row in ten is of the other sample: once these are taken, what remains finds nothing, and isn't looked through again for each row."""
    import numpy as np

    from scanloom.operators.greedy import NearestOfEachSample, settle_block

    class Counted(np.ndarray):
        seen = 0

        def __getitem__(self, at):
            out = super().__getitem__(at)
            Counted.seen += np.size(out)
            return out

    n = 6000
    c = _block(np.random.default_rng(1), n, 2.0, 5.0, 1, 0)
    c["sample"] = (np.arange(n) % 10 == 0).astype(int)
    c = {k: v.view(Counted) for k, v in c.items()}
    doubt = np.zeros(n, bool)
    found = settle_block(NearestOfEachSample((2.5, 10.0, 1e9), c, doubt), doubt, np.zeros(n, bool))
    assert len(found) == n - n // 10 and Counted.seen < 400 * n
