"""The multi-sample workflow on planted peptides, and identifications against loops."""

import random

from scanloom.functions.chem import C13_GAP, PROTON
from scanloom.operators import workflow


def test_matches(spark):
    rng = random.Random(1)
    features = [(rng.randrange(2), i, rng.choice([None, rng.uniform(500, 520)]), a := rng.uniform(0, 50), a + rng.uniform(0, 20)) for i in range(60)]
    ids = [(rng.randrange(2), rng.uniform(500, 520), rng.uniform(0, 60), float(rng.randrange(10)), float(rng.randrange(3)), f"S{rng.randrange(40)}") for _ in range(300)]
    f = spark.createDataFrame(features, "run int, feature long, mass double, start double, end double")
    k = spark.createDataFrame(ids, "run int, mass double, rt double, score double, intensity double, sequence string")
    got = {r["feature"]: tuple(r)[1:] for r in workflow.match_identifications(f, k, 1000.0, 3.0).collect()}
    want = {}
    for run, i, mass, a, b in features:
        near = [x for x in ids if mass and x[0] == run and abs(x[1] - mass) <= mass * 1000 / 1e6 and a <= x[2] <= b and x[3] > 3]
        if near:
            x = min(near, key=lambda x: (-x[4], -x[3], x[5]))
            want[i] = (x[5], x[3], x[4])
    assert got == want


def test_peptides_of_three_samples(spark):
    rng = random.Random(2)
    planted = [(900.0 + 37.1 * k, 2 + k % 2, 12 + 11 * k) for k in range(6)]  # mass, charge, scan
    rows, n = [], 0
    for run, stretch in ((1, 1.0), (2, 1.06), (3, 0.95)):
        for mass, z, at in planted:
            if (run, mass) == (3, planted[2][0]):
                continue  # one that a sample lacks
            centre = round(at * stretch)
            for k in range(4):
                for s in range(-3, 4):
                    rows.append((n, run, centre + s, (mass + z * PROTON + k * C13_GAP) / z + rng.uniform(-0.002, 0.002), 1e4 * 0.6**k * (4 - abs(s)) * (1 + 0.1 * run)))
                    n += 1
        rows += [(n + j, run, s, 2000.0 + 7.3 * j, 1.0) for j, s in enumerate((0, 90))]
        n += 2
    points = spark.createDataFrame(rows, "id long, run int, idx int, mz double, intensity double").repartition(3)
    ids = [(1, planted[0][0], 12.0, 50.0, 9.0, "PEPTIDEK"), (2, planted[3][0], float(round(45 * 1.06)), 50.0, 9.0, "OTHERR"), (2, planted[3][0], 45.0, 1.0, 99.0, "POORR"), (1, 5000.0, 12.0, 90.0, 9.0, "NONE")]
    known = spark.createDataFrame(ids, "run int, mass double, rt double, score double, intensity double, sequence string")
    listed, table = workflow.peptides(points, known, 0.01, 2, 3.0, 4, 20.0, 5.0, 0.05, 6.0, 3.0, segments=4, rows_per_block=500)
    got = listed.collect()
    assert sorted(round(r["UnchargedMass"], 1) for r in got) == [round(m, 1) for m, _, _ in planted]
    names = {round(r["UnchargedMass"], 1): r["Sequence"] for r in got}
    assert names[900.0] == "PEPTIDEK" and names[round(planted[3][0], 1)] == "OTHERR" and sum(v.startswith("UNKNOWN_") for v in names.values()) == 4
    by_group: dict = {}
    for r in table.collect():
        by_group.setdefault(r["group"], []).append(r["sample"])
    assert sorted(len(v) for v in by_group.values()) == [2, 3, 3, 3, 3, 3]
