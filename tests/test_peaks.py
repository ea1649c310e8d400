"""Peaks by prominence and the intervals that they cut a series into."""

import random

import pytest

from scanloom.operators import series as S


def frame(spark, lists):
    rows = [(k, i + 1, float(i), float(v)) for k, ys in lists.items() for i, v in enumerate(ys)]
    return spark.createDataFrame(rows, "channel string, i int, t double, y double").repartition(3)


def extrema(ys):
    runs = []
    for i, v in enumerate(ys):
        if runs and runs[-1][1] == v:
            runs[-1] = (i, v, runs[-1][2] + 1)
        else:
            runs.append((i, v, 1))
    out = []
    for k, (i, v, n) in enumerate(runs):
        left = None if k == 0 else (v > runs[k - 1][1]) - (v < runs[k - 1][1])
        right = None if k + 1 == len(runs) else (v > runs[k + 1][1]) - (v < runs[k + 1][1])
        if left is None and right is None:
            continue
        kind = (right if n == 1 else 0) if left is None else left if right is None else left if left == right else 0
        if kind:
            out.append((i, v))
    return out


def peaks(ys, sel, sign=1):
    """By the definition: from each extremum outwards until a higher one."""
    e = [(i, sign * v) for i, v in extrema(ys)]
    least = min((v for _, v in e), default=0)
    out = []
    for k, (i, v) in enumerate(e):
        falls = []
        for side, higher in ((reversed(e[:k]), lambda o: o >= v), (e[k + 1 :], lambda o: o > v)):  # noqa: B023
            low = v
            for _, o in side:
                if higher(o):
                    break
                low = min(low, o)
            else:
                low = least
            falls.append(v - low)
        if min(falls) > sel:
            out.append(i + 1)
    return out


def intervals(ys, share, least_points):
    n = len(ys)
    found = {}
    if n >= least_points:
        sel = share * max(map(abs, ys))
        valleys = peaks(ys, sel, -1)
        for p in peaks(ys, sel):
            bounds = max((v for v in valleys if v < p), default=1), min((v for v in valleys if v > p), default=n)
            if bounds not in found or ys[p - 1] > ys[found[bounds] - 1]:
                found[bounds] = p
    out = sorted((a, b, p) for (a, b), p in found.items())
    at, filled = 1, []
    for a, b, _ in out:
        if at < a:
            filled.append((at, a, None))
        at = max(at, b)
    if at < n or n == 1:
        filled.append((at, n, None))
    return sorted(out + filled, key=str)


def series_of(rng):
    return {str(k): [rng.choice([rng.uniform(-5, 10), rng.randint(-3, 6)]) for _ in range(rng.choice([1, 2, 3, 7, 30, 90]))] for k in range(40)} | {"flat": [2.0] * 9, "up": list(range(12)), "down": list(range(12, 0, -1))}


@pytest.mark.parametrize("selectivity", [0.0, 1.5, 6.0])
def test_peaks_by_definition(spark, selectivity):
    lists = series_of(random.Random(selectivity))
    df = frame(spark, lists)
    for sign in (1, -1):
        got = {}
        for r in S.peaks(df, "channel", selectivity, sign).collect():
            got.setdefault(r["channel"], []).append(r["i"])
        assert {k: sorted(v) for k, v in got.items()} == {k: p for k, ys in lists.items() if (p := peaks(ys, selectivity, sign))}


def test_peak_intervals(spark):
    lists = series_of(random.Random(8))
    got = {}
    for r in S.peak_intervals(frame(spark, lists), "channel", 0.3, 3).collect():
        got.setdefault(r["channel"], []).append((r["first"], r["last"], r["apex"]))
    assert {k: sorted(v, key=str) for k, v in got.items()} == {k: intervals(ys, 0.3, 3) for k, ys in lists.items()}
    assert S.peak_intervals(frame(spark, {"a": [1.0]}).limit(0), "channel", 0.3).collect() == []


def test_nested_intervals_cover(spark):
    rng = random.Random(3)
    ys = [abs(rng.gauss(0, 1)) * (40 if 30 < i < 60 else 4) for i in range(120)]
    got = sorted((r["first"], r["last"]) for r in S.peak_intervals_nested(frame(spark, {"a": ys, "b": ys[:50]}), "channel", 0.4, 6).where("channel = 'a'").collect())
    assert got[0][0] == 1 and got[-1][1] == 120 and all(a[1] == b[0] for a, b in zip(got, got[1:]))
    assert len(got) > len(intervals(ys, 0.4, 6))


def test_noise_floor_from_counts(spark):
    import statistics

    from scanloom.operators import spectra

    rng = random.Random(6)
    groups = {k: [rng.choice([float(rng.randrange(5)), rng.uniform(0, 9)]) for _ in range(n)] for k, n in (("a", 1), ("b", 2), ("c", 37), ("d", 200))}
    rows = [(k, v) for k, vs in groups.items() for v in vs] + [("a", None)]
    df = spark.createDataFrame(rows, "k string, intensity double").repartition(3)
    got = {r["k"]: r["floor"] for r in spectra.noise_floor(df, ["k"]).collect()}
    for k, vs in groups.items():
        low = sorted(vs)[: -(-len(vs) * 4 // 5)]
        assert abs(got[k] - (low[len(low) // 2] + 3 * statistics.pstdev(low))) < 1e-9
    assert "collect_list" not in spectra.noise_floor(df, ["k"])._jdf.queryExecution().toString()


def test_lists_roll_up_without_leaves(spark):
    from scanloom.operators import report

    rng = random.Random(1)
    rows = [(rng.choice("xy"), rng.choice(["p", "q", None]), rng.choice(["m", "n", "o", "", None]), i) for i in range(80)] + [("z", "p", "", 99)]
    df = spark.createDataFrame(rows, "g string, h string, s string, o int")
    key = lambda r: str((r["g"], r["h"], r["depth"]))
    plain = {key(r): r["l"] for r in report.roll_up(df, ["g", "h"], {"l": report.value_list("s", "o")}).collect()}
    assert {key(r): r["s"] for r in report.roll_up_lists(df, ["g", "h"], "s", "o").collect()} == plain


def test_overlapping_pairs(spark):
    from scanloom.operators.joins import overlapping_pairs

    rng = random.Random(4)
    rows = [(i, rng.randrange(2), a := rng.uniform(-20, 20), a + rng.choice([0.0, 1.0, 30.0, -1.0])) for i in range(80)]
    got = {(r["a"], r["b"]) for r in overlapping_pairs(spark.createDataFrame(rows, "i int, k int, lo double, hi double"), "i", "lo", "hi", 3.0, ["k"]).collect()}
    ok = [r for r in rows if r[2] <= r[3]]
    assert got == {(a[0], b[0]) for a in ok for b in ok if a[0] < b[0] and a[1] == b[1] and a[2] <= b[3] and b[2] <= a[3]}


def test_interval_overlap_has_all_pairs(spark):
    """Pairs that are apart too: as many as the nation's suppliers make, with the negative ratio of their gap."""
    import duckdb

    from scanloom.plans import catalog

    d = "/root/testdata/sf0.01"
    got = sorted(map(tuple, catalog.queries()["interval_overlap"](spark, d).collect()))
    con = duckdb.connect()
    for t in ("supplier",):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet'")
    pairs = con.execute("SELECT count(*) FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey").fetchone()[0]
    assert len(got) == pairs and any(r[2] < 0 for r in got)
    assert got == sorted(con.execute(catalog.oracle_sql()["interval_overlap"]).fetchall())


def test_all_pairs_in_slices(spark, monkeypatch):
    from scanloom.operators import joins

    monkeypatch.setattr(joins, "PAIRS_PER_TASK", 50)
    rows = [(i, i % 3) for i in range(60)]
    got = [(r["a_i"], r["b_i"]) for r in joins.all_pairs(spark.createDataFrame(rows, "i int, k int"), "i", ["k"]).collect()]
    assert sorted(got) == [(a, b) for a in range(60) for b in range(a + 1, 60) if a % 3 == b % 3]


def test_extrema_with_nulls_take_one_sort(spark):
    """A null parts runs and has no sign; a series is sorted once and not grouped by its runs."""
    ys = [None, 3.0, 3.0, None, None, 2.0, 5.0, None, 4.0, 1.0, 1.0, 6.0]
    df = spark.createDataFrame([("a", i + 1, float(i), v) for i, v in enumerate(ys)] + [("b", 1, 0.0, 7.0), ("c", 1, 0.0, 1.0), ("c", 2, 1.0, 1.0), ("c", 3, 2.0, 0.0)], "channel string, i int, t double, y double")
    e = S.extrema(df, ["channel"])
    runs = [(1, None, 1), (3, 3.0, 2), (4, None, 1), (5, None, 1), (6, 2.0, 1), (7, 5.0, 1), (8, None, 1), (9, 4.0, 1), (11, 1.0, 2), (12, 6.0, 1)]
    want = set()
    for k, (i, v, n) in enumerate(runs):
        sign = lambda o: None if v is None or o is None else (v > o) - (v < o)  # noqa: B023, E731
        left, right = sign(runs[k - 1][1] if k else None), sign(runs[k + 1][1] if k + 1 < len(runs) else None)
        kind = 0 if left is None and right is None else (right if n == 1 else 0) if left is None else left if right is None else left if left == right else 0
        if kind:
            want.add(("a", i, kind))
    got = {(r["channel"], r["i"], r["kind"]) for r in e.collect()}
    assert got == want | {("c", 3, -1)}
    plan = e._jdf.queryExecution().executedPlan().toString()
    assert plan.count("- Sort [") == 1 and "Aggregate" not in plan


def test_relative_peaks_find_extrema_once(spark):
    """One window over the stored extrema, cut to the first ranks before the shuffle; none over the series."""
    s = frame(spark, {"a": [0, 4, 1, 6, 2, 3, 0], "b": [1, 1, 1]})
    out = S.peaks_relative(s, "channel", 0.25, 1)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("+- Window [") == 1 and "WindowGroupLimit" in plan
    assert [(r["channel"], r["i"]) for r in out.orderBy("i").collect()] == [("a", 2), ("a", 4)]
