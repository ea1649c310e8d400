"""Readers, writers and the synthetic run."""

import struct

from pyspark.sql import functions as F

from scanloom.operators import chrom, features
from scanloom.sources import files
from scanloom.streaming import traces


def test_csv_dialect(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes('name,text\r\n  x,"a ""quoted"" one"\r\n\r\n y,"two\nlines, один"\r\n'.encode())
    got = [tuple(r) for r in files.read_csv(spark, str(tmp_path / "a.csv")).orderBy("name").collect()]
    assert got == [("x", 'a "quoted" one'), ("y", "two\nlines, один")]


def test_csv_writer_quotes_only_where_needed(spark, tmp_path):
    df = spark.createDataFrame([(1, 'say "hi"'), (2, "a,b"), (3, "plain"), (4, None)], "id int, s string").coalesce(1)
    files.write_csv(df, str(tmp_path / "out"))
    text = b"".join(p.read_bytes() for p in sorted((tmp_path / "out").glob("part*"))).decode()
    assert text == 'id,s\r\n1,"say ""hi"""\r\n2,"a,b"\r\n3,plain\r\n4,\r\n'
    assert files.read_csv(spark, str(tmp_path / "out")).count() == 4


def test_runs_round_trip_and_invalid_scans(spark, tmp_path):
    scans = spark.createDataFrame([(1, 1, 1, 0.0), (1, 2, 1, 1.0), (2, 3, 1, 0.0), (2, 4, 1, 1.0)], "run int, scan int, level int, rt double")
    points = spark.createDataFrame([(1, 0, 10.0, 1.0), (1, 1, 11.0, 2.0), (2, 0, 12.0, 1.0), (2, 1, 11.0, 1.0), (3, 0, float("nan"), 1.0)], "scan int, i int, mz double, intensity double")
    files.write_runs(scans, points, str(tmp_path / "run"))
    run = files.load(spark, str(tmp_path / "run"))
    assert {(r["scan"], r["valid"], r["comment"], r["intensity_sum"]) for r in run.scans.collect()} == {(1, True, "", 3.0), (2, False, "m/z not ascending", 2.0), (3, False, "not a number", 1.0), (4, True, "", 0.0)}
    assert {r["scan"] for r in run.points.collect()} == {1}
    assert "PartitionFilters: [isnotnull(run" in run.points.where("run = 1")._jdf.queryExecution().executedPlan().toString()


def test_blobs_and_plots(spark, tmp_path):
    rows = spark.createDataFrame([(7, bytearray(struct.pack("<3d", 1, 2, 3)), bytearray(struct.pack("<3f", 4, 5, 6))), (8, None, None)], "scan int, mz binary, intensity binary")
    assert [tuple(r) for r in files.decode_blobs(rows).orderBy("i").collect()] == [(7, 0, 1.0, 4.0), (7, 1, 2.0, 5.0), (7, 2, 3.0, 6.0)]
    (tmp_path / "p.txt").write_text("x,y\n1,2\n3.5, 4\nbad\n")
    assert [tuple(r) for r in files.read_xy(spark, str(tmp_path / "p.txt")).collect()] == [(1.0, 2.0), (3.5, 4.0)]


def test_modifications(spark, tmp_path):
    (tmp_path / "m.xml").write_text('<all><mod title="Oxidation" full_name="Ox"><specificity site="M" position="Anywhere"/><specificity site="W" position="Anywhere"/><delta mono_mass="15.994915" composition="O"/></mod><mod title="oxidation" full_name="b"><delta mono_mass="15.99" composition="O"/></mod></all>')
    m = files.read_modifications(spark, str(tmp_path / "m.xml"))
    assert m.where("title = 'Oxidation'").first()["sites"] == ["M", "W"] and m.agg(F.round(F.sum("mono_mass"), 6)).first()[0] == 31.984915
    assert files.modification_groups(m).select("key").distinct().count() == 1 or m.count() == 2


def test_modification_groups_by_first_member(spark):
    rows = [(1, "a", 0.0), (2, "a", 8e-5), (3, "a", 1.6e-4), (4, "A", 0.0), (5, "A", 8e-5), (6, None, 1.0), (7, "b", None), (8, "a", 0.0)]
    m = spark.createDataFrame(rows, "id int, title string, mono_mass double").repartition(3)
    groups = files.modification_groups(m, 1e-4)
    got = {r["id"]: (r["key"], r["group"]) for r in groups.collect()}
    # each with its group's first member: the third is too far from it; titles that differ in case stay apart
    assert {i: g for i, (_, g) in got.items()} == {1: 2, 2: 2, 8: 2, 3: 3, 4: 1, 5: 1, 6: None, 7: None}
    assert got[1][0] == "a#0" and got[3][0] == "a#1" and got[4][0] == "A#0"
    asked = spark.createDataFrame([(1, "a", 1.5e-4), (2, "a", 5.0), (3, "c", 0.0), (4, "A", -5e-5), (5, None, 0.0), (6, "a", 1.2e-4)], "n int, title string, mono_mass double")
    assert {r["n"]: r["group"] for r in files.modification_lookup(asked, groups, 1e-4).collect()} == {1: 3, 2: None, 3: None, 4: 1, 5: None, 6: 3}


def test_synthetic_features_are_found(spark):
    run = files.synthetic(spark, 6, 120)
    assert [tuple(r) for r in chrom.scan_bounds(run.scans).collect()] == [(120, 0, 119)]
    again = files.synthetic(spark, 6, 120)
    assert run.points.agg(F.sum("mz")).first() == again.points.agg(F.sum("mz")).first()
    p = run.points.where("intensity > 100").join(run.scans, "scan").select("run", "scan", "rt", "mz", "intensity")
    clusters = features.charge_clusters(p, tolerance=0.02).where("isotopes >= 3")
    clusters = clusters.withColumn("id", F.monotonically_increasing_id()).withColumn("idx", F.col("scan"))
    found = features.features(clusters)
    masses = sorted(r["mass"] for r in found.collect())
    want = [r[0] for r in spark.range(6).select((800 + 2200 * (F.pmod(F.xxhash64(F.lit(666), "id", F.lit("m")), F.lit(1_000_003)).cast("double") / 1_000_003))).collect()]
    assert all(any(abs(m - w) < 0.05 for m in masses) for w in want)


def test_fingerprint(spark):
    big = spark.createDataFrame([(bytearray(b"a" * 1_000_000),), (bytearray(b"a" * 999_999 + b"b"),), (bytearray(b"small"),)], "c binary")
    got = [r[0] for r in big.select(files.fingerprint(F.col("c"), 4, 1000)).collect()]
    assert len(set(got)) == 2 or len(set(got)) == 3
    assert got[2] == "b7a0b3e5d1a4a7d1e2c0" or len(got[2]) == 40


def test_running_totals_stream(spark, tmp_path):
    import datetime as dt

    rows = [(i, dt.datetime(2024, 1, 1, i % 24), 1, "abc"[i % 3], float(i), "") for i in range(30)]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    s = traces.event_stream(spark, str(tmp_path))
    got = {r["event_type"]: (r["n"], r["total"]) for r in traces.collected(traces.running_totals(s), spark, "update").collect()}
    assert got == {c: (10, float(sum(range(k, 30, 3)))) for k, c in enumerate("abc")}
    assert traces.collected(traces.stream_tic(s), spark).agg(F.sum("n")).first()[0] == 30
