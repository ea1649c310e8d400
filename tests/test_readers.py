"""Runs by path."""

import struct

import pytest

from scanloom.sources import files, readers


def test_canonical():
    c = readers.canonical
    assert c("/a//b/./c/../d/") == "/a/b/d" and c("hdfs://host/a//b/") == "hdfs://host/a/b" and c("a\\b") == "a/b" and c("file:/x/../y") == "file:/y" and c("s3a://k/a/b.csv") == "s3a://k/a/b.csv"


def test_readers_in_order(spark, tmp_path):
    scans = spark.createDataFrame([(1, 5, 1, 0.5), (2, 6, 1, 0.1)], "run int, scan long, level int, rt double")
    points = spark.createDataFrame([(5, 0, 100.0, 1.0), (5, 1, 101.0, 2.0), (6, 0, 99.0, 3.0)], "scan long, i int, mz double, intensity double")
    files.write_runs(scans, points, str(tmp_path / "folder"))
    (tmp_path / "t.csv").write_text("run,scan,level,rt,mz,intensity\n3,7,1,0.2,50.5,4\n3,8,2,0.3,,\n")
    peaks = spark.createDataFrame([(9, bytearray(struct.pack("<2d", 1, 2)), bytearray(struct.pack("<2f", 3, 4)))], "scan long, mz binary, intensity binary")
    peaks.write.parquet(str(tmp_path / "blobs" / "peaks.parquet"))
    spark.createDataFrame([(4, 9, 1, 0.0)], "run int, scan long, level int, rt double").write.parquet(str(tmp_path / "blobs" / "scans.parquet"))
    one = readers.open_run(spark, f"{tmp_path}/folder/")
    assert readers.open_run(spark, f"{tmp_path}//x/../folder") is one and one.points.count() == 3
    plan = one.points.where("run = 2")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(run" in plan
    whole = readers.open_runs(spark, [f"{tmp_path}/{n}" for n in ("folder", "t.csv", "blobs")])
    assert sorted(r["scan"] for r in whole.scans.collect()) == [5, 6, 7, 8, 9] and whole.points.count() == 6
    with pytest.raises(ValueError, match="folder, blobs, text"):
        readers.open_run(spark, f"{tmp_path}/nothing")
    known = list(readers.READERS)
    try:
        readers.register(readers.Reader("mine", lambda s, p: p.endswith("folder"), lambda s, p: files.Run(scans, points.limit(1))), first=True)
        assert readers.open_run(spark, f"{tmp_path}/folder") is one
        readers.close_run(spark, f"{tmp_path}/folder")
        assert readers.open_run(spark, f"{tmp_path}/folder").points.count() == 1
        assert readers.open_run(spark, f"{tmp_path}/folder", "folder").points.count() == 3
    finally:
        readers.READERS[:] = known
