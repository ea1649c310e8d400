"""The centroiding policy."""

from scanloom.operators import centroids as C


def test_policy_and_plans(spark):
    scans = [(1, True, "raw", None), (2, True, "other", None), (3, False, "raw", "custom"), (4, True, "raw", "vendor"), (5, True, "other", "CUSTOM"), (6, None, "raw", None), (7, True, None, "odd")]
    df = C.centroiding(spark.createDataFrame(scans, "scan int, profile boolean, format string, override string"), "auto", ["raw"])
    assert [r["centroiding"] for r in df.orderBy("scan").collect()] == ["custom", "vendor", "none", "vendor", "custom", "none", "vendor"]
    assert {r["centroiding"] for r in C.centroiding(df.drop("centroiding"), "vendor", ["raw"]).where("override is null and profile").collect()} == {"vendor"}
    points = spark.createDataFrame([(s, float(i), float(y)) for s in range(1, 8) for i, y in enumerate([1, 3, 2, 0, 5, 5, 1])], "scan int, mz double, intensity double")
    vendor = spark.createDataFrame([(2, 9.0, 8.0), (1, 7.0, 7.0)], "scan int, mz double, intensity double")
    got: dict = {}
    for r in C.centroids(points, df, vendor).collect():
        got.setdefault(r["scan"], []).append((round(r["mz"], 6), r["intensity"]))
    assert sorted(got[1]) == sorted(got[5]) == [(round((0 + 3 + 4) / 6, 6), 3.0), (round((20 + 25 + 6) / 11, 6), 5.0)]
    assert got[2] == [(9.0, 8.0)] and len(got[3]) == len(got[4]) == len(got[6]) == len(got[7]) == 7
    assert len(C.centroids(points, df).where("scan = 2").collect()) == 7
