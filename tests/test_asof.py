"""As-of joins in buckets of time against the plain window and against loops."""

import random

import pytest

from scanloom.operators import joins


@pytest.fixture
def small_buckets(monkeypatch):
    monkeypatch.setattr(joins, "BUCKETS_FROM_BYTES", 0)
    monkeypatch.setattr(joins, "ROWS_PER_BUCKET", 7)


def tables(spark, seed):
    rng = random.Random(seed)
    left = [(i, rng.choice([1, 2, None]) if seed else 1, rng.choice([float(rng.randrange(40)), rng.uniform(0, 40), None, 200.0])) for i in range(120)]
    # gaps of many buckets without a right row, ties at the edges of buckets
    right = [(rng.choice([1, 2]) if seed else 1, float(rng.choice([rng.randrange(6), rng.randrange(30, 36)])), float(rng.randrange(100))) for _ in range(40)]
    return left, right, spark.createDataFrame(left, "id int, k int, t double").repartition(3), spark.createDataFrame(right, "k int, rt double, v double").repartition(2)


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_buckets_against_loops(spark, small_buckets, seed):
    left, right, l, r = tables(spark, seed)
    back = {x["id"]: x["match"] for x in joins.asof_backward(l, "t", r, "rt", "v", ["k"]).collect()}
    near = {x["id"]: x["match"] for x in joins.asof_nearest(l, "t", r, "rt", "v", ["k"]).collect()}
    assert len(back) == len(near) == len(left)
    for i, k, t in left:
        if t is None:
            assert back[i] is None
            continue
        mine = [(x, v) for q, x, v in right if q == k]
        before = [p for p in mine if p[0] <= t]
        assert back[i] == (max(before)[1] if before else None)
        assert near[i] == (min(mine, key=lambda p: (abs(p[0] - t), -p[0], -p[1]))[1] if mine else None)


def test_buckets_equal_one_window(spark, monkeypatch):
    _, _, l, r = tables(spark, 3)
    line = r.groupBy("k", "rt").max("v").withColumnRenamed("max(v)", "v")

    def answers():
        return sorted(map(str, joins.interpolate(l, "t", line, "rt", "v", ["k"], True).collect())), sorted(map(str, joins.asof_nearest(l, "t", r, "rt", "v", ["k"]).collect()))

    plain = answers()
    monkeypatch.setattr(joins, "BUCKETS_FROM_BYTES", 0)
    monkeypatch.setattr(joins, "ROWS_PER_BUCKET", 5)
    assert answers() == plain


def test_one_key_is_many_groups(spark, small_buckets):
    from pyspark.sql import functions as F

    _, _, l, r = tables(spark, 0)
    both = l.select("k", F.col("t").alias("_t"), F.lit(1).alias("_side"), F.struct("id").alias("_row"), F.lit(None).cast("struct<t:double,v:double>").alias("_r"))
    assert joins._in_buckets(both, ["k"]).select("k", "_b").distinct().count() >= 4
