"""Skew helpers against the plain operators."""

import numpy as np
from pyspark.sql import functions as F

from comarca.scale import exact_quantiles, hot_keys, number_rows, quantile_bounds, range_piece, skew_join


def skewed(spark, n=3000):
    key = F.when(F.col("id") % 3 == 0, F.lit(7)).when(F.col("id") % 50 == 1, F.lit(None)).otherwise(F.col("id") % 200)
    return spark.range(n).select("id", key.cast("long").alias("k"))


def test_skew_join_equals_join(spark):
    left = skewed(spark)
    right = spark.range(0, 400, 3).select(F.col("id").alias("k"), (F.col("id") % 5).alias("w")).unionByName(
        spark.createDataFrame([(7, 90), (7, 91)], "k long, w long")
    )
    assert hot_keys(left, ["k"], 500) == [(7,)]
    for how in ("inner", "left", "left_semi", "left_anti"):
        want = left.join(right, ["k"], how)
        for rows in (500, 30):
            got = skew_join(left, right, ["k"], how, min_rows=rows, salts=8)
            assert got.columns == want.columns
            assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)


def test_range_pieces(spark):
    df = skewed(spark)
    cuts = quantile_bounds(df, "id", 8)
    sizes = [r["count"] for r in df.groupBy(range_piece(F.col("id"), cuts).alias("p")).count().collect()]
    assert len(sizes) == 8 and max(sizes) < 500


def test_number_rows(spark):
    df = skewed(spark)
    got = number_rows(df, [F.desc("k"), F.col("id")], "n").collect()
    want = sorted(got, key=lambda r: (r.k is None, -(r.k or 0), r.id))
    assert [r.n for r in want] == list(range(1, 3001))


def test_exact_quantiles(spark):
    rng = np.random.default_rng(5)
    rows = [(int(g), float(v)) for g, v in zip(rng.integers(0, 3, 2000), np.round(rng.normal(size=2000), 1))]
    df = spark.createDataFrame(rows, "g long, v double")
    probs = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    got = {(r.g, r.prob): r["quantile"] for r in exact_quantiles(df, "v", probs, ["g"], pieces=7).collect()}
    for g in range(3):
        want = np.quantile([v for k, v in rows if k == g], probs)
        assert np.allclose([got[(g, p)] for p in probs], want)
    alone = exact_quantiles(df.where("g = 0").limit(1), "v", [0.5]).collect()
    assert len(alone) == 1


def test_joins_start_no_job_and_many_cuts_are_cheap(spark):
    left, right = spark.range(50).toDF("k"), spark.range(10).toDF("k")
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("plain-join", "no job is expected")
    skew_join(left, right, ["k"])
    assert not list(tracker.getJobIdsForGroup("plain-join"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    cuts = list(range(10, 40_010, 10))
    rows = spark.range(0, 40_100, 7).select("id", range_piece(F.col("id"), cuts).alias("p")).collect()
    assert all(r.p == min(r.id // 10, len(cuts)) for r in rows)
