"""Nearest of many centres against comparing all pairs."""

import random
from collections import Counter

import pytest

from comarca.operators.nearest import nearest_centres


def made(kind, rng):
    spread = lambda n, k=10.0: [(rng.random() * k, rng.random() * k) for _ in range(n)]
    if kind == "even":
        return spread(300), spread(200)
    if kind == "far":
        # centres crowd in one corner, points lie all around them, a third of them at one place
        return [(x * 50 - 200, y * 50 - 200) for x, y in spread(150)] + [(3.0, 3.0)] * 75, spread(300, 1e-3) + [(5.0, 5.0)]
    if kind == "lattice":
        # ties everywhere, and centres that repeat a place
        return [(i / 2, j / 2) for i in range(20) for j in range(20)], [(float(i), float(j)) for i in range(9) for j in range(9)] * 2
    return spread(40), [(2.5, 2.5)]


@pytest.mark.parametrize("kind", ["even", "far", "lattice", "one"])
def test_nearest(spark, kind):
    points, places = made(kind, random.Random(5))
    centres = [(1000 - i, *p) for i, p in enumerate(places)]
    want = Counter(
        (x, y, min(((x - cx) * (x - cx) + (y - cy) * (y - cy), i) for i, cx, cy in centres)[1]) for x, y in points
    )
    got = nearest_centres(
        spark.createDataFrame(points, "x double, y double"), spark.createDataFrame(centres, "cluster_id long, x double, y double")
    ).collect()
    assert {(r.x, r.y, r.cluster_id): r.n for r in got} == dict(want)


def test_places_that_are_none(spark):
    nan, inf = float("nan"), float("inf")
    points = spark.createDataFrame([(1.0, 1.0), (None, 1.0), (nan, 1.0), (inf, 0.0)], "x double, y double")
    centres = spark.createDataFrame([(1, None, 0.0), (2, nan, 0.0), (None, 1.0, 1.0), (4, 7.0, -inf), (5, 9.0, 9.0)], "cluster_id long, x double, y double")
    assert [(r.x, r.n, r.cluster_id, r.d2) for r in nearest_centres(points, centres).collect()] == [(1.0, 1, 5, 128.0)]
    assert nearest_centres(points, centres.limit(0)).collect() == []
    assert nearest_centres(points.limit(0), centres).collect() == []


def test_points_of_one_file_are_made_by_many_tasks(spark, tmp_path):
    """A table in one small file is dealt out before its names are hashed, and the points are worked out once."""
    from comarca.checks.scalars import located, located_once
    from comarca.checks.views import Tables

    rows = [(k, f"Customer#{k}", k % 25, float(k % 3 - 1), "MACHINERY") for k in range(300)] + [(None, None, None, None, None)]
    customer = spark.createDataFrame(rows, "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string")
    customer.coalesce(1).write.parquet(str(tmp_path / "customer.parquet"))
    tables = Tables(spark, str(tmp_path))
    found = located_once(tables, ["id", "lon", "lat"])
    assert sorted(map(repr, found.collect())) == sorted(map(repr, located(tables).select("id", "lon", "lat").collect()))
    assert found.selectExpr("input_file_name()").distinct().count() > 1 and "md5" not in found._jdf.queryExecution().toString()
