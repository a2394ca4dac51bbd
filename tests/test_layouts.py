"""Stored layouts and arriving files: refused lines, keyed tables, geocoding that resumes, streets over cells."""

import json
import math
import os
import random

import pytest
from pyspark.sql import functions as F

from comarca import fixed
from comarca.operators import density
from comarca.sources import keyed, readers
from comarca.streaming import geocode


def test_quarantine(spark, tmp_path):
    good = ";".join(f"f{i}" for i in range(len(fixed.RAW_COLUMNS)))
    quoted = good.replace("f4", '"a;""b""\\"')
    lines = [good, "", "short;row", good + ";more", good.replace("f3", '"open'), quoted, good.replace("f0", "é")]
    (tmp_path / "raw.csv").write_bytes("\n".join(lines).encode("latin-1"))
    sound, refused, counts = readers.quarantine(spark, str(tmp_path / "raw.csv"), str(tmp_path / "refused"))
    assert tuple(counts.first()) == (3, 3)
    assert sorted(r[0] for r in sound.select("cnpj_basico").collect()) == ["f0", "f0", "é"]
    assert {r[0] for r in sound.select(fixed.RAW_COLUMNS[4]).collect()} == {"f4", 'a;"b"\\'}
    assert sorted(r.line for r in refused.collect()) == sorted([lines[2], lines[3], lines[4]])
    assert {r.cnpj_basico: r.fields for r in refused.collect() if r.fields < 10} == {"short": 2}


def test_quarantine_of_nothing(spark, tmp_path):
    (tmp_path / "raw.csv").write_text("")
    sound, refused, counts = readers.quarantine(spark, str(tmp_path / "raw.csv"), str(tmp_path / "refused"))
    assert sound.count() == refused.count() == 0 and tuple(counts.first()) == (0, 0)


def stamps(folder):
    return {p: p.stat().st_mtime_ns for p in folder.rglob("*.parquet")}


def test_keyed_upsert_rewrites_touched_parts_only(spark, tmp_path):
    rows = [(f"k{i}", i, f"v{i}") for i in range(200)]
    name = "keyed_test"
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    keyed.create_keyed(spark.createDataFrame(rows, "k string, n int, v string"), name, ["k"], parts=16, buckets=3, path=str(tmp_path / "t"))
    try:
        before = stamps(tmp_path / "t")
        source = spark.createDataFrame([("k3", 0, "old", 1), ("k3", 300, "new", 2), ("fresh", 1, "x", 1)], "k string, n int, v string, seq int")
        plan = keyed.merged_parts(spark, name, source, ["v"], order="seq")
        text = plan._jdf.queryExecution().executedPlan().toString()
        assert "Bucketed: true" in text and "PartitionFilters: [" in text
        assert text.count("Exchange") == 1 and "REPARTITION_BY_NUM" in text  # that of the source
        for _ in range(2):  # the same delivery again changes nothing
            keyed.upsert_keyed(spark, name, source, ["v"], order="seq")
            got = {r.k: (r.n, r.v) for r in keyed.read_keyed(spark, name).collect()}
            want = {k: (n, v) for k, n, v in rows} | {"k3": (3, "new"), "fresh": (1, "x")}
            assert got == want
        touched = {r[0] for r in source.select(keyed.part_of(["k"], 16)).collect()}
        after = stamps(tmp_path / "t")
        for file, time in before.items():
            if int(file.parent.name.split("=")[1]) not in touched:
                assert after[file] == time
        assert set(before) - set(after) and len(touched) <= 2
        with pytest.raises(Exception, match="a key is null"):
            keyed.upsert_keyed(spark, name, spark.createDataFrame([(None, 1, "x")], "k string, n int, v string"), ["v"])
        assert keyed.read_keyed(spark, name).count() == 201
    finally:
        spark.sql(f"DROP TABLE {name}")


def test_geocoding_stops_and_resumes(spark, tmp_path, monkeypatch):
    """Ended inside its second batch, the stream repeats that batch alone."""
    queue = tmp_path / "queue"
    queue.mkdir()
    for k in range(3):
        rows = [{"id": 10 * k + i, "cnpj_completo": f"{10 * k + i:014d}", "logradouro": f"Rua {i}", "numero": "1", "bairro": "Centro",
                 "municipio": "Londrina", "business_type": "tech"} for i in range(4)]
        (queue / f"{k}.json").write_text("\n".join(map(json.dumps, rows)))
        os.utime(queue / f"{k}.json", (1_000_000 + k, 1_000_000 + k))
    gazetteer = spark.createDataFrame([("Rua 1, 1, Centro, Londrina, PR, Brazil", -51.5, -23.5)], "address string, lon double, lat double")
    true, calls = geocode.locate, []

    def flaky(batch, *rest):
        calls.append(1)
        if len(calls) == 2:
            raise RuntimeError("the cluster goes down")
        return true(batch, *rest)

    monkeypatch.setattr(geocode, "locate", flaky)
    out, progress = str(tmp_path / "out"), str(tmp_path / "progress")
    start = lambda: geocode.start_geocoding(geocode.read_pending(spark, str(queue)), gazetteer, out, progress).awaitTermination()
    with pytest.raises(Exception, match="goes down"):
        start()
    first = stamps(tmp_path / "out")
    assert geocode.located_rows(spark, out).count() == 4
    start()
    assert len(calls) == 4  # one, the failed one, the failed one again, the third
    assert {p: stamps(tmp_path / "out")[p] for p in first} == first
    found = {r.id: (r.lon, r.lat, r.source) for r in geocode.located_rows(spark, out).collect()}
    assert sorted(found) == [0, 1, 2, 3, 10, 11, 12, 13, 20, 21, 22, 23]
    assert found[11] == (-51.5, -23.5, "nominatim") and found[10][2] == "fallback"
    start()
    assert len(calls) == 4


def test_streets_over_cells(spark):
    """Lengths per cell add up to the line, and agree with many small steps along it."""
    rng = random.Random(2)
    lines = [(i, [(rng.uniform(-3, 9), rng.uniform(-3, 9)) for _ in range(rng.randrange(2, 5))]) for i in range(20)]
    lines += [(50, [(1.0, 1.0), (4.0, 1.0)]), (51, [(2.0, 2.0), (2.0, 2.0)]), (52, [(3.2, 4.1)]), (53, []), (54, None), (55, [(0.5, 0.5), (3.5, 3.5)])]
    segs = spark.createDataFrame(lines, "id long, geom array<struct<x:double,y:double>>")
    got = {(r.segment_id, r.ix, r.iy): r.length for r in density.street_cells(segs, 0.0, 0.0, 1.0).collect()}
    for i, vs in lines[:20]:
        whole = sum(math.dist(a, b) for a, b in zip(vs, vs[1:]))
        own = {k[1:]: v for k, v in got.items() if k[0] == i}
        assert sum(own.values()) == pytest.approx(whole)
        steps = {}
        for a, b in zip(vs, vs[1:]):
            for k in range(4000):
                t = (k + 0.5) / 4000
                cell = tuple(math.floor(p + t * (q - p) + 0.5) for p, q in zip(a, b))
                steps[cell] = steps.get(cell, 0) + math.dist(a, b) / 4000
        assert all(own.get(c, 0) == pytest.approx(d, abs=0.02) for c, d in steps.items())
    assert {k[1:]: v for k, v in got.items() if k[0] == 50} == pytest.approx({(1, 1): 0.5, (2, 1): 1.0, (3, 1): 1.0, (4, 1): 0.5})
    assert {k: v for k, v in got.items() if k[0] in (51, 52, 53, 54)} == {(51, 2, 2): 0.0, (52, 3, 4): 0.0}
    grid = spark.createDataFrame([(1.0, 1, 1, 4.0), (1.0, 2, 1, 2.0), (1.0, 2, 2, 7.0), (2.0, 2, 2, 9.0)], "bandwidth double, ix long, iy long, density double")
    found = {r.segment_id: r.density for r in density.street_density(segs, grid, 1.0, 0.0, 0.0, 1.0).collect()}
    assert found[50] == pytest.approx((0.5 * 4 + 1.0 * 2) / 3) and found[51] == 7.0 and found[52] == 0.0
    assert 53 not in found and 54 not in found
