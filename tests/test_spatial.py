"""Clusters, components, merged lines, densities and box joins against brute force."""

import math
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from comarca.operators import components, dbscan, density, linemerge, segments


def smallest_of_component(nodes, edges):
    parent = {n: n for n in nodes}

    def find(n):
        while parent[n] != n:
            parent[n] = parent[parent[n]]
            n = parent[n]
        return n

    for a, b in edges:
        ra, rb = find(a), find(b)
        parent[max(ra, rb)] = min(ra, rb)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("kind", ["random", "path", "star", "none"])
def test_components(spark, kind):
    rng = random.Random(3)
    edges = {
        "random": [(rng.randrange(300), rng.randrange(300)) for _ in range(200)],
        "path": [(i, i + 1) for i in range(150)],
        "star": [(500, i) for i in range(150)] + [(500, 900), (900, 901)],
        "none": [(4, 4)],
    }[kind]
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    nodes = {n for a, b in edges if a != b for n in (a, b)}
    assert got == smallest_of_component(nodes, [(a, b) for a, b in edges if a != b])


def cluster_points(kind, rng):
    if kind == "sparse":
        return [(rng.random() * 30, rng.random() * 30) for _ in range(250)]
    if kind == "crowded":
        # two full cells that almost touch, many copies and a few loners
        left = [(rng.random() * 0.6, rng.random() * 0.6) for _ in range(150)]
        right = [(1.65 + rng.random() * 0.6, rng.random() * 0.6) for _ in range(150)]
        return left + right + [(0.1, 0.1)] * 100 + [(40.0 + i, 3.0) for i in range(5)]
    if kind == "arc":
        # a ring just outside eps around a blob: pairs stay open until cells are fine
        ring = [(1.0005 * math.cos(a), 1.0005 * math.sin(a)) for a in np.linspace(0, 6.28, 200)]
        return ring + [(1e-5 * rng.random(), 1e-5 * rng.random()) for _ in range(100)]
    return [(float(i), 0.0) for i in range(60)] + [(float(i) + 0.5, 3.0) for i in range(0, 60, 3)]


@pytest.mark.parametrize("kind", ["sparse", "crowded", "arc", "line"])
def test_dbscan(spark, kind):
    pts = cluster_points(kind, random.Random(11))
    near = [(i, j) for i in range(len(pts)) for j in range(i)
            if (pts[i][0] - pts[j][0]) ** 2 + (pts[i][1] - pts[j][1]) ** 2 <= 1.0]
    want = smallest_of_component(range(len(pts)), near)
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pts)], "id long, x double, y double").repartition(3)
    got = {r.id: r.component for r in dbscan.dbscan(df, 1.0).collect()}
    assert got == want
    table = dbscan.cluster_table(df, 1.0).orderBy("number").collect()
    assert [r.component for r in table] == sorted(set(want.values())) and [r.number for r in table] == list(range(len(table)))
    assert sum(r.total_lojas for r in table) == len(pts)


def plain_dbscan(pts, eps, least):
    """Kind and component per point by comparing all pairs."""
    near = [[j for j, q in enumerate(pts) if (p[0] - q[0]) ** 2 + (p[1] - q[1]) ** 2 <= eps * eps] for p in pts]
    cores = [i for i, n in enumerate(near) if len(n) >= least]
    part = smallest_of_component(cores, [(i, j) for i in cores for j in near[i] if j in set(cores)])
    out = {}
    for i, n in enumerate(near):
        reach = [j for j in n if j in part]
        out[i] = ("core", part[i]) if i in part else ("border", part[min(reach)]) if reach else ("noise", None)
    return out


@pytest.mark.parametrize("kind, least", [("sparse", 3), ("crowded", 40), ("arc", 30), ("line", 3), ("rim", 20)])
def test_core_and_border(spark, kind, least):
    rng = random.Random(12)
    if kind == "rim":
        # a crowded cell whose points lie on both sides of eps for the points near it, and exact distances of eps
        pts = [(rng.random() * 0.7, rng.random() * 0.7) for _ in range(200)] + [(1.0 + 0.01 * i, 0.2) for i in range(60)]
        pts += [(10.0, 0.0), (11.0, 0.0), (12.0, 0.0)] + [(10.0, 0.0)] * 18
    else:
        pts = cluster_points(kind, rng)
    want = plain_dbscan(pts, 1.0, least)
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pts)], "id long, x double, y double").repartition(3)
    got = {r.id: (r.kind, r.component) for r in dbscan.density_clusters(df, 1.0, least).collect()}
    assert got == want
    if kind != "rim":
        return
    assert {r.id: r.component for r in dbscan.dbscan(df, 1.0, least).collect()} == {i: c for i, (_, c) in want.items()}
    table = dbscan.cluster_table(df, 1.0, least).orderBy("number").collect()
    sizes = defaultdict(int)
    for _, c in want.values():
        sizes[c] += c is not None
    assert [(r.component, r.total_lojas) for r in table] == sorted((c, n) for c, n in sizes.items() if n)


def test_core_points_of_nothing(spark):
    empty = spark.createDataFrame([], "id long, x double, y double")
    assert dbscan.density_clusters(empty, 1.0, 3).collect() == []
    alone = spark.createDataFrame([(7, 0.0, 0.0)], "id long, x double, y double")
    assert [tuple(r) for r in dbscan.density_clusters(alone, 1.0, 2).collect()] == [(7, 0.0, 0.0, "noise", None)]
    with pytest.raises(ValueError):
        dbscan.dbscan(alone, 1.0, 0)


def line(*vs):
    return [(float(x), float(y)) for x, y in vs]


def merged(spark, lines, listed=None):
    df = spark.createDataFrame([(i, g) for i, g in lines.items()], "id long, geom array<struct<x:double,y:double>>")
    routes = spark.createDataFrame([(1, i) for i in (listed or lines)], "route_id long, segment_id long")
    out = defaultdict(list)
    for r in linemerge.route_vertices(df, routes).orderBy("line_id", "pos").collect():
        assert r.pos == len(out[r.line_id])
        out[r.line_id].append((r.x, r.y))
    return dict(out)


SEEDS = {
    1001: line((-51.1630, -23.3150), (-51.1610, -23.3120)), 1002: line((-51.1610, -23.3120), (-51.1580, -23.3100)),
    1003: line((-51.1610, -23.3100), (-51.1610, -23.3130)), 1004: line((-51.1630, -23.3130), (-51.1580, -23.3130)),
}


def test_seed_segments_merge(spark):
    got = merged(spark, SEEDS)
    assert got == {1001: SEEDS[1001] + SEEDS[1002][1:], 1003: SEEDS[1003], 1004: SEEDS[1004]}
    assert list(merged(spark, SEEDS, [1001, 1002, 1002, 77])) == [1001]


def test_ids_of_64_bits(spark):
    """Ids may lie anywhere between the ends of a long, as hashed ones do; the smallest names the line."""
    low, high = -(2**63), 2**63 - 1
    lines = {low: line((0, 0), (1, 0)), high: line((1, 0), (2, 0)), 2**62: line((5, 5), (6, 5))}
    assert merged(spark, lines) == {low: line((0, 0), (1, 0), (2, 0)), 2**62: line((5, 5), (6, 5))}


def test_direction_of_the_majority(spark):
    lines = {1: line((2, 0), (1, 0)), 2: line((2, 0), (3, 0)), 3: line((3, 0), (4, 1), (5, 0))}
    assert merged(spark, lines) == {1: line((1, 0), (2, 0), (3, 0), (4, 1), (5, 0))}


def test_branch_and_ring(spark):
    ring = {10: line((0, 0), (1, 0)), 11: line((1, 1), (1, 0)), 12: line((1, 1), (0, 0))}
    fork = {1: line((5, 5), (6, 5)), 2: line((6, 5), (7, 6)), 3: line((6, 5), (7, 4)), 4: line((9, 9), (9, 9))}
    loop = {20: line((3, 3), (4, 3), (4, 4), (3, 3))}
    got = merged(spark, ring | fork | loop)
    assert set(got) == {10, 1, 2, 3, 20}
    assert got[10] in (line((0, 0), (1, 0), (1, 1), (0, 0)), line((0, 0), (1, 1), (1, 0), (0, 0)))
    assert got[20] == loop[20]


def test_random_lines_keep_their_edges(spark):
    rng = random.Random(2)
    lines = {}
    for i in range(120):
        n = rng.randrange(2, 5)
        lines[i] = line(*[(rng.randrange(12), rng.randrange(12)) for _ in range(n)])
    got = merged(spark, lines)
    edges = lambda ls: sorted(tuple(sorted(e)) for g in ls for e in zip(g, g[1:]) if e[0] != e[1])
    assert edges(got.values()) == edges(lines.values())
    ends = defaultdict(int)
    for g in lines.values():
        g = [v for k, v in enumerate(g) if k == 0 or v != g[k - 1]]
        if len(g) > 1:
            ends[g[0]] += 1
            ends[g[-1]] += 1
    tips = defaultdict(int)
    for g in got.values():
        tips[g[0]] += 1
        tips[g[-1]] += 1
    assert all(tips[v] == d for v, d in ends.items() if d != 2)


def test_long_chain(spark):
    order = list(range(200))
    random.Random(1).shuffle(order)
    lines = {k: line((i, 0), (i + 1, 0)) if k % 3 else line((i + 1, 0), (i, 0)) for i, k in enumerate(order)}
    assert list(merged(spark, lines).values()) == [line(*[(i, 0) for i in range(201)])]


def test_routes_nested(spark):
    df = spark.createDataFrame(list(SEEDS.items()), "id long, geom array<struct<x:double,y:double>>")
    listed = spark.createDataFrame([(1, k) for k in SEEDS] + [(2, 1001), (2, 1002), (3, 5)], "route_id long, segment_id long")
    routes = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "route_id long, name string")
    got = linemerge.build_routes(df, routes, listed).withColumn("doc", linemerge.route_geometry("geom"))
    docs = {r.name: r.doc for r in got.collect()}
    assert set(docs) == {"a", "b"} and '"MultiLineString"' in docs["a"] and '"LineString"' in docs["b"]
    with pytest.raises(ValueError):
        linemerge.build_routes(df, routes, listed, most_vertices=3)


def test_kde_against_direct_sum(spark):
    rng = np.random.default_rng(4)
    pts = np.vstack([rng.normal(0, 400, (150, 2)), rng.normal(5000, 50, (150, 2)), [[9000.0, 100.0]] * 40])
    df = spark.createDataFrame([(float(x), float(y)) for x, y in pts], "x double, y double")
    got = density.kde(df, 50.0, [200.0, 500.0]).toPandas()
    x0, y0 = pts.min(axis=0) - 1500
    x1, y1 = pts.max(axis=0) + 1500
    gx, gy = np.arange(x0, x1, 50.0), np.arange(y0, y1, 50.0)
    assert len(got) == 2 * len(gx) * len(gy)
    for h in (200.0, 500.0):
        ex = np.exp(-((gx[:, None] - pts[:, 0]) ** 2) / (2 * h * h))
        ey = np.exp(-((gy[:, None] - pts[:, 1]) ** 2) / (2 * h * h))
        want = ex @ ey.T * 1e6 / (2 * math.pi * h * h)
        part = got[got.bandwidth == h]
        assert np.allclose(part.density, want[part.ix, part.iy], rtol=1e-12, atol=1e-12 * want.max())
        assert np.allclose(part.cell_x, gx[part.ix])
    stats = density.kde_stats(density.kde(df, 50.0, [500.0])).first()
    assert np.allclose([stats.p25, stats.p50, stats.p75], np.percentile(want, [25, 50, 75]))


def test_far_density_has_no_cut(spark):
    rng = np.random.default_rng(5)
    pts = np.vstack([rng.normal(0, 300, (200, 2)), [[0.0, 0.0]] * 3, [[30000.0, 12000.0]]])
    df = spark.createDataFrame([(float(x), float(y)) for x, y in pts], "x double, y double")
    got = density.kde_far(df, 400.0, [200.0, 500.0], error=1e-10).toPandas()
    assert len(got) == len(got.drop_duplicates(["bandwidth", "ix", "iy"])) == len(density.kde(df, 400.0, [200.0, 500.0]).toPandas())
    for h, part in got.groupby("bandwidth"):
        d2 = (part.cell_x.to_numpy()[:, None] - pts[:, 0]) ** 2 + (part.cell_y.to_numpy()[:, None] - pts[:, 1]) ** 2
        low = d2.min(axis=1)
        want = np.log(np.exp((low[:, None] - d2) / (2 * h * h)).sum(axis=1)) - low / (2 * h * h) + math.log(1e6 / (2 * math.pi * h * h))
        assert np.abs(part.log_density.to_numpy() - want).max() < 1e-8
        assert (part.density == 0).any() and (h > 200 or (want < -800).any())
    assert density.kde_far(df.limit(0)).collect() == []


def hits(lines, box):
    """Ids of lines of which an edge meets the box, by clipping every edge."""
    x1, y1, x2, y2 = box
    out = []
    for i, vs in lines:
        for (ax, ay), (bx, by) in zip(vs, vs[1:]):
            low, high = 0.0, 1.0
            for p, q in ((ax - bx, ax - x1), (bx - ax, x2 - ax), (ay - by, ay - y1), (by - ay, y2 - ay)):
                if p == 0:
                    high = high if q >= 0 else -1.0
                elif p < 0:
                    low = max(low, q / p)
                else:
                    high = min(high, q / p)
            if low <= high:
                out.append(i)
                break
    return out


def test_box_join_in_a_crowded_cell(spark):
    """Half of all boxes and lines crowd in one cell; copies are dealt in blocks, others are told apart by quarters."""
    rng = random.Random(9)
    spot = lambda: (7.0 + rng.random() * 0.9, 7.0 + rng.random() * 0.9)
    lines = [(i, line((rng.random() * 50, rng.random() * 50), (rng.random() * 50, rng.random() * 50))) for i in range(60)]
    for i in range(100, 180):
        x, y = spot()
        lines.append((i, line((x, y), (x + 0.02, y + 0.01))))
    lines += [(200 + i, line((7.5, 7.5), (7.5, 7.5))) for i in range(40)] + [(300, line((7.5, 7.5)))]
    boxes = [(i, x, y, x + 3, y + 2) for i in range(60) for x, y in [(rng.random() * 50, rng.random() * 50)]]
    for i in range(60, 100):
        x, y = spot()
        boxes.append((i, x, y, x + 0.03, y + 0.03))
    boxes += [(100 + i, 7.4, 7.4, 7.6, 7.6) for i in range(30)]
    segs = spark.createDataFrame(lines, "id long, geom array<struct<x:double,y:double>>")
    wins = spark.createDataFrame(boxes, "box_id long, x1 double, y1 double, x2 double, y2 double")
    got = sorted(map(tuple, segments.box_join(segs, wins, pairs=200).collect()))
    assert got == sorted((b, i) for b, *box in boxes for i in hits(lines, box))


def test_box_join_lays_out_bounds_only(spark):
    segs = spark.createDataFrame([(1, line((0, 0), (1, 1)))], "id long, geom array<struct<x:double,y:double>>")
    left = segments._laid(segments._sized(segments.with_bounds(segs).select("id", "min_x", "max_x", "min_y", "max_y"), "min_x", "min_y", "max_x", "max_y", 1), [0], "min_x", "min_y", "max_x", "max_y")
    assert "geom" not in left.columns
    wins = spark.createDataFrame([(1, 0.0, 0.0, 2.0, 2.0)], "box_id long, x1 double, y1 double, x2 double, y2 double")
    plan = segments.box_pairs(segs, wins)._jdf.queryExecution().executedPlan().toString()
    assert "geom" not in plan and segments.box_pairs(segs, wins).columns == ["box_id", "id", "inside", "x1", "y1", "x2", "y2"]


def test_box_reads_few_files_of_a_stored_layout(spark, tmp_path):
    """Most files lie beside a small box by the bounds in their footers, and the box finds the same segments."""
    import pyarrow.parquet as pq

    rng = random.Random(10)
    lines = [(i, line((x, y), (x + 0.1, y + 0.1))) for i in range(4000) for x, y in [(rng.random() * 100, rng.random() * 100)]]
    segs = spark.createDataFrame([*lines, (9999, None)], "id long, geom array<struct<x:double,y:double>>")
    segments.write_by_place(segs, str(tmp_path / "placed"), files=32)
    box, met, files = (40.0, 40.0, 48.0, 48.0), 0, list((tmp_path / "placed").glob("*.parquet"))
    for file in files:
        footer = pq.ParquetFile(file).metadata
        for g in range(footer.num_row_groups):
            ends = {footer.row_group(g).column(c).path_in_schema: footer.row_group(g).column(c).statistics for c in range(footer.num_columns)}
            ends = {k: v for k, v in ends.items() if v is not None and v.has_min_max}
            met += ends["min_x"].min <= box[2] and ends["max_x"].max >= box[0] and ends["min_y"].min <= box[3] and ends["max_y"].max >= box[1]
    assert len(files) >= 24 and met <= len(files) / 4
    stored = spark.read.parquet(str(tmp_path / "placed"))
    assert stored.count() == 4001
    found = segments.in_box(stored, box)
    assert sorted(r.id for r in found.collect()) == sorted(hits(lines, box))
    assert "PushedFilters: [" in found._jdf.queryExecution().executedPlan().toString()


def test_box_join_against_all_pairs(spark):
    rng = random.Random(8)
    lines = [(i, line(*[(rng.random() * 20, rng.random() * 20) for _ in range(3)])) for i in range(60)]
    lines += [(100 + i, line((5.0, 5.0), (5.01, 5.01))) for i in range(40)]
    boxes = [(i, x, y, x + w, y + h) for i in range(40)
             for x, y, w, h in [(rng.random() * 18, rng.random() * 18, rng.random() * 0.5**rng.randrange(6), rng.random() * 5)]]
    boxes += [(50, 4.9, 4.9, 5.1, 5.1), (51, -100.0, -100.0, 100.0, 100.0), (52, 5.0, 5.0, 5.0, 5.0)]
    segs = spark.createDataFrame(lines, "id long, geom array<struct<x:double,y:double>>")
    wins = spark.createDataFrame(boxes, "box_id long, x1 double, y1 double, x2 double, y2 double")
    for pairs in (20, 1_000_000):
        got = sorted(map(tuple, segments.box_join(segs, wins, pairs=pairs).collect()))
        assert got == sorted((b, i) for b, *box in boxes for i in hits(lines, box))
    assert segments.box_join(segs, wins.limit(0)).count() == 0


def test_mass_of_density(spark):
    df = spark.createDataFrame([(float(i % 7 * 90), float(i % 5 * 70)) for i in range(100)], "x double, y double")
    mass = density.kde(df, 100.0, [200.0]).agg(F.sum("density")).first()[0] * 0.01
    assert mass == pytest.approx(100, rel=1e-6)


def test_crowded_keys_take_the_split_paths(spark, monkeypatch):
    """The same clusters and components when almost every key counts as hot."""
    monkeypatch.setattr(dbscan, "HOT_ROWS", 20)
    monkeypatch.setattr(components, "HOT_ROWS", 20)
    pts = cluster_points("crowded", random.Random(11)) + cluster_points("arc", random.Random(11))
    near = [(i, j) for i in range(len(pts)) for j in range(i)
            if (pts[i][0] - pts[j][0]) ** 2 + (pts[i][1] - pts[j][1]) ** 2 <= 1.0]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pts)], "id long, x double, y double")
    got = {r.id: r.component for r in dbscan.dbscan(df, 1.0).collect()}
    assert got == smallest_of_component(range(len(pts)), near)
    star = [(500, i) for i in range(150)] + [(500, 900), (900, 901)]
    found = components.connected_components(spark.createDataFrame(star, "src long, dst long")).collect()
    assert len(found) == 153 and {r.component for r in found} == {0}


def test_long_chain_takes_the_split_path(spark, monkeypatch):
    monkeypatch.setattr(linemerge, "HOT_ROWS", 10)
    lines = {i: line((i, 0), (i + 1, 0)) for i in range(40)} | {100: line((0, 5), (1, 5))}
    assert merged(spark, lines) == {0: line(*[(i, 0) for i in range(41)]), 100: lines[100]}


def test_whole_routes_merge_as_large_ones(spark, monkeypatch):
    """A task merges many routes at once, with the lines that the joins over large routes find; some routes are too large."""
    rng, rows = random.Random(5), []
    odd = [0.0, -0.0, None, float("nan"), 1.0]
    for route in range(60):
        near = lambda: rng.choice(odd) if route % 6 == 0 else float(rng.randrange(3))
        for _ in range(rng.choice([1, 2, 3, 9, 30])):
            rows.append((route, rng.choice([1, -1]) * len(rows), [(near(), near()) for _ in range(rng.choice([2, 2, 4]))]))
        ring = [(9.0 + rng.random(), rng.random()) for _ in range(rng.choice([0, 1, 2, 5]))]
        for a, b in zip(ring, ring[1:] + ring[:1]):
            way = [a, b] if a != b else [a, (20.0, 20.0), a]
            rows.append((route, len(rows), way if rng.random() < 0.5 else way[::-1]))
    rows += [(None, 1 << 40, [(0.0, 0.0), (1.0, 0.0)]), (1, None, [(0.0, 0.0), (1.0, 0.0)])]
    lines = spark.createDataFrame(rows, "route_id long, segment_id long, geom array<struct<x: double, y: double>>")
    lines = lines.withColumn("geom", linemerge._tidy("geom")).where("size(geom) > 1").localCheckpoint()
    batch = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(batch)
    spark.conf.set(batch, "7")  # routes go on from batch to batch
    try:
        read = lambda df: sorted(repr(tuple(r)) for r in df.selectExpr("route_id", "line_id", "pos", "x + 0d", "y + 0d").collect())
        found = []
        for most in (200_000, 20, 0):
            monkeypatch.setattr(linemerge, "LOCAL", most)
            found.append(read(linemerge.merge_lines(lines)))
    finally:
        spark.conf.set(batch, before)
    assert found[0] and found[0] == found[1] == found[2]
