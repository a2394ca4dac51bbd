"""Clusters, components, merged routes and density grids over whole tables."""

from pyspark.sql import Window as W, functions as F

from comarca.checks.registry import check
from comarca.checks.scalars import POINTS, located, located_once
from comarca.operators import components, dbscan, density, linemerge
from comarca.scale import HOT_ROWS, exact_quantiles
from comarca.session import stored

PI = "3.141592653589793"
MET = f"""SELECT id, lon, lat, radians(lon) * 6378137.0 AS x, ln(tan({PI} / 4 + radians(lat) / 2)) * 6378137.0 AS y
    FROM ({POINTS}) AS p"""

# clusters of active tech and repair points: smallest id that can be reached in steps of eps
LINKS = f"""
    pts AS (SELECT id, lon, lat FROM ({POINTS}) AS p WHERE situacao_cadastral = 2 AND business_type IN ('tech', 'repairs')),
    links AS (SELECT a.id AS a, b.id AS b FROM pts AS a JOIN pts AS b ON b.lon BETWEEN a.lon - 0.003 AND a.lon + 0.003
        WHERE (a.lon - b.lon) * (a.lon - b.lon) + (a.lat - b.lat) * (a.lat - b.lat) <= CAST(0.003 AS DOUBLE) * CAST(0.003 AS DOUBLE)),
    cc(id, comp) USING KEY (id) AS (
        SELECT id, id FROM pts
        UNION SELECT l.b, min(c.comp) FROM cc AS c JOIN links AS l ON l.a = c.id JOIN recurring.cc AS r ON r.id = l.b
        WHERE c.comp < r.comp GROUP BY l.b)"""


def _active(t):
    from comarca.operators.filters import cluster_input

    return cluster_input(located(t))


@check("g1_dbscan", f"WITH RECURSIVE {LINKS} SELECT id, comp AS component FROM cc")
def g1(t):
    points = _active(t).select("id", F.col("lon").alias("x"), F.col("lat").alias("y"))
    return dbscan.dbscan(points).select("id", "component")


CLUSTERS = f"""WITH RECURSIVE {LINKS}
    SELECT 99 + row_number() OVER (ORDER BY comp) AS cluster_id, n AS total_lojas, round(x, 6) AS x, round(y, 6) AS y
    FROM (SELECT comp, count(*) AS n, avg(lon) AS x, avg(lat) AS y FROM cc JOIN pts ON pts.id = cc.id GROUP BY comp) AS g"""


@check("a1_clusters", CLUSTERS)
def a1(t):
    rows = dbscan.clusters(located(t))
    return rows.select("cluster_id", "total_lojas", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@check("p20_clustered", f"WITH RECURSIVE {LINKS} SELECT count(*) AS n FROM cc WHERE comp IS NOT NULL")
def p20(t):
    points = _active(t).select("id", F.col("lon").alias("x"), F.col("lat").alias("y"))
    return dbscan.dbscan(points).where(F.col("component").isNotNull()).agg(F.count("*").alias("n"))


@check("a6_recount_members", f"""WITH RECURSIVE {LINKS}
    SELECT comp AS cluster_id, count(*) FILTER (cnae_fiscal_principal = '6209100') AS total_lojas
    FROM cc JOIN {{est}} AS e ON e.id = cc.id GROUP BY comp""")
def a6_members(t):
    rows = _active(t).select("id", F.col("lon").alias("x"), F.col("lat").alias("y"), F.col("cnae_fiscal_principal").alias("cnae"))
    return dbscan.recount_members(dbscan.dbscan(rows).withColumnRenamed("component", "cluster_id"), "support")


@check("g1_clusters_lines")
def g1_lines(t):
    """Clusters of one point per order line; too many pairs for plain SQL."""
    from comarca.functions.geo import with_synthetic_point
    from comarca.functions.text import company_id

    rows = t.est_large.withColumn("company", company_id("cnpj_basico", "cnpj_ordem", "cnpj_dv"))
    rows = with_synthetic_point(rows, "company", "business_type", "municipio")
    points = rows.select(F.xxhash64("company", "logradouro", "lon", "lat").alias("id"), F.col("lon").alias("x"), F.col("lat").alias("y"))
    return dbscan.cluster_table(points).select("number", "total_lojas", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


CORES = """
    pts AS (SELECT id, lon, lat FROM ({POINTS}) AS p WHERE situacao_cadastral = 2 AND business_type IN ('tech', 'repairs')),
    near AS (SELECT a.id AS a, b.id AS b FROM pts AS a JOIN pts AS b ON b.lon BETWEEN a.lon - 0.003 AND a.lon + 0.003
        WHERE (a.lon - b.lon) * (a.lon - b.lon) + (a.lat - b.lat) * (a.lat - b.lat) <= CAST(0.003 AS DOUBLE) * CAST(0.003 AS DOUBLE)),
    cores AS (SELECT a AS id FROM near GROUP BY a HAVING count(*) >= 4),
    links AS (SELECT a, b FROM near WHERE a IN (SELECT id FROM cores) AND b IN (SELECT id FROM cores)),
    cc(id, comp) USING KEY (id) AS (
        SELECT id, id FROM cores
        UNION SELECT l.b, min(c.comp) FROM cc AS c JOIN links AS l ON l.a = c.id JOIN recurring.cc AS r ON r.id = l.b
        WHERE c.comp < r.comp GROUP BY l.b),
    reached AS (SELECT n.a AS id, min(n.b) AS core FROM near AS n JOIN cores AS c ON c.id = n.b GROUP BY n.a),
    told AS (SELECT pts.id, CASE WHEN cores.id IS NOT NULL THEN 'core' WHEN reached.id IS NOT NULL THEN 'border' ELSE 'noise' END AS kind,
            coalesce(own.comp, other.comp) AS component, lon, lat
        FROM pts LEFT JOIN cores ON cores.id = pts.id LEFT JOIN cc AS own ON own.id = pts.id
        LEFT JOIN reached ON reached.id = pts.id LEFT JOIN cc AS other ON other.id = reached.core)""".replace("{POINTS}", POINTS)


@check("g1_core_border", f"WITH RECURSIVE {CORES} SELECT id, kind, component FROM told")
def g1_core_border(t):
    """Clusters of four points or more within eps, with their border points; the rest is noise."""
    points = _active(t).select("id", F.col("lon").alias("x"), F.col("lat").alias("y"))
    return dbscan.density_clusters(points, min_points=4).select("id", "kind", "component")


@check("w1_cluster_numbers", f"""WITH RECURSIVE {CORES}
    SELECT 99 + row_number() OVER (ORDER BY component) AS cluster_id, n AS total_lojas, round(x, 6) AS x, round(y, 6) AS y
    FROM (SELECT component, count(*) AS n, avg(lon) AS x, avg(lat) AS y FROM told WHERE component IS NOT NULL GROUP BY component) AS g""")
def w1_numbers(t):
    rows = dbscan.clusters(located(t), min_points=4)
    return rows.select("cluster_id", "total_lojas", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@check("g7_centroids", f"""
    SELECT hub, round(avg(lon), 6) AS x, round(avg(lat), 6) AS y FROM ({POINTS}) AS p GROUP BY hub""")
def g7(t):
    from comarca.functions.geo import hash_digits, hub_of

    rows = located(t).withColumn("hub", hub_of(hash_digits("cnpj_completo"), "business_type"))
    return rows.groupBy("hub").agg(F.round(F.avg("lon"), 6).alias("x"), F.round(F.avg("lat"), 6).alias("y"))


@check("g2_components", """
    SELECT o_custkey AS node, o_custkey AS component FROM {orders} GROUP BY o_custkey
    UNION ALL SELECT 1000000000000 + o_orderkey, o_custkey FROM {orders}""")
def g2(t):
    edges = t.orders.select(F.col("o_custkey").alias("src"), (F.col("o_orderkey") + 1_000_000_000_000).alias("dst"))
    return components.connected_components(edges)


@check("g2_components_hubs", """
    SELECT c_custkey AS node, min(c_custkey) OVER (PARTITION BY c_nationkey) AS component FROM {customer}
    UNION ALL SELECT 1000000000000 + o_orderkey, m FROM {orders} JOIN (
        SELECT c_custkey, min(c_custkey) OVER (PARTITION BY c_nationkey) AS m FROM {customer}) AS c ON o_custkey = c_custkey
    UNION ALL SELECT 2000000000000 + c_nationkey, min(c_custkey) FROM {customer} GROUP BY c_nationkey""")
def g2_hubs(t):
    lines = t.orders.select(F.col("o_custkey").alias("src"), (F.col("o_orderkey") + 1_000_000_000_000).alias("dst"))
    hubs = t.customer.select(F.col("c_custkey").alias("src"), (F.col("c_nationkey") + 2_000_000_000_000).alias("dst"))
    return components.connected_components(lines.unionByName(hubs))


def _route_parts(t):
    vertex = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    rows = t.route_lines
    segments = rows.select(F.col("segment_id").alias("id"), F.array(vertex("ax", "ay"), vertex("bx", "by_")).alias("geom"))
    return segments, rows.select("route_id", "segment_id")


@check("p18_route_segments", """
    SELECT route_id, count(*) AS segments FROM {route_lines} WHERE ax <> bx OR ay <> by_ GROUP BY route_id""")
def p18(t):
    segments, listed = _route_parts(t)
    twice = listed.unionByName(listed)
    return linemerge.route_lines(segments, twice).groupBy("route_id").agg(F.count("*").alias("segments"))


@check("g4_merged_totals", """
    SELECT route_id, count(*) AS edges, round(sum(sqrt((ax - bx) * (ax - bx) + (ay - by_) * (ay - by_))), 6) AS length
    FROM {route_lines} WHERE ax <> bx OR ay <> by_ GROUP BY route_id""")
def g4_totals(t):
    vertices = linemerge.route_vertices(*_route_parts(t))
    # lines are cut into pieces, so a long one is shared by many tasks; where two pieces meet, both have the vertex
    here = F.floor(F.col("pos") / HOT_ROWS)
    pieces = F.when((F.col("pos") % HOT_ROWS == 0) & (here > 0), F.array(here - 1, here)).otherwise(F.array(here))
    line = W.partitionBy("route_id", "line_id", "piece").orderBy("pos")
    dx, dy = F.col("x") - F.lag("x").over(line), F.col("y") - F.lag("y").over(line)
    steps = vertices.withColumn("piece", F.explode(pieces)).select("route_id", F.row_number().over(line).alias("k"), F.sqrt(dx * dx + dy * dy).alias("d")).where("k > 1")
    return steps.groupBy("route_id").agg(F.count("*").alias("edges"), F.round(F.sum("d"), 6).alias("length"))


ENDS = """
    SELECT route_id, x, y, count(*) AS degree FROM (
        SELECT route_id, ax AS x, ay AS y FROM {route_lines} WHERE ax <> bx OR ay <> by_
        UNION ALL SELECT route_id, bx, by_ FROM {route_lines} WHERE ax <> bx OR ay <> by_) AS e GROUP BY ALL"""


@check("g4_line_ends", f"""
    SELECT route_id, x, y, degree AS ends FROM ({ENDS}) AS n WHERE degree <> 2""")
def g4_ends(t):
    """Where merged lines end: at every node that is not passed by exactly two lines, once per line."""
    segments, listed = _route_parts(t)
    lines = stored(linemerge.route_lines(segments, listed))
    vertices = linemerge.merge_lines(lines)
    tips = vertices.groupBy("route_id", "line_id").agg(
        F.min_by(F.struct("x", "y"), "pos").alias("first"), F.max_by(F.struct("x", "y"), "pos").alias("last")
    )
    ends = tips.select("route_id", F.explode(F.array("first", "last")).alias("v")).select("route_id", "v.x", "v.y")
    counted = ends.groupBy("route_id", "x", "y").agg(F.count("*").alias("ends"))
    nodes = lines.select("route_id", F.explode(F.array(F.element_at("geom", 1), F.element_at("geom", -1))).alias("v"))
    degree = nodes.groupBy("route_id", "v.x", "v.y").agg(F.count("*").alias("degree")).where("degree <> 2")
    return counted.join(degree, ["route_id", "x", "y"]).select("route_id", "x", "y", "ends")


@check("g4_routes")
def g4(t):
    segments, listed = _route_parts(t)
    routes = t.orders.select(F.col("o_orderkey").alias("route_id"), F.concat(F.lit("Rota "), "o_orderkey").alias("name"))
    built = linemerge.build_routes(segments, routes, listed)
    return built.select("route_id", "name", linemerge.route_geometry("geom").alias("geometry"))


@check("a11_extent", f"""
    SELECT round(min(x) - 1500, 4) AS min_x, round(min(y) - 1500, 4) AS min_y, round(max(x) + 1500, 4) AS max_x,
        round(max(y) + 1500, 4) AS max_y FROM ({MET}) AS m""")
def a11(t):
    box = density.extent(density.metric_points(located(t)), 1500.0)
    return box.select(*[F.round(c, 4).alias(c) for c in box.columns])


GRID = f"""
    SELECT h AS bandwidth, ix, iy, x0 + ix * 1000.0 AS cell_x, y0 + iy * 1000.0 AS cell_y,
        sum(exp(-((x0 + ix * 1000.0 - x) * (x0 + ix * 1000.0 - x) + (y0 + iy * 1000.0 - y) * (y0 + iy * 1000.0 - y)) / (2 * h * h)))
            * 1e6 / (2 * {PI} * h * h) AS density
    FROM ({MET}) AS m,
        (SELECT min(x) - 1500 AS x0, min(y) - 1500 AS y0, CAST(ceil((max(x) - min(x) + 3000) / 1000.0) AS BIGINT) AS nx,
            CAST(ceil((max(y) - min(y) + 3000) / 1000.0) AS BIGINT) AS ny FROM ({MET}) AS m2) AS b,
        (VALUES (CAST(200 AS DOUBLE)), (CAST(500 AS DOUBLE)), (CAST(1000 AS DOUBLE))) AS w(h),
        LATERAL (SELECT unnest(range(nx)) AS ix) AS c, LATERAL (SELECT unnest(range(ny)) AS iy) AS r
    GROUP BY h, ix, iy, x0, y0"""


def _grid(t):
    return density.kde(density.metric_points(located(t)), resolution=1000.0)


@check("g5_kde_grid", f"""
    SELECT bandwidth, ix, iy, round(cell_x, 3) AS cell_x, round(cell_y, 3) AS cell_y, round(density, 4) AS density FROM ({GRID}) AS g""")
def g5(t):
    three = lambda c: F.round(c, 3).alias(c)
    return _grid(t).select("bandwidth", "ix", "iy", three("cell_x"), three("cell_y"), F.round("density", 4).alias("density"))


# one stray place 60 km off the corner stretches the grid: most cells are out of the kernels' reach
@check("g5_kde_far", f"""
    WITH met AS (SELECT x, y FROM ({MET}) AS m UNION ALL SELECT max(x) + 60000, max(y) + 60000 FROM ({MET}) AS m2),
        places AS (SELECT x, y, count(*) AS n FROM met GROUP BY x, y),
        b AS (SELECT min(x) - 1500 AS x0, min(y) - 1500 AS y0, CAST(ceil((max(x) - min(x) + 3000) / 4000.0) AS BIGINT) AS nx,
            CAST(ceil((max(y) - min(y) + 3000) / 4000.0) AS BIGINT) AS ny FROM met),
        cells AS (SELECT ix, iy, x0 + ix * 4000.0 AS cx, y0 + iy * 4000.0 AS cy FROM b,
            LATERAL (SELECT unnest(range(nx)) AS ix) AS c, LATERAL (SELECT unnest(range(ny)) AS iy) AS r),
        least AS (SELECT ix, iy, cx, cy, min((cx - x) * (cx - x) + (cy - y) * (cy - y)) AS m FROM cells, places GROUP BY ALL)
    SELECT h AS bandwidth, ix, iy, round(ln(sum(n * exp((m - (cx - x) * (cx - x) - (cy - y) * (cy - y)) / (2 * h * h))))
        - m / (2 * h * h) + ln(1e6 / (2 * {PI} * h * h)), 5) AS log_density
    FROM least, places, (VALUES (CAST(200 AS DOUBLE)), (CAST(500 AS DOUBLE)), (CAST(1000 AS DOUBLE))) AS w(h)
    GROUP BY h, ix, iy, m""")
def g5_far(t):
    """Logarithm of the density in every cell, however far from the points."""
    points = density.metric_points(located_once(t, ["lon", "lat"]))
    stray = points.agg((F.max("x") + 60000).alias("x"), (F.max("y") + 60000).alias("y"))
    found = density.kde_far(points.unionByName(stray), resolution=4000.0)
    return found.select("bandwidth", "ix", "iy", F.round("log_density", 5).alias("log_density"))


@check("a13_kernel_sums", f"SELECT bandwidth, round(sum(density), 2) AS mass FROM ({GRID}) AS g GROUP BY bandwidth")
def a13(t):
    return _grid(t).groupBy("bandwidth").agg(F.round(F.sum("density"), 2).alias("mass"))


@check("a12_density_stats", f"""
    SELECT bandwidth, round(min(density), 4) AS min, round(max(density), 4) AS max, round(avg(density), 4) AS mean,
        round(quantile_cont(density, 0.25), 4) AS p25, round(quantile_cont(density, 0.5), 4) AS p50,
        round(quantile_cont(density, 0.75), 4) AS p75 FROM ({GRID}) AS g GROUP BY bandwidth""")
def a12(t):
    stats = density.kde_stats(_grid(t))
    return stats.select("bandwidth", *[F.round(c, 4).alias(c) for c in stats.columns if c != "bandwidth"])


@check("a12_exact_quantiles", """
    SELECT l_returnflag, p AS prob, round(q, 6) AS quantile FROM (
        SELECT l_returnflag, unnest(quantile_cont(l_extendedprice, [0.0, 0.25, 0.5, 0.75, 0.99, 1.0])) AS q,
            unnest(CAST([0.0, 0.25, 0.5, 0.75, 0.99, 1.0] AS DOUBLE[])) AS p FROM {lineitem} GROUP BY l_returnflag) AS s""")
def a12_quantiles(t):
    q = exact_quantiles(t.lineitem, "l_extendedprice", [0.0, 0.25, 0.5, 0.75, 0.99, 1.0], ["l_returnflag"])
    return q.withColumn("quantile", F.round("quantile", 6))


@check("k8_grid_files", f"SELECT bandwidth, count(*) AS cells, round(max(density), 4) AS peak FROM ({GRID}) AS g GROUP BY bandwidth")
def k8(t):
    import uuid

    from comarca.session import checkpoint_dir
    from comarca.sources.writers import write_grid

    path = f"{checkpoint_dir(t.spark)}/grid-{uuid.uuid4().hex}"
    write_grid(_grid(t), path)
    cells = t.spark.read.parquet(path).groupBy(F.col("bandwidth").cast("double").alias("bandwidth"))
    return cells.agg(F.count("*").alias("cells"), F.round(F.max("density"), 4).alias("peak"))


def _density_files(t):
    import uuid

    from comarca.session import checkpoint_dir, durable
    from comarca.sources.writers import write_density_csv

    folder = f"{checkpoint_dir(t.spark)}/density-{uuid.uuid4().hex}"
    grid = durable(_grid(t))
    write_density_csv(grid, density.kde_stats(grid), folder)
    return folder


@check("k5_density_statistics", f"""
    SELECT bandwidth, round(min(density), 4) AS min, round(max(density), 4) AS max, round(avg(density), 4) AS mean,
        round(quantile_cont(density, 0.25), 4) AS p25, round(quantile_cont(density, 0.5), 4) AS p50,
        round(quantile_cont(density, 0.75), 4) AS p75 FROM ({GRID}) AS g GROUP BY bandwidth""")
def k5_statistics(t):
    """Density statistics written as CSV and read back."""
    names = ("min", "max", "mean", "p25", "p50", "p75")
    schema = "bandwidth double, " + ", ".join(f"{c} double" for c in names)
    rows = t.spark.read.schema(schema).option("header", True).option("enforceSchema", False).csv(f"{_density_files(t)}/statistics")
    return rows.select("bandwidth", *[F.round(c, 4).alias(c) for c in names])


@check("k5_density_grid", f"""
    SELECT round(cell_x, 3) AS cell_x, round(cell_y, 3) AS cell_y, round(density, 4) AS density_stores_km2
    FROM ({GRID}) AS g WHERE bandwidth = 500""")
def k5_grid(t):
    """Cells of the 500 m density written as CSV and read back."""
    rows = t.spark.read.schema("cell_x double, cell_y double, density_stores_km2 double").option("header", True).option("enforceSchema", False)
    rows = rows.csv(f"{_density_files(t)}/grid")
    return rows.select(F.round("cell_x", 3).alias("cell_x"), F.round("cell_y", 3).alias("cell_y"), F.round("density_stores_km2", 4).alias("density_stores_km2"))


@check("g5_kde_lines")
def g5_lines(t):
    """Default grid over one point per order line; too many kernels for plain SQL."""
    from comarca.functions.geo import with_synthetic_point
    from comarca.functions.text import company_id

    rows = t.est_large.withColumn("company", company_id("cnpj_basico", "cnpj_ordem", "cnpj_dv"))
    rows = with_synthetic_point(rows, "company", "business_type", "municipio")
    return density.kde(density.metric_points(rows)).withColumn("density", F.round("density", 4))


@check("g6_segment_density", f"""
    SELECT m.id AS segment_id, round(coalesce(density, 0), 4) AS density
    FROM ({MET}) AS m, (SELECT min(x) - 1500 AS x0, min(y) - 1500 AS y0 FROM ({MET}) AS m2) AS b
    LEFT JOIN (SELECT * FROM ({GRID}) AS g WHERE bandwidth = 500) AS g
    ON g.ix = CAST(round((x - x0) / 1000.0) AS BIGINT) AND g.iy = CAST(round((y - y0) / 1000.0) AS BIGINT)""")
def g6(t):
    rows = located(t)
    points = density.metric_points(rows)
    box = density.extent(points, 1500.0).first()
    spot = F.struct(F.col("lon").alias("x"), F.col("lat").alias("y"))
    found = density.density_at(rows.select("id", F.array(spot, spot).alias("geom")), _grid(t), 500.0, box.min_x, box.min_y, 1000.0)
    return found.withColumn("density", F.round("density", 4))


# streets over a grid of their own corners: cells a unit wide, edges cut where they pass from cell to cell
STREET_GRID = f"""
    SELECT ix, iy, sum(exp(-((x0 + ix - ax) * (x0 + ix - ax) + (y0 + iy - ay) * (y0 + iy - ay)) / 2)) * 1e6 / (2 * {PI}) AS density
    FROM {{streets}}, (SELECT min(ax) - 1 AS x0, min(ay) - 1 AS y0, CAST(ceil(max(ax) - min(ax) + 2) AS BIGINT) AS nx,
        CAST(ceil(max(ay) - min(ay) + 2) AS BIGINT) AS ny FROM {{streets}}) AS b,
        LATERAL (SELECT unnest(range(nx)) AS ix) AS c, LATERAL (SELECT unnest(range(ny)) AS iy) AS r
    GROUP BY ix, iy"""


@check("g6_street_density", f"""
    WITH base AS (SELECT min(ax) - 1.5 AS x0, min(ay) - 1.5 AS y0 FROM {{streets}}),
        edges AS (
            SELECT id, 1 AS e, ax - x0 AS px, ay - y0 AS py, bx - x0 AS qx, by_ - y0 AS qy FROM {{streets}}, base
            UNION ALL SELECT id, 2, bx - x0, by_ - y0, cx - x0, cy - y0 FROM {{streets}}, base),
        cuts AS (
            SELECT id, e, px, py, qx, qy, 0.0 AS t FROM edges UNION ALL SELECT id, e, px, py, qx, qy, 1.0 FROM edges
            UNION ALL SELECT id, e, px, py, qx, qy, (k - px) / (qx - px) FROM edges,
                LATERAL (SELECT unnest(range(CAST(floor(least(px, qx)) AS BIGINT) + 1, CAST(ceil(greatest(px, qx)) AS BIGINT))) AS k) AS a
            UNION ALL SELECT id, e, px, py, qx, qy, (k - py) / (qy - py) FROM edges,
                LATERAL (SELECT unnest(range(CAST(floor(least(py, qy)) AS BIGINT) + 1, CAST(ceil(greatest(py, qy)) AS BIGINT))) AS k) AS a),
        steps AS (SELECT *, lead(t) OVER (PARTITION BY id, e ORDER BY t) AS t2 FROM cuts),
        parts AS (SELECT id, CAST(floor(px + (t + t2) / 2 * (qx - px)) AS BIGINT) AS ix, CAST(floor(py + (t + t2) / 2 * (qy - py)) AS BIGINT) AS iy,
            (t2 - t) * sqrt((qx - px) * (qx - px) + (qy - py) * (qy - py)) AS d FROM steps WHERE t2 IS NOT NULL)
    SELECT id AS segment_id, round(CASE WHEN sum(d) > 0 THEN sum(d * coalesce(density, 0)) / sum(d) ELSE max(coalesce(density, 0)) END, 4) AS density
    FROM parts LEFT JOIN ({STREET_GRID}) AS g USING (ix, iy) GROUP BY id""")
def g6_streets(t):
    """Density along every street, by the length that runs in each cell."""
    from comarca.checks.visits import streets

    corners = t.streets.select(F.col("ax").alias("x"), F.col("ay").alias("y"))
    box = density.extent(corners, 1.0).first()
    grid = density.kde(corners, resolution=1.0, bandwidths=(1.0,), margin=1.0)
    found = density.street_density(streets(t), grid, 1.0, box.min_x, box.min_y, 1.0)
    return found.withColumn("density", F.round("density", 4))
