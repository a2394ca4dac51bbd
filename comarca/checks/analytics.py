"""Filters, aggregates, joins, windows and top-k reports over whole tables."""

from pyspark.sql import functions as F

from comarca import fixed
from comarca.checks.registry import check
from comarca.checks.scalars import POINTS, _case, _in, digits, HUB, located, located_once
from comarca.functions import geo, labels, text
from comarca.operators import analytics, cleaning, filters
from comarca.operators.nearest import nearest_centres
from comarca.plans import etl
from comarca.sources import readers, writers

CATEGORY = _case("substr(cnae_fiscal_principal, 1, 2)", fixed.CATEGORIES.items(), "Otros")
STREETS = f"""
    SELECT street, cat, count(*) AS n FROM (
        SELECT trim(logradouro) AS street, {CATEGORY} AS cat FROM {{rows}}
        WHERE trim(coalesce(logradouro, '')) <> '' AND lpad(coalesce(porte_empresa, ''), 2, '0') IN ('01', '03')
    ) AS s GROUP BY street, cat"""


def _streets(view):
    return STREETS.replace("{rows}", "{" + view + "}")


def _told(df):
    listed = F.array_join(
        F.transform("distribucion_rubros", lambda e: F.concat(e["categoria"], F.lit(":"), e["cantidad"].cast("string"))), "|"
    )
    return df.select("logradouro", "total_negocios", listed.alias("rubros"), "predominancia")


TOLD = """
    SELECT street AS logradouro, CAST(sum(n) AS BIGINT) AS total_negocios,
        string_agg(cat || ':' || n, '|' ORDER BY n DESC, cat) AS rubros,
        first(cat ORDER BY n DESC, cat) AS predominancia
    FROM ({streets}) AS s GROUP BY street"""


@check("a3_street_topk", TOLD.replace("{streets}", _streets("est")) + " ORDER BY 2 DESC, 1 LIMIT 15")
def a3(t):
    return _told(analytics.top_streets(t.est))


@check("a3_street_topk_lines", TOLD.replace("{streets}", _streets("est_large")) + " ORDER BY 2 DESC, 1 LIMIT 15")
def a3_lines(t):
    return _told(analytics.top_streets(t.est_large))


@check("o3_street_categories", TOLD.replace("{streets}", _streets("est_large")))
def o3(t):
    return _told(analytics.street_categories(t.est_large))


@check("o2_top_streets", f"""
    SELECT street, CAST(sum(n) AS BIGINT) AS total FROM ({_streets('est_large')}) AS s
    GROUP BY street ORDER BY 2 DESC, 1 LIMIT 15""")
def o2(t):
    return analytics.top_streets(t.est_large).select(
        F.col("logradouro").alias("street"), F.col("total_negocios").alias("total")
    )


FOLDED = "strip_accents(lower(trim(municipio)))"
CITY = "CASE " + " ".join(
    f"WHEN {FOLDED} LIKE '{p}%' THEN '{c}'"
    for p, c in (("londr", "Londrina"), ("cambe", "Cambé"), ("rolan", "Rolândia"), ("arapo", "Arapongas"),
                 ("apuca", "Apucarana"), ("cambi", "Cambira"), ("janda", "Jandaia do Sul"))
) + " END"


@check("j6_corridor_city", f"SELECT id, {CITY} AS city FROM {{est}}")
def j6(t):
    return t.est.select("id", analytics.corridor_city("municipio").alias("city"))


@check("j6_corridor_city_exact", f"""
    SELECT id, CASE WHEN {FOLDED} = 'rolandia' AND trim(municipio) <> 'Rolândia' THEN NULL ELSE {CITY} END AS city
    FROM {{est}}""")
def j6_exact(t):
    return t.est.select("id", analytics.corridor_city("municipio", fold=False).alias("city"))


@check("j7_centroid", f"SELECT id, clng AS lng, clat AS lat FROM ({POINTS}) AS p")
def j7(t):
    return geo.with_centroid(t.est, "municipio", "lng", "lat").select("id", "lng", "lat")


CORRIDOR = "(VALUES " + ", ".join(
    f"({i + 1}, '{c}', CAST({x} AS DOUBLE), CAST({y} AS DOUBLE))" for i, (c, x, y) in enumerate(fixed.CORRIDOR)
) + ") AS d(place, city, lng, lat)"
COUNTED = f"""SELECT {CITY} AS city, business_type FROM {{est_large}}"""


@check("a4_corridor", f"""
    SELECT d.place, d.city, d.lng, d.lat, count(s.city) AS total,
        count(*) FILTER (s.business_type = 'tech') AS tech, count(*) FILTER (s.business_type = 'repairs') AS repairs
    FROM {CORRIDOR} LEFT JOIN ({COUNTED}) AS s ON s.city = d.city GROUP BY ALL
    UNION ALL SELECT 0, NULL, NULL, NULL, count(*), count(*) FILTER (business_type = 'tech'),
        count(*) FILTER (business_type = 'repairs') FROM ({COUNTED}) AS s WHERE city IS NOT NULL""")
def a4(t):
    return analytics.corridor_counts(t.est_large)


@check("a4_corridor_summary", f"""
    SELECT 'BR-369' AS corridor, count(*) AS total_businesses, count(*) FILTER (business_type = 'tech') AS total_tech,
        count(*) FILTER (business_type = 'repairs') AS total_repairs,
        round(count(*) FILTER (business_type = 'tech') / count(*) * 100, 1) AS tech_pct
    FROM ({COUNTED}) AS s WHERE city IS NOT NULL""")
def a4_summary(t):
    return analytics.corridor_summary(t.est_large)


@check("a5_corridor_line", f"""
    SELECT string_agg(lng || ' ' || lat, ', ' ORDER BY place) AS line FROM {CORRIDOR}""")
def a5(t):
    """All cities of the corridor, with shops or without."""
    rows = analytics.corridor_counts(t.est_large).where("place > 0")
    spot = lambda v: F.concat_ws(" ", v["x"].cast("string"), v["y"].cast("string"))
    return analytics.corridor_line(rows).select(F.array_join(F.transform("line", spot), ", ").alias("line"))


@check("a17_feature_collection", f"""
    SELECT 'FeatureCollection' AS type, 8 AS features, 'LineString' AS last_kind, count(*) AS total
    FROM ({COUNTED}) AS s WHERE city IS NOT NULL""")
def a17(t):
    doc = writers.feature_collection(analytics.corridor_features(t.est_large))
    last = F.element_at("document.features", -1)
    return doc.select(
        F.col("document.type").alias("type"), F.size("document.features").alias("features"),
        F.get_json_object(last["geometry"], "$.type").alias("last_kind"),
        F.get_json_object(last["properties"], "$.total_businesses").cast("bigint").alias("total"),
    )


@check("a17_corridor_document", f"""
    SELECT 'FeatureCollection' AS type, 'BR-369' AS corridor, (SELECT string_agg(city, ',' ORDER BY place) FROM {CORRIDOR}) AS cities,
        (SELECT string_agg(city, ',' ORDER BY place) FROM {CORRIDOR}) || ',BR-369 Corridor' AS names,
        count(*) AS total_businesses, count(*) FILTER (business_type = 'tech') AS total_tech,
        count(*) FILTER (business_type = 'repairs') AS total_repairs,
        round(count(*) FILTER (business_type = 'tech') / count(*) * 100, 1) AS tech_pct
    FROM ({COUNTED}) AS s WHERE city IS NOT NULL""")
def a17_document(t):
    doc = analytics.corridor_document(t.est_large).select(F.to_json("document").alias("text")).select(
        F.from_json("text", "type string, features array<struct<properties:string>>, metadata struct<corridor:string,cities:array<string>,"
                    "total_businesses:long,total_tech:long,total_repairs:long,tech_pct:double>").alias("d"))
    names = F.transform("d.features", lambda f: F.get_json_object(f["properties"], "$.name"))
    return doc.select(
        "d.type", "d.metadata.corridor", F.array_join("d.metadata.cities", ",").alias("cities"), F.array_join(names, ",").alias("names"),
        *[f"d.metadata.{c}" for c in ("total_businesses", "total_tech", "total_repairs", "tech_pct")],
    )


TECH = """
    SELECT cnpj_completo AS cnpj, CASE WHEN coalesce(nome_fantasia, '') = '' THEN 'Empresa Tech ' || substr(cnpj_completo, 1, 8)
            ELSE nome_fantasia END AS nome_fantasia,
        cnae_fiscal_principal AS cnae, 'Software & TI' AS cnae_label, '💻' AS cnae_icon,
        CASE WHEN coalesce(bairro, '') = '' THEN 'Centro' ELSE bairro END AS bairro,
        coalesce(logradouro, '') AS logradouro, municipio, business_type
    FROM {est} WHERE business_type = 'tech'"""
FOUND = """ AND (contains(lower(coalesce(nome_fantasia, '')), '{q}') OR contains(lower(cnae_fiscal_principal), '{q}')
    OR contains(lower(coalesce(bairro, '')), '{q}') OR contains(lower(coalesce(logradouro, '')), '{q}'))"""


def _found(q):
    return FOUND.replace("{q}", q)


@check("p7_tech_only", "SELECT id, cnpj_completo FROM {est} WHERE business_type = 'tech'")
def p7(t):
    return t.est.where(F.col("business_type") == "tech").select("id", "cnpj_completo")


@check("p8_search", TECH + _found("rua 1"))
def p8(t):
    return analytics.tech_businesses(t.est, "  RUA 1 ")


@check("p8_search_literal", TECH + _found("_"))
def p8_literal(t):
    return analytics.tech_businesses(t.est, "_")


@check("o4_page", TECH + _found("bairro 1") + " ORDER BY cnpj LIMIT 30 OFFSET 4")
def o4(t):
    return analytics.page(analytics.tech_businesses(t.est, "bairro 1"), "cnpj", 30, 4)


@check("o4_page_after_key", TECH + " AND cnpj_completo > '00000050' ORDER BY cnpj LIMIT 30")
def o4_after(t):
    return analytics.page(analytics.tech_businesses(t.est), "cnpj", 30, after="00000050")


PAGE_STATE = """
    SELECT count(*) AS total, greatest(least(30, count(*) - 4), 0) AS shown,
        4 + greatest(least(30, count(*) - 4), 0) < count(*) AS has_more,
        greatest(count(*) - 4 - greatest(least(30, count(*) - 4), 0), 0) AS remaining
    FROM ({rows}) AS s"""


@check("a14_page_total", f"SELECT count(*) AS total FROM ({TECH + _found('bairro 1')}) AS s")
def a14(t):
    return analytics.page_state(analytics.tech_businesses(t.est, "bairro 1"), 30, 4).select("total")


@check("w6_has_more", PAGE_STATE.replace("{rows}", TECH + _found("bairro 1")))
def w6(t):
    return analytics.page_state(analytics.tech_businesses(t.est, "bairro 1"), 30, 4)


NAMED = """
    SELECT id, nome_fantasia, cnpj_completo AS cnpj, logradouro, bairro FROM {est}"""


@check("p10_autocomplete", f"""
    SELECT * FROM ({NAMED}) AS s WHERE contains(lower(coalesce(nome_fantasia, '')), 'rua 1') OR contains(cnpj, 'rua 1')
        OR contains(lower(coalesce(logradouro, '')), 'rua 1') OR contains(lower(coalesce(bairro, '')), 'rua 1')
    ORDER BY cnpj LIMIT 10""")
def p10(t):
    rows = t.est.select("id", "nome_fantasia", F.col("cnpj_completo").alias("cnpj"), "logradouro", "bairro")
    return filters.autocomplete(rows, "Rua 1")


@check("o6_first_ten", f"""
    SELECT cnpj FROM ({NAMED}) AS s WHERE contains(lower(coalesce(bairro, '')), 'bairro 2') ORDER BY cnpj LIMIT 10""")
def o6(t):
    rows = t.est.select("nome_fantasia", F.col("cnpj_completo").alias("cnpj"), "logradouro", "bairro")
    return filters.autocomplete(rows, "bairro 2").select("cnpj")


@check("p2_region", f"SELECT id FROM {{est}} WHERE codigo_municipio IN ({', '.join(map(str, fixed.CITY_CODES_BROAD))})")
def p2(t):
    return filters.in_region(t.est, fixed.CITY_CODES_BROAD).select("id")


@check("p2_named_cities", f"SELECT codigo FROM {{reg_municipios}} WHERE upper(trim(descricao)) IN {_in(fixed.CITY_NAMES)}")
def p2_named(t):
    return filters.in_named_cities(t.reg_municipios).select("codigo")


@check("p3_active", "SELECT id FROM {est} WHERE situacao_cadastral = 2")
def p3(t):
    return filters.active(t.est).select("id")


@check("p4_codes", f"SELECT count(*) AS n FROM {{est_large}} WHERE cnae_fiscal_principal IN {_in(etl.BROAD.codes)}")
def p4(t):
    return filters.with_codes(t.est_large, etl.BROAD.codes).agg(F.count("*").alias("n"))


@check("p4_code_table", """
    SELECT count(*) AS n FROM {est_large} WHERE cnae_fiscal_principal IN (SELECT cnae_fiscal_principal FROM {est})""")
def p4_table(t):
    codes = t.est.select("cnae_fiscal_principal").distinct()
    return filters.with_codes(t.est_large, codes).agg(F.count("*").alias("n"))


@check("p5_all_filters", f"""
    SELECT id FROM {{est}} WHERE situacao_cadastral = 2 AND cnae_fiscal_principal IN {_in(etl.TECH.codes)}
        AND codigo_municipio IN ({', '.join(map(str, fixed.CITY_CODES_TECH))})""")
def p5(t):
    rows = filters.active(filters.in_region(t.est, fixed.CITY_CODES_TECH))
    return filters.with_codes(rows, etl.TECH.codes).select("id")


@check("p6_small_on_streets", """
    SELECT id FROM {est} WHERE trim(coalesce(logradouro, '')) <> ''
        AND lpad(coalesce(porte_empresa, ''), 2, '0') IN ('01', '03')""")
def p6(t):
    return filters.on_streets(t.est).select("id")


@check("p9_sectors", """
    SELECT 'software' AS sector, count(*) AS n FROM {est} WHERE cnae_fiscal_principal IN ('6201501', '6202300')
    UNION ALL SELECT 'support', count(*) FROM {est} WHERE cnae_fiscal_principal = '6209100'
    UNION ALL SELECT 'repairs', count(*) FROM {est} WHERE cnae_fiscal_principal IN ('9511800', '9512600')
    UNION ALL SELECT 'all', count(*) FROM {est}""")
def p9(t):
    counts = t.est.agg(
        *[F.count_if(labels.sector_filter("cnae_fiscal_principal", s)).alias(s) for s in ("software", "support", "repairs", "all")]
    )
    return counts.unpivot([], counts.columns, "sector", "n")


@check("p12_pending", "SELECT id FROM {est} WHERE coalesce(geocoded, FALSE) = FALSE AND situacao_cadastral = 2 ORDER BY id")
def p12(t):
    return readers.pending(t.est).select("id").orderBy("id")


@check("o5_pending_order", """
    SELECT id, municipio FROM {est} WHERE (geocoded IS NULL OR geocoded = FALSE) AND situacao_cadastral = 2 ORDER BY id""")
def o5(t):
    return readers.pending(t.est).select("id", "municipio").orderBy("id")


@check("p13_valid", "SELECT id FROM {est} WHERE trim(coalesce(municipio, '')) <> '' AND trim(coalesce(cnae_fiscal_principal, '')) <> ''")
def p13(t):
    return filters.valid(t.est).select("id")


@check("p14_cluster_input", """
    SELECT id FROM {est} WHERE situacao_cadastral = 2 AND longitude IS NOT NULL AND latitude IS NOT NULL
        AND business_type IN ('tech', 'repairs')""")
def p14(t):
    return filters.cluster_input(t.est.withColumns({"lon": F.col("longitude"), "lat": F.col("latitude")})).select("id")


@check("p21_state", "SELECT o_orderkey FROM {reg_estab} WHERE uf = 'PR'")
def p21(t):
    return filters.in_state(t.reg_estab).select("o_orderkey")


HUB_COUNTS = f"""
    SELECT d.hub AS cluster_id, count(s.hub) AS total_lojas, d.x, d.y
    FROM (VALUES {', '.join(f'({h[0]}, CAST({h[2]} AS DOUBLE), CAST({h[3]} AS DOUBLE))' for h in fixed.HUBS)}) AS d(hub, x, y)
    LEFT JOIN (SELECT {HUB} AS hub FROM (SELECT *, {digits('cnpj_completo')} AS h FROM {{est}}) AS a) AS s ON s.hub = d.hub
    GROUP BY ALL"""


@check("a2_hub_counts", HUB_COUNTS)
def a2(t):
    return analytics.hub_counts(t.est)


@check("o1_ranked_hubs", f"SELECT cluster_id, total_lojas FROM ({HUB_COUNTS}) AS s ORDER BY 2 DESC, 1")
def o1(t):
    return analytics.ranked(analytics.hub_counts(t.est)).select("cluster_id", "total_lojas")


NEAREST = f"""
    SELECT id, cnae_fiscal_principal AS cnae, (SELECT hub FROM (VALUES {', '.join(f'({h[0]}, {h[2]}, {h[3]})' for h in fixed.HUBS)}) AS d(hub, x, y)
        ORDER BY (lon - x) * (lon - x) + (lat - y) * (lat - y), hub LIMIT 1) AS hub
    FROM ({POINTS}) AS p"""


@check("j8_nearest_hub", f"SELECT id, hub FROM ({NEAREST}) AS s")
def j8(t):
    return located(t).select("id", geo.nearest_hub("lon", "lat").alias("hub"))


@check("j5_hub_metadata", f"""
    SELECT id, h.hub, h.zone FROM ({NEAREST}) AS s JOIN (VALUES {', '.join(f"({h[0]}, '{h[4]}')" for h in fixed.HUBS)}) AS h(hub, zone) ON s.hub = h.hub""")
def j5(t):
    rows = located(t).select("id", geo.nearest_hub("lon", "lat").alias("hub"))
    return analytics.with_hub(rows).select("id", "hub", "zone")


RECOUNT = f"""
    SELECT c.cluster_id, coalesce(n, 0) AS total_lojas FROM ({HUB_COUNTS}) AS c LEFT JOIN (
        SELECT hub, count(*) AS n FROM ({NEAREST}) AS s WHERE cnae IN ('9511800', '9512600') GROUP BY hub
    ) AS r ON r.hub = c.cluster_id"""


def _recount(t):
    points = located(t).withColumn("cnae", F.col("cnae_fiscal_principal"))
    return analytics.recount(analytics.hub_counts(t.est), points, "repairs")


@check("a6_sector_recount", RECOUNT)
def a6(t):
    return _recount(t).select("cluster_id", "total_lojas")


@check("a6_recount_centres", f"""
    SELECT d.place AS cluster_id, coalesce(n, 0) AS total_lojas FROM {CORRIDOR} LEFT JOIN (
        SELECT near, count(*) AS n FROM (
            SELECT (SELECT place FROM {CORRIDOR}
                ORDER BY (p.lon - d.lng) * (p.lon - d.lng) + (p.lat - d.lat) * (p.lat - d.lat), place LIMIT 1) AS near
            FROM ({POINTS}) AS p WHERE cnae_fiscal_principal IN ('6201501', '6202300')) AS s
        GROUP BY near) AS r ON r.near = d.place""")
def a6_centres(t):
    points = located(t).withColumn("cnae", F.col("cnae_fiscal_principal"))
    rows = analytics.corridor_counts(t.est).where("place > 0")
    centres = rows.select(F.col("place").alias("cluster_id"), F.col("lng").alias("x"), F.col("lat").alias("y"),
                          F.col("total").alias("total_lojas"))
    return analytics.recount(centres, points, "software", centres).select("cluster_id", "total_lojas")


# one centre per order, on a lattice where many are equally near
CENTRES = """SELECT o_orderkey AS cluster_id, CAST(-52 AS DOUBLE) + CAST(o_orderkey % 1009 AS DOUBLE) / CAST(500 AS DOUBLE) AS x,
    CAST(-24 AS DOUBLE) + CAST(o_orderkey * 7 % 997 AS DOUBLE) / CAST(500 AS DOUBLE) AS y FROM {orders}"""
NEAREST = f"""SELECT id, cnae_fiscal_principal AS cnae, hit.cluster_id AS cluster_id FROM (
    SELECT p.id, any_value(cnae_fiscal_principal) AS cnae_fiscal_principal, min(struct_pack(
        d2 := (p.lon - c.x) * (p.lon - c.x) + (p.lat - c.y) * (p.lat - c.y), cluster_id := c.cluster_id)) AS hit
    FROM ({POINTS}) AS p, ({CENTRES}) AS c GROUP BY p.id) AS m"""


def _centres(t):
    part = lambda c, k: F.expr(f"cast({c} % {k} as double) / 500d")
    return t.orders.select(
        F.col("o_orderkey").alias("cluster_id"), (F.lit(-52.0) + part("o_orderkey", 1009)).alias("x"),
        (F.lit(-24.0) + part("o_orderkey * 7", 997)).alias("y"),
    )


@check("a6_many_centres", f"""
    SELECT c.cluster_id, coalesce(n, 0) AS total_lojas FROM ({CENTRES}) AS c LEFT JOIN (
        SELECT cluster_id, count(*) AS n FROM ({NEAREST}) AS s WHERE cnae IN ('6201501', '6202300') GROUP BY cluster_id) AS r
    ON r.cluster_id = c.cluster_id""")
def a6_many(t):
    points = located(t).withColumn("cnae", F.col("cnae_fiscal_principal"))
    centres = _centres(t).withColumn("total_lojas", F.lit(0).cast("long"))
    return analytics.recount(centres, points, "software", centres).select("cluster_id", "total_lojas")


@check("j8_nearest_centres", f"SELECT id, cluster_id FROM ({NEAREST}) AS s")
def j8_centres(t):
    points = located_once(t, ["id", F.col("lon").alias("x"), F.col("lat").alias("y")])
    return points.join(nearest_centres(points, _centres(t)), ["x", "y"]).select("id", "cluster_id")


@check("o8_recount_order", f"SELECT cluster_id, total_lojas FROM ({RECOUNT}) AS s ORDER BY 2 DESC, 1")
def o8(t):
    return analytics.ranked(_recount(t)).select("cluster_id", "total_lojas")


@check("p17_non_zero", f"SELECT cluster_id FROM ({RECOUNT}) AS s WHERE total_lojas > 0")
def p17(t):
    return filters.non_zero(_recount(t)).select("cluster_id")


STREET_CLUSTERS = """
    SELECT CAST(s_nationkey AS BIGINT) AS cluster_id, count(*) AS total_lojas
    FROM {lineitem} JOIN {supplier} ON l_suppkey = s_suppkey GROUP BY 1"""


def _groups(t):
    rows = t.lineitem.join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    return rows.groupBy(F.col("s_nationkey").cast("bigint").alias("cluster_id")).agg(F.count("*").alias("total_lojas"))


@check("p11_find_clusters", f"SELECT cluster_id FROM ({STREET_CLUSTERS}) AS s WHERE contains(CAST(cluster_id AS VARCHAR), '1')")
def p11(t):
    return filters.find_clusters(_groups(t), "Polo 1").select("cluster_id")


@check("a7_cluster_summary", f"""
    SELECT CAST(sum(total_lojas) AS BIGINT) AS total, CAST(round(avg(total_lojas)) AS BIGINT) AS average,
        '#' || first(cluster_id ORDER BY total_lojas DESC, cluster_id) AS top_cluster FROM ({STREET_CLUSTERS}) AS s""")
def a7(t):
    return analytics.cluster_summary(_groups(t))


@check("w2_ranking", """
    SELECT l_partkey AS cluster_id, n AS total_lojas, row_number() OVER (ORDER BY n DESC, l_partkey) AS position,
        row_number() OVER (ORDER BY n DESC, l_partkey) <= 3 AS premium
    FROM (SELECT l_partkey, count(*) AS n FROM {lineitem} GROUP BY l_partkey) AS s""")
def w2(t):
    groups = t.lineitem.groupBy(F.col("l_partkey").alias("cluster_id")).agg(F.count("*").alias("total_lojas"))
    return analytics.with_rank(groups)


@check("a8_type_and_city", """
    SELECT business_type, municipio, count(*) AS n FROM {est_large} GROUP BY GROUPING SETS ((business_type), (municipio), ())""")
def a8(t):
    return analytics.counts_by_type_and_city(t.est_large)


@check("o7_city_counts", "SELECT municipio, count(*) AS n FROM {est_large} GROUP BY municipio ORDER BY n DESC, municipio")
def o7(t):
    rows = analytics.counts_by_type_and_city(t.est_large)
    return rows.where("business_type is null and municipio is not null").select("municipio", "n").orderBy(F.desc("n"), "municipio")


@check("a10_profile", f"""
    SELECT count(*) AS total, count(*) FILTER (codigo_municipio IN ({', '.join(map(str, fixed.PROFILE_CITIES))})) AS n_region,
        count(*) FILTER (situacao_cadastral = 2) AS n_active,
        {', '.join(f"count(*) FILTER (cnae_fiscal_principal IN {_in(c)}) AS n_{k}" for k, c in fixed.PROFILE_CODES.items())}
    FROM {{est}}""")
def a10(t):
    return analytics.profile(t.est)


DOUBLED = """
    SELECT *, id AS seq FROM {est} UNION ALL
    SELECT * REPLACE (' ' || cnpj_basico AS cnpj_basico, 'Copy' AS nome_fantasia), id + 1000000000 AS seq
    FROM {est} WHERE id % 3 = 0"""


def _doubled(t):
    copies = t.est.where("id % 3 = 0").withColumns(
        {"cnpj_basico": F.concat(F.lit(" "), "cnpj_basico"), "nome_fantasia": F.lit("Copy"), "seq": F.col("id") + 1_000_000_000}
    )
    return t.est.withColumn("seq", F.col("id")).unionByName(copies)


@check("w3_keep_first", f"""
    SELECT seq, nome_fantasia FROM (SELECT *, row_number() OVER (PARTITION BY trim(cnpj_basico), trim(cnpj_ordem), trim(cnpj_dv)
        ORDER BY seq) AS r FROM ({DOUBLED}) AS d) AS s WHERE r = 1""")
def w3(t):
    return cleaning.distinct_companies(_doubled(t), "seq").select("seq", "nome_fantasia")


@check("a18_distinct_companies", f"""
    SELECT count(DISTINCT trim(cnpj_basico) || '/' || trim(cnpj_ordem) || '/' || trim(cnpj_dv)) AS n FROM ({DOUBLED}) AS d""")
def a18(t):
    return cleaning.distinct_companies(_doubled(t), "seq").agg(F.count("*").alias("n"))


@check("a9_quality_report", f"""
    SELECT (SELECT count(*) FROM ({DOUBLED}) AS d) AS original,
        (SELECT count(*) FROM ({DOUBLED}) AS d) - (SELECT count(*) FROM {{est}}) AS duplicates,
        (SELECT count(*) FROM {{est}}) AS clean,
        round(CAST((SELECT count(*) FROM ({DOUBLED}) AS d) - (SELECT count(*) FROM {{est}}) AS DOUBLE)
            / (SELECT count(*) FROM ({DOUBLED}) AS d) * 100, 2) AS percent_removed""")
def a9(t):
    return cleaning.quality_report(_doubled(t))


@check("clean_records", """
    SELECT id, CASE WHEN trim(coalesce(nome_fantasia, '')) = '' THEN 'Sin nombre fantasía' ELSE trim(nome_fantasia) END AS nome_fantasia,
        trim(logradouro) AS logradouro, bairro FROM {est}""")
def clean_records(t):
    return cleaning.clean(_doubled(t), "seq").select("id", "nome_fantasia", "logradouro", "bairro")


REGISTRY = f"""
    FROM {{reg_estab}} AS e JOIN {{reg_municipios}} AS m ON e.codigo_municipio = m.codigo
    LEFT JOIN {{reg_empresas}} AS p ON e.cnpj_basico = p.cnpj_basico
    WHERE e.uf = 'PR' AND e.codigo_situacao_cadastral = 2 AND upper(trim(m.descricao)) IN {_in(fixed.CITY_NAMES)}
        AND e.codigo_cnae_fiscal_principal IN {_in(etl.TECH.codes)}"""
CITY_NAME = _case("upper(trim(m.descricao))", fixed.CITY_NAMES.items(), "Unknown")


def _registry(t):
    return etl.etl_registry(t.reg_estab, t.reg_municipios, t.reg_empresas)


@check("etl_registry", f"""
    SELECT lpad(e.cnpj_basico, 8, '0') || lpad(e.cnpj_ordem, 4, '0') || lpad(e.cnpj_dv, 2, '0') AS cnpj_completo,
        CASE WHEN nome_fantasia = '' THEN NULL ELSE nome_fantasia END AS nome_fantasia, CAST(2 AS BIGINT) AS situacao_cadastral,
        codigo_cnae_fiscal_principal AS cnae_fiscal, trim(logradouro) AS logradouro, numero,
        coalesce(trim(bairro), '') AS bairro, cep, trim(ddd_1) AS ddd_1, {CITY_NAME} AS municipio,
        CASE WHEN codigo_cnae_fiscal_principal LIKE '62%' THEN 'tech' ELSE 'repairs' END AS business_type,
        codigo_porte_empresa AS porte_empresa {REGISTRY}""")
def etl_registry(t):
    return _registry(t).select(
        "cnpj_completo", "nome_fantasia", "situacao_cadastral", "cnae_fiscal", "logradouro", "numero", "bairro", "cep",
        "ddd_1", "municipio", "business_type", "porte_empresa",
    )


@check("j1_city_join", """
    SELECT o_orderkey, trim(descricao) AS city FROM {reg_estab} JOIN {reg_municipios} ON codigo_municipio = codigo""")
def j1(t):
    places = t.reg_municipios
    joined = t.reg_estab.join(places, F.col("codigo_municipio") == F.col("codigo"))
    return joined.select("o_orderkey", F.trim("descricao").alias("city"))


@check("j2_company_join", """
    SELECT o_orderkey, codigo_porte_empresa AS size FROM {reg_estab} AS e LEFT JOIN {reg_empresas} AS p ON e.cnpj_basico = p.cnpj_basico""")
def j2(t):
    from comarca.scale import skew_join

    joined = skew_join(t.reg_estab, t.reg_empresas, ["cnpj_basico"], "left")
    return joined.select("o_orderkey", F.col("codigo_porte_empresa").alias("size"))


@check("j2_company_join_split", """
    SELECT o_orderkey, codigo_porte_empresa AS size FROM {reg_estab} AS e LEFT JOIN {reg_empresas} AS p ON e.cnpj_basico = p.cnpj_basico""")
def j2_split(t):
    from comarca.scale import skew_join

    joined = skew_join(t.reg_estab, t.reg_empresas, ["cnpj_basico"], "left", min_rows=15)
    return joined.select("o_orderkey", F.col("codigo_porte_empresa").alias("size"))


@check("s7_registry_verification", f"""
    SELECT CASE WHEN codigo_cnae_fiscal_principal LIKE '62%' THEN 'tech' ELSE 'repairs' END AS business_type,
        {CITY_NAME} AS municipio, count(*) AS n {REGISTRY} GROUP BY GROUPING SETS ((1), (2), ())""")
def s7(t):
    return analytics.counts_by_type_and_city(_registry(t))


ADDRESS = """concat_ws(', ', CASE WHEN trim(coalesce(logradouro, '')) <> '' THEN trim(logradouro)
    || CASE WHEN coalesce(numero, '') NOT IN ('', '0', 'S/N', 'SN', 's/n') THEN ', ' || numero ELSE '' END END,
    trim(bairro), trim(municipio), 'PR', 'Brazil')"""
GAZETTEER = f"""SELECT {ADDRESS} AS address, min(CAST(-52 AS DOUBLE) + CAST(id AS DOUBLE) / CAST(1000000 AS DOUBLE)) AS glon,
    min(CAST(-24 AS DOUBLE) + CAST(id AS DOUBLE) / CAST(1000000 AS DOUBLE)) AS glat FROM {{est}} WHERE id % 2 = 0 GROUP BY 1"""
LOCATED = f"""
    SELECT p.id, CASE WHEN g.address IS NOT NULL THEN glon ELSE p.lon END AS lon,
        CASE WHEN g.address IS NOT NULL THEN glat ELSE p.lat END AS lat,
        CASE WHEN g.address IS NOT NULL THEN 'nominatim' ELSE 'fallback' END AS source
    FROM ({POINTS}) AS p LEFT JOIN ({GAZETTEER}) AS g ON g.address = {ADDRESS}
    WHERE p.situacao_cadastral = 2 AND coalesce(p.geocoded, FALSE) = FALSE"""


def _gazetteer(t):
    address = text.address("logradouro", "numero", "bairro", "municipio").alias("address")
    return t.est.where("id % 2 = 0").groupBy(address).agg(
        F.min(F.lit(-52.0) + F.col("id") / F.lit(1e6)).alias("lon"), F.min(F.lit(-24.0) + F.col("id") / F.lit(1e6)).alias("lat")
    )


def _geocoded(t):
    from comarca.plans.geocode import geocode

    return geocode(t.est, _gazetteer(t))


@check("j14_geocode", f"SELECT id, round(lon, 10) AS lon, round(lat, 10) AS lat, source FROM ({LOCATED}) AS s")
def j14(t):
    return _geocoded(t).select("id", F.round("lon", 10).alias("lon"), F.round("lat", 10).alias("lat"), "source")


@check("a16_geocode_counts", f"SELECT source, count(*) AS n FROM ({LOCATED}) AS s GROUP BY source")
def a16(t):
    from comarca.plans.geocode import geocode_counts

    return geocode_counts(_geocoded(t))


@check("t3_geocode_stream", f"SELECT id, round(lon, 10) AS lon, round(lat, 10) AS lat, source FROM ({LOCATED}) AS s")
def t3_stream(t):
    """Pending establishments as files, located in bounded batches."""
    import uuid

    from comarca.session import checkpoint_dir
    from comarca.streaming import geocode

    root = f"{checkpoint_dir(t.spark)}/geocode-{uuid.uuid4().hex}"
    todo = readers.pending(t.est).select("id", "cnpj_completo", "logradouro", "numero", "bairro", "municipio", "business_type")
    todo.repartition(3, "id").write.json(f"{root}/queue")
    rows = geocode.read_pending(t.spark, f"{root}/queue", 2)
    geocode.start_geocoding(rows, _gazetteer(t), f"{root}/located", f"{root}/progress").awaitTermination()
    found = geocode.located_rows(t.spark, f"{root}/located")
    return found.select("id", F.round("lon", 10).alias("lon"), F.round("lat", 10).alias("lat"), "source")


def _filled(t):
    from comarca.plans.geocode import apply_points

    est = t.est.withColumns(
        {"longitude": F.col("longitude").cast("decimal(11,8)"), "latitude": F.col("latitude").cast("decimal(10,8)")}
    )
    return apply_points(est, _geocoded(t))


@check("k6_fill_points", f"""
    SELECT e.id, coalesce(s.lon, e.longitude) IS NOT NULL AS placed, TRUE AS exact,
        CASE WHEN s.id IS NOT NULL THEN TRUE ELSE e.geocoded END AS geocoded
    FROM {{est}} AS e LEFT JOIN ({LOCATED}) AS s ON s.id = e.id""")
def k6(t):
    """Stored points keep eight decimals, so they are compared with the point they came from."""
    made = _geocoded(t).select("id", F.col("lon").alias("x"), F.col("lat").alias("y"))
    old = t.est.select("id", F.col("longitude").alias("x0"), F.col("latitude").alias("y0"))
    rows = _filled(t).join(old, "id").join(made, "id", "left")
    off = lambda stored, new, was: F.abs(F.col(stored).cast("double") - F.coalesce(new, was)) <= 1e-8
    exact = F.coalesce(off("longitude", "x", "x0") & off("latitude", "y", "y0"), F.lit(True))
    return rows.select("id", F.col("longitude").isNotNull().alias("placed"), exact.alias("exact"), "geocoded")


@check("t3_geocode_resumed", """
    SELECT count(*) AS pending FROM {est} WHERE FALSE""")
def t3(t):
    return readers.pending(_filled(t)).agg(F.count("*").alias("pending"))


@check("s8_pending", """
    SELECT id, cnpj_completo, logradouro FROM {est} WHERE coalesce(geocoded, FALSE) = FALSE AND situacao_cadastral = 2""")
def s8(t):
    return readers.pending(t.est).select("id", "cnpj_completo", "logradouro")


@check("s5_street_scan", """
    SELECT logradouro, cnae_fiscal_principal AS cnae, porte_empresa FROM {est}
    WHERE logradouro IS NOT NULL AND trim(logradouro) <> '' AND porte_empresa IN ('1', '01', '3', '03')""")
def s5(t):
    return filters.on_streets(readers.street_scan(t.est))


@check("s6_first_source", "SELECT c_custkey FROM {customer}")
def s6(t):
    empty = lambda: t.customer.where("c_custkey < 0")
    missing = lambda: t.spark.read.parquet(f"{t.folder}/none.parquet")
    return readers.first_non_empty([missing, empty, lambda: t.customer]).select("c_custkey")


@check("p1_kept_columns", """
    SELECT cnpj_basico, cnpj_ordem, cnpj_dv, nome_fantasia, cnae_fiscal_principal, logradouro, numero, bairro,
        porte_empresa, municipio FROM {est}""")
def p1(t):
    return filters.keep_columns(t.est)


@check("u1_union_sources", """
    SELECT cnae_fiscal_principal AS code, count(*) AS n FROM (SELECT cnae_fiscal_principal FROM {est} UNION ALL
        SELECT cnae_fiscal_principal FROM {est_large}) AS s GROUP BY 1""")
def u1(t):
    both = t.est.unionByName(t.est_large, allowMissingColumns=True)
    return both.groupBy(F.col("cnae_fiscal_principal").alias("code")).agg(F.count("*").alias("n"))


@check("u2_union_codes", """
    SELECT cnae_fiscal_principal AS code FROM {est} UNION SELECT codigo_cnae_fiscal_principal FROM {reg_estab}""")
def u2(t):
    one = t.est.select(F.col("cnae_fiscal_principal").alias("code"))
    return one.union(t.reg_estab.select("codigo_cnae_fiscal_principal")).distinct()
