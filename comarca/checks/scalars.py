"""Column functions over whole tables."""

from pyspark.sql import functions as F

from comarca import fixed
from comarca.checks.registry import check
from comarca.functions import geo, labels, text
from comarca.scale import pieces_for
from comarca.session import stored


def _case(subject, pairs, other):
    whens = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in pairs)
    return f"CASE {subject} {whens} ELSE '{other}' END"


def _in(codes):
    return "(" + ", ".join(f"'{c}'" for c in codes) + ")"


NUMBER = r"'^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$'"

# md5 of a text as a number, modulo one million
DIGITS = """CAST((((CAST('0x' || substr(md5({c}), 1, 8) AS BIGINT) % 1000000 * 967296
    + CAST('0x' || substr(md5({c}), 9, 8) AS BIGINT)) % 1000000 * 967296
    + CAST('0x' || substr(md5({c}), 17, 8) AS BIGINT)) % 1000000 * 967296
    + CAST('0x' || substr(md5({c}), 25, 8) AS BIGINT)) % 1000000 AS BIGINT)"""


def digits(column):
    return DIGITS.replace("{c}", column)


HUB = """CASE business_type
    WHEN 'gastronomy' THEN CASE h % 5 WHEN 0 THEN 2 WHEN 1 THEN 3 WHEN 2 THEN 5 WHEN 3 THEN 1 ELSE 4 END
    WHEN 'tech' THEN CASE h % 5 WHEN 0 THEN 3 WHEN 1 THEN 2 WHEN 2 THEN 1 WHEN 3 THEN 5 ELSE 4 END
    ELSE CASE h % 5 WHEN 0 THEN 1 WHEN 1 THEN 4 WHEN 2 THEN 2 WHEN 3 THEN 3 ELSE 5 END END"""


def _hub_case(place):
    return " ".join(f"WHEN {h[0]} THEN CAST({h[place]} AS DOUBLE)" for h in fixed.HUBS)


# stored or made point of each establishment: lon, lat
POINTS = f"""
    SELECT *, CASE WHEN clng IS NULL THEN CASE hub {_hub_case(2)} END ELSE clng END
            + fx * fx * fx * spread AS lon,
        CASE WHEN clat IS NULL THEN CASE hub {_hub_case(3)} END ELSE clat END
            + fy * fy * fy * spread AS lat
    FROM (
        SELECT *, {HUB} AS hub, CAST(h % 1000 - 500 AS DOUBLE) / CAST(500 AS DOUBLE) AS fx,
            CAST(h // 1000 % 1000 - 500 AS DOUBLE) / CAST(500 AS DOUBLE) AS fy,
            CASE WHEN clng IS NULL THEN CAST(0.0075 AS DOUBLE) ELSE CAST(0.015 AS DOUBLE) END AS spread
        FROM (
            SELECT *, {digits('cnpj_completo')} AS h,
                CASE WHEN k LIKE 'cambir%' THEN CAST(-51.5778 AS DOUBLE)
                    WHEN k LIKE 'camb%' THEN CAST(-51.2782 AS DOUBLE)
                    WHEN k LIKE 'ibipor%' THEN CAST(-51.0478 AS DOUBLE)
                    WHEN k LIKE 'roland%' THEN CAST(-51.3897 AS DOUBLE)
                    WHEN k LIKE 'arapong%' THEN CAST(-51.4244 AS DOUBLE)
                    WHEN k LIKE '%apucar%' THEN CAST(-51.4614 AS DOUBLE)
                    WHEN k LIKE '%janda%' OR k LIKE '%jata%' THEN CAST(-51.6447 AS DOUBLE) END AS clng,
                CASE WHEN k LIKE 'cambir%' THEN CAST(-23.5828 AS DOUBLE)
                    WHEN k LIKE 'camb%' THEN CAST(-23.2758 AS DOUBLE)
                    WHEN k LIKE 'ibipor%' THEN CAST(-23.2694 AS DOUBLE)
                    WHEN k LIKE 'roland%' THEN CAST(-23.3105 AS DOUBLE)
                    WHEN k LIKE 'arapong%' THEN CAST(-23.4194 AS DOUBLE)
                    WHEN k LIKE '%apucar%' THEN CAST(-23.5521 AS DOUBLE)
                    WHEN k LIKE '%janda%' OR k LIKE '%jata%' THEN CAST(-23.6064 AS DOUBLE) END AS clat
            FROM (SELECT *, strip_accents(lower(trim(municipio))) AS k FROM {{est}}) AS a
        ) AS b
    ) AS c"""


def located(t):
    """Establishments with made coordinates lon, lat."""
    return geo.with_synthetic_point(t.est, "cnpj_completo", "business_type", "municipio")


def located_once(t, columns):
    """``columns`` of ``located``, worked out once and stored.

    The hash of a name takes long beside reading it, so rows are dealt out first: a table of millions may be one small file.
    """
    dealt = t.est.repartition(pieces_for(t.est))
    return stored(geo.with_synthetic_point(dealt, "cnpj_completo", "business_type", "municipio").select(*columns))


@check("f1_lenient_numbers", f"""
    SELECT id, CASE WHEN regexp_matches(trim(number_text), {NUMBER})
            THEN CAST(trim(number_text) AS DOUBLE) END AS number,
        CASE WHEN regexp_matches(trim(number_text), {NUMBER})
            THEN CAST(trunc(CAST(trim(number_text) AS DOUBLE)) AS BIGINT) END AS whole
    FROM {{dirty}}""")
def f1(t):
    return t.dirty.select("id", text.to_number("number_text").alias("number"),
                          text.to_whole("number_text").alias("whole"))


@check("f2_clean_code", r"""
    SELECT id, regexp_replace(code_text, '[-/\s.]', '', 'g') AS code FROM {dirty}""")
def f2(t):
    return t.dirty.select("id", text.clean_code("code_text").alias("code"))


@check("f3_company_id", "SELECT id, cnpj_completo AS company FROM {est}")
def f3(t):
    return t.est.select("id", text.company_id("cnpj_basico", "cnpj_ordem", "cnpj_dv").alias("company"))


@check("f3_company_id_lines", """
    SELECT company, count(*) AS n FROM (
        SELECT lpad(cnpj_basico, 8, '0')
            || lpad(cnpj_ordem, 4, '0') || lpad(cnpj_dv, 2, '0') AS company
        FROM {est_large}) AS s GROUP BY company""")
def f3_lines(t):
    company = text.company_id("cnpj_basico", "cnpj_ordem", "cnpj_dv").alias("company")
    return t.est_large.groupBy(company).agg(F.count("*").alias("n"))


@check("f4_repair_text", """
    SELECT id, CASE WHEN id % 5 = 0 THEN c_name || 'é' ELSE broken_text END AS repaired FROM {dirty}""")
def f4(t):
    return t.dirty.select("id", text.repair_text("broken_text").alias("repaired"))


@check("f5_city_name", """
    SELECT id, CASE id % 7 WHEN 0 THEN 'Cambé' WHEN 1 THEN 'Jandaia do Sul' WHEN 2 THEN 'Unknown'
        WHEN 3 THEN 'Unknown' WHEN 4 THEN 'Ibiporã' WHEN 5 THEN 'Nova Fatima' ELSE 'Londrina' END AS city
    FROM {dirty}""")
def f5(t):
    return t.dirty.select("id", text.city_name("city_text").alias("city"))


@check("f6_business_type", f"""
    SELECT id, CASE WHEN cnae_fiscal_principal IN {_in(fixed.TECH_CODES_BROAD)} THEN 'tech'
            WHEN cnae_fiscal_principal IN {_in(fixed.REPAIRS_CODES_BROAD)} THEN 'repairs'
            WHEN cnae_fiscal_principal IN {_in(fixed.RETAIL_CODES)} THEN 'retail'
            ELSE 'gastronomy' END AS broad,
        CASE WHEN cnae_fiscal_principal IN {_in(fixed.TECH_CODES)} THEN 'tech' ELSE 'repairs' END AS narrow
    FROM {{est}}""")
def f6(t):
    code = "cnae_fiscal_principal"
    return t.est.select("id", labels.business_type(code).alias("broad"),
                        labels.business_type(code, "tech").alias("narrow"))


@check("f7_category", f"""
    SELECT id, {_case('substr(cnae_fiscal_principal, 1, 2)', fixed.CATEGORIES.items(), 'Otros')} AS category
    FROM {{est}}""")
def f7(t):
    return t.est.select("id", labels.category("cnae_fiscal_principal").alias("category"))


@check("f8_subcategory", f"""
    SELECT id,
        {_case('substr(cnae_fiscal_principal, 1, 2)', [(k, v[0]) for k, v in fixed.SUBCATEGORIES.items()], fixed.SUBCATEGORY_OTHER[0])} AS label,
        {_case('substr(cnae_fiscal_principal, 1, 2)', [(k, v[1]) for k, v in fixed.SUBCATEGORIES.items()], fixed.SUBCATEGORY_OTHER[1])} AS icon
    FROM {{est}}""")
def f8(t):
    code = "cnae_fiscal_principal"
    return t.est.select("id", labels.subcategory_label(code).alias("label"),
                        labels.subcategory_icon(code).alias("icon"))


@check("f9_size_label", f"""
    SELECT id, {_case("lpad(coalesce(porte_empresa, ''), 2, '0')", fixed.SIZES.items(), 'Otros')} AS size
    FROM {{est}}""")
def f9(t):
    return t.est.select("id", labels.size_label("porte_empresa").alias("size"))


@check("f10_pad_size", "SELECT id, lpad(coalesce(porte_empresa, ''), 2, '0') AS size FROM {est}")
def f10(t):
    return t.est.select("id", text.pad("porte_empresa", 2).alias("size"))


@check("f11_defaults", """
    SELECT id, coalesce(nome_fantasia, 'Comercio') AS missing_only,
        CASE WHEN coalesce(nome_fantasia, '') = '' THEN 'Sin nombre fantasía' ELSE nome_fantasia END AS falsy,
        coalesce(bairro, 'Centro') AS district
    FROM {est}""")
def f11(t):
    return t.est.select(
        "id", text.or_default("nome_fantasia", fixed.DEFAULT_NAME).alias("missing_only"),
        labels.display_name("nome_fantasia").alias("falsy"),
        text.or_default("bairro", fixed.DEFAULT_DISTRICT).alias("district"),
    )


@check("f12_strip", "SELECT id, trim(name_text, ' ' || chr(9) || chr(160)) AS name FROM {dirty}")
def f12(t):
    return t.dirty.select("id", text.strip("name_text").alias("name"))


@check("f13_address", """
    SELECT id, concat_ws(', ', CASE WHEN trim(coalesce(logradouro, '')) <> '' THEN trim(logradouro)
            || CASE WHEN coalesce(numero, '') NOT IN ('', '0', 'S/N', 'SN', 's/n') THEN ', ' || numero ELSE '' END END,
        trim(bairro), trim(municipio), 'PR', 'Brazil') AS address
    FROM {est}""")
def f13(t):
    address = text.address("logradouro", "numero", "bairro", "municipio")
    return t.est.select("id", address.alias("address"))


@check("f14_hash_digits", f"SELECT id, {digits('cnpj_completo')} AS digits FROM {{est}}")
def f14(t):
    return t.est.select("id", geo.hash_digits("cnpj_completo").alias("digits"))


@check("f15_synthetic_point", f"SELECT id, round(lon, 10) AS lon, round(lat, 10) AS lat FROM ({POINTS}) AS p")
def f15(t):
    return located(t).select("id", F.round("lon", 10).alias("lon"), F.round("lat", 10).alias("lat"))


@check("f16_hub_index", f"""
    SELECT id, {HUB} AS hub FROM (SELECT *, {digits('cnpj_completo')} AS h FROM {{est}}) AS s""")
def f16(t):
    return t.est.select("id", geo.hub_of(geo.hash_digits("cnpj_completo"), "business_type").alias("hub"))


@check("f17_stored_point", f"""
    SELECT id, round(CASE WHEN longitude IS NOT NULL AND latitude IS NOT NULL THEN longitude ELSE lon END, 10) AS lon,
        round(CASE WHEN longitude IS NOT NULL AND latitude IS NOT NULL THEN latitude ELSE lat END, 10) AS lat
    FROM ({POINTS}) AS p""")
def f17(t):
    p = geo.stored_or("longitude", "latitude", geo.point("lon", "lat"))
    return located(t).select("id", F.round(p["x"], 10).alias("lon"), F.round(p["y"], 10).alias("lat"))


@check("f18_geometry_text", """
    SELECT id, 'LineString' AS kind, 3 AS vertices, ax AS first_x, by_ AS middle_y, cx AS last_x FROM {streets}""")
def f18(t):
    numbers = lambda *cs: F.concat_ws(" ", *[F.col(c).cast("string") for c in cs])
    wkt = F.concat(F.lit("LINESTRING("), numbers("ax", "ay"), F.lit(", "), numbers("bx", "by_"),
                   F.lit(","), numbers("cx", "cy"), F.lit(")"))
    rows = t.streets.select("id", geo.parse_line(wkt).alias("line"))
    doc = F.to_json(geo.line_geometry("line"))
    return rows.select(
        "id", geo.geometry_member(doc, "type").alias("kind"), F.size("line").alias("vertices"),
        geo.geometry_member(doc, "coordinates[0][0]").cast("double").alias("first_x"),
        geo.geometry_member(doc, "coordinates[1][1]").cast("double").alias("middle_y"),
        F.get("line", F.lit(2))["x"].alias("last_x"),
    )


@check("f19_instants", """
    SELECT id, CASE id % 6 WHEN 0 THEN '2026-05-30T10:00:00' WHEN 1 THEN '2026-05-30T13:00:00.250000'
        WHEN 2 THEN '2026-05-30T00:00:00' WHEN 3 THEN '2026-05-30T10:00:00' END AS utc FROM {dirty}""")
def f19(t):
    return t.dirty.select("id", text.iso(text.instant("time_text")).alias("utc"))


@check("f19_event_times", "SELECT event_id, iso AS utc FROM {events_keyed}")
def f19_events(t):
    return t.events_keyed.select("event_id", text.iso(text.instant("iso")).alias("utc"))


@check("f20_mercator", f"""
    SELECT id, round(radians(lon) * 6378137.0, 4) AS x,
        round(ln(tan(pi() / 4 + radians(lat) / 2)) * 6378137.0, 4) AS y
    FROM ({POINTS}) AS p""")
def f20(t):
    return located(t).select("id", F.round(geo.mercator_x("lon"), 4).alias("x"),
                             F.round(geo.mercator_y("lat"), 4).alias("y"))


@check("f21_kernel", """
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
        round(exp(-(l_quantity * l_quantity * 1000) / (2.0 * 250000)) * 1e6 / (2 * pi() * 250000), 6) AS density
    FROM {lineitem}""")
def f21(t):
    from comarca.operators.density import kernel

    d2 = F.col("l_quantity") * F.col("l_quantity") * 1000
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                             F.round(kernel(d2, 500.0), 6).alias("density"))


@check("f22_percent", """
    SELECT l_suppkey, CASE WHEN count(*) FILTER (l_returnflag <> 'X') = 0 THEN 0.0
        ELSE round(count(*) FILTER (l_returnflag = 'R') / count(*) * 100, 4) END AS share
    FROM {lineitem} GROUP BY l_suppkey""")
def f22(t):
    rows = t.lineitem.groupBy("l_suppkey").agg(
        F.count_if(F.col("l_returnflag") == "R").alias("part"), F.count("*").alias("whole")
    )
    return rows.select("l_suppkey", labels.percent("part", "whole", 4).alias("share"))


@check("f23_squared_distance", f"""
    SELECT id, round((lon - (-51.161)) * (lon - (-51.161)) + (lat - (-23.311)) * (lat - (-23.311)), 9) AS d2
    FROM ({POINTS}) AS p""")
def f23(t):
    hub = fixed.HUBS[0]
    d2 = geo.squared_distance("lon", "lat", F.lit(hub[2]), F.lit(hub[3]))
    return located(t).select("id", F.round(d2, 9).alias("d2"))


@check("f24_density_label", """
    SELECT s_nationkey, n, CASE WHEN n = 0 THEN 'Sin comercios activos detectados en esta zona.'
            ELSE 'Zona comercial consolidada con ' || n || ' locales.' END AS every,
        CASE WHEN n = 0 THEN 'Sin comercios activos detectados en esta zona.'
            ELSE 'Hardware en funcionamiento: ' || n || ' talleres de reparación de hardware activos.' END AS repairs
    FROM (SELECT s_nationkey, count(*) FILTER (s_acctbal > 9000) AS n FROM {supplier} GROUP BY s_nationkey) AS s""")
def f24(t):
    rows = t.supplier.groupBy("s_nationkey").agg(F.count_if(F.col("s_acctbal") > 9000).alias("n"))
    return rows.select("s_nationkey", "n", labels.density_label("n").alias("every"),
                       labels.density_label("n", "repairs").alias("repairs"))


@check("f25_coordinate_text", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, printf('%.4f', l_discount * 7) AS shown FROM {lineitem}")
def f25(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                             geo.coordinate_text(F.col("l_discount") * 7).alias("shown"))


@check("f26_tech_name", """
    SELECT id, CASE WHEN coalesce(nome_fantasia, '') = '' THEN 'Empresa Tech ' || substr(cnpj_completo, 1, 8)
        ELSE nome_fantasia END AS name FROM {est}""")
def f26(t):
    return t.est.select("id", labels.tech_name("nome_fantasia", "cnpj_completo").alias("name"))


@check("f28_street_defaults", """
    SELECT id, CASE WHEN coalesce(name, '') = '' THEN 'Calle sin nombre' ELSE name END AS name,
        coalesce(length_m, 0.0) AS length_m FROM {streets}""")
def f28(t):
    from comarca.operators.segments import street_defaults

    return t.streets.select("id", *street_defaults())
