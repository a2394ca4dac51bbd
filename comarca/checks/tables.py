"""Readers and writers: files, tables and upserts that make a round trip."""

import datetime
import uuid

from pyspark.sql import functions as F

from comarca import fixed
from comarca.checks.registry import check
from comarca.checks.scalars import POINTS
from comarca.functions.text import to_whole
from comarca.plans import etl
from comarca.session import checkpoint_dir
from comarca.sources import readers, writers


def _folder(t, name):
    return f"{checkpoint_dir(t.spark)}/{name}-{uuid.uuid4().hex}"


def _raw_file(t):
    """The establishments as a headerless Latin-1 registry file, read back."""
    known = {
        "identificador_matriz_filial": F.lit("1"),
        "situacao_cadastral": F.concat(F.lit("0"), F.col("situacao_cadastral").cast("string")),
        "cep": F.lit("86000000"), "correio_eletronico": F.lit("a;b@example.com"),
    }
    columns = [
        known.get(c, F.col(c) if c in t.est.columns else F.lit(None)).cast("string").alias(c)
        for c in fixed.RAW_COLUMNS
    ]
    path = _folder(t, "registry")
    t.est.select(*columns).write.option("sep", ";").option("encoding", "ISO-8859-1").csv(path)
    return readers.read_registry_csv(t.spark, path)


@check("s1_registry_csv", """
    SELECT cnpj_basico, cnpj_ordem, cnpj_dv, trim(municipio) AS municipio, uf, 'a;b@example.com' AS correio_eletronico FROM {est}""")
def s1(t):
    return _raw_file(t).select("cnpj_basico", "cnpj_ordem", "cnpj_dv", F.trim("municipio").alias("municipio"), "uf", "correio_eletronico")


def _flawed_file(t):
    """One line per establishment: short ones, long ones and ones with a quote that never closes among them."""
    path = _folder(t, "flawed")
    named = {"cnpj_basico": F.col("cnpj_basico"), "uf": F.col("uf"), "correio_eletronico": F.lit('"a;b"')}
    fields = [F.coalesce(named.get(c, F.lit("")), F.lit("")) for c in fixed.RAW_COLUMNS]
    flaw = F.col("id") % 10
    line = (
        F.when(flaw == 0, F.concat_ws(";", *fields[:5]))
        .when(flaw == 1, F.concat_ws(";", *fields, F.lit("one"), F.lit("more")))
        .when(flaw == 2, F.concat_ws(";", fields[0], F.lit('"never closed'), *fields[2:]))
        .otherwise(F.concat_ws(";", *fields))
    )
    t.est.select(line).write.text(path)
    return path


@check("s1_bad_rows", """
    SELECT cnpj_basico, id % 10 IN (0, 1, 2) AS refused, CASE WHEN id % 10 > 2 THEN uf END AS uf,
        CASE id % 10 WHEN 0 THEN 5 WHEN 1 THEN 35 WHEN 2 THEN 33 END AS fields,
        count(*) FILTER (id % 10 > 2) OVER () AS kept, count(*) FILTER (id % 10 <= 2) OVER () AS all_refused FROM {est}""")
def s1_bad(t):
    """Sound rows and refused ones with their lines; together they are all lines of the file."""
    sound, refused, counts = readers.quarantine(t.spark, _flawed_file(t), _folder(t, "refused"))
    none = lambda kind: F.lit(None).cast(kind)
    rows = sound.select("cnpj_basico", F.lit(False).alias("refused"), "uf", none("int").alias("fields")).unionByName(
        refused.select("cnpj_basico", F.lit(True).alias("refused"), none("string").alias("uf"), "fields"))
    total = counts.first()  # one row of two numbers
    return rows.withColumns({"kept": F.lit(total.kept).cast("long"), "all_refused": F.lit(total.refused).cast("long")})


@check("s2_typed_columns", """
    SELECT cnpj_basico, cnpj_ordem, CAST(codigo_municipio AS BIGINT) AS codigo_municipio,
        CAST(situacao_cadastral AS BIGINT) AS situacao_cadastral FROM {est}""")
def s2(t):
    return _raw_file(t).select("cnpj_basico", "cnpj_ordem", to_whole("codigo_municipio").alias("codigo_municipio"),
                               to_whole("situacao_cadastral").alias("situacao_cadastral"))


def _in(codes):
    return "(" + ", ".join(f"'{c}'" for c in codes) + ")"


def _numbers(codes):
    return "(" + ", ".join(str(c) for c in codes) + ")"


@check("etl_file_broad", f"""
    SELECT cnpj_basico, cnae_fiscal_principal, CASE WHEN cnae_fiscal_principal IN {_in(fixed.TECH_CODES_BROAD)} THEN 'tech'
        WHEN cnae_fiscal_principal IN {_in(fixed.REPAIRS_CODES_BROAD)} THEN 'repairs'
        WHEN cnae_fiscal_principal IN {_in(fixed.RETAIL_CODES)} THEN 'retail' ELSE 'gastronomy' END AS business_type
    FROM {{est}} WHERE situacao_cadastral = 2 AND codigo_municipio IN {_numbers(fixed.CITY_CODES_BROAD)}
        AND cnae_fiscal_principal IN {_in(etl.BROAD.codes)}""")
def etl_broad(t):
    return etl.etl_file(_raw_file(t)).select("cnpj_basico", "cnae_fiscal_principal", "business_type")


@check("etl_file_tech", f"""
    SELECT cnpj_completo, trim(municipio) AS municipio, CAST(codigo_municipio AS BIGINT) AS codigo_municipio,
        CASE WHEN cnae_fiscal_principal LIKE '62%' THEN 'tech' ELSE 'repairs' END AS business_type
    FROM {{est}} WHERE situacao_cadastral = 2 AND codigo_municipio IN {_numbers(fixed.CITY_CODES_TECH)}
        AND cnae_fiscal_principal IN {_in(etl.TECH.codes)}""")
def etl_tech(t):
    rows = etl.etl_file(_raw_file(t), etl.TECH)
    return rows.select("cnpj_completo", F.trim("municipio").alias("municipio"), "codigo_municipio", "business_type")


RECORD = "SELECT cnpj_basico, cnpj_ordem, cnpj_dv, nome_fantasia, municipio, porte_empresa FROM {est}"


@check("s3_json_records", RECORD)
def s3(t):
    """Arrays of a hundred records, one array per line."""
    path = _folder(t, "records")
    fields = ["cnpj_basico", "cnpj_ordem", "cnpj_dv", "nome_fantasia", "municipio", "porte_empresa"]
    pages = t.est.groupBy(F.floor(F.col("id") / 100).alias("page")).agg(F.collect_list(F.struct(*fields)).alias("rows"))
    pages.select(F.to_json("rows").alias("value")).write.text(path)
    return readers.read_business_json(t.spark, path, lines=True).select(*fields)


@check("k1_json_lines", RECORD)
def k1(t):
    path = _folder(t, "lines")
    writers.write_json(t.est, path)
    return readers.read_business_json(t.spark, path, lines=True).select(
        "cnpj_basico", "cnpj_ordem", "cnpj_dv", "nome_fantasia", "municipio", "porte_empresa"
    )


@check("k2_replace_table", "SELECT id, municipio FROM {est}")
def k2(t):
    name, path = f"replaced_{uuid.uuid4().hex}", _folder(t, "table")
    writers.replace_table(t.est.select("id"), name, path)
    writers.replace_table(t.est.select("id", "municipio"), name, path)
    return t.spark.table(name)


@check("s4_table_scan", "SELECT * FROM {customer}")
def s4(t):
    name, path = f"scanned_{uuid.uuid4().hex}", _folder(t, "table")
    writers.replace_table(t.customer, name, path)
    return t.spark.table(name)


TARGET = """SELECT cnpj_completo, nome_fantasia, cnae_fiscal_principal AS cnae_fiscal, logradouro, numero, bairro, municipio,
    business_type, situacao_cadastral, porte_empresa, geocoded FROM {est}"""
# a second delivery: changed rows, new rows and a stale copy before the changed one
SOURCE = """
    SELECT CASE WHEN id % 3 = 0 THEN cnpj_completo ELSE 'N' || cnpj_completo END AS cnpj_completo,
        'Novo ' || cnpj_basico AS nome_fantasia, '6209100' AS cnae_fiscal, logradouro,
        CASE WHEN id % 2 = 0 THEN '77' ELSE numero END AS numero, bairro, municipio, 'tech' AS business_type,
        2 AS situacao_cadastral, '99' AS porte_empresa, FALSE AS geocoded, 2 AS seq FROM {est}
    UNION ALL
    SELECT cnpj_completo, 'Velho', '6209100', logradouro, numero, bairro, municipio, 'tech', 2, '98', FALSE, 1
    FROM {est} WHERE id % 3 = 0"""


def _delivery(t):
    target = t.est.select(
        "cnpj_completo", "nome_fantasia", F.col("cnae_fiscal_principal").alias("cnae_fiscal"), "logradouro", "numero", "bairro",
        "municipio", "business_type", "situacao_cadastral", "porte_empresa", "geocoded",
    )
    source = t.spark.sql(SOURCE, est=t.est)
    return target, source


@check("k3_upsert", f"""
    WITH tgt AS ({TARGET}), src AS (SELECT * FROM ({SOURCE}) AS s WHERE seq = 2)
    SELECT coalesce(t.cnpj_completo, s.cnpj_completo) AS cnpj_completo,
        CASE WHEN s.cnpj_completo IS NOT NULL THEN s.nome_fantasia ELSE t.nome_fantasia END AS nome_fantasia,
        CASE WHEN s.cnpj_completo IS NOT NULL THEN s.numero ELSE t.numero END AS numero,
        CASE WHEN s.cnpj_completo IS NOT NULL THEN s.business_type ELSE t.business_type END AS business_type,
        CASE WHEN t.cnpj_completo IS NULL THEN s.porte_empresa ELSE t.porte_empresa END AS porte_empresa,
        CASE WHEN t.cnpj_completo IS NULL THEN s.geocoded ELSE t.geocoded END AS geocoded
    FROM tgt AS t FULL OUTER JOIN src AS s ON t.cnpj_completo = s.cnpj_completo""")
def k3(t):
    target, source = _delivery(t)
    merged = writers.upsert(target, source, ["cnpj_completo"], fixed.UPSERT_COLUMNS, order="seq")
    return merged.select("cnpj_completo", "nome_fantasia", "numero", "business_type", "porte_empresa", "geocoded")


@check("k3_upsert_bucketed", f"""
    WITH tgt AS ({TARGET}), src AS (SELECT * FROM ({SOURCE}) AS s WHERE seq = 2)
    SELECT coalesce(t.cnpj_completo, s.cnpj_completo) AS cnpj_completo,
        CASE WHEN s.cnpj_completo IS NOT NULL THEN s.nome_fantasia ELSE t.nome_fantasia END AS nome_fantasia,
        CASE WHEN s.cnpj_completo IS NOT NULL THEN s.numero ELSE t.numero END AS numero,
        CASE WHEN t.cnpj_completo IS NULL THEN s.porte_empresa ELSE t.porte_empresa END AS porte_empresa
    FROM tgt AS t FULL OUTER JOIN src AS s ON t.cnpj_completo = s.cnpj_completo""")
def k3_bucketed(t):
    """The same upsert into a stored table of which only the touched parts are rewritten."""
    from comarca.session import durable
    from comarca.sources import keyed

    target, source = _delivery(t)
    name = f"keyed_{uuid.uuid4().hex}"
    keyed.create_keyed(target, name, ["cnpj_completo"], parts=8, buckets=4, path=_folder(t, "keyed"))
    try:
        keyed.upsert_keyed(t.spark, name, source, fixed.UPSERT_COLUMNS, order="seq")
        return durable(keyed.read_keyed(t.spark, name).select("cnpj_completo", "nome_fantasia", "numero", "porte_empresa"))
    finally:
        t.spark.sql(f"DROP TABLE {name}")


@check("k3_upsert_reset_geocode", f"""
    WITH tgt AS ({TARGET}), src AS (SELECT * FROM ({SOURCE}) AS s WHERE seq = 2)
    SELECT coalesce(t.cnpj_completo, s.cnpj_completo) AS cnpj_completo,
        CASE WHEN t.cnpj_completo IS NULL THEN s.geocoded
            WHEN s.cnpj_completo IS NOT NULL AND t.numero IS DISTINCT FROM s.numero THEN FALSE ELSE t.geocoded END AS geocoded
    FROM tgt AS t FULL OUTER JOIN src AS s ON t.cnpj_completo = s.cnpj_completo""")
def k3_reset(t):
    target, source = _delivery(t)
    merged = writers.upsert(
        target, source, ["cnpj_completo"], fixed.UPSERT_COLUMNS, order="seq", reset_geocode_on=["numero"]
    )
    return merged.select("cnpj_completo", "geocoded")


@check("f27_timestamps", f"""
    WITH tgt AS ({TARGET}), src AS (SELECT * FROM ({SOURCE}) AS s WHERE seq = 2)
    SELECT coalesce(t.cnpj_completo, s.cnpj_completo) AS cnpj_completo,
        CASE WHEN t.cnpj_completo IS NULL THEN '2026-06-01' ELSE '2020-01-01' END AS created,
        CASE WHEN s.cnpj_completo IS NULL THEN '2020-01-01' ELSE '2026-06-01' END AS updated
    FROM tgt AS t FULL OUTER JOIN src AS s ON t.cnpj_completo = s.cnpj_completo""")
def f27(t):
    target, source = _delivery(t)
    old, now = F.lit(datetime.datetime(2020, 1, 1)), F.lit(datetime.datetime(2026, 6, 1))
    target = target.withColumns({"created_at": old, "updated_at": old})
    merged = writers.upsert(target, source, ["cnpj_completo"], fixed.UPSERT_COLUMNS, order="seq", stamp=now)
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    return merged.select("cnpj_completo", day("created_at").alias("created"), day("updated_at").alias("updated"))


@check("k4_geojson_features", f"""
    SELECT cnpj_completo AS cnpj, 'Feature' AS type, 'Point' AS geometry,
        round(CASE WHEN longitude IS NOT NULL AND latitude IS NOT NULL THEN longitude ELSE lon END, 10) AS lon,
        coalesce(nome_fantasia, 'Comercio') AS nome_fantasia, cnae_fiscal_principal AS cnae, coalesce(bairro, 'Centro') AS bairro,
        coalesce(numero, '') AS numero, '' AS cep, coalesce(porte_empresa, '') AS porte_empresa, municipio
    FROM ({POINTS}) AS p""")
def k4(t):
    path = _folder(t, "features")
    writers.write_features(writers.heatmap_features(t.est), path)
    text = t.spark.read.text(path)
    member = lambda m: F.get_json_object("value", f"$.{m}")
    kept = ("cnpj", "nome_fantasia", "cnae", "bairro", "numero", "cep", "porte_empresa", "municipio")
    return text.select(
        member("type").alias("type"), member("geometry.type").alias("geometry"),
        F.round(member("geometry.coordinates[0]").cast("double"), 10).alias("lon"),
        *[member(f"properties.{c}").alias(c) for c in kept],
    )


@check("k4_collection_file", """
    SELECT 'feature' AS line, cnpj_completo AS cnpj, municipio, cnpj_completo > (SELECT min(cnpj_completo) FROM {est}) AS comma FROM {est}
    UNION ALL SELECT 'head', NULL, NULL, NULL UNION ALL SELECT 'foot', NULL, NULL, NULL""")
def k4_collection(t):
    """One document of any size over several files; each line of it is a head, a foot or one feature."""
    path = _folder(t, "collection")
    writers.write_collection(writers.heatmap_features(t.est), path, ["feature.properties.cnpj"], {"source": "registry"})
    text = t.spark.read.text(path)
    comma = F.col("value").startswith(",")
    feature = F.regexp_replace("value", "^,", "")
    member = lambda m: F.get_json_object(feature, f"$.{m}")
    line = (
        F.when(F.col("value") == '{"type":"FeatureCollection","features":[', "head")
        .when(F.col("value") == '],"metadata":{"source": "registry"}}', "foot")
        .when(member("type") == "Feature", "feature")
    )
    return text.select(
        line.alias("line"), member("properties.cnpj").alias("cnpj"), member("properties.municipio").alias("municipio"),
        F.when(line == "feature", comma).alias("comma"),
    )


@check("k5_csv", "SELECT CAST(l_orderkey AS VARCHAR) AS l_orderkey, sum(l_quantity) AS q FROM {lineitem} GROUP BY 1")
def k5(t):
    path = _folder(t, "csv")
    writers.write_csv(t.lineitem.groupBy("l_orderkey").agg(F.sum("l_quantity").alias("q")), path)
    return t.spark.read.schema("l_orderkey string, q double").option("header", True).csv(path)


@check("k7_new_ids", """
    SELECT e.event_id, (SELECT max(c_custkey) FROM {customer}) + row_number() OVER (ORDER BY ts, event_id) AS id FROM {events} AS e""")
def k7(t):
    target = t.customer.select(F.col("c_custkey").alias("id"))
    return writers.with_new_ids(target, t.events.select("event_id", "ts"), ["ts", "event_id"]).select("event_id", "id")


@check("k7_stable_ids", "SELECT count(*) AS n, count(*) AS ids FROM {visits_server}")
def k7_stable(t):
    ids = t.visits_server.select(writers.stable_id("user_id", "segment_id").alias("id"))
    return ids.agg(F.count("*").alias("n"), F.count_distinct("id").alias("ids"))


@check("k9_insert_absent", """
    SELECT cnpj_basico FROM {reg_estab} AS e WHERE NOT EXISTS (SELECT 1 FROM {reg_empresas} AS p WHERE p.cnpj_basico = e.cnpj_basico)""")
def k9(t):
    return writers.insert_absent(t.reg_empresas, t.reg_estab, ["cnpj_basico"]).select("cnpj_basico")


@check("k10_widen", "SELECT id, geocoded, CAST(NULL AS VARCHAR) AS email, CAST(0 AS INTEGER) AS visits FROM {est}")
def k10(t):
    wide = writers.widen(t.est, {"geocoded": ("boolean", False), "email": ("string", None), "visits": ("int", 0)})
    return wide.select("id", "geocoded", "email", "visits")
