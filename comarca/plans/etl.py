"""From registry files and tables to classified establishments."""

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from comarca import fixed
from comarca.functions.labels import business_type
from comarca.functions.text import (
    city_name, clean_code, company_id, pad, repair_text, strip, to_whole,
)
from comarca.operators.filters import active, in_named_cities, in_region, in_state, with_codes
from comarca.operators.filters import keep_columns, union_codes
from comarca.scale import skew_join


@dataclass(frozen=True)
class Preset:
    """City codes, activity codes and classification of an extract."""

    name: str
    cities: tuple
    codes: tuple


BROAD = Preset(
    "broad", tuple(fixed.CITY_CODES_BROAD),
    tuple(union_codes(fixed.RETAIL_CODES, fixed.GASTRONOMY_CODES, fixed.TECH_CODES_BROAD,
                      fixed.REPAIRS_CODES_BROAD)),
)
TECH = Preset(
    "tech", tuple(fixed.CITY_CODES_TECH), tuple(union_codes(fixed.TECH_CODES, fixed.REPAIRS_CODES))
)


def etl_file(raw, preset=BROAD) -> DataFrame:
    """Active establishments of the preset's cities and codes, classified.

    One scan and no shuffle: filters, then the projection.
    """
    if preset.name == "tech":
        raw = raw.withColumns(
            {"cnae_fiscal_principal": clean_code("cnae_fiscal_principal"),
             "municipio": repair_text("municipio")}
        )
    rows = with_codes(active(in_region(raw, preset.cities)), preset.codes)
    kind = business_type("cnae_fiscal_principal", preset.name)
    if preset.name == "tech":
        return rows.withColumns(
            {
                "codigo_municipio": to_whole("codigo_municipio"),
                "situacao_cadastral": to_whole("situacao_cadastral"),
                "business_type": kind,
                "cnpj_completo": company_id("cnpj_basico", "cnpj_ordem", "cnpj_dv"),
            }
        )
    return keep_columns(rows).withColumn("business_type", kind)


def etl_registry(
    estab, municipios, empresas, cities=tuple(fixed.CITY_NAMES), codes=TECH.codes
) -> DataFrame:
    """Establishments of the registry tables in target cities, with size class and city name.

    The city table is filtered before its join. The company join is the large one: a company
    with very many establishments is spread over tasks.
    """
    places = in_named_cities(municipios, cities).select("codigo", "descricao")
    code = F.col("codigo_cnae_fiscal_principal").cast("string")
    rows = in_state(estab).where(
        (F.col("codigo_situacao_cadastral") == fixed.ACTIVE) & code.isin(list(codes))
    )
    placed = rows.join(places, rows["codigo_municipio"] == places["codigo"], "inner")
    sizes = empresas.select("cnpj_basico", F.col("codigo_porte_empresa").alias("porte_empresa"))
    joined = skew_join(placed, sizes, ["cnpj_basico"], "left")
    trimmed = lambda c: F.coalesce(strip(c), F.lit("")).alias(c)
    return joined.select(
        pad("cnpj_basico", 8).alias("cnpj_basico"), pad("cnpj_ordem", 4).alias("cnpj_ordem"),
        pad("cnpj_dv", 2).alias("cnpj_dv"),
        company_id("cnpj_basico", "cnpj_ordem", "cnpj_dv").alias("cnpj_completo"),
        to_whole(F.col("identificador_matriz_filial").cast("string")).alias("identificador_matriz_filial"),
        F.nullif("nome_fantasia", F.lit("")).alias("nome_fantasia"),
        to_whole(F.col("situacao_cadastral").cast("string")).alias("situacao_cadastral"),
        code.alias("cnae_fiscal"), trimmed("logradouro"), trimmed("numero"), trimmed("bairro"),
        strip(F.col("cep").cast("string")).alias("cep"), F.lit("PR").alias("uf"),
        city_name("descricao").alias("municipio"), strip("ddd_1").alias("ddd_1"),
        strip(F.col("telefone_1").cast("string")).alias("telefone_1"),
        strip("correio_eletronico").alias("correio_eletronico"),
        business_type(code, "tech").alias("business_type"), "porte_empresa",
    )
