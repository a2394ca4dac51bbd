"""Schemas of the inputs and tables, as DDL text that readers and createDataFrame accept."""

from comarca.fixed import RAW_COLUMNS

RAW_ESTAB = ", ".join(f"{c} string" for c in RAW_COLUMNS)

BUSINESS_JSON = """
    cnpj_basico string, cnpj_ordem string, cnpj_dv string, nome_fantasia string,
    cnae_fiscal_principal string, logradouro string, numero string, bairro string, cep string,
    telefone_1 string, business_type string, porte_empresa string, municipio string
"""

ESTAB = """
    id int, cnpj_basico string, cnpj_ordem string, cnpj_dv string, cnpj_completo string,
    identificador_matriz_filial int, nome_fantasia string, situacao_cadastral int,
    data_situacao_cadastral date, motivo_situacao_cadastral int, nome_cidade_exterior string,
    codigo_pais int, data_inicio_atividade date, cnae_fiscal int, cnae_fiscal_descricao string,
    descricao_tipo_logradouro string, logradouro string, numero string, complemento string,
    bairro string, cep string, uf string, codigo_municipio int, municipio string, ddd_1 string,
    telefone_1 string, ddd_2 string, telefone_2 string, ddd_fax string, fax string,
    correio_eletronico string, situacao_especial string, data_situacao_especial date,
    latitude decimal(10,8), longitude decimal(11,8), geocoded boolean, created_at timestamp,
    updated_at timestamp, business_type string, porte_empresa string
"""

LINE = "array<struct<x:double,y:double>>"

SEGMENT = f"""
    id long, osm_id long, name string, geom {LINE}, length_m decimal(10,2), created_at timestamp
"""

VISIT = """
    user_id string, segment_id long, visited boolean, visited_at timestamp, notes string,
    source string, synced boolean
"""

#: A stored visit with the id it was given.
VISIT_RECORD = f"id long, {VISIT.strip()}"

VISIT_ITEM = """
    user_id string, segment_id long, visited boolean, visited_at string, notes string,
    source string, seq long
"""

ROUTE = f"id long, user_id string, name string, geom array<{LINE}>, created_at timestamp"

SEGMENT_DENSITY = "segment_id long, density double, computed_at timestamp"
