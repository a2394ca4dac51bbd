"""The given tables seen as registry, street and visit data.

Every view is one SQL text that both engines read; ``{name}`` stands for a table or an earlier
view. Where the dialects differ the view has two texts.
"""

import re

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()

_CITY = """CASE {key} % 10 WHEN 0 THEN 'Londrina' WHEN 1 THEN 'Cambé' WHEN 2 THEN 'Ibiporã'
    WHEN 3 THEN 'Rolândia' WHEN 4 THEN ' Arapongas ' WHEN 5 THEN 'APUCARANA' WHEN 6 THEN 'Cambira'
    WHEN 7 THEN 'Jandaia do Sul' WHEN 8 THEN 'Rolandia' ELSE 'Curitiba' END"""
_CITY_CODE = """CASE {key} % 10 WHEN 0 THEN 4113700 WHEN 1 THEN 4103701 WHEN 2 THEN 4109807
    WHEN 3 THEN 4122404 WHEN 4 THEN 4101507 WHEN 5 THEN 4101408 WHEN 6 THEN 4103800
    WHEN 7 THEN 4112108 WHEN 8 THEN 4122404 ELSE 4106902 END"""


def _city(key):
    return _CITY.replace("{key}", key)


def _city_code(key):
    return _CITY_CODE.replace("{key}", key)


VIEWS = {
    # one establishment per customer, with the flaws of real registry rows
    "est": f"""
        SELECT c_custkey AS id, CAST(c_custkey AS STRING) AS cnpj_basico,
            CAST(c_nationkey AS STRING) AS cnpj_ordem, CAST(c_custkey % 97 AS STRING) AS cnpj_dv,
            lpad(CAST(c_custkey AS STRING), 8, '0') || lpad(CAST(c_nationkey AS STRING), 4, '0')
                || lpad(CAST(c_custkey % 97 AS STRING), 2, '0') AS cnpj_completo,
            CASE WHEN c_custkey % 11 = 0 THEN NULL WHEN c_custkey % 11 = 1 THEN ''
                WHEN c_custkey % 11 = 2 THEN '  ' || c_name || ' ' ELSE c_name END AS nome_fantasia,
            CASE WHEN c_acctbal > 0 THEN 2 ELSE 8 END AS situacao_cadastral,
            CASE c_mktsegment WHEN 'MACHINERY' THEN 'tech' WHEN 'AUTOMOBILE' THEN 'repairs'
                WHEN 'FURNITURE' THEN 'gastronomy' ELSE 'retail' END AS business_type,
            CASE WHEN c_mktsegment = 'MACHINERY' AND c_custkey % 3 = 0 THEN '6201501'
                WHEN c_mktsegment = 'MACHINERY' AND c_custkey % 3 = 1 THEN '6202300'
                WHEN c_mktsegment = 'MACHINERY' THEN '6209100'
                WHEN c_mktsegment = 'AUTOMOBILE' AND c_custkey % 2 = 0 THEN '9511800'
                WHEN c_mktsegment = 'AUTOMOBILE' THEN '9512600'
                WHEN c_mktsegment = 'FURNITURE' THEN '5611201'
                WHEN c_custkey % 4 = 0 THEN '4781400' WHEN c_custkey % 4 = 1 THEN '4711301'
                WHEN c_custkey % 4 = 2 THEN '6411100' ELSE '0111301' END AS cnae_fiscal_principal,
            CASE WHEN c_custkey % 13 = 0 THEN NULL WHEN c_custkey % 13 = 1 THEN '  '
                WHEN c_custkey % 13 = 2 THEN ' Rua ' || CAST(c_custkey % 40 AS STRING) || ' '
                ELSE 'Rua ' || CAST(c_custkey % 40 AS STRING) END AS logradouro,
            CASE c_custkey % 6 WHEN 0 THEN 'S/N' WHEN 1 THEN '0' WHEN 2 THEN NULL
                ELSE CAST(c_custkey % 900 AS STRING) END AS numero,
            CASE WHEN c_custkey % 7 = 0 THEN NULL
                ELSE 'Bairro ' || CAST(c_nationkey AS STRING) END AS bairro,
            {_city('c_nationkey')} AS municipio, {_city_code('c_nationkey')} AS codigo_municipio,
            CASE c_custkey % 5 WHEN 0 THEN '1' WHEN 1 THEN '03' WHEN 2 THEN '05' WHEN 3 THEN NULL
                ELSE '3' END AS porte_empresa,
            CASE WHEN c_custkey % 9 = 0 THEN 'SP' ELSE 'PR' END AS uf,
            CASE WHEN c_custkey % 4 = 0 THEN CAST(-51 AS DOUBLE)
                - CAST(c_custkey % 1000 AS DOUBLE) / CAST(1000 AS DOUBLE) END AS longitude,
            CASE WHEN c_custkey % 4 = 0 THEN CAST(-23 AS DOUBLE)
                - CAST(c_custkey % 777 AS DOUBLE) / CAST(1000 AS DOUBLE) END AS latitude,
            CASE c_custkey % 4 WHEN 0 THEN TRUE WHEN 1 THEN NULL ELSE FALSE END AS geocoded
        FROM {{customer}}""",
    # one establishment per order line, for the heavy queries
    "est_large": f"""
        SELECT CAST(l_orderkey AS STRING) AS cnpj_basico,
            CAST(l_linenumber * 100 + l_suppkey % 100 AS STRING) AS cnpj_ordem,
            CAST(l_partkey % 97 AS STRING) AS cnpj_dv, p_name AS logradouro,
            CASE p_type WHEN 'STANDARD' THEN '4711301' WHEN 'PROMO' THEN '5611201'
                WHEN 'LARGE' THEN '6201501' WHEN 'SMALL' THEN '9511800' WHEN 'MEDIUM' THEN '8630503'
                ELSE '0111301' END AS cnae_fiscal_principal,
            CASE p_type WHEN 'STANDARD' THEN 'retail' WHEN 'PROMO' THEN 'gastronomy'
                WHEN 'LARGE' THEN 'tech' WHEN 'SMALL' THEN 'repairs' ELSE 'retail' END
                AS business_type,
            CASE l_linenumber % 4 WHEN 0 THEN '1' WHEN 1 THEN '03' WHEN 2 THEN '05'
                ELSE '3' END AS porte_empresa,
            CASE WHEN l_returnflag = 'R' THEN 8 ELSE 2 END AS situacao_cadastral,
            {_city('s_nationkey')} AS municipio
        FROM {{lineitem}} JOIN {{part}} ON l_partkey = p_partkey
            JOIN {{supplier}} ON l_suppkey = s_suppkey""",
    # text with the flaws of hand-typed and re-encoded data
    "dirty": """
        SELECT c_custkey AS id, c_name,
            CASE c_custkey % 8 WHEN 0 THEN CAST(c_custkey AS STRING) || '.0'
                WHEN 1 THEN ' ' || CAST(c_custkey AS STRING) || ' '
                WHEN 2 THEN CAST(c_custkey AS STRING) || 'd' WHEN 3 THEN '' WHEN 4 THEN NULL
                WHEN 5 THEN '-' || CAST(c_custkey AS STRING) || '.75'
                WHEN 6 THEN CAST(c_custkey AS STRING) || 'e2' ELSE 'abc' END AS number_text,
            CASE c_custkey % 3 WHEN 0 THEN '62.01-5/' || CAST(c_custkey AS STRING)
                WHEN 1 THEN ' 6202 ' || chr(9) || CAST(c_custkey AS STRING)
                ELSE CAST(c_custkey AS STRING) END AS code_text,
            CASE c_custkey % 4 WHEN 0 THEN chr(9) || c_name || chr(160)
                WHEN 1 THEN '  ' || c_name WHEN 2 THEN chr(160) ELSE NULL END AS name_text,
            CASE c_custkey % 5 WHEN 0 THEN c_name || 'Ã©' WHEN 1 THEN c_name || 'é'
                WHEN 2 THEN '€Ã©' || c_name WHEN 3 THEN NULL ELSE c_name || 'Ã' END AS broken_text,
            CASE c_custkey % 7 WHEN 0 THEN ' cambe' WHEN 1 THEN 'JANDAIA DO SUL' WHEN 2 THEN NULL
                WHEN 3 THEN '  ' WHEN 4 THEN 'IbiporÃ£' WHEN 5 THEN 'NOVA ' || 'FATIMA'
                ELSE 'londrina ' END AS city_text,
            CASE c_custkey % 6 WHEN 0 THEN '2026-05-30T10:00:00Z'
                WHEN 1 THEN '2026-05-30T10:00:00.250-03:00' WHEN 2 THEN '2026-05-30'
                WHEN 3 THEN '2026-05-30 10:00:00' WHEN 4 THEN 'soon' ELSE NULL END AS time_text
        FROM {customer}""",
    # registry tables
    "reg_estab": """
        SELECT o_orderkey, CAST(o_custkey AS STRING) AS cnpj_basico,
            CAST(o_orderkey % 10000 AS STRING) AS cnpj_ordem,
            CAST(o_orderkey % 89 AS STRING) AS cnpj_dv,
            CASE WHEN o_orderkey % 6 = 0 THEN '' ELSE 'Loja ' || CAST(o_orderkey AS STRING) END
                AS nome_fantasia,
            CASE o_orderpriority WHEN '1-URGENT' THEN '6201501' WHEN '2-HIGH' THEN '9511800'
                WHEN '3-MEDIUM' THEN '6209100' WHEN '5-LOW' THEN '9512600' ELSE '4711301' END
                AS codigo_cnae_fiscal_principal,
            ' Rua ' || CAST(o_orderkey % 50 AS STRING) || ' ' AS logradouro,
            CAST(o_orderkey % 300 AS STRING) AS numero,
            CASE WHEN o_orderkey % 8 = 0 THEN NULL ELSE 'Centro ' END AS bairro,
            CAST(86000000 + o_orderkey % 900 AS STRING) AS cep, '99' AS telefone_1, ' 43' AS ddd_1,
            '1' AS identificador_matriz_filial,
            CASE WHEN o_orderstatus = 'P' THEN '08' ELSE '02' END AS situacao_cadastral,
            CASE WHEN o_orderstatus = 'P' THEN 8 ELSE 2 END AS codigo_situacao_cadastral,
            CAST(NULL AS STRING) AS correio_eletronico, o_custkey % 25 AS codigo_municipio,
            CASE WHEN o_orderkey % 5 = 0 THEN 'SP' ELSE 'PR' END AS uf
        FROM {orders}""",
    "reg_municipios": """
        SELECT n_nationkey AS codigo, CASE n_nationkey % 10 WHEN 0 THEN ' Londrina '
            WHEN 1 THEN 'cambe' WHEN 2 THEN 'IBIPORA' WHEN 3 THEN 'Rolandia' WHEN 4 THEN 'ARAPONGAS '
            WHEN 5 THEN 'apucarana' WHEN 6 THEN 'CAMBIRA' WHEN 7 THEN ' jandaia do sul'
            WHEN 8 THEN 'CURITIBA' ELSE 'MARINGA' END AS descricao
        FROM {nation}""",
    "reg_empresas": """
        SELECT CAST(c_custkey AS STRING) AS cnpj_basico,
            CASE c_custkey % 3 WHEN 0 THEN '01' WHEN 1 THEN '03' ELSE '05' END
                AS codigo_porte_empresa
        FROM {customer} WHERE c_custkey % 5 <> 0""",
    # offline visits: a server state and a queue
    "events_keyed": (
        """SELECT CAST(user_id AS STRING) AS user_id, event_id % 50 AS segment_id,
            event_type <> 'error' AS visited, ts AS t, event_id,
            CASE WHEN event_id % 4 = 0 THEN NULL ELSE 'k' || props END AS notes,
            event_type AS source,
            CAST(conv(substring(md5(CAST(CAST(event_id AS STRING) AS BINARY)), 1, 15), 16, 10) AS BIGINT) AS seq,
            date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS") AS iso
        FROM {events}""",
        """SELECT CAST(user_id AS VARCHAR) AS user_id, event_id % 50 AS segment_id,
            event_type <> 'error' AS visited, ts AS t, event_id,
            CASE WHEN event_id % 4 = 0 THEN NULL ELSE 'k' || props END AS notes,
            event_type AS source,
            CAST('0x' || substr(md5(CAST(event_id AS VARCHAR)), 1, 15) AS BIGINT) AS seq,
            strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS iso
        FROM {events}""",
    ),
    "visits_server": (
        """SELECT user_id, segment_id, r.visited, r.t AS visited_at, r.notes, r.source, TRUE AS synced FROM (
            SELECT user_id, segment_id, max_by(struct(visited, t, notes, source), struct(t, -event_id)) AS r
            FROM {events_keyed} WHERE event_id % 3 = 0 GROUP BY user_id, segment_id) AS s""",
        """SELECT user_id, segment_id, visited, t AS visited_at, notes, source, TRUE AS synced FROM (
            SELECT *, row_number() OVER (PARTITION BY user_id, segment_id ORDER BY t DESC, event_id) AS r
            FROM {events_keyed} WHERE event_id % 3 = 0) AS s
        WHERE r = 1""",
    ),
    "visits_batch": """
        SELECT user_id, segment_id, visited,
            CASE WHEN event_id % 17 = 0 THEN 'not a time' ELSE iso || 'Z' END AS visited_at,
            notes, source, seq FROM {events_keyed} WHERE event_id % 3 <> 0""",
    # three-vertex streets, one per part; neighbours share corners
    "streets": """
        SELECT p_partkey AS id, p_partkey + 1000 AS osm_id,
            CASE WHEN p_partkey % 6 = 0 THEN NULL WHEN p_partkey % 6 = 1 THEN '' ELSE p_name END AS name,
            CASE WHEN p_partkey % 8 = 0 THEN NULL ELSE CAST(p_size AS DOUBLE) * 10 END AS length_m,
            CAST(p_partkey % 40 AS DOUBLE) AS ax,
            CAST((p_partkey - p_partkey % 40) AS DOUBLE) / CAST(40 AS DOUBLE) AS ay,
            CAST(p_partkey % 40 + 1 AS DOUBLE) AS bx,
            CAST((p_partkey - p_partkey % 40) AS DOUBLE) / CAST(40 AS DOUBLE)
                + CAST(p_size AS DOUBLE) / CAST(25 AS DOUBLE) AS by_,
            CAST(p_partkey % 40 + p_size % 3 AS DOUBLE) AS cx,
            CAST((p_partkey - p_partkey % 40) AS DOUBLE) / CAST(40 AS DOUBLE)
                + CAST(p_size % 2 AS DOUBLE) AS cy
        FROM {part}""",
    # route lines: from each line of an order to the next one
    "route_lines": """
        SELECT route_id, route_id * 1000 + r AS segment_id, CAST(k % 100 AS DOUBLE) AS ax,
            CAST(k - k % 100 AS DOUBLE) / CAST(100 AS DOUBLE) AS ay, CAST(k2 % 100 AS DOUBLE) AS bx,
            CAST(k2 - k2 % 100 AS DOUBLE) / CAST(100 AS DOUBLE) AS by_
        FROM (SELECT l_orderkey AS route_id, l_partkey AS k,
                row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS r,
                lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS k2
            FROM {lineitem}) AS s
        WHERE k2 IS NOT NULL""",
    # map windows, one per supplier
    "windows": """
        SELECT s_suppkey AS box_id, CAST(s_suppkey % 37 AS DOUBLE) + CAST(0.25 AS DOUBLE) AS x1,
            CAST(s_suppkey % 41 AS DOUBLE) AS y1,
            CAST(s_suppkey % 37 + 1 + s_suppkey % 4 AS DOUBLE) AS x2,
            CAST(s_suppkey % 41 + 1 + s_suppkey % 7 AS DOUBLE) AS y2
        FROM {supplier}""",
}


def names_in(text):
    return [n for n in dict.fromkeys(re.findall(r"\{(\w+)\}", text))]


def duck_text(name):
    text = VIEWS[name]
    return text if isinstance(text, str) else text[1]


def with_views(sql):
    """DuckDB text with the views it mentions written in front as common table expressions."""
    needed = []

    def visit(text):
        for name in names_in(text):
            if name in VIEWS and name not in needed:
                visit(duck_text(name))
                needed.append(name)

    visit(sql)
    plain = lambda text: re.sub(r"\{(\w+)\}", r"\1", text)
    body = plain(sql).strip()
    if not needed:
        return body
    ctes = ", ".join(f"{n} AS ({plain(duck_text(n))})" for n in needed)
    if body.upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {ctes}, {body[len('WITH RECURSIVE'):]}"
    if body.upper().startswith("WITH"):
        return f"WITH {ctes}, {body[len('WITH'):]}"
    return f"WITH {ctes} {body}"


class Tables:
    """Given tables and views of one data folder as DataFrames, by attribute."""

    def __init__(self, spark, folder):
        self.spark, self.folder, self._views = spark, folder, {}

    def __getattr__(self, name):
        if name.startswith("_"):
            raise AttributeError(name)
        if name in self._views:
            return self._views[name]
        if name in VIEWS:
            text = VIEWS[name]
            text = text if isinstance(text, str) else text[0]
            df = self.spark.sql(text, **{n: getattr(self, n) for n in names_in(text)})
        elif name in TABLES:
            df = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        else:
            raise AttributeError(name)
        self._views[name] = df
        return df
