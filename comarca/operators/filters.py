"""Filters and projections over establishments, clusters and visits."""

import re

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import NumericType

from comarca import fixed
from comarca.functions.labels import sector_filter
from comarca.functions.text import blank, holds_text, pad, to_number
from comarca.scale import skew_join

MANY_CODES = 500


def keep_columns(df, columns=fixed.KEPT_COLUMNS) -> DataFrame:
    return df.select([c for c in columns if c in df.columns])


def _number(df, column):
    """The column as a number; a typed column stays bare, so its filter reaches the scan."""
    if isinstance(df.schema[column].dataType, NumericType):
        return F.col(column)
    return to_number(column)


def in_region(df, codes, column="codigo_municipio") -> DataFrame:
    return df.where(_number(df, column).isin(list(codes)))


def in_named_cities(df, names=tuple(fixed.CITY_NAMES), column="descricao") -> DataFrame:
    return df.where(F.upper(F.trim(column)).isin(list(names)))


def active(df, column="situacao_cadastral") -> DataFrame:
    return df.where(_number(df, column) == fixed.ACTIVE)


def with_codes(df, codes, column="cnae_fiscal_principal") -> DataFrame:
    """Rows whose activity code is listed: a set test, or a semi join for a long list."""
    if isinstance(codes, DataFrame):
        return skew_join(df, codes.toDF(column), [column], "left_semi").select(*df.columns)
    codes = list(codes)
    if len(codes) <= MANY_CODES:
        return df.where(F.col(column).isin(codes))
    listed = df.sparkSession.createDataFrame([(c,) for c in codes], "_code string")
    return df.join(listed, F.col(column) == F.col("_code"), "left_semi")


def union_codes(*sets):
    """Union of code sets, in order of first appearance."""
    return list(dict.fromkeys(c for s in sets for c in s))


def on_streets(df, sizes=fixed.STREET_SIZES) -> DataFrame:
    """Rows with a street name and one of the small size classes."""
    # the null tests say nothing new, but unlike the rest they reach the scan
    present = F.col("logradouro").isNotNull() & F.col("porte_empresa").isNotNull()
    return df.where(present & ~blank("logradouro") & pad("porte_empresa", 2).isin(list(sizes)))


def valid(df) -> DataFrame:
    """Rows with a city and an activity code."""
    return df.where(~blank("municipio") & ~blank(F.col("cnae_fiscal_principal").cast("string")))


def cluster_input(df) -> DataFrame:
    """Active technology and repair establishments that have a point."""
    return df.where(
        (F.col("situacao_cadastral") == fixed.ACTIVE)
        & F.col("lon").isNotNull()
        & F.col("lat").isNotNull()
        & F.col("business_type").isin("tech", "repairs")
    )


def search(df, text, columns=("nome_fantasia", "cnae", "bairro", "logradouro")) -> DataFrame:
    return df.where(holds_text(columns, text))


def _is_cluster_query(text):
    return text.startswith("polo ") or re.fullmatch(r"\d+", text) is not None


def autocomplete(df, text, columns=("nome_fantasia", "cnpj", "logradouro", "bairro"), key="cnpj"):
    """First ten matches for a typed text of two characters or more."""
    needle = text.lower().strip()
    if len(text) < 2 or _is_cluster_query(needle):
        return df.limit(0)
    return df.where(holds_text(columns, needle)).orderBy(key).limit(10)


def find_clusters(clusters, text) -> DataFrame:
    """Clusters whose number contains the digits typed; other texts keep every cluster."""
    needle = text.lower().strip()
    if not needle or not _is_cluster_query(needle):
        return clusters
    number = needle.replace("polo ", "", 1)
    return clusters.where(F.col("cluster_id").cast("string").contains(number))


def in_sector(df, sector, column="cnae") -> DataFrame:
    return df.where(sector_filter(column, sector))


def non_zero(clusters) -> DataFrame:
    return clusters.where(F.col("total_lojas") > 0)


def of_user(visits, user) -> DataFrame:
    return visits.where(F.col("user_id") == F.lit(user))


def in_state(df, state="PR") -> DataFrame:
    return df.where(F.col("uf") == state)
