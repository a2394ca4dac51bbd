"""Deduplication, cleaning and the quality report."""

from pyspark.sql import DataFrame, functions as F

from comarca.functions.labels import display_name
from comarca.functions.text import blank, strip
from comarca.operators.filters import valid
from comarca.sources.writers import keep_first

KEYS = ("cnpj_basico", "cnpj_ordem", "cnpj_dv")


def distinct_companies(df, seq, keys=KEYS) -> DataFrame:
    """Keep the first record per trimmed company key, by ``seq``."""
    trimmed = {f"_k{i}": strip(F.col(k).cast("string")) for i, k in enumerate(keys)}
    return keep_first(df.withColumns(trimmed), list(trimmed), seq).drop(*trimmed)


def tidy_text(df) -> DataFrame:
    """Trim text fields; records without a name get the stand-in name."""
    name = F.when(blank("nome_fantasia"), display_name(F.lit(""))).otherwise(
        strip("nome_fantasia")
    )
    return df.withColumns(
        {"nome_fantasia": name, "logradouro": strip("logradouro"), "bairro": strip("bairro")}
    )


def clean(df, seq, validate_first=False) -> DataFrame:
    """Deduplicate, tidy and validate, in that order unless ``validate_first``."""
    if validate_first:
        return tidy_text(distinct_companies(valid(df), seq))
    return valid(tidy_text(distinct_companies(df, seq)))


def quality_report(df, keys=KEYS) -> DataFrame:
    """Rows read, duplicates, rows kept and percent removed.

    Per key only the count and the first record's validity travel to the final sum.
    """
    seq = "seq"
    ok = ~blank("municipio") & ~blank(F.col("cnae_fiscal_principal").cast("string"))
    per_key = df.groupBy(*[strip(F.col(k).cast("string")).alias(k) for k in keys]).agg(
        F.count("*").alias("n"), F.min_by(ok, seq).alias("ok")
    )
    totals = per_key.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("original"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicates"),
        F.count_if("ok").alias("clean"),
    )
    removed = (F.col("original") - F.col("clean")) / F.nullif(F.col("original"), F.lit(0)) * 100
    return totals.withColumn("percent_removed", F.coalesce(F.round(removed, 2), F.lit(0.0)))
