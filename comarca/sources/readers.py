"""Readers for registry files, business records and database tables."""

import logging

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, functions as F

from comarca import fixed, schemas


def read_registry_csv(spark, paths) -> DataFrame:
    """Headerless ``;`` Latin-1 registry files; every column stays text.

    Quotes inside quoted text are doubled and a backslash is an ordinary character.
    """
    return (
        spark.read.schema(schemas.RAW_ESTAB)
        .option("sep", ";")
        .option("quote", '"')
        .option("escape", '"')
        .option("encoding", "ISO-8859-1")
        .option("header", False)
        .csv(paths)
    )


BAD_LINE = "_bad_line"


def read_registry_checked(spark, paths) -> DataFrame:
    """``read_registry_csv`` with ``_bad_line``: the whole line where a row has too few or too many fields or an
    unclosed quote, NULL for sound rows. A fault stays within its line."""
    return (
        spark.read.schema(f"{schemas.RAW_ESTAB}, {BAD_LINE} string")
        .option("sep", ";").option("quote", '"').option("escape", '"')
        .option("encoding", "ISO-8859-1").option("header", False)
        .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", BAD_LINE)
        .option("columnPruning", "false")  # else unread fields are not counted
        .csv(paths)
    )


def quarantine(spark, paths, folder):
    """Sound registry rows of ``paths``; the others go to Parquet files under ``folder``.

    Returns the sound rows, the refused ones (``cnpj_basico`` as far as it could be read, ``line``, ``fields``: the
    number of separators plus one) and their counts (``kept``, ``refused``; together all lines that are not blank).
    """
    rows = read_registry_checked(spark, paths)
    bad = rows.where(F.col(BAD_LINE).isNotNull()).select(
        "cnpj_basico", F.col(BAD_LINE).alias("line"), F.size(F.split(BAD_LINE, ";")).alias("fields")
    )
    bad.write.mode("overwrite").parquet(folder)
    # always true, and names a field: rows can't be read from a file by their fault alone
    named = F.coalesce("cnpj_basico", F.lit("")) >= ""
    sound = rows.where(F.col(BAD_LINE).isNull() & named).drop(BAD_LINE)
    refused = spark.read.schema("cnpj_basico string, line string, fields int").parquet(folder)
    zero = F.lit(0).cast("long")
    counts = sound.agg(F.count("*").alias("kept")).withColumn("refused", zero).unionByName(
        refused.agg(F.count("*").alias("refused")).withColumn("kept", zero)
    ).agg(F.sum("kept").alias("kept"), F.sum("refused").alias("refused"))
    return sound, refused, counts


def read_business_json(spark, path, lines=False) -> DataFrame:
    """Business records: one JSON array, or JSON Lines with ``lines=True``.

    A JSON array cannot be split, so one file is one task; convert large ones to Parquet once.
    """
    return spark.read.schema(schemas.BUSINESS_JSON).json(path, multiLine=not lines)


def read_jdbc(spark, url, table, column, lower, upper, partitions, **options) -> DataFrame:
    """Database table read in parallel ranges of ``column``; filters and columns push down."""
    return spark.read.jdbc(
        url, table, column=column, lowerBound=lower, upperBound=upper, numPartitions=partitions,
        properties={k: str(v) for k, v in options.items()},
    )


def first_non_empty(readers):
    """First source that exists and has at least one row; None when there is none.

    ``readers`` are functions without arguments. Each try costs a one-row job. A source that fails, such as a
    database that is down, is logged and passed over.
    """
    for reader in readers:
        try:
            df = reader()
            if not df.isEmpty():
                return df
        except (PySparkException, Py4JError, OSError) as error:
            logging.getLogger(__name__).warning("source passed over: %s", str(error).split("\n")[0])
    return None


def pending(est) -> DataFrame:
    """Active establishments that have no coordinates yet."""
    todo = ~F.coalesce(F.col("geocoded"), F.lit(False))
    return est.where(todo & (F.col("situacao_cadastral") == fixed.ACTIVE))


def street_scan(est) -> DataFrame:
    """The three columns street analytics needs; older tables carry another code column."""
    codes = [c for c in ("cnae_fiscal", "cnae_fiscal_principal") if c in est.columns]
    code = F.coalesce(*[F.col(c).cast("string") for c in codes]).alias("cnae")
    return est.select("logradouro", code, "porte_empresa")
