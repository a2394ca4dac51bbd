"""Coordinates for establishments that have none yet."""

from pyspark.sql import DataFrame, functions as F

from comarca.functions.geo import with_synthetic_point
from comarca.functions.text import address
from comarca.scale import skew_join
from comarca.sources.readers import pending


def locate(rows, gazetteer, fold=True) -> DataFrame:
    """Add lon, lat and source: the gazetteer's point for the address, else a repeatable one.

    ``gazetteer`` has address, lon and lat; of repeated addresses the smallest point counts.
    """
    asked = rows.withColumn("address", address("logradouro", "numero", "bairro", "municipio"))
    point = F.struct(F.col("lon").alias("_lon"), F.col("lat").alias("_lat"))
    known = gazetteer.groupBy("address").agg(F.min(point).alias("_point")).select("address", "_point.*")
    joined = skew_join(asked, known, ["address"], "left")
    kind = F.coalesce("business_type", F.lit("tech"))
    made = with_synthetic_point(joined, "cnpj_completo", kind, "municipio", "_x", "_y", fold)
    found = F.col("_lon").isNotNull() & F.col("_lat").isNotNull()
    return made.select(
        *rows.columns, "address",
        F.when(found, F.col("_lon")).otherwise(F.col("_x")).alias("lon"),
        F.when(found, F.col("_lat")).otherwise(F.col("_y")).alias("lat"),
        F.when(found, "nominatim").otherwise("fallback").alias("source"),
    )


def geocode(est, gazetteer, fold=True) -> DataFrame:
    """Located pending rows by id. Running it again after ``apply_points`` finds nothing to do."""
    todo = pending(est).select(
        "id", "cnpj_completo", "logradouro", "numero", "bairro", "municipio", "business_type"
    )
    return locate(todo, gazetteer, fold).select("id", "lon", "lat", "source")


def apply_points(est, located) -> DataFrame:
    """Fill coordinates of the located rows and mark them as geocoded."""
    new = located.select("id", F.col("lon").alias("_lon"), F.col("lat").alias("_lat"))
    joined = est.join(new, "id", "left")
    got = F.col("_lon").isNotNull()
    return joined.withColumns(
        {
            "longitude": F.when(got, F.col("_lon")).otherwise(F.col("longitude")).cast("decimal(11,8)"),
            "latitude": F.when(got, F.col("_lat")).otherwise(F.col("latitude")).cast("decimal(10,8)"),
            "geocoded": F.when(got, F.lit(True)).otherwise(F.col("geocoded")),
        }
    ).select(*est.columns)


def geocode_counts(located) -> DataFrame:
    """Rows by source."""
    return located.groupBy("source").agg(F.count("*").alias("n"))
