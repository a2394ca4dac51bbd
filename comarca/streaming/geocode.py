"""Geocoding of arriving establishments, batch by batch, resumable at every batch.

The progress folder says which files each batch holds; a batch is committed once its rows are written to a folder of
its own. Ended between two commits, the stream repeats no batch; ended inside one, it writes that batch anew.
"""

from pyspark.sql import DataFrame, functions as F

from comarca.plans.geocode import locate
from comarca.sources.writers import keep_last

QUEUE = "id long, cnpj_completo string, logradouro string, numero string, bairro string, municipio string, business_type string"
LOCATED = "id long, lon double, lat double, source string"


def read_pending(spark, path, files_per_batch=1) -> DataFrame:
    """Stream of pending establishments from JSON Lines files, at most so many files a batch."""
    return spark.readStream.schema(QUEUE).option("maxFilesPerTrigger", files_per_batch).json(path)


def start_geocoding(rows, gazetteer, path, checkpoint, fold=True, **trigger):
    """Locate every row of the stream into ``path``, one folder a batch; resumes from ``checkpoint``.

    By default it ends when all files that are there have been read.
    """
    def place(batch, number):
        found = locate(batch, gazetteer, fold).select(F.col("id").cast("long").alias("id"), "lon", "lat", "source")
        found.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return (
        rows.writeStream.foreachBatch(place).option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True})).start()
    )


def located_rows(spark, path) -> DataFrame:
    """All located rows; of an id that came again the latest batch counts."""
    rows = spark.read.schema(f"{LOCATED}, batch long").parquet(path)
    return keep_last(rows, ["id"], F.struct("batch", "lon", "lat")).select("id", "lon", "lat", "source")
