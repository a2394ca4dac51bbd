"""Tables laid out by key, so that an upsert reads and rewrites only the parts that its keys touch.

Rows are dealt into parts (folders) and, within a part, buckets (files) by hashes of their keys. An upsert looks at the
parts of its source, joins there without shuffling the table, and replaces these parts; files of other parts stay as
they are.
"""

from pyspark.sql import DataFrame, functions as F

from comarca.sources.writers import upsert

PART = "key_part"
_MODE = "spark.sql.sources.partitionOverwriteMode"


def part_of(keys, parts):
    return F.pmod(F.xxhash64(*keys), F.lit(parts)).cast("int")


def _property(spark, name, key):
    return spark.sql(f"SHOW TBLPROPERTIES {name}").where(F.col("key") == key).first()["value"]


def create_keyed(df, name, keys, parts=64, buckets=64, path=None) -> None:
    """A new catalog table of ``df``, laid out by ``keys``; ``path`` keeps its files outside the warehouse folder.

    ``buckets`` is also the number of tasks that an upsert runs in.
    """
    spark = df.sparkSession
    # dealt as the buckets are, so each task writes one file a part
    dealt = df.withColumn(PART, part_of(keys, parts)).repartition(buckets, *keys)
    writer = dealt.write.mode("error").partitionBy(PART).bucketBy(buckets, *keys).sortBy(*keys)
    (writer.option("path", path) if path else writer).saveAsTable(name)
    spark.sql(f"ALTER TABLE {name} SET TBLPROPERTIES ('keyed.parts' = '{parts}', 'keyed.keys' = '{','.join(keys)}', 'keyed.buckets' = '{buckets}')")


def read_keyed(spark, name) -> DataFrame:
    return spark.table(name).drop(PART)


def merged_parts(spark, name, source, update, order=None, **more) -> DataFrame:
    """The parts of the table that ``source`` touches, after ``upsert``; the table's side is not shuffled."""
    keys = _property(spark, name, "keyed.keys").split(",")
    parts, buckets = (int(_property(spark, name, f"keyed.{c}")) for c in ("parts", "buckets"))
    touched = [r[0] for r in source.select(part_of(keys, parts)).distinct().collect()]  # at most ``parts`` numbers
    target = spark.table(name).where(F.col(PART).isin(touched)).drop(PART)
    # the source is dealt as the buckets are; more partitions on its side would make Spark deal the table anew
    merged = upsert(target, source.repartition(buckets, *keys), keys, update, order=order, null_keys=False, **more)
    return merged.withColumn(PART, part_of(keys, parts))


def upsert_keyed(spark, name, source, update, order=None, **more) -> None:
    """``upsert`` (see ``sources.writers``) into a table of ``create_keyed``; keys that are null are refused.

    New files are complete before old ones go, part by part. One upsert at a time may write to a table; running the
    same one again changes nothing more.
    """
    keys = _property(spark, name, "keyed.keys").split(",")
    missing = F.raise_error(F.lit("a key is null")).cast("boolean")
    full = F.lit(True)
    for k in keys:
        full = full & F.col(k).isNotNull()
    merged = merged_parts(spark, name, source.where(F.when(full, F.lit(True)).otherwise(missing)), update, order, **more)
    before = spark.conf.get(_MODE)
    spark.conf.set(_MODE, "dynamic")  # only the folders that are written to are replaced
    try:
        merged.select(*spark.table(name).columns).write.mode("overwrite").insertInto(name)
    finally:
        spark.conf.set(_MODE, before)
    spark.catalog.refreshTable(name)
