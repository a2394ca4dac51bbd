"""Writers: files, tables, GeoJSON features, upserts."""

import json

from pyspark.sql import DataFrame, functions as F

from comarca import fixed
from comarca.functions.geo import line_geometry, point, point_geometry, stored_or, with_synthetic_point
from comarca.functions.labels import size_label
from comarca.functions.text import company_id, or_default
from comarca.scale import number_rows, skew_join


def write_json(df, path, mode="overwrite"):
    """JSON Lines, one record per line; non-ASCII text is kept."""
    df.write.mode(mode).json(path)


def write_csv(df, path, mode="overwrite"):
    df.write.mode(mode).option("header", True).csv(path)


def replace_table(df, name, path=None):
    """Replace a catalog table; ``path`` keeps its files outside the warehouse folder."""
    writer = df.write.mode("overwrite")
    (writer.option("path", path) if path else writer).saveAsTable(name)


def write_grid(grid, path):
    """Density grid, one folder per bandwidth."""
    grid.write.mode("overwrite").partitionBy("bandwidth").parquet(path)


def widen(df, columns) -> DataFrame:
    """Add the missing ones of ``columns``: name -> (type, default)."""
    added = {
        name: F.lit(default).cast(kind)
        for name, (kind, default) in columns.items()
        if name not in df.columns
    }
    return df.withColumns(added) if added else df


def _one_per_key(df, keys, pick) -> DataFrame:
    """One row per key; the keys stay plain columns, so that filters on them reach the scan."""
    rest = [c for c in df.columns if c not in keys]
    if not rest:
        return df.distinct()
    best = df.groupBy(*keys).agg(pick(F.struct(*rest)).alias("_row"))
    return best.select(*[F.col(c) if c in keys else F.col(f"_row.{c}") for c in df.columns])


def keep_last(df, keys, order) -> DataFrame:
    """The last row per key by ``order``; rows are reduced before the shuffle."""
    return _one_per_key(df, list(keys), lambda row: F.max_by(row, order))


def keep_first(df, keys, order) -> DataFrame:
    """The first row per key by ``order``; rows are reduced before the shuffle."""
    return _one_per_key(df, list(keys), lambda row: F.min_by(row, order))


def _unrepeated(df, keys, nulls=True) -> DataFrame:
    """``df``; reading it fails where a key without nulls occurs twice. Null keys equal no other; without ``nulls``
    their rows are left out."""
    full = F.lit(True)
    for k in keys:
        full = full & F.col(k).isNotNull()
    rest = [c for c in df.columns if c not in keys]
    listed = df.where(full).groupBy(*keys).agg(F.first(F.struct(F.lit(1), *rest)).alias("_row"), F.count("*").alias("_n"))
    fine = F.when(F.col("_n") > 1, F.raise_error(F.lit("a key occurs twice in the source: give an order")).cast("boolean"))
    once = listed.where(F.coalesce(fine, F.lit(True)))
    once = once.select(*[F.col(c) if c in keys else F.col(f"_row.{c}") for c in df.columns])
    return once.unionByName(df.where(~full)) if nulls else once


def upsert(target, source, keys, update, order=None, stamp=None, reset_geocode_on=(), null_keys=True):
    """Target after inserting new keys and refreshing ``update`` columns of known ones.

    With ``order`` the source is first reduced to its last row per key, as sequential statements
    would leave it; without it a key that the source repeats is an error. ``stamp`` (a timestamp column) sets updated_at on refreshed rows and both
    stamps on inserted ones. ``reset_geocode_on`` lists address columns whose change clears the
    geocoded flag. ``null_keys=False`` says that the source has none, which spares a union.
    """
    if order is not None:
        source = keep_last(source, keys, order)
    else:
        source = _unrepeated(source, list(keys), null_keys)
    t, s = target.alias("t"), source.withColumn("_new", F.lit(True)).alias("s")
    same = [F.col(f"t.{k}") == F.col(f"s.{k}") for k in keys]
    joined = t.withColumn("_old", F.lit(True)).alias("t").join(s, same, "full_outer")
    known = F.col("t._old") & F.coalesce(F.col("s._new"), F.lit(False))
    inserted = F.col("t._old").isNull()

    moved = F.lit(False)
    for c in reset_geocode_on:
        moved = moved | ~F.col(f"t.{c}").eqNullSafe(F.col(f"s.{c}"))
    moved = known & moved

    def value(c):
        old = F.col(f"t.{c}")
        new = F.col(f"s.{c}") if c in source.columns else F.lit(None)
        if stamp is not None and c == "updated_at":
            return F.when(known | inserted, stamp).otherwise(old)
        if stamp is not None and c == "created_at":
            return F.when(inserted, stamp).otherwise(old)
        if c == "geocoded" and reset_geocode_on:
            old = F.when(moved, F.lit(False)).otherwise(old)
        if c in keys:
            return F.coalesce(old, new)
        refreshed = inserted | known if c in update else inserted
        return F.when(refreshed, new).otherwise(old)

    return joined.select(*[value(c).alias(c) for c in target.columns])


def insert_absent(target, new, keys) -> DataFrame:
    """Rows of ``new`` whose key the target lacks; append these."""
    return skew_join(new, target.select(*keys), list(keys), "left_anti")


def stable_id(*columns):
    """Repeatable 64-bit id from natural keys."""
    return F.xxhash64(*columns)


def with_new_ids(target, new, order, name="id") -> DataFrame:
    """Number new rows upwards from the largest id of the target."""
    last = target.agg(F.coalesce(F.max(name), F.lit(0))).scalar()
    placed = number_rows(new, order, "_place")
    return placed.withColumn(name, last + F.col("_place")).drop("_place")


def heatmap_features(est, fold=True) -> DataFrame:
    """One GeoJSON point feature per establishment as a struct column ``feature``."""
    missing = {
        c: F.lit(None).cast("string")
        for c in ("longitude", "latitude", "cnae_fiscal", "cnae_fiscal_principal",
                  "cnae_fiscal_descricao", "numero", "cep", "telefone_1", "porte_empresa")
        if c not in est.columns
    }
    est = est.withColumns(missing) if missing else est
    est = est.withColumns(
        {"_company": company_id("cnpj_basico", "cnpj_ordem", "cnpj_dv"),
         "_kind": or_default("business_type", "retail")}
    )
    est = with_synthetic_point(est, "_company", "_kind", "municipio", "_x", "_y", fold)
    where = stored_or("longitude", "latitude", point("_x", "_y"))
    code = F.coalesce(F.col("cnae_fiscal").cast("string"), "cnae_fiscal_principal", F.lit(""))
    text = lambda c: or_default(F.col(c).cast("string"), "")
    properties = F.struct(
        F.col("_company").alias("cnpj"),
        or_default("nome_fantasia", fixed.DEFAULT_NAME).alias("nome_fantasia"),
        F.col("_kind").alias("business_type"),
        code.alias("cnae"),
        text("cnae_fiscal_descricao").alias("cnae_desc"),
        or_default("bairro", fixed.DEFAULT_DISTRICT).alias("bairro"),
        text("logradouro").alias("logradouro"),
        text("numero").alias("numero"),
        text("cep").alias("cep"),
        text("telefone_1").alias("telefone_1"),
        text("porte_empresa").alias("porte_empresa"),
        size_label("porte_empresa").alias("porte_desc"),
        F.when(F.coalesce("municipio", F.lit("")) == "", fixed.DEFAULT_CITY)
        .otherwise(F.col("municipio"))
        .alias("municipio"),
    )
    return est.select(
        F.struct(
            F.lit("Feature").alias("type"),
            point_geometry(where).alias("geometry"),
            properties.alias("properties"),
        ).alias("feature")
    )


def segment_features(rows) -> DataFrame:
    """One GeoJSON line feature per street segment with its visit state (``operators.segments.with_visits``)."""
    properties = F.struct("id", "osm_id", "name", "length_m", "visited_by_user", "notes", "visited_at")
    return rows.select(F.struct(
        F.lit("Feature").alias("type"), line_geometry("geom").alias("geometry"), properties.alias("properties")
    ).alias("feature"))


def write_features(features, path, nulls=False):
    """Newline-delimited GeoJSON, written by every task; ``nulls`` keeps members without a value."""
    text = F.to_json("feature", {"ignoreNullFields": str(not nulls).lower()})
    features.select(text.alias("value")).write.mode("overwrite").text(path)


def write_density_csv(grid, stats, folder, bandwidth=500.0):
    """Density statistics of all bandwidths and the cells of one of them, as two CSV folders under ``folder``."""
    write_csv(stats, f"{folder}/statistics")
    cells = grid.where(F.col("bandwidth") == float(bandwidth))
    write_csv(cells.select("cell_x", "cell_y", F.col("density").alias("density_stores_km2")), f"{folder}/grid")


def write_collection(features, path, order, metadata=None):
    """One FeatureCollection of any size as part files: their texts, in the order of their names, are the document.

    Every task writes its features, one a line, sorted by ``order``; ``metadata`` is a small value for JSON.
    """
    spark = features.sparkSession
    more = "" if metadata is None else ',"metadata":' + json.dumps(metadata, ensure_ascii=False)
    head, foot = (
        spark.createDataFrame([(line,)], "value string").coalesce(1)
        for line in ('{"type":"FeatureCollection","features":[', f"]{more}}}")
    )
    placed = number_rows(features, order, "_place")
    comma = F.when(F.col("_place") > 1, ",").otherwise("")
    lines = placed.select(F.concat(comma, F.to_json("feature")).alias("value"))
    # a union keeps its parts one behind the other
    head.union(lines).union(foot).write.mode("overwrite").text(path)


def feature_collection(features, metadata=None, most=10_000) -> DataFrame:
    """One FeatureCollection document for a small result.

    A document is one row, so the number of features is checked first; write larger results
    with ``write_collection``.
    """
    if features.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} features: use write_collection")
    parts = [F.lit("FeatureCollection").alias("type"), F.col("features")]
    if metadata is not None:
        parts.append(metadata.alias("metadata"))
    ordered = "_place" in features.columns
    item = F.struct("_place", "feature") if ordered else F.struct("feature")
    listed = F.array_sort(F.collect_list(item)) if ordered else F.collect_list(item)
    rows = features.agg(F.transform(listed, lambda f: f["feature"]).alias("features"))
    return rows.select(F.struct(*parts).alias("document"))
