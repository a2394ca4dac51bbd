"""Streets, corridor, hubs, search pages and cluster statistics."""

from unicodedata import combining, normalize

from pyspark.sql import DataFrame, functions as F

from comarca import fixed
from comarca.functions.geo import hash_digits, hub_of, nearest_hub
from comarca.functions.labels import (
    category, percent, subcategory_icon, subcategory_label, tech_name,
)
from comarca.functions.text import company_id, fold_accents, or_default_blank, strip
from comarca.operators.filters import in_sector, on_streets, search
from comarca.operators.nearest import nearest_centres
from comarca.scale import number_rows
from comarca.sources.readers import street_scan


def street_categories(est, sizes=fixed.STREET_SIZES) -> DataFrame:
    """Every street: total, sorted category counts and predominant category.

    Rows are counted per street and category before the shuffle; the list per street is bounded
    by the number of categories.
    """
    rows = on_streets(street_scan(est), sizes)
    counted = rows.groupBy(
        strip("logradouro").alias("logradouro"), category("cnae").alias("categoria")
    ).agg(F.count("*").alias("cantidad"))
    per_street = counted.groupBy("logradouro").agg(
        F.sum("cantidad").alias("total_negocios"),
        F.sort_array(
            F.collect_list(F.struct((-F.col("cantidad")).alias("minus"), "categoria"))
        ).alias("_list"),
    )
    listed = F.transform(
        "_list", lambda e: F.struct(e["categoria"].alias("categoria"), (-e["minus"]).alias("cantidad"))
    )
    return per_street.select(
        "logradouro", "total_negocios", listed.alias("distribucion_rubros"),
        F.col("_list")[0]["categoria"].alias("predominancia"),
    )


def top_streets(est, k=15, sizes=fixed.STREET_SIZES) -> DataFrame:
    """The ``k`` streets with most establishments."""
    return street_categories(est, sizes).orderBy(F.desc("total_negocios"), "logradouro").limit(k)


def corridor_city(city, fold=True):
    """First corridor city that a name equals or shares five leading letters with."""
    name = F.lower(strip(city))
    name = fold_accents(name) if fold else name
    fold_text = lambda v: "".join(
        c for c in normalize("NFD", v) if not combining(c)
    )
    rule = F.lit(None).cast("string")
    for text, _, _ in reversed(fixed.CORRIDOR):
        start = (fold_text(text.lower()) if fold else text.lower())[:5]
        # an equal name shares its first letters too
        rule = F.when(name.startswith(start), text).otherwise(rule)
    return rule


def corridor_dim(spark) -> DataFrame:
    rows = [(i + 1, *c) for i, c in enumerate(fixed.CORRIDOR)]
    return spark.createDataFrame(rows, "place int, city string, lng double, lat double")


def corridor_counts(est, fold=True) -> DataFrame:
    """Total, tech and repairs per corridor city, zero-filled, and a grand total (city NULL)."""
    # names repeat, so rows are counted per name first and each name is matched once
    named = est.groupBy("municipio", "business_type").agg(F.count("*").alias("n"))
    found = named.withColumn("city", corridor_city("municipio", fold)).where(F.col("city").isNotNull())
    of_type = lambda k: F.coalesce(F.sum(F.when(F.col("business_type") == k, F.col("n"))), F.lit(0))
    counted = found.rollup("city").agg(
        F.sum("n").alias("total"), of_type("tech").alias("tech"), of_type("repairs").alias("repairs")
    )
    # at most eight rows on either side: seven cities and the grand total
    frame = corridor_dim(est.sparkSession).unionByName(
        est.sparkSession.createDataFrame([(0,)], "place int"), allowMissingColumns=True
    )
    filled = frame.join(F.broadcast(counted), counted["city"].eqNullSafe(frame["city"]), "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return filled.select(
        "place", frame["city"], "lng", "lat", zero("total"), zero("tech"), zero("repairs")
    )


def corridor_document(est, fold=True) -> DataFrame:
    """City points, the route line and the corridor's totals as one GeoJSON document in a struct column ``document``."""
    rows = _corridor_features(corridor_counts(est, fold))  # eight rows
    total = lambda c: F.max(F.when(F.col("place") == 0, F.col(c)))
    found = rows.agg(
        F.array_sort(F.collect_list(F.struct("_place", "feature"))).alias("parts"), total("total").alias("total"),
        total("tech").alias("tech"), total("repairs").alias("repairs"),
    )
    metadata = F.struct(
        F.lit(fixed.CORRIDOR_NAME).alias("corridor"), F.array(*[F.lit(c[0]) for c in fixed.CORRIDOR]).alias("cities"),
        F.col("total").alias("total_businesses"), F.col("tech").alias("total_tech"), F.col("repairs").alias("total_repairs"),
        F.coalesce(percent("tech", "total"), F.lit(0.0)).alias("tech_pct"),
    )
    return found.select(F.struct(
        F.lit("FeatureCollection").alias("type"), F.transform("parts", lambda e: e["feature"]).alias("features"),
        metadata.alias("metadata"),
    ).alias("document"))


def corridor_features(est, fold=True) -> DataFrame:
    """City points and the route line as GeoJSON features, in road order."""
    return _corridor_features(corridor_counts(est, fold)).select("_place", "feature")


def _corridor_features(rows) -> DataFrame:
    city = F.struct(
        F.lit("Feature").alias("type"),
        F.to_json(F.struct(F.lit("Point").alias("type"), F.array("lng", "lat").alias("coordinates"))).alias("geometry"),
        F.to_json(
            F.struct(
                F.col("city").alias("name"), F.col("total").alias("total_businesses"),
                F.col("tech").alias("tech_businesses"), F.col("repairs").alias("repairs_businesses"),
                F.lit("city").alias("type"),
            )
        ).alias("properties"),
    )
    path = F.array(*[F.array(F.lit(lng), F.lit(lat)) for _, lng, lat in fixed.CORRIDOR])
    route = F.struct(
        F.lit("Feature").alias("type"),
        F.to_json(F.struct(F.lit("LineString").alias("type"), path.alias("coordinates"))).alias("geometry"),
        F.to_json(
            F.struct(
                F.lit(f"{fixed.CORRIDOR_NAME} Corridor").alias("name"), F.lit("route").alias("type"),
                F.lit(len(fixed.CORRIDOR)).alias("total_cities"),
                F.col("total").alias("total_businesses"), F.col("tech").alias("total_tech"),
                F.col("repairs").alias("total_repairs"),
            )
        ).alias("properties"),
    )
    place = F.when(F.col("place") == 0, len(fixed.CORRIDOR) + 1).otherwise(F.col("place"))
    feature = F.when(F.col("place") == 0, route).otherwise(city)
    return rows.select("*", place.alias("_place"), feature.alias("feature"))


def corridor_line(dim) -> DataFrame:
    """One row per corridor: its centres as an ordered polyline."""
    spots = F.array_sort(F.collect_list(F.struct("place", F.col("lng").alias("x"), F.col("lat").alias("y"))))
    return dim.agg(F.transform(spots, lambda s: F.struct(s["x"].alias("x"), s["y"].alias("y"))).alias("line"))


def corridor_summary(est, fold=True) -> DataFrame:
    total = corridor_counts(est, fold).where("place = 0")
    return total.select(
        F.lit(fixed.CORRIDOR_NAME).alias("corridor"),
        F.col("total").alias("total_businesses"), F.col("tech").alias("total_tech"),
        F.col("repairs").alias("total_repairs"),
        percent("tech", "total").alias("tech_pct"),
    )


def tech_businesses(est, text="") -> DataFrame:
    """Technology establishments that match a text, with their labels."""
    have = [c for c in ("cnae_fiscal", "cnae_fiscal_principal") if c in est.columns]
    code = F.coalesce(*[F.nullif(F.col(c).cast("string"), F.lit("")) for c in have], F.lit(""))
    tech = est.where(F.col("business_type") == "tech").withColumn("cnae", code)
    company = company_id("cnpj_basico", "cnpj_ordem", "cnpj_dv")
    return search(tech, text).select(
        company.alias("cnpj"),
        tech_name("nome_fantasia", company).alias("nome_fantasia"),
        "cnae",
        subcategory_label("cnae").alias("cnae_label"),
        subcategory_icon("cnae").alias("cnae_icon"),
        or_default_blank("bairro", fixed.DEFAULT_DISTRICT).alias("bairro"),
        F.coalesce("logradouro", F.lit("")).alias("logradouro"),
        or_default_blank("municipio", fixed.DEFAULT_CITY).alias("municipio"),
        "business_type",
    )


def page(df, key, limit=50, offset=0, after=None) -> DataFrame:
    """One page in key order. ``after`` starts past a key instead of counting rows over."""
    if after is not None:
        return df.where(F.col(key) > F.lit(after)).orderBy(key).limit(limit)
    return df.orderBy(key).offset(offset).limit(limit)


def page_state(df, limit=50, offset=0) -> DataFrame:
    """Total matches, rows on the page, whether more follow and how many."""
    shown = F.greatest(F.least(F.lit(limit), F.col("total") - offset), F.lit(0))
    return (
        df.agg(F.count("*").alias("total"))
        .withColumn("shown", shown.cast("bigint"))
        .withColumn("has_more", offset + F.col("shown") < F.col("total"))
        .withColumn("remaining", F.greatest(F.col("total") - offset - F.col("shown"), F.lit(0)))
    )


def hub_dim(spark) -> DataFrame:
    return spark.createDataFrame(
        fixed.HUBS,
        "hub int, hub_name string, lng double, lat double, zone string, bias string, density string",
    )


def with_hub(df, hub="hub") -> DataFrame:
    """Attach the metadata of the five hubs."""
    dim = hub_dim(df.sparkSession).withColumnRenamed("hub", "_hub")
    # five fixed rows
    return df.join(F.broadcast(dim), F.col(hub) == F.col("_hub"), "left").drop("_hub")


def _all_hubs(counted):
    dim = hub_dim(counted.sparkSession).select("hub", "lng", "lat")
    # the counts have at most five rows
    filled = dim.join(F.broadcast(counted), "hub", "left")
    return filled.select(
        F.col("hub").alias("cluster_id"),
        F.coalesce("total_lojas", F.lit(0)).cast("bigint").alias("total_lojas"),
        F.col("lng").alias("x"), F.col("lat").alias("y"),
    )


def hub_counts(est) -> DataFrame:
    """Establishments per hub by id hash; every hub is present. Cities are not looked at."""
    digits = hash_digits(company_id("cnpj_basico", "cnpj_ordem", "cnpj_dv"))
    kind = F.coalesce("business_type", F.lit("retail"))
    counted = est.groupBy(hub_of(digits, kind).alias("hub")).agg(F.count("*").alias("total_lojas"))
    return _all_hubs(counted)


def ranked(clusters) -> DataFrame:
    return clusters.orderBy(F.desc("total_lojas"), "cluster_id")


def recount(clusters, points, sector, centres=None) -> DataFrame:
    """Cluster totals for a sector: each point counts for its nearest centre.

    ``centres`` (cluster_id, x, y) defaults to the five hubs; of others there may be any number.
    """
    if sector == "all":
        return clusters
    rows = in_sector(points, sector)
    if centres is not None:
        near = nearest_centres(rows.select(F.col("lon").alias("x"), F.col("lat").alias("y")), centres)
        return _with_totals(clusters, near.groupBy("cluster_id").agg(F.sum("n").alias("_n")))
    near = nearest_hub("lon", "lat")
    # a point without coordinates is near no centre; a key that cannot be NULL also spares the
    # optimizer a null filter that would repeat the whole coordinate expression
    key = F.coalesce(near, F.lit(0)).alias("cluster_id")
    return _with_totals(clusters, rows.groupBy(key).agg(F.count("*").alias("_n")))


def _with_totals(clusters, counted):
    joined = clusters.drop("total_lojas").join(counted, "cluster_id", "left")
    return joined.withColumn("total_lojas", F.coalesce("_n", F.lit(0))).drop("_n")


def cluster_summary(clusters) -> DataFrame:
    """Total, mean and largest cluster; 0, 0 and N/A when there are none."""
    top = F.max_by("cluster_id", F.struct("total_lojas", (-F.col("cluster_id")).alias("m")))
    return clusters.agg(
        F.coalesce(F.sum("total_lojas"), F.lit(0)).alias("total"),
        F.coalesce(F.round(F.avg("total_lojas"), 0), F.lit(0)).cast("bigint").alias("average"),
        F.coalesce(F.concat(F.lit("#"), top.cast("string")), F.lit("N/A")).alias("top_cluster"),
    )


def with_rank(clusters) -> DataFrame:
    """Position in the ranking and the top-three flag."""
    placed = number_rows(clusters, [F.desc("total_lojas"), F.col("cluster_id")], "position")
    return placed.withColumn("premium", F.col("position") <= 3)


def counts_by_type_and_city(est) -> DataFrame:
    """Counts per type, per city and overall in one pass."""
    return est.groupingSets(
        [["business_type"], ["municipio"], []], "business_type", "municipio"
    ).agg(F.count("*").alias("n"))


def profile(raw) -> DataFrame:
    """Counts of target-city, active and per-group rows of raw registry data."""
    groups = {
        f"n_{name}": F.count_if(F.col("cnae_fiscal_principal").isin(codes))
        for name, codes in fixed.PROFILE_CODES.items()
    }
    return raw.agg(
        F.count("*").alias("total"),
        F.count_if(F.col("codigo_municipio").isin(fixed.PROFILE_CITIES)).alias("n_region"),
        F.count_if(F.col("situacao_cadastral") == fixed.ACTIVE).alias("n_active"),
        *[c.alias(name) for name, c in groups.items()],
    )
