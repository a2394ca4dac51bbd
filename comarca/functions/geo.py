"""Coordinates, projections and line geometry as native expressions."""

import math

from pyspark.sql import Column, functions as F

from comarca import fixed
from comarca.functions.text import fold_accents, strip


def _col(c):
    return F.col(c) if isinstance(c, str) else c


def hash_digits(c) -> Column:
    """The md5 of a text, read as one large number, modulo one million; 0 for NULL."""
    hexed = F.md5(_col(c).cast("binary"))
    rest = F.lit(0).cast("bigint")
    for start in (1, 9, 17, 25):
        limb = F.conv(F.substring(hexed, start, 8), 16, 10).cast("bigint")
        rest = (rest * F.lit(2**32 % 10**6) + limb) % F.lit(10**6)
    return F.coalesce(rest, F.lit(0).cast("bigint"))


def hub_of(digits, kind) -> Column:
    """Hub number for a hash, by the preference order of the business type."""
    listed = lambda hubs: F.array(*[F.lit(h) for h in hubs])
    order = listed(fixed.HUB_ORDER_OTHER)
    for name, hubs in fixed.HUB_ORDER.items():
        order = F.when(_col(kind) == name, listed(hubs)).otherwise(order)
    return F.element_at(order, (_col(digits) % 5 + 1).cast("int"))


def _place(key):
    """Number of the first centroid rule that a folded or lower-case city name meets, or 0."""
    rule = F.lit(0)
    for i, (how, text, _, _) in reversed(list(enumerate(fixed.CENTROIDS, 1))):
        hit = key.startswith(text) if how == "prefix" else key.contains(text)
        rule = F.when(hit, i).otherwise(rule)
    return rule


def _pick(values, index):
    """The value at a 1-based index, NULL at 0."""
    return F.get(F.array(*[F.lit(v) for v in values]), index - 1)


def with_centroid(df, city, lng="clng", lat="clat", fold=True):
    """Add the centroid of the city a name points to; NULL when no rule fits."""
    key = F.coalesce(F.lower(strip(city)), F.lit(""))
    named = df.withColumn("_key", fold_accents(key) if fold else key)
    return (
        named.withColumn("_place", _place(F.col("_key")))
        .withColumns(
            {lng: _pick([c[2] for c in fixed.CENTROIDS], F.col("_place")),
             lat: _pick([c[3] for c in fixed.CENTROIDS], F.col("_place"))}
        )
        .drop("_key", "_place")
    )


def with_synthetic_point(df, company, kind, city, lng="lon", lat="lat", fold=True):
    """Add a repeatable point per establishment: city centroid or hub plus cubic jitter.

    The hash, the centroid and the jitter are separate projections, so each is computed once.
    The result is declared not NULL: a null filter on it would repeat the whole expression.
    """
    made = with_centroid(df.withColumn("_digits", hash_digits(company)), city, "_clng", "_clat", fold)
    made = made.withColumns(
        {
            "_hub": hub_of("_digits", kind),
            "_fx": (F.col("_digits") % 1000 - 500) / F.lit(500.0),
            "_fy": (F.floor(F.col("_digits") / 1000) % 1000 - 500) / F.lit(500.0),
            "_spread": F.when(F.col("_clng").isNull(), fixed.HUB_SPREAD).otherwise(fixed.CITY_SPREAD),
        }
    )
    cube = lambda c: F.col(c) * F.col(c) * F.col(c) * F.col("_spread")
    centre = lambda c, at: F.coalesce(c, _pick([h[at] for h in fixed.HUBS], F.col("_hub")))
    return made.withColumns(
        {
            lng: F.coalesce(centre("_clng", 2) + cube("_fx"), F.lit(0.0)),
            lat: F.coalesce(centre("_clat", 3) + cube("_fy"), F.lit(0.0)),
        }
    ).drop("_digits", "_clng", "_clat", "_hub", "_fx", "_fy", "_spread")


def point(lng, lat) -> Column:
    return F.struct(_col(lng).cast("double").alias("x"), _col(lat).cast("double").alias("y"))


def stored_or(lng, lat, other) -> Column:
    """Stored coordinates when both are present, else the other point."""
    both = _col(lng).isNotNull() & _col(lat).isNotNull()
    return F.when(both, point(lng, lat)).otherwise(other)


def parse_line(wkt) -> Column:
    """Vertices of a LINESTRING text; NULL when the text is not one."""
    body = F.regexp_extract(_col(wkt), r"(?i)^\s*LINESTRING\s*\(([^()]+)\)\s*$", 1)
    vertex = lambda t: F.split(F.trim(t), r"\s+")
    line = F.transform(
        F.split(F.nullif(body, F.lit("")), ","),
        lambda t: F.struct(
            vertex(t)[0].cast("double").alias("x"), vertex(t)[1].cast("double").alias("y")
        ),
    )
    return line


def line_text(line) -> Column:
    """LINESTRING text of a vertex array."""
    parts = F.transform(_col(line), lambda v: F.concat_ws(" ", v["x"].cast("string"), v["y"].cast("string")))
    return F.concat(F.lit("LINESTRING("), F.array_join(parts, ", "), F.lit(")"))


def point_geometry(p) -> Column:
    return F.struct(
        F.lit("Point").alias("type"), F.array(_col(p)["x"], _col(p)["y"]).alias("coordinates")
    )


def line_geometry(line) -> Column:
    pairs = F.transform(_col(line), lambda v: F.array(v["x"], v["y"]))
    return F.struct(F.lit("LineString").alias("type"), pairs.alias("coordinates"))


def geometry_member(doc, member) -> Column:
    """A member of a GeoJSON text, as JSON text."""
    return F.get_json_object(_col(doc), f"$.{member}")


def mercator_x(lng) -> Column:
    return F.radians(_col(lng)) * F.lit(fixed.EARTH_RADIUS)


def mercator_y(lat) -> Column:
    half = F.lit(math.pi / 4) + F.radians(_col(lat)) / 2
    return F.ln(F.tan(half)) * F.lit(fixed.EARTH_RADIUS)


def squared_distance(x, y, cx, cy) -> Column:
    dx, dy = _col(x) - _col(cx), _col(y) - _col(cy)
    return dx * dx + dy * dy


def nearest_hub(x, y) -> Column:
    """Hub with the smallest squared distance; the lower number wins a tie."""
    return F.array_min(
        F.array(
            *[
                F.struct(
                    squared_distance(x, y, F.lit(h[2]), F.lit(h[3])).alias("d2"),
                    F.lit(h[0]).alias("hub"),
                )
                for h in fixed.HUBS
            ]
        )
    )["hub"]


def coordinate_text(c) -> Column:
    return F.format_string("%.4f", _col(c).cast("double"))


def parse_box(text):
    """Numbers of a ``lng1,lat1,lng2,lat2`` text as (min x, min y, max x, max y)."""
    parts = text.split(",")
    if len(parts) != 4:
        raise ValueError("a box needs exactly four numbers: lng1,lat1,lng2,lat2")
    try:
        x1, y1, x2, y2 = map(float, parts)
    except ValueError:
        raise ValueError("the numbers of a box must be valid") from None
    return min(x1, x2), min(y1, y2), max(x1, x2), max(y1, y2)


def line_bounds(line):
    """Named min/max columns of a vertex array, for Parquet statistics and bucketing."""
    xs = F.transform(_col(line), lambda v: v["x"])
    ys = F.transform(_col(line), lambda v: v["y"])
    return {
        "min_x": F.array_min(xs), "max_x": F.array_max(xs),
        "min_y": F.array_min(ys), "max_y": F.array_max(ys),
    }


def line_hits_box(line, x1, y1, x2, y2) -> Column:
    """Exact test of a polyline against a closed rectangle; touching counts."""
    line = _col(line)
    x1, y1, x2, y2 = (_col(v) if not isinstance(v, (int, float)) else F.lit(float(v))
                      for v in (x1, y1, x2, y2))

    def hit(i):
        a, b = F.get(line, i), F.get(line, i + 1)
        ax, ay, bx, by = a["x"], a["y"], b["x"], b["y"]
        overlap = (
            (F.greatest(ax, bx) >= x1) & (F.least(ax, bx) <= x2)
            & (F.greatest(ay, by) >= y1) & (F.least(ay, by) <= y2)
        )
        side = lambda px, py: (bx - ax) * (py - ay) - (by - ay) * (px - ax)
        corners = [side(x1, y1), side(x1, y2), side(x2, y1), side(x2, y2)]
        return overlap & (F.least(*corners) <= 0) & (F.greatest(*corners) >= 0)

    found = F.exists(F.sequence(F.lit(0), F.size(line) - 2), hit)
    return F.when(F.size(line) >= 2, found).otherwise(F.lit(False))
