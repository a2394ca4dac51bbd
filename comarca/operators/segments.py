"""Street segments in a box, visits with their segments, and box joins for many boxes."""

from pyspark.sql import DataFrame, functions as F

from comarca import fixed
from comarca.functions.geo import line_bounds, line_geometry, line_hits_box, parse_box
from comarca.functions.text import iso, or_default_blank
from comarca.operators.filters import of_user
from comarca.scale import skew_join
from comarca.session import durable


def with_bounds(segments) -> DataFrame:
    """Add min/max columns; stored, they let box filters reach the Parquet statistics."""
    return segments.withColumns(line_bounds("geom"))


def in_box(segments, box) -> DataFrame:
    """Segments that meet a box text or tuple: bounds first, then the exact test."""
    x1, y1, x2, y2 = parse_box(box) if isinstance(box, str) else box
    have = segments if "min_x" in segments.columns else with_bounds(segments)
    near = have.where(
        (F.col("min_x") <= x2) & (F.col("max_x") >= x1)
        & (F.col("min_y") <= y2) & (F.col("max_y") >= y1)
    )
    return near.where(line_hits_box("geom", x1, y1, x2, y2)).select(*segments.columns)


def street_defaults():
    return [
        or_default_blank("name", fixed.NO_STREET_NAME).alias("name"),
        F.coalesce(F.col("length_m").cast("double"), F.lit(0.0)).alias("length_m"),
    ]


def with_visits(segments, visits, user=None) -> DataFrame:
    """Segments with the visit state of one user; without a user nothing is visited."""
    base = segments.select("id", "osm_id", *street_defaults(), "geom")
    if user is None:
        return base.select(
            "*", F.lit(False).alias("visited_by_user"), F.lit(None).cast("string").alias("notes"),
            F.lit(None).cast("string").alias("visited_at"),
        )
    own = of_user(visits, user).select(
        F.col("segment_id").alias("id"), F.col("visited").alias("visited_by_user"), "notes",
        iso("visited_at").alias("visited_at"),
    )
    return base.join(own, "id", "left").withColumn(
        "visited_by_user", F.coalesce("visited_by_user", F.lit(False))
    )


def segments_in(segments, visits, box, user=None) -> DataFrame:
    return with_visits(in_box(segments, box), visits, user)


def visits_with_segments(visits, segments) -> DataFrame:
    """Visits of all users with their street; a busy segment is spread over tasks."""
    streets = segments.select(F.col("id").alias("segment_id"), "name", "length_m", "geom")
    joined = skew_join(visits, streets, ["segment_id"])
    return joined.select(
        "user_id", "segment_id", "visited", iso("visited_at").alias("visited_at"), "notes", "source",
        F.col("name").alias("street_name"),
        F.coalesce(F.col("length_m").cast("double"), F.lit(0.0)).alias("length_m"), "geom",
    )


def user_visits(visits, segments, user, box=None) -> DataFrame:
    streets = segments if box is None else in_box(segments, box)
    return visits_with_segments(of_user(visits, user), streets)


def visit_records(visits, segments, user=None, box=None) -> DataFrame:
    """Visits as records: their ``id``, the visit, its street and the line as GeoJSON text; of one user or of all.

    Visits without an ``id`` column get a repeatable one from user and segment.
    """
    own = visits if user is None else of_user(visits, user)
    if "id" not in own.columns:
        own = own.withColumn("id", F.xxhash64("user_id", "segment_id"))
    streets = segments if box is None else in_box(segments, box)
    streets = streets.select(F.col("id").alias("segment_id"), F.col("name").alias("street_name"), "length_m", "geom")
    return skew_join(own, streets, ["segment_id"]).select(
        "id", "user_id", "segment_id", "visited", iso("visited_at").alias("visited_at"), "notes", "source", "street_name",
        F.coalesce(F.col("length_m").cast("double"), F.lit(0.0)).alias("length_m"),
        F.to_json(line_geometry("geom")).alias("geometry"),
    )


def known_visits(visits, segments) -> DataFrame:
    """Visits that refer to an existing segment."""
    ids = segments.select(F.col("id").alias("segment_id"))
    return skew_join(visits, ids, ["segment_id"], "left_semi")


def orphan_visits(visits, segments) -> DataFrame:
    """Visits whose segment is gone."""
    ids = segments.select(F.col("id").alias("segment_id"))
    return skew_join(visits, ids, ["segment_id"], "left_anti")


def mark_selected(segments, chosen) -> DataFrame:
    """Flag the segments whose id is in ``chosen`` (column id)."""
    flag = chosen.select("id").distinct().withColumn("_on", F.lit(True))
    return segments.join(flag, "id", "left").withColumn(
        "selected", F.coalesce("_on", F.lit(False))
    ).drop("_on")


def toggle(current, clicked) -> DataFrame:
    """Ids in exactly one of the two sets."""
    a, b = current.select("id").distinct(), clicked.select("id").distinct()
    return a.exceptAll(b).unionByName(b.exceptAll(a))


def overlay_pending(state, waiting) -> DataFrame:
    """Cached visit state with changes not yet sent laid over it."""
    local = waiting.select("user_id", "segment_id", F.col("visited").alias("_visited"))
    return state.join(local, ["user_id", "segment_id"], "left").withColumn(
        "visited", F.coalesce("_visited", "visited")
    ).drop("_visited")


def _sized(df, x1, y1, x2, y2, detail):
    """Add the size class of the bounds: a power of two, ``detail`` halvings below the extent."""
    extent = F.greatest(F.col(x2) - F.col(x1), F.col(y2) - F.col(y1), F.lit(2.0**-30))
    return df.withColumn("own", F.ceil(F.log2(extent)).cast("int") - detail)


def _levels(df):
    return sorted(r.own for r in df.select("own").distinct().collect())


def _laid(df, others, x1, y1, x2, y2):
    """One row per cell covered, on every grid where the coarser partner sets the size."""
    grids = F.array_distinct(F.transform(F.array(*[F.lit(v) for v in others]), lambda v: F.greatest(v, F.col("own"))))
    size = F.pow(F.lit(2.0), F.col("level"))
    cells = lambda lo, hi: F.explode(F.sequence(F.floor(F.col(lo) / size), F.floor(F.col(hi) / size)))
    return df.withColumn("level", F.explode(grids)).withColumn("cx", cells(x1, x2)).withColumn("cy", cells(y1, y2))


#: A cell with more pairs than this is cut in four, and dealt in blocks where cutting does not help.
PAIRS = 1_000_000
CUTS = 12
_CELL = ["level", "cut", "cx", "cy"]


def _size():
    return F.pow(F.lit(2.0), F.col("level") - F.col("cut"))


def _quarters(df, x1, y1, x2, y2):
    """The rows of cut cells in those quarters that their bounds meet."""
    half = F.pow(F.lit(2.0), F.col("level") - F.col("cut") - 1)
    for c, lo, hi in (("cx", x1, x2), ("cy", y1, y2)):
        first = F.greatest(2 * F.col(c), F.floor(F.col(lo) / half))
        last = F.least(2 * F.col(c) + 1, F.floor(F.col(hi) / half))
        df = df.withColumn(c, F.explode(F.sequence(first, last)))
    return df.withColumn("cut", F.col("cut") + 1)


def _crowded(left, right, pairs):
    """Cells in which more than ``pairs`` pairs meet, with the counts of both sides."""
    a = left.groupBy(*_CELL).agg(F.count("*").alias("na"))
    b = right.groupBy(*_CELL).agg(F.count("*").alias("nb"))
    return a.join(b, _CELL).where(F.col("na") * F.col("nb") > pairs)


def _cut(left, right, pairs):
    """Both sides with crowded cells cut in four until they are not, or until the quarters hold no fewer pairs.

    Only rows of crowded cells are laid out anew.
    """
    bounds = ("min_x", "min_y", "max_x", "max_y"), ("x1", "y1", "x2", "y2")
    left, right = durable(left), durable(right)
    kept = ([], [])
    for _ in range(CUTS):
        crowd = durable(_crowded(left, right, pairs))
        if crowd.isEmpty():
            break
        parts = []
        for side, own, ends in zip((left, right), kept, bounds):
            own.append(side.join(crowd.select(*_CELL), _CELL, "left_anti"))
            parts.append(durable(_quarters(side.join(crowd.select(*_CELL), _CELL, "left_semi"), *ends)))
        held = crowd.agg(F.sum(F.col("na") * F.col("nb"))).first()[0]
        left, right = parts
        a, b = (p.groupBy(*_CELL).count() for p in parts)
        now = a.join(b.withColumnRenamed("count", "other"), _CELL).agg(F.sum(F.col("count") * F.col("other"))).first()[0] or 0
        if now > 0.9 * held:  # bounds that cover the whole cell: space tells them apart no further
            break
    whole = []
    for side, own in zip((left, right), kept):
        for more in own:
            side = side.unionByName(more)
        whole.append(side)
    return whole


def _dealt(left, right, pairs):
    """Both sides with blocks: a crowded cell is split on both sides, and every two of its blocks meet once."""
    block = max(1, int(pairs**0.5))
    crowd = durable(_crowded(left, right, pairs)).select(
        *_CELL, F.ceil(F.col("na") / block).alias("ka"), F.ceil(F.col("nb") / block).alias("kb")
    )
    one = lambda c: F.coalesce(c, F.lit(1))
    every = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), one(c) - 1))
    a = left.join(crowd, _CELL, "left").withColumn("sa", F.pmod(F.xxhash64("id"), one("ka"))).withColumn("sb", every("kb"))
    b = right.join(crowd, _CELL, "left").withColumn("sb", F.pmod(F.xxhash64("box_id"), one("kb"))).withColumn("sa", every("ka"))
    return a.drop("ka", "kb"), b.drop("ka", "kb")


def box_pairs(segments, boxes, detail=1, pairs=PAIRS) -> DataFrame:
    """Pairs of boxes and segments whose bounds overlap: ``box_id, id, inside`` and the box.

    Ids and bounds alone are laid out. Both sides have size classes (at most one per power of two), and a pair meets on
    the grid of the larger one, where either covers at most nine cells however large or small it is. Crowded cells are
    cut in four, again and again, and dealt in blocks of both sides where that does not help. A pair is reported only by
    the cell that holds the lower left corner of the shared bounds, so no duplicates arise. ``inside`` tells that the box
    holds the whole segment.
    """
    bounded = with_bounds(segments) if "min_x" not in segments.columns else segments
    bounded = bounded.select("id", "min_x", "max_x", "min_y", "max_y")
    left = _sized(bounded, "min_x", "min_y", "max_x", "max_y", detail)
    right = _sized(boxes.select("box_id", "x1", "y1", "x2", "y2"), "x1", "y1", "x2", "y2", detail)
    of_segments, of_boxes = _levels(left), _levels(right)
    left = _laid(left, of_boxes or [0], "min_x", "min_y", "max_x", "max_y").withColumn("cut", F.lit(0))
    right = _laid(right, of_segments or [0], "x1", "y1", "x2", "y2").withColumnRenamed("own", "box_own").withColumn("cut", F.lit(0))
    left, right = _dealt(*_cut(left, right, pairs), pairs)
    home_x = F.floor(F.greatest("min_x", "x1") / _size()) == F.col("cx")
    home_y = F.floor(F.greatest("min_y", "y1") / _size()) == F.col("cy")
    overlap = (
        (F.col("min_x") <= F.col("x2")) & (F.col("max_x") >= F.col("x1"))
        & (F.col("min_y") <= F.col("y2")) & (F.col("max_y") >= F.col("y1"))
    )
    inside = (
        (F.col("min_x") >= F.col("x1")) & (F.col("max_x") <= F.col("x2"))
        & (F.col("min_y") >= F.col("y1")) & (F.col("max_y") <= F.col("y2"))
    )
    met = left.join(right, [*_CELL, "sa", "sb"])
    met = met.where((F.col("level") == F.greatest("own", "box_own")) & overlap & home_x & home_y)
    return met.select("box_id", "id", inside.alias("inside"), "x1", "y1", "x2", "y2")


def box_join(segments, boxes, detail=1, pairs=PAIRS) -> DataFrame:
    """Pairs of boxes and segments that meet: ``box_id, id``. Ids of segments are unique.

    Bounds settle most pairs; lines are looked up for those pairs only whose segment crosses the edge of its box.
    """
    # a line of fewer than two vertices has no edge to meet anything
    met = durable(box_pairs(segments.where(F.size("geom") > 1), boxes, detail, pairs))
    crossing = met.where("not inside").join(segments.select("id", "geom"), "id")
    crossing = crossing.where(line_hits_box("geom", "x1", "y1", "x2", "y2"))
    return met.where("inside").select("box_id", "id").unionByName(crossing.select("box_id", "id"))


def place_key(x1, y1, x2, y2, low, high, bits=20):
    """Z-order key of the centre of bounds within the square from ``low`` to ``high``: bits of both axes in turn.

    Places outside of the square count as its border; null bounds come first.
    """
    def spread(v):
        # 20 bits with a gap after each: halves, quarters, ... are moved apart
        for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
            v = v.bitwiseOR(F.shiftleft(v, shift)).bitwiseAND(F.lit(mask))
        return v

    top = (1 << bits) - 1
    whole = lambda a, b: F.least(F.greatest(F.floor(
        ((F.col(a) + F.col(b)) / 2 - F.lit(low)) / F.lit(max(high - low, 2.0**-40)) * top
    ), F.lit(0)), F.lit(top)).cast("long")
    return spread(whole(x1, x2)).bitwiseOR(F.shiftleft(spread(whole(y1, y2)), 1))


def write_by_place(segments, path, files=None) -> None:
    """Parquet with bounds, range-partitioned and sorted along a Z-order curve, so that a box reads few row groups.

    ``files`` is the number of files (by default that of shuffle partitions); rows without a line come first.
    """
    have = segments if "min_x" in segments.columns else with_bounds(segments)
    ends = have.agg(F.min(F.least("min_x", "min_y")), F.max(F.greatest("max_x", "max_y"))).first()  # one row
    low, high = (float(e) if e is not None else 0.0 for e in ends)
    keyed = have.withColumn("_place", place_key("min_x", "min_y", "max_x", "max_y", low, high))
    count = files or int(have.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    laid = keyed.repartitionByRange(count, "_place").sortWithinPartitions("_place").drop("_place")
    laid.write.mode("overwrite").parquet(path)
