"""Density clusters: points linked when they lie within a radius of each other.

With one point as the minimum every point is a core point, so clusters are the connected
components of the "within eps" graph. With more, core points are found first (``operators/cores.py``) and linked in
the same way; other points join a core point they can reach or are noise. Points are reduced to grid cells whose diagonal is at
most eps: one cell is always one cluster. Whether two cells touch is decided from their extreme
points and bounding boxes; pairs that stay open are looked at in finer cells. Points are compared
only where two cells have a handful of them, so crowded cells cost no more than others.
"""

from pyspark.sql import DataFrame, functions as F

from comarca import fixed
from comarca.operators.components import connected_components
from comarca.operators.filters import cluster_input
from comarca.scale import HOT_ROWS, number_rows, skew_join
from comarca.session import durable

DIAGONAL = 0.7071067  # just below 1/sqrt(2): the cell diagonal stays below eps
SPLIT = 4
LEAF = 64  # cell pairs with at most this many point pairs are settled point by point
DEPTH = 24  # finer than double precision, so every open pair is settled before

_AHEAD = [(dx, dy) for dx in range(0, 3) for dy in range(-2, 3) if (dx, dy) > (0, 0)]


def _summary():
    """Per cell: the outermost points, which also give the bounding box."""
    return [
        F.struct(F.min("x").alias("x"), F.min_by("y", "x").alias("y")).alias("west"),
        F.struct(F.max("x").alias("x"), F.max_by("y", "x").alias("y")).alias("east"),
        F.struct(F.min_by("x", "y").alias("x"), F.min("y").alias("y")).alias("south"),
        F.struct(F.max_by("x", "y").alias("x"), F.max("y").alias("y")).alias("north"),
    ]


_BOX = ["west", "east", "south", "north"]


def _packed(prefix):
    return F.struct(*[F.col(c) for c in _BOX]).alias(prefix)


def _square(dx, dy):
    return f"({dx}) * ({dx}) + ({dy}) * ({dy})"


# squared distance between two bounding boxes
_GAP = _square(
    "greatest(box_b.west.x - box_a.east.x, box_a.west.x - box_b.east.x, 0D)",
    "greatest(box_b.south.y - box_a.north.y, box_a.south.y - box_b.north.y, 0D)",
)
# smallest squared distance between the extreme points of two cells
_CLOSEST = "least({})".format(
    ", ".join(
        _square(f"box_a.{p}.x - box_b.{q}.x", f"box_a.{p}.y - box_b.{q}.y") for p in _BOX for q in _BOX
    )
)


def _judge(pairs, eps):
    """Mark pairs as linked or open, and drop those too far apart."""
    limit = F.lit(eps * eps)
    return pairs.where(F.expr(_GAP) <= limit).withColumn("linked", F.expr(_CLOSEST) <= limit)


def _at(c, w, scale=1):
    """Grid index; declared not NULL, so joins on it add no null filter over the input."""
    return F.coalesce(F.floor(F.col(c) / w * F.lit(float(scale))), F.lit(0))


def cell_table(points, eps) -> DataFrame:
    """Non-empty grid cells: column, row, count, coordinate sums, smallest id, extremes."""
    w = eps * DIAGONAL
    return points.groupBy(_at("x", w).alias("cx"), _at("y", w).alias("cy")).agg(
        F.min("id").alias("cell"), F.count("*").alias("n"),
        F.sum("x").alias("sx"), F.sum("y").alias("sy"), *_summary(),
    )


def _few(points, pairs, at, eps):
    """Cell pairs with at most LEAF point pairs, settled by their points."""
    w_a = points.select(at("x").alias("ax"), at("y").alias("ay"), F.col("x").alias("x1"), F.col("y").alias("y1"))
    w_b = points.select(at("x").alias("bx"), at("y").alias("by"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    dx, dy = F.col("x1") - F.col("x2"), F.col("y1") - F.col("y2")
    met = pairs.join(w_a, ["ax", "ay"]).join(w_b, ["bx", "by"])
    return met.where(dx * dx + dy * dy <= F.lit(eps * eps)).select("src", "dst").distinct()


PAIR = ["src", "dst", "ax", "ay", "bx", "by", "na", "nb"]


def _neighbours(cells, eps) -> DataFrame:
    """Pairs of cells near enough to matter, marked as linked or open."""
    side = cells.select("cx", "cy", "cell", "n", _packed("box"))
    ahead = F.explode(F.array(*[F.struct(F.lit(dx).alias("x"), F.lit(dy).alias("y")) for dx, dy in _AHEAD]))
    left = side.select(
        F.col("cell").alias("src"), F.col("cx").alias("ax"), F.col("cy").alias("ay"),
        F.col("n").alias("na"), F.col("box").alias("box_a"), ahead.alias("step"),
    ).withColumns({"cx": F.col("ax") + F.col("step.x"), "cy": F.col("ay") + F.col("step.y")})
    right = side.select(
        "cx", "cy", F.col("cell").alias("dst"), F.col("n").alias("nb"), F.col("box").alias("box_b")
    )
    pairs = left.join(right, ["cx", "cy"]).withColumnsRenamed({"cx": "bx", "cy": "by"})
    return _judge(pairs.select(*PAIR, "box_a", "box_b"), eps).select(*PAIR, "linked")


def _hot_ends(pairs):
    """Crowded cells among the ends of pairs; their counts are known already."""
    ends = pairs.select(F.col("ax").alias("px"), F.col("ay").alias("py"), F.col("na").alias("n")).union(
        pairs.select("bx", "by", "nb")
    )
    top = ends.where(F.col("n") >= HOT_ROWS).distinct().orderBy(F.desc("n"))
    return [(r.px, r.py) for r in top.collect()]


def _late_links(points, undecided, eps) -> DataFrame:
    """Which open pairs of groups hold points within eps: ``src, dst``.

    Every round looks only at points of cells in open pairs, in cells a quarter as wide; a pair
    of groups leaves as soon as one pair of its cells is found linked.
    """
    w = eps * DIAGONAL
    rest, scale, links = points.select("x", "y"), 1, []
    for _ in range(DEPTH):
        if undecided.isEmpty():
            break
        small = F.col("na") * F.col("nb") <= LEAF
        ends = undecided.select(F.col("ax").alias("px"), F.col("ay").alias("py")).union(
            undecided.select("bx", "by")
        )
        here = lambda c, k=scale: _at(c, w, k)
        placed = rest.withColumns({"px": here("x"), "py": here("y")})
        kept = skew_join(placed, ends.distinct(), ["px", "py"], "left_semi", hot=_hot_ends(undecided))
        rest = durable(kept.select("x", "y"))
        few = _few(rest, undecided.where(small).select("src", "dst", "ax", "ay", "bx", "by"), here, eps)

        scale *= SPLIT
        fine = rest.groupBy(_at("x", w, scale).alias("cx"), _at("y", w, scale).alias("cy")).agg(
            F.count("*").alias("n"), *_summary()
        ).withColumns({"px": F.floor(F.col("cx") / SPLIT), "py": F.floor(F.col("cy") / SPLIT)})
        as_side = lambda s: fine.select(
            F.col("px").alias(f"{s}x"), F.col("py").alias(f"{s}y"), F.col("n").alias(f"n{s}"),
            F.col("cx").alias(f"{s}cx"), F.col("cy").alias(f"{s}cy"), _packed(f"box_{s}"),
        )
        many = undecided.where(~small).select("src", "dst", "ax", "ay", "bx", "by")
        finer = many.join(as_side("a"), ["ax", "ay"]).join(as_side("b"), ["bx", "by"])
        finer = finer.drop("ax", "ay", "bx", "by").withColumnsRenamed(
            {"acx": "ax", "acy": "ay", "bcx": "bx", "bcy": "by"}
        )
        told = few.select(
            "src", "dst", *[F.lit(None).cast("bigint").alias(c) for c in PAIR[2:]], F.lit(True).alias("linked")
        )
        judged = durable(_judge(finer, eps).select(*PAIR, "linked").unionByName(told))
        found = judged.where("linked").select("src", "dst").distinct()
        links.append(found)
        undecided = judged.where("not linked").join(found, ["src", "dst"], "left_anti")
    else:
        raise RuntimeError("cell pairs stayed open below double precision")
    out = links[0]
    for more in links[1:]:
        out = out.unionByName(more)
    return out


def _labelled_cells(points, eps):
    """Cells with their component.

    Linked cells are put together first. Open pairs inside one component no longer matter, so
    points are read again only where two components may still touch.
    """
    cells = durable(cell_table(points, eps))
    pairs = durable(_neighbours(cells, eps))
    parts = connected_components(pairs.where("linked").select("src", "dst"))
    labels = durable(
        cells.select("cell").join(parts, F.col("cell") == F.col("node"), "left").select(
            "cell", F.coalesce("component", "cell").alias("component")
        )
    )
    label = lambda end: labels.select(F.col("cell").alias(end), F.col("component").alias(f"{end}_part"))
    between = pairs.where("not linked").drop("linked").join(label("src"), "src").join(label("dst"), "dst")
    between = durable(
        between.where("src_part <> dst_part").withColumns(
            {"src": F.least("src_part", "dst_part"), "dst": F.greatest("src_part", "dst_part")}
        ).select(*PAIR)
    )
    labelled = cells.join(labels, "cell")
    if between.isEmpty():
        return labelled
    merged = connected_components(_late_links(points, between, eps)).select(
        F.col("node").alias("component"), F.col("component").alias("_whole")
    )
    return skew_join(labelled, merged, ["component"], "left").withColumn(
        "component", F.coalesce("_whole", "component")
    ).drop("_whole")


def _assigned(points, eps) -> DataFrame:
    """``points`` with ``component``, all of them being core points."""
    w = eps * DIAGONAL
    labels = durable(_labelled_cells(points, eps).select("cx", "cy", "n", "component"))
    top = labels.where(F.col("n") >= HOT_ROWS).orderBy(F.desc("n"))
    hot = [(r.cx, r.cy) for r in top.collect()]
    placed = points.withColumns({"cx": _at("x", w), "cy": _at("y", w)})
    return skew_join(placed, labels.drop("n"), ["cx", "cy"], hot=hot).drop("cx", "cy")


def density_clusters(points, eps=fixed.CLUSTER_EPS, min_points=fixed.CLUSTER_MIN_POINTS) -> DataFrame:
    """``id, x, y, kind, component`` of every point; kind is core, border or noise.

    A core point has ``min_points`` points within ``eps``, itself included. Clusters are what core points reach in
    steps of ``eps``; a component is its smallest core id. A border point is no core point but near one, and follows
    the near core point of smallest id, so the result depends on no order. Noise has no component. ``points`` has a
    unique ``id`` and coordinates ``x``, ``y``, none of them NULL.
    """
    from comarca.operators.cores import border_points, split_cores

    cores, others = split_cores(points.select("id", "x", "y"), eps, min_points)
    labelled = durable(_assigned(cores, eps))
    near = border_points(others, cores, eps)
    rest = others.join(near, "id", "left").join(
        labelled.select(F.col("id").alias("core"), "component"), "core", "left"
    )
    kind = F.when(F.col("core").isNull(), F.lit("noise")).otherwise(F.lit("border"))
    return labelled.select("id", "x", "y", F.lit("core").alias("kind"), "component").unionByName(
        rest.select("id", "x", "y", kind.alias("kind"), "component")
    )


def dbscan(points, eps=fixed.CLUSTER_EPS, min_points=fixed.CLUSTER_MIN_POINTS) -> DataFrame:
    """Cluster of every point: ``id, x, y, component``; component is its smallest core point id, NULL for noise.

    ``points`` has a unique ``id`` and coordinates ``x``, ``y``, none of them NULL. With ``min_points`` 1 every point
    is a core point; see ``density_clusters`` for the rest.
    """
    if min_points < 1:
        raise ValueError("min_points is at least 1")
    if min_points == 1:
        return _assigned(points, eps)
    return density_clusters(points, eps, min_points).drop("kind")


def cluster_table(points, eps=fixed.CLUSTER_EPS, min_points=fixed.CLUSTER_MIN_POINTS) -> DataFrame:
    """One row per cluster: number, smallest point id, size and centroid.

    Clusters are numbered from 0 by their smallest point id (core point id, where ``min_points`` is more than 1). With
    ``min_points`` 1, sizes and centroids are added up from the cells, so the points are read only once; otherwise
    border points count for their cluster and noise for none.
    """
    if min_points == 1:
        groups = _labelled_cells(points, eps).groupBy("component").agg(
            F.sum("n").alias("total_lojas"),
            (F.sum("sx") / F.sum("n")).alias("x"), (F.sum("sy") / F.sum("n")).alias("y"),
        )
    else:
        groups = dbscan(points, eps, min_points).where("component is not null").groupBy("component").agg(
            F.count("*").alias("total_lojas"), F.avg("x").alias("x"), F.avg("y").alias("y")
        )
    numbered = number_rows(groups, ["component"], "_number")
    return numbered.withColumn("number", F.col("_number") - 1).drop("_number")


def clusters(est, eps=fixed.CLUSTER_EPS, min_points=fixed.CLUSTER_MIN_POINTS) -> DataFrame:
    """Density clusters of active technology and repair establishments, numbered from 100."""
    points = cluster_input(est).select("id", F.col("lon").alias("x"), F.col("lat").alias("y"))
    table = cluster_table(points, eps, min_points)
    return table.select(
        (F.col("number") + fixed.CLUSTER_ID_BASE).alias("cluster_id"), "total_lojas", "x", "y"
    )


def recount_members(members, sector) -> DataFrame:
    """Sector totals by cluster membership, for any number of clusters.

    ``members`` has one row per point with its ``cluster_id`` and activity code ``cnae``.
    """
    from comarca.functions.labels import sector_filter

    return members.groupBy("cluster_id").agg(
        F.count_if(sector_filter("cnae", sector)).alias("total_lojas")
    )
