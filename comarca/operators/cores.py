"""Core and border points of density clusters.

Cells are narrow enough that all their points lie within eps of each other, so the points of a cell that holds the
minimum are all core points. Only points of sparser cells are looked at one by one, and a cell has fewer of them than
the minimum; as a cell has 24 neighbours within reach, every point meets at most ``24 * (minimum - 1)`` of them,
however crowded its cell is. Most of these meetings are settled by counts of cells a quarter as wide.
"""

from pyspark.sql import DataFrame, functions as F

from comarca.scale import HOT_ROWS, skew_join
from comarca.session import durable

SPLIT = 4
_AROUND = [(dx, dy) for dx in range(-2, 3) for dy in range(-2, 3)]


def _placed(points, eps):
    from comarca.operators.dbscan import DIAGONAL, _at

    w = eps * DIAGONAL
    fine = points.withColumns({"fx": _at("x", w, SPLIT), "fy": _at("y", w, SPLIT)})
    return fine.withColumns({"cx": F.floor(F.col("fx") / SPLIT), "cy": F.floor(F.col("fy") / SPLIT)})


def _fine_cells(placed, *more):
    """Cells a quarter as wide: count, bounds and further aggregates."""
    return placed.groupBy("cx", "cy", "fx", "fy").agg(
        F.count("*").alias("n"), F.min("x").alias("x1"), F.max("x").alias("x2"), F.min("y").alias("y1"), F.max("y").alias("y2"), *more
    )


# squared distances from a point (px, py) to the nearest and the farthest place of the bounds of a cell
_NEAR = "pow2(greatest(x1 - px, px - x2, 0D)) + pow2(greatest(y1 - py, py - y2, 0D))"
_FAR = "pow2(greatest(abs(px - x1), abs(px - x2))) + pow2(greatest(abs(py - y1), abs(py - y2)))"


def _squares(text):
    """``pow2(e)`` written as ``(e) * (e)``, so that bounds and distances round alike."""
    out = []
    for part in text.split(" + pow2"):
        inner = part.removeprefix("pow2")
        out.append(f"{inner} * {inner}")
    return F.expr(" + ".join(out))


def _meet(asking, cells) -> DataFrame:
    """Every asking point (``pid, px, py, cx, cy``) with the fine cells of the 25 cells around it, and both distances."""
    step = F.explode(F.array(*[F.struct(F.lit(dx).alias("x"), F.lit(dy).alias("y")) for dx, dy in _AROUND]))
    spread = asking.withColumn("_step", step).withColumns(
        {"cx": F.col("cx") + F.col("_step.x"), "cy": F.col("cy") + F.col("_step.y")}
    ).drop("_step")
    return spread.join(cells, ["cx", "cy"]).withColumns({"near": _squares(_NEAR), "far": _squares(_FAR)})


def _opened(open_cells, placed, eps) -> DataFrame:
    """Points of cells that stay open, where they lie within ``eps`` of the point that asks.

    Crowded cells are spread over tasks; their counts are known already.
    """
    top = open_cells.where(F.col("n") >= HOT_ROWS).select("fx", "fy").distinct()
    hot = [(r.fx, r.fy) for r in top.collect()]  # one cell for so many points at most
    there = placed.select("fx", "fy", "id", "x", "y")
    met = skew_join(there, open_cells.select("pid", "px", "py", "fx", "fy"), ["fx", "fy"], hot=hot)
    dx, dy = F.col("px") - F.col("x"), F.col("py") - F.col("y")
    return met.where(dx * dx + dy * dy <= F.lit(eps * eps))


def _asking(placed):
    return placed.select(F.col("id").alias("pid"), F.col("x").alias("px"), F.col("y").alias("py"), "cx", "cy")


def split_cores(points, eps, min_points) -> tuple[DataFrame, DataFrame]:
    """``points(id, x, y)`` as core points and others, both written once."""
    placed = durable(_placed(points, eps))
    cells = durable(_fine_cells(placed))
    whole = cells.groupBy("cx", "cy").agg(F.sum("n").alias("cell_n"))
    full = whole.where(F.col("cell_n") >= min_points)
    crowded = [(r.cx, r.cy) for r in full.where(F.col("cell_n") >= HOT_ROWS).collect()]
    sure = skew_join(placed, full.select("cx", "cy"), ["cx", "cy"], "left_semi", hot=crowded)
    sparse = durable(skew_join(placed, full.select("cx", "cy"), ["cx", "cy"], "left_anti", hot=crowded))

    limit = F.lit(eps * eps)
    met = durable(_meet(_asking(sparse), cells).where(F.col("near") <= limit))
    inside = F.when(F.col("far") <= limit, F.col("n")).otherwise(0)
    told = met.groupBy("pid").agg(F.sum(inside).alias("least"), F.sum("n").alias("most"))
    told = durable(told)
    # a count that is enough, or can't become enough, opens no cell
    undecided = told.where((F.col("least") < min_points) & (F.col("most") >= min_points)).select("pid", "least")
    open_cells = met.where(F.col("far") > limit).join(undecided, "pid")
    more = _opened(open_cells, placed, eps).groupBy("pid").agg(F.count("*").alias("more"))
    late = undecided.join(more, "pid").where(F.col("least") + F.col("more") >= min_points).select("pid")
    found = told.where(F.col("least") >= min_points).select("pid").unionByName(late).withColumnRenamed("pid", "id")
    parted = durable(sparse.join(found.withColumn("_core", F.lit(True)), "id", "left"))
    cores = sure.select("id", "x", "y").unionByName(parted.where("_core").select("id", "x", "y"))
    return durable(cores), parted.where("_core is null").select("id", "x", "y")


def border_points(others, cores, eps) -> DataFrame:
    """``id, core``: the core point of smallest id within ``eps``, for the points that have one."""
    placed = durable(_placed(cores, eps))
    cells = _fine_cells(placed, F.min("id").alias("first"))
    limit = F.lit(eps * eps)
    met = durable(_meet(_asking(_placed(others, eps)), cells).where(F.col("near") <= limit))
    inside = F.when(F.col("far") <= limit, F.col("first"))
    told = met.groupBy("pid").agg(F.min(inside).alias("best"))
    # a cell is opened only if its smallest id could be better than one already sure
    open_cells = met.where(F.col("far") > limit).join(told, "pid").where(F.col("best").isNull() | (F.col("first") < F.col("best")))
    late = _opened(open_cells, placed, eps).groupBy("pid").agg(F.min("id").alias("late"))
    both = told.join(late, "pid", "left").select(F.col("pid").alias("id"), F.least("best", "late").alias("core"))
    return both.where("core is not null")
