"""Nearest of many given centres, without comparing every point with every centre.

Centres form a tree of square cells, split while a cell holds more than a few of them. Points are put together in
cells too, and each such box walks down the tree, level by level: it keeps the tree cells that can hold the nearest
centre of one of its points. A tree cell is dropped once its nearest place is farther away than a centre that is
known for certain. Points meet only the centres of the cells that are left, so the work follows the number of points
and not its product with the number of centres, wherever either of them crowd.
"""

from pyspark.sql import DataFrame, Window as W, functions as F

from comarca.session import durable

SPLIT = 4
LEAF = 4
DEPTH = 26  # finer than double precision within the extent, where different places differ
_SMALL = 4  # levels with so few cells (SPLIT ** (2 * level)) that they are broadcast

# squared distances between box q and tree cell c: nearest places, and farthest place of q from the known centre
_NEAR = (
    "greatest(c.x1 - q.x2, q.x1 - c.x2, 0D) * greatest(c.x1 - q.x2, q.x1 - c.x2, 0D)"
    " + greatest(c.y1 - q.y2, q.y1 - c.y2, 0D) * greatest(c.y1 - q.y2, q.y1 - c.y2, 0D)"
)
_SURE = (
    "greatest(abs(c.rx - q.x1), abs(c.rx - q.x2)) * greatest(abs(c.rx - q.x1), abs(c.rx - q.x2))"
    " + greatest(abs(c.ry - q.y1), abs(c.ry - q.y2)) * greatest(abs(c.ry - q.y1), abs(c.ry - q.y2))"
)
_BOX = "named_struct('x1', min(x), 'x2', max(x), 'y1', min(y), 'y2', max(y))"


_PLACE = "abs(x) < double('infinity') and abs(y) < double('infinity')"  # neither null nor NaN


def _marks(centres, ident):
    """Different places of centres, each with its smallest id."""
    rows = centres.select(F.col(ident).alias("id"), F.col("x").cast("double"), F.col("y").cast("double"))
    return rows.where("id is not null").where(_PLACE).groupBy("x", "y").agg(F.min("id").alias("id"))


def frame_of(marks):
    """Lower left corner and side of the square around all centres, the side a power of two; and their number."""
    return marks.agg(
        F.count("*").alias("n"), F.min("x").alias("x"), F.min("y").alias("y"),
        F.pow(F.lit(2.0), F.ceil(F.log2(F.greatest(F.max("x") - F.min("x"), F.max("y") - F.min("y"), F.lit(2.0**-40)))) + 1).alias("side"),
    ).first()  # one row


def nearest_centres(points, centres, ident="cluster_id") -> DataFrame:
    """``x, y, n, <ident>, d2`` per different place of ``points(x, y)``: how many points lie there, the id of the
    nearest of ``centres(<ident>, x, y)`` and the squared distance.

    Equal distances go to the smaller id. Points and centres without coordinates take no part, nor do centres without
    an id; without centres there are no rows. Copies of a place are counted before anything meets.
    """
    spots = points.select(F.col("x").cast("double"), F.col("y").cast("double")).where(_PLACE)
    spots = durable(spots.groupBy("x", "y").agg(F.count("*").alias("n")))
    rest = durable(_marks(centres, ident))
    frame = frame_of(rest)
    if not frame.n:
        return spots.select("*", F.lit(None).cast(centres.schema[ident].dataType).alias(ident), F.lit(None).cast("double").alias("d2")).limit(0)

    # boxes of points: about four to a centre, were these spread evenly over their square
    spots, offered = offers(spots, rest, frame, frame.side / 2 ** max(1, (4 * frame.n - 1).bit_length() // 2))
    dx, dy = F.col("x") - F.col("mx"), F.col("y") - F.col("my")
    met = spots.join(offered, ["bx", "by"]).select("x", "y", "n", F.struct((dx * dx + dy * dy).alias("d2"), "id").alias("hit"))
    return met.groupBy("x", "y").agg(F.first("n").alias("n"), F.min("hit").alias("hit")).select(
        "x", "y", "n", F.col("hit.id").alias(ident), F.col("hit.d2").alias("d2")
    )


def offers(spots, rest, frame, width, slack=0.0):
    """``spots`` with their box ``bx, by`` of side ``width``, and ``bx, by, mx, my, id``: the centres each box has to look at.

    These hold every centre whose squared distance from a spot of the box is at most ``slack`` above that of the spot's
    nearest one. ``rest`` has a row ``id, x, y`` per place of a centre, ``frame`` is their square.
    """
    grid = lambda c, low, w: F.floor((F.col(c) - F.lit(low)) / F.lit(w))
    spots = spots.withColumns({"bx": grid("x", frame.x, width), "by": grid("y", frame.y, width)})
    front = spots.groupBy("bx", "by").agg(F.expr(_BOX).alias("q")).select(
        "bx", "by", "q", F.lit(0).cast("bigint").alias("px"), F.lit(0).cast("bigint").alias("py"),
        F.lit(float("inf")).alias("best"),
    )
    found, leaves = [], []
    for level in range(1, DEPTH + 1):
        w = frame.side / SPLIT**level
        placed = rest.withColumns({"cx": grid("x", frame.x, w), "cy": grid("y", frame.y, w)})
        known = F.min(F.struct("id", "x", "y"))
        nodes = placed.groupBy("cx", "cy").agg(F.count("*").alias("m"), F.expr(_BOX).alias("b"), known.alias("r")).select(
            "cx", "cy", "m", F.floor(F.col("cx") / SPLIT).alias("px"), F.floor(F.col("cy") / SPLIT).alias("py"),
            F.struct("b.x1", "b.x2", "b.y1", "b.y2", F.col("r.x").alias("rx"), F.col("r.y").alias("ry")).alias("c"),
        )
        nodes = durable(nodes)
        # at most 16 cells to each of the few parents of the first levels; later ones are left to Spark
        met = front.join(F.broadcast(nodes) if level <= _SMALL else nodes, ["px", "py"])
        met = met.withColumns({"near": F.expr(_NEAR), "sure": F.expr(_SURE)})
        least = F.min("sure").over(W.partitionBy("bx", "by"))
        met = met.withColumn("best", F.least("best", least)).where(F.col("near") <= F.col("best") + slack)
        met = durable(met.select("bx", "by", "q", "cx", "cy", "m", "near", "best"))
        done = (F.col("m") <= LEAF) if level < DEPTH else F.lit(True)
        found.append(met.where(done).select("bx", "by", F.lit(level).alias("level"), "cx", "cy", "near", "best"))
        front = met.where(~done).select("bx", "by", "q", F.col("cx").alias("px"), F.col("cy").alias("py"), "best")
        split = placed.join(nodes.select("cx", "cy", "m"), ["cx", "cy"])
        leaves.append(split.where(done).select(F.lit(level).alias("level"), "cx", "cy", F.col("x").alias("mx"), F.col("y").alias("my"), "id"))
        rest = durable(split.where(~done).select("id", "x", "y"))
        if rest.isEmpty():
            break
    pairs, marks = found[0], leaves[0]
    for more, also in zip(found[1:], leaves[1:]):
        pairs, marks = pairs.unionByName(more), marks.unionByName(also)
    # cells kept on an early level may have lost since
    least = F.min("best").over(W.partitionBy("bx", "by"))
    pairs = pairs.withColumn("best", least).where(F.col("near") <= F.col("best") + slack).select("bx", "by", "level", "cx", "cy")
    return spots, pairs.join(marks, ["level", "cx", "cy"]).select("bx", "by", "mx", "my", "id")
