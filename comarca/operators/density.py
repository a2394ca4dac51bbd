"""Gaussian kernel density on a regular grid."""

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from comarca import fixed
from comarca.functions.geo import mercator_x, mercator_y
from comarca.operators.nearest import frame_of, offers
from comarca.scale import exact_quantiles
from comarca.session import durable

REACH = 8.5  # bandwidths; a kernel beyond is below double precision of its peak


def metric_points(df, lng="lon", lat="lat") -> DataFrame:
    return df.select(mercator_x(lng).alias("x"), mercator_y(lat).alias("y"))


def extent(points, margin=0.0) -> DataFrame:
    """Bounds of the points, widened by ``margin``."""
    return points.agg(
        (F.min("x") - margin).alias("min_x"), (F.min("y") - margin).alias("min_y"),
        (F.max("x") + margin).alias("max_x"), (F.max("y") + margin).alias("max_y"),
    )


def kernel(d2, bandwidth):
    """Gaussian kernel in points per square kilometre."""
    h2 = bandwidth * bandwidth
    return F.exp(-d2 / F.lit(2.0 * h2)) * F.lit(1e6 / (2.0 * math.pi * h2))


def _tile(bandwidth, resolution, reach):
    """Cells along a tile: about the reach of the kernel, so a point goes to few tiles."""
    cells = max(64.0, min(256.0, bandwidth * reach / resolution))
    return 2 ** math.ceil(math.log2(cells))


HELD = 200  # tiles a task adds up at once before it hands them on


def _tile_sums(min_x, min_y, cols, lines, resolution, tiles, reach):
    """Add up kernels tile by tile over a stream of points in spatial order.

    A point is added to every tile within reach. Sums are handed on as they are when many tiles
    are held, and meet again in the final sum per cell. The task function carries all it needs, so
    workers need not have this package.
    """
    most = HELD

    def spread(lo, hi):
        """Row numbers and values of the ranges ``lo..hi`` written one under the other."""
        count = np.maximum(hi - lo + 1, 0)
        row = np.repeat(np.arange(len(lo)), count)
        first = np.cumsum(count) - count
        return row, lo[row] + np.arange(len(row)) - first[row]

    def add(batches):
        held = {}

        def rows():
            for (h, tx, ty), total in held.items():
                iy, ix = np.nonzero(total)
                ix, iy, part = ix + tx * tiles[h], iy + ty * tiles[h], total[iy, ix]
                inside = (ix < cols) & (iy < lines)
                yield pd.DataFrame(
                    {"bandwidth": h, "ix": ix[inside], "iy": iy[inside], "part": part[inside]}
                )
            held.clear()

        for batch in batches:
            x, y, n = (batch[c].to_numpy() for c in ("x", "y", "n"))
            for h, tile in tiles.items():
                side, steps = tile * resolution, np.arange(tile)

                def span(v, low, count):
                    lo = np.floor((v - h * reach - low) / side).astype(np.int64)
                    hi = np.floor((v + h * reach - low) / side).astype(np.int64)
                    return np.maximum(lo, 0), np.minimum(hi, (count - 1) // tile)

                row, tx = spread(*span(x, min_x, cols))
                lo_y, hi_y = span(y, min_y, lines)
                again, ty = spread(lo_y[row], hi_y[row])
                row, tx = row[again], tx[again]
                order = np.lexsort((ty, tx))
                row, tx, ty = row[order], tx[order], ty[order]
                cuts = np.flatnonzero((tx[1:] != tx[:-1]) | (ty[1:] != ty[:-1])) + 1
                for run in np.split(np.arange(len(row)), cuts):
                    if not len(run):
                        continue
                    key = (h, int(tx[run[0]]), int(ty[run[0]]))
                    at = row[run]
                    gx = min_x + (key[1] * tile + steps) * resolution
                    gy = min_y + (key[2] * tile + steps) * resolution
                    ex = np.exp(-((x[at, None] - gx) ** 2) / (2 * h * h))
                    ey = np.exp(-((y[at, None] - gy) ** 2) / (2 * h * h)) * n[at, None]
                    total = ey.T @ ex
                    held[key] = held[key] + total if key in held else total
                    if len(held) > most:
                        yield from rows()
        yield from rows()

    return add


def kde(
    points, resolution=fixed.KDE_RESOLUTION, bandwidths=tuple(fixed.KDE_BANDWIDTHS),
    margin=fixed.KDE_MARGIN, reach=REACH,
) -> DataFrame:
    """Points per square kilometre at every grid cell: ``bandwidth, ix, iy, cell_x, cell_y, density``.

    Points are range-partitioned by place (and by hash within a place, so a crowded place is
    shared by many tasks). Every task adds up kernels for the tiles its points reach; the parts
    meet in one sum per cell.
    """
    box = extent(points, margin).first()
    if box.min_x is None:
        return points.sparkSession.createDataFrame(
            [], "bandwidth double, ix long, iy long, cell_x double, cell_y double, density double"
        )
    cols = math.ceil((box.max_x - box.min_x) / resolution)
    lines = math.ceil((box.max_y - box.min_y) / resolution)
    tiles = {float(b): _tile(b, resolution, reach) for b in bandwidths}
    side = max(tiles.values()) * resolution
    h = F.col("bandwidth")

    weighted = points.groupBy("x", "y").agg(F.count("*").alias("n"))
    placed = (
        weighted.withColumns(
            {"px": F.floor((F.col("x") - box.min_x) / side), "py": F.floor((F.col("y") - box.min_y) / side)}
        )
        .repartitionByRange("px", "py", F.xxhash64("x", "y"))
        .sortWithinPartitions("px", "py")
        .select("x", "y", "n")
    )
    parts = placed.mapInPandas(
        _tile_sums(box.min_x, box.min_y, cols, lines, resolution, tiles, reach),
        "bandwidth double, ix long, iy long, part double",
    )
    widths = F.explode(F.array(*[F.lit(b) for b in tiles]))
    empty = points.sparkSession.range(cols * lines).select(
        widths.alias("bandwidth"), (F.col("id") % cols).alias("ix"),
        F.floor(F.col("id") / cols).alias("iy"), F.lit(0.0).alias("part"),
    )
    sums = parts.unionByName(empty).groupBy("bandwidth", "ix", "iy").agg(F.sum("part").alias("s"))
    return sums.select(
        "bandwidth", "ix", "iy",
        (F.lit(box.min_x) + F.col("ix") * resolution).alias("cell_x"),
        (F.lit(box.min_y) + F.col("iy") * resolution).alias("cell_y"),
        (F.col("s") * F.lit(1e6) / (F.lit(2.0 * math.pi) * h * h)).alias("density"),
    )


FAR_TILE = 16  # cells along a box of far cells


def kde_far(
    points, resolution=fixed.KDE_RESOLUTION, bandwidths=tuple(fixed.KDE_BANDWIDTHS),
    margin=fixed.KDE_MARGIN, error=1e-9, reach=REACH,
) -> DataFrame:
    """The cells of ``kde`` with ``log_density``, the natural logarithm of the density, of relative error below ``error``.

    No cell is cut off: the logarithm is finite however far the nearest point, also where the density itself is below
    what a double holds (beyond 38 bandwidths). What ``kde`` leaves out is at most ``exp(-reach ** 2 / 2)`` for each point,
    so cells whose near sum is large against that are settled by it. Every other cell adds up the points whose squared
    distance is at most ``2 h^2 log(points / error)`` above that of its nearest point; the rest of the points weigh less than
    ``error`` of that one. A walk down a tree of the points finds them, so far cells meet the rim of a cluster only.
    """
    grid = kde(points, resolution, bandwidths, margin, reach)
    rest = points.groupBy("x", "y").agg(F.count("*").alias("id"))
    rest = durable(rest.where("x is not null and y is not null"))
    total = rest.agg(F.sum("id")).first()[0]
    if not total:
        return grid.withColumn("log_density", F.lit(None).cast("double"))
    grid, frame, parts = durable(grid), frame_of(rest), []
    for h in map(float, bandwidths):
        unit = 1e6 / (2.0 * math.pi * h * h)
        own = grid.where(F.col("bandwidth") == h)
        near = F.col("density") >= total * math.exp(-reach * reach / 2) / error * unit
        parts.append(own.where(near).withColumn("log_density", F.log("density")))
        cells = own.where(~near).withColumnsRenamed({"cell_x": "x", "cell_y": "y"})
        if cells.isEmpty():
            continue
        cells, offered = offers(cells, rest, frame, FAR_TILE * float(resolution), 2.0 * h * h * math.log(total / error))
        offered = durable(offered)
        dx, dy = F.col("x") - F.col("mx"), F.col("y") - F.col("my")
        d2 = dx * dx + dy * dy
        key = ["bx", "by", "ix", "iy"]
        least = cells.join(offered, ["bx", "by"]).groupBy(*key).agg(F.min(d2).alias("least"))
        cells = durable(cells.join(least, key))
        weight = F.col("id") * F.exp((F.col("least") - d2) / (2.0 * h * h))
        sums = cells.join(offered, ["bx", "by"]).groupBy(*key).agg(F.sum(weight).alias("s"))
        logs = F.log("s") - F.col("least") / (2.0 * h * h) + math.log(unit)
        done = cells.join(sums, key).withColumnsRenamed({"x": "cell_x", "y": "cell_y"}).withColumn("log_density", logs)
        parts.append(done.select(*grid.columns, "log_density"))
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def kde_stats(grid) -> DataFrame:
    """Minimum, maximum, mean and quartiles of the density per bandwidth."""
    plain = grid.groupBy("bandwidth").agg(
        F.min("density").alias("min"), F.max("density").alias("max"), F.avg("density").alias("mean")
    )
    q = exact_quantiles(grid, "density", [0.25, 0.5, 0.75], ["bandwidth"])
    pick = lambda p: F.max(F.when(F.col("prob") == p, F.col("quantile")))
    quartiles = q.groupBy("bandwidth").agg(
        pick(0.25).alias("p25"), pick(0.5).alias("p50"), pick(0.75).alias("p75")
    )
    return plain.join(quartiles, "bandwidth")


def density_at(segments, grid, bandwidth, min_x, min_y, resolution) -> DataFrame:
    """Density of the grid cell nearest to the middle of each segment's end points.

    ``segments`` has id and a geom in degrees; the grid origin is that of ``kde``.
    """
    a, b = F.element_at("geom", 1), F.element_at("geom", -1)
    mx = (mercator_x(a["x"]) + mercator_x(b["x"])) / 2
    my = (mercator_y(a["y"]) + mercator_y(b["y"])) / 2
    cell = lambda m, low: F.round((m - F.lit(low)) / resolution).cast("bigint")
    placed = segments.select(
        F.col("id").alias("segment_id"), cell(mx, min_x).alias("ix"), cell(my, min_y).alias("iy")
    )
    values = grid.where(F.col("bandwidth") == float(bandwidth)).select("ix", "iy", "density")
    found = placed.join(values, ["ix", "iy"], "left")
    return found.select("segment_id", F.coalesce("density", F.lit(0.0)).alias("density"))


def _crossings(a, b):
    """Parameters from 0 to 1 at which the way from ``a`` to ``b`` (in cells) passes a cell border."""
    low, high = F.least(a, b), F.greatest(a, b)
    first, last = F.floor(low) + 1, F.ceil(high) - 1
    borders = F.when(last >= first, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))
    return F.transform(borders, lambda k: (k - a) / (b - a))


def street_cells(segments, min_x, min_y, resolution) -> DataFrame:
    """``segment_id, ix, iy, length``: how long each polyline runs in each grid cell, in the units of the grid.

    ``segments`` has id and a geom in the grid's coordinates. Cells are centred on the grid's nodes, as ``kde`` places
    them; every edge is cut where it passes a border, and a piece belongs to the cell of its middle. A line without
    length is in the cell of its first vertex, with length 0; a line without vertices in none.
    """
    u = lambda v, low: (v - F.lit(float(low))) / F.lit(float(resolution)) + 0.5
    at = lambda i: F.get("geom", i)
    ends = F.transform(
        F.when(F.size("geom") > 1, F.sequence(F.lit(0), F.size("geom") - 2)).otherwise(F.when(F.size("geom") == 1, F.array(F.lit(0)))),
        lambda i: F.struct(at(i).alias("a"), F.coalesce(at(i + 1), at(i)).alias("b")),
    )
    edges = segments.select(F.col("id").alias("segment_id"), F.explode(ends).alias("e")).select(
        "segment_id", u(F.col("e.a.x"), min_x).alias("ax"), u(F.col("e.a.y"), min_y).alias("ay"),
        u(F.col("e.b.x"), min_x).alias("bx"), u(F.col("e.b.y"), min_y).alias("by"),
    )
    cuts = F.array_sort(F.concat(
        F.array(F.lit(0.0), F.lit(1.0)), _crossings(F.col("ax"), F.col("bx")), _crossings(F.col("ay"), F.col("by"))
    ))
    pieces = edges.withColumn("_cuts", cuts).withColumn("_k", F.explode(F.sequence(F.lit(0), F.size("_cuts") - 2)))
    t1, t2 = F.get("_cuts", F.col("_k")), F.get("_cuts", F.col("_k") + 1)
    dx, dy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    middle = (t1 + t2) / 2
    return pieces.select(
        "segment_id", F.floor(F.col("ax") + middle * dx).alias("ix"), F.floor(F.col("ay") + middle * dy).alias("iy"),
        ((t2 - t1) * F.sqrt(dx * dx + dy * dy) * F.lit(float(resolution))).alias("length"),
    ).groupBy("segment_id", "ix", "iy").agg(F.sum("length").alias("length"))


def street_density(segments, grid, bandwidth, min_x, min_y, resolution) -> DataFrame:
    """``segment_id, density``: mean density along each polyline, cells weighted by the length that runs in them.

    A line without length has the density of its cell; cells outside of the grid count as 0. Only ids, cells and
    lengths meet the grid.
    """
    values = grid.where(F.col("bandwidth") == float(bandwidth)).select("ix", "iy", "density")
    met = street_cells(segments, min_x, min_y, resolution).join(values, ["ix", "iy"], "left")
    dense = F.coalesce("density", F.lit(0.0))
    return met.groupBy("segment_id").agg(
        F.when(F.sum("length") > 0, F.sum(F.col("length") * dense) / F.sum("length")).otherwise(F.max(dense)).alias("density")
    )
