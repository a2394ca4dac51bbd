"""Merge the lines of a route into as few lines as possible.

Lines are joined where exactly two line ends of the route meet. Chains are ordered by pointer
doubling: every directed line learns in log2(length) rounds how far it is from the end of its
chain. Routes of up to ``LOCAL`` vertices are dealt out whole and a task doubles the pointers of
many routes at once; the rounds over larger ones are joins, so no such chain is ever brought into
one task.
"""

import sys

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F

from comarca.functions.geo import line_geometry
from comarca.scale import HOT_ROWS, number_rows, skew_join
from comarca.session import durable, stored

MOST_ROUNDS = 62
LOCAL = 200_000  # vertices of a route, about 100 bytes each in a task

# the task functions travel to the executors by value, so the package need not be installed there
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _tidy(line):
    """Line without repeated vertices."""
    return F.filter(line, lambda v, i: (i == 0) | (v != F.get(line, i - 1)))


def route_lines(segments, route_segments) -> DataFrame:
    """The lines of each route, every segment once, lines without length left out."""
    listed = route_segments.select("route_id", "segment_id").distinct()
    lines = segments.select(F.col("id").alias("segment_id"), _tidy(F.col("geom")).alias("geom"))
    return skew_join(listed, lines.where(F.size("geom") >= 2), ["segment_id"])


def _directed(lines):
    """Both directions of each line as arcs with the arc that follows, if any.

    The forward arc of a segment is twice its number, the backward arc one more.
    """
    base = lines.select(
        "route_id", "segment_id", (F.size("geom") - 1).alias("weight"),
        F.element_at("geom", 1).alias("first"), F.element_at("geom", -1).alias("last"),
    )
    # an end is the arc that leaves by it: forward from the first vertex, backward from the last
    ends = base.select(
        "route_id", "weight",
        F.explode(
            F.array(
                F.struct(F.col("first").alias("v"), (F.col("segment_id") * 2).alias("end")),
                F.struct(F.col("last").alias("v"), (F.col("segment_id") * 2 + 1).alias("end")),
            )
        ).alias("e"),
    ).select("route_id", "weight", "e.v.x", "e.v.y", "e.end")
    met = (
        ends.groupBy("route_id", "x", "y")
        .agg(
            F.count("*").alias("degree"), F.min("end").alias("p"), F.max("end").alias("q"),
            F.min_by("weight", "end").alias("wp"), F.max_by("weight", "end").alias("wq"),
        )
        .where("degree = 2")
    )
    # who arrives by one end leaves by the other; arriving is the reverse of leaving
    follow = met.select(
        "route_id",
        F.explode(
            F.array(
                F.struct(F.expr("p ^ 1L").alias("arc"), F.col("q").alias("next"), F.col("wq").alias("w")),
                F.struct(F.expr("q ^ 1L").alias("arc"), F.col("p").alias("next"), F.col("wp").alias("w")),
            )
        ).alias("f"),
    ).select("route_id", "f.arc", "f.next", F.col("f.w").alias("next_weight"))
    arcs = base.select(
        "route_id", "weight",
        F.explode(F.array(F.col("segment_id") * 2, F.col("segment_id") * 2 + 1)).alias("arc"),
    )
    return arcs.join(follow, ["route_id", "arc"], "left")


PLACED = ["route_id", "arc", "weight", "to", "hops", "ahead", "forwards"]


def _rank(arcs):
    """Place of every arc in its chain, and the arcs of closed rings, which have no end.

    ``to`` is the last arc of the chain; ``hops``, ``ahead`` and ``forwards`` count the arcs,
    edges and forward arcs that come after. Finished arcs are never written again: each round
    writes only the arcs that still have to jump.
    """
    started = arcs.select(
        "route_id", "arc", "weight", F.coalesce("next", "arc").alias("to"),
        F.when(F.col("next").isNull(), 0).otherwise(1).cast("bigint").alias("hops"),
        F.coalesce("next_weight", F.lit(0)).cast("bigint").alias("ahead"),
        F.coalesce(1 - F.expr("next & 1L"), F.lit(0)).cast("bigint").alias("forwards"),
        F.col("next").isNull().alias("done"),
    )
    state = durable(started)
    finished, active = state.where("done"), state.where("not done")
    left = None
    for _ in range(MOST_ROUNDS):
        now = active.count()
        if now == 0 or now == left:
            return finished.select(*PLACED), active.select("route_id", "arc")
        left = now
        jump = finished.unionByName(active).select(
            "route_id", F.col("arc").alias("to"), F.col("to").alias("to2"), F.col("hops").alias("hops2"),
            F.col("ahead").alias("ahead2"), F.col("forwards").alias("forwards2"), F.col("done").alias("done2"),
        )
        moved = durable(
            active.join(jump, ["route_id", "to"]).select(
                "route_id", "arc", "weight", F.col("to2").alias("to"),
                (F.col("hops") + F.col("hops2")).alias("hops"),
                (F.col("ahead") + F.col("ahead2")).alias("ahead"),
                (F.col("forwards") + F.col("forwards2")).alias("forwards"), F.col("done2").alias("done"),
            )
        )
        finished, active = finished.unionByName(moved.where("done")), moved.where("not done")
    raise RuntimeError("chains did not settle")


def _open_rings(arcs, tails):
    """Cut each ring before the arc that leaves its smallest node.

    ``tails`` gives the node each arc leaves from.
    """
    state = durable(
        arcs.join(tails, ["route_id", "arc"]).select(
            "route_id", "arc", F.col("next").alias("to"), F.struct("x", "y", "arc").alias("low")
        )
    )
    for _ in range(MOST_ROUNDS):
        jump = state.select("route_id", F.col("arc").alias("to"), F.col("to").alias("to2"), F.col("low").alias("low2"))
        state = durable(
            state.join(jump, ["route_id", "to"]).select(
                "route_id", "arc", F.col("to2").alias("to"), F.least("low", "low2").alias("low"),
                (F.col("low2") < F.col("low")).alias("changed"),
            )
        )
        if state.where("changed").isEmpty():
            break
        state = state.drop("changed")
    else:
        raise RuntimeError("rings did not settle")
    lows = state.select("route_id", "arc", F.col("low.arc").alias("start"))
    cut = F.col("next") == F.col("start")
    return arcs.join(lows, ["route_id", "arc"]).withColumns(
        {"next": F.when(~cut, F.col("next")), "next_weight": F.when(~cut, F.col("next_weight"))}
    ).drop("start")


def _ordered(column):
    """Two arrays that order coordinates as Spark does, nulls first and NaN last."""
    return np.asarray(column.is_valid()), np.asarray(column.fill_null(0.0)) + 0.0


def _same(values):
    """Whether each element but the first equals the one before, NaN also."""
    return (values[1:] == values[:-1]) | ((values[1:] != values[1:]) & (values[:-1] != values[:-1]))


def _jumps(follow, ahead, forwards, rounds):
    """Pointer doubling over arcs: the last arc, and hops, edges and forward arcs that come after."""
    some = follow >= 0
    to = np.where(some, follow, np.arange(len(follow)))
    hops, ahead, forwards = (np.where(some, v, 0) for v in (np.ones(len(to), np.int64), ahead[to], forwards[to]))
    for _ in range(rounds):
        hops, ahead, forwards, to = hops + hops[to], ahead + ahead[to], forwards + forwards[to], to[to]
    return to, hops, ahead, forwards


def _merge_whole(rows):
    """Vertices of the merged lines of whole routes, rows ordered by route and segment; steps and ties as in ``_merge_far``."""
    geom, n = rows["geom"], rows.num_rows
    begin = np.asarray(geom.offsets)[: n + 1].astype(np.int64)
    x, y = geom.values.flatten()
    begin, x, y = begin - begin[0], x.slice(begin[0], begin[-1] - begin[0]), y.slice(begin[0], begin[-1] - begin[0])
    # arcs and ends by number: forward twice the row, backward one more; an end is the arc that leaves by it
    arcs = np.arange(2 * n)
    edges = np.repeat(np.diff(begin) - 1, 2)
    tail = np.column_stack([begin[:-1], begin[1:] - 1]).ravel()
    route = np.repeat(np.asarray(rows["route_id"].dictionary_encode().indices), 2)
    keys = [v[tail] for c in (x, y) for v in _ordered(c)]
    order = np.lexsort((arcs, *reversed(keys), route))
    alike = np.logical_and.reduce([_same(v[order]) for v in (route, *keys)])
    starts = np.flatnonzero(np.r_[True, ~alike])
    pairs = starts[np.diff(np.r_[starts, 2 * n]) == 2]
    p, q = order[pairs], order[pairs + 1]
    follow = np.full(2 * n, -1)
    # who arrives by one end leaves by the other; arriving is the reverse of leaving
    follow[p ^ 1], follow[q ^ 1] = q, p
    rounds = int(2 * np.bincount(route[::2]).max()).bit_length()
    to, *found = _jumps(follow, edges, 1 - arcs % 2, rounds)
    rings = follow[to] >= 0
    if rings.any():
        # cut each ring before the arc that leaves its smallest node
        place = np.empty(2 * n, np.int64)
        place[np.lexsort((arcs, *reversed(keys)))] = arcs
        low, at = place.copy(), np.where(follow >= 0, follow, arcs)
        for _ in range(rounds):
            low, at = np.minimum(low, low[at]), at[at]
        follow = np.where(rings & (place[follow] == low), -1, follow)
        to, *found = _jumps(follow, edges, 1 - arcs % 2, rounds)
    hops, ahead, forwards = found
    count, first, least = np.zeros(2 * n, np.int64), np.zeros(2 * n, np.int64), np.full(2 * n, n)
    np.maximum.at(count, to, hops + 1)
    leads = count[to] == hops + 1
    first[to[leads]] = arcs[leads]
    np.minimum.at(least, to, arcs // 2)
    # the other direction starts with the reverse of the last arc
    forward = (forwards[first] + 1 - first % 2) * 2
    kept = (count > 0) & ((forward > count) | ((forward == count) & (first < arcs ^ 1)))
    chosen = arcs[kept[to]]
    chosen = chosen[np.lexsort((-hops[chosen], to[chosen]))]
    last, lead = to[chosen], leads[chosen]
    length = ahead[first[last]] + edges[first[last]]
    start = length - ahead[chosen] - edges[chosen]
    sizes = edges[chosen] + lead
    row = np.repeat(np.arange(len(chosen)), sizes)
    j = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + ~lead[row]
    vertex = tail[chosen][row] + np.where(chosen[row] % 2 == 1, -j, j)
    line = least[last][row]
    return pa.RecordBatch.from_arrays(
        [rows["route_id"].take(line), rows["segment_id"].take(line), pa.array(start[row] + j), x.take(vertex), y.take(vertex)],
        ["route_id", "line_id", "pos", "x", "y"],
    )


def _merge_near(lines):
    """``merge_lines`` for routes that a task can hold."""

    def merge(table):
        return _merge_whole(table.combine_chunks().to_batches()[0])

    def run(batches):
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            met = pa.Table.from_batches([batch])
            table = pa.concat_tables([held, met]) if held else met
            # a route may go on in the next batch
            open_ = pc.index(table["route_id"], table["route_id"][-1]).as_py()
            if open_:
                yield merge(table.slice(0, open_))
            held = table.slice(open_)
        if held:
            yield merge(held)

    types = {f.name: f.dataType.simpleString() for f in lines.schema}
    v = lines.schema["geom"].dataType.elementType
    schema = (
        f"route_id {types['route_id']}, line_id {types['segment_id']}, pos long, "
        f"x {v['x'].dataType.simpleString()}, y {v['y'].dataType.simpleString()}"
    )
    dealt = lines.select("route_id", "segment_id", "geom").repartition("route_id").sortWithinPartitions("route_id", "segment_id")
    return dealt.mapInArrow(run, schema)


def merge_lines(lines) -> DataFrame:
    """Vertices of the merged lines: ``route_id, line_id, pos, x, y``.

    ``lines`` has route_id, segment_id (long) and geom; it is read twice. A line is named by its smallest segment
    id and runs in the direction of most of its segments.
    """
    lines = lines.where("route_id is not null and segment_id is not null")
    sizes = lines.groupBy("route_id").agg(F.sum(F.size("geom")).alias("n"))
    large = durable(sizes.where(F.col("n") > LOCAL).select("route_id"))  # a row per LOCAL vertices at most
    if large.isEmpty():
        return _merge_near(lines)
    near = _merge_near(lines.join(F.broadcast(large), "route_id", "left_anti"))
    return near.unionByName(_merge_far(lines.join(F.broadcast(large), "route_id", "left_semi")))


def _merge_far(lines):
    """``merge_lines`` for routes of any size."""
    lines = durable(lines)
    # ids may take all 64 bits, so segments are numbered in the order of their ids
    numbers = number_rows(lines.select("segment_id").distinct(), ["segment_id"], "_n")
    lines = durable(
        lines.join(numbers, "segment_id").select("route_id", F.col("_n").alias("segment_id"), "geom")
    )
    arcs = durable(_directed(lines))
    placed, rings = _rank(arcs)
    if not rings.isEmpty():
        tail = F.when(F.expr("arc & 1L") == 0, F.element_at("geom", 1)).otherwise(F.element_at("geom", -1))
        tails = (
            rings.withColumn("segment_id", F.shiftright("arc", 1))
            .join(lines, ["route_id", "segment_id"])
            .select("route_id", "arc", tail["x"].alias("x"), tail["y"].alias("y"))
        )
        opened = _open_rings(durable(arcs.join(rings, ["route_id", "arc"])), tails)
        placed = placed.unionByName(_rank(opened)[0])

    lists = placed.groupBy("route_id", "to").agg(
        (F.max("hops") + 1).alias("arcs"), F.max_by("arc", "hops").alias("first_arc"),
        F.max_by("forwards", "hops").alias("forwards"), F.max(F.col("ahead") + F.col("weight")).alias("length"),
        F.min(F.shiftright("arc", 1)).alias("line_id"),
    )
    # the other direction starts with the reverse of the last arc
    forward = (F.col("forwards") + 1 - F.expr("first_arc & 1L")) * 2
    tie = F.col("first_arc") < F.expr("to ^ 1L")
    kept = durable(
        lists.where((forward > F.col("arcs")) | ((forward == F.col("arcs")) & tie)).select(
            "route_id", "to", "line_id", "length", "first_arc", "arcs"
        )
    )
    named = numbers.select(F.col("_n").alias("line_id"), F.col("segment_id").alias("_name"))
    # the lengths of the chains are known, so the hot ones need no count of their own
    long = kept.where(F.col("arcs") >= HOT_ROWS).orderBy(F.desc("arcs"))
    ordered = skew_join(
        placed.select("route_id", "arc", "to", "ahead", "weight"),
        kept.drop("arcs").join(named, "line_id").drop("line_id").withColumnRenamed("_name", "line_id"),
        ["route_id", "to"], hot=[(r.route_id, r.to) for r in long.collect()],
    )
    path = F.when(F.expr("arc & 1L") == 1, F.reverse("geom")).otherwise(F.col("geom"))
    return (
        ordered.withColumn("segment_id", F.shiftright("arc", 1))
        .join(lines, ["route_id", "segment_id"])
        .withColumn("start", F.col("length") - F.col("ahead") - F.col("weight"))
        .select("route_id", "line_id", "start", (F.col("arc") == F.col("first_arc")).alias("leads"),
                F.posexplode(path).alias("j", "v"))
        .where("leads or j > 0")
        .select("route_id", "line_id", (F.col("start") + F.col("j")).alias("pos"), "v.x", "v.y")
    )


def route_vertices(segments, route_segments) -> DataFrame:
    """Merged lines of many routes in long form, one row per vertex."""
    return merge_lines(stored(route_lines(segments, route_segments)))


def build_routes(segments, routes, route_segments, most_vertices=1_000_000) -> DataFrame:
    """Routes with their multi-line geometry; routes without a known segment give no row.

    A geometry is one value, so the largest route is checked first; take ``route_vertices`` for
    routes beyond ``most_vertices``.
    """
    vertices = stored(route_vertices(segments, route_segments))
    sizes = vertices.groupBy("route_id").agg(F.count("*").alias("n"))
    largest = sizes.agg(F.max("n")).first()[0]
    if largest and largest > most_vertices:
        raise ValueError(f"a route has {largest} vertices: use route_vertices")
    lines = vertices.groupBy("route_id", "line_id").agg(
        F.array_sort(F.collect_list(F.struct("pos", "x", "y"))).alias("vs")
    )
    lines = lines.select(
        "route_id", "line_id",
        F.transform("vs", lambda v: F.struct(v["x"].alias("x"), v["y"].alias("y"))).alias("line"),
    )
    whole = lines.groupBy("route_id").agg(
        F.array_sort(F.collect_list(F.struct("line_id", "line"))).alias("ls")
    )
    return routes.join(
        whole.select("route_id", F.transform("ls", lambda s: s["line"]).alias("geom")), "route_id"
    )


def route_geometry(geom):
    """GeoJSON text of a route: a LineString for one line, else a MultiLineString."""
    lines = F.transform(geom, lambda g: line_geometry(g)["coordinates"])
    several = F.struct(F.lit("MultiLineString").alias("type"), lines.alias("coordinates"))
    return F.when(F.size(geom) == 1, F.to_json(line_geometry(F.get(geom, F.lit(0))))).otherwise(
        F.to_json(several)
    )
