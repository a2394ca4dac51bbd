"""Gradient boosted trees: logistic loss, binned features, depth-limited trees.

``fit`` takes arrays, ``fit_frame`` a Spark table of any size: it grows the same trees from histograms that tasks add up.
"""

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

SMALL = 20_000  # rows that one task fits alone
SLICE = 50_000  # cells whose columns are turned at once
PACKED = 64  # cells in a row of the table that is passed over
UNIT = 2.0**24  # gradients are whole numbers of this fraction, so their sums don't depend on how rows are dealt out
AFRESH = 5  # trees after which margins are written down anew
TASK_CELLS = (20_000, 2_000_000)  # rows that are worth a task, and rows that should be the most of one
MOST_TASKS = 64  # each hands on one histogram, or one sketch of each feature
STEPS = 1024  # of a margin's unit, to which calibration rounds down


def fit_frame(rows, width, rounds=40, depth=3, rate=0.3, bins=32, least=5.0, small=SMALL):
    """``fit`` on every row of ``rows(x array<float>, y int)``, ``width`` features each, up to 256 bins.

    Up to ``small`` rows one task calls ``fit`` on them all, which spares a pass for each level of each tree.

    Quantiles are exact up to 10,000 rows and have rows off by at most a ten-thousandth beyond. Rows of the same bins and
    label become one cell with a count. Each level of a tree is one pass over all cells; the driver gets histograms only.
    ``rows`` is read three times, so the caller keeps it.
    """
    size, positive = rows.agg(F.count("y"), F.coalesce(F.sum("y"), F.lit(0))).first()
    if not size:
        return {"start": 0.0, "trees": []}
    share = (positive + 1) / (size + 2)
    start = float(np.log(share / (1 - share)))
    if not 0 < positive < size:
        return {"start": start, "trees": []}
    if size <= small:
        return _alone(rows, rounds, depth, rate, bins, least)
    tasks = min(MOST_TASKS, max(min(-(-size // TASK_CELLS[0]), rows.sparkSession.sparkContext.defaultParallelism), -(-size // TASK_CELLS[1])))
    ranks = [(int(q * (size - 1)) + 0.5) / size for q in np.linspace(0, 1, bins + 1)[1:-1]]
    # few tasks, since each hands on a sketch of every feature
    found = rows.coalesce(tasks).agg(*[F.percentile_approx(F.col("x")[f], ranks, 10_000).alias(f"c{f}") for f in range(width)]).first()
    cuts = [np.unique(np.array(c, np.float32)) for c in found]
    first = cells = _cells(rows, cuts, start, tasks).persist()
    trees, fresh = [], []
    for _ in range(rounds):
        tree = _Tree(depth)
        for level in range(depth):
            sums = _histograms(cells, width, bins, fresh, tree, level)
            if not tree.grow(level, sums, cuts, rate, least):
                break
        trees.append(tree)
        fresh.append(tree)
        if len(fresh) == AFRESH and len(trees) < rounds:
            # from the first cells each time, so that no plan holds the plans of all trees before
            before, cells = cells, _moved(first, width, trees).persist()
            cells.count()
            if before is not first:
                before.unpersist()
            fresh = []
    cells.unpersist()
    first.unpersist()
    return {"start": start, "trees": [t.nested(cuts) for t in trees]}


def fit(x, y, rounds=40, depth=3, rate=0.3, bins=32, least=5.0):
    """Trees as nested lists: ``[feature, cut, low, high]`` (x <= cut goes low) or a leaf value."""
    if not len(y):
        return {"start": 0.0, "trees": []}
    share = (y.sum() + 1) / (len(y) + 2)
    start = float(np.log(share / (1 - share)))
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for c in x.T]
    placed = np.stack([np.searchsorted(c, v, "left") for c, v in zip(cuts, x.T)], 1)
    raw, trees = np.full(len(y), start), []
    for _ in range(rounds if 0 < y.sum() < len(y) else 0):
        p = 1 / (1 + np.exp(-raw))
        tree, value = _grow(placed, cuts, y - p, p * (1 - p), np.arange(len(y)), depth, rate, least)
        trees.append(tree)
        raw[value[0]] += value[1]
    return {"start": start, "trees": trees}


def _grow(placed, cuts, gap, weight, rows, depth, rate, least):
    total, heft = gap[rows].sum(), weight[rows].sum()
    best = (1e-6, None, None)
    for f, c in enumerate(cuts if depth else []):
        g = np.cumsum(np.bincount(placed[rows, f], gap[rows], len(c) + 1))[:-1]
        h = np.cumsum(np.bincount(placed[rows, f], weight[rows], len(c) + 1))[:-1]
        n = np.cumsum(np.bincount(placed[rows, f], minlength=len(c) + 1))[:-1]
        gain = g**2 / (h + 1) + (total - g) ** 2 / (heft - h + 1) - total**2 / (heft + 1)
        gain[(n < least) | (len(rows) - n < least)] = 0
        if len(c) and gain.max() > best[0]:
            best = (gain.max(), f, int(gain.argmax()))
    if best[1] is None:
        leaf = float(rate * total / (heft + 1))
        return leaf, (rows, np.full(len(rows), leaf))
    _, f, k = best
    low = placed[rows, f] <= k
    a, va = _grow(placed, cuts, gap, weight, rows[low], depth - 1, rate, least)
    b, vb = _grow(placed, cuts, gap, weight, rows[~low], depth - 1, rate, least)
    return [f, float(cuts[f][k]), a, b], (np.concatenate((va[0], vb[0])), np.concatenate((va[1], vb[1])))


def predict(model, x):
    return 1 / (1 + np.exp(-margin(model, x)))


def margin(model, x):
    raw = np.full(len(x), model["start"])

    def walk(tree, rows):
        if not isinstance(tree, list):
            raw[rows] += tree
            return
        low = x[rows, tree[0]] <= tree[1]
        walk(tree[2], rows[low])
        walk(tree[3], rows[~low])

    for tree in model["trees"]:
        walk(tree, np.arange(len(x)))
    return raw


def calibrated_cut(scores, y, precision=0.98, n=None):
    """Least score above which at least ``precision`` of the rows are positive; above 1 where there is none.

    With ``n``, each score stands for so many rows, ``y`` of them positive.
    """
    order = np.argsort(-scores, kind="stable")
    s, right = scores[order], np.cumsum(y[order]) / np.cumsum((np.ones(len(y)) if n is None else n)[order])
    last = np.append(s[1:] != s[:-1], True) if len(s) else np.zeros(0, bool)
    good = np.flatnonzero(last & (right >= precision))
    return float(s[good[-1]]) if len(good) else 2.0


def _alone(rows, *settings):
    def run(batches):
        parts = [(b.column("x").flatten().to_numpy().reshape(b.num_rows, -1), b.column("y").to_numpy()) for b in batches if b.num_rows]
        x, y = (np.concatenate(part) for part in zip(*parts))
        order = np.lexsort((y, *x.T))
        model = json.dumps(fit(x[order], y[order].astype(float), *settings))
        yield pa.RecordBatch.from_arrays([pa.array([model])], ["model"])

    return json.loads(rows.select("x", "y").repartition(1).mapInArrow(run, "model string").first()[0])


class _Tree:
    """A full binary tree, root 1, children of ``v`` at ``2v`` and ``2v + 1``. What isn't split sends everything low."""

    def __init__(self, depth):
        self.depth, self.open = depth, {1}
        self.feature, self.bin = np.zeros(2**depth, np.int64), np.full(2**depth, 255, np.int64)
        self.value = np.zeros(2 ** (depth + 1))

    def walk(self, placed, levels):
        """The node of each cell after so many levels; ``placed`` has a row for each feature."""
        node, cell = np.ones(placed.shape[1], np.int64), np.arange(placed.shape[1])
        for _ in range(levels):
            node = 2 * node + (placed[self.feature[node], cell] > self.bin[node])
        return node

    def grow(self, level, sums, cuts, rate, least):
        """Split the open nodes of a level by ``sums[g|h|n, feature, node, bin]``; whether any was."""
        opened = set()
        for node in sorted(self.open):
            g, h, n = sums[:, :, node - 2**level]
            total, heft, count = g[0].sum(), h[0].sum(), n[0].sum()
            best = (1e-6, None, None)
            for f, c in enumerate(cuts):
                a, b, m = (np.cumsum(s[f])[: len(c)] for s in (g, h, n))
                gain = a**2 / (b + 1) + (total - a) ** 2 / (heft - b + 1) - total**2 / (heft + 1)
                gain[(m < least) | (count - m < least)] = 0
                if len(c) and gain.max() > best[0]:
                    best = (gain.max(), f, int(gain.argmax()), a, b)
            if best[1] is None:
                self.close(node, level, rate * total / (heft + 1))
                continue
            _, f, k, a, b = best
            self.feature[node], self.bin[node] = f, k
            opened |= {2 * node, 2 * node + 1}
            if level + 1 == self.depth:
                self.close(2 * node, level + 1, rate * a[k] / (b[k] + 1))
                self.close(2 * node + 1, level + 1, rate * (total - a[k]) / (heft - b[k] + 1))
        self.open = opened
        return bool(opened)

    def close(self, node, level, value):
        self.value[node << (self.depth - level)] = value

    def nested(self, cuts, node=1, level=0):
        if level == self.depth or self.bin[node] == 255:
            return float(self.value[node << (self.depth - level)])
        f, k = int(self.feature[node]), int(self.bin[node])
        return [f, float(cuts[f][k]), self.nested(cuts, 2 * node, level + 1), self.nested(cuts, 2 * node + 1, level + 1)]


def _layout(width):
    return np.dtype([("x", "u1", (width,)), ("y", "u1"), ("n", "<i8"), ("raw", "<f8")])


def _bytes_of(column):
    """All bytes of a binary column without nulls, one value after the other."""
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]


def _binary(data, ends):
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(data)])


def _packed(records):
    ends = np.append(np.arange(0, len(records), PACKED), len(records)) * records.itemsize
    return pa.RecordBatch.from_arrays([_binary(records.tobytes(), ends)], ["cells"])


def _cells(rows, cuts, start, tasks):
    """``cells``: binary, records of binned features, label, count and margin."""
    width = len(cuts)

    def place(batches):
        for batch in batches:
            if batch.num_rows:
                x = batch.column("x").flatten().to_numpy().reshape(-1, width)
                placed = np.stack([np.searchsorted(c, v, "left") for c, v in zip(cuts, x.T)], 1).astype(np.uint8)
                ends = np.arange(batch.num_rows + 1) * width
                yield pa.RecordBatch.from_arrays([_binary(placed.tobytes(), ends), batch.column("y")], ["x", "y"])

    def pack(batches):
        for batch in batches:
            if batch.num_rows:
                records = np.empty(batch.num_rows, _layout(width))
                records["x"] = _bytes_of(batch.column("x")).reshape(-1, width)
                records["y"], records["n"], records["raw"] = batch.column("y").to_numpy(), batch.column("n").to_numpy(), start
                yield _packed(records)

    placed = rows.select("x", "y").mapInArrow(place, "x binary, y int").groupBy("x", "y").agg(F.count("y").alias("n"))
    return placed.mapInArrow(pack, "cells binary").repartition(tasks)


def _margins(records, placed, trees):
    raw = records["raw"].copy()
    for tree in trees:
        raw += tree.value[tree.walk(placed, tree.depth)]
    return raw


def _slices(batches, width):
    for batch in batches:
        if batch.num_rows:
            records = _bytes_of(batch.column(0)).view(_layout(width))
            for at in range(0, len(records), SLICE):
                part = records[at : at + SLICE]
                yield part, np.ascontiguousarray(part["x"].T)


def _moved(cells, width, trees):
    """The cells with the trees added to their margins."""

    def run(batches):
        for part, placed in _slices(batches, width):
            records = part.copy()
            records["raw"] = _margins(part, placed, trees)
            yield _packed(records)

    return cells.mapInArrow(run, "cells binary")


def _histograms(cells, width, bins, trees, tree, level):
    """Sums of gradients, their weights and counts: ``float[3, feature, node of the level, bin]``."""
    nodes = 2**level

    def run(batches):
        total = np.zeros((3, width, nodes * bins))
        for part, placed in _slices(batches, width):
            p, n = 1 / (1 + np.exp(-_margins(part, placed, trees))), part["n"].astype(float)
            weights = np.rint((part["y"] - p) * UNIT) * n, np.rint(p * (1 - p) * UNIT) * n, n
            slot = (tree.walk(placed, level) - nodes) * bins
            for f in range(width):
                at = slot + placed[f]
                for k, w in enumerate(weights):
                    total[k, f] += np.bincount(at, w, nodes * bins)
        yield pa.RecordBatch.from_arrays([pa.array([total.astype(np.int64).tobytes()], pa.binary())], ["sums"])

    total = sum(np.frombuffer(r[0], np.int64) for r in cells.mapInArrow(run, "sums binary").collect())
    return total.reshape(3, width, nodes, bins) / np.array([UNIT, UNIT, 1]).reshape(3, 1, 1, 1)


def calibrated_cuts(rows, model, kinds, precision=0.98):
    """``calibrated_cut`` of the rows of each kind 0, 1, ... in ``rows(x, y)``, whose first feature is the kind.

    Every row counts; margins are rounded down to steps, whose counts are all that the driver gets.
    """

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                x = batch.column("x").flatten().to_numpy().reshape(batch.num_rows, -1)
                keys = np.stack([x[:, 0].astype(np.int64), np.floor(margin(model, x) * STEPS).astype(np.int64)], 1)
                keys, at = np.unique(keys, axis=0, return_inverse=True)
                n, right = np.bincount(at.ravel()), np.bincount(at.ravel(), batch.column("y").to_numpy())
                columns = [*keys.T, n, right.astype(np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["kind", "step", "n", "y"])

    counts = rows.select("x", "y").mapInArrow(run, "kind long, step long, n long, y long").groupBy("kind", "step").sum("n", "y").collect()
    table = np.array([tuple(r) for r in counts], np.int64).reshape(-1, 4)
    cuts = []
    for k in range(kinds):
        _, step, n, y = table[table[:, 0] == k].T
        cuts.append(calibrated_cut(1 / (1 + np.exp(-step / STEPS)), y, precision, n))
    return cuts
