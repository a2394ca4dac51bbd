"""Nearest neighbours by collision counting: query-centred windows over sorted single projections.

Largest inner products are turned into least distances by one more coordinate (sqrt(M^2 - |x|^2), 0 for queries),
which tells distances well only among vectors of like length. So a block is cut into classes of falling length, each
no shorter than a share of its longest vector ``M``. A class of some size keeps one sorted array per random direction.
A query opens a window around its own projection in each array and widens all of them by a factor, level by level,
which re-uses the same arrays (virtual rehashing). Vectors inside enough windows are verified with their exact inner
product, those inside most windows first, until a share of the class has been. Small classes are verified whole. The
search ends before a class whose ``M |q|`` is below the ``k``-th product found.

Vectors are dealt into blocks and queries into groups, both of bounded size; every group meets every block once,
and only ``k`` rows of each meeting go on. All vectors are indexed.
"""

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from comarca.llm.frames import with_text

BLOCK = 16_384
GROUP = 1_024
PROJECTIONS = 64  # at least; whole orthonormal bases are taken, which tell distances apart with the least error
#: Half widths of windows, in standard deviations of a class's projections: ``WIDTH * FACTOR ** level``.
WIDTH, FACTOR = 0.25, 1.15
#: A vector inside at least this share of the windows may be verified; ``k + EXTRA * class`` vectors are.
SHARE, EXTRA = 0.8, 0.1
RATIO = 0.95  # shortest to longest vector of a class
SMALL = 1_024  # classes of fewer vectors are verified whole


class Projections:
    """Sorted projections of one class: the place of every vector in the order of every direction."""

    def __init__(self, vectors, norms, projections=PROJECTIONS, seed=11):
        top = norms.max()
        # scaled, so that lengths do not matter to the windows
        more = np.sqrt(np.maximum(top**2 - norms**2, 0))
        size = vectors.shape[1] + 1
        rng = np.random.default_rng(seed)
        bases = [np.linalg.qr(rng.normal(size=(size, size)))[0] for _ in range(-(-projections // size))]
        self.directions = np.concatenate(bases, 1)[:, : max(projections, size)]
        placed = (np.column_stack((vectors, more)) / top @ self.directions).T
        order = np.argsort(placed, 1, kind="stable")
        self.sorted = np.take_along_axis(placed, order, 1)
        self.place = np.empty(order.shape, np.uint16 if len(vectors) < 1 << 16 else np.uint32)
        np.put_along_axis(self.place, order, np.arange(len(vectors), dtype=self.place.dtype)[None], 1)
        self.spread = placed.std() or 1.0

    def collisions(self, centre, half):
        """In how many of the windows around ``centre`` each vector lies."""
        kind = self.place.dtype
        first = np.array([np.searchsorted(s, c) for s, c in zip(self.sorted, centre - half)])
        last = np.array([np.searchsorted(s, c, "right") for s, c in zip(self.sorted, centre + half)])
        first, size = first.astype(kind)[:, None], np.minimum(last - first, np.iinfo(kind).max).astype(kind)[:, None]
        # one comparison of unsigned numbers: places before the window wrap around
        return _added(((self.place - first) < size).view(np.uint8))

    def first_level(self, queries, wanted, **levels):
        """The lowest level that is enough for one of a few queries."""
        return min((self._level(q, wanted, 0, **levels)[1] for q in queries), default=0)

    def _level(self, query, wanted, level, width=WIDTH, factor=FACTOR, share=SHARE):
        need = max(1, math.ceil(share * len(self.sorted)))
        # a query's length does not change which products are largest
        centre = query / math.sqrt(query @ query) @ self.directions[:-1]
        while True:
            counts = self.collisions(centre, width * factor**level * self.spread)
            if (counts >= need).sum() >= wanted:
                return counts, level, need
            level += 1

    def candidates(self, query, wanted, level=0, **levels):
        """``wanted`` vectors, by collisions at the first level from ``level`` on at which so many pass the threshold.

        Those inside most windows come first; of equal counts all come in.
        """
        counts, _, need = self._level(query, wanted, level, **levels)
        have = np.cumsum(np.bincount(counts, minlength=len(self.sorted) + 1)[::-1])
        least = len(self.sorted) - int(np.searchsorted(have, wanted))
        return np.flatnonzero(counts >= max(least, need))


def _added(flags):
    """Column sums of 0 and 1; up to 255 rows are added up in bytes."""
    total = np.zeros(flags.shape[1], np.uint16)
    for at in range(0, len(flags), 255):
        total += np.add.reduce(flags[at : at + 255], 0, dtype=np.uint8)
    return total


class Index:
    """Vectors of one block in classes of falling length."""

    def __init__(self, vectors, extra=EXTRA, ratio=RATIO, small=SMALL, projections=PROJECTIONS, **levels):
        self.extra, self.levels = extra, levels
        norms = np.sqrt((vectors**2).sum(1))
        order = np.argsort(-norms, kind="stable")
        self.classes, at = [], 0
        while at < len(order):
            top = norms[order[at]]
            end = at + int(np.searchsorted(-norms[order[at:]], -ratio * top, "right"))
            end = max(end, at + 1)
            rows = order[at:end]
            own = np.ascontiguousarray(vectors[rows])
            lines = Projections(own, norms[rows], projections) if len(rows) >= small else None
            wanted = self._wanted(len(rows), 0)
            start = lines.first_level(own[:: max(1, len(own) // 5)], wanted, **levels) if lines else 0
            self.classes.append((float(top), rows, own, lines, start))
            at = end

    def _wanted(self, rows, k):
        # one more than k, since a query can find itself
        return min(rows, k + 1 + math.ceil(self.extra * rows))

    def search(self, query, k, skip=None):
        """Rows and products of the ``k`` best found, without the rows of ``skip`` (a mask); ties stay in.

        Also the number of vectors that were verified.
        """
        length, rows, products, seen = math.sqrt(query @ query), [], [], 0
        kth = -math.inf
        for top, own, vectors, lines, start in self.classes:
            # the bound allows for the rounding of products
            if top * length * (1 + 1e-12) < kth:
                break
            if lines is not None:
                found = lines.candidates(query, self._wanted(len(own), k), start, **self.levels)
                own, vectors = own[found], vectors[found]
            seen += len(own)
            got = vectors @ query
            if skip is not None:
                keep = ~skip[own]
                own, got = own[keep], got[keep]
            rows.append(own)
            products.append(got)
            every = np.concatenate(products)
            if len(every) >= k:
                kth = np.partition(every, len(every) - k)[len(every) - k]
                good = every >= kth
                rows, products = [np.concatenate(rows)[good]], [every[good]]
        return np.concatenate(rows), np.concatenate(products), seen


def _usable(vector):
    return (
        vector.isNotNull() & (F.size(vector) > 0)
        & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
        & F.exists(vector, lambda x: x != 0)
    )


def nearest(vectors: DataFrame, k=20, every=20, block=BLOCK, group=GROUP, **search) -> DataFrame:
    """``query_id, rank, vec_id, score`` from ``vectors(vec_id, embedding)``: the ``k`` largest inner products found.

    Queries are the rows whose ``vec_id`` is divisible by ``every``; a query's candidates are all other rows with as
    many components. Rows with a null ``vec_id``, with null, empty or zero vectors and with null or non-finite
    components take no part. Rows of equal ``vec_id`` count once (the smallest vector). Ties go to the smaller id.
    A query meets fewer than ``k`` rows only where there are fewer.
    """
    rows = with_text(vectors, "vec_id", "embedding").where(F.col("vec_id").isNotNull())
    rows = rows.select("vec_id", F.col("embedding").cast("array<double>").alias("v")).where(_usable(F.col("v")))
    # rows of one id shrink inside tasks, so none of them crowd a block
    rows = rows.groupBy("vec_id").agg(F.min("v").alias("v"))
    count = vectors.count()
    blocks, groups = max(1, -(-count // block)), max(1, -(-count // every // group))

    def dealt(pieces, salt):
        return F.pmod(F.xxhash64("vec_id", F.lit(salt)), F.lit(pieces)).cast("int")

    def all_of(pieces):
        return F.explode(F.sequence(F.lit(0), F.lit(pieces - 1)))

    own = rows.withColumn("b", dealt(blocks, 1)).withColumn("g", all_of(groups)).withColumn("d", F.size("v"))
    asked = rows.where(F.col("vec_id") % every == 0).withColumn("g", dealt(groups, 2))
    asked = asked.withColumn("b", all_of(blocks)).withColumn("d", F.size("v"))

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        parts = []
        if len(left) and len(right):
            left = left.sort_values("vec_id")
            ids, index = left["vec_id"].to_numpy(), Index(np.stack(left["v"].to_numpy()), **search)
            for q, vector in zip(right["vec_id"].to_numpy(), right["v"]):
                found, score, _ = index.search(np.asarray(vector), k, ids == q)
                best = np.lexsort((ids[found], -score))[:k]
                parts.append(pd.DataFrame({"query_id": q, "vec_id": ids[found[best]], "score": score[best]}))
        return pd.concat(parts) if parts else pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64"})

    keys = ["b", "g", "d"]
    met = own.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInPandas(
        meet, "query_id long, vec_id long, score double"
    )
    # at most k rows of each block
    ranked = met.groupBy("query_id").agg(
        F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id"))), 1, k).alias("best")
    )
    return ranked.select("query_id", F.posexplode("best").alias("i", "x")).select(
        "query_id", (F.col("i") + 1).alias("rank"), F.col("x.vec_id").alias("vec_id"), (-F.col("x.s")).alias("score")
    )
