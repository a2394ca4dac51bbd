"""Embedding whitening by QDWH spectral divide-and-conquer.

The orthogonal polar factor of a shifted covariance ``V - s I`` has eigenvalues 1 and -1 for the eigenvectors of ``V``
above and below the shift, so ``(U + I) / 2`` projects on the upper invariant subspace. Dynamically weighted Halley
steps find it with QR and multiplications only. The two subspaces are split again until they hold one component, or
components of one eigenvalue, and the basis found whitens all vectors inside tasks.

Sums over the vectors are made by Spark; only the count, the sums and the covariance (``d`` times ``d`` numbers for
``d`` dimensions, whatever the number of rows) reach the driver.
"""

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from comarca.llm.frames import with_text

COMPONENTS = 32
SCALE, OFFSET = 64, 1_000_000
LARGEST = 2.0**56  # |64 c| beyond it is no finite entry of a long
SEED = 5
_EPS = np.finfo(float).eps


# --- the decomposition ------------------------------------------------------------------------------------------------


def polar(matrix: np.ndarray, most_steps=60) -> np.ndarray:
    """Orthogonal polar factor of a symmetric matrix by dynamically weighted Halley steps in their QR form.

    A matrix close to singular takes more steps; the directions of its null space come out as neither 1 nor -1.
    """
    d = len(matrix)
    x = matrix / np.linalg.norm(matrix)  # Frobenius norm, at least the largest singular value
    low = max(1 / (np.linalg.norm(np.linalg.pinv(x)) + 1), _EPS)  # at most the smallest one
    for _ in range(most_steps):
        ratio = low * low
        r = np.cbrt(4 * (1 - ratio) / ratio**2) if ratio < 1 else 0.0
        a = math.sqrt(1 + r) + 0.5 * math.sqrt(8 - 4 * r + 8 * (2 - ratio) / (ratio * math.sqrt(1 + r)))
        b = (a - 1) ** 2 / 4
        c = a + b - 1
        q = np.linalg.qr(np.vstack((math.sqrt(c) * x, np.eye(d))))[0]
        after = b / c * x + (a - b / c) / math.sqrt(c) * q[:d] @ q[d:].T
        after = (after + after.T) / 2
        moved, x = np.linalg.norm(after - x), after
        low = min(low * (a + b * ratio) / (1 + c * ratio), 1.0)
        if moved <= _EPS ** (1 / 3) and 1 - low <= 4 * _EPS:
            break
    return x


def _split(matrix, shift, floor, rng):
    """Orthonormal bases of the invariant subspaces above and below ``shift``, or None where it meets an eigenvalue."""
    d = len(matrix)
    centred = matrix - shift * np.eye(d)
    if np.linalg.norm(centred) <= floor:
        return None
    upper = (polar(centred) + np.eye(d)) / 2
    rank = round(float(np.trace(upper)))
    if not 0 < rank < d:
        return None
    # subspace iteration with the projector: once from random vectors, once to settle
    basis = np.linalg.qr(upper @ rng.normal(size=(d, rank)))[0]
    whole = np.linalg.qr(upper @ basis, mode="complete")[0]
    above, below = whole[:, :rank], whole[:, rank:]
    return (above, below) if np.linalg.norm(below.T @ matrix @ above) <= floor else None


def components_of(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues from the largest down and unit eigenvectors (columns) of a symmetric matrix."""
    matrix = (matrix + matrix.T) / 2
    rng, size = np.random.default_rng(SEED), np.linalg.norm(matrix)
    floor = 8 * len(matrix) * _EPS * size
    values, vectors = np.empty(len(matrix)), np.empty_like(matrix)
    todo, done = [(matrix, np.eye(len(matrix)))], 0
    while todo:
        part, basis = todo.pop()
        middle, d = np.diag(part), len(part)
        rest = part - np.diag(middle)
        split = None
        if d > 1 and np.linalg.norm(rest) + np.ptp(middle) > floor:
            # the median deals evenly; the mean lies strictly between the ends; the others keep off an eigenvalue
            spread = np.linalg.norm(part - middle.mean() * np.eye(d)) / math.sqrt(d)
            tries = [np.median(middle), middle.mean(), *(middle.mean() + spread * t for t in (0.13, -0.17, 0.41, -0.47, 0.71, -0.73))]
            split = next((s for t in tries if (s := _split(part, t, floor, rng))), None)
        if split is None:
            # one component, or several of one eigenvalue to double precision: any basis of theirs will do
            values[done : done + d], vectors[:, done : done + d] = middle, basis
            done += d
            continue
        for side in split:
            inner = side.T @ part @ side
            todo.append(((inner + inner.T) / 2, basis @ side))
    # one step of correction by the residual keeps the columns orthonormal to rounding
    vectors = vectors @ (1.5 * np.eye(len(matrix)) - 0.5 * vectors.T @ vectors)
    values = np.einsum("ij,ij->j", vectors, matrix @ vectors)
    order = np.argsort(-values, kind="stable")
    return values[order], vectors[:, order]


# --- sums over all vectors --------------------------------------------------------------------------------------------


def _usable(v):
    return v.isNotNull() & (F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) * SCALE > LARGEST))


def quantised(vectors: DataFrame) -> tuple[DataFrame, int]:
    """``vec_id, x`` with ``x = floor(64 c) + 1000000`` as longs, and the number of dimensions (0 without rows)."""
    rows = with_text(vectors, "vec_id", "embedding").withColumn("embedding", F.col("embedding").cast("array<double>"))
    rows = rows.where(_usable(F.col("embedding")))
    sizes = rows.groupBy(F.size("embedding").alias("d")).agg(F.count("*").alias("n"))
    top = sizes.agg(F.max(F.struct("n", "d"))["d"]).first()[0] or 0
    x = F.transform("embedding", lambda c: F.floor(c * SCALE).cast("long") + OFFSET)
    return rows.where(F.size("embedding") == top).select("vec_id", x.alias("x")), top


def _matrix(batch, d, name="x"):
    column = batch.column(batch.schema.get_field_index(name))
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _gram(rows: DataFrame, d, width, project) -> tuple[np.ndarray, np.ndarray]:
    """Sums of ``z`` and of ``z z'`` over the rows, for ``z = project(x)`` of ``width`` numbers.

    A task sends ``width + 1`` rows of sums; these meet in a hash aggregate of as many groups.
    """
    def added(batches):
        plain, square = np.zeros(width), np.zeros((width, width))
        for batch in batches:
            if batch.num_rows:
                z = project(_matrix(batch, d))
                plain += z.sum(0)
                square += z.T @ z
        table = np.vstack((square, plain))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(width + 1)), *(pa.array(c) for c in table.T.copy())], ["i", *(f"s{j}" for j in range(width))]
        )

    parts = rows.select("x").mapInArrow(added, "i long, " + ", ".join(f"s{j} double" for j in range(width)))
    table = np.zeros((width + 1, width))
    for row in parts.groupBy("i").agg(*[F.sum(f"s{j}").alias(f"s{j}") for j in range(width)]).collect():  # width + 1 rows
        table[row["i"]] = row[1:]
    return table[-1], table[:-1]


class Whitener:
    """Count, exact sums, components and eigenvalues of a fit list."""

    def __init__(self, n, sums, covariance, components):
        self.n, self.sums = n, sums
        self.mean = np.array([s / n for s in sums], float)
        values, vectors = components_of(covariance)
        trace = float(np.trace(covariance))
        # an eigenvalue that is rounding error has no scale to be divided by
        rank = int((values > len(values) * 64 * _EPS * max(values[0], 0)).sum())
        self.size = min(components, rank)
        self.values, self.vectors = values[: self.size], vectors[:, : self.size]
        self.explained = self.values / trace if trace > 0 else self.values
        self.basis = self.vectors / np.sqrt(self.values)

    def whiten(self, x):
        return (x - self.mean) @ self.basis

    def deviations(self, x):
        """Exact ``sum (n x - S)^2`` of every row; None where a long can't hold it."""
        # as integers near their whole mean, so that int64 is enough wherever the result is
        base = [s // self.n for s in self.sums]
        near = x - np.array(base, np.int64)
        rest = np.array([s - b * self.n for s, b in zip(self.sums, base)], object)
        if self.n * (int(np.abs(near).max(initial=0)) + 1) >= 1 << 62:
            exact = ((self.n * near.astype(object) - rest) ** 2).sum(1)
            return [int(v) if v < 1 << 63 else None for v in exact]
        gap = self.n * near - rest.astype(np.int64)
        about = (gap.astype(float) ** 2).sum(1)
        found = (gap * gap).sum(1).tolist()  # exact wherever the result fits
        for i in np.flatnonzero(about > 2.0**62):
            exact = sum(int(g) ** 2 for g in gap[i])
            found[i] = exact if exact < 1 << 63 else None
        return found


def fit(rows: DataFrame, d, components=COMPONENTS) -> tuple["Whitener", float] | None:
    """Fit on all of ``quantised`` rows, and the largest absolute entry of whitened's covariance minus the identity.

    None without rows. Three passes: count and exact sums, centred products, products of the whitened rows.
    """
    if not d:
        return None
    totals = rows.agg(F.count("*").alias("n"), *[F.sum(F.col("x")[j].cast("decimal(20,0)")).alias(f"s{j}") for j in range(d)]).first()
    n, sums = totals["n"], [int(s) for s in totals[1:]]
    mean = np.array([s / n for s in sums], float)
    off, square = _gram(rows, d, d, lambda x: x - mean)
    off /= n  # what the rounding of the mean left over
    found = Whitener(n, sums, square / n - np.outer(off, off), components)
    error = 0.0
    if found.size:
        mean, basis = found.mean, found.basis
        off, square = _gram(rows, d, found.size, lambda x: (x - mean) @ basis)
        off /= n
        error = float(np.abs(square / n - np.outer(off, off) - np.eye(found.size)).max())
    return found, error


SCHEMA = "vec_id long, n long, deviation long, whitened array<double>"


def whiten(rows: DataFrame, d, fitted: Whitener) -> DataFrame:
    """``SCHEMA`` of every quantised row: one array of whitened components a row."""
    shared = rows.sparkSession.sparkContext.broadcast(vars(fitted))  # plain arrays, d * (d + components) numbers

    def run(batches):
        w = Whitener.__new__(Whitener)
        vars(w).update(shared.value)
        for batch in batches:
            x = _matrix(batch, d)
            flat = w.whiten(x)
            lists = pa.FixedSizeListArray.from_arrays(pa.array(flat.ravel()), max(w.size, 1)) if w.size else pa.array([[]] * len(x), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), pa.array(np.full(len(x), w.n)), pa.array(w.deviations(x), pa.int64()), lists.cast(pa.list_(pa.float64()))],
                ["vec_id", "n", "deviation", "whitened"],
            )

    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), "x").mapInArrow(run, SCHEMA)


def whiten_report(vectors: DataFrame, components=COMPONENTS) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error`` of ``vectors(vec_id, embedding)``.

    Rows with a null or empty vector and with null or non-finite components take no part, nor do vectors of another
    length than most have (of equally frequent lengths the longest counts). Rows with a null or repeated ``vec_id`` are
    rows like others, and equal vectors count as often as they occur. Components whose eigenvalue is zero within
    rounding can't be scaled and are left out, so a table of one vector has no rows; nor has an empty table.
    """
    rows, d = quantised(vectors)
    fitted = fit(rows, d, components)
    if fitted is None or not fitted[0].size:
        none = F.lit(None).cast("double")
        return with_text(vectors, "vec_id").limit(0).select(
            F.col("vec_id").cast("long").alias("vec_id"), F.lit(0).alias("component"), F.lit(None).cast("long").alias("n"),
            F.lit(None).cast("long").alias("deviation"), none.alias("whitened"), none.alias("explained"), none.alias("identity_error"),
        )
    model, error = fitted
    shares = F.array(*[F.lit(float(e)) for e in model.explained])
    return whiten(rows, d, model).select("vec_id", "n", "deviation", F.posexplode("whitened").alias("i", "whitened")).select(
        "vec_id", (F.col("i") + 1).alias("component"), "n", "deviation", "whitened",
        F.element_at(shares, F.col("i") + 1).alias("explained"), F.lit(error).alias("identity_error"),
    )
