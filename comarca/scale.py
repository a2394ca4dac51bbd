"""Helpers that keep one hot key, or one global order, from landing in a single task."""

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from comarca.session import durable

HOT_ROWS = 1_000_000  # a key below this many rows never needs splitting


def hot_keys(df: DataFrame, keys, min_rows=HOT_ROWS):
    """All keys with at least ``min_rows`` rows, largest first: at most one for so many rows of ``df``."""
    top = df.groupBy(*keys).count().where(F.col("count") >= min_rows).orderBy(F.desc("count")).collect()
    return [tuple(r[k] for k in keys) for r in top]


def skew_join(left, right, keys, how="inner", min_rows=None, salts=64, hot=None):
    """Join on ``keys`` where some keys may dominate ``left``.

    By default this is the plain join, whose skewed partitions adaptive execution splits from the sizes it sees
    while it runs, without a counting pass. With ``hot`` (or ``min_rows``, which counts the keys first), the rows of hot keys are spread over
    ``salts`` sub-keys and only the matching rows of ``right`` are repeated, so every pair is
    still produced exactly once. Works for inner, left, left_semi and left_anti.
    """
    if hot is None and min_rows is not None:
        hot = hot_keys(left, keys, min_rows)
    if not hot:
        return left.join(right, keys, how)
    schema = left.select(*keys).schema
    listed = left.sparkSession.createDataFrame(hot, schema).withColumn("_hot", F.lit(True))
    spread = F.pmod(F.xxhash64(*left.columns) + F.spark_partition_id(), F.lit(salts)).cast("int")
    none = F.array(F.lit(0))
    every = F.sequence(F.lit(0), F.lit(salts - 1))
    marked_left = _mark(left, listed, keys).withColumn(
        "_salt", F.when(F.col("_hot"), spread).otherwise(F.lit(0))
    )
    marked_right = _mark(right, listed, keys).withColumn(
        "_salt", F.explode(F.when(F.col("_hot"), every).otherwise(none))
    )
    joined = marked_left.drop("_hot").join(marked_right.drop("_hot"), [*keys, "_salt"], how)
    return joined.drop("_salt")


def _mark(df, listed, keys):
    names = {k: f"_hot_{k}" for k in keys}
    renamed = listed.withColumnsRenamed(names)
    same = reduce(lambda a, b: a & b, [df[k].eqNullSafe(renamed[names[k]]) for k in keys])
    # at most one row per HOT_ROWS rows of the larger side, see hot_keys
    return df.join(F.broadcast(renamed), same, "left").drop(*names.values())


def pieces_for(df):
    return max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))


def quantile_bounds(df, value, pieces=None):
    """Cut points that split the rows of ``df`` into about equal ranges of ``value``."""
    pieces = pieces or pieces_for(df)
    probs = [i / pieces for i in range(1, pieces)]
    cuts = df.agg(F.percentile_approx(value, probs, F.lit(max(10_000, 10 * pieces)))).first()[0]
    return sorted(set(cuts or []))


def range_piece(value: Column, cuts) -> Column:
    """Index of the range that ``value`` falls in: the number of cuts at or below it.

    A binary search over one array, so thousands of cuts cost a dozen steps and no generated code.
    """
    if not cuts:
        return F.lit(0)
    listed = F.array(*[F.lit(c) for c in cuts])
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(len(cuts).bit_length()))])

    def step(at, size):
        beyond = F.try_element_at(listed, at + size) <= value
        return F.when(F.coalesce(beyond, F.lit(False)), at + size).otherwise(at)

    return F.aggregate(steps, F.lit(0), step)


def running_best(df, keys, order, value, name, pieces=None, ties=()):
    """Add ``name``: the greatest ``value`` among earlier rows (by ``order``) of the same key.

    The running maximum is split at quantiles of ``order``, so a key with any share of the rows
    is worked on in many tasks: rows within a range use a window, earlier ranges arrive as one
    pre-aggregated row per range. ``ties`` settle the order of rows of equal ``order``.
    """
    cuts = quantile_bounds(df, order, pieces)
    cut = df.withColumn("_piece", range_piece(F.col(order), cuts))
    tops = cut.groupBy(*keys, "_piece").agg(F.max(value).alias("_top"))
    before = W.partitionBy(*keys).orderBy("_piece").rowsBetween(W.unboundedPreceding, -1)
    carried = tops.select(*keys, "_piece", F.max("_top").over(before).alias("_carried"))
    inside = (
        W.partitionBy(*keys, "_piece").orderBy(order, *ties).rowsBetween(W.unboundedPreceding, -1)
    )
    return (
        cut.join(carried, [*keys, "_piece"], "left")
        .withColumn(name, F.greatest("_carried", F.max(value).over(inside)))
        .drop("_piece", "_carried")
    )


def number_rows(df, order, name):
    """Add ``name``: the 1-based position of each row in the global order ``order``.

    The sorted rows stay distributed; only one count per sorted partition is put in sequence.
    """
    mixed = F.monotonically_increasing_id()
    placed = durable(df.orderBy(*order).withColumn("_mixed", mixed))
    part = F.shiftright("_mixed", 33)
    sizes = placed.groupBy(part.alias("_part")).count()
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    starts = sizes.select(
        "_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_start")
    )
    inside = F.col("_mixed").bitwiseAND(F.lit((1 << 33) - 1))
    # one row per sort partition, so the broadcast side is bounded by the partition count
    return (
        placed.withColumn("_part", part)
        .join(F.broadcast(starts), "_part")
        .withColumn(name, F.col("_start") + inside + 1)
        .drop("_part", "_mixed", "_start")
    )


def exact_quantiles(df, value, probs, by=(), pieces=None):
    """Exact, linearly interpolated quantiles per group: columns ``by``, ``prob``, ``quantile``.

    Equal values are counted first. The distinct values are then cut into ranges; counts per
    range tell which ranges hold the wanted ranks, and only those are sorted.
    """
    by = list(by)
    counted = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_n"))
    counted = durable(counted)
    cuts = quantile_bounds(counted, value, pieces)
    counted = counted.withColumn("_piece", range_piece(F.col(value), cuts))

    whole = W.partitionBy(*by) if by else W.partitionBy(F.lit(0))
    before = whole.orderBy("_piece").rowsBetween(W.unboundedPreceding, -1)
    ranges = (
        counted.groupBy(*by, "_piece")
        .agg(F.sum("_n").alias("_n"))
        .withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .withColumn("_total", F.sum("_n").over(whole))
    )
    spot = F.col("prob") * (F.col("_total") - 1)
    wanted = (
        ranges.withColumn("prob", F.explode(F.array(*[F.lit(float(p)) for p in probs])))
        .withColumn("_share", spot - F.floor(spot))
        .withColumn("_rank", F.explode(F.array(F.floor(spot), F.ceil(spot))))
        .where("_rank >= _start and _rank < _start + _n")
        .select(*by, "_piece", "prob", "_share", "_rank", "_start", "_total")
        .distinct()
    )
    keys = [*by, "_piece"]
    inside = W.partitionBy(*keys).orderBy(value)
    sorted_rows = (
        counted.join(wanted.select(*keys).distinct(), keys, "left_semi")
        .withColumn("_end", F.sum("_n").over(inside.rowsBetween(W.unboundedPreceding, 0)))
        .withColumn("_begin", F.col("_end") - F.col("_n"))
    )
    local = F.col("_rank") - F.col("_start")
    hits = sorted_rows.join(wanted, keys).where((local >= F.col("_begin")) & (local < F.col("_end")))
    low, high = F.min(value), F.max(value)
    return hits.groupBy(*by, "prob").agg(
        (low + (high - low) * F.first("_share")).alias("quantile")
    )
