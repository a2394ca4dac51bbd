"""Connected components by randomised contraction."""

from pyspark.sql import DataFrame, functions as F

from comarca.scale import HOT_ROWS, hot_keys, skew_join
from comarca.session import durable


def _hot(df, key, count):
    top = df.where(F.col(count) >= HOT_ROWS).orderBy(F.desc(count))
    return [(r[0],) for r in top.select(key).collect()]


def connected_components(edges: DataFrame, src="src", dst="dst", most_rounds=200) -> DataFrame:
    """Smallest node id of the component of every node that has an edge: ``node, component``.

    Each round orders the nodes at random and moves every node to the first one within two steps,
    so stars and chains alike collapse and the graph shrinks by a constant factor and the number of rounds is
    logarithmic whatever its shape. The moves are composed from the last (smallest) round back.
    """
    pairs = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where("a <> b")
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    work = durable(both.distinct())
    moves = []
    for turn in range(most_rounds):
        left = work.count()
        if left == 0:
            break

        def rank(c):
            return F.xxhash64(F.col(c), F.lit(turn))

        first = work.groupBy("a").agg(
            F.min(rank("b")).alias("h"), F.min_by("b", rank("b")).alias("m"), F.count("*").alias("n")
        )
        own = rank("a") <= F.col("h")
        first = first.select(
            "a", "n", F.when(own, F.col("a")).otherwise(F.col("m")).alias("m"), F.least("h", rank("a")).alias("h")
        )
        hot = _hot(first, "a", "n") if left >= HOT_ROWS else []
        around = skew_join(work, first.select(F.col("a").alias("b"), "m", "h"), ["b"], hot=hot)
        move = durable(
            around.groupBy("a").agg(F.min_by("m", "h").alias("to")).withColumnRenamed("a", "node")
        )
        moves.append((move, hot))
        for end in ("a", "b"):
            target = move.select(F.col("node").alias(end), "to")
            work = skew_join(work, target, [end], hot=hot).drop(end).withColumnRenamed("to", end)
        work = durable(work.where("a <> b").select("a", "b").distinct())
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")

    if not moves:
        return edges.select(F.col(src).alias("node"), F.col(src).alias("component")).limit(0)
    labels = moves[-1][0]
    for move, hot in reversed(moves[:-1]):
        later = labels.select(F.col("node").alias("to"), F.col("to").alias("final"))
        if hot:  # within two steps more nodes can share a target than any one had neighbours
            hot = hot_keys(move, ["to"])
        labels = skew_join(move, later, ["to"], how="left", hot=hot).select(
            "node", F.coalesce("final", "to").alias("to")
        )
    labels = durable(labels)
    names = labels.groupBy("to").agg(F.min("node").alias("component"), F.count("*").alias("n"))
    hot = _hot(names, "to", "n") if labels.count() >= HOT_ROWS else []
    return skew_join(labels, names.drop("n"), ["to"], hot=hot).select("node", "component")
