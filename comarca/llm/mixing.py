"""Mixing sources to target weights by Pfair scheduling.

Each source's rows, in pseudo-random order, form blocks. Block j of a source with share w of a phase has release
floor((j-1)/w) and deadline ceil(j/w); each slot goes to the released block of the earliest deadline. So after any
number of slots a source is less than one block from its target. The schedule of integer weights repeats after
their sum, so at most one period per phase is worked out and every block looks up its slot. A phase ends when a source
has no block left; the others go on by their weights, so every row is placed exactly once. Of equal deadlines that of the
source furthest behind over all phases goes first, so that many short phases favour nobody.
"""

from fractions import Fraction
from heapq import heapify, heappop, heappush
from math import gcd, lcm

from pyspark.sql import DataFrame, Window as W, functions as F

from comarca.llm.frames import fresh

BLOCK_ROWS = 16
BUCKET_ROWS = 2_000
PLAN_ROWS = 1_000_000  # a plan of more rows is refused, since it is broadcast
PIECE_SLOTS = 500  # slots of a partition of ordered output, unless that makes more than spark.sql.shuffle.partitions
#: Shares of the production mix; sources not named get ``DEFAULT``.
TARGETS = {"src0": 4, "src1": 3, "src2": 2}
DEFAULT = 1


def one_period(weights: dict, left: dict, behind: dict) -> list:
    """The source of each slot of a period, or up to the last block of a source: earliest deadline first among released blocks.

    ``left`` counts the blocks of each source. Equal deadlines go by ``behind``, largest first, then by name.
    """
    total, slots = sum(weights.values()), []
    done = dict.fromkeys(weights, 0)
    ready, later = [(-(-total // w), -behind[s], str(s), s) for s, w in weights.items()], []
    heapify(ready)
    for t in range(total):
        while later and later[0][0] <= t:
            heappush(ready, heappop(later)[1])
        source = heappop(ready)[-1]
        slots.append(source)
        done[source] += 1
        n, w = done[source], weights[source]
        if n == left[source]:
            break
        if n < w:
            block = (-(-(n + 1) * total // w), -behind[source], str(source), source)
            heappush(later, (n * total // w, block))
    return slots


def phases(blocks: dict, weights: dict, most=PLAN_ROWS):
    """``(source, first block, end block, first slot, weight, period, places)`` of every source in every phase.

    ``blocks`` counts the blocks of each source. ``places`` are the slots of a source within a period, as far as the
    phase reaches. All places together are at most one for each block, and at most one period for each phase.
    """
    left, used, begin = {s: n for s, n in blocks.items() if n}, dict.fromkeys(blocks, 0), 0
    behind, out, size = dict.fromkeys(blocks, 0.0), [], 0
    while left:
        common = gcd(*(weights[s] for s in left))
        shares = {s: weights[s] // common for s in left}
        period, places = sum(shares.values()), {}
        order = one_period(shares, left, behind)
        for t, s in enumerate(order):
            places.setdefault(s, []).append(t)
        stop = len(order)
        if stop == period:
            stop = min((n - 1) // shares[s] * period + places[s][(n - 1) % shares[s]] for s, n in left.items()) + 1
        whole, rest = divmod(stop, period)
        size += len(order)
        if size > most:
            raise ValueError(f"the mix needs a plan of more than {most} rows: give weights of a smaller common period or longer blocks")
        for s, w in shares.items():
            behind[s] += stop * w / period
        for s, at in places.items():
            n = whole * shares[s] + (sum(p < rest for p in at) if rest < len(order) else len(at))
            if n:
                out.append((s, used[s], used[s] + n, begin, shares[s], period, at))
            used[s] += n
            behind[s] -= n
            left[s] -= n
            if not left[s]:
                del left[s]
        begin += stop
    return out


def whole_weights(weights: dict) -> dict:
    """Weights as integers of the same proportions; a float stands for the decimal number that it prints."""
    parts = {s: Fraction(str(w) if isinstance(w, float) else w) for s, w in weights.items()}
    if any(p <= 0 for p in parts.values()):
        raise ValueError("weights must be positive")
    scale = lcm(*(p.denominator for p in parts.values())) if parts else 1
    return {s: int(p * scale) for s, p in parts.items()}


def hash_of(documents, seed=0):
    """What the rows of a source are ordered by."""
    return F.xxhash64(*[F.col(c) for c in ("doc_id", "text") if c in documents.columns], F.lit(seed))


def mix_places(
    documents: DataFrame, targets=TARGETS, default=DEFAULT, block_rows=BLOCK_ROWS, seed=0, bucket_rows=BUCKET_ROWS, most=PLAN_ROWS,
    names=("_slot", "_seat", "_block"), spot=None,
):
    """All columns of ``documents(doc_id, source)`` and three ``names``: slot of the row's block, seat in it, block of its source.

    A null source is a source of its own. Rows of a source are ordered by a hash of their id and, if there is one, their
    ``text``, then by id; rows equal in these take neighbouring places in any order. Rows are numbered inside hash buckets of about ``bucket_rows`` rows,
    and one count per source and bucket is put in sequence, so a source of any size is spread over many tasks, and so
    are rows without an id or of one id if their texts differ. The driver sees one count per source, and a plan of
    at most ``most`` rows. ``spot`` names a column that has the hash already (``hash_of``). An empty table has no places. Columns of ``documents`` may have any names but the three.
    """
    if taken := {c.lower() for c in documents.columns} & {n.lower() for n in names}:
        raise ValueError(f"documents have columns {sorted(taken)}")
    total = documents.count()
    pieces = max(1, -(-total // bucket_rows))
    # plain columns rather than a struct of them, so that equal shuffles of several readers are made once
    name, hashed, bucket, n, start, at, block, seat, span, k = fresh(
        documents, "_name", "_hash", "_bucket", "_n", "_start", "_at", "_in_source", "_in_block", "_span", "_k"
    )
    rows = documents.withColumns({
        name: F.coalesce(F.concat(F.lit("="), "source"), F.lit("-")),
        hashed: F.col(spot) if spot else hash_of(documents, seed),
    }).withColumn(bucket, F.pmod(F.shiftrightunsigned(hashed, 8), F.lit(pieces)))
    sizes = rows.groupBy(name, bucket).agg(F.count("*").alias(n))
    before = W.partitionBy(name).orderBy(bucket).rowsBetween(W.unboundedPreceding, -1)
    starts = sizes.select(name, bucket, F.coalesce(F.sum(n).over(before), F.lit(0)).alias(start))
    inside = W.partitionBy(name, bucket).orderBy(hashed, "doc_id")
    counts = {r[0]: r[1] for r in rows.groupBy(name).agg(F.count("*")).limit(most + 1).collect()}
    if len(counts) > most:
        raise ValueError(f"more than {most} sources")
    blocks = {s: -(-c // block_rows) for s, c in counts.items()}
    wanted = whole_weights({s: targets.get(s[1:] if s != "-" else None, default) for s in counts})
    found = phases(blocks, wanted, most)
    spark = documents.sparkSession
    # both have at most ``most`` rows; the plan of a span is one struct, so that its names meet no column of the documents
    spans = spark.createDataFrame(
        [(f[0], i, tuple(f[1:6])) for i, f in enumerate(found)],
        "name string, span long, plan struct<first: long, end: long, begin: long, w: long, period: long>",
    )
    places = spark.createDataFrame([(i, j, p) for i, f in enumerate(found) for j, p in enumerate(f[6])], "span long, k long, place long")
    planned, plan, place = fresh(rows, "_planned", "_plan", "_place")
    numbered = (
        rows.withColumn(at, F.row_number().over(inside) - 1)
        .join(starts, [name, bucket])
        .withColumn(at, F.col(at) + F.col(start))
        .withColumns({block: F.floor(F.col(at) / block_rows), seat: F.col(at) % block_rows})
    )
    part = lambda field: F.col(f"{plan}.{field}")
    fits = (F.col(name) == F.col(planned)) & (F.col(block) >= part("first")) & (F.col(block) < part("end"))
    step = F.col(block) - part("first")
    placed = numbered.join(F.broadcast(spans.toDF(planned, span, plan)), fits).withColumn(k, step % part("w"))
    placed = placed.join(F.broadcast(places.toDF(span, k, place)), [span, k])
    slot = part("begin") + F.floor(step / part("w")) * part("period") + F.col(place)
    kept = [F.col(f"`{c}`") for c in documents.columns]
    return placed.select(*kept, slot.cast("long").alias(names[0]), F.col(seat).alias(names[1]), F.col(block).alias(names[2]))


def count_slots(documents: DataFrame, block_rows=BLOCK_ROWS) -> int:
    """How many slots the mix of ``documents(source)`` has."""
    blocks = documents.groupBy("source").count().select(F.ceil(F.col("count") / block_rows).alias("n"))
    return blocks.agg(F.sum("n")).first()[0] or 0


def in_order(placed: DataFrame, slots: int, slot="_slot", seat="_seat") -> DataFrame:
    """Rows sorted by slot and seat across partitions and within each. Slots have no gaps, so no sample is needed to cut them."""
    most = int(placed.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    pieces = max(1, min(most, -(-slots // PIECE_SLOTS)))
    per = max(1, -(-slots // pieces))
    return placed.repartitionById(pieces, F.floor(F.col(slot) / per).cast("int")).sortWithinPartitions(slot, seat)


def mix_sources(documents: DataFrame, **options) -> DataFrame:
    """The documents in the order of the mix: sorted across partitions and within each; all rows and columns of ``mix_places``."""
    names = fresh(documents, "_slot", "_seat", "_block")
    placed = mix_places(documents, **options, names=names)
    slots = count_slots(documents, options.get("block_rows", BLOCK_ROWS))
    return in_order(placed, slots, *names[:2]).select(*[F.col(f"`{c}`") for c in documents.columns])


def mix_report(documents: DataFrame, **options) -> DataFrame:
    """``doc_id, source, slot, block, seat`` of every row; null and repeated ids, ties and null sources as in ``mix_places``."""
    # texts are hashed where they are read and go no further
    named = documents.select("doc_id", "source", hash_of(documents, options.get("seed", 0)).alias("spot"))
    placed = mix_places(named, **options, spot="spot")
    return placed.select(
        "doc_id", "source", F.col("_slot").alias("slot"), F.col("_block").cast("long").alias("block"),
        F.col("_seat").cast("long").alias("seat"),
    )
