"""Near duplicates by SetSketch registers.

A document's set are its distinct word shingles. Equal sets form one class. Each class gets a SetSketch: register i
is floor(1 - log_b h_i), cut to 0..q+1, for the least h_i of exponential variates of the set's members. The registers
are mergeable and agree the more often, the more similar two sets are. Runs of registers are banded; the classes
of a band's bucket are compared with the bucket's leader and, in blocks of bounded size, with each other: a joint
likelihood of the register comparisons and the known sizes estimates the similarity, and what may reach the threshold
is verified on the full sets. Linked classes form components.
"""

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from comarca.llm.frames import sorted_groups, with_text
from comarca.llm.words import NOT_SPACE, Words, lower, mix, shingle_sets, slices
from comarca.operators.components import connected_components
from comarca.session import durable

BASE = 1.2  # b: ratio of register steps
RATE = 16.0  # a: rate of the exponential variates
LIMIT = 200  # q + 1: the largest register
BAND, BANDS = 5, 32  # a pair of similarity 0.8 shares no band with probability 6e-7, one of 0.85 with 1e-9
REGISTERS = BAND * BANDS
SHINGLE, PERCENT = 3, 85
CHUNK = 512  # classes of a bucket that meet in one block
MARGIN = 5.0  # standard errors below the threshold from which an estimate settles a pair without verification


def _multipliers():
    return mix(np.arange(1, REGISTERS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def registers(members: np.ndarray) -> np.ndarray:
    """Registers of one set of 64-bit hashes; the sketch of a union is the maximum of the sketches."""
    if not len(members):
        return np.zeros(REGISTERS, np.uint8)
    least = np.array([(members * m).min() for m in _multipliers()], np.uint64)
    return _truncate(least)


def _truncate(least):
    # the least of exponential variates belongs to the least of the uniform ones
    uniform = (least.astype(np.float64) + 0.5) / 2.0**64
    h = -np.log1p(-uniform) / RATE
    return np.clip(np.floor(1 - np.log(h) / math.log(BASE)), 0, LIMIT).astype(np.uint8)


def sketches(sets: list) -> np.ndarray:
    """Registers of many non-empty sets."""
    sizes = np.array([len(s) for s in sets])
    starts = np.cumsum(sizes) - sizes
    every = np.concatenate(sets)
    least = np.empty((REGISTERS, len(sets)), np.uint64)
    # parts of about 16,000 members stay in the processor's cache
    cuts = [0, *(np.flatnonzero(np.diff(starts // 16_384)) + 1), len(sets)]
    scratch = np.empty(max(int(sizes[a:b].sum()) for a, b in zip(cuts, cuts[1:])), np.uint64)
    for a, b in zip(cuts, cuts[1:]):
        part = every[starts[a] : starts[a] + sizes[a:b].sum()]
        room = scratch[: len(part)]
        for i, m in enumerate(_multipliers()):
            np.multiply(part, m, out=room)
            np.minimum.reduceat(room, starts[a:b] - starts[a], out=least[i, a:b])
    return _truncate(least).T.copy()


def estimate(above, below, size_u, size_v, steps=40):
    """Similarity of most likelihood from how many registers of u exceed, and fall below, those of v.

    P(K_u > K_v) = p(u - v J), P(K_u < K_v) = p(v - u J) with p(x) = -log_b(1 - x (b - 1) / b) and shares u, v of the
    sizes; J is at most min(u, v) / max(u, v). Works on arrays.
    """
    u = size_u / (size_u + size_v)
    v = 1 - u
    equal = REGISTERS - above - below

    def p(x):
        return -np.log1p(-np.maximum(x, 0) * (BASE - 1) / BASE) / math.log(BASE)

    def likelihood(j):
        more, less = p(u - v * j), p(v - u * j)
        tiny = 1e-12
        return (
            above * np.log(np.maximum(more, tiny)) + below * np.log(np.maximum(less, tiny))
            + equal * np.log(np.maximum(1 - more - less, tiny))
        )

    low, high = np.zeros(np.shape(u)), np.minimum(u / v, v / u)
    for _ in range(steps):  # the likelihood has one maximum
        a, b = low + (high - low) * 0.382, low + (high - low) * 0.618
        better = likelihood(a) >= likelihood(b)
        low, high = np.where(better, low, a), np.where(better, b, high)
    return (low + high) / 2


def enough(a, b, percent):
    """Whether 100 |a & b| >= percent |a | b|, for sorted distinct arrays."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = np.sort(np.concatenate((a, b)), kind="stable")
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= percent * (len(a) + len(b) - common)


def with_sets(documents: DataFrame, shingle=SHINGLE, row=None) -> DataFrame:
    """``doc_id, n_shingles, key, registers, row``: ``key`` is one digest for equal sets, null for empty ones.

    ``row`` is what the column ``row`` says of each row, null without it.
    """
    def run(batches):
        for batch in batches:
            for row, data, offsets in slices(batch.column("text")):
                words = Words(lower(data), offsets, NOT_SPACE)
                sets = list(shingle_sets(words, shingle))
                full = [s for s in sets if len(s)]
                made = iter(sketches(full)) if full else iter(())
                keys = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(row, len(sets)), pa.array([len(s) for s in sets], pa.int64()),
                        pa.array(keys, pa.binary()), pa.array([next(made).tobytes() if len(s) else None for s in sets], pa.binary()),
                        batch.column("row").slice(row, len(sets)),
                    ],
                    ["doc_id", "n_shingles", "key", "registers", "row"],
                )

    mark = F.lit(None).cast("long") if row is None else row
    rows = documents.select("doc_id", "text", mark.alias("row"))
    return rows.mapInArrow(run, "doc_id long, n_shingles long, key binary, registers binary, row long")


def _bands(classes: DataFrame) -> DataFrame:
    """``id, bucket`` of every class and band."""

    def run(batches):
        factors = mix(np.arange(1, BAND + 1, dtype=np.uint64)) | np.uint64(1)
        salts = mix(np.arange(101, 101 + BANDS, dtype=np.uint64))
        for batch in batches:
            if batch.num_rows:
                table = np.frombuffer(b"".join(batch.column("registers").to_pylist()), np.uint8).reshape(-1, BANDS, BAND)
                buckets = mix((table.astype(np.uint64) * factors).sum(2, dtype=np.uint64) + salts).astype(np.int64)
                ids = np.repeat(batch.column("id").to_numpy(), BANDS)
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(buckets.ravel())], ["id", "bucket"])

    return classes.select("id", "registers").mapInArrow(run, "id long, bucket long")


def _followers(banded: DataFrame, pieces) -> DataFrame:
    """``leader, id`` (distinct, leader <> id) of the classes that share a bucket with its leader.

    The leader is the class with the most neighbours in all of its buckets, so that the centre of a group leads.
    """
    dealt = banded.repartition(pieces, "bucket")
    sizes = dealt.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    shared = durable(dealt.join(sizes.hint("shuffle_hash"), "bucket"))
    weight = shared.groupBy("id").agg(F.sum("n").alias("w"))
    ranked = shared.join(weight, "id").select("bucket", "id", F.struct("w", (-F.col("id")).alias("i")).alias("r"))
    leaders = ranked.groupBy("bucket").agg((-F.max("r")["i"]).alias("leader"))
    return shared.join(leaders, "bucket").where("leader <> id").select("leader", "id").distinct()


class _Union:
    def __init__(self, n):
        self.up = list(range(n))

    def find(self, i):
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i, j):
        i, j = self.find(i), self.find(j)
        self.up[max(i, j)] = min(i, j)
        return i != j


def shortlist(sizes, tables, rows, columns, percent):
    """Pairs of ``rows`` x ``columns`` whose estimate may reach the threshold, best first."""
    level = percent / 100
    slack = MARGIN * math.sqrt(level * (1 - level) / REGISTERS)
    first, second = [], []
    guesses = []
    for at in range(0, len(rows), 64):
        part = rows[at : at + 64]
        a, b = tables[part][:, None, :], tables[columns][None, :, :]
        above, below = (a > b).sum(2, dtype=np.int32), (a < b).sum(2, dtype=np.int32)
        guess = estimate(above, below, sizes[part][:, None].astype(float), sizes[columns][None, :].astype(float), 24)
        r, c = np.nonzero(guess >= level - slack)
        first.append(part[r])
        second.append(columns[c])
        guesses.append(guess[r, c])
    order = np.argsort(-np.concatenate(guesses), kind="stable")
    return np.concatenate(first)[order], np.concatenate(second)[order]


def block_pairs(sizes, tables, left, right, percent):
    """Shortlisted pairs of one block: those of the leader (row 0), then those of ``left`` x ``right``."""
    every = np.unique(np.concatenate((left, right)))
    for rows, columns in ((np.array([0]), every), (left, right)):
        a, b = shortlist(sizes, tables, rows, columns, percent)
        yield a[a != b], b[a != b]


def block_links(ids, sets, pairs, percent):
    """Links that connect what the shortlisted pairs of one block show connected, each verified on the full sets.

    Pairs already connected through others of the block are not looked at again.
    """
    union = _Union(len(ids))
    for left, right in pairs:
        for i, j in zip(left.tolist(), right.tolist()):
            if union.find(i) != union.find(j) and enough(sets[i], sets[j], percent):
                union.join(i, j)
                yield ids[i], ids[j]


def _each_block(batches):
    """Rows of each block, the leader first, with register table, left and right row numbers."""
    for group in sorted_groups(batches, ["leader", "i", "j"]):
        side, ids = group.column("side").to_numpy(), group.column("id").to_numpy()
        order = np.lexsort((ids, side))
        table, side = group.take(pa.array(order)), side[order]
        if side[0] != 0 or len(side) < 2:
            continue
        tables = np.frombuffer(b"".join(table.column("registers").to_pylist()), np.uint8).reshape(-1, REGISTERS)
        left, right = np.flatnonzero(side == 1), np.flatnonzero(side == 2)
        yield table, tables, left if len(left) else right, right if len(right) else left


_BLOCK = "leader long, i int, j int, side int, id long"


def _promising(blocks: DataFrame, percent) -> DataFrame:
    """The rows of ``blocks`` that have a shortlisted pair in their block, judged by registers and sizes alone."""

    def run(batches):
        for table, tables, left, right in _each_block(batches):
            pairs = list(block_pairs(table.column("n").to_numpy(), tables, left, right, percent))
            used = np.unique(np.concatenate([x for p in pairs for x in p]))
            if len(used):
                used = np.union1d(used, [0])  # the leader opens its block
                kept = table.select([c.split()[0] for c in _BLOCK.split(", ")]).take(pa.array(used))
                yield from kept.combine_chunks().to_batches()

    ordered = blocks.repartition("leader", "i", "j").sortWithinPartitions("leader", "i", "j")
    return ordered.mapInArrow(run, _BLOCK)


def _verify(blocks: DataFrame, percent) -> DataFrame:
    """``src, dst`` from ``leader, i, j, side, id, n, registers, members`` dealt by block."""

    def run(batches):
        for table, tables, left, right in _each_block(batches):
            sets = [np.frombuffer(b, np.uint64) for b in table.column("members").to_pylist()]
            pairs = block_pairs(table.column("n").to_numpy(), tables, left, right, percent)
            links = list(block_links(table.column("id").to_pylist(), sets, pairs, percent))
            if links:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*links)], ["src", "dst"])

    ordered = blocks.repartition("leader", "i", "j").sortWithinPartitions("leader", "i", "j")
    return ordered.mapInArrow(run, "src long, dst long")


def _members(documents: DataFrame, wanted: DataFrame, shingle) -> DataFrame:
    """``key, members``: the sorted shingle hashes of the documents of ``wanted(doc)``, and the digest of each set."""

    def run(batches):
        for batch in batches:
            for _, data, offsets in slices(batch.column("text")):
                sets = [s.tobytes() for s in shingle_sets(Words(lower(data), offsets, NOT_SPACE), shingle) if len(s)]
                keys = [hashlib.blake2b(s, digest_size=16).digest() for s in sets]
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(sets, pa.binary())], ["key", "members"])

    texts = with_text(documents, "doc_id", "text")
    rows = texts.join(wanted.select(F.col("doc").alias("doc_id")).where("doc_id is not null").distinct(), "doc_id", "left_semi")
    if not wanted.where("doc is null").isEmpty():
        rows = rows.unionByName(texts.where("doc_id is null"))
    return rows.select("text").mapInArrow(run, "key binary, members binary")


def near_duplicates(documents: DataFrame, shingle=SHINGLE, percent=PERCENT, chunk=CHUNK) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of every row of ``documents(doc_id, text)``.

    Null and empty texts, and texts without a word, have an empty set and stand alone. Texts of fewer words than a
    shingle have their whole sequence as one. Repeated rows get the same answer each; rows of one ``doc_id`` and different texts are one document
    that has all of their links. Rows without an id are linked like others: their component is the smallest id that
    they reach, null without one, and only then are they kept.
    """
    out = _labelled(documents, shingle, percent, chunk)
    own = F.coalesce("component_id", "doc_id")
    kept = F.when(F.col("doc_id").isNull(), own.isNull()).otherwise(F.col("doc_id") == own)
    return out.select("doc_id", "n_shingles", own.alias("component_id"), kept.alias("kept"))


def _labelled(documents: DataFrame, shingle, percent, chunk, row=None) -> DataFrame:
    """``doc_id, n_shingles, row, part, component_id`` of every row.

    ``part`` is a number that linked rows share, null for rows without words; ``component_id`` is the smallest id among
    them, null where none has one.
    """
    if not 50 <= percent <= 100:
        raise ValueError("bands are laid out for thresholds from 50 to 100 percent")
    spark = documents.sparkSession
    pieces = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    rows = durable(with_sets(documents, shingle, row))
    full_rows = rows.where("key is not null")
    # one class per distinct set; equal keys have equal registers. A number names it, since an id may have several sets
    classes = full_rows.groupBy("key").agg(
        F.min("doc_id").alias("doc"), F.first("n_shingles").alias("n"), F.first("registers").alias("registers")
    )
    classes = durable(classes.withColumn("id", F.monotonically_increasing_id()))
    pairs = durable(_followers(_bands(classes), pieces))
    # followers of a leader are dealt into chunks by a hash, and every two chunks meet in one block
    counts = pairs.groupBy("leader").agg(F.count("*").alias("c"))
    chunks = F.greatest(F.lit(1), F.ceil(F.col("c") / chunk)).cast("int")
    dealt = pairs.join(counts, "leader").withColumn("k", chunks).withColumn("x", F.pmod(F.xxhash64("id", F.lit(5)), "k").cast("int"))
    partners = F.sequence(F.lit(0), F.col("k") - 1)
    met = dealt.select("leader", "id", "x", F.explode(partners).alias("y")).select(
        "leader", "id", F.least("x", "y").alias("i"), F.greatest("x", "y").alias("j"),
        F.when(F.col("x") <= F.col("y"), 1).otherwise(2).alias("side"),
    )
    wide = counts.withColumn("k", chunks).select("leader", F.col("leader").alias("id"), F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("i"), "k")
    heads = wide.select("leader", "id", "i", F.explode(F.sequence("i", F.col("k") - 1)).alias("j"), F.lit(0).alias("side"))
    blocks = met.unionByName(heads.select("leader", "id", "i", "j", "side"))
    blocks = durable(_promising(blocks.join(classes.select("id", "n", "registers"), "id"), percent))
    wanted = classes.join(blocks.select("id").distinct(), "id", "left_semi")
    sets = _members(documents, wanted, shingle)
    full = sets.join(wanted.drop("doc"), "key").groupBy("id", "n", "registers").agg(F.min("members").alias("members"))
    links = _verify(blocks.join(full, "id"), percent)
    # a document with several rows of different texts holds its classes together
    first = full_rows.where("doc_id is not null").select("key", "doc_id").join(classes.select("key", "id"), "key").select("doc_id", "id").distinct()
    many = first.groupBy("doc_id").agg(F.min("id").alias("least"), F.max("id").alias("most")).where("least <> most")
    bridges = first.join(many, "doc_id").where("id <> least").select(F.col("least").alias("src"), F.col("id").alias("dst"))
    found = connected_components(durable(links.unionByName(bridges).distinct()))
    parts = classes.select("key", "id", "doc").join(found.withColumnRenamed("node", "id"), "id", "left").select(
        "key", "doc", F.coalesce("component", "id").alias("part")
    )
    named = parts.join(parts.groupBy("part").agg(F.min("doc").alias("component_id")), "part").drop("doc")
    return rows.select("doc_id", "n_shingles", "key", "row").join(named, "key", "left").drop("key")


def _unused(columns, name):
    """``name``, or a longer one with which no column begins, whatever its case."""
    taken = {c.lower() for c in columns}
    while any(t.startswith(name) for t in taken):
        name += "_"
    return name


def drop_near_duplicates(documents: DataFrame, shingle=SHINGLE, percent=PERCENT, chunk=CHUNK) -> DataFrame:
    """One row of each component, all columns: that of the smallest id, and of its rows the one of the least hash.

    Rows without an id go where they are linked to a named row; of others that are linked, one stays. A row without
    words stands for its id alone, or without an id for the rows that equal it. Input columns of any name stay as they are.
    """
    names = [f"`{c}`" for c in documents.columns]
    columns = [F.col(f"`{f.name}`") for f in documents.schema if "map<" not in f.dataType.simpleString()]
    row = F.xxhash64(*columns, *[c.isNull() for c in columns])
    labelled = _labelled(documents, shingle, percent, chunk, row)
    whose = F.coalesce("component_id", "doc_id")
    groups = labelled.select(
        whose.alias("whose"), F.when(whose.isNull(), F.col("part")).alias("unnamed"),
        F.when(whose.isNull() & F.col("part").isNull(), F.col("row")).alias("alone"), "doc_id", "row",
    )
    counts = groups.groupBy("whose", "unnamed", "alone", "doc_id", "row").agg(F.count("*").alias("n"))
    best = F.min(F.struct(F.col("doc_id").isNull().alias("without"), "doc_id", "row", "n")).alias("x")
    mark, ident = _unused(documents.columns, "_row"), _unused(documents.columns, "_id")
    chosen = durable(counts.groupBy("whose", "unnamed", "alone").agg(best).select(
        F.col("x.doc_id").alias(ident), F.col("x.row").alias(f"{mark}2"), "x.n"
    ))
    marked = documents.withColumn(mark, row)
    same = (F.col(mark) == F.col(f"{mark}2")) & F.col("doc_id").eqNullSafe(F.col(ident))
    kept = marked.join(chosen.where("n = 1").drop("n"), same, "left_semi").select(*names)
    many = chosen.where("n > 1").drop("n")
    if many.isEmpty():
        return kept
    repeated = marked.join(many, same, "left_semi").groupBy("doc_id", mark).agg(F.first(F.struct(*names)).alias(f"{mark}3"))
    return kept.unionByName(repeated.select(f"{mark}3.*"))
