"""Filter interaction audit: what each filter removes in every order of application, from one walk over subsets.

Documents shrink to one cell per part and failure mask. A Gray code visits all subsets of filters and toggles one
filter at a time: each cell counts its active failures, and the survivors change only by cells whose counter
leaves or reaches zero. Survivors of all subsets are stored (32 states for five filters); every step of every
order is the difference of two of them.
"""

from itertools import permutations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from comarca.llm.frames import with_text
from comarca.session import durable

FILTERS = "ABCDE"
MEASURES = ["n", "good", "toxic"]
SCHEMA = (
    "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, "
    "good_lost long, toxic_lost long, shapley long"
)


def walk(cells: np.ndarray) -> np.ndarray:
    """Sums over the cells that no filter of a subset fails, for every subset; row ``m`` of both is mask ``m``."""
    size = len(cells)
    masks, failing = np.arange(size), np.zeros(size, np.int64)
    states, kept, subset = np.empty_like(cells), cells.sum(0), 0
    states[0] = kept
    for turn in range(1, size):
        bit = turn & -turn  # the filter that the Gray code toggles
        subset ^= bit
        rows = np.flatnonzero(masks & bit)
        if subset & bit:
            failing[rows] += 1
            kept = kept - cells[rows[failing[rows] == 1]].sum(0)
        else:
            failing[rows] -= 1
            kept = kept + cells[rows[failing[rows] == 0]].sum(0)
        states[subset] = kept
    return states


def report(part, cells, filters=FILTERS) -> pd.DataFrame:
    """All steps of all orders of one part."""
    states, count = walk(cells), len(filters)
    failed = [int(cells[np.flatnonzero(np.arange(len(cells)) >> f & 1), 0].sum()) for f in range(count)]
    alone = [int(cells[1 << f, 0]) for f in range(count)]
    rows, shapley = [], [0] * count
    for order in permutations(range(count)):
        name, subset = "".join(filters[f] for f in order), 0
        for step, f in enumerate(order, 1):
            after = subset | 1 << f
            lost = states[subset] - states[after]
            shapley[f] += int(lost[0])
            rows.append((name, step, f, int(states[after, 0]), int(lost[0]), failed[f] - int(lost[0]), alone[f], int(lost[1]), int(lost[2])))
            subset = after
    names = ["filter_order", "step", "f", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"]
    out = pd.DataFrame(rows, columns=names)
    out["shapley"] = out["f"].map(dict(enumerate(shapley)))
    return out.drop(columns="f").assign(part=part)


def fail_masks(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """``part, mask, good, toxic, n`` for ``documents(doc_id, text, lang)``: ``n`` rows of one kind each.

    Bit 0 of ``mask`` is filter A, bit 4 filter E.

    A: under 100 words. B: fewer than 80 % of the words are different. C: more than 10 % capitals A-Z. D: holds one
    of ``#$%&*|``. E: the text equals that of a smaller ``doc_id``, whatever becomes of it. Null texts are empty, a
    null ``lang`` is the part ''. Rows without an id fail E never and make nobody fail it; rows that repeat an id are
    judged each. A document is good (toxic) where any of its rows in ``labels(doc_id, quality, toxic)`` says 1.
    Equal texts are told by SHA-256, so texts of any length travel as 32 bytes.
    """
    text = F.coalesce("text", F.lit(""))
    words = F.array_remove(F.split("_text", r"[\x20\x09-\x0D]+"), "")
    n, size = F.size("_words").cast("long"), F.length("_text").cast("long")
    capitals = size - F.length(F.regexp_replace("_text", "[A-Z]", ""))
    fails = [
        n < 100, 100 * F.size(F.array_distinct("_words")) < 80 * n, 100 * capitals > 10 * size,
        F.col("_text").rlike("[#$%&*|]"),
    ]
    mask = sum((F.when(f, 1 << k).otherwise(0) for k, f in enumerate(fails[1:], 1)), F.when(fails[0], 1).otherwise(0))
    rows = with_text(documents, "doc_id", "text", "lang").withColumn("_text", text).withColumn("_words", words)
    # one pass over the texts; what follows moves some 60 bytes a document
    rows = durable(rows.select(
        "doc_id", F.coalesce("lang", F.lit("")).alias("part"), mask.alias("mask"), F.unhex(F.sha2("_text", 256)).alias("digest")
    ))
    marked = with_text(labels, "doc_id", "quality", "toxic").where("doc_id is not null").groupBy("doc_id").agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False)).cast("long")).alias("good"),
        F.max(F.coalesce(F.col("toxic") == 1, F.lit(False)).cast("long")).alias("toxic"),
    )
    zero = F.lit(0).cast("long")
    alike = ["digest", "part", "mask", "good", "toxic"]
    # repeated rows are counted first, so an id of many rows meets its labels once for each of its texts
    own = rows.where("doc_id is not null").groupBy("doc_id", "digest", "part", "mask").agg(F.count("*").alias("n"))
    own = own.join(marked, "doc_id", "left").withColumns({c: F.coalesce(c, zero) for c in ("good", "toxic")})
    # a group of copies shrinks inside tasks to one row per part and label, and only these rows meet
    copies = own.groupBy(*alike).agg(
        F.sum("n").alias("n"), F.min("doc_id").alias("least"), F.min_by("n", "doc_id").alias("at_least")
    )
    first = F.col("least") == F.min("least").over(W.partitionBy("digest"))
    copies = copies.withColumn("first", F.when(first, F.col("at_least")).otherwise(zero))
    told = copies.select(*alike, F.explode(F.array(
        F.struct(F.lit(0).alias("fifth"), F.col("first").alias("n")), F.struct(F.lit(16).alias("fifth"), (F.col("n") - F.col("first")).alias("n"))
    )).alias("e")).select("part", (F.col("mask") + F.col("e.fifth")).alias("mask"), "good", "toxic", F.col("e.n").alias("n"))
    nameless = rows.where("doc_id is null").groupBy("part", "mask").agg(F.count("*").alias("n"))
    return told.where("n > 0").unionByName(nameless.select("part", "mask", zero.alias("good"), zero.alias("toxic"), "n"))


def audit(masks: DataFrame, filters=FILTERS) -> DataFrame:
    """``SCHEMA``: per part, order of filters and step, counts within the part.

    ``masks(part, mask, good, toxic, n)`` says how many documents fail which filters: bit ``k`` of ``mask`` stands for
    filter ``k`` of ``filters``, ``good`` and ``toxic`` are 0 or 1. A part has at most ``2 ** len(filters)`` cells, added up before anything is shuffled, and
    ``len(filters)!`` orders. Parts without rows do not occur; an empty table gives no rows.
    """
    if not 1 <= len(filters) <= 6 or len(set(filters)) < len(filters):
        raise ValueError("1 to 6 different filters")
    marked = lambda c: F.sum(F.col("n") * F.col(c)).alias(c)
    cells = masks.groupBy("part", "mask").agg(F.sum("n").alias("n"), marked("good"), marked("toxic"))
    parts = cells.groupBy("part").agg(F.collect_list(F.struct("mask", *MEASURES)).alias("cells"))

    def orders(batches):
        for batch in batches:
            for part, listed in zip(batch["part"], batch["cells"]):
                table = np.zeros((1 << len(filters), len(MEASURES)), np.int64)
                for c in listed:
                    table[c["mask"]] = [c[m] for m in MEASURES]
                yield report(part, table, filters)[[c.split()[0] for c in SCHEMA.split(", ")]]

    return parts.mapInPandas(orders, SCHEMA)


def oracle() -> str:
    fail = """(CASE WHEN n < 100 THEN 1 ELSE 0 END) + (CASE WHEN 100 * len(list_distinct(w)) < 80 * n THEN 2 ELSE 0 END)
        + (CASE WHEN 100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 10 * length(text) THEN 4 ELSE 0 END)
        + (CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END)
        + (CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY text) THEN 16 ELSE 0 END)"""
    letters = "(VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16))"
    lost = "sum({m}) FILTER ((c.mask & before) = 0 AND (c.mask & bit) <> 0)"
    count = lambda m: f"CAST(coalesce({m}, 0) AS BIGINT)"
    return f"""
    WITH docs AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(lang, '') AS part,
            regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w, len(w) AS n FROM documents),
        marked AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good,
            max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
        cells AS (SELECT part, mask, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic
            FROM (SELECT doc_id, part, {fail} AS mask FROM docs) AS m LEFT JOIN marked USING (doc_id) GROUP BY part, mask),
        letters(l, bit) AS {letters},
        orders AS (SELECT a.l || b.l || c.l || d.l || e.l AS filter_order
            FROM letters AS a, letters AS b, letters AS c, letters AS d, letters AS e
            WHERE (a.bit | b.bit | c.bit | d.bit | e.bit) = 31),
        steps AS (SELECT filter_order, CAST(s AS INTEGER) AS step, l, bit,
                CAST(coalesce(sum(bit) OVER (PARTITION BY filter_order ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before
            FROM orders, range(1, 6) AS r(s), letters WHERE l = substr(filter_order, CAST(s AS INTEGER), 1)),
        told AS (SELECT part, filter_order, step, l,
                {count('sum(c.n) FILTER ((c.mask & (before | bit)) = 0)')} AS kept, {count(lost.replace('{m}', 'c.n'))} AS removed,
                {count('sum(c.n) FILTER ((c.mask & bit) <> 0)')} AS failed, {count('sum(c.n) FILTER (c.mask = bit)')} AS unique_fails,
                {count(lost.replace('{m}', 'good'))} AS good_lost, {count(lost.replace('{m}', 'toxic'))} AS toxic_lost
            FROM cells AS c, steps GROUP BY part, filter_order, step, l)
    SELECT part, filter_order, step, kept, removed, failed - removed AS redundant, unique_fails, good_lost, toxic_lost,
        CAST(sum(removed) OVER (PARTITION BY part, l) AS BIGINT) AS shapley FROM told"""
