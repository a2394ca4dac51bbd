"""Visit state: overwrite, last-write-wins merge with conflicts, queue handling."""

from pyspark.sql import DataFrame, functions as F

from comarca.functions.text import instant, iso
from comarca.scale import running_best
from comarca.session import durable
from comarca.sources.writers import keep_last

KEYS = ["user_id", "segment_id"]
STATE = ["user_id", "segment_id", "visited", "visited_at", "notes", "source", "synced"]


def latest_queued(queue) -> DataFrame:
    """The last queued change per user and segment."""
    return keep_last(queue, KEYS, "seq")


#: Server rows come before every item of a batch.
_SERVER = -(1 << 63)
#: What settles the order of items of one ``seq``, as when two devices drain into one batch.
_TIES = ["t", "visited", "notes", "source"]


def _timed(items):
    missing = F.raise_error(F.lit("an item without seq")).cast("bigint")
    return items.withColumn("seq", F.coalesce(F.col("seq").cast("bigint"), missing)).withColumn(
        "t", instant("visited_at")
    ).where("t is not null")


def _touched(state, items):
    """State rows whose key occurs in the batch."""
    return state.join(items.select(*KEYS).distinct(), KEYS, "left_semi")


def fold(state, items) -> DataFrame:
    """Every item of a batch with the state it meets and whether it is accepted.

    An item is accepted when no earlier accepted write of its key is newer; equal times go to
    the item. ``seq`` is the order of the batch, equal ones are ordered by time and then by the rest of the row; an
    item without it is an error. Items with an unreadable time are left out.
    """
    batch = _timed(items).select(
        *KEYS, "seq", "t", "visited", "notes", "source", F.col("visited_at").alias("sent_at"),
        F.lit(False).alias("_server"),
    )
    server = _touched(state, batch).select(
        *KEYS, F.lit(_SERVER).cast("bigint").alias("seq"), F.col("visited_at").alias("t"), "visited",
        "notes", "source", F.lit(None).cast("string").alias("sent_at"), F.lit(True).alias("_server"),
    )
    seen = running_best(
        server.unionByName(batch), KEYS, "seq", F.struct("t", "seq", "visited", "notes"), "met", ties=_TIES
    )
    fits = F.coalesce(F.col("t") >= F.col("met.t"), F.lit(True))
    return seen.where("not _server").drop("_server").withColumn("accepted", fits)


def conflicts(folded) -> DataFrame:
    """Rejected items with the state that beat them."""
    return folded.where("not accepted").select(
        *KEYS, "seq", F.col("visited").alias("client_visited"),
        F.col("sent_at").alias("client_visited_at"), F.col("met.visited").alias("server_visited"),
        iso("met.t").alias("server_visited_at"), F.col("met.notes").alias("server_notes"),
    )


def accepted_state(folded) -> DataFrame:
    """The newest accepted write per key, as state rows."""
    won = folded.where("accepted").withColumn("_order", F.struct("t", "seq", "visited", "notes", "source"))
    last = keep_last(won, KEYS, "_order")
    return last.select(
        *KEYS, "visited", F.col("t").alias("visited_at"), "notes", "source",
        F.lit(True).alias("synced"),
    )


def replace_rows(state, rows) -> DataFrame:
    """State with the rows of the given keys replaced or added."""
    kept = state.join(rows.select(*KEYS), KEYS, "left_anti").select(*STATE)
    return kept.unionByName(rows.select(*STATE))


def sync_visits(state, items):
    """(new state, conflicts, outcome) of merging a batch; the last write wins by time."""
    folded = durable(fold(state, items))  # three results, one fold
    return replace_rows(state, accepted_state(folded)), conflicts(folded), outcome(folded)


def outcome(folded) -> DataFrame:
    """Number of accepted items and of conflicts."""
    return folded.agg(
        F.count_if("accepted").alias("synced"), F.count_if(~F.col("accepted")).alias("conflicts")
    )


def overwrite_rows(items) -> DataFrame:
    """The last write per key without any time check; an unreadable time is an error."""
    bad = F.raise_error(F.concat(F.lit("invalid visited_at: "), F.coalesce("visited_at", F.lit("NULL"))))
    read = instant("visited_at")
    t = F.when(read.isNull(), bad.cast("timestamp")).otherwise(read)
    timed = keep_last(items.withColumn("t", t), KEYS, "seq")
    return timed.select(
        *KEYS, "visited", F.col("t").alias("visited_at"), "notes", "source",
        F.lit(True).alias("synced"),
    )


def upsert_visits(state, items) -> DataFrame:
    """State after unconditional writes; the last arrival wins."""
    return replace_rows(state, overwrite_rows(items))


def waiting_counts(queue) -> DataFrame:
    """Queued changes per user."""
    return queue.groupBy("user_id").agg(F.count("*").alias("waiting"))
