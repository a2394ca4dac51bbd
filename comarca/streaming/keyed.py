"""Visit merging with one state per user and segment, kept by Spark between micro-batches.

The state is the newest accepted write of a key. It starts from stored visits, is versioned and recovered with the
stream's progress, and a batch reads and writes the keys of its items only. Keys are dealt into buckets, each a group of
the stream with a map of its keys' states, so that what a group costs is paid once a bucket and not once a key. Accepted
states and conflicts go to one folder of files; Spark's own log of that folder counts the files of a repeated batch once.
"""

from itertools import groupby
from operator import attrgetter

from pyspark.sql import DataFrame, Row, functions as F
from pyspark.sql.streaming import StatefulProcessor

from comarca.functions.text import iso
from comarca.operators.visits import KEYS, STATE, _timed, replace_rows
from comarca.sources.writers import keep_last

#: Groups that the keys are dealt into. A stream keeps the number it started with.
BUCKETS = 4096
_BUCKET = "bucket"
_KEY = "user_id string, segment_id long"
_NOW = "t long, visited boolean, notes string, source string, version long"
#: ``version`` counts the accepted writes of a key; rows without it are conflicts.
RESULT = """
    user_id string, segment_id long, version long, seq long, visited boolean, t long, notes string, source string,
    sent_at string, server_visited boolean, server_t long, server_notes string
"""
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_ROW = Row(*[c.split()[0] for c in RESULT.split(",")])


def _key_order(row):
    return (row.user_id is not None, row.user_id or "", row.segment_id is not None, row.segment_id or 0)


def _order(row):
    """Items of a key as they were queued; equal ones by time and then by the rest of the row, nulls first."""
    return (
        *_key_order(row), row.seq, row.t, row.visited is not None, row.visited or False,
        row.notes is not None, row.notes or "", row.source is not None, row.source or "",
    )


class Merge(StatefulProcessor):
    """Last write wins by time; equal times go to the later item. One output row per conflict and per changed key."""

    def init(self, handle):
        self.now = handle.getMapState("now", _KEY, _NOW)

    def handleInitialState(self, key, initialState, timerValues):
        row = initialState
        self.now.updateValue((row.user_id, row.segment_id), (row.t, row.visited, row.notes, row.source, 0))

    def handleInputRows(self, key, rows, timerValues):
        """Items of the keys of one bucket in one batch; trigger limits bound their number."""
        for pair, items in groupby(sorted(rows, key=_order), attrgetter(*KEYS)):
            start = self.now.getValue(pair)
            met = start = tuple(start) if start is not None else None
            for row in items:
                if met is not None and row.t < met[0]:
                    yield _ROW(*pair, None, row.seq, row.visited, row.t, row.notes, row.source, row.sent_at, met[1], met[0], met[2])
                else:
                    met = (row.t, row.visited, row.notes, row.source, (met[4] if met is not None else 0) + 1)
            if met is not start:
                self.now.updateValue(pair, met)
                yield _ROW(*pair, met[4], None, met[1], met[0], met[2], met[3], None, None, None, None)

    def close(self):
        pass


def keyed_sync(items, state, buckets=BUCKETS) -> DataFrame:
    """Stream of ``RESULT`` rows for a stream of queue items (``VISIT_ITEM``), starting from ``state`` (``VISIT``).

    Items with an unreadable time are left out and an item without ``seq`` is an error, as in ``fold``. Items of a later
    batch come after those of earlier ones, whatever their ``seq``.
    """
    bucket = F.pmod(F.xxhash64(*KEYS), F.lit(buckets)).alias(_BUCKET)
    known = state.select(bucket, *KEYS, F.unix_micros("visited_at").alias("t"), "visited", "notes", "source").where("t is not null")
    timed = _timed(items).select(
        bucket, *KEYS, "seq", F.unix_micros("t").alias("t"), "visited", "notes", "source", F.col("visited_at").alias("sent_at")
    )
    return timed.groupBy(_BUCKET).transformWithState(
        Merge(), outputStructType=RESULT, outputMode="Append", timeMode="None", initialState=known.groupBy(_BUCKET)
    )


def start_keyed_sync(items, state, path, checkpoint, **trigger):
    """Run ``keyed_sync`` into files under ``path``; resumes from ``checkpoint``.

    A stream that resumes takes its states from there and ``state`` is not read again.
    """
    conf = items.sparkSession.conf
    before = conf.get(_PROVIDER, None)
    conf.set(_PROVIDER, _ROCKSDB)  # states of this kind need it; the stream keeps the setting it starts with
    try:
        return (
            keyed_sync(items, state).writeStream.format("parquet").outputMode("append")
            .option("path", path).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True})).start()
        )
    finally:
        conf.unset(_PROVIDER) if before is None else conf.set(_PROVIDER, before)


def keyed_state(spark, path, state) -> DataFrame:
    """The state after all results under ``path``: ``state`` with the newest version of every changed key."""
    rows = spark.read.schema(RESULT).parquet(path).where("version is not null")
    newest = keep_last(rows, KEYS, "version").select(
        *KEYS, "visited", F.timestamp_micros("t").alias("visited_at"), "notes", "source", F.lit(True).alias("synced")
    )
    return replace_rows(state.select(*STATE), newest)


def keyed_conflicts(spark, path) -> DataFrame:
    """Refused items with the state that beat them, as ``operators.visits.conflicts`` returns them."""
    rows = spark.read.schema(RESULT).parquet(path).where("version is null")
    return rows.select(
        *KEYS, "seq", F.col("visited").alias("client_visited"), F.col("sent_at").alias("client_visited_at"), "server_visited",
        iso(F.timestamp_micros("server_t")).alias("server_visited_at"), "server_notes",
    )
