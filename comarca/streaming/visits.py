"""Offline visit queues merged into a state table as they arrive.

Every micro-batch writes the rows it changed and the conflicts it found to folders of its own run
and number. A run is a stream with its progress folder; the store gives each a number, so that a
stream with a fresh progress folder, whose batches start at 0 again, overwrites nothing. A batch that runs again
replaces its own output and reads only earlier ones. One run at a time may write to a store.

Rows are dealt into buckets by their key, and a batch reads the buckets that its items touch. After some batches the
state is written as a snapshot; a manifest, written anew under the next version once its files are complete, names the
snapshot and the change folders since. The state is the newest row per key over these, however old the store is.
"""

import functools

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, functions as F

from comarca import schemas
from comarca.operators.visits import (
    KEYS, STATE, accepted_state, conflicts, fold, overwrite_rows,
)
from comarca.sources.writers import keep_last

CONFLICT = """
    user_id string, segment_id long, seq long, client_visited boolean, client_visited_at string,
    server_visited boolean, server_visited_at string, server_notes string
"""
PLACE = "struct<run:long,batch:long>"
MANIFEST = f"version long, buckets int, snapshot {PLACE}, changes array<{PLACE}>"
BUCKETS = 64
COMPACT_EVERY = 16


class VisitStore:
    """Changed rows, conflicts, snapshots and manifests under a shared path.

    ``buckets`` holds for a new store; one that exists keeps its own number. A batch that finds ``compact_every``
    change folders before it writes a snapshot first.
    """

    def __init__(self, spark, path, policy="newest", buckets=BUCKETS, compact_every=COMPACT_EVERY):
        if policy not in ("newest", "overwrite"):
            raise ValueError("policy is 'newest' or 'overwrite'")
        self.spark, self.path, self.policy = spark, path.rstrip("/"), policy
        self.buckets, self.compact_every = buckets, compact_every

    # --- files ---------------------------------------------------------------------------------------------------

    def _at(self, name):
        """Folder and file system of ``name``, in whatever store the path lies."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self, name):
        path, files = self._at(name)
        return sorted(s.getPath().getName() for s in files.listStatus(path)) if files.exists(path) else []

    def _read(self, name, schema):
        try:
            return self.spark.read.schema(f"{schema}, run long, batch long").parquet(f"{self.path}/{name}")
        except AnalysisException as error:
            if "PATH_NOT_FOUND" not in (error.getCondition() or ""):
                raise
            return self.spark.createDataFrame([], f"{schema}, run long, batch long")

    def _write(self, df, name, batch, run=0):
        df.write.mode("overwrite").parquet(f"{self.path}/{name}/run={run}/batch={batch}")

    def _write_buckets(self, rows, buckets, folder):
        """State rows, one folder a bucket; large buckets are cut into several files."""
        dealt = rows.withColumn("bucket", bucket_of(buckets)).hint("rebalance", "bucket")
        dealt.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/{folder}")

    # --- the manifest ----------------------------------------------------------------------------------------------

    def manifest(self):
        """The newest complete manifest as a row of ``MANIFEST``, None for a store without one."""
        for name in reversed(self._names("manifest")):
            found = self.spark.read.schema(MANIFEST).json(f"{self.path}/manifest/{name}").first()
            if found is not None:
                return found
        return None

    def _publish(self, version, buckets, snapshot, changes):
        row = self.spark.createDataFrame([(version, buckets, snapshot, sorted(changes))], MANIFEST)
        row.coalesce(1).write.mode("overwrite").json(f"{self.path}/manifest/version={version:012d}")

    def _record(self, run, batch):
        """Add the change folder of a batch; one that ran before is listed already."""
        now = self.manifest()
        known = [tuple(c) for c in now.changes] if now else []
        if (run, batch) not in known:
            self._publish(
                now.version + 1 if now else 0, now.buckets if now else self.buckets,
                tuple(now.snapshot) if now and now.snapshot else None, [*known, (run, batch)],
            )

    # --- the state ---------------------------------------------------------------------------------------------------

    def state(self, before=None, touched=None) -> DataFrame:
        """Newest row per key; ``before`` (run, batch) leaves out the given batch and later ones.

        With ``touched`` only the rows of these buckets are read and returned.
        """
        now = self.manifest()
        parts = []
        if now and now.snapshot:
            kept = self.spark.read.schema(f"{schemas.VISIT}, bucket int").parquet(self._snapshot(now.snapshot))
            parts.append(kept.select("*", *[F.lit(None).cast("long").alias(c) for c in ("run", "batch")]))
        folders = [
            f"{self.path}/changes/run={c.run}/batch={c.batch}" for c in (now.changes if now else [])
            if before is None or tuple(c) < tuple(before)
        ]
        if folders:
            reader = self.spark.read.option("basePath", f"{self.path}/changes")
            parts.append(reader.schema(f"{schemas.VISIT}, run long, batch long, bucket int").parquet(*folders))
        if not parts:
            return self.spark.createDataFrame([], schemas.VISIT).select(*STATE)
        rows = functools.reduce(DataFrame.unionByName, parts)
        if touched is not None:
            rows = rows.where(F.col("bucket").isin(list(touched)))
        # one row per key, run and batch, so these order them; rows of the snapshot come first
        return keep_last(rows.drop("bucket"), KEYS, F.struct("run", "batch")).select(*STATE)

    def _snapshot(self, place):
        return f"{self.path}/snapshots/before={place[0]}_{place[1]}"

    def compact(self, before=None):
        """Write the state before a batch (by default all of it) as a snapshot and publish a manifest that starts there."""
        now = self.manifest()
        if now is None:
            return
        known = [tuple(c) for c in now.changes]
        place = tuple(before) if before is not None else max(known, default=tuple(now.snapshot or (0, -1)))
        if before is None and known:
            place = (place[0], place[1] + 1)
        if now.snapshot and tuple(now.snapshot) >= place:
            return
        self._write_buckets(self.state(place), now.buckets, f"snapshots/before={place[0]}_{place[1]}")
        self._publish(now.version + 1, now.buckets, place, [c for c in known if c >= place])

    def vacuum(self):
        """Delete what the newest manifest does not name; call it while nobody reads an older state."""
        now = self.manifest()
        if now is None:
            return
        kept = {(c.run, c.batch) for c in now.changes}
        gone = [f"manifest/{n}" for n in self._names("manifest") if n != f"version={now.version:012d}"]
        gone += [f"snapshots/{n}" for n in self._names("snapshots") if not now.snapshot or n != f"before={now.snapshot.run}_{now.snapshot.batch}"]
        for run in self._names("changes"):
            for batch in self._names(f"changes/{run}"):
                if batch.startswith("batch=") and (int(run.split("=")[1]), int(batch.split("=")[1])) not in kept:
                    gone.append(f"changes/{run}/{batch}")
        for name in gone:
            path, files = self._at(name)
            files.delete(path, True)

    def conflicts(self) -> DataFrame:
        return self._read("conflicts", CONFLICT)

    def apply(self, items, batch, run=0):
        """Merge one batch of queue items (``VISIT_ITEM`` columns); streams have runs from 1.

        A batch that a snapshot holds already changes nothing.
        """
        now = self.manifest()
        if now and now.snapshot and (run, batch) < tuple(now.snapshot):
            return
        if now and sum(tuple(c) < (run, batch) for c in now.changes) >= self.compact_every:
            self.compact(before=(run, batch))
        buckets = now.buckets if now else self.buckets
        if self.policy == "overwrite":
            self._write_buckets(overwrite_rows(items), buckets, f"changes/run={run}/batch={batch}")
            self._record(run, batch)
            return
        # at most as many numbers as there are buckets
        touched = [r[0] for r in items.select(bucket_of(buckets)).distinct().collect()]
        folded = fold(self.state((run, batch), touched), items).persist()
        try:
            self._write(conflicts(folded), "conflicts", batch, run)
            self._write_buckets(accepted_state(folded), buckets, f"changes/run={run}/batch={batch}")
        finally:
            folded.unpersist()
        self._record(run, batch)

    def _run_of(self, checkpoint):
        """Number of the run whose progress is in ``checkpoint``, a new one for a stream not seen before.

        A stream keeps its id in its progress folder, so a fresh folder of the same name is another run.
        """
        stream = self.spark.read.schema("id string").json(f"{checkpoint}/metadata").first()["id"]
        try:
            known = {r["stream"]: r["run"] for r in self.spark.read.schema("stream string, run long").parquet(f"{self.path}/runs").collect()}
        except AnalysisException as error:
            if "PATH_NOT_FOUND" not in (error.getCondition() or ""):
                raise
            known = {}
        if stream not in known:
            known[stream] = max(known.values(), default=0) + 1
            row = self.spark.createDataFrame([(stream,)], "stream string")
            row.write.mode("overwrite").parquet(f"{self.path}/runs/run={known[stream]}")
        return known[stream]

    def seed(self, state):
        """Put an existing state in place before the first batch."""
        self._write_buckets(state.select(*STATE), self.buckets, "changes/run=0/batch=-1")
        self._record(0, -1)

    def start(self, items, checkpoint, **trigger):
        """Run over a stream of queue items; resumes from ``checkpoint``."""
        run = []

        def merge(batch_items, batch):
            if not run:
                run.append(self._run_of(checkpoint))
            self.apply(batch_items, batch, run[0])

        return (
            items.writeStream.foreachBatch(merge)
            .option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True}))
            .start()
        )


def bucket_of(buckets):
    return F.pmod(F.xxhash64(*KEYS), F.lit(buckets)).cast("int").alias("bucket")


def read_queue(spark, path, files_per_batch=None) -> DataFrame:
    """Stream of queue files in JSON Lines."""
    reader = spark.readStream.schema(schemas.VISIT_ITEM)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.json(path)
