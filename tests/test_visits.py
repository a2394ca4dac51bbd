"""Last-write-wins merging, in one batch and as a stream, against a sequential fold."""

import datetime as dt
import json
import os
import random

import pytest
from pyspark.sql import functions as F

from comarca import schemas
from comarca.operators import visits
from comarca.streaming.visits import VisitStore, read_queue

T0 = dt.datetime(2026, 5, 30, 10)


def made(seed, n=120):
    rng = random.Random(seed)
    state = [(f"u{u}", s, bool(s % 2), T0 + dt.timedelta(minutes=rng.randrange(60)), f"s{s}", "web", True) for u in range(2) for s in range(3)]
    items = []
    for i in range(n):
        t = (T0 + dt.timedelta(minutes=rng.randrange(60))).isoformat() + "Z"
        user = "u0" if rng.random() < 0.7 else f"u{rng.randrange(3)}"
        items.append((user, rng.randrange(2 if user == "u0" else 5), rng.random() < 0.5, "bad" if i % 19 == 0 else t, f"n{i}", "mobile", i))
    return state, items


def fold(state, items):
    now = {(r[0], r[1]): (r[3], r[2], r[4]) for r in state}
    lost = []
    for user, seg, visited, at, notes, _, seq in items:
        if at == "bad":
            continue
        t = dt.datetime.fromisoformat(at.replace("Z", ""))
        met = now.get((user, seg))
        if met and met[0] > t:
            lost.append((user, seg, seq, met[1], met[2]))
        else:
            now[(user, seg)] = (t, visited, notes)
    return now, sorted(lost)


def frames(spark, state, items):
    return spark.createDataFrame(state, schemas.VISIT), spark.createDataFrame(items, schemas.VISIT_ITEM).repartition(4)


def read(state):
    return {(r.user_id, r.segment_id): (r.visited_at, r.visited, r.notes) for r in state.collect()}


@pytest.mark.parametrize("seed", [1, 2])
def test_sync_equals_fold(spark, seed):
    state, items = made(seed)
    new, lost, outcome = visits.sync_visits(*frames(spark, state, items))
    want, want_lost = fold(state, items)
    assert read(new) == want
    rows = sorted((r.user_id, r.segment_id, r.seq, r.server_visited, r.server_notes) for r in lost.collect())
    assert rows == want_lost
    good = sum(i[3] != "bad" for i in items)
    assert tuple(outcome.first()) == (good - len(want_lost), len(want_lost))


def test_overwrite_has_no_time_check(spark):
    state, items = made(3)
    good = [i for i in items if i[3] != "bad"]
    got = read(visits.upsert_visits(*frames(spark, state, good)))
    want = {(r[0], r[1]): r[4] for r in state} | {(i[0], i[1]): i[4] for i in good}
    assert {k: v[2] for k, v in got.items()} == want
    with pytest.raises(Exception, match="invalid visited_at"):
        visits.upsert_visits(*frames(spark, state, items)).collect()


def write(path, items):
    names = ["user_id", "segment_id", "visited", "visited_at", "notes", "source", "seq"]
    path.mkdir(parents=True, exist_ok=True)
    for k, part in enumerate(items):
        file = path / f"{k:03d}.json"
        file.write_text("\n".join(json.dumps(dict(zip(names, i))) for i in part))
        os.utime(file, (1_000_000 + k, 1_000_000 + k))  # a stream takes files by age


@pytest.mark.parametrize("parts", [1, 3])
def test_stream_equals_fold(spark, tmp_path, parts):
    state, items = made(4, 60)
    size = -(-len(items) // parts)
    write(tmp_path / "queue", [items[k:k + size] for k in range(0, len(items), size)])
    store = VisitStore(spark, str(tmp_path / "store"))
    store.seed(spark.createDataFrame(state, schemas.VISIT))
    want, want_lost = fold(state, items)
    for _ in range(2):  # the second start finds nothing new
        store.start(read_queue(spark, str(tmp_path / "queue"), 1), str(tmp_path / "progress")).awaitTermination()
        assert read(store.state()) == want
        assert sorted(r.seq for r in store.conflicts().collect()) == sorted(x[2] for x in want_lost)


def test_fresh_progress_keeps_earlier_runs(spark, tmp_path):
    """A second progress folder, also one of the same name, starts a run of its own over the same store."""
    import shutil

    state, items = made(8, 40)
    store = VisitStore(spark, str(tmp_path / "store"))
    store.seed(spark.createDataFrame(state, schemas.VISIT))
    for k, part in enumerate((items[:15], items[15:30], items[30:])):
        write(tmp_path / f"queue{k}", [part])
        progress = tmp_path / ("first" if k == 0 else "again")
        if progress.exists():
            shutil.rmtree(progress)
        store.start(read_queue(spark, str(tmp_path / f"queue{k}"), 1), str(progress)).awaitTermination()
    want, want_lost = fold(state, items)
    assert read(store.state()) == want
    assert sorted(r.seq for r in store.conflicts().collect()) == sorted(x[2] for x in want_lost)


def test_replayed_batch_changes_nothing(spark, tmp_path):
    state, items = made(5, 40)
    store = VisitStore(spark, str(tmp_path / "store"))
    store.seed(spark.createDataFrame(state, schemas.VISIT))
    first, second = (spark.createDataFrame(part, schemas.VISIT_ITEM) for part in (items[:20], items[20:]))
    store.apply(first, 0)
    store.apply(second, 1)
    once, lost = read(store.state()), store.conflicts().count()
    store.apply(second, 1)
    store.apply(first, 0)
    store.apply(second, 1)
    assert read(store.state()) == once == fold(state, items)[0] and store.conflicts().count() == lost


def test_stream_overwrite(spark, tmp_path):
    state, items = made(6, 30)
    good = [i for i in items if i[3] != "bad"]
    store = VisitStore(spark, str(tmp_path / "store"), policy="overwrite")
    store.apply(spark.createDataFrame(good, schemas.VISIT_ITEM), 0)
    assert {k: v[2] for k, v in read(store.state()).items()} == {(i[0], i[1]): i[4] for i in good}


def test_any_seq(spark):
    """Negative and equal seq are taken in a fixed order; an item without seq is an error."""
    import pytest

    state, items = frames(spark, {}, [])
    row = items.schema.names
    base = {"user_id": "u", "segment_id": 1, "visited": True, "notes": "n", "source": "s"}

    def batch(*parts):
        full = [tuple({**base, **p}.get(c) for c in row) for p in parts]
        return spark.createDataFrame(full, items.schema)

    a, b = {"seq": -5, "visited_at": "2026-05-02T00:00:00"}, {"seq": -5, "visited_at": "2026-05-01T00:00:00"}
    got = [sorted(tuple(r) for r in visits.fold(state, batch(*x)).select("t", "accepted").collect()) for x in ([a, b], [b, a])]
    assert got[0] == got[1] and len(got[0]) == 2 and all(r[1] for r in got[0])
    with pytest.raises(Exception, match="without seq"):
        visits.fold(state, batch({"seq": None, "visited_at": "2026-05-02T00:00:00"})).collect()


def files_of(state):
    """Files that a state is read from, without their buckets."""
    return {f.split("/store/")[1].rsplit("/bucket=", 1)[0] for f in state.inputFiles()}


def test_compaction_bounds_what_a_batch_reads(spark, tmp_path):
    """Batch 50 reads at most the snapshot and the change folders since, and of these the buckets it touches."""
    state, items = made(9, 153)
    good = [i for i in items if i[3] != "bad"]
    store = VisitStore(spark, str(tmp_path / "store"), buckets=4, compact_every=20)
    store.seed(spark.createDataFrame(state, schemas.VISIT))
    size = -(-len(good) // 51)
    parts = [good[k : k + size] for k in range(0, len(good), size)]
    for k, part in enumerate(parts[:42]):  # the overwriting policy writes the same folders with less work
        VisitStore(spark, str(tmp_path / "store"), "overwrite", compact_every=20).apply(spark.createDataFrame(part, schemas.VISIT_ITEM), k)
    names = files_of(store.state((0, 42)))
    snapshots = {n for n in names if n.startswith("snapshots/")}
    assert len(snapshots) == 1 and len(names) <= 21 and store.manifest().snapshot.batch > 20
    want = {(r[0], r[1]): r[4] for r in state} | {(i[0], i[1]): i[4] for part in parts[:42] for i in part}
    assert {k: v[2] for k, v in read(store.state()).items()} == want

    bucket = store.state((0, 42), [2])
    assert all("/bucket=2/" in r[0] for r in bucket.select(F.input_file_name()).distinct().collect() if r[0])

    before = read(store.state())
    store.compact()
    assert read(store.state()) == before and len(files_of(store.state())) == 1
    store.vacuum()
    assert read(store.state()) == before
    assert len(list((tmp_path / "store" / "manifest").iterdir())) == 1
    assert not [p for p in (tmp_path / "store" / "changes").rglob("*.parquet")]
    store.apply(spark.createDataFrame(parts[3], schemas.VISIT_ITEM), 3)  # a batch the snapshot holds
    assert read(store.state()) == before


def test_compacted_stream_equals_fold(spark, tmp_path):
    state, items = made(10, 36)
    write(tmp_path / "queue", [items[k : k + 6] for k in range(0, 36, 6)])
    store = VisitStore(spark, str(tmp_path / "store"), buckets=3, compact_every=2)
    store.seed(spark.createDataFrame(state, schemas.VISIT))
    store.start(read_queue(spark, str(tmp_path / "queue"), 1), str(tmp_path / "progress")).awaitTermination()
    want, want_lost = fold(state, items)
    assert read(store.state()) == want and store.manifest().snapshot is not None
    assert sorted(r.seq for r in store.conflicts().collect()) == sorted(x[2] for x in want_lost)
    # a manifest that was not finished is passed over
    (tmp_path / "store" / "manifest" / "version=999999999999").mkdir()
    assert read(store.state()) == want


def test_keyed_state_equals_fold_and_resumes(spark, tmp_path):
    """States live in Spark's state store; a second start goes on from the stream's progress and repeats nothing."""
    from comarca.streaming.keyed import keyed_conflicts, keyed_state, start_keyed_sync

    state, items = made(11, 60)
    items = [(u, s, v, t, n, w, q + (1 << 60)) for u, s, v, t, n, w, q in items]  # beyond what a double holds
    stored = spark.createDataFrame(state, schemas.VISIT)
    results, progress = str(tmp_path / "results"), str(tmp_path / "progress")
    for upto in (25, 60, 60):
        parts = [items[:25], items[25:]] if upto == 60 else [items[:25]]
        write(tmp_path / "queue", parts)
        start_keyed_sync(read_queue(spark, str(tmp_path / "queue"), 1), stored, results, progress).awaitTermination()
        want, want_lost = fold(state, items[:upto])
        assert read(keyed_state(spark, results, stored)) == want
        lost = sorted((r.user_id, r.segment_id, r.seq, r.server_visited, r.server_notes) for r in keyed_conflicts(spark, results).collect())
        assert lost == want_lost


def test_keyed_merge_takes_many_keys_at_once():
    """What a group of the stream costs is paid for many keys, also null ones and ids beyond what a double holds."""
    from types import SimpleNamespace

    from pyspark.sql import Row

    from comarca.streaming.keyed import Merge

    class Map(dict):
        getValue, updateValue = dict.get, dict.__setitem__

    item = Row("user_id", "segment_id", "seq", "t", "visited", "notes", "source", "sent_at")
    big = (1 << 60) + 1
    merge, store = Merge(), Map()
    merge.init(SimpleNamespace(getMapState=lambda *_: store))
    merge.handleInitialState((0,), Row("user_id", "segment_id", "t", "visited", "notes", "source")("a", 1, 5, True, "old", "s"), None)
    rows = [item(u, s, 2, 4, True, None, "w", "4") for u, s in (("a", 1), ("a", big), (None, None))]
    rows += [item("a", big, 1, 7, None, "n", "w", "7"), item(None, None, 3, 4, False, "z", None, "4")]
    out = [tuple(r) for r in merge.handleInputRows((0,), iter(rows), None)]
    assert sorted(out, key=str) == sorted([
        ("a", 1, None, 2, True, 4, None, "w", "4", True, 5, "old"),
        ("a", big, None, 2, True, 4, None, "w", "4", None, 7, "n"),
        ("a", big, 1, None, None, 7, "n", "w", None, None, None, None),
        (None, None, 2, None, False, 4, "z", None, None, None, None, None),
    ], key=str)
    assert store == {("a", 1): (5, True, "old", "s", 0), ("a", big): (7, None, "n", "w", 1), (None, None): (4, False, "z", None, 2)}
