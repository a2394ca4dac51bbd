"""Visit state, offline queue and street segment queries over whole tables."""

from pyspark.sql import functions as F


from comarca.checks.registry import check
from comarca.functions import geo
from comarca.operators import filters, segments, visits

# fold of the queue into the server state, as a running maximum
MET = """
    SELECT *, max(struct_pack(t := t, seq := seq, visited := visited, notes := coalesce(notes, '')))
            OVER (PARTITION BY user_id, segment_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS met
    FROM (
        SELECT user_id, segment_id, -1 AS seq, visited_at AS t, visited, notes, source, NULL AS sent FROM {visits_server}
        UNION ALL
        SELECT user_id, segment_id, seq, TRY_CAST(rtrim(visited_at, 'Z') AS TIMESTAMP), visited, notes, source, visited_at
        FROM {visits_batch}
    ) AS a WHERE t IS NOT NULL"""
ISO = "CASE WHEN extract('microsecond' FROM {t}) % 1000000 = 0 THEN strftime({t}, '%Y-%m-%dT%H:%M:%S') ELSE strftime({t}, '%Y-%m-%dT%H:%M:%S.%f') END"


def _iso(column):
    return ISO.replace("{t}", column)


def streets(t):
    """Segments with their line as vertices."""
    vertex = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    return t.streets.withColumn("geom", F.array(vertex("ax", "ay"), vertex("bx", "by_"), vertex("cx", "cy")))


def state(t):
    return t.visits_server.withColumn("visited_at", F.col("visited_at").cast("timestamp"))


SHOWN = ["user_id", "segment_id", "visited", "notes", "source"]


@check("w5_lww_sync", f"""
    SELECT user_id, segment_id, seq, met IS NULL OR t >= met.t AS accepted FROM ({MET}) AS s WHERE seq >= 0""")
def w5(t):
    folded = visits.fold(state(t), t.visits_batch)
    return folded.select("user_id", "segment_id", "seq", "accepted")


@check("a15_sync_conflicts", f"""
    SELECT user_id, segment_id, seq, visited AS client_visited, sent AS client_visited_at, met.visited AS server_visited,
        {_iso('met.t')} AS server_visited_at, nullif(met.notes, '') AS server_notes
    FROM ({MET}) AS s WHERE seq >= 0 AND t < met.t""")
def a15(t):
    return visits.conflicts(visits.fold(state(t), t.visits_batch))


@check("a15_sync_outcome", f"""
    SELECT count(*) FILTER (met IS NULL OR t >= met.t) AS synced, count(*) FILTER (t < met.t) AS conflicts
    FROM ({MET}) AS s WHERE seq >= 0""")
def a15_outcome(t):
    return visits.outcome(visits.fold(state(t), t.visits_batch))


@check("j9_synced_state", f"""
    SELECT user_id, segment_id, visited, {_iso('t')} AS visited_at, notes, source FROM (
        SELECT *, row_number() OVER (PARTITION BY user_id, segment_id ORDER BY t DESC, seq DESC) AS r FROM ({MET}) AS s) AS x
    WHERE r = 1""")
def j9(t):
    from comarca.functions.text import iso

    new, _, _ = visits.sync_visits(state(t), t.visits_batch)
    return new.select("user_id", "segment_id", "visited", iso("visited_at").alias("visited_at"), "notes", "source")


@check("w4_queue_keep_last", """
    SELECT user_id, segment_id, seq, visited_at FROM (
        SELECT *, row_number() OVER (PARTITION BY user_id, segment_id ORDER BY seq DESC) AS r FROM {visits_batch}) AS s WHERE r = 1""")
def w4(t):
    return visits.latest_queued(t.visits_batch).select("user_id", "segment_id", "seq", "visited_at")


@check("t2_overwrite", """
    SELECT user_id, segment_id, visited, notes, source FROM (
        SELECT *, row_number() OVER (PARTITION BY user_id, segment_id ORDER BY seq DESC) AS r FROM {visits_batch}
        WHERE visited_at <> 'not a time') AS s WHERE r = 1
    UNION ALL SELECT user_id, segment_id, visited, notes, source FROM {visits_server} AS v WHERE NOT EXISTS (
        SELECT 1 FROM {visits_batch} AS b WHERE b.user_id = v.user_id AND b.segment_id = v.segment_id AND visited_at <> 'not a time')""")
def t2(t):
    items = t.visits_batch.where("visited_at <> 'not a time'")
    return visits.upsert_visits(state(t), items).select(*SHOWN)


@check("t1_stream_sync", f"""
    SELECT user_id, segment_id, visited, {_iso('t')} AS visited_at, notes, source FROM (
        SELECT *, row_number() OVER (PARTITION BY user_id, segment_id ORDER BY t DESC, seq DESC) AS r FROM ({MET}) AS s) AS x
    WHERE r = 1""")
def t1(t):
    """The queue as a file stream, merged micro-batch by micro-batch in the shared folder, read from a snapshot."""
    import uuid

    from comarca.functions.text import iso
    from comarca.session import checkpoint_dir
    from comarca.streaming.visits import VisitStore, read_queue

    root = f"{checkpoint_dir(t.spark)}/visit-sync-{uuid.uuid4().hex}"
    t.visits_batch.write.json(f"{root}/queue")
    store = VisitStore(t.spark, f"{root}/store")
    store.seed(state(t))
    store.start(read_queue(t.spark, f"{root}/queue"), f"{root}/progress").awaitTermination()
    store.compact()
    return store.state().select("user_id", "segment_id", "visited", iso("visited_at").alias("visited_at"), "notes", "source")


SYNCED = f"""SELECT user_id, segment_id, visited, {_iso('t')} AS visited_at, notes, source FROM (
        SELECT *, row_number() OVER (PARTITION BY user_id, segment_id ORDER BY t DESC, seq DESC) AS r FROM ({MET}) AS s) AS x
    WHERE r = 1"""


def _keyed(t):
    import uuid

    from comarca.session import checkpoint_dir
    from comarca.streaming.keyed import start_keyed_sync
    from comarca.streaming.visits import read_queue

    root = f"{checkpoint_dir(t.spark)}/visit-keys-{uuid.uuid4().hex}"
    t.visits_batch.write.json(f"{root}/queue")
    queue = read_queue(t.spark, f"{root}/queue")
    start_keyed_sync(queue, state(t), f"{root}/results", f"{root}/progress").awaitTermination()
    return f"{root}/results"


@check("t1_keyed_state", SYNCED)
def t1_keyed(t):
    """The queue as a stream over one state per user and segment, which starts from the stored visits."""
    from comarca.functions.text import iso
    from comarca.streaming.keyed import keyed_state

    rows = keyed_state(t.spark, _keyed(t), state(t))
    return rows.select("user_id", "segment_id", "visited", iso("visited_at").alias("visited_at"), "notes", "source")


@check("t1_keyed_conflicts", f"""
    SELECT user_id, segment_id, seq, visited AS client_visited, sent AS client_visited_at, met.visited AS server_visited,
        {_iso('met.t')} AS server_visited_at, nullif(met.notes, '') AS server_notes
    FROM ({MET}) AS s WHERE seq >= 0 AND t < met.t""")
def t1_keyed_lost(t):
    from comarca.streaming.keyed import keyed_conflicts

    return keyed_conflicts(t.spark, _keyed(t))


@check("a19_waiting", "SELECT user_id, count(*) AS waiting FROM {visits_batch} GROUP BY user_id")
def a19(t):
    return visits.waiting_counts(t.visits_batch)


@check("p19_of_user", "SELECT user_id, segment_id FROM {visits_server} WHERE user_id = '7'")
def p19(t):
    return filters.of_user(t.visits_server, "7").select("user_id", "segment_id")


BASE = """s.id, s.osm_id, CASE WHEN coalesce(name, '') = '' THEN 'Calle sin nombre' ELSE name END AS name,
    coalesce(length_m, 0.0) AS length_m"""


@check("j3_segments_with_visits", f"""
    SELECT {BASE}, coalesce(v.visited, FALSE) AS visited_by_user, v.notes, {_iso('v.visited_at')} AS visited_at
    FROM {{streets}} AS s LEFT JOIN {{visits_server}} AS v ON v.segment_id = s.id AND v.user_id = '7'""")
def j3(t):
    return segments.with_visits(streets(t), state(t), "7").drop("geom")


@check("j3_segments_anonymous", f"""
    SELECT {BASE}, FALSE AS visited_by_user, CAST(NULL AS VARCHAR) AS notes, CAST(NULL AS VARCHAR) AS visited_at FROM {{streets}} AS s""")
def j3_anonymous(t):
    return segments.with_visits(streets(t), state(t)).drop("geom")


@check("j4_visits_with_segments", f"""
    SELECT v.user_id, v.segment_id, v.visited, {_iso('v.visited_at')} AS visited_at, v.notes, v.source, s.name AS street_name,
        coalesce(s.length_m, 0.0) AS length_m
    FROM {{visits_server}} AS v JOIN {{streets}} AS s ON v.segment_id = s.id""")
def j4(t):
    return segments.visits_with_segments(state(t), streets(t)).drop("geom")


NUMBERED = "CAST(user_id AS BIGINT) * 1000000 + segment_id"


@check("j4_visit_records", f"""
    SELECT CAST(v.user_id AS BIGINT) * 1000000 + v.segment_id AS id, v.user_id, v.segment_id, v.visited, {_iso('v.visited_at')} AS visited_at,
        v.notes, v.source, s.name AS street_name, coalesce(s.length_m, 0.0) AS length_m, 'LineString' AS kind, 3 AS vertices,
        ax AS x, cy AS y
    FROM {{visits_server}} AS v JOIN {{streets}} AS s ON v.segment_id = s.id""")
def j4_records(t):
    rows = segments.visit_records(state(t).withColumn("id", F.expr(NUMBERED)), streets(t))
    member = lambda m: F.get_json_object("geometry", f"$.{m}")
    return rows.select(
        *[c for c in rows.columns if c != "geometry"], member("type").alias("kind"),
        F.size(F.from_json(member("coordinates"), "array<array<double>>")).alias("vertices"),
        member("coordinates[0][0]").cast("double").alias("x"), member("coordinates[2][1]").cast("double").alias("y"),
    )


@check("k4_segment_features", f"""
    SELECT 'Feature' AS type, 'LineString' AS geometry, {BASE}, coalesce(v.visited, FALSE) AS visited_by_user, v.notes,
        {_iso('v.visited_at')} AS visited_at, ax AS x, cy AS y, TRUE AS has_notes
    FROM {{streets}} AS s LEFT JOIN {{visits_server}} AS v ON v.segment_id = s.id AND v.user_id = '7'""")
def k4_segments(t):
    import uuid

    from comarca.session import checkpoint_dir
    from comarca.sources import writers

    path = f"{checkpoint_dir(t.spark)}/segment-features-{uuid.uuid4().hex}"
    writers.write_features(writers.segment_features(segments.with_visits(streets(t), state(t), "7")), path, nulls=True)
    member = lambda m: F.get_json_object("value", f"$.{m}")
    own = lambda m, kind: member(f"properties.{m}").cast(kind).alias(m)
    return t.spark.read.text(path).select(
        member("type").alias("type"), member("geometry.type").alias("geometry"), own("id", "long"), own("osm_id", "long"),
        own("name", "string"), own("length_m", "double"), own("visited_by_user", "boolean"), own("notes", "string"),
        own("visited_at", "string"), member("geometry.coordinates[0][0]").cast("double").alias("x"),
        member("geometry.coordinates[2][1]").cast("double").alias("y"), F.col("value").contains('"notes":').alias("has_notes"),
    )


# an edge meets a closed rectangle: bounds overlap and the corners are not all on one side
EDGE = """(greatest({ax}, {bx}) >= x1 AND least({ax}, {bx}) <= x2 AND greatest({ay}, {by}) >= y1 AND least({ay}, {by}) <= y2
    AND least(({bx}-{ax})*(y1-{ay})-({by}-{ay})*(x1-{ax}), ({bx}-{ax})*(y2-{ay})-({by}-{ay})*(x1-{ax}),
        ({bx}-{ax})*(y1-{ay})-({by}-{ay})*(x2-{ax}), ({bx}-{ax})*(y2-{ay})-({by}-{ay})*(x2-{ax})) <= 0
    AND greatest(({bx}-{ax})*(y1-{ay})-({by}-{ay})*(x1-{ax}), ({bx}-{ax})*(y2-{ay})-({by}-{ay})*(x1-{ax}),
        ({bx}-{ax})*(y1-{ay})-({by}-{ay})*(x2-{ax}), ({bx}-{ax})*(y2-{ay})-({by}-{ay})*(x2-{ax})) >= 0)"""


def _edge(a, b):
    text = EDGE
    for k, v in zip(("ax", "ay", "bx", "by"), (*a, *b)):
        text = text.replace("{" + k + "}", v)
    return text


HITS = f"({_edge(('ax', 'ay'), ('bx', 'by_'))} OR {_edge(('bx', 'by_'), ('cx', 'cy'))})"
WINDOW = "(SELECT 3.5 AS x1, 2.25 AS y1, 17.75 AS x2, 9.5 AS y2)"


@check("p15_box", f"SELECT id FROM {{streets}}, {WINDOW} AS w WHERE {HITS}")
def p15(t):
    return segments.in_box(streets(t), "17.75,2.25,3.5,9.5").select("id")


@check("p16_parsed_box", f"SELECT id FROM {{streets}}, {WINDOW} AS w WHERE {HITS}")
def p16(t):
    box = geo.parse_box("3.5,2.25,17.75,9.5")
    return segments.in_box(streets(t), box).select("id")


@check("g3_line_hits_box", f"SELECT id, {HITS} AS hit FROM {{streets}}, {WINDOW} AS w")
def g3(t):
    return streets(t).select("id", geo.line_hits_box("geom", 3.5, 2.25, 17.75, 9.5).alias("hit"))


@check("j10_box_join", f"SELECT box_id, id FROM {{streets}}, {{windows}} WHERE {HITS}")
def j10(t):
    return segments.box_join(streets(t), t.windows)


@check("j10_box_join_split", f"SELECT box_id, id FROM {{streets}}, {{windows}} WHERE {HITS}")
def j10_split(t):
    """The same pairs where nearly every cell counts as crowded."""
    return segments.box_join(streets(t), t.windows, pairs=20)


@check("p15_box_stored", f"SELECT id FROM {{streets}}, {WINDOW} AS w WHERE {HITS}")
def p15_stored(t):
    """A box over segments stored in the order of their places."""
    import uuid

    from comarca.session import checkpoint_dir

    path = f"{checkpoint_dir(t.spark)}/places-{uuid.uuid4().hex}"
    segments.write_by_place(streets(t), path)
    return segments.in_box(t.spark.read.parquet(path), "3.5,2.25,17.75,9.5").select("id")


@check("s4_segments_of_user_in_box", f"""
    SELECT {BASE}, coalesce(v.visited, FALSE) AS visited_by_user
    FROM (SELECT * FROM {{streets}}, {WINDOW} AS w WHERE {HITS}) AS s
    LEFT JOIN {{visits_server}} AS v ON v.segment_id = s.id AND v.user_id = '7'""")
def s4(t):
    return segments.segments_in(streets(t), state(t), "3.5,2.25,17.75,9.5", "7").drop("geom", "notes", "visited_at")


@check("p19_user_visits_in_box", f"""
    SELECT v.segment_id, v.visited FROM {{visits_server}} AS v
    JOIN (SELECT id FROM {{streets}}, {WINDOW} AS w WHERE {HITS}) AS s ON v.segment_id = s.id WHERE v.user_id = '7'""")
def p19_box(t):
    return segments.user_visits(state(t), streets(t), "7", "3.5,2.25,17.75,9.5").select("segment_id", "visited")


@check("j12_known_visits", """
    SELECT event_id, segment_id FROM {events_keyed} WHERE segment_id IN (SELECT id FROM {streets} WHERE id % 3 <> 0)""")
def j12(t):
    kept = t.streets.where("id % 3 <> 0")
    return segments.known_visits(t.events_keyed, kept).select("event_id", "segment_id")


@check("j12_orphan_visits", """
    SELECT event_id, segment_id FROM {events_keyed} WHERE segment_id NOT IN (SELECT id FROM {streets} WHERE id % 3 <> 0)""")
def j12_orphans(t):
    kept = t.streets.where("id % 3 <> 0")
    return segments.orphan_visits(t.events_keyed, kept).select("event_id", "segment_id")


@check("j11_selected", "SELECT id, id IN (SELECT segment_id FROM {visits_server} WHERE visited) AS selected FROM {streets}")
def j11(t):
    chosen = t.visits_server.where("visited").select(F.col("segment_id").alias("id"))
    return segments.mark_selected(t.streets, chosen).select("id", "selected")


@check("u3_toggle", """
    (SELECT segment_id AS id FROM {visits_server} WHERE user_id = '7' EXCEPT SELECT p_partkey FROM {part} WHERE p_size = 9)
    UNION ALL (SELECT p_partkey FROM {part} WHERE p_size = 9 EXCEPT SELECT segment_id FROM {visits_server} WHERE user_id = '7')""")
def u3(t):
    current = t.visits_server.where("user_id = '7'").select(F.col("segment_id").alias("id"))
    return segments.toggle(current, t.part.where("p_size = 9").select(F.col("p_partkey").alias("id")))


@check("u4_more_rows", "SELECT id FROM {streets} ORDER BY id LIMIT 60")
def u4(t):
    from comarca.operators.analytics import page

    return page(t.streets, "id", 60).select("id")


@check("j13_overlay_pending", """
    SELECT s.user_id, s.segment_id, coalesce(q.visited, s.visited) AS visited FROM {visits_server} AS s LEFT JOIN (
        SELECT *, row_number() OVER (PARTITION BY user_id, segment_id ORDER BY seq DESC) AS r FROM {visits_batch}) AS q
    ON q.user_id = s.user_id AND q.segment_id = s.segment_id AND q.r = 1""")
def j13(t):
    waiting = visits.latest_queued(t.visits_batch)
    return segments.overlay_pending(t.visits_server, waiting).select("user_id", "segment_id", "visited")
