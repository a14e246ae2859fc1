"""States, guards, progress streams and registries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuemill import adapters as A
from cuemill.functions.clips import render_key
from cuemill.functions.progress import clamped
from cuemill.operators import clips as C
from cuemill.operators import ordered as O
from cuemill.operators import projects as P
from cuemill.operators import states as S
from cuemill.queries.base import may_pass, query, sql, trim
from cuemill.schema import GUARDS, TRANSITIONS
from cuemill.session import work_dir
from cuemill.sources.events import event_text, parse_events
from cuemill.streaming import progress as live

#: The state machine as a fold over a session's requests.
RUN = {
    "asked": "SELECT session_id, list({'new': new_state, 'now': '', 'was': []::VARCHAR[]} ORDER BY ts, event_id) AS xs FROM requests GROUP BY session_id",
    "ran": f"""SELECT session_id, list_reduce(list_prepend({{'new': '', 'now': 'IDLE', 'was': []::VARCHAR[]}}, xs), lambda s, x:
        {{'new': x.new, 'now': CASE WHEN {may_pass('s.now', 'x.new')} THEN x.new ELSE s.now END, 'was': list_append(s.was, s.now)}}).was AS was, [x.new for x in xs] AS news FROM asked""",
    "steps": "SELECT session_id, CAST(generate_subscripts(was, 1) - 1 AS INTEGER) AS seq, unnest(news) AS new_state, unnest(was) AS was FROM ran",
}
STEPS = f"""SELECT session_id, seq, new_state, {may_pass('was', 'new_state')} AS accepted, CASE WHEN {may_pass('was', 'new_state')} THEN new_state ELSE was END AS state,
    CASE WHEN NOT {may_pass('was', 'new_state')} THEN 'Invalid transition: ' || was || ' → ' || new_state END AS error FROM steps"""


@query(sql("requests", STEPS, **RUN))
def g04_state_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.run_states(A.requests(spark, sf_dir))


@query(
    f"""SELECT event_id, state, new_state, {may_pass('state', 'new_state')} AS allowed FROM (SELECT event_id, {list(TRANSITIONS)}[event_id % 7 + 1] AS state, {list(TRANSITIONS)}[event_id // 7 % 7 + 1] AS new_state FROM events)"""
)
def d12_allowed_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    names, n = F.array(*map(F.lit, TRANSITIONS)), F.col("event_id")
    rows = A.table(spark, sf_dir, "events").select("event_id", F.get(names, (n % 7).cast("int")).alias("state"), F.get(names, F.floor(n / 7 % 7).cast("int")).alias("new_state"))
    return S.allowed(rows).select("event_id", "state", "new_state", "allowed")


_OPS = [*GUARDS, "other"]


@query(
    f"""SELECT event_id, op, state, CASE WHEN op = 'other' THEN 400 WHEN event_id % 11 = 0 THEN 404 WHEN (op || '>' || state) IN {tuple(f'{k}>{v}' for k, v in GUARDS.items())} THEN 200 ELSE 409 END AS status
    FROM (SELECT event_id, {_OPS}[event_id % {len(_OPS)} + 1] AS op, {list(TRANSITIONS)}[event_id // 7 % 7 + 1] AS state FROM events)"""
)
def c11_state_guards(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id")
    rows = A.table(spark, sf_dir, "events").select(
        "event_id",
        F.get(F.array(*map(F.lit, _OPS)), (n % len(_OPS)).cast("int")).alias("op"),
        F.get(F.array(*map(F.lit, TRANSITIONS)), F.floor(n / 7 % 7).cast("int")).alias("state"),
        (n % 11 != 0).alias("session_exists"),
    )
    return S.guarded(rows).select("event_id", "op", "state", "status")


@query(sql("requests", "SELECT session_id, max(ts)::TIMESTAMP AS ts, max_by(event_id, struct_pack(ts := ts, e := event_id)) AS event_id, max_by(new_state, struct_pack(ts := ts, e := event_id)) AS new_state FROM requests GROUP BY session_id"))
def i02_latest_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.latest(A.requests(spark, sf_dir))
    return rows.select("session_id", F.col("ts").cast("timestamp_ntz").alias("ts"), "event_id", "new_state")


_SAVES = """SELECT session_id, CAST(save_no AS INTEGER) AS save_no, count(*) AS n_events, max_by(event_id, struct_pack(ts := ts, e := event_id)) AS last_event, max(ts) + INTERVAL 7200 SECOND AS saved_at FROM (
    SELECT *, sum(CASE WHEN gap THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS save_no FROM (
        SELECT *, coalesce(epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY session_id ORDER BY ts, event_id)) >= 7200000000, false) AS gap FROM requests)) GROUP BY session_id, save_no"""


@query(sql("requests", _SAVES))
def i04_quiet_saves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Debounced saves, in batch form; the events are hours apart, so the quiet time is two hours here."""
    rows = S.quiet_saves(A.requests(spark, sf_dir), quiet_ms=7_200_000)
    return rows.withColumn("saved_at", F.col("saved_at").cast("timestamp_ntz"))


def _renders(rows: DataFrame) -> DataFrame:
    """Starts and ends of renders of four clips a session."""
    kind = F.when(F.col("new_state") == "READY", "done").otherwise("start")
    return rows.select("session_id", "ts", "event_id", F.concat(F.lit("clip"), F.col("event_id") % 4).alias("render_key"), kind.alias("kind"))


@query(
    sql(
        "requests",
        """SELECT session_id, render_key, event_id, row_number() OVER (PARTITION BY session_id, render_key, run ORDER BY ts, event_id) = 1 AS accepted FROM (
        SELECT *, coalesce(sum(CASE WHEN kind = 'done' THEN 1 ELSE 0 END) OVER (PARTITION BY session_id, render_key ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS run FROM r) WHERE kind = 'start'""",
        r="SELECT session_id, ts, event_id, 'clip' || (event_id % 4) AS render_key, CASE WHEN new_state = 'READY' THEN 'done' ELSE 'start' END AS kind FROM requests",
    )
)
def i07_accepted_renders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.accepted_renders(_renders(A.requests(spark, sf_dir))).select("session_id", "render_key", "event_id", "accepted")


@query(
    sql(
        "requests",
        """SELECT session_id, render_key, event_id, CASE WHEN status = 'exported' AND before IS DISTINCT FROM 'exported' THEN 'finished' WHEN status IS NULL AND before = 'rendering' THEN 'failed' END AS outcome
        FROM (SELECT *, lag(coalesce(status, 'gone')) OVER (PARTITION BY session_id, render_key ORDER BY ts, event_id) AS before FROM r)
        WHERE (status = 'exported' AND before IS DISTINCT FROM 'exported') OR (status IS NULL AND before = 'rendering')""",
        r="SELECT session_id, ts, event_id, 'clip' || (event_id % 4) AS render_key, CASE WHEN new_state = 'READY' THEN 'exported' WHEN new_state <> 'IDLE' THEN 'rendering' END AS status FROM requests",
    )
)
def i08_batch_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("new_state") == "READY", "exported").when(F.col("new_state") != "IDLE", "rendering")
    rows = A.requests(spark, sf_dir).select("session_id", "ts", "event_id", F.concat(F.lit("clip"), F.col("event_id") % 4).alias("render_key"), status.alias("status"))
    return S.batch_steps(rows).select("session_id", "render_key", "event_id", "outcome")


@query("SELECT event_id, user_id AS session_id, greatest(0.0::DOUBLE, least(100.0::DOUBLE, value - 20)) AS progress, event_type AS message FROM events WHERE event_id % 5 > 1")
def a19_event_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events written as text and read again (A18, A19, I01); every fifth is broken, every fifth has no data."""
    rows = A.table(spark, sf_dir, "events")
    body = event_text(F.struct(F.col("user_id").cast("string").alias("sessionId"), F.lit("READY").alias("state"), clamped(F.col("value") - 20).alias("progress"), F.col("event_type").alias("message")))
    body = F.when(F.col("event_id") % 5 == 0, "data: {broken\n\n").when(F.col("event_id") % 5 == 1, ": ping\n\n").otherwise(F.concat(F.lit("event: x\n"), body, F.lit("data: {\"sessionId\": \"cut")))
    read = parse_events(rows.select("event_id", body.alias("body")))
    return read.select("event_id", F.col("event.sessionId").cast("long").alias("session_id"), "event.progress", "event.message")


# Streams, run over everything that is there


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The requests of :func:`cuemill.adapters.requests` as a stream."""
    kinds = F.create_map(*[F.lit(x) for pair in A.REQUESTS.items() for x in pair])
    rows = live.read_progress(spark, f"{sf_dir}/events.parquet*")
    return rows.select(F.col("user_id").alias("session_id"), "ts", "event_id", kinds[F.col("event_type")].alias("new_state"))


@query(
    """WITH e AS (SELECT user_id AS session_id, event_id, ts, greatest(0.0::DOUBLE, least(100.0::DOUBLE, value - 20)) AS progress, event_type AS message FROM events),
    s AS (SELECT DISTINCT session_id, TIMESTAMP '2024-01-08' + to_hours(CAST(session_id % 100 AS INTEGER)) AS joined FROM e),
    j AS (SELECT e.*, ts > joined AS later FROM e JOIN s USING (session_id))
    SELECT session_id, event_id, CASE WHEN later THEN 'event' ELSE 'snapshot' END AS kind, progress, message FROM j
    QUALIFY later OR row_number() OVER (PARTITION BY session_id, later ORDER BY ts DESC, event_id DESC) = 1"""
)
def a18_subscriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text that a subscriber of each session gets (A18): a snapshot when it connects, then the session's events from a stream; read again."""
    at = work_dir(spark, "heard")
    connected = F.lit("2024-01-08").cast("timestamp") + F.make_dt_interval(hours=(F.col("session_id") % 100).cast("int"))
    flat = lambda rows: rows.select(F.col("user_id").alias("session_id"), "event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")
    table = flat(A.table(spark, sf_dir, "events"))
    subscribers = table.select("session_id").distinct().select(F.col("session_id").alias("subscriber"), "session_id", connected.alias("connected_at"))
    row = F.struct(F.col("session_id").cast("string").alias("sessionId"), F.lit("READY").alias("state"), clamped(F.col("value") - 20).alias("progress"), F.col("event_type").alias("message"))
    stream = live.to_events(live.heard(flat(live.read_progress(spark, f"{sf_dir}/events.parquet*")), subscribers), row, "event_id")
    texts = live.drained(stream, f"{at}/out", f"{at}/log").withColumn("kind", F.lit("event"))
    texts = texts.unionByName(live.to_events(live.on_connect(table, subscribers), row, "event_id").withColumn("kind", F.lit("snapshot")))
    read = parse_events(texts, "value")
    return read.select("session_id", "event_id", "kind", "event.progress", "event.message")


@query(sql("requests", "SELECT session_id, max_by(event_id, struct_pack(ts := ts, e := event_id)) AS event_id, max_by(new_state, struct_pack(ts := ts, e := event_id)) AS new_state FROM requests GROUP BY session_id"))
def i05_serial_saves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table that batch after batch of a stream leaves: each session's newest event."""
    at = work_dir(spark, "saves")
    query_ = live.serial_saves(_stream(spark, sf_dir), f"{at}/out", f"{at}/log")
    query_.awaitTermination()
    return live.saved(spark, f"{at}/out").select("session_id", "event_id", "new_state")


@query(
    sql(
        "requests",
        f"SELECT session_id, n_events, last_event FROM ({_SAVES}) WHERE saved_at <= (SELECT date_trunc('milliseconds', max(ts)) - INTERVAL 600 SECOND FROM requests)",
    )
)
def i04_stream_saves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Debounced saves by session windows (I04); windows that the watermark has not passed stay open."""
    at = work_dir(spark, "quiet")
    return live.drained(live.saves(_stream(spark, sf_dir), "2 hours"), f"{at}/out", f"{at}/log").drop("saved_at")


@query(sql("requests", "SELECT DISTINCT session_id, 'clip' || (event_id % 4) AS render_key FROM requests WHERE new_state <> 'READY'"))
def i07_stream_first_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One request of each clip while the watermark holds it (I07); all that is there comes in one batch, before which there is no watermark."""
    at = work_dir(spark, "first")
    rows = _renders(_stream(spark, sf_dir)).where("kind = 'start'")
    return live.drained(live.first_requests(rows), f"{at}/out", f"{at}/log").select("session_id", "render_key")


# Registries and files


@query(sql("laid renders", "SELECT r.project_id, r.file, coalesce(nullif(substr(" + trim("regexp_replace(title, '[^0-9A-Za-z_\\- ]', '_', 'g')") + ", 1, 60), ''), r.render_key) || '.mp4' AS filename FROM (SELECT project_id, render_key, 'output_' || render_key || '.mp4' AS file FROM renders) r LEFT JOIN laid l ON r.project_id = l.project_id AND r.render_key = l.render_key AND l.pos % 2 = 0"))
def d02_download_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rendered files of clips; those of every second clip find no title."""
    clips = A.clips(spark, sf_dir)
    files = A.renders_of(clips).select("project_id", F.concat(F.lit("output_"), "render_key", F.lit(".mp4")).alias("file"))
    files = files.unionByName(files.withColumn("file", F.lit("input.mp4")))
    named = C.with_layout(clips, A.FPS).where("pos % 2 = 0").select("project_id", "pos", "render_key", "title")
    return P.download_names(files, named)


@query("SELECT page_id FROM pages WHERE page_id NOT IN (SELECT event_id * 3 FROM events)")
def d03_orphaned_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    registry = A.table(spark, sf_dir, "events").select((F.col("event_id") * 3).alias("page_id"))
    return P.orphaned(A.table(spark, sf_dir, "pages").select("page_id"), registry, "page_id")


@query(sql("renders", "SELECT project_id, render_key, status FROM renders WHERE (status = 'exported' AND project_id % 2 = 0) OR (status = 'rendering' AND project_id % 3 = 0)"))
def d04_synced_renders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of every second project are there; every third project renders."""
    renders = A.renders_of(A.clips(spark, sf_dir))
    files = renders.where("project_id % 2 = 0").select("project_id", F.concat(F.lit("output_"), "render_key", F.lit(".mp4")).alias("file"))
    return P.synced_renders(renders, files, renders.where("project_id % 3 = 0").select("project_id"))


@query(sql("registry", "SELECT project_id, project_path FROM registry WHERE project_id NOT IN ('p5', 'p11')"))
def d13_removed_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By id."""
    rows = A.registry(spark, sf_dir)
    return P.removed(rows, spark.createDataFrame([("p5",), ("p11",)], "project_id string")).select("project_id", "project_path")


@query(
    sql(
        "registry",
        """SELECT project_path, CASE WHEN m THEN coalesce(CASE WHEN n % 5 > 0 THEN 'From file ' || n END, video_name) ELSE video_name END AS video_name,
        CASE WHEN m THEN 'ALIGNING' ELSE state END AS state, n % 2 > 0 AS missing
        FROM (SELECT *, entry_no AS n, entry_no % 2 = 0 AND (video_name IS NULL OR thumbnail IS NULL) AS m
              FROM (SELECT * REPLACE (project_path || '-' || entry_no AS project_path) FROM registry))""",
    )
)
def d14_checked_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A registry with a path for every use; the archives of every second one are there."""
    n = F.col("entry_no")
    rows = A.registry(spark, sf_dir).withColumn("project_path", F.concat("project_path", F.lit("-"), n)).withColumn("missing", F.lit(False))
    files = rows.where("entry_no % 2 = 0").select(
        "project_path", F.when(n % 5 > 0, F.concat(F.lit("From file "), n)).alias("video_name"), F.lit("ALIGNING").alias("state"), F.lit(None).cast("string").alias("updated_at")
    )
    return P.checked_registry(rows.drop("ts", "entry_no"), files).select("project_path", "video_name", "state", "missing")
