"""Streams that keep order by event-time timers (I03, I04, I05, I08, A18), over files in shuffled order, a slice of time to a batch."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuemill import adapters as A
from cuemill.adapters import REQUESTS
from cuemill.functions.progress import clamped
from cuemill.queries.base import ORACLE_SQL, query, sql
from cuemill.queries.states import RUN, STEPS
from cuemill.session import input_bytes, work_dir
from cuemill.sources.events import event_text, parse_events
from cuemill.streaming import ordered as live
from cuemill.streaming.progress import drained as run_out, read_progress

#: Files that the events' time is cut into, and bytes of input files for a state that sessions share (some ten thousand events).
SLICES, SHARE_BYTES = 6, 256 << 10


def shuffled(events: DataFrame, path: str) -> str:
    """Writes ``events`` as files that overlap in time, then one event that is late enough to end the stream; returns by how much rows come late.

    A row goes to the file of its slice of time or to the next one, so that each
    file holds rows older than half of those of the file before.
    """
    lo, hi = events.agg(F.min(F.unix_micros("ts")), F.max(F.unix_micros("ts"))).first()
    step = max((hi - lo) // SLICES, 1)
    delay = 2 * math.ceil(step / 1_000_000) + 1
    no = F.least(F.floor((F.unix_micros("ts") - lo) / step), F.lit(SLICES - 1)) + F.pmod(F.xxhash64("event_id"), F.lit(2))
    files = events.sparkSession.sparkContext.defaultParallelism
    for k in range(SLICES + 1):
        events.where(no == k).repartition(files).write.mode("append").parquet(path)
    events.limit(1).withColumn("ts", F.timestamp_micros(F.lit(hi + 2 * delay * 1_000_000))).write.mode("append").parquet(path)
    return f"{delay} seconds"


def drained(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """:func:`cuemill.streaming.progress.drained`, with a partition of state for each core: every batch opens and commits them all."""
    spark, name = stream.sparkSession, "spark.sql.shuffle.partitions"
    before = spark.conf.get(name)
    spark.conf.set(name, str(spark.sparkContext.defaultParallelism))
    try:
        return run_out(stream, path, checkpoint)
    finally:
        spark.conf.set(name, before)


def _files(spark: SparkSession, sf_dir: str, at: str, where: str = "true", name: str = "events") -> tuple[DataFrame, str]:
    """The events as a stream over shuffled files, and the delay that its order needs."""
    rows = A.table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")).where(where)
    delay = shuffled(rows, f"{at}/{name}")
    # a slice is a batch, whatever files the events come in
    files = str(spark.sparkContext.defaultParallelism)
    return read_progress(spark, f"{at}/{name}", maxFilesPerTrigger=files).withColumnRenamed("user_id", "session_id"), delay


def _shares(spark: SparkSession, sf_dir: str) -> int:
    """States that the sessions are dealt over: a few for each core, and more as the events grow."""
    return max(4 * spark.sparkContext.defaultParallelism, -(-input_bytes(A.table(spark, sf_dir, "events")) // SHARE_BYTES))


@query(sql("requests", STEPS, **RUN))
def i03_stream_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state machine with state kept by the stream: the same rows as in batch form, whatever the files' order."""
    at = work_dir(spark, "states")
    rows, delay = _files(spark, sf_dir, at)
    kinds = F.create_map(*[F.lit(x) for pair in REQUESTS.items() for x in pair])
    requests = rows.select("session_id", "ts", "event_id", kinds[F.col("event_type")].alias("new_state"))
    return drained(live.states(requests, delay, shares=_shares(spark, sf_dir)), f"{at}/out", f"{at}/log")


@query(
    """WITH n AS (SELECT user_id AS session_id, ts, event_id, event_type = 'purchase' AS at_once, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS later FROM events),
    m AS (SELECT *, CASE WHEN at_once THEN ts WHEN later IS NULL OR epoch_us(later) - epoch_us(ts) >= 7200000000 THEN ts + INTERVAL 2 HOUR END AS saved FROM n),
    g AS (SELECT *, coalesce(sum(CASE WHEN saved IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY session_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS no FROM m)
    SELECT session_id, max(saved) AS saved_at, CASE WHEN bool_or(at_once) THEN 'immediate' ELSE 'quiet' END AS kind, count(*) AS n_events,
           max_by(event_id, struct_pack(ts := ts, e := event_id)) AS last_event FROM g GROUP BY session_id, no"""
)
def i05_debounced_saves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Saves two hours after the last change (I04), and at once on a purchase, which cancels the one that waits."""
    at = work_dir(spark, "debounced")
    rows, delay = _files(spark, sf_dir, at)
    changes = rows.select("session_id", "ts", "event_id", (F.col("event_type") == "purchase").alias("at_once"))
    saves = drained(live.debounced_saves(changes, delay, 7_200_000, _shares(spark, sf_dir)), f"{at}/out", f"{at}/log")
    return saves.withColumn("saved_at", F.col("saved_at").cast("timestamp_ntz"))


@query(
    """WITH e AS (SELECT user_id AS session_id, ts, event_id, greatest(0.0::DOUBLE, least(100.0::DOUBLE, value - 20)) AS progress, event_type AS message FROM events WHERE event_type <> 'signup'),
    c AS (SELECT user_id AS session_id, ts AS since, event_id AS subscriber FROM events WHERE event_type = 'signup'),
    j AS (SELECT c.session_id, subscriber, since, e.ts, event_id, progress, message, e.ts > since OR (e.ts = since AND event_id > subscriber) AS later FROM c JOIN e ON c.session_id = e.session_id)
    SELECT session_id, subscriber, 'event' AS kind, event_id, progress, message FROM j WHERE later AND ts < since + INTERVAL 24 HOUR
    UNION ALL
    SELECT session_id, subscriber, 'snapshot' AS kind, event_id, progress, message FROM (
        SELECT *, row_number() OVER (PARTITION BY subscriber ORDER BY ts DESC, event_id DESC) AS n FROM j WHERE NOT later) WHERE n = 1"""
)
def a18_live_subscriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Connections as a second stream (A18, I02): each signup listens to its session for a day, after a snapshot."""
    at = work_dir(spark, "listeners")
    events, delay = _files(spark, sf_dir, at, "event_type <> 'signup'")
    joins, late = _files(spark, sf_dir, at, "event_type = 'signup'", "joins")
    row = F.struct(F.col("session_id").cast("string").alias("sessionId"), F.lit("READY").alias("state"), clamped(F.col("value") - 20).alias("progress"), F.col("event_type").alias("message"))
    events = events.select("session_id", "ts", "event_id", event_text(row).alias("value"))
    joins = joins.select("session_id", "ts", F.col("event_id").alias("subscriber"), (F.col("ts") + F.expr("INTERVAL 24 HOURS")).alias("closed_at"))
    # the slower of two delays serves both
    delay = max(delay, late, key=lambda x: int(x.split()[0]))
    texts = drained(live.subscriptions(events, joins, delay, _shares(spark, sf_dir)), f"{at}/out", f"{at}/log")
    read = parse_events(texts, "value")
    return read.select("session_id", "subscriber", "kind", "event_id", "event.progress", "event.message")


@query(ORACLE_SQL["i07_accepted_renders"])
def i07_stream_accepted_renders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Starts that are accepted while the same clip is not under way (I07), whatever batches they come in."""
    at = work_dir(spark, "renders")
    rows, delay = _files(spark, sf_dir, at)
    kind = F.when(F.col("event_type") == "purchase", "done").otherwise("start")
    requests = rows.select("session_id", "ts", "event_id", F.concat(F.lit("clip"), F.col("event_id") % 4).alias("render_key"), kind.alias("kind"))
    return drained(live.accepted_renders(requests, delay, _shares(spark, sf_dir)), f"{at}/out", f"{at}/log")


_INDEX = "CAST(right({}, 1) AS INTEGER) + 1"


@query(
    f"""WITH RECURSIVE e AS MATERIALIZED (
        SELECT user_id AS session_id, ts, 'clip' || (event_id % 4) AS clip, CASE event_type WHEN 'signup' THEN 'queued' WHEN 'purchase' THEN 'exported' WHEN 'error' THEN 'gone' ELSE 'rendering' END AS status,
               row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
    r AS (
        SELECT DISTINCT session_id, CAST(0 AS BIGINT) AS n, []::VARCHAR[] AS queue, NULL::VARCHAR AS cur, NULL::TIMESTAMP AS started, false AS was, CAST(0 AS BIGINT) AS turn,
               [NULL, NULL, NULL, NULL]::VARCHAR[] AS st, NULL::VARCHAR AS o_key, NULL::TIMESTAMP AS o_started, NULL::TIMESTAMP AS o_ended, NULL::VARCHAR AS o_outcome FROM e
        UNION ALL
        SELECT session_id, n, CASE WHEN moves THEN queue[2:] ELSE queue END, CASE WHEN moves THEN queue[1] ELSE cur END,
               CASE WHEN NOT moves THEN started WHEN queue[1] IS NOT NULL THEN ts END,
               CASE WHEN moves THEN coalesce(st[{_INDEX.format('queue[1]')}] = 'rendering', false) ELSE was OR (status <> 'queued' AND coalesce(now = 'rendering', false)) END,
               turn + CASE WHEN outcome IS NULL THEN 0 ELSE 1 END, st, CASE WHEN outcome IS NOT NULL THEN cur END, started, ts, outcome
        FROM (SELECT *, outcome IS NOT NULL OR (status = 'queued' AND cur IS NULL) AS moves FROM (
            SELECT *, CASE WHEN status = 'queued' OR cur IS NULL THEN NULL WHEN now = 'exported' THEN 'finished' WHEN now IS NULL AND was THEN 'failed' END AS outcome FROM (
                SELECT *, st[{_INDEX.format('cur')}] AS now FROM (
                    SELECT r.session_id, e.n, ts, status, cur, started, was, turn, CASE WHEN status = 'queued' THEN list_append(queue, clip) ELSE queue END AS queue,
                           CASE WHEN status = 'queued' THEN st ELSE [CASE WHEN i = {_INDEX.format('clip')} THEN nullif(status, 'gone') ELSE st[i] END for i in [1, 2, 3, 4]] END AS st
                    FROM r JOIN e ON e.session_id = r.session_id AND e.n = r.n + 1)))))
    SELECT session_id, turn - 1 AS turn, o_key AS render_key, o_started AS started_at, o_ended AS ended_at, o_outcome AS outcome FROM r WHERE o_outcome IS NOT NULL"""
)
def i08_render_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The queue of renders itself (I08): signups queue a clip, other events report on one."""
    at = work_dir(spark, "queue")
    rows, delay = _files(spark, sf_dir, at)
    kind = F.col("event_type")
    status = F.when(kind == "signup", "queued").when(kind == "purchase", "exported").when(kind == "error", "gone").otherwise("rendering")
    reports = rows.select("session_id", "ts", "event_id", F.concat(F.lit("clip"), F.col("event_id") % 4).alias("render_key"), status.alias("status"))
    done = drained(live.render_queue(reports, delay, _shares(spark, sf_dir)), f"{at}/out", f"{at}/log")
    return done.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("started_at", "ended_at")})
