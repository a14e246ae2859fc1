"""Streams that keep order by timers: across batches, with ties, repeats and late rows."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from cuemill.operators import states as S
from cuemill.schema import TRANSITIONS
from cuemill.session import clear_work, work_dir
from cuemill.streaming import ordered

US = 1_000_000
#: Seconds that all times are moved by: a stream drops what is not after 1970.
FROM = 1_000_000


def streamed(spark, at, batches: list[list[tuple]], schema: str):
    """A stream of the batches (us first in each row), one file to each, then one row that ends it."""
    kind = f"us long, {schema}"
    end = max(r[0] for b in batches for r in b) + 10_000 * US
    for rows in [*batches, [(end, *[None] * schema.count(","), None)]]:
        df = spark.createDataFrame(rows, kind)
        df.coalesce(1).write.mode("append").parquet(f"{at}/in")
    rows = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(f"{at}/in")
    return rows.withColumn("ts", F.timestamp_micros(F.col("us") + FROM * US)).drop("us")


def drained(stream, at):
    """The rows that the stream wrote, and the most rows that its state held after a batch."""
    query = stream.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/log").trigger(availableNow=True).start()
    query.awaitTermination()
    held = max(p.stateOperators[0].numRowsTotal for p in query.recentProgress if p.stateOperators)
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{at}/out"), held


def test_states_of_shuffled_files(spark):
    """Each batch holds rows older than the one before; ties go by number; a repeated request is one of its own; state stays small."""
    rng = random.Random(4)
    rows = [(t * US + rng.randrange(3) * 500, 7 + t % 3, t, rng.choice(list(TRANSITIONS))) for t in range(1200)]
    rows += [(rows[5][0], 7, 5000, "UPLOADING"), (rows[5][0], 7, 4999, "TRANSCRIBING"), rows[30], rows[30]]
    batches: list[list[tuple]] = [[] for _ in range(13)]
    for r in rows:
        batches[min(r[0] // (100 * US), 11) + rng.randrange(2)].append(r)
    for b in batches:
        rng.shuffle(b)
    at = work_dir(spark, "test")
    stream = ordered.states(streamed(spark, at, batches, "session_id long, event_id long, new_state string"), "201 seconds")
    got, held = drained(stream, at)
    want = S.run_states(spark.createDataFrame(rows, "us long, session_id long, event_id long, new_state string").withColumn("ts", F.timestamp_micros("us")))
    key = lambda df: sorted(map(tuple, df.select("session_id", "seq", "new_state", "accepted", "state", "error").collect()))
    assert key(got) == key(want)
    assert held <= 450  # of 1204 rows: those of some 300 seconds, and a few values for each session
    clear_work()


def test_late_rows_are_left_out(spark):
    """What comes after its time was handled is dropped; the rest is in order (a batch's rows are measured by the watermark before it)."""
    batches = [[(100 * US, 1, 1, "UPLOADING")], [(300 * US, 1, 2, "IDLE")], [(150 * US, 1, 3, "TRANSCRIBING"), (299 * US, 1, 4, "TRANSCRIBING")], [(200 * US, 1, 5, "ALIGNING")]]
    at = work_dir(spark, "test")
    got, _ = drained(ordered.states(streamed(spark, at, batches, "session_id long, event_id long, new_state string"), "10 seconds"), at)
    assert [(r.seq, r.new_state, r.accepted) for r in got.orderBy("seq").collect()] == [(0, "UPLOADING", True), (1, "TRANSCRIBING", True), (2, "TRANSCRIBING", False), (3, "IDLE", False)]


def test_debounce(spark):
    """A change moves the deadline; an immediate save cancels it; a deadline between two batches fires once; changes at the very deadline come after it."""
    changes = [(0, False), (1.5, False), (3.4, True), (3.5, False), (5.5, False), (30, True), (31, True), (60, False)]
    rows = [(int(t * US), 1, i, now) for i, (t, now) in enumerate(changes)] + [(int(t * US) + 1, 2, 100 + i, False) for i, t in enumerate((0, 10, 11, 20))]
    batches = [rows[1::2], rows[::2]]
    at = work_dir(spark, "test")
    got, _ = drained(ordered.debounced_saves(streamed(spark, at, batches, "session_id long, event_id long, at_once boolean"), "100 seconds"), at)
    saves = sorted((r.session_id, r.saved_at.timestamp() - FROM, r.kind, r.n_events, r.last_event) for r in got.collect())
    one = [(3.4, "immediate", 3, 2), (5.5, "quiet", 1, 3), (7.5, "quiet", 1, 4), (30, "immediate", 1, 5), (31, "immediate", 1, 6), (62, "quiet", 1, 7)]
    two = [(2.000001, "quiet", 1, 100), (13.000001, "quiet", 2, 102), (22.000001, "quiet", 1, 103)]
    assert [(s, round(t, 6), *x) for s, t, *x in saves] == [(1, *x) for x in one] + [(2, *x) for x in two]


@pytest.mark.parametrize("cut", [1, 4])
def test_queue(spark, cut):
    """One clip at a time: finished, failed after it was rendering, gone before it rendered, under way when it starts, queued twice."""
    told = [("a", "queued"), ("b", "queued"), ("a", "gone"), ("b", "rendering"), ("a", "rendering"), ("a", "exported"), ("b", "gone"), ("c", "queued"), ("c", "exported"), ("d", "queued"), ("a", "queued"), ("d", "rendering")]
    rows = [(i * US, 1, i, c, s) for i, (c, s) in enumerate(told)] + [(20 * US, 1, 20, "d", "exported"), (21 * US, 1, 21, "x", "rendering")]
    at = work_dir(spark, "test")
    stream = ordered.render_queue(streamed(spark, at, [rows[i::cut] for i in range(cut)], "session_id long, event_id long, render_key string, status string"), "50 seconds")
    got, _ = drained(stream, at)
    out = [(r.turn, r.render_key, r.started_at.timestamp() - FROM, r.ended_at.timestamp() - FROM, r.outcome) for r in got.orderBy("turn").collect()]
    # b was rendering when its turn came; c waits from 7 on; the last a is exported from long before, which the next report shows
    assert out == [(0, "a", 0, 5, "finished"), (1, "b", 5, 6, "failed"), (2, "c", 7, 8, "finished"), (3, "d", 9, 20, "finished"), (4, "a", 20, 21, "finished")]


def test_subscriptions(spark):
    """A snapshot of the newest event by then, though it comes in a later batch; events until the connection closes."""
    at = work_dir(spark, "test")
    events = [[(20 * US, 1, 2, "e20"), (31 * US, 1, 4, "e31")], [(10 * US, 1, 1, "e10"), (30 * US, 1, 3, "e30"), (50 * US, 2, 9, "f50")]]
    joins = [[(25 * US, 1, 500, 31 * US), (5 * US, 1, 501, 25 * US)], [(30 * US, 1, 502, 90 * US), (60 * US, 3, 503, 70 * US)]]
    left = streamed(spark, f"{at}/e", events, "session_id long, event_id long, value string")
    right = streamed(spark, f"{at}/j", joins, "session_id long, subscriber long, closed long").withColumn("closed_at", F.timestamp_micros(F.col("closed") + FROM * US))
    got, _ = drained(ordered.subscriptions(left, right, "60 seconds"), at)
    rows = sorted((r.subscriber, r.kind, r.value) for r in got.collect())
    # 502 connects at the time of e30, whose number is smaller: it comes first
    assert rows == [(500, "event", "e30"), (500, "snapshot", "e20"), (501, "event", "e10"), (501, "event", "e20"), (502, "event", "e31"), (502, "snapshot", "e30")]


def test_a_slice_is_a_batch_whatever_its_files(spark, tmp_path):
    """Events in many files make no more batches than in one, and no more rows of state than sessions."""
    from cuemill.queries import live

    events = spark.range(900).select(F.col("id").alias("event_id"), F.timestamp_micros(F.lit(FROM * US) + F.col("id") * US).alias("ts"), (F.col("id") % 5).alias("user_id"), F.lit("view").alias("event_type"), F.lit(1.0).alias("value"), F.lit("").alias("props"))
    events.withColumn("ts", F.col("ts").cast("timestamp_ntz")).repartition(30).write.parquet(f"{tmp_path}/events.parquet")
    at = work_dir(spark, "test")
    rows, delay = live._files(spark, str(tmp_path), at)
    stream = ordered.states(rows.select("session_id", "ts", "event_id", F.lit("IDLE").alias("new_state")), delay)
    query = stream.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/log").trigger(availableNow=True).start()
    query.awaitTermination()
    told = query.recentProgress
    assert len(told) <= live.SLICES + 4 and max(p.stateOperators[0].numRowsTotal for p in told) == 5
    assert spark.read.parquet(f"{at}/out").groupBy("session_id").agg(F.max("seq").alias("m"), F.count("*").alias("n")).where("m = n - 1 and n = 180").count() == 5
    clear_work()


def shared(spark, make, kinds: str, row) -> None:
    """Sessions that share three states give the rows that each gives with a state of its own, and hold three."""
    rng = random.Random(8)
    rows = [(rng.randrange(400) * US, rng.choice([*range(40), None]), i, *row(rng)) for i in range(900)]
    batches: list[list[tuple]] = [[] for _ in range(5)]
    for r in rows:
        batches[r[0] // (100 * US) + rng.randrange(2)].append(r)
    schema, out = f"session_id long, event_id long, {kinds}", []
    for shares in (None, 3):
        at = work_dir(spark, "test")
        got, held = drained(make(streamed(spark, at, batches, schema), "201 seconds", shares), at)
        out.append(sorted(map(repr, got.collect())))
        assert held >= 40 if shares is None else held <= 3
    assert out[0] == out[1] and len(out[0]) > 40
    clear_work()


def test_queues_share_states(spark):
    shared(spark, lambda s, d, n: ordered.render_queue(s, d, shares=n), "render_key string, status string", lambda r: (r.choice("ab"), r.choice(["queued", "rendering", "exported", "gone"])))


def test_debounced_saves_share_states(spark):
    shared(spark, lambda s, d, n: ordered.debounced_saves(s, d, 20_000, n), "at_once boolean", lambda r: (r.random() < 0.3,))


def test_subscriptions_share_states(spark):
    def make(stream, delay, shares):
        sides = stream.where("closed is null"), stream.where("closed is not null")
        joins = sides[1].select("session_id", "ts", F.col("event_id").alias("subscriber"), (F.col("ts") + F.make_dt_interval(secs=F.col("closed"))).alias("closed_at"))
        return ordered.subscriptions(sides[0], joins, delay, shares)

    shared(spark, make, "closed long, value string", lambda r: (r.randrange(90), None) if r.random() < 0.3 else (None, f"e{r.random()}"))


def test_accepted_renders_share_states(spark):
    shared(spark, lambda s, d, n: ordered.accepted_renders(s, d, n), "render_key string, kind string", lambda r: (r.choice("ab"), r.choice(["start", "done"])))


def test_stream_states_share_states(spark):
    shared(spark, lambda s, d, n: ordered.states(s, d, shares=n), "new_state string", lambda r: (r.choice(list(TRANSITIONS)),))
