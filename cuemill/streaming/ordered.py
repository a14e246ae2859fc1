"""Keyed stream processors that take a key's rows in order of event time, whatever batches they come in.

Rows wait in the key's state until the watermark has passed them; then they are
read one after another, in order, and folded into the key's value.  A key has
one timer, set to the earliest thing that it waits for: a row, or a deadline of
the processor's own, which later rows may move or cancel.  A key's state is read
and written once a batch, whole, so that a row costs no call to the state store.
Where keys have few rows each, many may share a state (``shares``): a call of
the processor costs a millisecond, whatever the rows that it is given.
"""

from __future__ import annotations

import pickle
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from operator import itemgetter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import LongType

from cuemill.schema import FLAG, LONG, TEXT, TRANSITIONS, record


#: The place of a row that waits: time, number, and which came first.
_place = itemgetter(0, 1, 2)


def _values(column: pd.Series, whole: bool) -> list:
    """A column's values; whole numbers among nulls come as fractions."""
    if column.notna().all():
        return column.astype("int64").tolist() if whole else column.tolist()
    values = column.astype(object).where(column.notna(), None).tolist()
    return [None if x is None else int(x) for x in values] if whole else values


class InOrder:
    """Calls :meth:`take` for each row of a key by (ts, event_id), and :meth:`due` for a deadline that came before the next row.

    ``fields``: what is kept of a row, as a schema; ``out``: the rows that come
    out.  A key's value is any value that can be pickled, null at first.  Rows
    that are equal in all columns are taken each.
    """

    fields, out = record(), ""

    def take(self, key: tuple, us: int, event_id: int, row: tuple, value, deadline: int | None) -> tuple[list[tuple], object, int | None]:
        """The rows to emit, the key's new value, and the new deadline (microseconds), if any."""
        raise NotImplementedError

    def due(self, key: tuple, us: int, value) -> tuple[list[tuple], object]:
        """The rows to emit when the deadline ``us`` has passed, and the key's new value."""
        return [], value

    def run(self, key: str, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        """Takes the rows of the keys (in the column ``key``) that share a state; what a key waits for and its value are the key's own."""
        no, waiting, held = pickle.loads(zlib.decompress(state.get[0])) if state.exists else (0, [], {})
        whole = [isinstance(f.dataType, LongType) for f in self.fields]
        for frame in frames:
            rows = list(zip(*(_values(frame[f.name], w) for f, w in zip(self.fields, whole, strict=True)), strict=True))
            came = range(no, no + len(rows))
            waiting += zip(_values(frame["us"], True), _values(frame["event_id"], True), came, _values(frame[key], True), rows, strict=True)
            no += len(rows)
        waiting.sort(key=_place)
        mark, out = state.getCurrentWatermarkMs(), []
        at = bisect_left(waiting, mark * 1000, key=lambda x: x[0])
        for us, event_id, _, name, row in waiting[:at]:
            deadline, value = held.get(name, (None, None))
            if deadline is not None and deadline <= us:
                told, value = self.due((name,), deadline, value)
                out += told
                deadline = None
            told, value, deadline = self.take((name,), us, event_id, row, value, deadline)
            out += told
            held[name] = deadline, value
        for name, (deadline, value) in held.items():
            if deadline is not None and deadline // 1000 < mark:
                told, value = self.due((name,), deadline, value)
                out += told
                held[name] = None, value
        del waiting[:at]
        held = {name: x for name, x in held.items() if x[0] is not None or x[1] is not None}
        state.update((zlib.compress(pickle.dumps((no, waiting, held)), 1),))
        nexts = [x for x, _ in held.values() if x is not None] + [x[0] for x in waiting[:1]]
        if nexts:
            state.setTimeoutTimestamp(max(min(nexts) // 1000, 1))
        if out:
            yield pd.DataFrame(out, columns=[c.split()[0] for c in self.out.split(",")], dtype=object)


def _run(timed: DataFrame, key: str, processor: InOrder, shares: int | None) -> DataFrame:
    keys = timed.groupBy(key) if shares is None else timed.withColumn("_share", F.pmod(F.xxhash64(key), F.lit(shares))).groupBy("_share")
    return keys.applyInPandasWithState(lambda _, frames, state: processor.run(key, frames, state), processor.out, "state BINARY", "append", GroupStateTimeout.EventTimeTimeout)


def ordered(rows: DataFrame, key: str, processor: InOrder, delay: str, shares: int | None = None) -> DataFrame:
    """``processor`` over a stream (key, ts, event_id, fields): rows may come later than others by up to ``delay``; later ones are dropped.

    ``shares``: states that the keys are dealt over; each key has its own if it
    is not given.  A share should hold some thousands of the rows that wait; the
    number can't change while a checkpoint lasts.
    """
    names = processor.fields.names
    return _run(rows.withWatermark("ts", delay).select(key, "ts", F.unix_micros("ts").alias("us"), "event_id", *names), key, processor, shares)


class States(InOrder):
    """The state machine: the number of requests so far and its state are the key's value."""

    fields = record(new_state=TEXT)
    out = "session_id BIGINT, seq INT, new_state STRING, accepted BOOLEAN, state STRING, error STRING"

    def __init__(self, start: str):
        self.start = start

    def take(self, key, us, event_id, row, value, deadline):
        seq, was = value or (0, self.start)
        new = row[0]
        fine = new in TRANSITIONS[was]
        after = new if fine else was
        error = None if fine else f"Invalid transition: {was} → {new}"
        return [(key[0], seq, new, fine, after, error)], (seq + 1, after), None


def states(requests: DataFrame, delay: str, start: str = "IDLE", shares: int | None = None) -> DataFrame:
    """(session_id, seq, new_state, accepted, state, error) for a stream of requests (session_id, ts, event_id, new_state).

    Requests are taken by time across batches, so that the rows are those of
    :func:`cuemill.operators.states.run_states`, as far as the watermark came.
    """
    return ordered(requests, "session_id", States(start), delay, shares)


class Saves(InOrder):
    """Changes set a deadline anew; an immediate save cancels it.  The value is the number of changes that wait and the last one."""

    fields = record(at_once=FLAG)
    out = "session_id BIGINT, saved_us BIGINT, kind STRING, n_events BIGINT, last_event BIGINT"

    def __init__(self, quiet_us: int):
        self.quiet_us = quiet_us

    def take(self, key, us, event_id, row, value, deadline):
        n = (value or (0, None))[0] + 1
        if row[0]:
            return [(key[0], us, "immediate", n, event_id)], None, None
        return [], (n, event_id), us + self.quiet_us

    def due(self, key, us, value):
        return [(key[0], us, "quiet", *value)], None


def debounced_saves(changes: DataFrame, delay: str, quiet_ms: int = 2000, shares: int | None = None) -> DataFrame:
    """(session_id, saved_at, kind, n_events, last_event): the saves of a stream of changes (session_id, ts, event_id, at_once).

    A change is saved once ``quiet_ms`` have passed without another; one that is
    to be saved ``at_once`` is, together with those that wait, whose timer goes.
    """
    out = ordered(changes, "session_id", Saves(quiet_ms * 1000), delay, shares)
    return out.select("session_id", F.timestamp_micros("saved_us").alias("saved_at"), "kind", "n_events", "last_event")


class Listeners(InOrder):
    """The session's newest event and the connections that are open are its value."""

    fields = record(closed_us=LONG, value=TEXT)
    out = "session_id BIGINT, subscriber BIGINT, kind STRING, event_id BIGINT, value STRING"

    def take(self, key, us, event_id, row, value, deadline):
        closed, text = row
        newest, listeners = value or (None, [])
        if closed is not None:  # a connection, named by its event_id
            told = [(key[0], event_id, "snapshot", *newest)] if newest else []
            return told, (newest, [*listeners, (event_id, closed)]), None
        left = [x for x in listeners if x[1] > us]
        return [(key[0], s, "event", event_id, text) for s, _ in left], ((event_id, text), left), None


def subscriptions(events: DataFrame, connections: DataFrame, delay: str, shares: int | None = None) -> DataFrame:
    """(session_id, subscriber, kind, event_id, value): what each connection gets, of two streams.

    ``events``: (session_id, ts, event_id, value); ``connections``: (session_id,
    ts, subscriber, closed_at).  On connecting a subscriber gets the newest event
    of its session, if there is one, then each later one until it closes.  What
    has the same time comes by its number; the watermark is that of the slower stream.
    """
    shape = lambda df, no, closed, value: df.withWatermark("ts", delay).select("session_id", "ts", F.unix_micros("ts").alias("us"), no.alias("event_id"), closed.alias("closed_us"), value.alias("value"))
    none: Column = F.lit(None)
    both = shape(connections, F.col("subscriber"), F.unix_micros("closed_at"), none.cast("string")).unionByName(shape(events, F.col("event_id"), none.cast("long"), F.col("value")))
    return _run(both, "session_id", Listeners(), shares)


class Renders(InOrder):
    """The clips of a session that are being rendered are its value."""

    fields = record(render_key=TEXT, kind=TEXT)
    out = "session_id BIGINT, render_key STRING, event_id BIGINT, accepted BOOLEAN"

    def take(self, key, us, event_id, row, value, deadline):
        clip, kind = row
        running = value or frozenset()
        if kind == "done":
            return [], running - {clip}, None
        return [(key[0], clip, event_id, clip not in running)], running | {clip}, None


def accepted_renders(requests: DataFrame, delay: str, shares: int | None = None) -> DataFrame:
    """(session_id, render_key, event_id, accepted): the starts of a stream of requests (session_id, ts, event_id, render_key, kind).

    A start is accepted unless the same clip is being rendered; ``done`` ends that.
    """
    return ordered(requests, "session_id", Renders(), delay, shares)


class Queue(InOrder):
    """A session's clips, rendered one after another: its value is the current one, those that wait, and what is known of renders."""

    fields = record(render_key=TEXT, status=TEXT)
    out = "session_id BIGINT, turn BIGINT, render_key STRING, started_us BIGINT, ended_us BIGINT, outcome STRING"

    def take(self, key, us, event_id, row, value, deadline):
        clip, status = row
        current, started, was, turn, queue, renders = value or (None, None, None, 0, [], {})

        def start(turn: int) -> tuple:
            """The next clip that waits becomes the current one; it may be under way already."""
            return (queue[0], us, renders.get(queue[0]) == "rendering", turn, queue[1:], renders) if queue else (None, None, None, turn, [], renders)

        if status == "queued":
            queue = [*queue, clip]
            return [], start(turn) if current is None else (current, started, was, turn, queue, renders), None
        if status == "gone":
            renders.pop(clip, None)
        else:
            renders[clip] = status
        if current is None:
            return [], (None, None, None, turn, queue, renders), None
        now = renders.get(current)
        outcome = "finished" if now == "exported" else "failed" if now is None and was else None
        if outcome:
            return [(key[0], turn, current, started, us, outcome)], start(turn + 1), None
        return [], (current, started, was or now == "rendering", turn, queue, renders), None


def render_queue(reports: DataFrame, delay: str, shares: int | None = None) -> DataFrame:
    """(session_id, turn, render_key, started_at, ended_at, outcome): the renders of each session's queue, of a stream of reports.

    ``reports``: (session_id, ts, event_id, render_key, status), where status
    is ``queued`` for a clip that joins the queue, or what a render has become:
    ``rendering``, ``exported`` or ``gone``.  One clip at a time is current; it
    is finished once it is exported, failed once it is gone after it was
    rendering, and then the next one starts.
    """
    rows = ordered(reports, "session_id", Queue(), delay, shares)
    return rows.select("session_id", "turn", "render_key", F.timestamp_micros("started_us").alias("started_at"), F.timestamp_micros("ended_us").alias("ended_at"), "outcome")
