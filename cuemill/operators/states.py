"""A project's state machine over ordered requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuemill.operators.arrays import in_order
from cuemill.operators.prefix import numbered
from cuemill.schema import TRANSITIONS, guards, transitions

#: Requests that one fold takes at most.
BLOCK = 1024


def may_pass(state: Column, new: Column) -> Column:
    """Whether the transition is in the table."""
    pairs = [f"{a}>{b}" for a, to in TRANSITIONS.items() for b in to]
    return F.concat(state, F.lit(">"), new).isin(pairs)


def _after(state: Column, new: Column) -> Column:
    return F.when(may_pass(state, new), new).otherwise(state)


def run_states(requests: DataFrame, start: str = "IDLE", key: str = "session_id", order: list[str] = ("ts", "event_id")) -> DataFrame:
    """(key, seq, new_state, accepted, state, error) for requests (key, order..., new_state).

    A request that the table does not allow leaves the state as it is.  The
    requests of a session are folded in blocks: each block is first run from
    every state, so that blocks need not wait for each other; chaining these
    results gives the state in which each block begins, and each block is run
    once more from there.  No array is longer than a block, or than a session
    has blocks.
    """
    rows = numbered(requests.select(key, *order, "new_state"), [key], list(order)).withColumn("seq", F.col("seq").cast("int")).withColumn("blk", F.floor(F.col("seq") / BLOCK).cast("int"))
    blocks = rows.groupBy(key, "blk").agg(in_order("new_state", order="seq").alias("rows"))
    states = F.array(*map(F.lit, TRANSITIONS))
    ends = F.transform(states, lambda s: F.aggregate("rows", s, lambda a, x: _after(a, x["new_state"])))
    chained = blocks.select(key, "blk", ends.alias("ends")).groupBy(key).agg(in_order("ends", order="blk").alias("b"))
    begin = F.aggregate(
        "b",
        F.struct(F.lit(start).alias("now"), F.array().cast("array<string>").alias("all")),
        lambda s, x: F.struct(F.get(x["ends"], F.array_position(states, s["now"]).cast("int") - 1).alias("now"), F.concat(s["all"], F.array(s["now"])).alias("all")),
        lambda s: s["all"],
    )
    begins = chained.select(key, F.posexplode(begin).alias("blk", "begin"))
    # within a block: the state after each request
    walked = F.aggregate(
        "rows",
        F.struct(F.col("begin").alias("now"), F.array().cast("array<string>").alias("all")),
        lambda s, x: F.struct(_after(s["now"], x["new_state"]).alias("now"), F.concat(s["all"], F.array(s["now"])).alias("all")),
        lambda s: s["all"],
    )
    out = blocks.join(begins, [key, "blk"]).withColumn("_was", walked).select(key, F.inline(F.arrays_zip("rows", F.col("_was").alias("was"))))
    new, was = F.col("rows.new_state"), F.col("was")
    fine = may_pass(was, new)
    error = F.when(~fine, F.concat(F.lit("Invalid transition: "), was, F.lit(" → "), new))
    return out.select(key, F.col("rows.seq").alias("seq"), new.alias("new_state"), fine.alias("accepted"), _after(was, new).alias("state"), error.alias("error"))


def allowed(requests: DataFrame) -> DataFrame:
    """Adds ``allowed`` to (state, new_state) by a join with the table of transitions (D12); the table has 8 rows."""
    table = transitions(requests.sparkSession).withColumn("_ok", F.lit(True))
    rows = requests.join(F.broadcast(table), ["state", "new_state"], "left")
    return rows.withColumn("allowed", F.col("_ok").isNotNull()).drop("_ok")


def guarded(requests: DataFrame) -> DataFrame:
    """Adds ``status`` to (session_exists, state, op): 404 for no session, 409 in a wrong state, else 200 (C11); the table has 5 rows.

    An unknown operation has no guard and is bad (400).
    """
    rows = requests.join(F.broadcast(guards(requests.sparkSession)), "op", "left")
    status = F.when(F.col("needed_state").isNull(), 400).when(~F.col("session_exists"), 404).when(~F.col("state").eqNullSafe(F.col("needed_state")), 409).otherwise(200)
    return rows.withColumn("status", status).drop("needed_state")


def latest(events: DataFrame, key: str = "session_id", order: list[str] = ("ts", "event_id")) -> DataFrame:
    """The newest event of each session."""
    return events.groupBy(key).agg(F.max_by(F.struct(*[c for c in events.columns if c != key]), F.struct(*order)).alias("_e")).select(key, "_e.*")


def quiet_saves(events: DataFrame, quiet_ms: int = 2000, key: str = "session_id", order: list[str] = ("ts", "event_id")) -> DataFrame:
    """(key, save_no, n_events, last_event, saved_at): one save after each burst of changes (I04, batch form).

    A burst goes on while each change comes less than ``quiet_ms`` after the one before.
    """
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    rows = numbered(events, [key], list(order), earlier={"_before": at})
    new = F.coalesce((at - F.col("_before") >= quiet_ms * 1000).cast("int"), F.lit(0))
    rows = numbered(rows.withColumn("_new", new).drop("seq", "_before"), [key], list(order), sums={"_starts": F.col("_new")})
    rows = rows.withColumn("save_no", (F.col("_starts") + F.col("_new")).cast("int"))
    out = rows.groupBy(key, "save_no").agg(F.count(F.lit(1)).alias("n_events"), F.max_by("event_id", F.struct(*order)).alias("last_event"), F.max("ts").alias("_last"))
    return out.select(key, "save_no", "n_events", "last_event", (F.col("_last") + F.make_dt_interval(secs=F.lit(quiet_ms / 1000))).alias("saved_at"))


def accepted_renders(requests: DataFrame, key: list[str] = ("session_id", "render_key"), order: list[str] = ("ts", "event_id")) -> DataFrame:
    """Render requests with ``accepted``: false while the last accepted one of the same clip is under way.

    ``requests`` has kind ``start`` or ``done``.  A start is accepted if no
    other start stands between it and the last ``done``.
    """
    rows = numbered(requests, list(key), list(order), earlier={"_before": F.col("kind")})
    # only starts and ends are there, so the row before tells
    return rows.where("kind = 'start'").withColumn("accepted", F.coalesce(F.col("_before") == "done", F.lit(True))).drop("seq", "_before")


def batch_steps(statuses: DataFrame, key: list[str] = ("session_id", "render_key"), order: list[str] = ("ts", "event_id")) -> DataFrame:
    """(key, ts, outcome): ends of renders in a sequence of statuses (I08): ``finished`` where it becomes exported,
    ``failed`` where the entry is gone (null) after it was rendering."""
    statuses = numbered(statuses, list(key), list(order), earlier={"_before": F.coalesce("status", F.lit("gone"))})
    before = F.col("_before")
    outcome = F.when((F.col("status") == "exported") & ~before.eqNullSafe(F.lit("exported")), "finished").when(F.col("status").isNull() & (before == "rendering"), "failed")
    return statuses.withColumn("outcome", outcome).where("outcome is not null").select(*key, *order, "outcome")
