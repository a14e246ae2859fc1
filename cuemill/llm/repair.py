"""Repair of conversations: the cheapest edits that make a legal dialogue, by cost layers of grammar states.

Rows are put in order of conversation and turn over range partitions, so that a
long conversation is spread over tasks, and cut into segments of a bounded size.
A segment is solved by layers: layer j holds, for each of its turns, the set of
grammar states (four bits) from which the end can be reached at a cost of j.  A
conversation of one segment needs nothing else.  Of longer ones each segment
first gives the costs between all states at its two ends; a stream over these
small tables from the last segment to the first tells what the rest of the
conversation costs from each state, and seeds the layers of each segment.
"""

from __future__ import annotations

import hashlib
from itertools import count

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuemill.llm.common import free_names, staged, with_small

#: Different rows, and characters of text, of a segment.
SEGMENT, TEXT = 128, 4 << 20
#: Costs of the edits; a truncated turn that stays costs one more.
COST = {"K": 0, "R": 2, "D": 3, "I": 2}
#: The grammar's states: nothing yet, after system, after user, after assistant; a dialogue ends in the first or the last.
KEPT = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
NEXT = {0: 2, 1: 2, 2: 3, 3: 2}
SPOKEN = {2: "user", 3: "assistant"}
ENDS = [0, -1, -1, 0]
_WHITE = " \t\n\x0b\x0c\r"


def _before(moves: dict[int, int]) -> bytes:
    """For each set of states (as bits): the states that move into it."""
    return bytes(sum(1 << p for p, q in moves.items() if to >> q & 1) for to in range(16))


_ANY, _NONE = _before(NEXT), bytes(16)
_KEEP = {c: _before(moves) for c, moves in KEPT.items()}


def layers(rows: list[tuple[str, bool]], seeds: list[int], until: int) -> list[bytearray]:
    """Layer after layer until the states ``until`` (bits) are reached at the first turn.

    ``rows``: initial and truncated of each turn; ``seeds``: what follows the
    last turn costs from each state (-1: it can't end there).  ``out[j][i]`` are
    the states before turn ``i`` from which all that is left costs ``j``.
    """
    n, seen, out = len(rows), 0, []
    keeps = [_KEEP.get(c, _NONE) for c, _ in rows]
    none, most = bytes(n + 1), 3 * n + max(seeds) + 8
    for j in count():
        one, two, three = (out[j - k] if j >= k else none for k in (1, 2, 3))
        now = bytearray(n + 1)
        now[n] = sum(1 << q for q, x in enumerate(seeds) if x == j) | _ANY[two[n]]
        for i in range(n - 1, -1, -1):
            if rows[i][1]:
                now[i] = _ANY[two[i] | three[i + 1]] | three[i + 1] | keeps[i][one[i + 1]]
            else:
                now[i] = _ANY[two[i] | two[i + 1]] | three[i + 1] | keeps[i][now[i + 1]]
        out.append(now)
        seen |= now[0]
        if seen & until == until or j >= most:
            return out


def trace(rows: list[tuple[str, bool]], found: list[bytearray], seeds: list[int], state: int) -> tuple[list[tuple[str, int]], int]:
    """The cheapest edits from ``state``, of equal ones the first in order of their letters, as (edit, state after it); and the state at the end."""
    j = next(k for k, x in enumerate(found) if x[0] >> state & 1)
    i, out = 0, []
    while True:
        if i == len(rows) and seeds[state] == j:
            return out, state
        c, cut = rows[i] if i < len(rows) else ("", False)
        move, kept = NEXT[state], KEPT.get(c, {}).get(state)
        if i < len(rows) and j >= 3 and found[j - 3][i + 1] >> state & 1:
            out.append(("D", state))
            i, j = i + 1, j - 3
        elif j >= 2 and found[j - 2][i] >> move & 1:
            out.append(("I", move))
            state, j = move, j - 2
        elif kept is not None and j >= cut and found[j - cut][i + 1] >> kept & 1:
            out.append(("K", kept))
            i, j, state = i + 1, j - cut, kept
        else:
            out.append(("R", move))
            i, j, state = i + 1, j - 2 - cut, move


def _free(rows: list[dict]) -> list[tuple[str, bool]]:
    """What the layers see: the rows that don't have to go."""
    return [(r["role"][:1], r["fault"] == "truncated") for r in rows if r["fault"] in ("truncated", "")]


def matrix(rows: list[dict]) -> list[int]:
    """Costs from each state before a segment to each state after it, row by row; -1 where there is no way."""
    free, forced = _free(rows), 3 * sum(r["m"] - (r["fault"] in ("truncated", "")) for r in rows)
    out = [-1] * 16
    for q in range(4):
        found = layers(free, [0 if x == q else -1 for x in range(4)], 15)
        for p in range(4):
            at = next((j for j, x in enumerate(found) if x[0] >> p & 1), None)
            out[4 * p + q] = -1 if at is None else at + forced
    return out


class Story:
    """A conversation that is repaired segment by segment."""

    def __init__(self):
        self.state = self.cost = self.illegal = self.distinct = 0
        self.first = self.turn = self.initial = None
        self.faults = {"blank": 0, "duplicate": 0, "truncated": 0}
        self.audit, self.digest, self.empty = [], hashlib.sha256(), True

    def add(self, rows: list[dict], seeds: list[int]) -> list[dict]:
        """The segment's repaired turns, deleted ones included: edit, role, text."""
        free, out = _free(rows), []
        edits, end = trace(free, layers(free, seeds, 1 << self.state), seeds, self.state)
        edits.reverse()
        for r in rows:
            self._count(r)
            stays = r["fault"] in ("truncated", "")
            # copies of a row that stays come after it, so their deletion does
            gone = [{"edit": "D", "role": r["role"], "text": r["text"]}] * (r["m"] - stays)
            if not stays:
                out += gone
                continue
            while edits[-1][0] == "I":
                out.append({"edit": "I", "role": SPOKEN[edits.pop()[1]], "text": ""})
            edit, state = edits.pop()
            out.append({"edit": edit, "role": SPOKEN[state] if edit == "R" else r["role"], "text": r["text"]})
            self.cost += (r["fault"] == "truncated") and edit != "D"
            out += gone
        out += [{"edit": "I", "role": SPOKEN[state], "text": ""} for _, state in reversed(edits)]
        self.state = end
        for x in out:
            self.audit.append(x["edit"])
            self.cost += COST[x["edit"]]
            if x["edit"] != "D":
                self.digest.update(f"{'' if self.empty else chr(10)}{x['role']}:{x['text']}".encode())
                self.empty = False
        return out

    def _count(self, r: dict) -> None:
        c, turn = r["role"][:1], r["turn"]
        self.illegal += r["m"] - 1 + (self.initial is not None and self.initial + c not in ("su", "ua", "au"))
        self.initial = c
        if r["fault"]:
            self.faults[r["fault"]] += 1
        self.faults["blank" if r["fault"] == "blank" else "duplicate"] += r["m"] - 1
        if turn is not None:
            self.distinct += turn != self.turn
            self.first, self.turn = turn if self.first is None else self.first, turn

    def summary(self) -> dict:
        gaps = self.turn - self.first + 1 - self.distinct if self.distinct else 0
        return {"gaps": gaps, **self.faults, "illegal": self.illegal, "cost": self.cost, "audit": "".join(self.audit), "repaired_sha256": self.digest.hexdigest()}


_ROW = pa.struct([("turn", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("fault", pa.string()), ("m", pa.int64())])
_ROW_DDL = "array<struct<turn: bigint, role: string, text: string, fault: string, m: bigint>>"
_TURN_DDL = "array<struct<edit: string, role: string, text: string>>"
_TURN = pa.struct([(x, pa.string()) for x in ("edit", "role", "text")])
_SUMMARY = {x: pa.int64() for x in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")} | {"audit": pa.string(), "repaired_sha256": pa.string()}
_SUMMARY_DDL = ", ".join(f"{k} {'long' if t == pa.int64() else 'string'}" for k, t in _SUMMARY.items())


def _segments(parts):
    """Sorted rows in segments; equal rows of a turn are one with their number."""
    part, no, conv, held, size = TaskContext.get().partitionId(), 0, None, [], 0

    def batch():
        return pa.RecordBatch.from_arrays([pa.array([conv], kind), pa.array([part], pa.int32()), pa.array([no], pa.int64()), pa.array([held], pa.list_(_ROW))], ["conv", "part", "seg", "rows"])

    for b in parts:
        kind = b.column("conv").type
        for r in b.to_pylist():
            own = r.pop("conv")
            last = held[-1] if held and own == conv else None
            if last and all(last[k] == r[k] for k in ("turn", "role", "text")):
                last["m"] += r["m"]
                continue
            if held and (own != conv or len(held) >= SEGMENT or size >= TEXT):
                yield batch()
                no, held, size = no + 1, [], 0
            conv = own
            held.append(r)
            size += len(r["text"])
    if held:
        yield batch()


def _costs(parts):
    for b in parts:
        got = [matrix(rows) for rows in b.column("rows").to_pylist()]
        yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("conv", "part", "seg")), pa.array(got, pa.list_(pa.int32()))], ["conv", "part", "seg", "costs"])


def _seeds(parts):
    """Segments from the last to the first: what the rest of the conversation costs from each state after them."""
    conv, rest = (), ENDS
    for b in parts:
        out = []
        for own, costs in zip(b.column("conv").to_pylist(), b.column("costs").to_pylist(), strict=True):
            if (own,) != conv:
                conv, rest = (own,), ENDS
            out.append(rest)
            sums = [[costs[4 * p + q] + rest[q] for q in range(4) if costs[4 * p + q] >= 0 and rest[q] >= 0] for p in range(4)]
            least = min(min(x) for x in sums if x)
            rest = [min(x) - least if x else -1 for x in sums]
        yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("conv", "part", "seg")), pa.array(out, pa.list_(pa.int32()))], ["conv", "part", "seg", "seeds"])


def _finish(turns: bool):
    def batches(parts):
        """Segments in order: their repaired turns, and the summary after the last of each conversation."""
        conv, story = (), None
        for b in parts:
            convs, out, kind = b.column("conv").to_pylist(), [], b.column("conv").type
            for own, at, rows, seeds in zip(convs, b.column("place").to_pylist(), b.column("rows").to_pylist(), b.column("seeds").to_pylist(), strict=True):
                if conv and (own,) != conv:
                    out.append((conv[0], None, None, story.summary()))
                if (own,) != conv:
                    conv, story = (own,), Story()
                fixed = story.add(rows, seeds)
                if turns:
                    out.append((own, at, fixed, {}))
            yield _batch(out, kind)
        if conv:
            yield _batch([(conv[0], None, None, story.summary())], kind)

    return batches


def _batch(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    cols = [pa.array([r[0] for r in rows], kind), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.list_(_TURN))]
    cols += [pa.array([r[3].get(k) for r in rows], t) for k, t in _SUMMARY.items()]
    return pa.RecordBatch.from_arrays(cols, ["conv", "place", "turns", *_SUMMARY])


def _faults(rows: DataFrame) -> DataFrame:
    """``rows`` (conv, turn, role, text, m) with the first fault of each.

    A text seen in an earlier turn comes from a grouped minimum, joined back for
    the few that stand in several turns; copies in one turn meet when rows are sorted.
    """
    rows = rows.select("conv", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), F.col("m").cast("long").alias("m"))
    rows = rows.withColumn("said", F.sha2(F.concat(F.length("role"), F.lit(":"), "role", "text"), 256))
    when = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    seen = rows.groupBy("conv", "said").agg(F.min(when).alias("first"), F.max(when).alias("last")).where("first <> last")
    # structs as keys: a conversation may have no id
    seen = staged(seen.select(F.struct("conv", "said").alias("key"), F.col("first.turn").alias("first_turn"), F.lit(True).alias("hit")), "seen")
    rows = with_small(rows.withColumn("key", F.struct("conv", "said")), seen, ["key"], "left")
    repeated = F.col("hit").isNotNull() & ~F.col("turn").eqNullSafe(F.col("first_turn"))
    end = F.rtrim("text", F.lit(_WHITE))
    fault = F.when(end == "", "blank").when(repeated, "duplicate").when(~F.right(end, F.lit(1)).isin(".", "!", "?"), "truncated").otherwise("")
    return rows.select("conv", "turn", "role", "text", fault.alias("fault"), "m")


def solved(convs: DataFrame, turns: bool = False, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", copies_col: str | None = None) -> DataFrame:
    """Rows with the repaired turns of segments (``turns``), and one with the summary of each conversation (``audit`` is not null).

    See :func:`repair_conversations` and :func:`repaired_turns`.
    """
    rows = convs.select(
        F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text"), (F.col(copies_col) if copies_col else F.lit(1)).alias("m")
    )
    kind = rows.schema["conv"].dataType.simpleString()
    key = ["conv", "turn", "role", "text"]
    ordered = _faults(rows).repartitionByRange(*key).sortWithinPartitions(*key)
    segments = staged(ordered.mapInArrow(_segments, f"conv {kind}, part int, seg long, rows {_ROW_DDL}"), "segments")
    # nearly all conversations are one segment; what is listed are those that are not
    long = staged(segments.groupBy(F.struct("conv").alias("key")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key"), "long")
    keyed = segments.withColumn("key", F.struct("conv")).withColumn("place", F.shiftleft(F.col("part").cast("long"), 32) + F.col("seg"))
    out = f"conv {kind}, place long, turns {_TURN_DDL}, {_SUMMARY_DDL}"
    short = with_small(keyed, long, ["key"], "left_anti").select("conv", "place", "rows", F.array(*map(F.lit, ENDS)).alias("seeds")).mapInArrow(_finish(turns), out)
    parts = with_small(keyed, long, ["key"], "left_semi")
    costs = parts.select("conv", "part", "seg", "rows").mapInArrow(_costs, f"conv {kind}, part int, seg long, costs array<int>")
    upward = costs.repartition("conv").sortWithinPartitions("conv", F.desc("part"), F.desc("seg"))
    seeds = staged(upward.mapInArrow(_seeds, f"conv {kind}, part int, seg long, seeds array<int>"), "seeds").select(F.col("part").alias("_part"), F.col("seg").alias("_seg"), "seeds")
    # (part, seg) names a segment
    seeded = parts.join(seeds, (F.col("part") == F.col("_part")) & (F.col("seg") == F.col("_seg"))).select("conv", "place", "rows", "seeds")
    return short.unionByName(seeded.repartition("conv").sortWithinPartitions("conv", "place").mapInArrow(_finish(turns), out))


def repair_conversations(convs: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", copies_col: str | None = None) -> DataFrame:
    """One row for each conversation of ``convs``: its id, gaps, blank, duplicate, truncated, illegal, cost (longs), audit, repaired_sha256.

    Turns are kept (K, free), get another role (R, 2), are deleted (D, 3: always
    if blank or said before) or inserted (I, 2), until the roles' first letters
    read ``(s?(ua)+)?``; a truncated turn that stays costs one more.  The audit
    is the cheapest sequence of edits, of equal ones the first by its letters.

    Rows go by turn, null first; rows of one turn by role and text.  A null role
    or text counts as one space; a role without a letter of the grammar can't
    be kept.  ``copies_col``: how often a row stands there.  A null id is a
    conversation like any other.  Repeated rows are duplicates.  An empty table
    gives no rows; other columns are ignored, whatever their names.  The audit
    and the digest of a conversation are made by one task, which streams its
    segments; the costs of the segments are worked out in parallel.
    """
    done = solved(convs, False, conv_col, turn_col, role_col, text_col, copies_col)
    return done.where("audit is not null").select(F.col("conv").alias(conv_col), *_SUMMARY)


def repaired_turns(convs: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", copies_col: str | None = None) -> DataFrame:
    """The repaired dialogues: conversation, place (rises with the turns, not gapless), edit, role, text; deleted turns are rows with edit D."""
    done = solved(convs, True, conv_col, turn_col, role_col, text_col, copies_col).where("audit is null")
    return done.select(F.col("conv").alias(conv_col), F.col("place"), F.posexplode("turns").alias("pos", "_t")).select(conv_col, F.struct("place", "pos").alias("place"), "_t.*")


def damaged(convs: DataFrame) -> DataFrame:
    """``convs`` (conv_id, turn, role, text) with faults that depend on the row's key alone, and ``copies``; nulls become one space.

    The remainder by 20 of the CRC-32 of ``conv_id:turn`` drops the row (0),
    empties its text (1), takes out ``[.!?]`` (2), doubles it (3) or makes its
    role user (4).
    """
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    (x,) = free_names(convs, "fault_no")
    rows = convs.withColumn(x, F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20).where(F.col(x) != 0)
    text = F.when(F.col(x) == 1, "").when(F.col(x) == 2, F.translate(space("text"), ".!?", "")).otherwise(space("text"))
    role = F.when(F.col(x) == 4, "user").otherwise(space("role"))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.when(F.col(x) == 3, 2).otherwise(1).alias("copies"))
