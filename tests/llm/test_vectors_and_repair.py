"""Embeddings and conversations against brute force."""

from __future__ import annotations

import hashlib
import math
import random
import zlib

import numpy as np
import pytest

from cuemill.llm import queries, repair, vectors, whitening
from cuemill.llm.common import SESSION
from cuemill.llm.repair import damaged, repair_conversations, repaired_turns
from cuemill.llm.vectors import near_vectors
from cuemill.llm.whitening import whiten

# Embedding near-duplicates


def _brute_links(rows: list[tuple], similar: float = 0.9) -> list[tuple]:
    units = []
    for _, v in rows:
        x = np.array(v, float) if v and None not in v else None
        units.append(x / np.linalg.norm(x) if x is not None and np.isfinite(x).all() and x.any() else None)
    n = len(rows)
    near = [[j for j in range(n) if j != i and units[i] is not None and units[j] is not None and len(units[i]) == len(units[j]) and units[i] @ units[j] >= similar] for i in range(n)]
    out = []
    for i in range(n):
        seen, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        least = min(ids) if ids else None
        out.append((rows[i][0], len(near[i]), least, least == rows[i][0]))
    return sorted(out, key=repr)


def _vectors() -> list[tuple]:
    rng = np.random.default_rng(5)
    rows = [(i, rng.standard_normal(12).tolist()) for i in range(150)]
    for c in range(6):  # clusters of all widths, so that whole, partial and no links between balls occur
        middle = rng.standard_normal(12)
        middle /= np.linalg.norm(middle)
        rows += [(1000 + 100 * c + i, (middle + rng.standard_normal(12) * 0.025 * (c + 1)).tolist()) for i in range(60)]
    rows += [(2000 + i, rows[3][1]) for i in range(40)]
    rows += [(3000 + i, rng.standard_normal(5).tolist()) for i in range(60)]
    rows += [(4000, None), (4001, []), (4002, [0.0] * 12), (4003, [None] + [1.0] * 11), (4004, [math.nan] + [1.0] * 11), (4005, [math.inf] + [1.0] * 11)]
    rows += [(None, rows[3][1]), (None, [5.0, 0.1, 0.1]), (7, rows[3][1]), (4006, [2.0]), (4007, [3.0]), (4008, [-3.0]), (4009, (np.array(rows[9][1]) * 7).tolist())]
    return rows


_VECTORS = "vec_id long, embedding array<double>, label int, id int, fp int, unit int, ball int, dims int"


@pytest.mark.parametrize("leaf, tile", [(2048, 2048), (8, 5)])
def test_near_vectors(spark, monkeypatch, leaf, tile):
    """All links, of whole balls, of members and of points; small leaves and tiles give the same."""
    monkeypatch.setattr(vectors, "LEAF", leaf)
    monkeypatch.setattr(vectors, "TILE", tile)
    rows = _vectors()
    df = spark.createDataFrame([(*r, 1, 2, 3, 4, 5, 6) for r in rows], _VECTORS).repartition(5)
    assert sorted(map(tuple, near_vectors(df).collect()), key=repr) == _brute_links(rows)


def test_near_vectors_close_to_the_threshold(spark):
    """Pairs of a cosine just above and just below; a chain is one component."""
    rows = []
    for i, c in enumerate([0.9 + 1e-9, 0.9 - 1e-9, 0.95, 0.5]):
        a = [0.0] * 8
        a[2 * (i % 4)] = 1.0
        b = [0.0] * 8
        b[2 * (i % 4)], b[2 * (i % 4) + 1] = c, math.sqrt(1 - c * c)
        rows += [(10 * i, a), (10 * i + 1, b)]
    got = near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert sorted(map(tuple, got), key=repr) == _brute_links(rows)


def test_no_vectors(spark):
    assert near_vectors(spark.createDataFrame([], _VECTORS)).collect() == []
    assert whiten(spark.createDataFrame([], _VECTORS)).collect() == []


def test_copies_cost_few_balls(spark):
    """A group of near copies is a handful of balls, and its links are never listed."""
    rng = np.random.default_rng(2)
    middle = rng.standard_normal(64) / 8
    rows = [(i, (middle + rng.standard_normal(64) * 0.01).tolist()) for i in range(3000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert {(r.n_links, r.component_id) for r in near_vectors(df).collect()} == {(2999, 0)}
    found = [x for x in SESSION.tables if "/candidates-" in x._cuemill_path][-1]
    assert found.count() < 3000


def test_comparisons_are_not_stored(spark, monkeypatch):
    """What is staged on the way has no more rows than there are vectors, however many pairs are compared."""
    monkeypatch.setattr(vectors, "LEAF", 64)
    rng = np.random.default_rng(4)
    rows = [(i, rng.standard_normal(24).tolist()) for i in range(1500)]
    SESSION.close()
    got = near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert sorted(map(tuple, got), key=repr) == _brute_links(rows)
    assert max(x.count() for x in SESSION.tables) <= 1500


# Whitening


def _brute_whitening(x: np.ndarray):
    n, s = len(x), x.sum(0)
    z = (n * x - s) / n
    e, q = np.linalg.eigh(z.T @ z / n)
    return ((n * x - s) ** 2).sum(1), z, e[::-1], q[:, ::-1]


@pytest.mark.parametrize("parts, rows", [(1, 4096), (40, 7)])
def test_whitening(spark, monkeypatch, parts, rows):
    """The covariance's own components, however the rows are dealt out."""
    monkeypatch.setattr(whitening, "ROWS", rows)
    rng = np.random.default_rng(3)
    c = (rng.standard_normal((300, 10)) @ rng.standard_normal((10, 10)) + 3).tolist()
    rows = [(i, v) for i, v in enumerate(c)] + [(900, None), (901, [None] * 10), (902, [math.nan] * 10), (903, [math.inf] + [0.0] * 9), (904, [1.0] * 9), (905, [])]
    df = spark.createDataFrame([(*r, 1, 2, 3, 4, 5, 6) for r in rows], _VECTORS).repartition(parts)
    got = whiten(df).toPandas()
    deviation, z, e, q = _brute_whitening(np.floor(np.array(c) * 1024).astype("i8") + 100_000)
    assert sorted(got.vec_id.unique()) == list(range(300)) and set(got.n) == {300}
    w = got.pivot(index="vec_id", columns="component", values="whitened").to_numpy()
    want = z @ q[:, :8] / np.sqrt(e[:8])
    assert np.allclose(w, want * np.sign((w * want).sum(0)), atol=1e-9)
    assert got.drop_duplicates("vec_id").sort_values("vec_id").deviation.tolist() == deviation.tolist()
    assert np.allclose(got.groupby("component").explained.first(), e[:8] / e.sum(), rtol=1e-10)
    assert got.identity_error.nunique() == 1 and got.identity_error[0] < 1e-9


def test_whitening_of_odd_tables(spark):
    """Rank below eight, huge entries, repeated rows, one row."""
    rows = [(None, [1.0, 2.0, 1.0]), (1, [2.0, 1.0, 1.0]), (1, [2.0, 1.0, 1.0]), (2, [1.5, 4.0, 1.0])]
    got = whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    assert {r.component for r in got.collect()} == {1, 2} and got.count() == 8
    huge = spark.createDataFrame([(i, [1e300 * (-1) ** i, float(i)]) for i in range(6)], "vec_id long, embedding array<double>")
    assert {r.deviation for r in whiten(huge).collect()} == {None}
    assert whiten(spark.createDataFrame(rows[:1], "vec_id long, embedding array<double>")).collect() == []


# Conversations


def _brute_damage(rows):
    space = lambda x: " " if x is None else str(x)
    out = []
    for conv, turn, role, text in rows:
        k = zlib.crc32(f"{space(conv)}:{space(turn)}".encode()) % 20
        if k == 0:
            continue
        role, text = space(role), space(text)
        text = "" if k == 1 else "".join(c for c in text if c not in ".!?") if k == 2 else text
        out += [(conv, turn, "user" if k == 4 else role, text)] * (2 if k == 3 else 1)
    return out


def _brute_repair(rows):
    """By a search over all edits, each state with its cheapest and then least audit."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))
    faults, seen = [], set()
    for _, _, role, text in rows:
        end = text.rstrip(" \t\n\x0b\x0c\r")
        faults.append("blank" if not end else "duplicate" if (role, text) in seen else "" if end[-1] in ".!?" else "truncated")
        seen.add((role, text))
    step = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
    best = [[None] * 4 for _ in range(len(rows) + 1)]
    for i in range(len(rows), -1, -1):
        own = {q: [] for q in range(4)}
        for q in range(4):
            if i == len(rows):
                own[q] += [(0, "", ())] if q in (0, 3) else []
                continue
            role, text, fault = rows[i][2], rows[i][3], faults[i]
            after = lambda cost, x, to, line: [(cost + best[i + 1][to][0], x + best[i + 1][to][1], line + best[i + 1][to][2])] if best[i + 1][to] else []  # noqa: B023, E731
            own[q] += after(3, "D", q, ())
            if fault in ("", "truncated"):
                extra = fault == "truncated"
                if (q, role[:1]) in step:
                    own[q] += after(extra, "K", step[q, role[:1]], (f"{role}:{text}",))
                for name in ("user", "assistant"):
                    if (q, name[0]) in step:
                        own[q] += after(2 + extra, "R", step[q, name[0]], (f"{name}:{text}",))
        now = [min(own[q], default=None) for q in range(4)]
        for _ in range(6):  # insertions in a row
            for q in range(4):
                for name in ("user", "assistant"):
                    to = step.get((q, name[0]))
                    if to is not None and now[to]:
                        cost, audit, lines = now[to]
                        now[q] = min(x for x in (now[q], (cost + 2, "I" + audit, (f"{name}:", *lines))) if x)
        best[i] = now
    cost, audit, lines = best[0][0]
    turns = [r[1] for r in rows if r[1] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    letters = [r[2][:1] for r in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(letters, letters[1:], strict=False))
    return (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def _conversations(seed: int, long: int) -> list[tuple]:
    rng = random.Random(seed)
    rows = [(i, t, rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None]), rng.choice(["Yes.", "No", " ", "", None, f"line {rng.random()}.", f"cut {rng.random()}"])) for i in range(60) for t in range(rng.randint(1, 9))]
    rows += [(100, t, "user" if t % 7 else "assistant", f"t{t}" + "." * (t % 3 > 0)) for t in range(long)]
    rows += [(101, t // 3, rng.choice(["user", "assistant"]), rng.choice(["Same.", "Other", f"{t}!"])) for t in range(long)]
    rows += [(None, None, None, None), (None, 3, "user", "Hi."), (102, None, "user", "Null turn."), (102, None, "assistant", "Null turn."), (102, 5, "user", "Null turn.")]
    rows += [(103, 1, "user", "Long. " * 40_000), (104, 2, "user", "One."), (104, 2, "user", "One."), (104, 2, "user", "One.")]
    return rows


_CONVERSATIONS = "conv_id long, turn long, role string, text string, conv int, part int, seg int, rows int, m int, said int, key int, hit int"


@pytest.mark.parametrize("segment, long, seed", [(128, 40, 1), (3, 40, 2), (16, 300, 3)])
def test_repair(spark, monkeypatch, segment, long, seed):
    """Cost, the least audit and the repaired text of conversations, in one segment and in many."""
    monkeypatch.setattr(repair, "SEGMENT", segment)
    rows = _conversations(seed, long)
    df = spark.createDataFrame([(*r, *[0] * 8) for r in rows], _CONVERSATIONS).repartition(5)
    left = _brute_damage(rows)
    want = {c: _brute_repair([r for r in left if r[0] == c]) for c in {r[0] for r in left}}
    got = {r[0]: tuple(r)[1:] for r in repair_conversations(damaged(df), copies_col="copies").collect()}
    assert got == want
    undamaged = {c: _brute_repair([tuple(" " if x is None and k > 1 else x for k, x in enumerate(r)) for r in rows if r[0] == c]) for c in {r[0] for r in rows}}
    assert {r[0]: tuple(r)[1:] for r in repair_conversations(df).collect()} == undamaged


def test_repaired_turns(spark):
    """The turns that stay spell the digest, and all edits the audit."""
    df = spark.createDataFrame([(*r, *[0] * 8) for r in _conversations(4, 200)], _CONVERSATIONS)
    told = {r.conv_id: (r.audit, r.repaired_sha256) for r in repair_conversations(df).collect()}
    by: dict = {}
    for r in sorted(repaired_turns(df).collect(), key=lambda r: r.place):
        by.setdefault(r.conv_id, []).append(r)
    text = lambda rs: "\n".join(f"{r.role}:{r.text}" for r in rs if r.edit != "D")
    assert {c: ("".join(r.edit for r in rs), hashlib.sha256(text(rs).encode()).hexdigest()) for c, rs in by.items()} == told


def test_query_on_the_whole_table(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    left = _brute_damage(rows)
    want = sorted((c, *_brute_repair([r for r in left if r[0] == c])) for c in {r[0] for r in rows})
    assert sorted(map(tuple, queries.op13_conversation_repair(spark, sf).collect())) == want


def test_no_conversations(spark):
    df = spark.createDataFrame([], _CONVERSATIONS)
    assert repair_conversations(df).collect() == [] and repaired_turns(df).collect() == []
