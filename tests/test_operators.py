"""Operators against plain loops and small vectors."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from cuemill import adapters as A
from cuemill import session
from cuemill.operators import blocks as B
from cuemill.operators import clips as C
from cuemill.operators import ordered as O
from cuemill.operators import pages as P
from cuemill.operators import prefix
from cuemill.operators import projects as R
from cuemill.operators import repair as X
from cuemill.operators import states as S
from cuemill.schema import TRANSITIONS

WORDS = "project_id string, pos int, word string, start_ms long, end_ms long"
CAPTIONS = "project_id string, pos int, text string, start_ms long, end_ms long"


@pytest.mark.parametrize(
    "n,windows", [(200, [(0, 200)]), (500, [(0, 500)]), (950, [(0, 500), (450, 950)]), (1400, [(0, 500), (450, 950), (900, 1400)]), (520, [(0, 520)]), (600, [(0, 500), (450, 600)])]
)
def test_chunk_windows(spark, n, windows):
    got = spark.range(1).select(O.chunk_windows(F.lit(n), 500, 50).alias("w")).first()["w"]
    assert [(w["start_idx"], w["end_idx"]) for w in got] == windows
    assert [w["is_first"] for w in got] == [True] + [False] * (len(windows) - 1)


def test_chunk_windows_need_a_stride(spark):
    with pytest.raises(ValueError):
        O.chunk_windows(F.lit(9), 50, 50)


@pytest.mark.parametrize("size,overlap", [(10, 3), (7, 6), (5, 0)])
def test_chunks_stitch_together(spark, size, overlap):
    rows = [(str(n), i, f"w{i}", i, i + 1) for n in range(1, 40, 3) for i in range(n)]
    words = spark.createDataFrame(rows, WORDS)
    cut = O.chunk_rows(words, size, overlap)
    wins = O.chunks(words, size, overlap)
    held = {(r.project_id, r.chunk_no): (r.start_idx, r.end_idx) for r in wins.collect()}
    got = {}
    for r in cut.collect():
        got.setdefault((r.project_id, r.chunk_no), []).append((r.pos, r.row_no))
    assert {k: (min(v)[0], max(v)[0] + 1) for k, v in got.items()} == held
    assert all(sorted(v) == [(held[k][0] + i, i) for i in range(held[k][1] - held[k][0])] for k, v in got.items())
    back = O.stitched(cut.drop("pos"), wins).select("project_id", "pos", "word").collect()
    assert sorted((r.project_id, r.pos, r.word) for r in back) == sorted((a, b, c) for a, b, c, _, _ in rows)


def loop_repair(words):
    """Zero-length words between their neighbours, one run after another."""
    out, i = [list(w) for w in words], 1
    while i < len(out):
        if out[i][0] != out[i][1]:
            i += 1
            continue
        j = i
        while j < len(out) and out[j][0] == out[j][1]:
            j += 1
        prev, n = out[i - 1][1], j - i
        step = ((out[j][0] if j < len(out) else prev + (n + 1) * 300) - prev) / (n + 1)
        for k in range(n):
            out[i + k] = [int(prev + step * (k + 1) + 0.5), int(prev + step * (k + 2) + 0.5)]
        i = j
    return [tuple(x) for x in out]


def test_repaired_times(spark):
    rng, cases = random.Random(1), {"a": [(0, 100), (100, 100), (400, 500)], "b": [(5, 5), (5, 5), (5, 5)], "c": [(0, 1)]}
    for n in range(30):
        t, words = 0, []
        for _ in range(rng.randint(1, 12)):
            end = t + rng.choice([0, 0, 100, 250])
            words.append((t, end))
            t = end + rng.choice([0, 50])
        cases[f"r{n}"] = words
    rows = spark.createDataFrame([(k, i, "w", s, e) for k, v in cases.items() for i, (s, e) in enumerate(v)], WORDS)
    got = {}
    for r in O.with_repaired_times(rows).orderBy("project_id", "pos").collect():
        got.setdefault(r.project_id, []).append((r.start_ms, r.end_ms))
    assert got["a"] == [(0, 100), (250, 400), (400, 500)]
    assert got == {k: loop_repair(v) for k, v in cases.items()}


def test_display_times(spark):
    rows = spark.createDataFrame([("a", 0, "", 0, 500), ("a", 1, "", 2000, 2100), ("b", 0, "", 0, 1900), ("b", 1, "", 1950, 5000)], "project_id string, block_no int, text string, start_ms long, end_ms long")
    got = {(r.project_id, r.block_no): (r.start_ms, r.end_ms) for r in O.with_display_times(rows).collect()}
    assert got == {("a", 0): (0, 1000), ("a", 1): (2000, 3000), ("b", 0): (0, 1870), ("b", 1): (1950, 5000)}


def loop_blocks(captions, brk, bound=("a",)):
    """Subtitle blocks, a word at a time; the rules in the order of the survey."""
    blocks, now = [], []
    for text, start, end in captions:
        t = text.strip()
        if now and start - now[-1][2] > 1000:
            blocks.append(now)
            now = []
        size = len(" ".join(x[0] for x in now)) + bool(now) + len(t)
        if now and size > 84:
            blocks.append(now)
            now = []
        low = t.lower().strip(".,;:!?")
        if len(now) >= 4 and size > 42 and (now[-1][0][-1] in '.,;:!?"()–—' or low in brk) and low not in bound:
            blocks.append(now)
            now = []
        now.append((t, start, end))
    return blocks + [now] * bool(now)


def test_blocks(spark):
    rng = random.Random(2)
    words = ["and", "but", "a", "I", "long,", "word", "sentence.", "x", "extraordinarily", "to", "-", "of"]
    cases = {}
    for n in range(25):
        t, out = 0, []
        for i in range(rng.randint(1, 120)):
            end = t + rng.randint(0, 400)
            out.append(((" " if i else "") + rng.choice(words), t, end))
            t = end + rng.choice([0, 40, 1000, 1001, 30, 30, 30, 30])
        cases[f"p{n}"] = out
    rows = spark.createDataFrame([(k, i, *c) for k, v in cases.items() for i, c in enumerate(v)], CAPTIONS)
    got = {}
    for r in B.group_blocks(rows).orderBy("project_id", "block_no").collect():
        got.setdefault(r.project_id, []).append((r.text, r.start_ms, r.end_ms, r.n_words))
    brk = {"and", "but", "to"}
    want = {k: [(" ".join(w[0] for w in b), b[0][1], b[-1][2], len(b)) for b in loop_blocks(v, brk)] for k, v in cases.items()}
    assert got == want
    assert all(len(t) <= 84 or n == 1 for v in got.values() for t, _, _, n in v)


def test_pages(spark):
    rng, cases = random.Random(3), {}
    for n in range(20):
        t, out = 0, []
        for i in range(rng.randint(1, 40)):
            out.append(((" " if i else "") + rng.choice(["a", "b.", "c!", "d,"]), t, t + 100))
            t += rng.choice([0, 100, 500, 1200, 1201])
        cases[f"p{n}"] = out
    rows = spark.createDataFrame([(k, i, *c) for k, v in cases.items() for i, c in enumerate(v)], CAPTIONS)

    def pages(tokens, split):
        out = []
        for x in tokens:
            if not out or x[1] - out[-1][0][1] > 1200:
                out.append([])
            out[-1].append(x)
        if split:
            parts = []
            for page in out:
                parts.append([])
                for i, x in enumerate(page):
                    parts[-1].append(x)
                    if x[0][-1] in ".!?" and i < len(page) - 1:
                        parts.append([])
            out = parts
        return [("".join(x[0] for x in p), p[0][1], p[-1][2] - p[0][1]) for p in out]

    grouped = P.group_pages(rows)
    for df, split in ((grouped, False), (P.split_at_sentences(grouped), True)):
        got = {}
        for r in df.orderBy("project_id", "page_no").collect():
            got.setdefault(r.project_id, []).append((r.text, r.start_ms, r.duration_ms))
        assert got == {k: pages(v, split) for k, v in cases.items()}


def loop_fit(ins, outs, norm):
    """The greedy walk, a row at a time."""

    def close(a, b):
        if a == b:
            return True
        if min(len(a), len(b)) <= 3:
            return False
        d = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            p, d[0] = d[0], i
            for j, y in enumerate(b, 1):
                p, d[j] = d[j], min(d[j] + 1, d[j - 1] + 1, p + (x != y))
        return d[-1] <= -(-4 * max(len(a), len(b)) // 10)

    a, b = [norm(x) for x in ins], [norm(x) for x in outs]
    o, result = 0, []
    for i, x in enumerate(ins):
        if o >= len(b):
            result.append(x)
            continue
        ahead = next((j for j in range(1, 5) if o + j < len(b) and b[o + j] == a[i]), None)
        behind = next((j for j in range(1, 5) if i + j < len(a) and a[i + j] == b[o]), None)
        if a[i] == b[o]:
            result.append(outs[o])
            o += 1
        elif behind and (not ahead or behind <= ahead):
            result.append(x)
        elif ahead:
            result.append(outs[o + ahead])
            o += ahead + 1
        elif close(a[i], b[o]):
            result.append(outs[o])
            o += 1
        else:
            result.append(x)
    return result


def test_repaired_rows(spark):
    rng, cases = random.Random(4), {}
    vocabulary = ["obchod", "obchodu", "na", "sa", "čas", "cas", "—", "…", "strom", "stromy", "Dom,"]
    for n in range(60):
        ins = [rng.choice(vocabulary) for _ in range(rng.randint(1, 25))]
        outs = [w if rng.random() < 0.8 else rng.choice(vocabulary) for w in ins if rng.random() < 0.85]
        outs += [rng.choice(vocabulary)] * rng.randint(0, 2)
        cases[n] = (ins, outs)
    rows = spark.createDataFrame([(str(k), 0, i, i * 10, w) for k, (ins, _) in cases.items() for i, w in enumerate(ins)], "project_id string, chunk_no int, row_no int, start_ms int, word string")
    answers = spark.createDataFrame([(str(k), 0, i, w) for k, (_, outs) in cases.items() for i, w in enumerate(outs)], "project_id string, chunk_no int, row_no int, word string")
    import re
    import unicodedata

    norm = lambda w: re.sub("[^a-z0-9]", "", unicodedata.normalize("NFD", w.lower()))
    got = {}
    for r in X.repaired(rows, answers).orderBy("project_id", "row_no").collect():
        assert r.start_ms == r.row_no * 10
        got.setdefault(int(r.project_id), []).append(r.word)
    assert got == {k: loop_fit(ins, outs, norm) for k, (ins, outs) in cases.items()}


def test_row_counts(spark):
    rows = spark.createDataFrame([("a", c, i, 0, "w") for c in range(3) for i in range(10)], "project_id string, chunk_no int, row_no int, start_ms int, word string")
    answers = spark.createDataFrame([("a", c, i, "w") for c, n in ((0, 10), (1, 9)) for i in range(n)], "project_id string, chunk_no int, row_no int, word string")
    got = {r.chunk_no: (r.expected, r.actual, r.is_mismatch, r.should_retry) for r in X.row_counts(rows, answers).collect()}
    assert got == {0: (10, 10, False, False), 1: (10, 9, True, False), 2: (10, 0, True, True)}


def test_states(spark, monkeypatch):
    monkeypatch.setattr(S, "BLOCK", 5)  # several blocks a session
    rng, names, cases = random.Random(5), list(TRANSITIONS), {}
    for n in range(12):
        cases[n] = [rng.choice(names[:5]) for _ in range(rng.randint(1, 60))]
    cases[99] = ["UPLOADING", "READY", "TRANSCRIBING", "ALIGNING", "READY"]
    rows = spark.createDataFrame([(k, i, i, s) for k, v in cases.items() for i, s in enumerate(v)], "session_id long, ts int, event_id int, new_state string")
    got = {}
    for r in S.run_states(rows).orderBy("session_id", "seq").collect():
        got.setdefault(r.session_id, []).append((r.accepted, r.state, r.error))
    want = {}
    for k, v in cases.items():
        now, out = "IDLE", []
        for s in v:
            fine = s in TRANSITIONS[now]
            out.append((fine, s if fine else now, None if fine else f"Invalid transition: {now} → {s}"))
            now = s if fine else now
        want[k] = out
    assert got == want
    assert got[99][1] == (False, "UPLOADING", "Invalid transition: UPLOADING → READY")


def test_clip_captions(spark):
    """Every pair once, over several buckets, with captions of no length and negative length."""
    rng = random.Random(6)
    caps = []
    for i in range(200):
        s = rng.randint(0, 400_000)
        caps.append(("a", i, f"t{i}", s, s + rng.choice([0, 10, 500, 70_000, -200])))
    clips = [("a", k, "t", s, s + rng.randint(1, 150_000), None, None, 0, 0) for k, s in enumerate(rng.sample(range(300_000), 12))]
    captions = spark.createDataFrame(caps, CAPTIONS).withColumn("timestamp_ms", F.col("start_ms")).withColumn("confidence", F.lit(None).cast("double"))
    table = spark.createDataFrame(clips, "project_id string, pos int, title string, start_ms long, end_ms long, caption_edits map<int,string>, caption_offset long, trim_start_delta long, trim_end_delta long")
    got = sorted((r.clip_no, r.pos) for r in C.clip_captions(captions, table, 25.0).collect())
    assert got == sorted((k, i) for _, k, _, s, e, *_ in clips for _, i, _, a, b in caps if b > s and a < e)


def test_regenerated_keeps_old_clips(spark):
    cols = "project_id string, pos int, start_ms long, end_ms long"
    old = spark.createDataFrame([("a", 0, 0, 10), ("b", 0, 0, 10)], cols)
    new = spark.createDataFrame([("a", 0, 0, 999), ("b", 0, 5, 9), ("c", 0, 3, 2)], cols)
    ends = spark.createDataFrame([("a", 100), ("b", 100)], "project_id string, transcript_end long")
    none = spark.createDataFrame([], "project_id string, video_ms long")
    got = sorted(map(tuple, C.regenerated_clips(old, new, ends, none).collect()))
    assert got == [("a", 0, 0, 10), ("b", 0, 5, 9)]


def test_synced_renders(spark):
    renders = spark.createDataFrame([("a", "0-1", "exported"), ("a", "0-2", "exported"), ("a", "0-3", "rendering"), ("b", "0-3", "rendering"), ("b", "0-4", "idle")], "project_id string, render_key string, status string")
    files = spark.createDataFrame([("a", "output_0-1.mp4")], "project_id string, file string")
    active = spark.createDataFrame([("b",)], "project_id string")
    assert sorted(tuple(r) for r in R.synced_renders(renders, files, active).collect()) == [("a", "0-1", "exported"), ("b", "0-3", "rendering"), ("b", "0-4", "idle")]


def test_empty_tables(spark):
    words = spark.createDataFrame([], WORDS)
    captions = spark.createDataFrame([], CAPTIONS)
    assert B.group_blocks(captions).count() == P.split_at_sentences(P.group_pages(captions)).count() == O.chunks(words).count() == 0
    assert O.with_repaired_times(words).count() == O.chunk_rows(words).count() == 0


def test_blocks_need_one_shuffle(spark, sf):
    """The words are dealt once; grouping, numbering and timing find them in place."""
    from cuemill.sources.srt import srt_cues

    plan = srt_cues(B.group_blocks(A.captions(spark, sf)))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1 and "Python" not in plan


def _moves(df) -> list[str]:
    """The exchanges of a plan but those that deal the texts."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [x for x in plan.splitlines() if "Exchange" in x and "REPARTITION_BY" not in x]


def test_answers_meet_their_chunks_without_a_shuffle(spark, sf):
    """Rows and answers that are dealt by project are grouped by chunk in place; what lacks the other side is as a left join has it."""
    from cuemill.plans.transcripts import correct

    words = A.words(spark, sf)
    rows = O.chunk_rows(words)
    answers = A.answers_of(rows)
    for df in (X.repaired(rows, answers), X.corrected(rows, answers), X.checked(rows, answers)[0], X.match_counts(X.repaired(rows, answers)), correct(words, answers)):
        assert _moves(df) == []
    kind = "project_id long, chunk_no int, row_no int, start_ms long, word string"
    given = spark.createDataFrame([(1, 0, 0, 0, "one"), (1, 0, 1, 5, "two"), (1, 1, 0, 9, "alone"), (None, 0, 0, 3, "nobody"), (2, None, 0, 4, "nowhere")], kind)
    came = spark.createDataFrame([(1, 0, 1, 0, "TWO"), (1, 0, 0, 0, "One"), (3, 0, 0, 0, "stray"), (None, 0, 0, 0, "NOBODY"), (2, None, 0, 0, "NOWHERE")], kind).drop("start_ms")
    got = sorted(map(tuple, X.repaired(given, came).collect()), key=repr)
    want = [(1, 0, 0, 0, "One", True), (1, 0, 1, 5, "TWO", True), (1, 1, 0, 9, "alone", False), (None, 0, 0, 3, "nobody", False), (2, None, 0, 4, "nowhere", False)]
    assert got == sorted(want, key=repr)


def test_active_tokens_need_no_join(spark, sf):
    """Found in the page's own row: none in a pause, the first of a page at its start, places that count on over pages."""
    pages = P.group_pages(A.captions(spark, sf)).withColumn("at_ms", F.col("start_ms") + 700)
    assert _moves(P.active_tokens(pages)) == []
    rows = [("a", i, w, s, e) for i, (w, s, e) in enumerate([("x", 0, 300), ("y", 400, 900), ("z", 1300, 1400), ("v", 1500, 2100)])]
    pages = P.group_pages(spark.createDataFrame(rows, CAPTIONS))
    at = lambda ms: [(r.page_no, r.text, r.pos) for r in P.active_tokens(pages.withColumn("at_ms", F.col("start_ms") + ms)).orderBy("page_no").collect()]
    assert at(0) == [(0, "x", 0), (1, "z", 2)]
    assert at(300) == [(1, "v", 3)] and at(400) == [(0, "y", 1), (1, "v", 3)] and at(900) == []


def test_ranks_of_a_hot_key(spark):
    """A session with half the rows: blocks give what one window would, and no task of theirs gets over a block."""
    rng = random.Random(8)
    rows = [(1 if i % 2 else rng.choice([None, 2, 3, *range(10, 60)]), rng.randrange(10**6), i, rng.randrange(5)) for i in range(6000)]
    df = spark.createDataFrame(rows, "k int, ts int, event_id int, x int").repartition(7)
    more = dict(sums={"total": F.col("x")}, earlier={"last_x": F.col("x")})
    key = lambda d: sorted(map(tuple, d.select("k", "ts", "event_id", "x", "seq", "total", "last_x").collect()), key=repr)
    whole = prefix.numbered(df, ["k"], ["ts", "event_id"], **more)
    blocks = prefix.numbered(df, ["k"], ["ts", "event_id"], block=500, **more)
    assert key(blocks) == key(whole)
    path = [p for _, p in session._WORK if "/blocks-" in p][-1]
    sizes = [r["count"] for r in spark.read.parquet(path).groupBy("_b").count().collect()]
    assert len(sizes) >= 6 and max(sizes) <= 2 * 500


def test_states_of_a_hot_session(spark, monkeypatch):
    """The operators that number rows give the same with small blocks."""
    rng = random.Random(9)
    rows = [(rng.choice([1, 1, 1, 2, 3]), i, rng.choice(["UPLOADING", "TRANSCRIBING", "ALIGNING", "READY", "IDLE"])) for i in range(900)]
    df = spark.createDataFrame(rows, "session_id int, event_id int, new_state string").withColumn("ts", F.timestamp_seconds((F.col("event_id") / 3).cast("int") * 5))
    renders = df.select("session_id", "ts", "event_id", F.lit("a").alias("render_key"), F.when(F.col("event_id") % 3 == 0, "done").otherwise("start").alias("kind"), F.when(F.col("event_id") % 3 == 0, "exported").when(F.col("event_id") % 3 == 1, "rendering").alias("status"))
    runs = [lambda: S.run_states(df), lambda: S.quiet_saves(df, quiet_ms=6000), lambda: S.accepted_renders(renders), lambda: S.batch_steps(renders)]
    before = [sorted(map(str, f().collect())) for f in runs]
    monkeypatch.setattr(prefix.numbered, "__defaults__", (None, None, 100))
    assert [sorted(map(str, f().collect())) for f in runs] == before


def test_observed_corrections(spark, tmp_path):
    """One pass gives rows and counts; the strict form ends the job and leaves nothing committed."""
    rows = spark.createDataFrame([("a", c, i, 100 * i, f"w{i}") for c in (0, 1, 2) for i in range(10)], "project_id string, chunk_no int, row_no int, start_ms long, word string")
    answers = rows.where("not (chunk_no = 1 and row_no = 3) and not (chunk_no = 2 and row_no > 4)").select("project_id", "chunk_no", "row_no", F.upper("word").alias("word"))
    got, seen = X.checked(rows, answers)
    got.write.parquet(str(tmp_path / "out"))
    assert seen.get == {"chunks": 3, "expected": 30, "actual": 24, "mismatched": 2, "to_retry": 1}
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(spark.read.parquet(str(tmp_path / "out"))) == key(X.corrected(rows, answers))
    strict, _ = X.checked(rows, answers, strict=True)
    with pytest.raises(Exception, match="chunk a/[12]: 10 rows expected, [59] came"):
        strict.write.parquet(str(tmp_path / "strict"))
    assert not (tmp_path / "strict" / "_SUCCESS").exists()
    whole, seen = X.checked(rows, rows.select("project_id", "chunk_no", "row_no", "word"), strict=True)
    assert whole.count() == 30 and seen.get["mismatched"] == 0


@pytest.mark.parametrize("run", [100, 137, 1000])
def test_blocks_of_speech_that_never_pauses(spark, run):
    """Runs give the blocks of one fold: islands of all sizes, ends beside a run's end, empty words; no array is longer than a run and a block."""
    rng = random.Random(run)
    words = ["but", "a", "I", "of", "which", "harbour,", "night.", "x", "", "incomprehensibilities", "and", "sea"]
    rows = []
    for k, (n, pause) in enumerate([(3000, 0), (900, 0.01), (99, 0), (100, 0), (101, 0), (185, 0), (186, 0), (1, 0), (400, 0.3)]):
        at = 0
        for i in range(n):
            rows.append((f"p{k}", 3 * i, rng.choice(words), at, at + 100))
            at += 100 + (2000 if rng.random() < pause else 0)
    df = spark.createDataFrame(rows, "project_id string, pos int, text string, start_ms long, end_ms long").repartition(3)
    key = lambda d: sorted(map(tuple, d.collect()))
    assert key(B.group_blocks(df, run=run)) == key(B.group_blocks(df))
    path = [p for _, p in session._WORK if "/runs-" in p][-1]
    sizes = spark.read.parquet(path).agg(F.max(F.size("rows")), F.count(F.lit(1)), F.count_if("cut")).first()
    assert sizes[0] <= run + B.BLOCK_CHARS + 1 and sizes[1] > sizes[2] > 2


@pytest.mark.parametrize("batch", [37, 10_000])
def test_words_of_runs_are_staged_once_and_not_dealt_again(spark, batch):
    """Blocks that cross runs and Arrow batches are whole, numbered where they are found, and nothing is shuffled behind the staged runs."""
    rng = random.Random(batch)
    rows = [(k, i, rng.choice(["but", "of", "sea,", "night.", None, "x", "incomprehensibilities"]), at, at + 50) for k in (1, None, 2) for i, at in enumerate(sorted(rng.sample(range(600_000), 700)))]
    df = spark.createDataFrame(rows, "project_id long, pos int, text string, start_ms long, end_ms long").fillna("", ["text"])
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(batch))
    try:
        got = B.group_blocks(df, run=120)
    finally:
        spark.conf.set(name, before)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, B.group_blocks(df).collect()))
    path = [p for _, p in session._WORK if "/runs-" in p][-1]
    assert spark.read.parquet(path).agg(F.sum(F.size("rows"))).first()[0] == len(rows)
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()


def test_restored_rows_are_not_joined(spark, sf):
    """By place as a join has it: gaps, surplus, several answers for a row, no answers, null keys, places and words; and the answers move no word."""
    rows = [(p, 0, i, 10 * i, f"w{i}") for p in ("whole", "gap", "twice", "late", "none", None) for i in (0, 1, 2, 3)] + [("whole", 0, None, 0, "x")]
    told = {"whole": [0, 1, 2, 3, 4], "gap": [0, 3, 7], "twice": [0, 2, 2], "late": [1, 2], None: [0, 1], "other": [0]}
    answers = [(p, 0, i, None if (p, i) == ("whole", 1) else f"{p}{i}-{k}") for p, at in told.items() for k, i in enumerate(at)] + [("gap", 0, None, "y")]
    given = spark.createDataFrame(rows, "project_id string, chunk_no int, row_no int, start_ms long, word string")
    found = spark.createDataFrame(answers, "project_id string, chunk_no int, row_no int, word string")
    joined = given.join(found.withColumnRenamed("word", "_new"), ["project_id", "chunk_no", "row_no"], "left").withColumn("word", F.coalesce("_new", "word")).drop("_new")
    got = X.restored(given, found)
    assert got.columns == joined.columns and sorted(map(repr, got.collect())) == sorted(map(repr, joined.collect()))
    words = A.chunked(spark, sf)
    plan = X.restored(words, A.answers_of(words))
    assert not _moves(plan) and "Join" not in plan._jdf.queryExecution().executedPlan().toString()


def test_clips_find_their_captions_in_place(spark, sf):
    """Captions and clips that are dealt by project meet, and pages are made, without another shuffle or a join; null keys meet nothing."""
    from cuemill.plans.transcripts import render_plan

    words = A.words(spark, sf)
    captions, clips = A.as_captions(words), A.clips_of(words)
    for df in (C.clip_captions(captions, clips, 25.0), C.clip_captions(captions, clips, 25.0, edited=False), render_plan(clips, captions, 25.0)[1]):
        assert not _moves(df) and "Join" not in df._jdf.queryExecution().executedPlan().toString()
    one, none = F.col("project_id") == 0, F.lit(None).cast("long")
    few = captions.where(one)
    lost = C.clip_captions(few.withColumn("project_id", none), clips.where(one).withColumn("project_id", none), 25.0)
    assert lost.count() == 0 < C.clip_captions(few, clips.where(one), 25.0).count()
