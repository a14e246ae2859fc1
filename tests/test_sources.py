"""Readers and writers."""

from __future__ import annotations

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from cuemill.session import clear_work, work_dir
from cuemill.sources import archives, cliptext, documents, events, lines, srt, stores, transcripts, zips
from cuemill.streaming import progress as live


def clips(spark, text):
    rows = cliptext.parse_clips(spark.createDataFrame([("a", text)], "project_id string, clip_text string")).orderBy("pos").collect()
    return [(r.title, r.start_ms, r.end_ms, r.hook_text) for r in rows]


def test_clip_forms(spark):
    """A cut, the older form, several cuts, ranges that are none, several blocks, and lines that only look like these."""
    assert clips(spark, "CLIP 7\nTitle: Harbour at dawn\nHook: Listen to the gulls\nCut 1: 00:02:03.250 - 00:02:41.075") == [("Harbour at dawn", 123250, 161075, "Listen to the gulls")]
    assert clips(spark, "clip 1\nEnd: 01:00:00.001\nStart: 59:59.5") == [("Untitled", 3599500, 3600001, "")]
    assert clips(spark, "CLIP 1\nTitle: Two cuts\nSegment 1: 0:07 – 0:19.5\nCut 2: 0:40 - 0:50\nStart: 0:01\nEnd: 0:02") == [("Two cuts", 7000, 19500, "")]
    assert clips(spark, "CLIP 1\nCut 1: 0:19 - 0:07\nStart: 0:01\nEnd: 0:02") == [("Untitled", 1000, 2000, "")]
    assert clips(spark, "CLIP 1\nTitle: Backwards\nStart: 0:12\nEnd: 0:12\n\nCLIP 2\nTitle: No range") == []
    assert clips(spark, "CLIP 1\nCut 1: soon - later\nCLIP x\nStart: 1:2:3\nEnd: 1:2:3,9 and more") == []
    several = "Intro\nCLIP 1\nTitle: North\nCut 1: 0:11 → 0:13\n\nclip 12\nTitle: South\nSegment 1: 0:14—0:15"
    assert [c[0] for c in clips(spark, several)] == ["North", "South"]
    assert clips(spark, "") == clips(spark, None) == []


def test_tsv(spark):
    text = "\ufeff\n00:00:01.000\thello\n\n00:02.500\t a\tb \nno tab\n00:00:03.000\t \n\tword\nx\tbad\n"
    rows = transcripts.parse_tsv(spark.createDataFrame([("p", text), ("q", None), ("r", "")], "project_id string, tsv string"), F.lit(9000).cast("long")).orderBy("pos").collect()
    assert [(r.word, r.start_ms, r.end_ms, r.malformed) for r in rows] == [("hello", 1000, 2500, False), ("a\tb", 2500, None, False), ("bad", None, 9000, True)]


def test_asr_files(spark, tmp_path):
    (tmp_path / "p1.json").write_text(
        json.dumps({"segments": [{"start": 1.0, "end": 2.5, "text": "x", "words": [{"word": " a "}, {"word": "b", "start": 1.5, "end": 1.75}]}, {"start": 3.0, "end": 4.0, "text": "none", "words": []}, {"start": 5.0, "end": 6.0, "text": "c"}]})
    )
    rows = transcripts.asr_words(transcripts.read_asr(spark, str(tmp_path))).orderBy("pos").collect()
    assert [tuple(r) for r in rows] == [("p1", 0, "a", 1000, 2500), ("p1", 1, "b", 1500, 1750)]


def test_archives(spark, tmp_path):
    good = {"version": 1, "projectId": "x", "videoPath": "../v/a.mp4"}
    rows = spark.createDataFrame([("/p/q/a.lusk", json.dumps(good)), ("/p/b.lusk", json.dumps(good | {"videoPath": "/abs.mp4"}))], "path string, j string").select("path", archives.zipped("j").alias("content"))
    rows = rows.unionByName(spark.createDataFrame([("/p/c.lusk", bytearray(b"no zip"))], "path string, content binary"))
    got = {r.path: (r.project and r.project.videoPath, r.error) for r in archives.parse_archives(rows).collect()}
    assert got["/p/q/a.lusk"] == ("/p/v/a.mp4", None) and got["/p/b.lusk"] == ("/abs.mp4", None)
    assert got["/p/c.lusk"][0] is None and "project.json" in got["/p/c.lusk"][1]
    documents = archives.parse_archives(rows).where("error is null").select("path", "project")
    archives.write_archives(documents, f"file://{tmp_path}")
    back = archives.read_archives(spark, str(tmp_path)).collect()
    assert len(back) == 2 and {r.project.projectId for r in back} == {"x"}


def test_registry(spark, tmp_path):
    texts = spark.createDataFrame([('[{"project_id": "a"}, {"project_id": "b"}]',), ("{}",), ("nonsense",), (None,)], "value string")
    assert [len(r[0]) for r in texts.select(stores.parse_registry("value")).collect()] == [2, 0, 0, 0]
    entries = spark.createDataFrame([("b", "/b", 2), ("a", "/a", 1)], "project_id string, project_path string, rank int")
    for c in ("video_name", "state", "updated_at", "thumbnail"):
        entries = entries.withColumn(c, F.lit(None).cast("string"))
    stores.write_registry(entries.withColumn("missing", F.lit(False)), str(tmp_path / "r"))
    assert [(r.entry_no, r.project_id) for r in stores.read_registry(spark, str(tmp_path / "r")).orderBy("entry_no").collect()] == [(0, "a"), (1, "b")]


def test_events(spark):
    body = 'data: {"sessionId": "s", "state": "READY", "progress": 5, "message": ""}\n\n: ping\n\ndata: {bad\n\nevent: x\ndata: {"sessionId": "t"}\n\ndata: {"sessionId": "open"}'
    got = events.parse_events(spark.createDataFrame([(body,)], "body string")).orderBy("event_no").collect()
    assert [(r.event_no, r.event.sessionId) for r in got] == [(0, "s"), (3, "t")]


def test_srt_text(spark):
    rows = spark.createDataFrame([("a", 0, "hi", 0, 500), ("a", 1, "there", 2000, 4000)], "project_id string, block_no int, text string, start_ms long, end_ms long")
    assert srt.srt_texts(rows).first()["srt"] == "1\r\n00:00:00,000 --> 00:00:01,000\r\nhi\r\n\r\n2\r\n00:00:02,000 --> 00:00:04,000\r\nthere\r\n\r\n"


def test_subscribers(spark):
    """A snapshot of the newest event by then, and what comes later."""
    events_ = spark.createDataFrame([("a", 1, 10), ("a", 2, 20), ("a", 3, 20), ("a", 4, 30), ("b", 5, 40)], "session_id string, event_id int, ts int")
    who = spark.createDataFrame([("x", "a", 20), ("y", "a", 5), ("z", "b", 40), ("q", "c", 1)], "subscriber string, session_id string, connected_at int")
    assert sorted((r.subscriber, r.event_id) for r in live.on_connect(events_, who).collect()) == [("x", 3), ("z", 5)]
    assert sorted((r.subscriber, r.event_id) for r in live.heard(events_, who).collect()) == [("x", 4), ("y", 1), ("y", 2), ("y", 3), ("y", 4)]
    assert [r.value for r in live.to_events(events_.limit(1), F.struct("event_id")).collect()] == ['data: {"event_id":1}\n\n']


def test_saves_of_many_batches(spark, tmp_path):
    """Deltas and bases together hold each session's newest row."""
    for i in range(7):
        rows = spark.createDataFrame([(s, 10 * i + s, 10 * (i if s else -i)) for s in range(i % 3 + 1)], "session_id int, event_id int, ts int")
        rows.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("session_id int, event_id int, ts int").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    live.serial_saves(stream, str(tmp_path / "out"), str(tmp_path / "log"), merge_every=3).awaitTermination()
    got = {r.session_id: r.event_id for r in live.saved(spark, str(tmp_path / "out")).collect()}
    assert got == {0: 0, 1: 51, 2: 52} and (tmp_path / "out" / "base=5").exists()


def test_merged_styles(spark):
    """Given styles win over default ones, field by field."""
    rows = spark.createDataFrame([(("serif", None),), ((None, 30),)], "styles struct<font string, size int>")
    got = rows.select(stores.merged_styles(F.col("styles"), {"font": "sans", "size": 42}).alias("s")).collect()
    assert [tuple(r.s) for r in got] == [("serif", 42), ("sans", 30)]


def test_lines_of_chunks(spark, monkeypatch, tmp_path):
    """Chunks that cut lines, characters and line ends; batches that begin anywhere; small tasks."""
    monkeypatch.setattr(lines, "TASK_BYTES", 50)
    monkeypatch.setattr(lines, "STEP", 7)
    rng = random.Random(3)
    texts = {p: "".join(rng.choice(["ab", "é", "😀", "\n", "\r", "\r\n", "x" * 30, ""]) for _ in range(200)).encode() for p in ("a", "b/c")}
    texts["d"] = b"no end"
    at = work_dir(spark, "test").removeprefix("file:")
    done = dict.fromkeys(texts, 0)
    out = []
    for batch in range(6):
        for p, text in texts.items():
            os.makedirs(f"{at}/in/{p}", exist_ok=True)
            for k in range(3):
                n = rng.randrange(60) if batch < 5 else len(text)
                if text[done[p] : done[p] + n]:
                    with open(f"{at}/in/{p}/{batch}-{k}", "ab") as f:
                        f.write(text[done[p] : done[p] + n])
                done[p] += n
        query = lines.read_lines(spark, f"{at}/in").writeStream.format("parquet").option("checkpointLocation", f"{at}/log").trigger(availableNow=True).start(f"{at}/out")
        query.awaitTermination()
        out.append(spark.read.schema("process string, offset long, line string").parquet(f"{at}/out").count())
    got = sorted(map(tuple, spark.read.parquet(f"{at}/out").collect()))
    want = []
    for p, text in texts.items():
        offset = 0
        for line in text.replace(b"\r", b"\n").split(b"\n")[:-1]:
            want.append((p, offset, line.decode()))
            offset += len(line) + 1
    assert got == sorted(want) and 0 < out[0] < out[2] < out[-1]
    clear_work()


def test_percent(spark):
    rows = spark.createDataFrame([(" 45%|####  | 9/20",), ("100%|##|",), ("12% done",), (None,)], "line string")
    assert [r.p for r in rows.select(lines.percent("line").alias("p")).collect()] == [46, 90, None, None]


def _below(folder) -> set[str]:
    return {str(p.relative_to(folder)) for p in folder.rglob("*") if p.is_file() and not p.name.endswith(".crc")}


def test_pieces_of_files(spark, tmp_path):
    """Archives and plain files in pieces; order, long entries, empty ones, names of other scripts; a second write replaces a file."""
    rows = [("a/x.zip", 1, "two", 0, b"2"), ("a/x.zip", 0, "one", 2, b"c" * 100), ("a/x.zip", 0, "one", 0, b"a"), ("a/x.zip", 0, "one", 1, b"b" * 70), ("/b.zip", 0, "\u00e9/empty", 0, b""), ("c.txt", None, None, 1, b"!"), ("c.txt", None, None, 0, b"hello")]
    df = spark.createDataFrame(rows, "path string, entry_no int, entry string, piece int, content binary")
    zips.write_pieces(df, str(tmp_path))
    zips.write_pieces(df.where("path = 'c.txt'"), f"file:{tmp_path}")
    assert _below(tmp_path) == {"a/x.zip", "b.zip", "c.txt"} and (tmp_path / "c.txt").read_bytes() == b"hello!"
    (tmp_path / "bad.zip").write_bytes(b"no archive")
    got = sorted((r.path, r.entry_no, r.entry, r.piece, bytes(r.content) if r.content is not None else None, r.error is not None) for r in zips.read_pieces(spark, str(tmp_path), piece=64).collect())
    one = b"a" + b"b" * 70 + b"c" * 100
    want = [("a/x.zip", 0, "one", k, one[64 * k : 64 * k + 64], False) for k in range(3)] + [("a/x.zip", 1, "two", 0, b"2", False), ("b.zip", 0, "\u00e9/empty", 0, b"", False), ("bad.zip", None, None, None, None, True)]
    assert got == sorted(want)


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    """Files of tasks that did end are not seen either."""
    rows = spark.range(40).select(F.format_string("f%d.txt", "id").alias("path"), F.lit(None).cast("int").alias("entry_no"), F.lit(None).cast("string").alias("entry"), F.lit(0).alias("piece"), F.col("id").cast("string").cast("binary").alias("content"))
    broken = rows.withColumn("content", F.when(F.col("path") == "f7.txt", F.raise_error(F.lit("broken")).cast("binary")).otherwise(F.col("content")))
    (tmp_path / "old.txt").write_text("stays")
    with pytest.raises(Exception, match="broken"):
        zips.write_pieces(broken, str(tmp_path))
    wrong = rows.withColumn("content", F.when(F.col("path") != "f7.txt", F.col("content")))  # null bytes fail in the writer, after the shuffle
    with pytest.raises(Exception, match="bytes"):
        zips.write_pieces(wrong, str(tmp_path))
    assert _below(tmp_path) == {"old.txt"} and not list(tmp_path.glob("_writing*"))
    zips.write_pieces(rows, str(tmp_path))
    assert len(_below(tmp_path)) == 41


def test_files_in_shards(spark, tmp_path):
    """The driver moves and lists the folders of shards, never their files; plain files and archives are read by tasks."""
    rows = [(f"{i}/t.tsv", None, None, 0, b"line %d" % i) for i in range(300)] + [("7/a.zip", 0, "x", 0, b"inner")]
    df = spark.createDataFrame(rows, "path string, entry_no int, entry string, piece int, content binary")
    zips.write_pieces(zips.sharded(df, 200), str(tmp_path), F.substring_index("path", "/", 1))
    reader = zips.ZipReader(str(tmp_path), ".zip", 1 << 20, ".tsv")
    named = [p for part in reader.partitions() for p in part.paths]
    assert sorted(named) == sorted(os.listdir(tmp_path)) and 128 <= len(named) <= 200
    got = sorted((r.path.split("/", 1)[1], r.entry, bytes(r.content)) for r in zips.read_pieces(spark, str(tmp_path), plain=".tsv").collect())
    assert got == sorted((p, e, c) for p, _, e, _, c in rows)
    zips.write_pieces(zips.sharded(df.limit(0).unionByName(spark.createDataFrame([("7/t.tsv", None, None, 0, b"new"), ("900/t.tsv", None, None, 0, b"")], df.schema)), 200), str(tmp_path))
    got = {r.path.split("/", 1)[1]: bytes(r.content) for r in zips.read_pieces(spark, str(tmp_path), suffix="no", plain=".tsv").collect()}
    assert got == {p: c for p, _, e, _, c in rows if e is None} | {"7/t.tsv": b"new", "900/t.tsv": b""}


def test_download(spark):
    """A short transcript is one file; a longer one is an archive whose whole text is its parts."""
    words = spark.createDataFrame([("a", i, f"w{i}", 1000 * i) for i in range(5)] + [("b", i, f"w{i}", 1000 * i) for i in range(4)], "project_id string, pos int, word string, start_ms long")
    rows = sorted((r.path, r.entry_no, r.entry or "", r.piece, bytes(r.content).decode()) for r in transcripts.download_pieces(words, 4).collect())
    line = lambda i: f"00:00:0{i}.000\tw{i}"
    four = "\n".join(map(line, range(4)))
    assert rows == [
        ("a/transcription_chunked.zip", 0, "transcription_full.tsv", 1, four + "\n"),
        ("a/transcription_chunked.zip", 0, "transcription_full.tsv", 2, line(4)),
        ("a/transcription_chunked.zip", 1, "transcription_part_1.tsv", 0, four),
        ("a/transcription_chunked.zip", 2, "transcription_part_2.tsv", 0, line(4)),
        ("b/transcription.tsv", 0, "", 0, four),
    ]


def test_unchecked_documents(spark):
    """Types that fit are read, others are errors; absent and null fields are none; other columns stay."""
    texts = ['{"version": 1.0, "videoWidth": "640", "videoName": 7, "transcript": {"text": 5, "words": [{"word": "a", "startMs": "12"}, 3]}}', '{"captions": [], "videoHeight": "tall", "b": 1, "a": null, "state": null}', "[1]", "7", "{", "", None, '{"version": 9, "transcript": "no"}']
    rows = spark.createDataFrame(list(enumerate(texts)), "project int, json string").withColumnRenamed("project", "n")
    got = {r.n: r for r in documents.read_documents(rows).collect()}
    first = got[0].project
    assert (first.version, first.videoWidth, first.videoName, first.state, got[0].errors, got[0].unknown) == (1, 640, "7", None, [], [])
    assert first.transcript.text == "5" and first.transcript.words[0].startMs == 12
    assert got[1].project.captions == [] and got[1].errors == ["videoHeight: INT expected, STRING found"] and got[1].unknown == ["a", "b"]
    for n in (2, 3, 4, 5, 6):
        assert (got[n].project, got[n].errors, got[n].unknown) == (None, ["no JSON object"], [])
    assert got[7].project.version == 9 and got[7].errors == ["transcript: OBJECT expected, STRING found", "version 9 is not known"]
