"""Values worked out by hand."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from cuemill.functions import clips as C
from cuemill.functions import progress as P
from cuemill.functions import text as T
from cuemill.functions import timecode as M
from cuemill.operators import blocks as B


def one(spark, col, **values):
    """The value of a column over one row of typed values."""
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()] or ["id"])
    return row.select(col).first()[0]


@pytest.mark.parametrize("ms,text", [(83456, "00:01:23.456"), (3600000, "01:00:00.000"), (360000000, "100:00:00.000"), (0, "00:00:00.000"), (-1, None)])
def test_ms_to_timestamp(spark, ms, text):
    assert one(spark, M.ms_to_timestamp("ms"), ms=ms) == text


@pytest.mark.parametrize("text,ms", [("00:11.260", 11260), ("00:00:11,260", 11000), ("12abc:5", 725000), ("x:1", None), ("5", None), ("1:2:3:4", None), ("1:00:00", 3600000), ("", None)])
def test_timestamp_to_ms(spark, text, ms):
    assert one(spark, M.timestamp_to_ms("t"), t=text) == ms


@pytest.mark.parametrize("text,ms", [("1:05", 65000), ("1:60", None), ("-1:05", None), ("1:02:03.5", 3723500), ("1:60:00", None), ("7", None), (" 2:00 ", 120000)])
def test_clock_to_ms(spark, text, ms):
    assert one(spark, M.clock_to_ms("t"), t=text) == ms


def test_input_to_ms(spark):
    assert [one(spark, M.input_to_ms("t"), t=t) for t in ("12.5", "-1", "1:05", "", "x")] == [12500, None, 65000, None, None]


def test_half_up_differs_from_round(spark):
    assert one(spark, M.half_up(F.col("x")), x=-2.5) == -2
    assert one(spark, M.half_up(F.col("x")), x=2.5) == 3


@pytest.mark.parametrize("a,b,same", [("na", "sa", False), ("obchod", "obchodu", True), ("", "", True), ("", "a", False), ("abcd", "abxy", True), ("abcd", "axyz", False)])
def test_similar(spark, a, b, same):
    assert one(spark, T.is_similar("a", "b"), a=a, b=b) is same


def test_normalized(spark):
    assert [one(spark, T.normalized("w"), w=w) for w in ("Ďakujem!", "ČAS,", "łódź", "e\u0301", "—")] == ["dakujem", "cas", "odz", "e", ""]


def test_break_words(spark):
    assert one(spark, T.is_break_word("w", "en"), w="(But)") and not one(spark, T.is_break_word("w", "en"), w="cat")
    # the English list has an upper-case I, but words are looked up in lower case
    assert not one(spark, T.is_bound_word("w", "en"), w="I") and one(spark, T.is_bound_word("w", "en"), w="A,")
    assert one(spark, T.ends_with_punctuation("w"), w="end” )") and one(spark, T.ends_with_punctuation("w"), w="x—\u00a0")


def test_clip_range(spark):
    trims = spark.createDataFrame([(0, 30000, None, None), (0, 30000, None, 0), (100, 200, 50, -10)], "start_ms long, end_ms long, trim_start_delta long, trim_end_delta long")
    assert [tuple(r) for r in trims.select(*C.clip_range()).collect()] == [(0, 30900), (0, 30000), (150, 190)]


def test_frames(spark):
    assert one(spark, C.start_frame(F.col("ms"), F.lit(23.976)), ms=1000) == 24
    assert one(spark, C.frames(F.col("ms"), F.col("ms"), F.lit(25.0)), ms=1000) == 1


def test_progress(spark):
    assert [one(spark, P.clamped("p"), p=p) for p in (150.0, -10.0, 42.0)] == [100.0, 0.0, 42.0]
    assert one(spark, P.bar_percents("o"), o="a 10%|#\rb 20%|##\n30%|") == [10, 20]
    assert [one(spark, P.valid_overlap("o", F.lit(4)), o=o) for o in (30.4, 30.5, -0.5, 1.5)] == [30, 4, 0, 2]


def test_names(spark):
    assert one(spark, T.safe_name("t", F.lit("key")), t="Žltá: a/b") == "_lt__ a_b"
    assert one(spark, T.safe_name("t", F.lit("key")), t="  ") == "key"
    assert one(spark, T.video_name("t"), t="my_best-video.final.mp4") == "my best video.final"
    assert one(spark, T.display_name("n", "p"), n=" ", p="C:\\x\\talk.LUSK") == "talk"


def test_tokens_and_edits(spark):
    assert one(spark, T.tokens("t", F.lit(4)), t="a  b c") == ["a", "  b", " c", ""]
    assert one(spark, T.caption_edits(F.array(F.lit("a"), F.lit(" b")), F.array(F.lit("a"), F.lit("")), F.lit(5))) == {6: ""}


def test_fenced_block(spark):
    assert one(spark, T.fenced_block("t"), t="x\n```tsv\n1\ta\n2\tb\n```\ny") == "1\ta\n2\tb"
    assert one(spark, T.fenced_block("t"), t="  bare \n") == "bare"


@pytest.mark.parametrize("text", ["short", "one two three four five six seven eight, nine ten eleven twelve", "x" * 90, "a" * 40 + " " + "b" * 60])
def test_wrapped(spark, text):
    """By trying each place."""

    def by_hand(t):
        words, best = t.split(), None
        for i in range(len(words) - 1):
            top, bottom = " ".join(words[: i + 1]), " ".join(words[i + 1 :])
            if len(top) > 42 or len(bottom) > 42 or len(top) > len(bottom) or words[i + 1].strip(".,;:!?").lower() in ("a",):
                continue
            score = abs(len(top) - len(t) // 2) - 20 * (words[i][-1] in ".,;:!?") - 10 * (words[i + 1].lower() in "but or and that".split())
            if best is None or score < best[0]:
                best = score, top + "\n" + bottom
        return t if len(t) <= 42 or not best else best[1]

    assert one(spark, B.wrapped("t"), t=text) == by_hand(text)


@pytest.mark.parametrize("told,log,ms", [("0.0", "nothing", 0), ("0.0", "Duration: 00:00:02.50", 2500), ("0.0004", "nothing", 0), (None, "Duration: 00:00:00.00", None), (None, "nothing", None), ("-1", "nothing", None)])
def test_probed_duration_of_zero(spark, told, log, ms):
    json = '{"format": {"duration": "%s"}}' % told if told else "{}"
    assert one(spark, M.probed_duration_ms("json", "log"), json=json, log=log) == ms


def test_white_space_is_the_same_in_each_form(spark):
    """The class that Java looks up, the signs one by one, and the class that SQL has."""
    signs = spark.range(1, 0xFFFE).where("id < 55296 or id > 57343").select("id", F.expr("decode(unhex(lpad(hex(id), 4, '0')), 'UTF-16BE')").alias("c"))
    ways = [F.col("c").rlike(f"^{T.SPACE}"), F.col("c").rlike(f"^{T.SPACE_CLASS}"), T.trim("c") == ""]
    assert signs.where((ways[0] != ways[1]) | (ways[0] != ways[2])).count() == 0 and signs.where(ways[0]).count() == len(T.SPACES) == 25
    # a sign that Java takes for a line's end is none of them
    assert one(spark, T.trim("c"), c="a \u0085") == "a \u0085" and not one(spark, T.ends_with_punctuation("c"), c="a.\u0085")


def test_words_are_dealt_by_bytes_of_input(spark, tmp_path, monkeypatch):
    """More files' bytes make more partitions, which adaptive execution leaves as they are; a small input is dealt as it was."""
    from cuemill import adapters, session

    texts = spark.range(400).select(F.col("id").alias("doc_id"), F.repeat(F.concat(F.sha2(F.col("id").cast("string"), 256), F.lit(" ")), 20).alias("text"))
    texts.write.parquet(str(tmp_path / "documents.parquet"))
    size = session.input_bytes(adapters.table(spark, str(tmp_path), "documents"))
    assert size == sum(f.stat().st_size for f in (tmp_path / "documents.parquet").glob("*.parquet"))
    parts = lambda: adapters.words(spark, str(tmp_path)).select(F.spark_partition_id()).distinct().count()
    assert parts() <= 4
    monkeypatch.setattr(session, "DEALT_BYTES", size // 40)
    assert parts() >= 35
