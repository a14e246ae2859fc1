"""From recognised speech to corrected words, clips and subtitles, as one batch plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from cuemill.functions.text import caption_text
from cuemill.operators.blocks import group_blocks
from cuemill.operators.clips import clip_captions, transcript_ends, valid_clips, with_layout
from cuemill.operators.ordered import chunk_rows, own_rows, with_next_start, with_repaired_times
from cuemill.operators.pages import group_pages, split_at_sentences
from cuemill.operators.repair import corrected
from cuemill.sources.cliptext import parse_clips
from cuemill.sources.srt import srt_texts
from cuemill.sources.transcripts import asr_words


def transcribed(asr: DataFrame) -> DataFrame:
    """Words of recognised segments, with times where they lack a length."""
    return with_repaired_times(asr_words(asr))


def to_captions(words: DataFrame) -> DataFrame:
    """(B09)"""
    return words.select(
        "project_id", "pos", caption_text("word", "pos").alias("text"), "start_ms", "end_ms", F.col("start_ms").alias("timestamp_ms"), F.lit(None).cast("double").alias("confidence")
    )


def correct(words: DataFrame, answers: DataFrame) -> DataFrame:
    """Words corrected by a model's answers to their chunks.

    ``answers``: (project_id, chunk_no, row_no, word).  Every chunk reads only
    its own rows, so all are fitted at once; stitching goes by place.  Times
    don't change, so a row's end is found before the rows are dealt into chunks.
    """
    end = F.last("end_ms").over(W.partitionBy("project_id").orderBy("pos").rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    timed = with_next_start(words.select("project_id", "pos", "word", "start_ms", "end_ms", end.alias("transcript_end")), "transcript_end")
    fitted = corrected(chunk_rows(timed).select("project_id", "chunk_no", "row_no", "start_ms", "end_ms", "word"), answers, keep=("start_ms", "end_ms"))
    return own_rows(fitted).select("project_id", "pos", "word", "start_ms", "end_ms")


def subtitles(captions: DataFrame, lang: str = "en") -> DataFrame:
    """(project_id, srt)."""
    return srt_texts(group_blocks(captions, lang), lang)


def detected_clips(texts: DataFrame, words: DataFrame) -> DataFrame:
    """Valid clips of a model's suggestions."""
    return valid_clips(parse_clips(texts), transcript_ends(words))


def render_plan(clips: DataFrame, captions: DataFrame, fps: float) -> tuple[DataFrame, DataFrame]:
    """What a renderer needs of each clip: its layout (B16, B17, B19), and its caption pages."""
    clip = ["project_id", "clip_no"]
    shown = clip_captions(captions, clips, fps).select(*clip, "pos", "text", "start_ms", "end_ms")
    return with_layout(clips, fps), split_at_sentences(group_pages(shown, key=clip), key=clip)
