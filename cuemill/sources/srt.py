"""SRT subtitles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuemill.functions.text import ordered_text
from cuemill.functions.timecode import ms_to_srt_timestamp
from cuemill.operators.blocks import group_blocks, wrapped
from cuemill.operators.ordered import with_display_times


def srt_cues(blocks: DataFrame, lang: str = "en", key: str = "project_id") -> DataFrame:
    """(key, cue_no, start, end, text) of blocks (key, block_no, text, start_ms, end_ms): cues from 1, timed and wrapped."""
    rows = with_display_times(blocks, key)
    return rows.select(
        key,
        (F.col("block_no") + 1).alias("cue_no"),
        ms_to_srt_timestamp("start_ms").alias("start"),
        ms_to_srt_timestamp("end_ms").alias("end"),
        wrapped("text", lang).alias("text"),
    )


def srt_texts(blocks: DataFrame, lang: str = "en", key: str = "project_id") -> DataFrame:
    """(key, srt): whole files (A10)."""
    cue = F.format_string("%d\r\n%s --> %s\r\n%s\r\n\r\n", "cue_no", "start", "end", "text")
    return srt_cues(blocks, lang, key).groupBy(key).agg(ordered_text(cue, "cue_no", "").alias("srt"))


def captions_to_srt(captions: DataFrame, lang: str = "en", key: str = "project_id") -> DataFrame:
    """SRT of word captions."""
    return srt_texts(group_blocks(captions, lang, key), lang, key)


def translated_to_srt(blocks: DataFrame, key: str = "project_id") -> DataFrame:
    """SRT of translated blocks, which are English."""
    return srt_texts(blocks, "en", key)
