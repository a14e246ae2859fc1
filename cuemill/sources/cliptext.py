"""The free text in which clips are suggested."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuemill.functions.text import SPACE, is_blank, trim
from cuemill.functions.timecode import ms_to_timestamp, timestamp_to_ms
from cuemill.operators.arrays import in_order, let
from cuemill.operators.ordered import with_index

WORD = f"([^{SPACE[1:-1]}]+)"
HEAD = rf"(?im)^CLIP{SPACE}+[0-9]+"
CUT = rf"(?im)^{SPACE}*(?:Cut|Segment){SPACE}+[0-9]+{SPACE}*:{SPACE}*{WORD}{SPACE}*[-–—→]+{SPACE}*{WORD}{SPACE}*$"


def _found(text: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def parse_clips(texts: DataFrame, key: str = "project_id", text: str = "clip_text") -> DataFrame:
    """Clips (key, pos, title, start_ms, end_ms, hook_text) of texts with ``CLIP n`` blocks.

    A block's range is its first ``Cut n: a - b`` line if that is a range, else
    its ``Start:`` and ``End:``; without one the block gives no clip.  Text
    before the first head counts as a block; a title may stand behind other
    letters (``Subtitle:``).
    """
    blocks = texts.select(key, F.posexplode(F.split(text, HEAD)).alias("_block", "b")).where(~is_blank("b"))
    b, label = F.col("b"), lambda name, what: _found(F.col("b"), rf"(?i){name}:{SPACE}*{what}")
    # one reader for all four times, and each block's once: as an array of no or one range
    times = F.transform(F.array(_found(b, CUT, 1), _found(b, CUT, 2), label("Start", WORD), label("End", WORD)), timestamp_to_ms)
    ranges = let(times, lambda t: F.array(*[F.when(F.get(t, F.lit(i + 1)) > F.get(t, F.lit(i)), F.struct(F.get(t, F.lit(i)).alias("s"), F.get(t, F.lit(i + 1)).alias("e"))) for i in (0, 2)]))
    rows = blocks.select(key, "_block", "b", F.explode(F.slice(F.array_compact(ranges), 1, 1)).alias("_r"))
    named = lambda name, other: F.coalesce(trim(label(name, r"([^\n\r]+)")), F.lit(other))
    rows = rows.select(key, "_block", named("Title", "Untitled").alias("title"), F.col("_r.s").alias("start_ms"), F.col("_r.e").alias("end_ms"), named("Hook", "").alias("hook_text"))
    return with_index(rows, "_block", key).select(key, F.col("idx").alias("pos"), "title", "start_ms", "end_ms", "hook_text")


def clip_block(number: Column, title: Column, hook: Column, start: Column, end: Column) -> Column:
    return F.format_string("CLIP %d\nTitle: %s\nHook: %s\nStart: %s\nEnd: %s", number, title, hook, ms_to_timestamp(start), ms_to_timestamp(end))


def clip_texts(clips: DataFrame, key: str = "project_id") -> DataFrame:
    """(key, clip_text): the text that :func:`parse_clips` reads (A09); blocks are numbered from 1."""
    block = clip_block(F.col("pos") + 1, F.col("title"), F.col("hook_text"), F.col("start_ms"), F.col("end_ms"))
    rows = clips.withColumn("_b", block).groupBy(key).agg(in_order("_b").alias("_r"))
    return rows.select(key, F.array_join(F.transform("_r", lambda x: x["_b"]), "\n\n").alias("clip_text"))
