"""Timed-text tables made from the driver's tables.

The driver has no transcripts.  These rules turn documents into words with
times and the like, so that every operator has something to work on; they are
stand-ins, not recordings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from cuemill.functions.clips import clip_range, render_key
from cuemill.functions.text import caption_text
from cuemill.functions.timecode import ms_to_timestamp
from cuemill.operators.clips import transcript_ends
from cuemill.operators.ordered import chunk_rows
from cuemill.session import dealt

CUT_MS, FPS = 25_000, 23.976
#: Requests that event types stand for.
REQUESTS = {"signup": "UPLOADING", "view": "TRANSCRIBING", "click": "ALIGNING", "purchase": "READY", "error": "IDLE"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def timed_words(texts: DataFrame, key: Column, text: str = "text") -> DataFrame:
    """(project_id, pos, word, start_ms, end_ms).

    Words last 60 ms a letter, with a pause of 1200 ms after a sentence, 300
    after a comma and 40 otherwise.  Texts are dealt by key before they are cut
    into words: one shuffle of texts, and every later step that goes by project
    finds its rows in place.
    """
    tokens = F.filter(F.split(text, "[ \n\t]+"), lambda w: w != "")
    rows = dealt(texts.select(key.alias("project_id"), tokens.alias("_t")), "project_id").select("project_id", F.posexplode("_t").alias("pos", "word"))
    length = F.length("word").cast("long") * 60
    gap = F.when(F.col("word").rlike("[.!?]$"), 1200).when(F.col("word").rlike("[,;:]$"), 300).otherwise(40)
    end = F.sum(length + gap).over(W.partitionBy("project_id").orderBy("pos").rowsBetween(W.unboundedPreceding, 0)) - gap
    rows = rows.withColumn("end_ms", end)
    return rows.select("project_id", "pos", "word", (F.col("end_ms") - length).alias("start_ms"), "end_ms")


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of ``documents``, one project a document."""
    return timed_words(table(spark, sf_dir, "documents"), F.col("doc_id"))


def captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(project_id, pos, text, start_ms, end_ms, timestamp_ms, confidence)."""
    return as_captions(words(spark, sf_dir))


def as_captions(rows: DataFrame) -> DataFrame:
    return rows.select(
        "project_id",
        "pos",
        caption_text("word", "pos").alias("text"),
        "start_ms",
        "end_ms",
        F.col("start_ms").alias("timestamp_ms"),
        F.lit(None).cast("double").alias("confidence"),
    )


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of ``conversations``, one project a conversation."""
    told = table(spark, sf_dir, "conversations")
    joined = told.groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), " ").alias("text"))
    return timed_words(joined, F.col("conv_id"))


def clips_of(rows: DataFrame) -> DataFrame:
    """Clips of 25 seconds that cover each project and run over its end.

    Every third has no trim; the others have trims of zero, and every fourth an offset.
    """
    ends = transcript_ends(rows)
    at = ends.select("project_id", F.explode(F.sequence(F.lit(0), F.floor(F.col("transcript_end") / CUT_MS).cast("int"))).alias("pos"))
    pos, none = F.col("pos"), F.lit(None).cast("long")
    trim = F.when(pos % 3 == 0, none).otherwise(F.lit(0).cast("long"))
    return at.select(
        "project_id",
        "pos",
        F.format_string("doc-%d-%d", "project_id", "pos").alias("title"),
        (pos * CUT_MS).cast("long").alias("start_ms"),
        ((pos + 1) * CUT_MS).cast("long").alias("end_ms"),
        F.format_string("hook %d", "pos").alias("hook_text"),
        F.create_map(F.lit(7), F.lit(" EDITED")).alias("caption_edits"),
        F.when(pos % 4 == 1, F.lit(50).cast("long")).alias("caption_offset"),
        trim.alias("trim_start_delta"),
        trim.alias("trim_end_delta"),
    )


def clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clips_of(words(spark, sf_dir))


def renders_of(rows: DataFrame) -> DataFrame:
    """Render states of clips (T6): exported, rendering or none, in turn."""
    start, end = clip_range()
    status = F.element_at(F.array(F.lit("exported"), F.lit("rendering")), (F.col("pos") % 3 + 1).cast("int"))
    kept = rows.where("pos % 3 < 2")
    return kept.select("project_id", render_key(start, end).alias("render_key"), status.alias("status"))


def answers_of(rows: DataFrame) -> DataFrame:
    """What a model might answer to chunk rows (T3): every 11th row is missing, every 5th ends in ``s``, each 4th chunk is whole."""
    given = rows.select("project_id", "chunk_no", "row_no", "word").where("chunk_no % 4 = 3 or row_no % 11 <> 10")
    place = F.row_number().over(W.partitionBy("project_id", "chunk_no").orderBy("row_no")) - 1
    return given.select("project_id", "chunk_no", place.alias("row_no"), F.when(F.col("row_no") % 5 == 4, F.concat("word", F.lit("s"))).otherwise(F.col("word")).alias("word"))


def chunked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of overlapping chunks."""
    return chunk_rows(words(spark, sf_dir))


def marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, ms, seconds): times up to 111 hours and amounts of seconds, from ``events``."""
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), (F.col("event_id") * 7_919_013 % 400_000_000).alias("ms"), F.col("value").alias("seconds"))


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(session_id, ts, event_id, new_state, progress) (T4)."""
    kinds = F.create_map(*[F.lit(x) for pair in REQUESTS.items() for x in pair])
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("session_id"), F.col("ts").cast("timestamp").alias("ts"), "event_id", kinds[F.col("event_type")].alias("new_state"), (F.col("value") - 20).alias("progress")
    )


def registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(project_id, project_path, video_name, state, updated_at, thumbnail, ts, entry_no): three uses of each project, from ``events`` (T5)."""
    rows = table(spark, sf_dir, "events").withColumn("_n", F.floor(F.col("event_id") / 3))
    return rows.select(
        F.format_string("p%d", "_n").alias("project_id"),
        F.format_string("/home/u/%d.lusk", "_n").alias("project_path"),
        F.when(F.col("_n") % 3 == 0, F.lit(None)).otherwise(F.format_string("Video %d", "_n")).alias("video_name"),
        F.lit("READY").alias("state"),
        F.format_string("t%d", "event_id").alias("updated_at"),
        F.when(F.col("_n") % 4 > 0, "picture").alias("thumbnail"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("event_id").alias("entry_no"),
    )


def time_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, text): times as people type them, good and bad, from :func:`marks`."""
    rows, at = marks(spark, sf_dir), F.col("id") % 10
    clock = F.format_string("%d:%02d", F.expr("ms div 60000"), F.expr("ms div 1000 % 60"))
    text = F.when(at == 0, ms_to_timestamp("ms")).when(at == 1, clock).when(at == 2, ms_to_timestamp("ms", ",")).when(at == 3, "abc").when(at == 4, F.format_string("%d.5", "id"))
    text = text.when(at == 5, "-3:10").when(at == 6, "1:75").when(at == 7, "1:2:3:4").when(at == 8, " 2:03.25xyz ").otherwise("x:10")
    return rows.select("id", text.alias("text"))


def vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(word): the different words of ``documents``."""
    tokens = F.filter(F.split("text", "[ \n\t]+"), lambda w: w != "")
    return table(spark, sf_dir, "documents").select(F.explode(tokens).alias("word")).distinct()
