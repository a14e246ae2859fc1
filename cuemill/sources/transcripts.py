"""Speech recognition output and timestamped TSV."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from cuemill.functions.text import is_blank, ordered_text, trim
from cuemill.functions.timecode import is_malformed_timestamp, ms_to_timestamp, seconds_to_ms, timestamp_to_ms
from cuemill.operators.ordered import DOWNLOAD_ROWS, with_index, with_next_start, with_part
from cuemill.schema import ASR


def read_asr(spark: SparkSession, path: str) -> DataFrame:
    """(project_id, segments) of JSON files, one a project, named by the file."""
    name = F.regexp_replace(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1), r"\.json$", "")
    return spark.read.schema(ASR).json(path, multiLine=True).select(name.alias("project_id"), "segments")


def asr_words(asr: DataFrame, key: str = "project_id") -> DataFrame:
    """Words (key, pos, word, start_ms, end_ms) of recognised segments.

    Words are trimmed; one without a start or end takes its segment's; segments
    without words vanish.  Dealt by key first, so that numbering the words needs
    no second shuffle.
    """
    segments = asr.repartition(key).select(key, F.posexplode("segments").alias("_seg", "s"))
    words = segments.select(key, "_seg", F.col("s.start").alias("_from"), F.col("s.end").alias("_to"), F.posexplode("s.words").alias("_word", "w"))
    rows = words.select(
        key,
        F.struct("_seg", "_word").alias("_at"),
        trim("w.word").alias("word"),
        seconds_to_ms(F.coalesce("w.start", "_from")).alias("start_ms"),
        seconds_to_ms(F.coalesce("w.end", "_to")).alias("end_ms"),
    )
    return with_index(rows, "_at", key).select(key, F.col("idx").alias("pos"), "word", "start_ms", "end_ms")


def tsv_line(start_ms: Column | str = "start_ms", word: Column | str = "word") -> Column:
    """``HH:MM:SS.mmm<TAB>word``."""
    return F.concat(ms_to_timestamp(start_ms), F.lit("\t"), F.col(word) if isinstance(word, str) else word)


def tsv_texts(words: DataFrame, key: str | list[str] = "project_id") -> DataFrame:
    """(key, tsv): one text a project."""
    by = [key] if isinstance(key, str) else key
    return words.groupBy(*by).agg(ordered_text(tsv_line(), "pos", "\n").alias("tsv"))


def tsv_parts(words: DataFrame, size: int = DOWNLOAD_ROWS, key: str = "project_id") -> DataFrame:
    """(key, part, n_lines, tsv): texts of at most ``size`` lines, from part 1."""
    parts = with_part(words, size, first=1)
    return parts.groupBy(key, "part").agg(F.count(F.lit(1)).alias("n_lines"), ordered_text(tsv_line(), "pos", "\n").alias("tsv"))


def download_pieces(words: DataFrame, size: int = DOWNLOAD_ROWS, key: str = "project_id") -> DataFrame:
    """The download of each project as pieces of files (path, entry_no, entry, piece, content) for :func:`cuemill.sources.zips.write_pieces`.

    A transcript of at most ``size`` lines is a plain file, a longer one an
    archive of the whole text and its parts.  The whole text is put together
    from the parts as it is written, never in memory.
    """
    parts = tsv_parts(words, size, key).withColumn("n", F.max("part").over(W.partitionBy(key)))
    short = F.struct(F.lit("transcription.tsv").alias("file"), F.lit(0).alias("entry_no"), F.lit(None).cast("string").alias("entry"), F.lit(0).alias("piece"), F.col("tsv").alias("content"))
    archive = F.lit("transcription_chunked.zip").alias("file")
    whole = F.struct(archive, F.lit(0).alias("entry_no"), F.lit("transcription_full.tsv").alias("entry"), F.col("part").alias("piece"), F.when(F.col("part") < F.col("n"), F.concat("tsv", F.lit("\n"))).otherwise(F.col("tsv")).alias("content"))
    part = F.struct(archive, F.col("part").alias("entry_no"), F.format_string("transcription_part_%d.tsv", "part").alias("entry"), F.lit(0).alias("piece"), F.col("tsv").alias("content"))
    rows = parts.select(key, F.inline(F.when(F.col("n") == 1, F.array(short)).otherwise(F.array(whole, part))))
    return rows.select(F.concat_ws("/", F.col(key).cast("string"), "file").alias("path"), "entry_no", "entry", "piece", F.col("content").cast("binary").alias("content"))


def tsv_pieces(words: DataFrame, size: int = DOWNLOAD_ROWS, key: str = "project_id") -> DataFrame:
    """The parts of each project as plain files (path, entry_no, entry, piece, content) for :func:`cuemill.sources.zips.write_pieces`."""
    path = F.format_string("%s/part_%d.tsv", F.col(key).cast("string"), "part")
    none = F.lit(None)
    return tsv_parts(words, size, key).select(path.alias("path"), none.cast("int").alias("entry_no"), none.cast("string").alias("entry"), F.lit(0).alias("piece"), F.col("tsv").cast("binary").alias("content"))


def write_tsv(words: DataFrame, path: str, size: int = DOWNLOAD_ROWS, key: str = "project_id") -> None:
    """A folder for each project and part, with the lines as text."""
    lines = with_part(words, size, first=1).select(key, "part", "pos", tsv_line().alias("value"))
    lines.repartition(key, "part").sortWithinPartitions(key, "part", "pos").drop("pos").write.partitionBy(key, "part").text(path)


def parse_tsv(texts: DataFrame, fallback: Column | str, key: str = "project_id", text: str = "tsv") -> DataFrame:
    """Words (key, pos, word, start_ms, end_ms, malformed) of timestamped texts.

    Blank lines go, and lines without a time or a word.  The first tab parts
    them; later tabs stay in the word.  A word ends where the next starts, the
    last at ``fallback``.  A time that begins with no number gives a null start;
    one without two or three parts is marked ``malformed``, and strict readers
    reject the whole text.
    """
    fallback = F.col(fallback) if isinstance(fallback, str) else fallback
    lines = texts.select(key, fallback.alias("_end"), F.col(text).alias("_text")).repartition(key)
    lines = lines.select(key, "_end", F.posexplode(F.split(trim("_text"), "\n")).alias("_line", "line")).where(~is_blank("line"))
    cut = F.split("line", "\t", 2)
    time, word = F.get(cut, F.lit(0)), trim(F.coalesce(F.get(cut, F.lit(1)), F.lit("")))
    rows = lines.select(key, "_end", "_line", time.alias("_time"), word.alias("word")).where("_time <> '' and word <> ''")
    rows = rows.select(key, "_end", "_line", "word", timestamp_to_ms(trim("_time")).alias("start_ms"), is_malformed_timestamp(trim("_time")).alias("malformed"))
    rows = with_index(rows, "_line", key).withColumnRenamed("idx", "pos")
    return with_next_start(rows, "_end", key).select(key, "pos", "word", "start_ms", "end_ms", "malformed")


def read_tsv(spark: SparkSession, path: str, fallback_ms: int = 0) -> DataFrame:
    """Words of TSV files, one a project, named by the file."""
    name = F.regexp_replace(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1), r"\.tsv$", "")
    texts = spark.read.text(path, wholetext=True).select(name.alias("project_id"), F.col("value").alias("tsv"))
    return parse_tsv(texts, F.lit(fallback_ms).cast("long"))


def transcript_texts(words: DataFrame, key: str = "project_id") -> DataFrame:
    """(key, text): words joined by spaces."""
    return words.groupBy(key).agg(ordered_text("word", "pos").alias("text"))
