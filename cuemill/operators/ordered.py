"""Windows over ordered rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from cuemill.functions.text import ends_sentence
from cuemill.functions.timecode import half_up

SILENCE_MS, MIN_DISPLAY_MS, MIN_GAP_MS, STEP_MS, PAGE_MS = 1000, 1000, 80, 300, 1200
CHUNK_ROWS, OVERLAP_ROWS, DOWNLOAD_ROWS, TRANSLATION_ROWS, REGISTRY_ROWS = 250, 30, 2000, 200, 20


def _by(key: str | list[str], order: str = "pos") -> W:
    return W.partitionBy(key).orderBy(order)


def _so_far(key: str, order: str = "pos") -> W:
    return _by(key, order).rowsBetween(W.unboundedPreceding, 0)


def with_next_start(words: DataFrame, fallback: Column | str, key: str = "project_id") -> DataFrame:
    """``end_ms`` becomes the next row's start, the fallback in the last row."""
    fallback = F.col(fallback) if isinstance(fallback, str) else fallback
    # a next row whose start is null gives a null end
    is_last = F.lead(F.lit(1)).over(_by(key)).isNull()
    return words.withColumn("end_ms", F.when(is_last, fallback).otherwise(F.lead("start_ms").over(_by(key))))


def with_islands(rows: DataFrame, gap_ms: int = SILENCE_MS, key: str = "project_id") -> DataFrame:
    """Adds ``island``, from 0: a new one begins where a row starts over ``gap_ms`` after the one before it ended."""
    far = F.col("start_ms") - F.lag("end_ms").over(_by(key)) > gap_ms
    return rows.withColumn("_far", F.coalesce(far.cast("int"), F.lit(0))).withColumn("island", F.sum("_far").over(_so_far(key)).cast("int")).drop("_far")


def with_repaired_times(words: DataFrame, key: str = "project_id") -> DataFrame:
    """Words without a length share the time between their neighbours in equal parts.

    A run of n such words stands between the end of the word before it and the
    start of the next word with a length, or takes ``STEP_MS`` a word if there
    is none.  The first word is never changed.
    """
    flat = (F.col("start_ms") == F.col("end_ms")) & (F.col("pos") > 0)
    # a run is headed by the word before it
    rows = words.withColumn("_flat", flat).withColumn("_run", F.sum(F.when(flat, 0).otherwise(1)).over(_so_far(key)))
    run = W.partitionBy(key, "_run")
    upto = run.orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumns(
        {
            "_prev": F.first("end_ms").over(upto),
            "_j": F.sum(F.col("_flat").cast("int")).over(upto),
            "_n": F.sum(F.col("_flat").cast("int")).over(run),
        }
    )
    # the next head's start, seen from every row of the run: the run's last row has it
    head_next = F.lead("start_ms").over(_by(key))
    rows = rows.withColumn("_after", head_next).withColumn("_next", F.last("_after").over(run.orderBy("pos").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    step = (F.coalesce("_next", F.col("_prev") + (F.col("_n") + 1) * STEP_MS) - F.col("_prev")) / (F.col("_n") + 1)
    start, end = half_up(F.col("_prev") + step * F.col("_j")), half_up(F.col("_prev") + step * (F.col("_j") + 1))
    rows = rows.withColumns({"start_ms": F.when(F.col("_flat"), start).otherwise(F.col("start_ms")), "end_ms": F.when(F.col("_flat"), end).otherwise(F.col("end_ms"))})
    return rows.select(*words.columns)


def with_display_times(blocks: DataFrame, key: str = "project_id", order: str = "block_no") -> DataFrame:
    """Each block shows for a second at least and ends 80 ms before the next, the second coming first."""
    following = F.lead("start_ms").over(_by(key, order))
    least = F.col("start_ms") + MIN_DISPLAY_MS
    end = F.greatest("end_ms", least)
    return blocks.withColumn("end_ms", F.when(end > following - MIN_GAP_MS, F.greatest(least, following - MIN_GAP_MS)).otherwise(end))


def with_sentence_parts(tokens: DataFrame, key: list[str], order: str = "pos", text: str = "text") -> DataFrame:
    """Adds ``part``, from 0 within each page: a new one begins after a token that ends a sentence (F06, as a window)."""
    ends = F.lag(ends_sentence(text).cast("int"), 1, 0).over(_by(key, order))
    return tokens.withColumn("_ends", ends).withColumn("part", F.sum("_ends").over(_by(key, order).rowsBetween(W.unboundedPreceding, 0)).cast("int")).drop("_ends")


def with_frames(pages: DataFrame, fps: float, key: str = "project_id", order: str = "page_no") -> DataFrame:
    """Adds ``start_frame`` and ``n_frames`` (fractions): a page ends with its last token or when the next begins;
    pages that last no time go (F04, C10)."""
    at = lambda ms: ms / 1000 * F.lit(fps)
    following = F.lead("start_ms").over(_by(key, order))
    end = F.least(at(following), at(F.col("end_ms")))
    return pages.withColumn("start_frame", at(F.col("start_ms"))).withColumn("n_frames", end - F.col("start_frame")).where("n_frames > 0")


def _chunk_count(n: Column, size: int, overlap: int) -> Column:
    if overlap >= size:
        raise ValueError("overlap must be smaller than size")
    stride = size - overlap
    k = F.ceil((n - size) / stride).cast("int") + 1
    return F.when(n <= size, 1).when(n - ((k - 2) * stride + size) < overlap, k - 1).otherwise(k)


def chunk_windows(n: Column, size: int = CHUNK_ROWS, overlap: int = OVERLAP_ROWS) -> Column:
    """Array of (chunk_no, start_idx, end_idx, is_first) that covers ``n`` rows with overlapping chunks.

    A last chunk with under ``overlap`` new rows joins the one before it.
    """
    k, stride = _chunk_count(n, size, overlap), size - overlap
    end = lambda i: F.when(i == k - 1, n).otherwise(i * stride + size)
    made = F.transform(
        F.sequence(F.lit(0), k - 1),
        lambda i: F.struct(i.alias("chunk_no"), (i * stride).cast("int").alias("start_idx"), end(i).cast("int").alias("end_idx"), (i == 0).alias("is_first")),
    )
    return F.when(n > 0, made)


def chunks(words: DataFrame, size: int = CHUNK_ROWS, overlap: int = OVERLAP_ROWS, key: str = "project_id") -> DataFrame:
    """(key, chunk_no, start_idx, end_idx, is_first): a project's row windows; a project of no rows has none."""
    sizes = words.groupBy(key).agg(F.count(F.lit(1)).cast("int").alias("_n"))
    return sizes.select(key, F.inline(chunk_windows(F.col("_n"), size, overlap)))


def chunk_rows(words: DataFrame, size: int = CHUNK_ROWS, overlap: int = OVERLAP_ROWS, key: str = "project_id") -> DataFrame:
    """The rows of every chunk: a row in an overlap stands in both, with ``row_no`` from 0 in each.

    Each row finds its chunks from its place and the project's size alone, so no join is needed.
    """
    stride = size - overlap
    n = F.count(F.lit(1)).over(W.partitionBy(key)).cast("int")
    last = F.least(F.floor(F.col("pos") / stride).cast("int"), _chunk_count(F.col("_n"), size, overlap) - 1)
    # earlier chunks that reach the row; the last one reaches every later row
    first = F.greatest(F.lit(0), F.ceil((F.col("pos") - size + 1) / stride).cast("int"))
    rows = words.withColumn("_n", n).withColumn("chunk_no", F.explode(F.sequence(F.least(first, last), last)))
    return rows.withColumn("row_no", (F.col("pos") - F.col("chunk_no") * stride).cast("int")).drop("_n")


def stitched(rows: DataFrame, windows: DataFrame, key: str = "project_id") -> DataFrame:
    """Chunk rows (key, chunk_no, row_no, ...) in one sequence again: rows that the chunk before has are dropped.

    Adds ``pos``.
    """
    before = F.coalesce(F.lag("end_idx").over(_by(key, "chunk_no")), F.lit(0))
    own = windows.select(key, "chunk_no", F.col("start_idx").alias("_start"), before.alias("_from"))
    joined = rows.join(own, [key, "chunk_no"]).withColumn("pos", F.col("_start") + F.col("row_no"))
    return joined.where("pos >= _from").drop("_start", "_from")


def own_rows(rows: DataFrame, size: int = CHUNK_ROWS, overlap: int = OVERLAP_ROWS) -> DataFrame:
    """:func:`stitched` for the windows of :func:`chunk_rows`: without a join, as every chunk but the first begins with ``overlap`` rows of the one before."""
    stride = size - overlap
    return rows.where(f"chunk_no = 0 or row_no >= {overlap}").withColumn("pos", (F.col("chunk_no") * stride + F.col("row_no")).cast("int"))


def with_part(rows: DataFrame, size: int, first: int = 0) -> DataFrame:
    """Adds ``part``: blocks of ``size`` rows, numbered from ``first``."""
    return rows.withColumn("part", (F.floor(F.col("pos") / size) + first).cast("int"))


def recent(entries: DataFrame, path: str = "project_path", order: list[str] = ("ts", "entry_no"), most: int = REGISTRY_ROWS) -> DataFrame:
    """The most recently used paths, newest first, each with its newest entry; adds ``rank`` from 1.

    The newest entry of a path is found by an aggregate, which combines before
    the shuffle; only ``most`` rows are then ranked.
    """
    latest = entries.groupBy(path).agg(F.max_by(F.struct(*entries.columns), F.struct(*order)).alias("_e")).select("_e.*")
    top = latest.orderBy(*[F.desc(c) for c in order]).limit(most)
    return top.withColumn("rank", F.row_number().over(W.orderBy(*[F.desc(c) for c in order])))


def with_index(rows: DataFrame, order: str, key: str = "project_id") -> DataFrame:
    """Adds ``idx`` from 0 (F13); keys that one task can't sort need :func:`cuemill.operators.prefix.numbered`."""
    return rows.withColumn("idx", F.row_number().over(_by(key, order)) - 1)
