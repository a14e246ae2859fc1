"""Clips: which are valid, which captions they show, how the list of them changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from cuemill.functions.clips import clip_range, frames, render_key, snapped_ms, start_frame

#: Captions and clips meet in buckets of this length.
BUCKET_MS = 60_000


def transcript_ends(words: DataFrame, key: str = "project_id") -> DataFrame:
    """(key, transcript_end): the end of the last word by place, which need not be the greatest end."""
    return words.groupBy(key).agg(F.max_by("end_ms", "pos").alias("transcript_end"))


def valid_clips(clips: DataFrame, ends: DataFrame, key: str = "project_id") -> DataFrame:
    """Clips that a detector found: they begin at zero or later, have a length and end by the last word's end.

    The untrimmed range counts.  A project without words ends at zero.
    """
    rows = clips.join(ends, key, "left").withColumn("transcript_end", F.coalesce("transcript_end", F.lit(0)))
    return rows.where("start_ms >= 0 and end_ms > start_ms and end_ms <= transcript_end").drop("transcript_end")


def regenerated_clips(old: DataFrame, found: DataFrame, ends: DataFrame, durations: DataFrame, key: str = "project_id") -> DataFrame:
    """Clips after a new search (C04, S05): a project's new valid clips replace its old ones; with none the old ones stay.

    The bound is the later of the last word's end and the video's duration
    (key, video_ms); a bound of zero or less holds nothing back.
    """
    bounds = ends.join(durations, key, "full").select(key, F.greatest(F.coalesce("transcript_end", F.lit(0)), F.coalesce("video_ms", F.lit(0))).alias("_bound"))
    rows = found.join(bounds, key, "left").where("start_ms >= 0 and end_ms > start_ms and (coalesce(_bound, 0) <= 0 or end_ms <= _bound)").drop("_bound")
    return replaced(old, rows, key)


def replaced(old: DataFrame, new: DataFrame, key: str = "project_id") -> DataFrame:
    """``new``, and the ``old`` rows of keys that it lacks."""
    return new.unionByName(old.join(new.select(key).distinct(), key, "left_anti"))


def dropped_count(found: DataFrame, kept: DataFrame, key: str = "project_id") -> DataFrame:
    """(key, n_found, n_dropped)."""
    n = found.groupBy(key).agg(F.count(F.lit(1)).alias("n_found"))
    m = kept.groupBy(key).agg(F.count(F.lit(1)).alias("_kept"))
    return n.join(m, key, "left").select(key, "n_found", (F.col("n_found") - F.coalesce("_kept", F.lit(0))).alias("n_dropped"))


def added(clips: DataFrame, new: DataFrame, key: str = "project_id") -> DataFrame:
    """``clips`` with the acceptable ``new`` ones behind each project's last (S04, C05): they need a start and a later end."""
    fine = new.where("start_ms is not null and end_ms is not null and end_ms > start_ms")
    last = clips.groupBy(key).agg(F.max("pos").alias("_last"))
    place = F.coalesce("_last", F.lit(-1)) + F.row_number().over(W.partitionBy(key).orderBy("pos"))
    fine = fine.join(last, key, "left").withColumn("pos", place.cast("int")).drop("_last")
    return clips.unionByName(fine, allowMissingColumns=True)


def with_layout(clips: DataFrame, fps: float) -> DataFrame:
    """Adds the effective range, key and frames of each clip: range_start, range_end, render_key, start_frame, n_frames, snapped_ms."""
    start, end = clip_range()
    rows = clips.withColumn("range_start", start).withColumn("range_end", end)
    at, rate = F.col("range_start"), F.lit(fps)
    return rows.withColumns(
        {
            "render_key": render_key(at, F.col("range_end")),
            "start_frame": start_frame(at, rate),
            "n_frames": frames(at, F.col("range_end"), rate),
            "snapped_ms": snapped_ms(at, rate),
        }
    )


def trimmed(clips: DataFrame) -> DataFrame:
    """Clips with the effective range as their own and no trims."""
    start, end = clip_range()
    rows = clips.withColumn("_s", start).withColumn("_e", end)
    return rows.withColumns({"start_ms": F.col("_s"), "end_ms": F.col("_e"), "trim_start_delta": F.lit(0).cast("long"), "trim_end_delta": F.lit(0).cast("long")}).drop("_s", "_e")


def _buckets(start: Column, end: Column) -> Column:
    first = F.floor(start / BUCKET_MS)
    return F.sequence(first, F.greatest(first, F.floor((end - 1) / BUCKET_MS)))


def _met(left: DataFrame, right: DataFrame, by: list[str]) -> DataFrame:
    """The inner join on ``by`` of sides whose groups are small: each side is grouped once, and each pair of groups is taken apart in its own row."""
    side = lambda df, name: df.dropna(subset=by).groupBy(*by).agg(F.collect_list(F.struct(*[c for c in df.columns if c not in by])).alias(name))
    both = side(left, "_left").unionByName(side(right, "_right"), allowMissingColumns=True)
    both = both.groupBy(*by).agg(*[F.first(c, ignorenulls=True).alias(c) for c in ("_left", "_right")]).where("_left is not null and _right is not null")
    return both.select(*by, "_right", F.inline("_left")).select("*", F.inline("_right")).drop("_right")


def clip_captions(captions: DataFrame, clips: DataFrame, fps: float, edited: bool = True, key: str = "project_id") -> DataFrame:
    """The captions that each clip shows, on the clip's own time (D01): (key, clip_no, pos, text, start_ms, end_ms, timestamp_ms, confidence).

    A caption shows if it ends after the clip's effective start and starts
    before its end; it is cut to that range and counted from the frame at which
    the clip starts.  With ``edited``, the clip's caption edits and offset hold
    too (D10).

    Both sides are dealt into buckets of a minute and meet on (key, bucket), so
    a caption is only compared with clips of its minute; a pair counts in the
    later of its first buckets, once.  They meet by a grouping, as a join on
    both would shuffle captions that are dealt by key; where they are not, a
    long project is spread over many tasks.
    """
    left = captions.select(key, "pos", "text", "start_ms", "end_ms", "timestamp_ms", "confidence", F.explode(_buckets(F.col("start_ms"), F.col("end_ms"))).alias("bucket"))
    right = with_layout(clips, fps).select(key, F.col("pos").alias("clip_no"), "range_start", "range_end", "snapped_ms", *(["caption_edits", "caption_offset"] if edited else []))
    right = right.withColumn("bucket", F.explode(_buckets(F.col("range_start"), F.col("range_end"))))
    once = F.col("bucket") == F.greatest(F.floor(F.col("start_ms") / BUCKET_MS), F.floor(F.col("range_start") / BUCKET_MS))
    rows = _met(left, right, [key, "bucket"]).where(once & (F.col("end_ms") > F.col("range_start")) & (F.col("start_ms") < F.col("range_end")))
    first, last = F.greatest("start_ms", "range_start"), F.least("end_ms", "range_end")
    offset = F.coalesce("caption_offset", F.lit(0)) if edited else F.lit(0)
    here = lambda ms: ms - F.col("snapped_ms") + offset
    text = F.coalesce(F.try_element_at("caption_edits", F.col("pos")), "text") if edited else F.col("text")
    return rows.select(
        key,
        "clip_no",
        "pos",
        text.alias("text"),
        here(first).alias("start_ms"),
        here(last).alias("end_ms"),
        here(F.least(F.greatest("timestamp_ms", first), last)).alias("timestamp_ms"),
        "confidence",
    )


def pending(clips: DataFrame, renders: DataFrame, key: str = "project_id") -> DataFrame:
    """Clips (with render_key) that are not exported yet, by (key, render_key)."""
    state = renders.select(key, "render_key", "status")
    return clips.join(state, [key, "render_key"], "left").where(~F.col("status").eqNullSafe(F.lit("exported")))


def batch_counts(clips: DataFrame, renders: DataFrame, key: str = "project_id") -> DataFrame:
    """(key, total, done, any_rendering) over a project's clips."""
    rows = clips.join(renders.select(key, "render_key", "status"), [key, "render_key"], "left")
    return rows.groupBy(key).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("status") == "exported").alias("done"),
        F.coalesce(F.bool_or(F.col("status") == "rendering"), F.lit(False)).alias("any_rendering"),
    )


def updated(clips: DataFrame, changes: DataFrame, key: str = "project_id") -> DataFrame:
    """Clips with changes to title, times or hook put in.

    ``changes`` has (key, old_title, old_start_ms, old_end_ms) to find the clip
    by, and new values; of changes to the same clip the last by ``change_no`` holds.
    """
    values = ["title", "start_ms", "end_ms", "hook_text"]
    # a key of one struct each, so that null titles meet and no column names clash
    old = F.struct(F.coalesce("old_title", F.lit("")), F.col("old_title").isNull(), "old_start_ms", "old_end_ms")
    last = changes.groupBy(key, old.alias("_old")).agg(F.max_by(F.struct(*values), "change_no").alias("_new"))
    last = last.select(F.col(key).alias("_key"), "_old", "_new")
    own = F.struct(F.coalesce("title", F.lit("")), F.col("title").isNull(), "start_ms", "end_ms")
    rows = clips.withColumn("_own", own).join(last, (F.col(key) == F.col("_key")) & (F.col("_own") == F.col("_old")), "left")
    return rows.select(*[F.when(F.col("_new").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c) if c in values else c for c in clips.columns])
