"""Clips: ranges, joins with captions, lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuemill import adapters as A
from cuemill.functions.clips import clip_range
from cuemill.functions.clips import render_key as key_of
from cuemill.operators import clips as C
from cuemill.plans.transcripts import render_plan
from cuemill.queries.base import query, sql
from cuemill.queries.blocks import page_ctes, pages_sql

FPS = A.FPS


@query(sql("laid", "SELECT project_id, pos, range_start, range_end FROM laid"))
def b16_clip_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    start, end = clip_range()
    return A.clips(spark, sf_dir).select("project_id", "pos", start.alias("range_start"), end.alias("range_end"))


@query(sql("laid", "SELECT project_id, pos, render_key FROM laid"))
def b17_render_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.clips(spark, sf_dir).select("project_id", "pos", key_of(*clip_range()).alias("render_key"))


@query(sql("laid", "SELECT project_id, pos, title, range_start AS start_ms, range_end AS end_ms, 0::BIGINT AS trim_start_delta, 0::BIGINT AS trim_end_delta FROM laid"))
def b18_trimmed_clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.trimmed(A.clips(spark, sf_dir)).select("project_id", "pos", "title", "start_ms", "end_ms", "trim_start_delta", "trim_end_delta")


@query(sql("ends", "SELECT project_id, transcript_end FROM ends"))
def e04_transcript_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.transcript_ends(A.words(spark, sf_dir))


@query(sql("clips", "SELECT c.project_id, pos, start_ms, end_ms FROM clips c JOIN ends e ON c.project_id = e.project_id WHERE start_ms >= 0 AND end_ms > start_ms AND end_ms <= transcript_end"))
def c03_valid_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = A.words(spark, sf_dir)
    return C.valid_clips(A.clips_of(words), C.transcript_ends(words)).select("project_id", "pos", "start_ms", "end_ms")


_FOUND = {"old": "SELECT project_id, pos, start_ms, end_ms FROM clips WHERE project_id % 2 = 0", "fresh": "SELECT project_id, pos + 100 AS pos, start_ms + 500 AS start_ms, end_ms - 500 AS end_ms FROM clips WHERE pos > 0 OR project_id % 3 = 0"}
_BOUNDS = "SELECT e.project_id, greatest(transcript_end, CASE WHEN e.project_id % 5 = 0 THEN 40000 ELSE 0 END) AS top FROM ends e"


def _found(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Old clips, newly found ones, transcript ends and video lengths of some projects."""
    words = A.words(spark, sf_dir)
    clips = A.clips_of(words).select("project_id", "pos", "start_ms", "end_ms")
    old = clips.where("project_id % 2 = 0")
    new = clips.where("pos > 0 or project_id % 3 = 0").withColumns({"pos": F.col("pos") + 100, "start_ms": F.col("start_ms") + 500, "end_ms": F.col("end_ms") - 500})
    ends = C.transcript_ends(words)
    return old, new, ends, ends.where("project_id % 5 = 0").select("project_id", F.lit(40_000).cast("long").alias("video_ms"))


@query(
    sql(
        "clips",
        "SELECT * FROM fine UNION ALL SELECT * FROM old WHERE project_id NOT IN (SELECT project_id FROM fine)",
        **_FOUND,
        bounds=_BOUNDS,
        fine="SELECT f.* FROM fresh f JOIN bounds b ON f.project_id = b.project_id WHERE start_ms >= 0 AND end_ms > start_ms AND (top <= 0 OR end_ms <= top)",
    )
)
def c04_regenerated_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.regenerated_clips(*_found(spark, sf_dir))


@query(sql("clips", "SELECT * FROM fresh UNION ALL SELECT * FROM old WHERE project_id NOT IN (SELECT project_id FROM fresh)", **_FOUND))
def s05_replaced_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manual submission replaces all clips of a project, without a range check."""
    old, new, _, _ = _found(spark, sf_dir)
    return C.replaced(old, new)


@query(
    sql(
        "clips",
        """SELECT project_id, pos, title, start_ms, end_ms FROM clips UNION ALL SELECT p.project_id, CAST(last + row_number() OVER (PARTITION BY p.project_id ORDER BY p.pos) AS INTEGER), title, start_ms, end_ms
        FROM (SELECT project_id, pos, 'new' AS title, start_ms, CASE pos % 3 WHEN 0 THEN start_ms + 9 WHEN 1 THEN start_ms END AS end_ms FROM clips) p
        JOIN (SELECT project_id, max(pos) AS last FROM clips GROUP BY project_id) l ON p.project_id = l.project_id WHERE end_ms > start_ms""",
    )
)
def s04_added_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New clips behind the others (S04); those without a later end are refused."""
    clips = A.clips(spark, sf_dir).select("project_id", "pos", "title", "start_ms", "end_ms")
    end = F.when(F.col("pos") % 3 == 0, F.col("start_ms") + 9).when(F.col("pos") % 3 == 1, F.col("start_ms"))
    return C.added(clips, clips.withColumns({"title": F.lit("new"), "end_ms": end}))


@query(sql("clips", "SELECT c.project_id, count(*) AS n_found, count(*) - count_if(end_ms <= transcript_end) AS n_dropped FROM clips c JOIN ends e ON c.project_id = e.project_id GROUP BY c.project_id"))
def e07_dropped_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = A.words(spark, sf_dir)
    clips = A.clips_of(words)
    return C.dropped_count(clips, C.valid_clips(clips, C.transcript_ends(words)))


_SHOWN = """SELECT c.project_id, l.pos AS clip_no, c.pos, {text} AS text, greatest(c.start_ms, range_start) - snapped_ms + {off} AS start_ms, least(c.end_ms, range_end) - snapped_ms + {off} AS end_ms,
    least(greatest(timestamp_ms, greatest(c.start_ms, range_start)), least(c.end_ms, range_end)) - snapped_ms + {off} AS timestamp_ms
    FROM captions c JOIN laid l ON c.project_id = l.project_id AND c.end_ms > range_start AND c.start_ms < range_end"""


@query(sql("captions laid", _SHOWN.format(text="text", off="0")))
def d01_clip_captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = A.words(spark, sf_dir)
    return C.clip_captions(A.as_captions(words), A.clips_of(words), FPS, edited=False).drop("confidence")


@query(sql("captions laid", _SHOWN.format(text="CASE WHEN c.pos = 7 THEN ' EDITED' ELSE text END", off="coalesce(caption_offset, 0)")))
def d10_edited_captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = A.words(spark, sf_dir)
    return C.clip_captions(A.as_captions(words), A.clips_of(words), FPS).drop("confidence")


@query(
    sql("captions laid", "SELECT project_id, clip_no, string_agg(text, '' ORDER BY start_ms, pos) AS text, count(*) AS n FROM s GROUP BY project_id, clip_no", s=_SHOWN.format(text="text", off="0"))
)
def e02_clip_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each clip's captions in the order of their starts, as one text."""
    words = A.words(spark, sf_dir)
    shown = C.clip_captions(A.as_captions(words), A.clips_of(words), FPS, edited=False)
    rows = F.sort_array(F.collect_list(F.struct("start_ms", "pos", "text")))
    return shown.groupBy("project_id", "clip_no").agg(F.array_join(F.transform(rows, lambda x: x["text"]), "").alias("text"), F.count(F.lit(1)).alias("n"))


@query(sql("renders", "SELECT l.project_id, pos, l.render_key FROM laid l LEFT JOIN renders r ON l.project_id = r.project_id AND l.render_key = r.render_key WHERE status IS DISTINCT FROM 'exported'"))
def d05_pending_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    clips = A.clips(spark, sf_dir)
    return C.pending(C.with_layout(clips, FPS), A.renders_of(clips)).select("project_id", "pos", "render_key")


_BATCH = """SELECT l.project_id, count(*) AS total, count_if(status = 'exported') AS done, coalesce(bool_or(status = 'rendering'), false) AS any_rendering
    FROM laid l LEFT JOIN renders r ON l.project_id = r.project_id AND l.render_key = r.render_key GROUP BY l.project_id"""


def _batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    clips = A.clips(spark, sf_dir)
    return C.batch_counts(C.with_layout(clips, FPS), A.renders_of(clips))


@query(sql("renders", f"SELECT project_id, any_rendering FROM ({_BATCH})"))
def e08_any_rendering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _batch(spark, sf_dir).select("project_id", "any_rendering")


@query(sql("renders", f"SELECT project_id, total, done FROM ({_BATCH})"))
def e09_batch_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _batch(spark, sf_dir).select("project_id", "total", "done")


@query(
    sql(
        "clips",
        """SELECT project_id, pos, CASE WHEN pos % 2 = 0 THEN 'changed' ELSE title END AS title, CASE WHEN pos % 2 = 0 THEN start_ms + 10 ELSE start_ms END AS start_ms,
        CASE WHEN pos % 2 = 0 THEN end_ms - 10 ELSE end_ms END AS end_ms FROM clips""",
    )
)
def d11_updated_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every second clip is changed twice; the second change holds."""
    clips = A.clips(spark, sf_dir)
    old = ["project_id", F.col("title").alias("old_title"), F.col("start_ms").alias("old_start_ms"), F.col("end_ms").alias("old_end_ms")]
    changes = clips.where("pos % 2 = 0").select(
        *old, F.explode(F.array(F.lit(0), F.lit(1))).alias("change_no"), "hook_text", "start_ms", "end_ms"
    )
    late = F.col("change_no") == 1
    changes = changes.withColumns(
        {"title": F.when(late, "changed").otherwise("wrong"), "start_ms": F.when(late, F.col("start_ms") + 10).otherwise(F.col("start_ms")), "end_ms": F.when(late, F.col("end_ms") - 10).otherwise(F.col("end_ms"))}
    )
    return C.updated(clips, changes).select("project_id", "pos", "title", "start_ms", "end_ms")


@query(
    sql(
        "captions laid",
        "SELECT project_id, clip_no, page_no, text, start_ms, duration_ms FROM (" + pages_sql("split", "page, part", "project_id, clip_no") + ")",
        shown=_SHOWN.format(text="CASE WHEN c.pos = 7 THEN ' EDITED' ELSE text END", off="coalesce(caption_offset, 0)"),
        **page_ctes("shown", "project_id, clip_no", "DOUBLE"),
    )
)
def p03_render_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages of every clip: a whole plan."""
    words = A.words(spark, sf_dir)
    _, pages = render_plan(A.clips_of(words), A.as_captions(words), FPS)
    return pages.select("project_id", "clip_no", "page_no", "text", "start_ms", "duration_ms")
