"""Subtitle blocks, pages and SRT."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuemill import adapters as A
from cuemill.operators import blocks as B
from cuemill.operators import ordered as O
from cuemill.operators import pages as P
from cuemill.queries.base import is_bound, is_break, punctuated, query, sql, stamp, wrap
from cuemill.sources import srt

FPS = 23.976

#: The fold over a project's words, a step a word; the list carries the accumulator's fields in every element.
_FOLD = {
    "marked": f"""SELECT project_id, pos, trim(text, ' ') AS text, start_ms, end_ms, length(trim(text, ' ')) AS len, {is_break('text').replace('lower(text)', "lower(trim(text, ' '))")} AS brk,
        {is_bound('text').replace('lower(text)', "lower(trim(text, ' '))")} AS nob, {punctuated('text')} AS punct,
        coalesce(start_ms - lag(end_ms) OVER (PARTITION BY project_id ORDER BY pos) > 1000, false) AS sil,
        coalesce(lag({punctuated('text')}) OVER (PARTITION BY project_id ORDER BY pos), false) AS pp FROM captions""",
    "listed": """SELECT project_id, list({'pos': pos, 'len': len, 'brk': brk, 'nob': nob, 'sil': sil, 'pp': pp, 'n': 0, 'size': 0::BIGINT, 'starts': []::INTEGER[]} ORDER BY pos) AS xs FROM marked GROUP BY project_id""",
    "walked": """SELECT project_id, list_reduce(list_prepend({'pos': -1, 'len': 0::BIGINT, 'brk': false, 'nob': false, 'sil': false, 'pp': false, 'n': 0, 'size': 0::BIGINT, 'starts': []::INTEGER[]}, xs), lambda a, x:
        CASE WHEN a.n = 0 OR x.sil OR a.size + 1 + x.len > 84 OR (a.n >= 4 AND a.size + 1 + x.len > 42 AND (x.pp OR x.brk) AND NOT x.nob)
        THEN {'pos': x.pos, 'len': x.len, 'brk': x.brk, 'nob': x.nob, 'sil': x.sil, 'pp': x.pp, 'n': 1, 'size': x.len, 'starts': list_append(a.starts, x.pos)}
        ELSE {'pos': x.pos, 'len': x.len, 'brk': x.brk, 'nob': x.nob, 'sil': x.sil, 'pp': x.pp, 'n': a.n + 1, 'size': a.size + 1 + x.len, 'starts': a.starts} END).starts AS starts FROM listed""",
    "begun": "SELECT project_id, unnest(starts) AS pos, 1 AS b FROM walked",
    "blocked": """SELECT m.*, CAST(sum(coalesce(b, 0)) OVER (PARTITION BY m.project_id ORDER BY m.pos) - 1 AS INTEGER) AS block_no FROM marked m LEFT JOIN begun s ON m.project_id = s.project_id AND m.pos = s.pos""",
    "blocks": """SELECT project_id, block_no, string_agg(text, ' ' ORDER BY pos) AS text, min_by(start_ms, pos) AS start_ms, max_by(end_ms, pos) AS end_ms, min(pos) AS first_pos, CAST(count(*) AS INTEGER) AS n_words
        FROM blocked GROUP BY project_id, block_no""",
}
_CUES = _FOLD | {
    "timed": """SELECT project_id, block_no, text, start_ms, CASE WHEN e > nxt - 80 THEN greatest(start_ms + 1000, nxt - 80) ELSE e END AS end_ms FROM (
        SELECT *, greatest(end_ms, start_ms + 1000) AS e, lead(start_ms) OVER (PARTITION BY project_id ORDER BY block_no) AS nxt FROM blocks)""",
    "cues": f"""SELECT project_id, CAST(block_no + 1 AS INTEGER) AS cue_no, {stamp("start_ms", ",")} AS "start", {stamp("end_ms", ",")} AS "end", {wrap("text")} AS text FROM timed""",
}


@query(sql("captions", "SELECT project_id, block_no, text, start_ms, end_ms, first_pos, n_words FROM blocks", **_FOLD))
def g01_subtitle_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.group_blocks(A.captions(spark, sf_dir))


_UNBROKEN = {"unbroken": "SELECT project_id, pos, text, pos * CAST(100 AS BIGINT) AS start_ms, (pos + 1) * CAST(100 AS BIGINT) AS end_ms FROM captions"}
_UNBROKEN |= _FOLD | {"marked": _FOLD["marked"].replace("FROM captions", "FROM unbroken")}


@query(sql("captions", "SELECT project_id, block_no, text, start_ms, end_ms, first_pos, n_words FROM blocks", **_UNBROKEN))
def g01_unbroken_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of the same words without any pause, in runs of at most 500 words."""
    pos = F.col("pos").cast("long")
    return B.group_blocks(A.captions(spark, sf_dir).withColumns({"start_ms": pos * 100, "end_ms": (pos + 1) * 100}), run=500)


@query(sql("captions", "SELECT project_id, cue_no, \"start\", \"end\", text FROM cues", **_CUES))
def a10_srt_cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return srt.srt_cues(B.group_blocks(A.captions(spark, sf_dir)))


_SRT = "SELECT project_id, string_agg(printf('%d', cue_no) || chr(13) || chr(10) || \"start\" || ' --> ' || \"end\" || chr(13) || chr(10) || text || chr(13) || chr(10) || chr(13) || chr(10), '' ORDER BY cue_no) AS srt FROM cues GROUP BY project_id"


@query(sql("captions", _SRT, **_CUES))
def a11_srt_of_captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return srt.captions_to_srt(A.captions(spark, sf_dir))


@query(sql("captions", _SRT, **{k: v.replace("SELECT project_id, block_no, text, start_ms, CASE", "SELECT project_id, block_no, replace(text, 'e', 'E') AS text, start_ms, CASE") for k, v in _CUES.items()}))
def a11_srt_of_translations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks with other letters stand for translated ones."""
    return srt.translated_to_srt(B.group_blocks(A.captions(spark, sf_dir)).withColumn("text", F.replace("text", F.lit("e"), F.lit("E"))))


@query(sql("captions", "SELECT project_id, min(pos) // 9 AS part, string_agg(trim(text, ' '), ' ' ORDER BY pos) AS text, min_by(start_ms, pos) AS start_ms, max_by(end_ms, pos) AS end_ms FROM captions GROUP BY project_id, pos // 9".replace("min(pos) // 9", "CAST(min(pos) // 9 AS INTEGER)")))
def e01_block_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of nine words."""
    return B.folded(O.with_part(A.captions(spark, sf_dir), 9), ["project_id", "part"])


@query(sql("captions", "SELECT project_id, CAST(pos // 9 AS INTEGER) AS part, CAST(sum(length(trim(text, ' ')) + 1) - 1 AS BIGINT) AS n_chars FROM captions GROUP BY project_id, pos // 9"))
def e03_block_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.block_length(O.with_part(A.captions(spark, sf_dir), 9), ["project_id", "part"])


@query(sql("captions", f"SELECT project_id, part, {wrap('text')} AS text FROM p", p="SELECT project_id, CAST(pos // 9 AS INTEGER) AS part, string_agg(trim(text, ' '), ' ' ORDER BY pos) AS text FROM captions GROUP BY project_id, pos // 9"))
def b21_wrapped_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.folded(O.with_part(A.captions(spark, sf_dir), 9), ["project_id", "part"]).select("project_id", "part", B.wrapped("text").alias("text"))


def page_ctes(table: str = "captions", by: str = "project_id", kind: str = "BIGINT") -> dict[str, str]:
    """Pages by the library's rule, as a fold like the one above; a word that far from the one before begins a page in any case."""
    same = " AND ".join(f"c.{k} = s.{k}" for k in by.split(", "))
    zero = f"'first': 0::{kind}, 'starts': []::INTEGER[]"
    return {
        "pfar": f"""SELECT *, sum(far) OVER (PARTITION BY {by} ORDER BY pos) AS isl FROM (
            SELECT *, CASE WHEN start_ms - lag(start_ms) OVER (PARTITION BY {by} ORDER BY pos) > 1200 THEN 1 ELSE 0 END AS far FROM {table})""",
        "plisted": f"SELECT {by}, isl, list({{'pos': pos, 's': start_ms, {zero}}} ORDER BY pos) AS xs FROM pfar GROUP BY {by}, isl",
        "pwalked": f"""SELECT {by}, list_reduce(list_prepend({{'pos': -1, 's': 0::{kind}, {zero}}}, xs), lambda a, x:
            CASE WHEN len(a.starts) = 0 OR x.s - a.first > 1200 THEN {{'pos': x.pos, 's': x.s, 'first': x.s, 'starts': list_append(a.starts, x.pos)}}
            ELSE {{'pos': x.pos, 's': x.s, 'first': a.first, 'starts': a.starts}} END).starts AS starts FROM plisted""",
        "pbegun": f"SELECT {by}, unnest(starts) AS pos, 1 AS b FROM pwalked",
        "paged": f"SELECT c.*, CAST(sum(coalesce(b, 0)) OVER (PARTITION BY {', '.join('c.' + k for k in by.split(', '))} ORDER BY c.pos) - 1 AS INTEGER) AS page FROM {table} c LEFT JOIN pbegun s ON {same} AND c.pos = s.pos",
        "split": f"""SELECT *, CAST(coalesce(sum(CASE WHEN regexp_matches(text, '[.!?]$') THEN 1 ELSE 0 END)
            OVER (PARTITION BY {by}, page ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INTEGER) AS part FROM paged""",
    }


def pages_sql(table: str, within: str, by: str = "project_id") -> str:
    return f"""SELECT {by}, CAST(row_number() OVER (PARTITION BY {by} ORDER BY min(pos)) - 1 AS INTEGER) AS page_no, string_agg(text, '' ORDER BY pos) AS text,
        min_by(start_ms, pos) AS start_ms, max_by(end_ms, pos) AS end_ms, max_by(end_ms, pos) - min_by(start_ms, pos) AS duration_ms, CAST(count(*) AS INTEGER) AS n_tokens
        FROM {table} GROUP BY {by}, {within}"""


_PAGES = page_ctes()


def _sized(pages: DataFrame) -> DataFrame:
    return pages.withColumn("n_tokens", F.size("tokens")).drop("tokens")


@query(sql("captions", pages_sql("paged", "page"), **_PAGES))
def g02_caption_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By the library's own rule; the reference leaves it to a package that it doesn't hold."""
    return _sized(P.group_pages(A.captions(spark, sf_dir)))


@query(sql("captions", pages_sql("split", "page, part"), **_PAGES))
def e02_sentence_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages split at sentences and folded."""
    return _sized(P.split_at_sentences(P.group_pages(A.captions(spark, sf_dir))))


@query(
    sql(
        "captions",
        """SELECT project_id, page_no, start_frame, n_frames FROM (SELECT project_id, page_no, start_ms / 1000 * 23.976::DOUBLE AS start_frame,
        least(lead(start_ms) OVER (PARTITION BY project_id ORDER BY page_no) / 1000 * 23.976::DOUBLE, end_ms / 1000 * 23.976::DOUBLE) - start_ms / 1000 * 23.976::DOUBLE AS n_frames FROM pg) WHERE n_frames > 0""",
        **_PAGES,
        pg=pages_sql("split", "page, part"),
    )
)
def f04_page_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of pages (F04); pages without any go."""
    pages = O.with_frames(P.split_at_sentences(P.group_pages(A.captions(spark, sf_dir))), FPS)
    return pages.select("project_id", "page_no", "start_frame", "n_frames")


@query(
    sql(
        "captions",
        """SELECT project_id, page_no, at_ms, pos FROM (SELECT project_id, page AS page_no, pos, start_ms, end_ms, min(start_ms) OVER (PARTITION BY project_id, page) + 700 AS at_ms FROM paged)
        WHERE start_ms <= at_ms AND at_ms < end_ms""",
        **_PAGES,
    )
)
def d09_active_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The token that is spoken 700 ms after each page begins."""
    pages = P.group_pages(A.captions(spark, sf_dir)).withColumn("at_ms", F.col("start_ms") + 700)
    return P.active_tokens(pages).select("project_id", "page_no", "at_ms", "pos")
