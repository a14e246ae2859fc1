"""Windows over ordered rows (F), orders and limits (S)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from cuemill import adapters as A
from cuemill.functions.text import numbered, ordered_text, unnumbered
from cuemill.operators import ordered as O
from cuemill.queries.base import half_up, query, sql
from cuemill.sources.transcripts import transcript_texts


@query(sql("words", "SELECT project_id, string_agg(word, ' ' ORDER BY pos) AS text FROM words GROUP BY project_id"))
def b10_transcript_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transcript_texts(A.words(spark, sf_dir))


@query(sql("turn_words", "SELECT project_id, pos, word, start_ms, coalesce(lead(start_ms) OVER (PARTITION BY project_id ORDER BY pos), 99) AS end_ms FROM turn_words"))
def f01_next_start(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.with_next_start(A.turns(spark, sf_dir), F.lit(99))


def _flat(rows: DataFrame) -> DataFrame:
    """Every 7th word and the one after it have no length, and so have the last words of every third project."""
    flat = (F.col("pos") % 7).isin(0, 1) | ((F.col("project_id") % 3 == 0) & (F.col("pos") >= 20))
    return rows.withColumn("end_ms", F.when(flat, F.col("start_ms")).otherwise(F.col("end_ms")))


@query(
    sql(
        "turn_words",
        f"""SELECT project_id, pos, word,
        CASE WHEN z THEN {half_up('prev_end + step * j')} ELSE start_ms END AS start_ms, CASE WHEN z THEN {half_up('prev_end + step * (j + 1)')} ELSE end_ms END AS end_ms FROM (
            SELECT *, (coalesce(next_start, prev_end + (n + 1) * 300) - prev_end) / (n + 1) AS step FROM (
                SELECT *, pos - head AS j, coalesce(tail, last + 1) - head - 1 AS n FROM r))""",
        flat="SELECT project_id, pos, word, start_ms, CASE WHEN pos % 7 IN (0, 1) OR (project_id % 3 = 0 AND pos >= 20) THEN start_ms ELSE end_ms END AS end_ms FROM turn_words",
        z="SELECT *, start_ms = end_ms AND pos > 0 AS z FROM flat",
        r="""SELECT *, max(CASE WHEN NOT z THEN pos END) OVER b AS head, max_by(end_ms, CASE WHEN NOT z THEN pos END) OVER b AS prev_end,
            min(CASE WHEN NOT z THEN pos END) OVER a AS tail, min_by(start_ms, CASE WHEN NOT z THEN pos END) OVER a AS next_start, max(pos) OVER (PARTITION BY project_id) AS last FROM z
            WINDOW b AS (PARTITION BY project_id ORDER BY pos), a AS (PARTITION BY project_id ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)""",
    )
)
def f02_repaired_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.with_repaired_times(_flat(A.turns(spark, sf_dir)))


@query(
    sql(
        "words",
        """SELECT project_id, island, start_ms, CASE WHEN e > nxt - 80 THEN greatest(start_ms + 1000, nxt - 80) ELSE e END AS end_ms FROM (
        SELECT *, greatest(end_ms, start_ms + 1000) AS e, lead(start_ms) OVER (PARTITION BY project_id ORDER BY island) AS nxt FROM b)""",
        i="SELECT *, CAST(sum(far) OVER (PARTITION BY project_id ORDER BY pos) AS INTEGER) AS island FROM (SELECT *, CASE WHEN start_ms - lag(end_ms) OVER (PARTITION BY project_id ORDER BY pos) > 1000 THEN 1 ELSE 0 END AS far FROM words)",
        b="SELECT project_id, island, min(start_ms) AS start_ms, max(end_ms) AS end_ms FROM i GROUP BY project_id, island",
    )
)
def f03_display_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Silence islands, timed as subtitles."""
    rows = O.with_islands(A.words(spark, sf_dir)).groupBy("project_id", "island").agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"))
    return O.with_display_times(rows, order="island")


@query(
    sql(
        "words",
        "SELECT project_id, island, min(pos) AS first_pos, count(*) AS n_words, min(start_ms) AS start_ms, max(end_ms) AS end_ms FROM i GROUP BY project_id, island",
        i="SELECT *, CAST(sum(far) OVER (PARTITION BY project_id ORDER BY pos) AS INTEGER) AS island FROM (SELECT *, CASE WHEN start_ms - lag(end_ms) OVER (PARTITION BY project_id ORDER BY pos) > 1000 THEN 1 ELSE 0 END AS far FROM words)",
    )
)
def f05_silence_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = O.with_islands(A.words(spark, sf_dir))
    return rows.groupBy("project_id", "island").agg(F.min("pos").alias("first_pos"), F.count(F.lit(1)).alias("n_words"), F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"))


@query(
    sql(
        "turn_words",
        """SELECT project_id, pos, word, CAST(coalesce(sum(CASE WHEN regexp_matches(word, '[.!?]$') THEN 1 ELSE 0 END)
        OVER (PARTITION BY project_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INTEGER) AS part FROM turn_words""",
    )
)
def f06_sentence_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.with_sentence_parts(A.turns(spark, sf_dir), "project_id", text="word").select("project_id", "pos", "word", "part")


@query(
    sql(
        "turn_words",
        """SELECT project_id, pos, word, CAST(sum(length(word) + CASE WHEN pos % 12 > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY project_id, pos // 12 ORDER BY pos) AS BIGINT) AS top_length FROM turn_words""",
    )
)
def f07_running_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The length of the upper line if a block of twelve words were split after each word."""
    rows = O.with_part(A.turns(spark, sf_dir), 12)
    length = F.length("word") + F.when(F.col("pos") % 12 > 0, 1).otherwise(0)
    total = F.sum(length).over(W.partitionBy("project_id", "part").orderBy("pos").rowsBetween(W.unboundedPreceding, 0))
    return rows.select("project_id", "pos", "word", total.alias("top_length"))


@query(sql("chunks", "SELECT project_id, chunk_no, start_idx, end_idx, is_first FROM chunks"))
def f09_overlapped_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.chunks(A.words(spark, sf_dir))


@query(sql("chunk_rows", "SELECT project_id, chunk_no, count(*) AS n, min(pos) AS first_pos, max(pos) AS last_pos, sum(start_ms)::BIGINT AS start_sum FROM chunk_rows GROUP BY project_id, chunk_no"))
def f09_chunk_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the chunks, summed up."""
    rows = A.chunked(spark, sf_dir)
    return rows.groupBy("project_id", "chunk_no").agg(
        F.count(F.lit(1)).alias("n"), F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"), F.sum("start_ms").alias("start_sum")
    )


@query(sql("words", "SELECT project_id, count(*) AS n, CAST(count(DISTINCT pos) AS BIGINT) AS n_places, string_agg(word, ' ' ORDER BY pos) AS text FROM words GROUP BY project_id"))
def f10_stitched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunk rows in one sequence again: every row once."""
    words = A.words(spark, sf_dir)
    rows = O.stitched(O.chunk_rows(words).drop("pos"), O.chunks(words))
    return rows.groupBy("project_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("pos").alias("n_places"), ordered_text("word", "pos").alias("text"))


@query(sql("words", "SELECT project_id, CAST(pos // 200 AS INTEGER) AS part, count(*) AS n_rows, min(start_ms) AS start_ms FROM words GROUP BY ALL"))
def f11_fixed_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = O.with_part(A.words(spark, sf_dir), O.TRANSLATION_ROWS)
    return rows.groupBy("project_id", "part").agg(F.count(F.lit(1)).alias("n_rows"), F.min("start_ms").alias("start_ms"))


TOP = """SELECT project_id, project_path, video_name, updated_at, entry_no, CAST(row_number() OVER (ORDER BY ts DESC, entry_no DESC) AS INTEGER) AS rank FROM (
    SELECT *, row_number() OVER (PARTITION BY project_path ORDER BY ts DESC, entry_no DESC) AS r FROM registry) WHERE r = 1 ORDER BY rank LIMIT 20"""


@query(sql("registry", TOP))
def f12_recent_projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.recent(A.registry(spark, sf_dir)).select("project_id", "project_path", "video_name", "updated_at", "entry_no", "rank")


@query(sql("turn_words", "SELECT project_id, start_ms, word, CAST(row_number() OVER (PARTITION BY project_id ORDER BY start_ms) - 1 AS INTEGER) AS idx FROM turn_words"))
def f13_caption_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.with_index(A.turns(spark, sf_dir).drop("pos"), "start_ms").select("project_id", "start_ms", "word", "idx")


@query(sql("turn_words", "SELECT project_id, string_agg(word, ' ' ORDER BY start_ms % 1000, pos) AS text FROM turn_words GROUP BY project_id"))
def s01_sorted_by_start(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stable order by a time with ties, as text; a table itself has no order to compare."""
    return A.turns(spark, sf_dir).groupBy("project_id").agg(ordered_text("word", F.struct(F.col("start_ms") % 1000, "pos")).alias("text"))


@query(sql("registry", "SELECT project_path, entry_no FROM (" + TOP + ")"))
def s02_top_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.recent(A.registry(spark, sf_dir)).select("project_path", "entry_no")


@query(sql("turn_words", "SELECT project_id, pos, printf('%d. %s', pos + 1, word) AS line, regexp_replace(word, '^[0-9]+\\.[ \\t]*', '') AS back FROM turn_words"))
def a14_numbered_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with their numbers, and without them again."""
    rows = A.turns(spark, sf_dir).select("project_id", "pos", numbered("pos", "word").alias("line"))
    return rows.withColumn("back", unnumbered("line"))
