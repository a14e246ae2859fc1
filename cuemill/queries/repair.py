"""Fitting a model's answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuemill import adapters as A
from cuemill.functions.text import fenced_block
from cuemill.operators import ordered as O
from cuemill.operators import repair as R
from cuemill.plans.transcripts import correct
from cuemill.queries.base import normal, query, similar, sql, stamp
from cuemill.session import work_dir


def _chunks(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = A.chunked(spark, sf_dir)
    return rows, A.answers_of(rows)


@query(
    sql(
        "chunk_rows answers",
        """SELECT project_id, chunk_no, string_agg(word, ' ' ORDER BY row_no) AS text, count(*) AS n FROM (SELECT r.project_id, r.chunk_no, r.row_no, coalesce(a.word, r.word) AS word
        FROM chunk_rows r LEFT JOIN answers a ON r.project_id = a.project_id AND r.chunk_no = a.chunk_no AND r.row_no = a.row_no) GROUP BY project_id, chunk_no""",
    )
)
def d06_restored_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = R.restored(*_chunks(spark, sf_dir))
    return _texts(rows).select("project_id", "chunk_no", "text", "n")


def _texts(rows: DataFrame) -> DataFrame:
    ordered = F.sort_array(F.collect_list(F.struct("row_no", "word")))
    return rows.groupBy("project_id", "chunk_no").agg(F.array_join(F.transform(ordered, lambda x: x["word"]), " ").alias("text"), F.count(F.lit(1)).alias("n"))


#: The walk over one chunk as a fold over its places; the lists of the chunk's words stand in every element.
_WALK = {
    "ins": f"SELECT project_id, chunk_no, list(word ORDER BY row_no) AS words, list({normal('word')} ORDER BY row_no) AS a, list(start_ms ORDER BY row_no) AS starts FROM chunk_rows GROUP BY project_id, chunk_no",
    "outs": f"SELECT project_id, chunk_no, list(word ORDER BY row_no) AS fixed, list({normal('word')} ORDER BY row_no) AS b FROM answers GROUP BY project_id, chunk_no",
    "paired": "SELECT i.*, coalesce(fixed, []) AS fixed, coalesce(b, []) AS b FROM ins i LEFT JOIN outs o ON i.project_id = o.project_id AND i.chunk_no = o.chunk_no",
}
_OUT = "list_position(b[s.o + 2:s.o + 5], a[x.i])"
_IN = "list_position(a[x.i + 1:x.i + 4], b[s.o + 1])"
_TAKE = f"""CASE WHEN s.o >= len(b) THEN NULL WHEN b[s.o + 1] = a[x.i] THEN s.o WHEN {_IN} > 0 AND (coalesce({_OUT}, 0) = 0 OR {_IN} <= {_OUT}) THEN NULL
    WHEN {_OUT} > 0 THEN s.o + {_OUT} WHEN {similar('a[x.i]', 'b[s.o + 1]')} THEN s.o END"""
_WALK["walked"] = f"""SELECT *, list_reduce(list_prepend({{'i': 0, 'o': 0, 'taken': []::INTEGER[]}}, [{{'i': CAST(k AS INTEGER), 'o': 0, 'taken': []::INTEGER[]}} for k in range(1, len(a) + 1)]),
    lambda s, x: {{'i': x.i, 'o': CAST(coalesce({_TAKE} + 1, s.o) AS INTEGER), 'taken': list_append(s.taken, CAST({_TAKE} AS INTEGER))}}).taken AS taken FROM paired"""
_WALK["fitted"] = """SELECT project_id, chunk_no, CAST(generate_subscripts(words, 1) - 1 AS INTEGER) AS row_no, unnest(starts) AS start_ms, unnest([coalesce(fixed[taken[k] + 1], words[k]) for k in range(1, len(words) + 1)]) AS word,
    unnest([t IS NOT NULL for t in taken]) AS matched FROM walked"""


@query(sql("chunk_rows answers", "SELECT project_id, chunk_no, string_agg(word, ' ' ORDER BY row_no) AS text, count(*) AS n, count_if(matched) AS matched, sum(start_ms)::BIGINT AS start_sum FROM fitted GROUP BY project_id, chunk_no", **_WALK))
def g03_repaired_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The greedy walk (G03, D07); one row a chunk, with all its words."""
    rows = R.repaired(*_chunks(spark, sf_dir))
    ordered = F.sort_array(F.collect_list(F.struct("row_no", "word")))
    return rows.groupBy("project_id", "chunk_no").agg(
        F.array_join(F.transform(ordered, lambda x: x["word"]), " ").alias("text"), F.count(F.lit(1)).alias("n"), F.count_if("matched").alias("matched"), F.sum("start_ms").alias("start_sum")
    )


_COUNTS = """SELECT project_id, chunk_no, expected, actual, actual <> expected AS is_mismatch, actual / expected AS share, actual <> expected AND actual / expected < 0.9::DOUBLE AS should_retry FROM (
    SELECT r.project_id, r.chunk_no, n AS expected, coalesce(m, 0) AS actual FROM (SELECT project_id, chunk_no, count(*) AS n FROM chunk_rows GROUP BY ALL) r
    LEFT JOIN (SELECT project_id, chunk_no, count(*) AS m FROM answers GROUP BY ALL) a ON r.project_id = a.project_id AND r.chunk_no = a.chunk_no)"""


@query(sql("chunk_rows answers", _COUNTS))
def e05_row_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.row_counts(*_chunks(spark, sf_dir))


@query(
    sql(
        "chunk_rows answers",
        f"""SELECT project_id, count(*) AS chunks, CAST(sum(expected) AS BIGINT) AS expected, CAST(sum(actual) AS BIGINT) AS actual, sum(expected) <> sum(actual) AS is_mismatch,
        count_if(is_mismatch) AS bad_chunks FROM ({_COUNTS}) GROUP BY project_id""",
    )
)
def e05_answer_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The total of each project's chunks."""
    return R.answer_totals(R.row_counts(*_chunks(spark, sf_dir)))


@query(
    sql(
        "chunk_rows answers",
        f"""SELECT count(*) AS chunks, CAST(sum(expected) AS BIGINT) AS expected, CAST(sum(actual) AS BIGINT) AS actual, count_if(is_mismatch) AS mismatched, count_if(should_retry) AS to_retry,
        CAST(sum(expected) AS BIGINT) AS written FROM ({_COUNTS})""",
    )
)
def e05_observed_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corrected rows written, and the counts that the same pass gave."""
    path = work_dir(spark, "observed")
    rows, seen = R.checked(*_chunks(spark, sf_dir))
    rows.write.parquet(path)
    names = ("chunks", "expected", "actual", "mismatched", "to_retry")
    return spark.read.parquet(path).agg(F.count(F.lit(1)).alias("written")).select(*[F.lit(seen.get[c]).cast("long").alias(c) for c in names], "written")


@query(sql("chunk_rows answers", "SELECT project_id, chunk_no, count_if(matched) AS matched, count(*) - count_if(matched) AS kept, count_if(matched) / count(*) AS match_ratio FROM fitted GROUP BY project_id, chunk_no", **_WALK))
def e06_match_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.match_counts(R.repaired(*_chunks(spark, sf_dir)))


def _texted(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = A.chunked(spark, sf_dir)
    ordered = F.sort_array(F.collect_list(F.struct("row_no", "word")))
    return rows.groupBy("project_id", "chunk_no").agg(F.array_join(F.transform(ordered, lambda x: x["word"]), "\n").alias("chunk_text"))


_TEXTED = {"texted": "SELECT project_id, chunk_no, string_agg(word, chr(10) ORDER BY row_no) AS chunk_text FROM chunk_rows GROUP BY project_id, chunk_no"}


@query(sql("chunk_rows", "SELECT project_id, chunk_no, md5(chunk_text) AS chunk_key, md5('translate_en:' || chunk_text) AS translation_key FROM texted", **_TEXTED))
def b24_chunk_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _texted(spark, sf_dir).select("project_id", "chunk_no", R.chunk_key("chunk_text").alias("chunk_key"), R.chunk_key("chunk_text", "translate_en:").alias("translation_key"))


def _cache(texts: DataFrame) -> DataFrame:
    return texts.where("project_id % 3 = 0").select(R.chunk_key("chunk_text").alias("chunk_key"), F.concat(F.lit("old "), "chunk_text").alias("answer"))


@query(sql("chunk_rows", "SELECT t.project_id, t.chunk_no, md5(chunk_text) AS chunk_key, CASE WHEN md5(chunk_text) IN (SELECT md5(chunk_text) FROM texted WHERE project_id % 3 = 0) THEN 'old ' || chunk_text END AS answer FROM texted t", **_TEXTED))
def d08_cache_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of every third project are in the cache; equal texts of others hit too."""
    texts = _texted(spark, sf_dir)
    return R.cached_or_missing(texts, _cache(texts)).select("project_id", "chunk_no", "chunk_key", "answer")


@query(sql("chunk_rows", "SELECT DISTINCT md5(chunk_text) AS chunk_key, CASE WHEN md5(chunk_text) IN (SELECT md5(chunk_text) FROM texted WHERE project_id % 3 = 0) THEN 'old ' || chunk_text ELSE 'new ' || chunk_text END AS answer FROM texted", **_TEXTED))
def a17_cache_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cache after the missing texts were answered."""
    texts = _texted(spark, sf_dir)
    cache = _cache(texts).distinct()
    fresh = R.cached_or_missing(texts, cache).where("answer is null").withColumn("answer", F.concat(F.lit("new "), "chunk_text"))
    return R.cache_after(cache, fresh)


@query(
    "SELECT doc_id, CASE WHEN doc_id % 3 < 2 THEN regexp_replace(t, '^[ \\t-\\r]+|[ \\t-\\r]+$', '', 'g') ELSE 'no block ' || doc_id END AS block FROM (SELECT doc_id, text AS t FROM documents)"
)
def a13_fenced_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    head, at = F.col("text"), F.col("doc_id") % 3
    answer = F.when(at == 0, F.concat(F.lit("Here:\n```tsv\n"), head, F.lit("\n```\nDone."))).when(at == 1, F.concat(F.lit("```\n"), head, F.lit("\n```")))
    answer = answer.otherwise(F.concat(F.lit("\n no block "), F.col("doc_id"), F.lit(" \n")))
    return A.table(spark, sf_dir, "documents").select("doc_id", fenced_block(answer).alias("block"))


@query(
    sql(
        "chunk_rows answers ends",
        """SELECT project_id, count(*) AS n, string_agg(word, ' ' ORDER BY pos) AS text, sum(start_ms)::BIGINT AS start_sum, max_by(end_ms, pos) AS last_end FROM (
            SELECT f.project_id, f.start_idx + f.row_no AS pos, f.word, f.start_ms, e.transcript_end AS end_ms FROM (
                SELECT g.*, c.start_idx, coalesce(lag(c.end_idx) OVER (PARTITION BY g.project_id, g.row_no ORDER BY g.chunk_no), 0) AS unused, p.prev_end FROM final g
                JOIN chunks c ON g.project_id = c.project_id AND g.chunk_no = c.chunk_no
                JOIN (SELECT project_id, chunk_no, coalesce(lag(end_idx) OVER (PARTITION BY project_id ORDER BY chunk_no), 0) AS prev_end FROM chunks) p ON g.project_id = p.project_id AND g.chunk_no = p.chunk_no
            ) f JOIN ends e ON f.project_id = e.project_id WHERE f.start_idx + f.row_no >= f.prev_end) GROUP BY project_id""",
        **_WALK,
        counts=_COUNTS,
        final="""SELECT r.project_id, r.chunk_no, r.row_no, r.start_ms, a.word FROM chunk_rows r JOIN counts c ON r.project_id = c.project_id AND r.chunk_no = c.chunk_no AND NOT is_mismatch
            JOIN answers a ON r.project_id = a.project_id AND r.chunk_no = a.chunk_no AND r.row_no = a.row_no
            UNION ALL SELECT f.project_id, f.chunk_no, f.row_no, f.start_ms, f.word FROM fitted f JOIN counts c ON f.project_id = c.project_id AND f.chunk_no = c.chunk_no AND is_mismatch""",
    )
)
def p02_corrected_transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A whole plan: chunks, answers, repair, stitching, ends (F09, D06, G03, F10, F01); one row a project."""
    words = A.words(spark, sf_dir)
    rows = correct(words, A.answers_of(O.chunk_rows(words)))
    ordered = F.sort_array(F.collect_list(F.struct("pos", "word")))
    return rows.groupBy("project_id").agg(
        F.count(F.lit(1)).alias("n"), F.array_join(F.transform(ordered, lambda x: x["word"]), " ").alias("text"), F.sum("start_ms").alias("start_sum"), F.max_by("end_ms", "pos").alias("last_end")
    )
