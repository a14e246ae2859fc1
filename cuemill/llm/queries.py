"""The registered queries of the training-data operators and, where SQL can say it, their DuckDB SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuemill.llm.chat import rotate_perspectives
from cuemill.llm.exact import exact_groups
from cuemill.llm.langid import held_out, identify, train
from cuemill.llm.lm import score_documents
from cuemill.llm.packing import pack_documents
from cuemill.llm.pieces import decode_documents, encode_documents
from cuemill.llm.quality import judge_quality
from cuemill.llm.repair import damaged, repair_conversations
from cuemill.llm.repeats import repeated_spans
from cuemill.llm.simhash import near_groups
from cuemill.llm.urls import judge_urls
from cuemill.llm.vectors import near_vectors
from cuemill.llm.whitening import whiten

WORD_MODEL = public_tokenizers.path("word_bpe_49k.json")
PIECE_MODEL = public_tokenizers.path("piece_bpe_32k.model")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    judged = identify(docs, train(docs))
    return judged.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "n_switches")


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(_table(spark, sf_dir, "pages"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(_table(spark, sf_dir, "documents"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge_quality(_table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "host", "host_failed_rules", "host_rejected")


def op5_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = repeated_spans(_table(spark, sf_dir, "documents"))
    return spans.select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"),
        F.size("starts").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(_table(spark, sf_dir, "documents"), WORD_MODEL)


def op7_chat_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rotate_perspectives(_table(spark, sf_dir, "conversations"))


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(_table(spark, sf_dir, "documents"))


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids, of the decoded text, and of the places where the pieces end in the original bytes."""
    coded = decode_documents(encode_documents(_table(spark, sf_dir, "documents"), PIECE_MODEL), PIECE_MODEL)
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        F.sha2(F.array_join("ends", ","), 256).alias("ends_sha256"),
    )


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of good quality by ``labels`` are the target, all others the background."""
    return score_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels").where("quality = 1"))


def op11_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(_table(spark, sf_dir, "embeddings"))


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(_table(spark, sf_dir, "embeddings"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, those of which the damage leaves no turn included."""
    convs = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    done = repair_conversations(damaged(convs), copies_col="copies").withColumnRenamed("conv_id", "_conv")
    ids = convs.select("conv_id").distinct()
    rows = ids.join(done, F.col("conv_id").eqNullSafe(F.col("_conv")), "left")
    numbers = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return rows.select("conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_language_id,
        op2_url_filter,
        op3_exact_dedup,
        op4_quality_rules,
        op5_suffix_array_dedup,
        op6_best_fit_packing,
        op7_chat_perspectives,
        op8_simhash_near_dedup,
        op9_sentencepiece,
        op10_lm_scoring,
        op11_embedding_near_dedup,
        op12_embedding_whitening,
        op13_conversation_repair,
    )
}

ORACLE_SQL = {
    "op3_exact_dedup": """
        WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g') AS norm FROM documents)
        SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = min(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
        FROM d WINDOW w AS (PARTITION BY norm)
    """,
    "op4_quality_rules": """
        WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS text FROM documents),
        w AS (SELECT *, list_filter(regexp_split_to_array(text, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws,
                     list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM d),
        i AS (SELECT rid, ws, unnest(range(1, len(ws) - 6)) AS i FROM w),
        g AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, array_to_string(ws[i:i + 7], ' ')) AS n FROM i),
        r AS (SELECT rid, count(DISTINCT i + k) AS covered FROM g, range(8) AS t(k) WHERE n > 1 GROUP BY rid),
        c AS (
            SELECT doc_id, source AS host, CAST(len(ws) AS BIGINT) AS n_words, length(array_to_string(ws, '')) AS word_chars,
                   length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, coalesce(covered, 0) AS n_repeat_words
            FROM w LEFT JOIN r USING (rid)),
        b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM c),
        f AS (
            SELECT host, rule, count(*) AS n, sum(hit) AS failed
            FROM (
                SELECT host, unnest(['short', 'repeats', 'word_length', 'symbols', 'lines']) AS rule, unnest([
                    CAST(n_words < 20 AS INT), CAST(100 * n_repeat_words > 30 * n_words AS INT), CAST(word_chars < 2 * n_words OR word_chars > 15 * n_words AS INT),
                    CAST(100 * n_symbols > 10 * n_words AS INT), CAST(100 * n_dup_lines > 5 * n_words AS INT)]) AS hit
                FROM b)
            GROUP BY host, rule),
        p AS (SELECT rule, avg(failed / n) AS m, var_samp(failed / n) - avg(failed / n) * (1 - avg(failed / n)) * avg(1 / n) AS v FROM f GROUP BY rule),
        q AS (SELECT rule, m, CASE WHEN v IS NULL THEN 1 WHEN v > 0 THEN least(greatest(m * (1 - m) / v - 1, 1), 1000) ELSE 1000 END AS w FROM p),
        s AS (SELECT host, rule, n + w AS size, (failed + m * w) / (n + w) AS rate FROM f JOIN q USING (rule)),
        j AS (
            SELECT host, coalesce(string_agg(rule, ',' ORDER BY list_position(['short', 'repeats', 'word_length', 'symbols', 'lines'], rule))
                FILTER (rate - 2 * sqrt(rate * (1 - rate) / (size + 1)) > 0.5), '') AS host_failed_rules
            FROM s GROUP BY host)
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND host_failed_rules = '' AS kept, b.host, host_failed_rules, host_failed_rules <> '' AS host_rejected
        FROM b JOIN j ON b.host IS NOT DISTINCT FROM j.host
    """,
    "op7_chat_perspectives": """
        WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, replace(replace(coalesce(text, ''), '<\\', '<\\\\'), '<|', '<\\|') AS said FROM conversations),
        people AS (SELECT DISTINCT conv_id, role AS perspective FROM t WHERE role <> 'system'),
        v AS (
            SELECT t.*, perspective, role = perspective AS own,
                   CASE WHEN role = perspective THEN '<|assistant|>' || chr(10) WHEN role = 'system' THEN '<|system|>' || chr(10)
                        ELSE '<|user:' || replace(replace(replace(replace(role, '<\\', '<\\\\'), '<|', '<\\|'), '|\\', '|\\\\'), '|>', '|\\>') || '|>' || chr(10) END AS head
            FROM t JOIN people ON t.conv_id IS NOT DISTINCT FROM people.conv_id),
        s AS (SELECT *, length(head) + length(said) + 8 AS size FROM v),
        p AS (
            SELECT *, CAST(coalesce(sum(size) OVER (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, role, said
                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS char_start FROM s)
        SELECT conv_id, perspective, turn, role, head || said || '<|end|>' || chr(10) AS rendered, char_start, char_start + size AS char_end,
               CASE WHEN own THEN char_start + length(head) END AS mask_start, CASE WHEN own THEN char_start + size - 1 END AS mask_end
        FROM p
    """,
}
