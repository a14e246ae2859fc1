"""Every operator and stage on tables that have the names it uses itself, and on a text of several megabytes."""

from __future__ import annotations

import random

import corpus_pipeline
import public_tokenizers
import pytest
from fixtures import odd_rows
from pyspark.sql import functions as F

from cuemill.llm import chat, exact, langid, lm, packing, pieces, quality, repeats, simhash, similar, urls

NAMES = """
    _b _lines _text _n _k _keep _host _salt _shift _rank _from _to _copies _base _off _target _in _hit _grams _conv _head _size _chunk _inside _before
    id n k b row base key copy keep host hosts rates failed failed_rules host_rejected host_failed_rules n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed
    kept keep_id group_size digest check salt salts norm sha first texts ids ends decoded piece start length ids_crc32 sequence_id offset fp fps fingerprint component_id root
    block bucket kind codes at c0 c1 data word prev target background in_targets cells score n_tokens lang_pred n_switches spans features label probability rule verdict
    path p_block bands hashes size u v combo
""".split()


@pytest.fixture(scope="module")
def docs(spark):
    """Odd rows with one id each, a long text, and a column of every name that is not one of documents."""
    rng = random.Random(5)
    long = " ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) + str(rng.randrange(10**6)) for _ in range(200_000))
    rows = {r[0]: r for r in odd_rows() if r[0] is not None} | {9000: (9000, long, "en", "h1")}
    plain = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows.values()], "doc_id long, text string, lang string, source string, n_chars long")
    return plain.select("*", *[F.concat(F.lit(n), F.col("doc_id").cast("string")).alias(n) for n in NAMES])


def plain(docs):
    return docs.select("doc_id", "text", "lang", "source", "n_chars")


WORD, PIECE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("piece_bpe_32k.model")
OPERATORS = {
    "identify": lambda d: langid.identify(d, langid.train(d, rows=3)),
    "exact_groups": exact.exact_groups,
    "judge_quality": quality.judge_quality,
    "repeated_spans": repeats.repeated_spans,
    "pack_documents": lambda d: packing.pack_documents(d, WORD).select("doc_id", "piece", "start", "length", "ids_crc32"),
    "near_groups": simhash.near_groups,
    "similar_groups": similar.similar_groups,
    "pieces": lambda d: pieces.decode_documents(pieces.encode_documents(d, PIECE), PIECE),
    "score_documents": lambda d: lm.score_documents(d, d.where("source = 'h1'")).withColumn("score", F.round("score", 9)),
    "judge_urls": lambda d: urls.judge_urls(d, "doc_id", "text", model=MODEL[0]),
    "rotate_perspectives": lambda d: chat.rotate_perspectives(d, "source", "doc_id", "lang", "text"),
}
MODEL = []


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_operators(spark, docs, name):
    """The rows are the same with and without the other columns."""
    if not MODEL:
        MODEL.append(urls.train(urls.default_labels(spark)))
    f = OPERATORS[name]
    with_names, without = f(docs), f(plain(docs))
    assert with_names.columns == without.columns
    assert sorted(map(str, with_names.collect())) == sorted(map(str, without.collect()))


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages(spark, docs, sf, name):
    """Rows that stay keep every column's value."""
    stage = dict(corpus_pipeline.STAGES)[name]
    without = sorted(map(str, map(tuple, stage(spark, plain(docs), sf).collect())))
    got = stage(spark, docs, sf)
    rows = got.collect()
    if name == "best_fit_packing":
        assert len(rows) == len(without)
        return
    assert got.columns == docs.columns
    assert sorted(str(tuple(r)[:5]) for r in rows) == without
    assert rows and all(r[n] == n + str(r.doc_id) for r in rows for n in NAMES)
