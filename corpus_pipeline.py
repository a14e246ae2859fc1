"""From raw documents to packed training sequences, in stages that are each written and read again."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from cuemill.llm.common import Scratch, staged
from cuemill.llm.exact import drop_exact
from cuemill.llm.packing import pack_documents
from cuemill.llm.quality import drop_poor
from cuemill.llm.repeats import drop_repeats
from cuemill.llm.simhash import drop_near
from cuemill.llm.similar import similar_groups


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules, or whose host is rejected, go.

    Null and empty texts fail them; a null host is a host; repeated rows are
    judged alike; the columns stay as they are; an empty table gives no rows.
    """
    return drop_poor(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, up to white space, the document with the smallest id stays.

    Null counts as empty, so that one such document stays; of rows that share
    the id as well, one; the columns stay as they are; an empty table gives no rows.
    """
    return drop_exact(docs)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity of 0.8 or more) stays, the one with the smallest id.

    Null and empty texts are one group; rows that share the smallest id stay
    together; the columns stay as they are; an empty table gives no rows.
    """
    return drop_near(docs, groups=similar_groups)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 100 bytes or more that an earlier document has are cut out; every document stays.

    Null texts stay null, empty ones empty; rows of one id are in order of their
    texts; the other columns stay as they are, but ``n_chars`` is counted anew;
    an empty table gives no rows.
    """
    return drop_repeats(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces and their places in sequences of 4096.

    A null or empty text is the end token alone; repeated rows are packed each;
    other columns are left out; an empty table gives no rows.
    """
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality_rules", quality_rules),
    ("exact_dedup", exact_dedup),
    ("simhash_near_dedup", simhash_near_dedup),
    ("suffix_array_dedup", suffix_array_dedup),
    ("best_fit_packing", best_fit_packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``.

    What a stage stages on its way is deleted once its result is written, and
    that result once the next one's is.  The last stage's tables stay, as its
    result is lazy: they belong to the scratch that is current where this is
    called.  Calls share nothing, so several may run at once.
    """
    docs, kept = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        with Scratch() as own:
            out = stage(spark, docs, sf_dir)
        with Scratch() as written:
            docs = staged(out, name)
        own.close()
        if kept:
            kept.close()
        kept = written
    kept.give()
    return STAGES[-1][1](spark, docs, sf_dir)


#: Fingerprint components, tokens and bins can't be said in SQL; the tests hold each stage against brute force.
ORACLE_SQL = None
