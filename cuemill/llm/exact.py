"""Exact deduplication that no hot group can slow down (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from cuemill.llm.common import SPACE, free_names, salt_bit, salt_of, salts_in, staged, with_small

SALTS = 64


def normalised(col):
    """Each run of white space becomes one space; null counts as empty."""
    return F.regexp_replace(F.coalesce(col, F.lit("")), SPACE, " ")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS, digest=None) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    Three combining steps, each keyed by the digests *and the whole text*, so
    rows merge only if their content is equal: rows of one task (Spark's partial
    aggregation), salted digest groups, and the winners of the salts.  A copy
    held by a third of all rows thus reaches any later task as at most
    ``salts`` rows per map task.  The verdict returns to the rows by (digests,
    salt), so the way back is spread alike.

    ``digest`` maps the normalised text to a grouping digest (SHA-256 by
    default); XXH64 stands beside it.  Texts were compared in full by then: if
    different texts ever shared both digests the query would fail, not merge them.

    Null or empty texts form one group.  Of rows that repeat the smallest id one
    stays.  A group whose ids are all null keeps null and one row; else null ids
    never stay.  An empty table gives no rows; other columns are ignored.
    """
    norm = normalised(F.col(text_col))
    base = docs.select(F.col(id_col).alias("id"), norm.alias("norm")).select(
        "id", "norm", F.sha2("norm", 256).alias("sha"), F.xxhash64("norm").alias("check"), salt_of(F.col("id"), salts).alias("salt")
    )
    base = base.withColumn("digest", F.unhex("sha") if digest is None else digest(F.col("norm")))
    salted = base.groupBy("digest", "check", "salt", "norm").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
    winners = (
        salted.repartition("digest", "check")
        .groupBy("digest", "check", "norm")
        .agg(F.min("first").alias("keep_id"), F.sum("n").alias("group_size"), F.bit_or(salt_bit(F.col("salt"))).alias("salts"))
        .groupBy("digest", "check")
        .agg(F.count(F.lit(1)).alias("texts"), F.min("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"), F.bit_or("salts").alias("salts"))
    )
    verdicts = winners.where("group_size > 1").select(
        "digest",
        "check",
        F.explode(salts_in(F.col("salts"), salts)).alias("salt"),
        "keep_id",
        F.when(F.col("texts") > 1, F.raise_error(F.lit("different texts share both digests"))).otherwise(F.col("group_size")).alias("group_size"),
    )
    rows = base.select("id", "sha", "digest", "check", "salt").join(verdicts, ["digest", "check", "salt"], "left")
    alone = F.col("group_size").isNull()
    keep = F.when(alone, F.col("id")).otherwise(F.col("keep_id"))
    copy = F.row_number().over(W.partitionBy("digest", "check", "salt", "id").orderBy(F.lit(0)))
    return rows.select(
        F.col("id").alias(id_col),
        keep.alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (F.col("id").eqNullSafe(keep) & (alone | (copy == 1))).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def drop_exact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs``, all columns, without the rows that :func:`exact_groups` does not keep.

    Digests alone tell which texts occur once; only the others go through
    :func:`exact_groups`, and only the keys of rows that go (or repeat) come back,
    so that the table itself is sent nowhere while those keys are few.

    A row is known by its id and digest; of rows equal in both, one stays.  Null
    and empty texts are copies of each other; the columns keep their names and
    values, whatever they are; an empty table gives no rows.
    """
    k, n, sha, check = free_names(docs, "key", "copy", "sha", "check")
    norm = normalised(docs[text_col])
    told = docs.withColumns({sha: F.sha2(norm, 256), check: F.xxhash64(norm)})
    many = staged(told.groupBy(sha, check).agg(F.count(F.lit(1)).alias(n)).where(F.col(n) > 1).select(sha, check), "many")
    some = staged(with_small(told, many, [sha, check], "left_semi").select(id_col, text_col), "some")
    groups = exact_groups(some, id_col, text_col)
    key = lambda d, x: F.struct(d[id_col].alias("id"), x.alias("sha")).alias(k)
    verdicts = groups.select(key(groups, groups["text_sha256"]), "kept").groupBy(k).agg(F.max("kept").alias("kept"), F.count(F.lit(1)).alias("n"))
    verdicts = staged(verdicts.where("n > 1 or not kept").select(k, "kept"), "verdicts")
    keyed = docs.select("*", key(docs, F.sha2(norm, 256)))
    rows = with_small(keyed, verdicts, [k], "left_anti").select(docs.columns)
    repeated = verdicts.where("kept")
    if repeated.isEmpty():
        return rows
    one = keyed.join(repeated.select(k), k, "left_semi").withColumn(n, F.row_number().over(W.partitionBy(k).orderBy(F.lit(0)))).where(F.col(n) == 1)
    return rows.unionByName(one.select(docs.columns))
