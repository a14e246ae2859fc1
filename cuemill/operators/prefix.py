"""Ranks, running sums and earlier values inside keys of any size, by distributed prefix sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType
from pyspark.sql.window import Window as W

from cuemill.session import work_dir

#: Rows of a key that one task may number.
BLOCK = 1_000_000


def numbered(rows: DataFrame, key: list[str], order: list[str], sums: dict[str, Column] | None = None, earlier: dict[str, Column] | None = None, block: int = BLOCK) -> DataFrame:
    """Adds ``seq`` (the row's place in its key by ``order``, from 0), sums over the rows before it, and values of the row just before it.

    Keys of at most ``block`` rows take a window each.  Rows of larger ones are
    sorted over range partitions and written, so that a partition is a block of
    at most about ``block`` rows; blocks give their counts, sums and last values,
    a window over these few rows gives what comes before each block, and windows
    inside the blocks the rest.  ``order`` should tell all rows of a key apart:
    of equal ones any may come first, and a run of equal rows is never cut.
    Null keys are keys.
    """
    sums, earlier = sums or {}, earlier or {}
    names = rows.columns
    # what is summed or looked back at becomes a column of the rows first
    rows = rows.select(*[F.col(f"`{c}`") for c in names], *[c.cast("long").alias(f"_s{i}") for i, c in enumerate(sums.values())], *[c.alias(f"_e{i}") for i, c in enumerate(earlier.values())])
    hot = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > block)
    total = hot.agg(F.sum("_n")).first()[0]
    out = [*[F.col(f"`{c}`") for c in names], F.col("seq"), *[F.col(f"_t{i}").alias(n) for i, n in enumerate(sums)], *[F.col(f"_p{i}").alias(n) for i, n in enumerate(earlier)]]
    if not total:
        return _inside(rows, key, order, len(sums), len(earlier)).select(*out)
    keys = hot.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(key)])
    same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(key)]
    # hot keys are at most all rows over the block size
    cold = _inside(rows.join(keys, same, "left_anti"), key, order, len(sums), len(earlier)).select(*out)
    path = work_dir(rows.sparkSession, "blocks")
    dealt = rows.join(keys, same, "left_semi").repartitionByRange(-(-total // block) + 1, *key, *order)
    dealt.withColumn("_b", F.spark_partition_id()).write.parquet(path)
    sorted_ = rows.sparkSession.read.schema(StructType([*dealt.schema.fields, StructField("_b", IntegerType())])).parquet(path)
    last = F.max_by(F.struct(*[f"_e{i}" for i in range(len(earlier))], F.lit(0).alias("_")), F.struct(*order))
    blocks = sorted_.groupBy(*key, "_b").agg(F.count(F.lit(1)).alias("_n"), *[F.sum(f"_s{i}").alias(f"_s{i}") for i in range(len(sums))], last.alias("_last"))
    win = W.partitionBy(*key).orderBy("_b")
    before = win.rowsBetween(W.unboundedPreceding, -1)
    blocks = blocks.select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(key)],
        F.col("_b").alias("_kb"),
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_seq"),
        *[F.coalesce(F.sum(f"_s{i}").over(before), F.lit(0)).alias(f"_a{i}") for i in range(len(sums))],
        F.lag("_last").over(win).alias("_l"),
    )
    inner = _inside(sorted_, [*key, "_b"], order, len(sums), len(earlier))
    met = inner.join(blocks, [*same, F.col("_b") == F.col("_kb")])
    own = F.col("seq") == 0
    met = met.withColumns({f"_p{i}": F.when(own, F.col("_l")[f"_e{i}"]).otherwise(F.col(f"_p{i}")) for i in range(len(earlier))} | {f"_t{i}": F.col(f"_t{i}") + F.col(f"_a{i}") for i in range(len(sums))})
    return cold.unionByName(met.withColumn("seq", F.col("seq") + F.col("_seq")).select(*out))


def _inside(rows: DataFrame, key: list[str], order: list[str], sums: int, earlier: int) -> DataFrame:
    """``seq``, sums ``_t`` and earlier values ``_p`` by windows."""
    win = W.partitionBy(*key).orderBy(*order)
    before = win.rowsBetween(W.unboundedPreceding, -1)
    cols = {"seq": (F.row_number().over(win) - 1).cast("long")}
    cols |= {f"_t{i}": F.coalesce(F.sum(f"_s{i}").over(before), F.lit(0)) for i in range(sums)}
    cols |= {f"_p{i}": F.lag(f"_e{i}").over(win) for i in range(earlier)}
    return rows.withColumns(cols)
